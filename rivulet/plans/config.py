"""Configuration with its defaults; values come from a mapping or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass
class Config:
    """Settings of all commands; durations are texts such as '24h'."""

    path: str = "feeds.archive"
    feedlist: str = ""
    feedlist_format: str = "opml"
    fetch_concurrency: int = 32
    fetch_max_items: int = 100
    fetch_max_age: str = ""
    with_unfurl: bool = False
    unfurl_concurrency: int = 32
    unfurl_retry_after: str = "1h"
    unfurl_skip_robots: bool = False
    render_max_age: str = "24h"
    render_output: str = "build"
    min_items_per_feed: int = 5
    max_items_per_feed: int = 50
    feeds_per_page: int = 25
    purge_max_age: str = "30d"
    purge_min_items: int = 0
    serve_port: int = 8889
    serve_dir: str = "build"

    @classmethod
    def load(cls, values: Mapping | None = None, environ: Mapping | None = None, prefix: str = "RIVULET_") -> Config:
        """Defaults, then ``values``, then variables such as RIVULET_PATH.

        An unknown key in ``values`` is an error.
        """
        environ = os.environ if environ is None else environ
        out = cls()
        known = {f.name: type(getattr(out, f.name)) for f in fields(cls)}
        found = dict(values or {})
        if unknown := set(found) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        found |= {n: environ[prefix + n.upper()] for n in known if prefix + n.upper() in environ}
        for name, value in found.items():
            kind = known[name]
            if kind is bool and isinstance(value, str):
                value = value.strip().lower() in ("1", "true", "yes", "on")
            setattr(out, name, kind(value))
        return out
