"""Command line: python -m rivulet COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import time

from rivulet.plans.commands import Archive, __version__, to_json
from rivulet.plans.config import Config
from rivulet.session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rivulet")
    p.add_argument("--path", help="archive folder")
    p.add_argument("--master", help="Spark master; by default that of spark-submit")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [a := sub.add_parser(name), [a.add_argument(*n, **k) for n, k in options]]
    opt = lambda *n, **k: (n, k)
    flag = lambda *n: (n, {"action": "store_true"})
    add("init", opt("--templates-dir", default=""), opt("--assets-dir", default=""))
    add("version")
    add("subscribe", opt("urls", nargs="+"), opt("--list", required=True), opt("--format"), flag("--discover"))
    add("unsubscribe", opt("url"), opt("--list", required=True), opt("--format"))
    add("fetch", opt("url", nargs="?", default=""), opt("--list", default=""), opt("--format"), opt("--max-items", type=int), opt("--max-age"), flag("--force"), flag("--remove-missing"), flag("--with-unfurl"))
    add("show", opt("url"), opt("--format", default="table"), opt("--limit", type=int, default=0), opt("--since", default=""), opt("--until", default=""), flag("--oldest"))
    add("unfurl", opt("url", nargs="?", default=""), opt("--limit", type=int, default=0), opt("--retry-after"), flag("--retry-immediate"))
    add("render", opt("--output"), opt("--max-age"), opt("--start", default=""), opt("--end", default=""), opt("--list", default=""), opt("--min-items", type=int), opt("--max-items", type=int), opt("--page-size", type=int), opt("--templates", default=""), opt("--assets", default=""))
    add("purge", opt("--max-age"), opt("--list", default=""), opt("--min-items", type=int), flag("--dry-run"), flag("--no-vacuum"))
    add("export", opt("file"), opt("--format"))
    add("serve", opt("--dir"), opt("--port", type=int))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    archive = Archive(get_spark("rivulet", a.master), Config.load({"path": a.path} if a.path else None))
    if a.command == "init":
        archive.init(a.templates_dir, a.assets_dir)
    elif a.command == "subscribe":
        new, known = archive.subscribe(a.urls, a.list, a.format, a.discover)
        print(to_json({"added": new, "already_listed": known}))
    elif a.command == "unsubscribe":
        return 0 if archive.unsubscribe(a.url, a.list, a.format) else 1
    elif a.command == "fetch":
        print(to_json(archive.fetch(a.url, a.list, a.format, None, a.max_items, a.max_age, a.force, a.remove_missing, a.with_unfurl or None)))
    elif a.command == "show":
        print(archive.show(a.url, a.format, a.limit, a.since, a.until, a.oldest))
    elif a.command == "unfurl":
        print(to_json(archive.unfurl(a.url, a.limit, a.retry_after, a.retry_immediate)))
    elif a.command == "render":
        print(to_json({"feeds": archive.render(a.output, a.max_age, a.start, a.end, a.list, a.min_items, a.max_items, a.page_size, a.templates, a.assets)}))
    elif a.command == "purge":
        print(to_json(archive.purge(a.max_age, a.list, a.min_items, a.dry_run, not a.no_vacuum)))
    elif a.command == "export":
        print(to_json({"feeds": archive.export(a.file, a.format)}))
    elif a.command == "serve":
        server = archive.serve(a.dir, a.port)
        try:
            while True:
                time.sleep(1)
        except KeyboardInterrupt:
            server.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(main())
