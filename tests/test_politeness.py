"""The crawl plan: no host is asked too often, and workers are evenly used."""

import http.server
import random
import threading
import time
from collections import defaultdict

import pytest

from rivulet.plans import politeness, unfurl


def plan_of(spark, urls, delays, workers, request_ms=50):
    u = spark.createDataFrame([(x,) for x in urls], "url string").repartition(3)
    d = spark.createDataFrame(list(delays.items()), "host string, delay_ms bigint")
    return [r.asDict() for r in politeness.crawl_schedule(u, d, workers, request_ms).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_plan_keeps_every_delay(spark, seed):
    rnd = random.Random(seed)
    hosts = [f"h{k}.example" for k in range(rnd.randint(1, 40))]
    delays = {h: rnd.choice([10, 700, 2000, 5000]) for h in hosts if rnd.random() < 0.7}
    urls = [f"https://{rnd.choice(hosts)}/{k}" for k in range(300)] + [f"http://{hosts[0]}/p{k}" for k in range(200)]
    workers = rnd.choice([1, 4, 9])
    plan = plan_of(spark, [*urls, urls[0], None], delays, workers)
    assert sorted(r["url"] for r in plan) == sorted(set(urls))
    gap = {h: max(delays.get(h, 0), 50) for h in hosts}
    own, busy = defaultdict(list), defaultdict(list)
    for r in plan:
        own[r["host"]].append(r["start_ms"])
        busy[r["worker"]].append((r["start_ms"], r["host"]))
    for h, starts in own.items():
        starts.sort()
        assert all(b - a >= gap[h] for a, b in zip(starts, starts[1:]))
    for w, starts in busy.items():
        starts.sort()
        assert 0 <= w < workers and all(b[0] - a[0] >= gap[a[1]] or b[0] - a[0] >= 50 for a, b in zip(starts, starts[1:]))
    length = {h: len(s) * gap[h] for h, s in own.items()}
    bound = max(max(length.values()), -(-sum(length.values()) // workers))
    assert max(r["start_ms"] for r in plan) < bound  # within 4/3 of what no plan can beat


def test_plan_of_odd_tables(spark):
    assert plan_of(spark, [], {}, 3) == []
    plan = plan_of(spark, ["https://a/1", "no url", "HTTPS://A/2"], {"a": 400}, 2)
    assert {r["host"] for r in plan} == {"a", ""} and len(plan) == 3


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path != "/robots.txt":
            self.server.asked.append(time.monotonic())
        body = b"User-agent: *\nCrawl-delay: 0.4\nDisallow: /private\n" if self.path == "/robots.txt" else b"<title>T</title>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_are_fetched_at_the_delay(spark, tmp_path):
    from datetime import datetime

    servers = []
    for _ in range(2):
        s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
        s.asked = []
        threading.Thread(target=s.serve_forever, daemon=True).start()
        servers.append(s)
    urls = [(f"http://127.0.0.1:{s.server_port}/{k}",) for s in servers for k in range(5)] + [(f"http://127.0.0.1:{servers[0].server_port}/private/x",)]
    rows = unfurl.unfurl(spark.createDataFrame(urls, "url string"), datetime(2024, 1, 1), str(tmp_path), concurrency=3).collect()
    assert {r.url: r.title for r in rows} == {u: None if "private" in u else "T" for (u,) in urls}
    for s in servers:
        asked = sorted(s.asked)
        assert len(asked) == 5 and all(b - a > 0.35 for a, b in zip(asked, asked[1:]))
        s.shutdown()
