"""When and by whom link pages are asked for, so that no host is asked too often."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import html as H
from rivulet.operators.ordering import with_running
from rivulet.sources import feeds as source

#: Milliseconds that a request is taken to need.
REQUEST_MS = 50


def host(url: str = "url"):
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def crawl_delays(robots: DataFrame) -> DataFrame:
    """(host, delay_ms) of robots(host, body); hosts without a delay are left out."""
    rules = robots.groupBy("host").agg(F.first("body").alias("body")).select("host", H.parse_robots("body").alias("r"))
    delay = F.ceil(F.col("r.crawl_delay") * 1000).cast("bigint")
    return rules.select("host", delay.alias("delay_ms")).filter("delay_ms > 0")


def crawl_schedule(urls: DataFrame, delays: DataFrame, workers: int, request_ms: int = REQUEST_MS) -> DataFrame:
    """(url, host, worker, start_ms) for distinct URLs: a plan that keeps every delay.

    A host's requests follow each other at its gap: its delay, or the length of a
    request. All of them, hosts with most to do first, are laid end to end (a running
    sum of gaps) and cut into ``workers`` lengths of equal time. A host that a cut
    divides goes on at the beginning of the next worker; as no host needs more than the
    whole length, the two parts are a gap apart at least. The length is the larger of the
    longest host's need and an even share of all, which no plan whose workers wait out
    the gaps of the host they are at can beat, so the plan ends within a gap of the best.

    Null URLs are left out, a URL without a host counts for the host ''. Repeated URLs
    are asked for once.
    """
    asked = urls.select("url").filter("url is not null").distinct().withColumn("host", host())
    gap = F.greatest(F.coalesce("delay_ms", F.lit(0)), F.lit(request_ms)).cast("bigint")
    hosts = asked.groupBy("host").agg(F.count("*").alias("n")).join(delays.select("host", "delay_ms"), "host", "left")
    hosts = hosts.select("host", gap.alias("gap"), (F.col("n") * gap).alias("length"))
    bound = hosts.agg(F.greatest(F.max("length"), F.ceil(F.sum("length") / workers)).cast("bigint").alias("bound"))
    order = [F.col("length").desc(), F.col("host").asc(), F.col("url").asc()]
    laid = with_running(asked.join(hosts, "host"), order, F.col("gap"), "end")
    at = F.col("end") - F.col("gap")
    # One row: the length of the plan.
    placed = laid.crossJoin(F.broadcast(bound)).withColumn("at", at)
    return placed.select("url", "host", F.expr("at div bound").cast("int").alias("worker"), F.expr("at % bound").alias("start_ms"))


def scheduled_pages(urls: DataFrame, delays: DataFrame, workers: int, limit: int | None = H.PAGE_LIMIT, request_ms: int = REQUEST_MS) -> DataFrame:
    """(url, status, body, error) of pages, fetched by the plan.

    Workers start together (a barrier), so that the parts of a divided host stay apart;
    there are no more of them than the session can run at once. A worker that falls
    behind still keeps the gap to its own last request of a host.
    """
    workers = max(1, min(workers, urls.sparkSession.sparkContext.defaultParallelism))
    gaps = F.greatest(F.coalesce("delay_ms", F.lit(0)), F.lit(request_ms)).alias("gap_ms")
    plan = crawl_schedule(urls, delays, workers, request_ms).join(delays.select("host", "delay_ms"), "host", "left")
    plan = plan.select("url", "host", "worker", "start_ms", gaps).repartitionById(workers, "worker").sortWithinPartitions("start_ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        BarrierTaskContext.get().barrier()
        began, last = time.monotonic(), {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                due = max(began + r.start_ms / 1000, last.get(r.host, began - 1e9) + r.gap_ms / 1000)
                time.sleep(max(0.0, due - time.monotonic()))
                last = {r.host: time.monotonic()}  # a worker stays with a host until it is done
                got = source.get(r.url, limit=limit)
                rows.append((r.url, got["status"], got["body"], got["error"]))
            out = pd.DataFrame(rows, columns=["url", "status", "body", "error"])
            out["status"] = out["status"].astype("Int32")
            yield out

    return plan.mapInPandas(run, "url string, status int, body string, error string", barrier=True)
