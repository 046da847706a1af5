"""Fetching pages as a data source: a URL once, each host at its own pace, with retries.

``fetch_pages`` takes the different URLs of a frame, deals their hosts out to lanes and writes the lanes to the shared folder; the
source's partitions are the lanes. All URLs of a host are in one lane, whose task waits between two requests to a host
and backs off when one fails for now (no answer, 429, 5xx); a host that failed ``GIVE_UP`` times in a row isn't asked again.
A lane interleaves its hosts, so one host's pause is spent on others. Each row comes back as soon as it is there, with the page
or what went wrong. Neither URLs nor pages pass the driver, and the result is stored: a plan that reads it again doesn't fetch again.
"""

from __future__ import annotations

import heapq
import itertools
import json
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.error import HTTPError

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import drop_stored, shared_dir, stored

LANES, RETRIES, PACE, GIVE_UP = 64, 3, 1.0, 10
PAGES = "url string, html string, error string, attempts int"


def host_of(url: str) -> str:
    """Host and port, lower-cased."""
    from urllib.parse import urlsplit

    try:
        return (urlsplit(url).netloc.rpartition("@")[2] or "").lower()
    except ValueError:
        return ""


def passing(error: Exception) -> bool:
    """Whether a failure may be gone the next time."""
    if isinstance(error, HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, OSError)  # no answer, time out, connection reset


def fetch_lane(urls: Iterator[str], fetch: Callable[[str], str], retries: int = RETRIES, pace: float = PACE, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """PAGES of ``urls``: requests to one host at least ``pace`` seconds apart, twice as long after each failed attempt."""
    hosts: dict[str, list[str]] = {}
    for url in urls:
        hosts.setdefault(host_of(url), []).append(url)
    number = itertools.count()
    due = [(0.0, next(number), host) for host in sorted(hosts)]  # when a host may be asked again
    heapq.heapify(due)
    attempts, failed = dict.fromkeys(hosts, 0), dict.fromkeys(hosts, 0)
    for left in hosts.values():
        left.sort(reverse=True)
    while due:
        at, _, host = heapq.heappop(due)
        url = hosts[host][-1]
        if failed[host] >= GIVE_UP:
            for u in reversed(hosts[host]):
                yield u, None, "HostGivenUp: too many failures in a row", 0
            continue
        now = clock()
        if at > now:
            sleep(at - now)
        attempts[host] += 1
        wait = pace
        try:
            row = (url, fetch(url), None, attempts[host])
            failed[host] = 0
        except Exception as e:  # noqa: BLE001  what the page's fetcher raises is that row's error
            failed[host] += 1
            row = None if passing(e) and attempts[host] <= retries and failed[host] < GIVE_UP else (url, None, f"{type(e).__name__}: {e}", attempts[host])
            wait = pace * 2 ** attempts[host] if row is None else pace
        if row:
            yield row
            hosts[host].pop()
            attempts[host] = 0
        if hosts[host]:
            heapq.heappush(due, (clock() + wait, next(number), host))


class _Lane(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def page_source(fetch: Callable[[str], str]) -> type[DataSource]:
    """The data source ``fetched_pages`` with the given fetcher. Options: lanes (JSON lists of files), retries, pace."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.lanes, self.retries, self.pace = json.loads(options["lanes"]), int(options["retries"]), float(options["pace"])

        def partitions(self):
            return [_Lane(files) for files in self.lanes] or [_Lane([])]

        def read(self, partition):
            import pyarrow.parquet as pq
            from pyarrow import fs

            urls = []
            for f in partition.files:
                system, path = fs.FileSystem.from_uri(f)
                urls += pq.read_table(path, columns=["url"], filesystem=system, partitioning=None)["url"].to_pylist()
            yield from fetch_lane(iter(urls), fetch, self.retries, self.pace)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "fetched_pages"

        def schema(self):
            return PAGES

        def reader(self, schema):
            return Reader(self.options)

    return Pages


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str], retries: int = RETRIES, pace: float = PACE, lanes: int = LANES) -> DataFrame:
    """PAGES, one row per different URL of ``urls`` (url; nulls are left out), stored."""
    spark = urls.sparkSession
    host = F.lower(F.element_at(F.split(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1), "@"), -1))
    plan = urls.where("url is not null").select("url").distinct().withColumn("lane", F.pmod(F.xxhash64(host), F.lit(lanes)))
    root = f"{shared_dir(spark)}/urls-{uuid.uuid4().hex}"
    plan.repartition("lane").write.partitionBy("lane").parquet(root)
    files: dict[str, list[str]] = {}
    for f in spark.read.parquet(root).inputFiles() if plan.take(1) else []:
        files.setdefault(f.rpartition("/")[0], []).append(f)
    spark.dataSource.register(page_source(fetch))
    pages = spark.read.format("fetched_pages").option("lanes", json.dumps(list(files.values()))).option("retries", retries).option("pace", pace).load()
    out = stored(pages, "fetched-pages")
    if files:
        drop_stored(spark.read.parquet(root))
    return out
