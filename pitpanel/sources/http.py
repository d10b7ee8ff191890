"""Paged REST sources as Spark data sources, with retries and daily quotas.

A partition is one enumeration (a series, a market's request window, a search); it pages
through its results by cursor. ``fetch(url, params) -> dict`` is a parameter, so the same
source reads a live service or recorded pages.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pitpanel.sources.files import replace_json


class QuotaExhausted(RuntimeError):
    """Every key has reached its daily cap."""


class Quota:
    """Requests a day and key (UTC), kept in a file; the least used key is next."""

    def __init__(self, keys: int, cap: int, path: str, today: Callable[[], str] = lambda: time.strftime("%Y-%m-%d", time.gmtime())):
        self.keys, self.cap, self.path, self.today = keys, cap, path, today

    def take(self) -> int:
        used = [0] * self.keys
        if os.path.exists(self.path):
            with open(self.path) as source:
                held = json.load(source)
            if held.get("day") == self.today() and len(held.get("used", [])) == self.keys:
                used = held["used"]
        key = min(range(self.keys), key=used.__getitem__)
        if used[key] >= self.cap:
            raise QuotaExhausted(f"all {self.keys} keys have made {self.cap} requests today")
        used[key] += 1
        replace_json(self.path, {"day": self.today(), "used": used})
        return key


def with_retries(call: Callable[[], dict], tries: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; after a failure it waits, twice as long each time."""
    for k in range(tries):
        try:
            return call()
        except (OSError, ValueError):
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)
    raise ValueError("tries must be positive")


def pages(fetch: Callable[[str, dict], dict], url: str, params: dict, items: str, most: int = 1_000_000, stop: Callable[[list], bool] | None = None) -> Iterator[dict]:
    """Items of all pages: follows ``cursor`` until it is empty, or a page satisfies ``stop``."""
    cursor = None
    for _ in range(most):
        page = with_retries(lambda: fetch(url, params | ({"cursor": cursor} if cursor else {})))
        found = page.get(items) or []
        yield from found
        cursor = page.get("cursor")
        if not cursor or not found or (stop and stop(found)):
            return


class Request(InputPartition):
    def __init__(self, params: dict):
        super().__init__(params)
        self.params = params


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, dict], dict]):
        self.url, self.items = options["url"], options["items"]
        self.requests = json.loads(options["requests"])
        self.fetch = fetch

    def partitions(self) -> list[Request]:
        return [Request(p) for p in self.requests]

    def read(self, partition: Request) -> Iterator[tuple]:
        for item in pages(self.fetch, self.url, partition.params, self.items):
            yield json.dumps(partition.params, sort_keys=True), json.dumps(item, sort_keys=True)


def read_pages(spark: SparkSession, fetch: Callable[[str, dict], dict], url: str, items: str, requests: list[dict]) -> DataFrame:
    """``request, item`` (JSON text) of all requests, one partition each."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_rest"

        def schema(self) -> str:
            return "request string, item string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(self.options, fetch)

    spark.dataSource.register(Paged)
    return spark.read.format("paged_rest").options(url=url, items=items, requests=json.dumps(requests)).load()


def http_get(url: str, params: dict) -> dict:
    """A plain GET of JSON with the standard library."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    with urlopen(f"{url}?{urlencode(params)}", timeout=30) as answer:
        return json.load(answer)
