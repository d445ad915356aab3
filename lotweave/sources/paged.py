"""Tables behind paged services, read page by page with retries, in batch or as a stream that resumes at its offset."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def fetch(url: str, tries: int = 30, most_wait: float = 300.0, wait: float = 1.0) -> bytes:
    """The answer; failures are tried again after waits that double up to most_wait."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return r.read()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(min(most_wait, wait * 2**k))
    raise ValueError("tries must be above 0")


class _Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class PagedTable(DataSource):
    """spark.read.format("paged").schema(...).options(url=..., page=..., rows=...): JSON records of a service.

    url has {limit} and {offset}; ``rows`` is the number of rows there, so that pages can be read side by side; ``records`` names
    the list in the answer, where the answer isn't a list. As a stream, the offset is the source's own, kept in the query's checkpoint: a page
    may come again after a failure, so repeated rows are dropped behind it by their id.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options, schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PageStream(self.options, schema)


def page_rows(options: dict, schema: StructType, offset: int) -> list[tuple]:
    limit = int(options.get("page", "1000"))
    found = json.loads(fetch(options["url"].format(limit=limit, offset=offset), int(options.get("tries", "30")), wait=float(options.get("wait", "1"))))
    for key in filter(None, options.get("records", "").split(".")):
        found = found[key]
    names = schema.fieldNames()
    if names == ["record"]:
        return [(json.dumps(r),) for r in found]
    return [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in found]


class _PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.fields = options, schema

    def partitions(self) -> list[_Page]:
        return [_Page(o) for o in range(0, int(self.options["rows"]), int(self.options.get("page", "1000")))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from page_rows(self.options, self.fields, partition.offset)


class _PageStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.fields = options, schema

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = page_rows(self.options, self.fields, start["offset"])
        return iter(rows), {"offset": start["offset"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["offset"]
        while at < end["offset"]:
            rows = page_rows(self.options, self.fields, at)[: end["offset"] - at]
            if not rows:
                return
            yield from rows
            at += len(rows)
