"""A paged REST source as a Python DataSource. The transport is a function that the caller passes by import path, so no network code is here."""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Window(InputPartition):
    def __init__(self, lo: str, hi: str):
        self.lo, self.hi = lo, hi


class PagedReader(DataSourceReader):
    """Options: fetch 'module:function' (lo, hi, page, size) -> (rows, total); windows 'lo/hi;lo/hi'; page_size, retries."""

    def __init__(self, options, schema):
        self.o, self.names = dict(options), schema.names

    def partitions(self):
        return [Window(*w.split("/")) for w in self.o["windows"].split(";") if w]

    def read(self, w):
        module, _, name = self.o["fetch"].partition(":")
        fetch, size, page, got = getattr(importlib.import_module(module), name), int(self.o.get("page_size", "25")), 0, 0
        while True:
            for attempt in range(int(self.o.get("retries", "3"))):
                try:
                    rows, total = fetch(w.lo, w.hi, page, size)
                    break
                except OSError:
                    if attempt + 1 == int(self.o.get("retries", "3")):
                        raise
            for r in rows:
                yield tuple(r.get(n) for n in self.names)
            got, page = got + len(rows), page + 1
            if not rows or got >= total:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return self.options.get("ddl", "value string")

    def reader(self, schema):
        return PagedReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
