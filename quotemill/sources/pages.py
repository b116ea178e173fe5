"""A data source for feeds that come in pages, each with a cursor to the next: spark.read.format('paged_json')."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Series(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class PagedReader(DataSourceReader):
    """Follows the cursors of each series to the end, or max_pages at most where that is set, one task a series. A cursor that comes again ends a series."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.items = options["path"], options.get("items", "markets")
        self.most = int(options.get("max_pages", "0"))
        self.series = [s for s in options.get("series", "").split(",") if s]

    def partitions(self) -> list[Series]:
        return [Series(s) for s in dict.fromkeys(self.series or sorted(os.listdir(self.folder)))]

    def read(self, partition: Series) -> Iterator[tuple[str, str, str]]:
        page, seen = "first", set()
        while page and page not in seen and (not self.most or len(seen) < self.most):
            seen.add(page)
            path = os.path.join(self.folder, partition.name, f"{page}.json")
            if not os.path.exists(path):
                return
            with open(path, encoding="utf-8") as f:
                body = json.load(f)
            for item in body.get(self.items) or []:
                yield partition.name, page, json.dumps(item)
            page = body.get("cursor") or ""


class PagedJson(DataSource):
    """Options: path (a folder of series, each a folder of <cursor>.json from first.json on), series (comma-separated, default all), items (the list's name), max_pages (default all)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "series string, page string, payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
