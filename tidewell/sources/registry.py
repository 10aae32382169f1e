"""Captured pages as a Spark data source: spark.read.format('posting_pages').option('path', folder)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*.json")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob(self.pattern))]

    def read(self, partition: InputPartition):
        file = Path(partition.value)
        search, _, page = file.stem.rpartition("-")
        yield search, int(page), file.read_text(encoding="utf-8")


class PagesSource(DataSource):
    """One file a page, named search-page.json; a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "posting_pages"

    def schema(self) -> str:
        return "search string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


SOURCES = {"posting_pages": PagesSource}


def register(spark: SparkSession, name: str) -> None:
    """Make a source known to a session; an unknown name fails."""
    spark.dataSource.register(SOURCES[name])
