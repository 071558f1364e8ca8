"""Search providers and pages as tables of their own: stored answers, read by format name with the asked keys pushed down."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from plumbline.session import open_fs

#: Each provider's columns; the first is what it is asked by.
PROVIDERS = {
    "google": "query string, url string, title string, snippet string",
    "serper": "query string, url string, title string, snippet string",
    "pubmed": "query string, url string, title string, snippet string",
    "pages": "url string, html string",
}


class StoredFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class AnswerReader(DataSourceReader):
    """One partition for each stored Parquet file; what is asked is filtered while it is read, in Arrow batches."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.asked = path, columns, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            keys = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if keys is None or f.attribute != (self.columns[0],):
                yield f
            else:
                self.asked = keys if self.asked is None else self.asked & keys

    def partitions(self) -> list[StoredFile]:
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = [StoredFile(f.path) for f in files if f.type == pafs.FileType.File and f.base_name.endswith(".parquet")]
        return out or [StoredFile("")]

    def read(self, partition: StoredFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.path)
        key = pc.field(self.columns[0])
        chosen = None if self.asked is None else key.isin(pa.array(sorted(x for x in self.asked if x is not None), pa.string()))
        for batch in ds.dataset(partition.path, filesystem=fs, format="parquet").to_batches(columns=self.columns, filter=chosen):
            if batch.num_rows:
                yield batch.cast(pa.schema([(c, pa.string()) for c in self.columns]))


class AnswerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_answers"

    def schema(self) -> str:
        return PROVIDERS[self.options.get("provider", "google")]

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(self.options["path"], [f.name for f in schema.fields])


def answers(spark: SparkSession, path: str, provider: str = "google") -> DataFrame:
    """The stored answers of a provider as a table: filters on what it is asked by reach its reader."""
    spark.dataSource.register(AnswerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stored_answers").option("path", path).option("provider", provider).load()
