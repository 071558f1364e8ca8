"""Log channels as a stream: published records are kept in order, subscribers read on from where they were."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from plumbline.operators.ingest import channels
from plumbline.session import open_fs

SCHEMA = "id string, channel string, record string"


def publish(logs: DataFrame, path: str, number: int) -> None:
    """Write a batch of log records (id, level, request_id, ..) as publication ``number``, once for each of their channels.

    A publication that is repeated after a failure replaces itself; numbers grow.
    """
    from pyspark.sql import functions as F

    rows = channels(logs).select(F.col("id").cast("string").alias("id"), "channel", F.to_json(F.struct(*logs.columns)).alias("record"))
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{number:020d}")


class PublishedFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChannelReader(DataSourceStreamReader):
    """Offsets are publication numbers; a publication counts when it is complete, and each of its files is a partition."""

    def __init__(self, path: str, channel: str):
        self.path, self.channel = path.rstrip("/"), channel

    def _published(self) -> list[int]:
        fs, root = open_fs(self.path)
        names = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        done = [d.base_name for d in names if d.type == pafs.FileType.Directory and d.base_name.isdigit()]
        return sorted(int(n) for n in done if fs.get_file_info(f"{root}/{n}/_SUCCESS").type == pafs.FileType.File)

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        # a number that is still being written holds back later ones
        return {"after": max(self._published(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[PublishedFile]:
        fs, root = open_fs(self.path)
        out = []
        for n in self._published():
            if start["after"] < n <= end["after"]:
                files = fs.get_file_info(pafs.FileSelector(f"{root}/{n:020d}"))
                out += [PublishedFile(f"{self.path}/{n:020d}/{f.base_name}") for f in files if f.base_name.startswith("part-")]
        return out

    def read(self, partition: PublishedFile) -> Iterator[tuple]:
        fs, file = open_fs(partition.path)
        with fs.open_input_stream(file) as lines:
            for line in lines.read().splitlines():
                row = json.loads(line)
                if self.channel in ("", row["channel"]):
                    yield row.get("id"), row["channel"], row.get("record")

    def commit(self, end: dict) -> None:
        pass


class ChannelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_channel"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChannelReader:
        return ChannelReader(self.options["path"], self.options.get("channel", ""))


def subscribe(spark: SparkSession, path: str, channel: str = "logs:all") -> DataFrame:
    """The records of a channel as a stream (id, channel, record as JSON), from the first publication on; a query goes on from its checkpoint."""
    spark.dataSource.register(ChannelSource)
    return spark.readStream.format("log_channel").option("path", path).option("channel", channel).load()
