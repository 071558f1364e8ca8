"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "plumbline", cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    is a folder of our own made, and only in a local session, as tests have it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.conf.get("plumbline.local.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "checkpoint")
        spark.conf.set("plumbline.local.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a local path; on a cluster the path must be a shared one."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, through Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the shared one, for a table that one job writes and reads."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch_folder() whose rows nothing reads any more, through Spark's own file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    Unlike cut() it forgets how rows were dealt, so a join with it deals both
    sides anew and an adaptive plan can split a hot key; that cannot be done
    where one side comes dealt from an aggregate.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Values up to which a table of them is broadcast, by rows and by characters.
BROADCAST_VALUES, BROADCAST_CHARACTERS = 100_000, 32_000_000


def by_value(df: DataFrame, names: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``made`` adds to a table of ``names``, worked out once for each distinct row of these.

    For expressions on texts that come again and cost far more than comparing
    them. ``made`` works row by row and keeps ``names``. The values are written
    once; where they are few they are broadcast, else they are joined and an
    adaptive plan splits values that very many rows have.
    """
    values = written(made(written(df.select(*names).distinct())))
    size = values.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("c")).first()
    small = size["n"] <= BROADCAST_VALUES and size["c"] <= BROADCAST_CHARACTERS
    keys = {n: f"_value_{i}" for i, n in enumerate(names)}
    values = values.withColumnsRenamed(keys)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()])
    return df.join(F.broadcast(values) if small else values, same).drop(*keys.values())


def few_pairs(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The distinct rows of both tables, written, where their pairs are few enough to be broadcast; else None.

    What decides folds before it is shuffled, so tables whose rows all differ
    cost one more pass over them and no more.
    """
    about = [t.agg(F.approx_count_distinct(F.xxhash64(*t.columns)).alias("n")).first()["n"] for t in (left, right)]
    if about[0] * about[1] > BROADCAST_VALUES:
        return None
    return written(left.distinct()), written(right.distinct())


def with_values(df: DataFrame, names: list[str], values: DataFrame) -> DataFrame | None:
    """``df`` with the columns of ``values``, a row for each that ``df`` has in ``names``; None where they are too many or too long to be broadcast."""
    values = written(values)
    size = values.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("c")).first()
    if size["n"] > BROADCAST_VALUES or size["c"] > BROADCAST_CHARACTERS:
        return None
    keys = {n: f"_value_{i}" for i, n in enumerate(names)}
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()])
    return df.join(F.broadcast(values.withColumnsRenamed(keys)), same).drop(*keys.values())
