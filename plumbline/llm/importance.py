"""Importance resampling towards a target: hashed n-gram features, one gain for each bucket.

A position table holds one row for each word of each document: the words are
posexploded, and lead() over the document's window brings up the words that
follow, one n-gram for each order. Every n-gram is hashed to a bucket. Buckets
are counted over the raw and the target texts; a bucket's gain is the log ratio
of its two shares, and a document's weight the sum of its features' gains.
Gumbel noise turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.ranges import with_running_sum
from plumbline.session import cut, remove_folder, scratch_folder

#: Runs of digits, a-z and non-ASCII characters, in texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
ORDERS = 3


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are; lower() does the same, faster, to texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def position_table(docs: DataFrame, id_col: str, text_col: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(rid, id, b1 .. b<orders>): a row for each word with the buckets of the n-grams that begin there.

    rid numbers the rows of docs, so rows that share an id stay apart. A text
    without words has one row of null buckets. Texts are dealt once, by rid;
    exploding, the windows and any count by rid keep that partitioning.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    words = rows.repartition("rid").select("rid", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "w1"))
    ahead = Window.partitionBy("rid").orderBy("pos")
    words = words.select("rid", "id", "w1", *[F.lead("w1", n).over(ahead).alias(f"w{n + 1}") for n in range(1, orders)])

    def bucket(n: int) -> Column:
        # a null word makes the whole n-gram null
        gram = F.concat(*[x for i in range(1, n + 1) for x in (F.lit(" "), F.col(f"w{i}"))][1:])
        return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int").alias(f"b{n}")

    return words.select("rid", "id", *[bucket(n) for n in range(1, orders + 1)])


def _features(table: DataFrame, orders: int) -> DataFrame:
    """(rid, id, n, bucket): the features of a position table; documents without any have one row of null bucket."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"b{n}").alias("bucket")) for n in range(1, orders + 1)])
    return table.select("rid", "id", F.explode(each).alias("f")).select("rid", "id", "f.n", "f.bucket").filter("bucket IS NOT NULL OR n = 1")


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, c) over a position table, counted inside the map tasks first."""
    return _features(table, orders).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), at most ``buckets`` rows: floor(1000 * ln(target's share / raw share)), each count raised by one."""
    raw, target = raw.select("bucket", F.col("c").alias("s")), target.select("bucket", F.col("c").alias("t"))
    both = raw.join(target, "bucket", "full")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    s, t = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in "st")
    ratio = ((t + 1) * (F.col("all_s").cast("double") + buckets)) / ((s + 1) * (F.col("all_t").cast("double") + buckets))
    return both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # total is one row


def noise(id_: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id, from the first 32 bits of sha256('seed:id'); a null id is the empty word."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", draw_pct: int = 5, least_words: int = 20, seed: int = 42, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Of the N rows with at least ``least_words`` words those with the
    floor(draw_pct * N / 100) highest scores are drawn; rank is 1, 2, 3 .. among
    them, null for the others. Ties go to the smaller id, null ids first, and
    between rows alike in both to any of them.

    The position table is written once and read twice, for the counts and for
    the weights: two numbers of four bytes at most for each feature; it is
    deleted before the result is returned. Only the table of gains, bounded by
    ``buckets``, is broadcast. Long documents are windows that spill; common
    n-grams are counted inside the map tasks.

    Null and empty texts, and texts without words, have no features: weight 0
    and never drawn. Rows with equal ids are judged each by its own text. An
    empty ``docs`` gives no rows; an empty target's buckets count 0. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "positions")
    position_table(docs, id_col, text_col, orders, buckets).write.parquet(folder)
    table = spark.read.parquet(folder)
    aims = bucket_counts(position_table(target, target_id, target_text, orders, buckets), orders)
    gains = bucket_gains(bucket_counts(table, orders), aims, buckets)
    found = _features(table, orders).join(F.broadcast(gains), "bucket", "left").groupBy("rid", "id").agg(
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"), F.count_if((F.col("n") == 1) & F.col("bucket").isNotNull()).alias("words")
    )
    scored = cut(found.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("words") < least_words).alias("out")))
    remove_folder(spark, folder)
    drawn = draw_pct * scored.filter("NOT out").count() // 100
    ranked = with_running_sum(scored.withColumn("down", -F.col("score")), ["out", "down", "id", "rid"], F.lit(1), "before")
    rank = F.when(~F.col("out") & (F.col("before") < drawn), F.col("before") + 1)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that importance_scores() draws, with all their columns; of rows that share an id all that are alike in it."""
    drawn = importance_scores(docs, target, id_col, **options).filter("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    rows = docs.join(drawn, docs[id_col].eqNullSafe(drawn["_drawn"]), "left_semi")
    return rows
