from pyspark.sql import functions as F

from plumbline.functions import scoring, text, urls
from plumbline.operators import dedup, evidence
from plumbline.streaming import logs as streams


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "  a \n b ", text.normalize_text) == "a b"
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "*a*... b", text.clean_statement) == "a. b"
    assert one(spark, "Über-Vitamin (D)!", text.sanitize_entity) == "über-vitamin (d)"
    assert one(spark, "<p>a &amp;lt; b</p>", text.remove_tags) == "a < b"
    assert one(spark, "Short. A sentence long enough! And one more here", text.sentences) == ["A sentence long enough!", "And one more here"]
    assert one(spark, "abcde fghij", lambda x: text.truncate_content(x, 8)) == "abcde fg..."
    assert one(spark, "abcdefg hij", lambda x: text.truncate_content(x, 8)) == "abcdefg..."


def test_urls(spark):
    assert one(spark, "https://www.Nih.gov/A/?q=1#f", urls.normalize_url) == "https://nih.gov/a"
    assert one(spark, "http://www.nih.gov:80/z/?utm_source=a&b=2&a=1#x", urls.dedupe_key) == "https://nih.gov/z?a=1&b=2"
    assert one(spark, "https://a.b.nih.gov/x", urls.root_domain) == "nih.gov"
    assert one(spark, "ftp://x", urls.is_valid_url) is False
    assert one(spark, "no url", urls.host) is None
    assert one(spark, "https://sub.who.int/", lambda u: urls.domain_in(u, ["who.int"])) is True
    assert one(spark, "https://notwho.int/", lambda u: urls.domain_in(u, ["who.int"])) is False


def test_scores(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    at = lambda x: x.cast("timestamp")
    assert one(spark, "2030-01-01", lambda x: scoring.recency_decay(at(x), now)) == 1.0
    assert one(spark, None, lambda x: scoring.recency_decay(at(x), now)) == 0.0
    assert one(spark, None, lambda x: scoring.recency_bucket(at(x), now)) == 0.5
    assert one(spark, "2023-09-01", lambda x: scoring.recency_bucket(at(x), now)) == 0.8
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(scoring.cosine(F.col("a"), F.col("b")).alias("z"), scoring.cosine(F.col("b"), F.col("b")).alias("o")).first()
    assert (row["z"], row["o"]) == (0.0, 1.0)


def test_minmax_of_equal_values_stays(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.4), (2, 1.0), (2, 3.0)], "claim_id int, v double")
    got = sorted((r.claim_id, r.n) for r in evidence.minmax(df, "v", "n").collect())
    assert got == [(1, 0.4), (1, 0.4), (2, 0.0), (2, 1.0)]


def test_keep_first_and_best_take_null_as_a_key(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (None, 2, 0.9), ("a", 3, None), ("a", 4, 0.0)], "k string, i int, s double")
    assert sorted(r.i for r in dedup.keep_first(df, ["k"], "i").collect()) == [1, 3]
    assert sorted(r.i for r in dedup.keep_best(df, ["k"], "s", "i").collect()) == [2, 3]


def test_stream_ingest(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    events = streams.read_events(spark, str(tmp_path / "in"), source.schema, 1)
    streams.ingest(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
