"""Flushed logs, learned marks, channels and stored answers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.sources import channels, search
from plumbline.streaming import flushing, learning
from plumbline.streaming.learning import MARKS

from test_state import write_in_order


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_a_lone_record_leaves_by_the_timer(rocks, tmp_path):
    rows = [(str(i), "a") for i in range(23)] + [("x", "b"), (None, None)]
    rocks.createDataFrame(rows, "id string, module string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema("id string, module string").parquet(str(tmp_path / "in"))
    query = flushing.flushed(stream, seconds=2).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        got = []
        for _ in range(60):
            time.sleep(1)
            got = rocks.table("flushed").collect()
            if sum(len(r.ids) for r in got) == len(rows):
                break
    finally:
        query.stop()
    by = {(r.key, r.flush): r for r in got}
    assert [(by["a", n].reason, len(by["a", n].ids)) for n in (1, 2, 3)] == [("full", 10), ("full", 10), ("timer", 3)]
    assert by["b", 1].reason == "timer" and list(by["b", 1].ids) == ["x"] and list(by["", 1].ids) == [None]
    assert sorted(i for r in got for i in r.ids if i is not None) == sorted(i for i, _ in rows if i is not None)


RESULTS = "claim_type string, query string, at double, anchors array<string>, results array<struct<url:string,title:string,snippet:string>>"


def asked(n=160, seed=2):
    draw, out, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += draw.choice((0.0, 40.0, 900.0, 5000.0))
        results = []
        for j in range(draw.randint(0, 10)):
            word = draw.choice(("zinc prevents colds", "a manual", "policy handbook", "brochure", "plain page", "zinc template"))
            host = draw.choice(("www.cdc.gov", "pubmed.ncbi.nlm.nih.gov", "blog.example"))
            results.append((f"https://{host}/{draw.choice(('a', 'b.pdf', 'c'))}{j % 4}", word, draw.choice((None, "zinc", ""))))
        out.append((draw.choice(("EFFICACY", "MYTH", "GENERAL")), f"q{i}", at, ["zinc"], results))
    return [*out, ("MYTH", "none", at, None, None)]


def test_processed_results(spark):
    items = [(f"https://www.cdc.gov/p{i}", "zinc prevents colds" if i in (1, 4) else "a manual", None) for i in range(10)]
    rows = [("EFFICACY", "two", 1.0, ["zinc"], [items[1], items[4], *items]), ("EFFICACY", "one", 1.0, ["zinc"], items), ("EFFICACY", "no", 1.0, ["tea"], [items[0]] * 3), ("EFFICACY", "bad", 1.0, [], [("https://blog.example/x", "zinc", None), (None, None, None), ("", "a", "b")])]
    got = {r.query: r for r in learning.processed(spark.createDataFrame(rows, RESULTS)).collect()}
    assert len(got["two"].selected) == 3 and got["two"].selected[:2] == [items[1][0], items[4][0]] and got["two"].learned == ["manual"]
    assert len(got["one"].selected) == 5 and len(got["one"].trusted) == 10
    assert got["no"].selected == [items[0][0]] and got["bad"].trusted == got["bad"].selected == got["bad"].learned == []


def test_learned_marks_by_force_and_by_stream(rocks, tmp_path):
    rows = asked()
    done = learning.processed(rocks.createDataFrame(rows, RESULTS))
    learned = [(r.claim_type, r.query, r.at, r.learned) for r in done.collect()]
    want = {}
    for kind, q, at, _ in learned:
        last = {m: max((t for k, _, t, ms in learned if k == kind and t < at and m in ms), default=None) for m in MARKS}
        want[q] = sorted(m for m, t in last.items() if t is not None and at - t <= 6000)
    batch = {r.query: r.left_out for r in learning.with_learned(done, 6000.0).collect()}
    assert batch == want and any(want.values()) and not all(want.values())
    # the queries of one moment stay in one file
    write_in_order(rocks, sorted(rows, key=lambda r: r[2]), RESULTS, str(tmp_path / "in"), 1)
    stream = rocks.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = learning.stream_learned(learning.processed(stream), 6000.0).writeStream.format("memory").queryName("learned").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.query: list(r.left_out) for r in rocks.table("learned").collect()} == want


def logs(spark, ids):
    return spark.createDataFrame([(i, "ERROR" if i % 2 else "INFO", f"r{i % 3}" if i % 4 else None, f"message {i}") for i in ids], "id long, level string, request_id string, message string")


def test_subscribers_go_on_from_their_checkpoint(spark, tmp_path):
    path, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        query = channels.subscribe(spark, path, "logs:level:ERROR").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(int(r.id) for r in spark.read.parquet(out).collect())

    channels.publish(logs(spark, range(10)), path, 1)
    assert run() == [1, 3, 5, 7, 9]
    channels.publish(logs(spark, range(10, 15)), path, 2)
    channels.publish(logs(spark, range(10, 15)), path, 2)  # repeated after a failure
    channels.publish(logs(spark, range(15, 17)), path, 3)
    assert run() == [1, 3, 5, 7, 9, 11, 13, 15]
    assert run() == [1, 3, 5, 7, 9, 11, 13, 15]
    row = spark.read.parquet(out).filter("id = '1'").first()
    assert row.channel == "logs:level:ERROR" and '"message":"message 1"' in row.record


def test_stored_answers_push_the_query_down(spark, tmp_path):
    rows = [(f"q{i % 7}", f"https://a.example/{i}", f"t{i}", None) for i in range(70)] + [(None, "u", "t", "s")]
    spark.createDataFrame(rows, "query string, url string, title string, snippet string").repartition(3).write.parquet(str(tmp_path / "a"))
    table = search.answers(spark, str(tmp_path / "a"))
    assert table.count() == 71 and table.rdd.getNumPartitions() == 3
    one = table.filter("query = 'q3'")
    assert one.count() == 10 and {r.query for r in one.collect()} == {"q3"}
    assert table.filter(F.col("query").isin("q1", "q2") & (F.col("title") != "t1")).count() == 19
    pages = tmp_path / "p"
    spark.createDataFrame([("https://a.example/1", "<p>x</p>")], "url string, html string").write.parquet(str(pages))
    assert search.answers(spark, str(pages), "pages").filter("url = 'https://a.example/1'").first().html == "<p>x</p>"
    reader = search.AnswerReader("x", ["query", "url"])
    from pyspark.sql.datasource import EqualTo, In

    left = list(reader.pushFilters([EqualTo(("query",), "a"), In(("query",), ("a", "b")), EqualTo(("url",), "u")]))
    assert reader.asked == {"a"} and len(left) == 1
