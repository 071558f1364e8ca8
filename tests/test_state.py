"""State that follows from events: batch and streaming forms against plain loops."""

import random

import pytest

from plumbline.operators import state
from plumbline.streaming import logs as streams


def by_force(events):
    """events in order: (domain, at, kind, seconds)."""
    held, out = {}, []
    for domain, at, kind, seconds in events:
        if kind == "success":
            held.pop(domain, None)
        else:
            s = held.setdefault(domain, {"count": 0, "last": 0.0, "until": 0.0})
            if kind == "cooldown":
                s["until"] = at + seconds
            else:
                s["count"] = 1 if at - s["last"] > 900 else s["count"] + 1
                if s["count"] >= 2:
                    s["until"] = at + 900
            s["last"] = at
        s = held.get(domain, {"count": 0, "until": 0.0})
        out.append((domain, at, s["count"], s["until"]))
    return out


@pytest.fixture(scope="module")
def events():
    draw = random.Random(3)
    at, out = 1000.0, []
    for _ in range(600):
        at += draw.choice((10.0, 200.0, 700.0))
        out.append((draw.choice("abc"), at, draw.choice(("failure", "failure", "failure", "success", "cooldown")), 500.0))
    return out


def test_domain_blocks(spark, events):
    got = state.domain_blocks(spark.createDataFrame(events, "domain string, at double, kind string, seconds double").repartition(5), ["at"]).collect()
    assert sorted((r["domain"], r["at"], r["failures"], r["blocked_until"]) for r in got) == sorted(by_force(events))


def write_in_order(spark, rows, schema, folder, parts=4):
    """Files that a stream reads in the order of time, one per trigger."""
    import os
    import time

    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        stamp = time.time() - 1000 + 10 * i
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.stat(path).st_mtime > time.time() - 500:
                os.utime(path, (stamp, stamp))


def run_stream(spark, stream, folder, name):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.read.parquet(f"{folder}/{name}").collect()


def test_stream_of_domain_blocks_agrees(spark, events, tmp_path):
    schema = "domain string, at double, kind string, seconds double"
    write_in_order(spark, events, schema, str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, state.stream_domain_blocks(stream), str(tmp_path), "out")
    assert sorted((r["domain"], r["at"], r["failures"], r["blocked_until"]) for r in got) == sorted(by_force(events))


def test_stream_token_bucket(spark, tmp_path):
    draw, at, rows = random.Random(5), 0.0, []
    for _ in range(200):
        at += draw.choice((0.0, 0.05, 0.4, 3.0))
        rows.append((draw.choice("pq"), round(at, 3)))
    write_in_order(spark, rows, "name string, at double", str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, state.stream_token_bucket(stream, 3, 1.0), str(tmp_path), "out")
    for name in "pq":
        started = sorted(r["started"] for r in got if r["name"] == name)
        asked = sorted(r["at"] for r in got if r["name"] == name)
        assert asked == sorted(t for n, t in rows if n == name) and all(s >= a - 1e-9 for a, s in zip(asked, started, strict=True))
        # no more than the bucket and its refill in any span
        for i in range(len(started)):
            for j in range(i + 1, len(started)):
                assert j - i + 1 <= 3 + 3 * (started[j] - started[i]) + 1e-6
        # nobody waits while there is a token
        free = [a for a, s in zip(asked, started, strict=True) if s == a]
        assert free and started[:3] == asked[:3]


def test_windowed_counts_leave_late_rows_out(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), "view", 1.0) for m in (0, 30, 300)]
    schema = "ts timestamp_ntz, event_type string, value double"
    write_in_order(spark, [*rows, (base + dt.timedelta(minutes=600), "view", 1.0)], schema, str(tmp_path / "in"), 2)
    stream = streams.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = run_stream(spark, streams.windowed_counts(stream), str(tmp_path), "out")
    assert sum(r["n"] for r in got) >= 2
