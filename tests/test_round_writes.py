"""What rounds write."""

from pyspark.sql import functions as F

from plumbline.operators import rounds


def test_rows_of_a_round_are_written_once(spark, monkeypatch):
    wrote, cut = [], rounds.cut
    monkeypatch.setattr(rounds, "cut", lambda df: wrote.append("final_score" in df.columns) or cut(df))
    ranked = spark.createDataFrame([(1, 0.9), (2, 0.1), (2, 0.2), (3, 0.1)], "claim_id int, final_score double")
    known = spark.createDataFrame([(2, "u")], "claim_id int, url string")
    search = lambda weak, number: weak.filter("claim_id = 2").select("claim_id", F.lit(f"a{number}").alias("url"))
    rank = lambda fresh, number: fresh.select("claim_id", F.lit(0.2 + 0.1 * number).alias("final_score"))
    rows, ends = rounds.reinforced(ranked, known, search, rank, 0.9, rounds=2)
    assert sum(wrote) == 3
    assert sorted((r.claim_id, round(r.final_score, 6)) for r in rows.collect()) == [(1, 0.9), (2, 0.4), (3, 0.1)]
    assert sorted((r.claim_id, r.rounds, r.reason) for r in ends.collect()) == [(1, 0, rounds.ENOUGH_NOW), (2, 2, rounds.LAST_ROUND), (3, 0, rounds.FEW_URLS)]
