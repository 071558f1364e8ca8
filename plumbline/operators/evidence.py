"""Ranking and aggregation of evidence per claim.

Evidence rows: claim_id, evidence_id, semantic_score, source_url, published_at,
stance, weight. All aggregates fold before they shuffle, once, on claim_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scoring, stance, urls

def _claim():
    return Window.partitionBy("claim_id")


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scaled to 0..1 over a claim's rows; where all are equal the values stay."""
    lo, hi, x = F.min(col).over(_claim()), F.max(col).over(_claim()), F.col(col)
    flat = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return df.withColumn(out, F.when(flat, x).otherwise((x - lo) / (hi - lo)))


def with_trust(df: DataFrame, now: Column, source_score: Column) -> DataFrame:
    """Evidence with its trust and the parts that it is made of."""
    parts = df.withColumns({"source_part": source_score, "recency_part": scoring.recency_bucket(F.col("published_at"), now), "stance_part": scoring.stance_share(F.col("stance"))})
    return parts.withColumn("trust", scoring.trust(F.col("semantic_score"), F.col("source_part"), F.col("recency_part"), F.col("stance")))


def evidence_key(url: Column, statement: Column) -> Column:
    """What makes evidence the same: its normalised URL, or where it has none the hash of its statement."""
    return F.coalesce(urls.dedupe_key(url), F.md5(F.trim(F.lower(F.coalesce(statement, F.lit(""))))))


#: Parts of a score that are not worked out yet, and signals that rows bring along.
UNKNOWN_PART, SIGNALS = 0.5, ("claim_overlap", "anchor_match_score", "predicate_match_score", "object_relation_overlap")


def evidence_items(ranked: DataFrame, claims: DataFrame) -> DataFrame:
    """Ranked rows as evidence: statement, scores, source, date, stance towards the claim, kind, and score_components.

    ranked: claim_id and any of statement or fact, sem_score, final_score,
    score, source_url or source, published_at or publish_date, stance, the
    SIGNALS, topic_aligned, admissible_for_trust and candidate_type; further
    columns stay. claims: claim_id, claim. Columns that are missing count as
    null: scores as 0, flags as true. A stance that is missing or neutral is
    worked out from both texts.
    """
    have = set(ranked.columns)
    first = lambda kind, *names: F.coalesce(*[F.col(f"r.{n}").cast(kind) for n in names if n in have], F.lit(None).cast(kind))
    number = lambda *names: F.coalesce(first("double", *names), F.lit(0.0))
    semantic, total, text = number("sem_score", "final_score", "score"), number("final_score", "score"), first("string", "statement", "fact")
    rows = ranked.alias("r").join(claims.select("claim_id", F.col("claim").alias("_claim")), "claim_id", "left")
    made = {
        "statement": text, "semantic_score": semantic, "source_url": first("string", "source_url", "source"), "trust": total, "candidate_type": F.coalesce(first("string", "candidate_type"), F.lit("")),
        "published_at": F.coalesce(*[F.col(f"r.{n}") for n in ("published_at", "publish_date") if n in have], F.lit(None)), "stance": stance.restanced(first("string", "stance"), F.coalesce("_claim", F.lit("")), F.coalesce(text, F.lit(""))),
        "_parts": F.struct(*[number(n).alias(n) for n in SIGNALS], *[F.coalesce(first("boolean", n), F.lit(True)).alias(n) for n in ("topic_aligned", "admissible_for_trust")]),
    }
    kept = [F.col(f"r.{n}") if n != "claim_id" else F.col("claim_id") for n in ranked.columns if n not in {*made, "fact", "sem_score", "final_score", "score", "source", "publish_date", *SIGNALS, "topic_aligned", "admissible_for_trust"}]
    items = rows.select(*kept, *[v.alias(k) for k, v in made.items()])
    raw = F.when(F.lower("stance") == "entails", 1.0).when(F.lower("stance") == "contradicts", -1.0).otherwise(0.0)
    parts = F.struct(F.col("semantic_score").alias("semantic"), F.lit(UNKNOWN_PART).alias("source"), F.lit(UNKNOWN_PART).alias("recency"), raw.alias("stance_raw"), ((raw + 1) / 2).alias("stance_mapped"), F.col("trust").alias("trust"), "_parts.*")
    return items.withColumn("score_components", parts).drop("_parts")


def trust_ranked(df: DataFrame, k: int = 10) -> DataFrame:
    """By trust, then semantic score, then id; one row per evidence_key; the k first per claim.

    Rows are dealt by claim once: the best row of a key is marked by a window
    within its claim, and both windows keep the partitioning.
    """
    order = [F.desc("trust"), F.desc("semantic_score"), "evidence_id"]
    keyed = df.withColumn("key", evidence_key(F.col("source_url"), F.col("statement"))).repartition("claim_id")
    first = F.row_number().over(Window.partitionBy("claim_id", "key").orderBy(*order))
    one = keyed.withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return one.withColumn("rank", F.row_number().over(_claim().orderBy(*order))).filter(F.col("rank") <= k)


def quota_selected(df: DataFrame, k: int, quota: int, score: str) -> DataFrame:
    """k rows per claim, of which up to ``quota`` contradict; free places go to the best of the rest."""
    against = F.col("stance") == "contradicts"
    order = [F.desc(score), "evidence_id", "stance"]
    own = F.row_number().over(Window.partitionBy("claim_id", against).orderBy(*order))
    tier = df.withColumn("own", own).withColumn("first", F.when(against, F.col("own") <= quota).otherwise(F.col("own") <= k - quota))
    pick = F.row_number().over(_claim().orderBy(F.desc("first"), *order))
    return tier.withColumn("pick", pick).filter(F.col("pick") <= k).drop("own", "first")


def claim_metrics(ranked: DataFrame) -> DataFrame:
    """Per claim, over its ranked first rows: diversity of domains, agreement, trust with its grade, means weighted by trust, and the shares of trust by stance."""
    t, st = F.col("trust"), F.col("stance")
    weighted = {"semantic_mean": "semantic_score", "source_mean": "source_part", "recency_mean": "recency_part", "stance_mean": "stance_part"}
    agg = ranked.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set(F.coalesce(urls.domain(F.col("source_url")), F.lit("")))).alias("u"),
        F.avg(F.when(st != "contradicts", 1.0).otherwise(0.0)).alias("agreement"), F.sum(t * t).alias("tt"), F.sum(t).alias("t"),
        F.count_if(st == "entails").alias("n_entails"), F.count_if(st == "contradicts").alias("n_contradicts"), F.count_if(st == "neutral").alias("n_neutral"),
        *[F.sum(F.when(st == name, t).otherwise(0.0)).alias(out) for name, out in (("entails", "ts"), ("contradicts", "tc"))], *[F.sum(F.col(c) * t).alias(out) for out, c in weighted.items()],
    )
    n, u = F.col("n"), F.col("u")
    diversity = F.when(n <= 1, 0.0).when(u >= n, 1.0).otherwise(scoring.clamp01(1 - F.log(n / u) / u))
    share = lambda c: F.when(F.col("t") > 0, F.col(c) / F.col("t")).otherwise(0.0)
    rest = F.when(F.col("t") > 0, (F.col("t") - F.col("ts") - F.col("tc")) / F.col("t")).otherwise(1.0)
    return agg.select(
        "claim_id", "n", diversity.alias("diversity"), "agreement", share("tt").alias("trust_post"), scoring.post_grade(F.round(share("tt"), 9)).alias("trust_grade"), *[share(c).alias(c) for c in weighted],
        "n_entails", "n_contradicts", "n_neutral", share("ts").alias("support_mass"), share("tc").alias("contradict_mass"), rest.alias("uncertain_mass"),
    )


def top_domains(ranked: DataFrame, k: int = 5) -> DataFrame:
    """(claim_id, domains): the k most frequent domains of a claim's ranked rows, ties by the better rank; 'unknown' for rows without a URL."""
    key = F.when(F.coalesce(F.col("source_url"), F.lit("")) == "", "unknown").otherwise(F.substring_index(F.substring_index(F.col("key"), "/", 3), "/", -1))
    each = ranked.groupBy("claim_id", key.alias("domain")).agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("r"))
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "r", "domain")))
    return each.groupBy("claim_id").agg(F.slice(F.transform(by_count, lambda x: x["domain"]), 1, k).alias("domains"))


def noisy_or(df: DataFrame) -> DataFrame:
    """Per claim, over its admissible rows: one less the product of what each leaves open, for and against, the status by their margin, and the rows' ids.

    A claim all of whose rows are inadmissible is UNKNOWN, with no ids.
    """
    w, ok = scoring.clamp01(F.col("trust")), F.col("admissible")
    left = lambda p: F.coalesce(F.product(F.when(ok, 1 - scoring.clamp01(F.col(p)) * w)), F.lit(1.0))
    rounded = lambda x: F.round(scoring.clamp01(x), 9)
    agg = df.groupBy("claim_id").agg(
        rounded(1 - left("support")).alias("support"), rounded(1 - left("against")).alias("against"), F.round(F.coalesce(F.sum(F.when(ok, w)), F.lit(0.0)), 9).alias("mass"),
        F.array_sort(F.collect_set(F.when(ok, F.col("evidence_id")))).alias("evidence_ids"),
    )
    m = F.round(F.col("support") - F.col("against"), 9)
    status = (
        F.when(F.col("mass") < 0.15, "UNKNOWN").when(m >= 0.22, "VALID").when(m <= -0.22, "INVALID")
        .when(m >= 0.06, "PARTIALLY_VALID").when(m <= -0.06, "PARTIALLY_INVALID").otherwise("UNKNOWN")
    )
    return agg.withColumn("status", status)


def weight_entropy(df: DataFrame, weight: str) -> DataFrame:
    """Normalised entropy of a claim's positive weights; 1 if there are none.

    From sum(w) and sum(w ln w), so one pass is enough.
    """
    w = F.when(F.col(weight) > 0, F.col(weight))
    agg = df.groupBy("claim_id").agg(F.sum(w).alias("s"), F.sum(w * F.log(w)).alias("l"), F.count(w).alias("k"))
    ent = (F.log("s") - F.col("l") / F.col("s")) / F.log(F.greatest(F.col("k"), F.lit(2)))
    return agg.select("claim_id", F.coalesce(scoring.clamp01(ent), F.lit(1.0)).alias("entropy"))


def vote_agreement(df: DataFrame) -> DataFrame:
    """Share of the largest camp when each host votes by its weighted support."""
    host = F.coalesce(urls.host(F.col("source_url")), F.lit("unknown"))
    by_host = df.filter("weight > 0").groupBy("claim_id", host.alias("h")).agg(F.sum(F.col("weight") * F.col("support")).alias("s"), F.sum(F.col("weight") * F.col("against")).alias("r"))
    side = F.when(F.col("s") > F.col("r") + 1e-9, "s").when(F.col("r") > F.col("s") + 1e-9, "r").otherwise("n")
    votes = by_host.groupBy("claim_id", side.alias("side")).agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("claim_id").agg((F.max("c") / F.sum("c")).alias("agreement"))


def binary_verdict(x: Column) -> Column:
    """TRUE, FALSE or null, partial verdicts on the side that they lean to."""
    v = F.upper(F.trim(x))
    return F.when(v.isin("TRUE", "PARTIALLY_TRUE", "MOSTLY_TRUE"), "TRUE").when(v.isin("FALSE", "PARTIALLY_FALSE", "MISLEADING"), "FALSE")


def regression_metrics(df: DataFrame) -> DataFrame:
    """samples, accuracy, F1 of TRUE, and precision of the first three domains, over rows that have both verdicts.

    df: expected_verdict, predicted_verdict, expected_domains, predicted_domains.
    """
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    rows = df.select(binary_verdict(F.col("expected_verdict")).alias("e"), binary_verdict(F.col("predicted_verdict")).alias("p"), clean(F.col("expected_domains")).alias("want"), F.slice(clean(F.col("predicted_domains")), 1, 3).alias("got"))
    rows = rows.filter("e IS NOT NULL AND p IS NOT NULL")
    e, p, asked = F.col("e") == "TRUE", F.col("p") == "TRUE", (F.size("want") > 0) & (F.size("got") > 0)
    hits = F.size(F.filter("got", lambda d: F.array_contains(F.col("want"), d)))
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e == p).alias("same"), F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"),
        F.sum(F.when(asked, hits).otherwise(0)).alias("hits"), F.sum(F.when(asked, F.size("got")).otherwise(0)).alias("asked"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    f1 = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return agg.select(F.col("n").cast("double").alias("samples"), ratio(F.col("same"), F.col("n")).alias("accuracy"), f1.alias("f1_true"), ratio(F.col("hits"), F.col("asked")).alias("evidence_precision_at_3"))


def thresholds_pass(metrics: DataFrame, accuracy: float = 0.85, f1_true: float = 0.82, precision: float = 0.70) -> DataFrame:
    """metrics with ``passed``: no figure is below its threshold."""
    return metrics.withColumn("passed", (F.col("accuracy") >= accuracy) & (F.col("f1_true") >= f1_true) & (F.col("evidence_precision_at_3") >= precision))
