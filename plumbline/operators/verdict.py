"""From the weighted evidence of a claim to its verdict.

Scored evidence rows: claim_id, source_url, weight, p_support, p_against,
p_neutral, admissible. The evidence is folded once per claim and host and once
per claim; every later step is column arithmetic on one row per claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.functions.scoring import clamp01, sigmoid

#: What a segment's status says about the truth of the claim.
STATUS_TRUTH = {"STRONGLY_VALID": 1.0, "VALID": 1.0, "PARTIALLY_VALID": 0.75, "PARTIALLY_INVALID": 0.25, "INVALID": 0.20, "UNKNOWN": 0.45}


def evidence_mass(scores: DataFrame) -> DataFrame:
    """Per claim: masses, entropy of weights, agreement of hosts, and the share of rows that count."""
    counts = F.col("admissible") & (F.col("weight") > 0)
    w = F.when(counts, F.col("weight"))
    host = F.coalesce(urls.host(F.col("source_url")), F.lit("unknown"))
    by_host = scores.groupBy("claim_id", host.alias("host")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(w).alias("k"), F.sum(w).alias("w"), F.sum(w * F.log(w)).alias("wl"),
        F.sum(w * F.col("p_support")).alias("s"), F.sum(w * F.col("p_against")).alias("r"), F.sum(w * F.col("p_neutral")).alias("n"),
    )
    votes = lambda c: F.count_if((F.col("k") > 0) & c)
    lean = F.col("s") - F.col("r")
    agg = by_host.groupBy("claim_id").agg(
        *[F.sum(c).alias(c) for c in ("rows", "k", "w", "wl", "s", "r", "n")],
        votes(lean > 1e-9).alias("vs"), votes(lean < -1e-9).alias("vr"), votes(F.abs(lean) <= 1e-9).alias("vn"),
    )
    total = F.greatest(F.lit(1e-9), F.coalesce(F.col("s") + F.col("r") + F.col("n"), F.lit(0.0)))
    # rounded, as masses meet thresholds and the order of additions must not show
    part = lambda c: F.round(clamp01(F.coalesce(F.col(c), F.lit(0.0)) / total), 9)
    entropy = F.coalesce(clamp01((F.log("w") - F.col("wl") / F.col("w")) / F.log(F.greatest(F.col("k"), F.lit(2)))), F.lit(1.0))
    camps = F.col("vs") + F.col("vr") + F.col("vn")
    return agg.select(
        "claim_id", part("s").alias("support_mass"), part("r").alias("refute_mass"), part("n").alias("neutral_mass"), entropy.alias("entropy"),
        (F.greatest("vs", "vr", "vn") / F.greatest(camps, F.lit(1))).alias("agreement"), (F.col("k") / F.greatest(F.col("rows"), F.lit(1))).alias("admissible_rate"),
    )


def posteriors(mass: DataFrame) -> DataFrame:
    """mass with coverage and diversity, to the probabilities of TRUE, FALSE and UNVERIFIABLE."""
    s, r = F.col("support_mass"), F.col("refute_mass")
    d = mass.withColumns({"margin": clamp01(F.abs(s - r)), "directed": clamp01(s + r), "strength": clamp01(F.greatest(s, r))})
    calm = F.when(F.col("directed") >= 0.25, F.least(F.col("entropy"), F.lit(0.85))).otherwise(F.col("entropy"))
    enough = sigmoid(1.45 * clamp01(F.col("coverage")) + 1.10 * clamp01(F.col("diversity")) + 1.35 * F.col("directed") - 0.55 * calm - 1.05)
    d = d.withColumn("sufficiency", enough)
    pull = (F.col("sufficiency") + F.greatest(F.lit(0.35), F.col("agreement"))) / 2
    doubt = (1 - F.col("sufficiency")) * (1 - 0.55 * F.col("strength"))
    rest = F.col("neutral_mass") * F.greatest(F.lit(0.08), 1 - (0.65 * F.col("margin") + 0.20 * F.col("strength") + 0.30 * F.col("directed")))
    d = d.withColumns({"t0": s * pull, "f0": r * pull, "u0": F.greatest(F.lit(0.0), doubt + rest)})
    total = F.greatest(F.lit(1e-9), F.col("t0") + F.col("f0") + F.col("u0"))
    d = d.withColumns({"p_true": clamp01(F.col("t0") / total), "p_false": clamp01(F.col("f0") / total), "p_unverifiable": clamp01(F.col("u0") / total)})
    top = F.greatest("p_true", "p_false", "p_unverifiable")
    sure = top * (0.45 + 0.55 * F.col("sufficiency")) * (1 - 0.22 * F.col("entropy")) * (0.80 + 0.20 * F.greatest("margin", "strength"))
    return d.withColumn("confidence_raw", clamp01(sure)).drop("t0", "f0", "u0", "directed")


def calibrated_classes(p_true: Column, p_false: Column, p_unv: Column, coverage: Column, admissible: Column, support: Column, against: Column, temperature: dict[str, float] | None = None) -> tuple[Column, Column, Column]:
    """Class probabilities after the lifts that polarity and sparse evidence give, summing to 1.

    ``temperature``: an artifact's temperatures of true, false and unverifiable.
    """
    total = p_true + p_false + p_unv
    p_true, p_false, p_unv = (F.when(total <= 0, other).otherwise(F.greatest(F.lit(0.0), p / total)) for p, other in ((p_true, 0.0), (p_false, 0.0), (p_unv, 1.0)))
    if temperature:
        p_true, p_false, p_unv = (tempered(p, float(temperature.get(k) or 1.0)) for p, k in ((p_true, "true"), (p_false, "false"), (p_unv, "unverifiable")))
    high, gap = F.greatest(support, against), F.abs(support - against)
    times = lambda cond, x, other=1.0: F.when(cond, x).otherwise(other)
    sparse = (clamp01(coverage) < 0.35) | (clamp01(admissible) < 0.40)
    boost = F.when((high >= 0.55) & (gap >= 0.18), 1.02).when((high >= 0.45) & (gap >= 0.12), 1.05).otherwise(1.10)
    lead = F.least(F.lit(1.25), 1 + 0.15 * gap)
    clear = F.least(F.lit(1.35), 1.15 + 0.12 * F.greatest(F.lit(0.0), gap - 0.05))
    for_true, for_false = support > against + 0.05, against > support + 0.05
    settled = (for_true | for_false) & (high >= 0.45) & (gap >= 0.12)
    weak = high <= 0.30
    t = p_true * times((gap >= 0.10) & (support > against), lead) * times(for_true, clear) * times(weak, 0.95)
    f = p_false * times((gap >= 0.10) & (support <= against), lead) * times(for_false, clear) * times(weak, 0.95)
    u = p_unv * times(sparse, boost) * times((gap <= 0.08) & (high <= 0.40), 1.12) * times(settled, 0.85) * times(weak, 1.05)
    total = F.greatest(F.lit(1e-9), t + f + u)
    return clamp01(t / total), clamp01(f / total), clamp01(u / total)


def mapped_confidence(score: Column, artifact: dict) -> Column:
    """A raw confidence through an artifact's line, knots (the first at or above it) and reliability bins (the first that holds it)."""
    mode = str(artifact.get("mode") or "linear").lower()
    x = clamp01(score)
    if mode == "linear":
        x = float(artifact.get("slope") or 1.0) * x + float(artifact.get("intercept") or 0.0)
    elif mode == "piecewise" and artifact.get("knots"):
        knots = [(float(k.get("x") or 0.0), float(k.get("y") or k.get("x") or 0.0)) for k in artifact["knots"]]
        x = F.coalesce(*[F.when(x <= at, y) for at, y in knots], F.lit(knots[-1][1]))
    bins = [(float(b.get("min") or 0.0), float(1.0 if b.get("max") is None else b["max"] or 1.0), b.get("calibrated")) for b in artifact.get("reliability_bins") or []]
    if bins:
        x = F.coalesce(*[F.when(x.between(lo, hi), F.lit(float(y)) if y else x) for lo, hi, y in bins], x)
    return x


def calibrated_confidence(score: Column, coverage: Column, agreement: Column, diversity: Column, against: Column, admissible: Column, top: Column, quality: Column | None = None, depth: Column | None = None, artifact: dict | None = None) -> Column:
    """One confidence out of a raw one and what is known of the evidence.

    A share of admissible rows that is 0 counts as 1, a quality of 0 as 0.5, and
    a top probability of 0 as the score: zero stands for unknown here.
    """
    score = mapped_confidence(score, artifact) if artifact else clamp01(score)
    unknown = lambda x, default: F.when(F.coalesce(x, F.lit(0.0)) == 0, default).otherwise(clamp01(x))
    adm, top = unknown(admissible, 1.0), unknown(top, clamp01(score))
    quality = F.lit(0.5) if quality is None else unknown(quality, 0.5)
    made = 0.30 * clamp01(coverage) + 0.25 * clamp01(agreement) + 0.15 * clamp01(diversity) + 0.20 * adm + 0.10 * quality
    x = 0.62 * score + 0.18 * made + 0.20 * top - 0.35 * clamp01(against)
    x = F.when(top >= 0.55, F.greatest(x, 0.5 * top)).otherwise(x)
    if depth is not None:
        x = F.when((clamp01(F.coalesce(depth, F.lit(0.0))) >= 0.66) & (quality < 0.45), 0.92 * x).otherwise(x)
    x = F.when((clamp01(against) >= 0.60) & (clamp01(coverage) < 0.50), F.least(x, F.lit(0.62))).otherwise(x)
    return clamp01(F.when(adm < 0.40, 0.85 * x).otherwise(x))


def tempered(p: Column, temperature: float) -> Column:
    """A probability whose logit is divided by the temperature."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return sigmoid(F.log(q / (1 - q)) / max(1e-3, temperature))


def _first_of(t: Column, f: Column, u: Column) -> Column:
    """The class of the largest probability; ties go to TRUE, then FALSE."""
    return F.when((t >= f) & (t >= u), "TRUE").when(f >= u, "FALSE").otherwise("UNVERIFIABLE")


def verdicts(post: DataFrame, steepness: float = 2.5) -> DataFrame:
    """posteriors() rows to verdict, its confidence, truthfulness in per cent, and the two-way verdict."""
    s, r, adm = F.col("support_mass"), F.col("refute_mass"), F.col("admissible_rate")
    t, f, u = calibrated_classes(F.col("p_true"), F.col("p_false"), F.col("p_unverifiable"), F.col("coverage"), adm, s, r)
    d = post.withColumns({"ct": t, "cf": f, "cu": u})
    t, f, u = F.col("ct"), F.col("cf"), F.col("cu")
    top, side, gap = F.greatest(t, f, u), F.greatest(s, r), F.abs(t - f)
    weak = sum((c.cast("int") for c in (gap <= 0.10, side <= 0.28, F.col("sufficiency") <= 0.42, adm <= 0.30)), F.lit(0))
    usable = (F.col("sufficiency") >= 0.42) & (adm >= 0.35)
    lock = lambda p, other, mass: (p >= 0.40) & (p >= other + 0.05) & (p >= u + 0.03) & (mass >= 0.28) & usable
    verdict = (
        F.when(lock(t, f, s), "TRUE").when(lock(f, t, r), "FALSE")
        .when((u >= 0.55) & (u - F.greatest(t, f) >= 0.12) & (weak >= 3), "UNVERIFIABLE")
        .when(top >= 0.45, _first_of(t, f, u)).otherwise(_first_of(F.col("p_true"), F.col("p_false"), F.col("p_unverifiable")))
    )
    raw = F.when(F.col("confidence_raw") == 0, top).otherwise(F.col("confidence_raw"))
    sure = calibrated_confidence(clamp01(0.65 * raw + 0.35 * top), F.col("coverage"), F.col("agreement"), F.col("diversity"), r, adm, top)
    d = d.withColumns({"verdict": verdict, "sure": sure})
    low = (F.col("sufficiency") < 0.58) | (F.col("margin") < 0.24) | (adm < 0.50)
    cap = F.when(F.col("verdict") != "UNVERIFIABLE", 1.0).when(low, 0.58).when((side >= 0.60) & (gap >= 0.20), 0.62).otherwise(1.0)
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    truth = (
        F.when(F.col("verdict") == "TRUE", clip(60 + 40 * F.col("p_true"), 55.0, 98.0))
        .when(F.col("verdict") == "FALSE", clip(45 * (1 - F.col("p_false")), 2.0, 45.0))
        .otherwise(clip(45 + 10 * (F.col("p_true") - F.col("p_false")), 30.0, 60.0))
    )
    two = F.round(1 / (1 + F.exp(-steepness * (s - r))), 9)
    d = d.withColumns({"confidence": F.least(F.col("sure"), cap), "truthfulness": truth, "truth_score_binary": two})
    return d.withColumn("verdict_binary", F.when(F.col("truth_score_binary") >= 0.5, "TRUE").otherwise("FALSE")).drop("sure", "ct", "cf", "cu")


def sufficiency_rule(coverage: Column, diversity: Column, agreement: Column, count: Column, relevance: Column, strong: Column, contradicted: Column, confidence_mode: bool = False) -> Column:
    """The first rule that decides whether the evidence is enough; its name starts with fail where it is not."""
    least = 1 if confidence_mode else 3
    high, mid = (0.35, 0.20) if confidence_mode else (0.60, 0.40)
    alone, rel = contradicted == 0, F.coalesce(relevance, F.lit(0.0))
    rule = F.when((count < least) & (coverage < 0.20) & ~((diversity >= 0.85) & (rel >= 0.75)), "fail_count")
    if confidence_mode:
        rule = rule.when((count >= least) & (coverage >= 0.5) & (diversity >= 0.3) & (agreement >= 0.8), "confidence_mode")
    return (
        rule.when(alone & (coverage >= 0.25) & (diversity >= 0.95) & (agreement >= 0.95), "consensus")
        .when(alone & (strong > 0) & (((coverage >= 0.25) & (diversity >= 0.75)) | (rel >= 0.55)), "adaptive_override")
        .when((coverage >= high) & (agreement >= 0.8), "high_coverage")
        .when((coverage >= mid) & (diversity >= 0.7) & (agreement >= 0.8), "medium_coverage")
        .otherwise("fail")
    )


def sufficient(*figures: Column, confidence_mode: bool = False) -> Column:
    """Whether the evidence is enough for a verdict."""
    return ~sufficiency_rule(*figures, confidence_mode=confidence_mode).startswith("fail")


def reconciled(segments: DataFrame) -> DataFrame:
    """(claim_id, status) of segments to one verdict per claim, weighted truth and its cap; null is UNKNOWN."""
    st = F.upper(F.coalesce(F.col("status"), F.lit("UNKNOWN")))
    weight = F.lit(0.0)
    for name, x in STATUS_TRUTH.items():
        weight = F.when(st == name, x).otherwise(weight)
    agg = segments.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(st == "UNKNOWN").alias("unresolved"), F.count_if(st == "VALID").alias("valid"),
        F.count_if(st.isin("VALID", "PARTIALLY_VALID", "STRONGLY_VALID")).alias("support"), F.count_if(st.isin("INVALID", "PARTIALLY_INVALID")).alias("invalid"),
        F.count_if(st.isin("PARTIALLY_VALID", "PARTIALLY_INVALID")).alias("partial"), F.avg(weight).alias("truth"),
    )
    c = F.col
    signal = (c("support") > 0) | (c("invalid") > 0)
    verdict = (
        F.when(c("unresolved") > 0, F.when(signal, "PARTIALLY_TRUE").otherwise("UNVERIFIABLE"))
        .when(c("valid") == c("segments"), "TRUE")
        .when((c("invalid") > 0) & (c("support") == 0), "FALSE")
        .when((c("support") > 0) | (c("partial") > 0), "PARTIALLY_TRUE")
        .otherwise("UNVERIFIABLE")
    )
    cap = F.least(F.lit(100.0), 100 * c("truth") + 5)
    cap = F.when(c("unresolved") > 0, F.least(cap, F.lit(65.0))).otherwise(cap)
    cap = F.when(c("unresolved") == c("segments"), F.least(cap, F.lit(20.0))).otherwise(cap)
    return agg.select("claim_id", verdict.alias("verdict"), "segments", "unresolved", c("truth").alias("weighted_truth"), cap.alias("truthfulness_cap"))


def heuristic_nli(overlap: Column, negation_differs: Column) -> tuple[Column, Column, Column]:
    """Entailment, contradiction and neutrality from shared words and polarity, summing to 1."""
    m = negation_differs.cast("double")
    against, entail = sigmoid(1.4 * overlap + 1.8 * m - 1.3), sigmoid(1.6 * overlap + 1.2 * (1 - m) - 1.4)
    neutral = F.greatest(F.lit(0.0), 1 - F.greatest(against, entail))
    total = against + entail + neutral
    return entail / total, against / total, neutral / total


def information_gain(coverage: Column, diversity: Column, agreement: Column, trust: Column, contradicted: Column, zero_rounds: Column, low_rounds: Column) -> Column:
    """What another round of search may bring, less after rounds that brought nothing."""
    x = 0.34 * (1 - clamp01(coverage)) + 0.22 * (1 - clamp01(diversity)) + 0.16 * (1 - clamp01(agreement)) + 0.20 * 2 * F.abs(trust - 0.5) + 0.08 * contradicted.cast("double")
    x = F.when(zero_rounds >= 2, 0.70 * x).otherwise(x)
    return clamp01(F.when(low_rounds >= 2, 0.80 * x).otherwise(x))
