"""Queries on rewritten claims: pair scores, the guard, canonical parts and the queries of both tracks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canonical, pairs, words
from plumbline.functions.segments import segmented
from plumbline.plans import worded
from plumbline.plans.naming import AUTHORITIES, BY_RULE, CLEAR, GROUP, SAID, WORTH
from plumbline.plans.registry import query
from plumbline.plans.worded import s_ascii, s_low, s_set, s_shared, sql_pick, sql_text
from plumbline.session import read_table

c = F.col
#: Rewritings of SAID and of others: the same, with other signs, near ones, denied ones, and none.
REWRITTEN = (
    *SAID, "zinc supplements reduce the duration of the common cold!", "Zinc supplements do not reduce the duration of the common cold", "Antibiotics work against viral infections", "smoking causes lung cancer and heart disease",
    "", None, "Exercise daily may improve mood", "Sugar increases the risk of diabetes in adults", "WHO guidelines recommend handwashing", "CDC recommends two doses over 6 months", "sleep", "-- --",
)


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


def s_pairs(name: str, source: str, a: str, b: str, out: str) -> str:
    """CTEs that add to ``source`` the list ``out`` of entail, contradict and neutral of ``a`` by ``b``; the last is called ``name``."""
    tokens = lambda x: s_set(s_ascii(f"lower(coalesce({x}, ''))"), words.ALPHA, pairs.STOP)
    denies = lambda x: f"regexp_matches({s_ascii(f'lower(coalesce({x}, {chr(39)}{chr(39)}))')}, {sql_text(words.NEGATED_NLI)})"
    return f"""
{name}a AS (SELECT *, {tokens(a)} AS own_, {tokens(b)} AS oth_, ({denies(a)} <> {denies(b)})::INT AS m_ FROM {source}),
{name}b AS (SELECT *, {s_shared('own_', 'oth_')} / greatest(1, len(own_)) AS o_ FROM {name}a),
{name}c AS (SELECT *, {_sigmoid('1.4 * o_ + 1.8 * m_ - 1.3')} AS hc_, {_sigmoid('1.6 * o_ + 1.2 * (1 - m_) - 1.4')} AS he_ FROM {name}b),
{name}d AS (SELECT *, greatest(0, 1 - greatest(hc_, he_)) AS hn_ FROM {name}c),
{name} AS (SELECT * EXCLUDE (own_, oth_, m_, o_, hc_, he_, hn_), CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN [0, 0, 1] WHEN len(own_) = 0 OR len(oth_) = 0 THEN [0.25, 0.25, 0.5]
    ELSE [he_ / (he_ + hc_ + hn_), hc_ / (he_ + hc_ + hn_), hn_ / (he_ + hc_ + hn_)] END::DOUBLE[] AS {out} FROM {name}d)"""


def s_guard(source: str, confidence: str) -> str:
    """CTEs from ``source`` (o, r and others) to gd: the same with the guard's verdict."""
    tokens = lambda x: s_set(s_ascii(f"lower({x})"), words.ALPHA)
    bare = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'))"
    fits = " OR ".join(f"(shared >= {x} AND least(there, back) >= {e} AND against <= {a})" for x, e, a in canonical.KEPT_IF)
    return f"""
{s_pairs('g1', source, 'o', 'r', 's1')}, {s_pairs('g2', 'g1', 'r', 'o', 's2')},
g3 AS (SELECT *, round(s1[1], 9) AS there, round(s2[1], 9) AS back, round(greatest(s1[2], s2[2]), 9) AS against, {tokens('o')} AS ot, {tokens('r')} AS rt FROM g2),
g4 AS (SELECT *, CASE WHEN len(ot) + len(rt) > 0 THEN round({s_shared('ot', 'rt')} / (len(ot) + len(rt) - {s_shared('ot', 'rt')}), 9) ELSE 0 END AS shared FROM g3),
g5 AS (SELECT *, ({bare('o')} <> '' AND {bare('o')} = {bare('r')}) OR {fits} AS fits FROM g4),
gd AS (SELECT * EXCLUDE (s1, s2, ot, rt, shared, there, back, against, fits), o <> '' AND r <> '' AND fits AS canonical_accepted,
    CASE WHEN o = '' THEN 'empty_original_segment' WHEN r = '' THEN 'empty_canonical_segment' WHEN fits THEN '' ELSE printf('drift_guard_failed:min_entail=%.3f,contradiction=%.3f', least(there, back), against) END AS canonical_rejected_reason,
    CASE WHEN o = '' OR r = '' THEN 0 ELSE there END AS entail_original_to_canonical, CASE WHEN o = '' OR r = '' THEN 0 ELSE back END AS entail_canonical_to_original, CASE WHEN o = '' OR r = '' THEN 0 ELSE against END AS contradiction_score,
    CASE WHEN o = '' OR (r <> '' AND fits) THEN r ELSE o END AS text, CASE WHEN o <> '' AND r <> '' AND NOT fits THEN greatest(0.05, least(0.99, {confidence} * 0.8)) ELSE {confidence} END::DOUBLE AS worth FROM g5)"""


PAIRED = f"""
p0 AS (SELECT o_orderkey AS id, {sql_pick(SAID, 'o_orderkey')} AS a, {sql_pick(REWRITTEN, 'o_custkey')} AS b FROM orders
    UNION ALL SELECT -item_id, text, regexp_replace(text, '(?i) (the|de|der|la) ', ' ', 'g') FROM benchmark UNION ALL SELECT -1000000 - item_id, text, left(text, 60) FROM benchmark UNION ALL SELECT -2000000 - 1000 * conv_id - turn, text, replace(text, '.', ' not.') FROM conversations)
"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """(id, a, b): claims in words with rewritings, and passages and turns of conversations with what is left of them."""
    orders, passages, turns = (read_table(spark, d, t) for t in ("orders", "benchmark", "conversations"))
    out = orders.select(c("o_orderkey").alias("id"), worded.pick(SAID, c("o_orderkey")).alias("a"), worded.pick(REWRITTEN, c("o_custkey")).alias("b"))
    out = out.union(passages.select(-c("item_id"), "text", F.regexp_replace("text", "(?i) (the|de|der|la) ", " "))).union(passages.select(-1000000 - c("item_id"), "text", F.left("text", F.lit(60))))
    return out.union(turns.select(-2000000 - 1000 * c("conv_id") - c("turn"), "text", F.replace("text", F.lit("."), F.lit(" not."))))


@query(f"WITH {PAIRED}, {s_pairs('p1', 'p0', 'a', 'b', 's')} SELECT id, round(s[1], 6) AS entail, round(s[2], 6) AS contradict, round(s[3], 6) AS neutral FROM p1")
def u50_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _paired(spark, d).select("id", pairs.rule_scores(c("a"), c("b")).alias("s"))
    return rows.select("id", *[F.round(c("s")[n], 6).alias(n) for n in ("entail", "contradict", "neutral")])


# a stand-in for a model: outputs from the lengths of both texts, none for some pairs

def stand_in() -> pairs.Model:
    def outputs(asked: list[tuple[str, str]]) -> list[list[float]]:
        found = []
        for a, b in asked:
            x, y = len(a) % 7 - 3.0, len(b) % 5 - 2.0
            found.append([[], [x], [x, y], [y, x / 2, y - x]][(len(a) + len(b)) % 4])
        return found

    return outputs


NAMED = ("entailment", "neutral", "contradiction")
SOFT = "list_transform(raw, lambda v: exp(greatest(-50, least(50, v)) - list_max(raw)))"


@query(f"""
WITH {PAIRED}, {s_pairs('p1', 'p0', 'a', 'b', 's')}, q0 AS (SELECT *, (length(a) % 7 - 3)::DOUBLE AS x, (length(b) % 5 - 2)::DOUBLE AS y, coalesce(a, '') <> '' AND coalesce(b, '') <> '' AS asked FROM p1),
q1 AS (SELECT *, CASE WHEN asked THEN [[], [x], [x, y], [y, x / 2, y - x]][(length(a) + length(b)) % 4 + 1] ELSE [] END::DOUBLE[] AS raw FROM q0), q2 AS (SELECT *, {SOFT} AS e FROM q1), q3 AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM q2),
q4 AS (SELECT *, CASE len(raw) WHEN 1 THEN [1 / (1 + exp(-raw[1])), 1 - 1 / (1 + exp(-raw[1])), 0] WHEN 2 THEN [p[2], p[1], greatest(0, 1 - greatest(p[1], p[2]))] WHEN 3 THEN [p[1], p[3], p[2]] END::DOUBLE[] AS t FROM q3),
q5 AS (SELECT *, list_transform(t, lambda v: v / list_sum(t)) AS m FROM q4), q6 AS (SELECT *, CASE WHEN m IS NULL THEN s ELSE list_transform([1, 2, 3], lambda i: 0.7 * m[i] + 0.3 * s[i]) END AS k FROM q5)
SELECT id, round(k[1] / list_sum(k), 6) AS entail, round(k[2] / list_sum(k), 6) AS contradict, round(k[3] / list_sum(k), 6) AS neutral, m IS NOT NULL AS by_model FROM q6
""")
def u51_u53_blended_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.with_model_outputs(_paired(spark, d), stand_in, "a", "b")
    rows = rows.select("id", pairs.rule_scores(c("a"), c("b")).alias("s"), pairs.decoded(c("raw"), NAMED).alias("m"))
    return rows.select("id", pairs.blended(c("m"), c("s")).alias("k"), c("m").isNotNull().alias("by_model")).select("id", *[F.round(c("k")[n], 6).alias(n) for n in ("entail", "contradict", "neutral")], "by_model")


@query(f"""
WITH {PAIRED}, c0 AS (SELECT id, {CLEAR('a')} AS o, {CLEAR('b')} AS r FROM p0), {s_guard('c0', '0.5')}
SELECT id, canonical_accepted, canonical_rejected_reason, round(entail_original_to_canonical, 6)::DOUBLE AS there, round(entail_canonical_to_original, 6)::DOUBLE AS back, round(contradiction_score, 6)::DOUBLE AS against, text, round(worth, 9) AS worth FROM gd
""")
def u43_guarded_rewritings(spark: SparkSession, d: str) -> DataFrame:
    rows = _paired(spark, d).select("id", canonical.guarded(c("a"), c("b"), F.lit(0.5)).alias("g")).select("id", "g.*")
    figures = {"there": "entail_original_to_canonical", "back": "entail_canonical_to_original", "against": "contradiction_score"}
    return rows.select("id", "canonical_accepted", "canonical_rejected_reason", *[F.round(v, 6).alias(k) for k, v in figures.items()], "text", F.round("worth", 9).alias("worth"))


# parts: an order of a customer is a part of the customer's claim

SPLIT = sql_text(canonical.SPLIT)
PARTS_SQL = f"""
c0 AS (SELECT o_custkey AS claim_id, o_orderkey AS part, {CLEAR(sql_pick(SAID, 'o_orderkey'))} AS t FROM orders UNION ALL SELECT -item_id, 1, {CLEAR('text')} FROM benchmark), c1 AS (SELECT *, {AUTHORITIES} FROM c0),
c1m AS (SELECT *, {s_ascii('t')} AS mask FROM c1), c1n AS (SELECT *, regexp_matches(mask, {SPLIT}) AS cuts, length({GROUP('mask', canonical.SPLIT, 1)}) AS n1, length({GROUP('mask', canonical.SPLIT, 2)}) AS n2 FROM c1m),
c1o AS (SELECT *, CASE WHEN cuts THEN left(t, n1) ELSE '' END AS p1, CASE WHEN cuts THEN substr(t, n1 + 1, n2) ELSE '' END AS p2, CASE WHEN cuts THEN substr(t, n1 + n2 + 1) ELSE '' END AS p3 FROM c1n),
c2 AS (SELECT claim_id, part, t, {BY_RULE(lambda i: f'a{i}', CLEAR('p1'))} AS s0, {BY_RULE(lambda i: f"'{canonical.RECOMMENDED[i][3]}'", CLEAR('p2'))} AS predicate, {BY_RULE(lambda i: f'o{i}', CLEAR('p3'))} AS object, {BY_RULE(lambda i: "'recommendation'", "''")} AS predicate_family FROM c1o),
c3 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(s0, '(?i)\\b(?:never|not|no|none|without)\\b\\s*$', '')), '(?i)\\b(?:has|have|had|is|are|was|were)\\b\\s*$', '')) AS s1 FROM c2),
c4 AS (SELECT claim_id, part, t AS o, CASE WHEN s1 <> '' THEN s1 ELSE {CLEAR("array_to_string(regexp_extract_all(" + s_ascii('t') + ", '\\b[a-zA-Z][a-zA-Z\\-]{2,}\\b')[1:4], ' ')")} END AS subject, predicate, object, predicate_family, {CLEAR(GROUP('t', canonical.COMPARATOR, 1))} AS comparator, {GROUP('t', canonical.NUMERIC, 1)} AS numeric_value, {CLEAR(GROUP('t', canonical.MODALITY, 1))} AS modality FROM c3),
c5 AS (SELECT *, {CLEAR("concat_ws(' ', nullif(subject, ''), nullif(predicate, ''), nullif(object, ''))")} AS joined FROM c4),
c6 AS (SELECT * EXCLUDE (joined), CASE WHEN joined <> '' THEN joined ELSE o END AS r, greatest(0.05, least(0.99, 0.30::DOUBLE + {WORTH}))::DOUBLE AS conf FROM c5), {s_guard('c6', 'conf')},
seg AS (SELECT claim_id, part, o, text AS n, subject, predicate, object, predicate_family, canonical_accepted AND predicate <> '' AND object <> '' AS accepted,
    CASE WHEN canonical_accepted AND (predicate = '' OR object = '') THEN 'canonical_parse_incomplete' ELSE canonical_rejected_reason END AS reason, CASE WHEN canonical_accepted AND (predicate = '' OR object = '') THEN greatest(0.05, least(0.99, worth * 0.8)) ELSE worth END AS worth FROM gd)
"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(c("o_custkey").alias("claim_id"), c("o_orderkey").alias("part"), worded.pick(SAID, c("o_orderkey")).alias("segment"))
    return canonical.canonicalized(orders.union(read_table(spark, d, "benchmark").select(-c("item_id"), F.lit(1).cast("long"), "text")))


@query(f"WITH {PARTS_SQL} SELECT claim_id, part, accepted, reason, n AS normalized_text, round(worth, 9) AS parse_confidence FROM seg")
def u44_canonical_parts(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("claim_id", "part", c("canonical_accepted").alias("accepted"), c("canonical_rejected_reason").alias("reason"), "normalized_text", F.round("parse_confidence", 9).alias("parse_confidence"))


QUERIES_SQL = f"""
{PARTS_SQL}, t0 AS (SELECT *, {CLEAR("subject || ' ' || predicate || ' ' || object")} AS t, CASE WHEN predicate IN ('is', 'are', 'was', 'were') AND subject <> '' AND object <> '' THEN subject || ' is not ' || object ELSE subject || ' does not ' || predicate || ' ' || object END AS denied,
    predicate_family = 'recommendation' AND subject <> '' AND object <> '' AS advice, CASE WHEN n <> '' THEN n ELSE o END AS a FROM seg),
t1 AS (SELECT *, CASE WHEN advice THEN [subject || ' recommends ' || object, subject || ' recommendation ' || object, subject || ' guidance ' || object] WHEN o <> '' THEN [o, o || ' evidence', o || ' systematic review'] ELSE [] END AS l0,
    CASE WHEN advice THEN [subject || ' advises against ' || object, subject || ' does not recommend ' || object] WHEN o = '' THEN [] WHEN t <> '' THEN ['no evidence ' || t, denied] ELSE ['no evidence ' || o, o || ' ineffective'] END AS l1,
    CASE WHEN advice THEN [subject || ' official recommendation ' || object, subject || ' healthy guidance ' || object] WHEN accepted AND n <> '' THEN [n, n || ' clinical evidence'] ELSE [] END AS l2,
    CASE WHEN advice THEN ['evidence against ' || subject || ' recommending ' || object] WHEN NOT (accepted AND n <> '') THEN [] WHEN t <> '' THEN ['evidence against ' || t] ELSE ['evidence against ' || n] END AS l3, CASE WHEN a <> '' THEN [a || ' site:who.int OR site:cdc.gov'] ELSE [] END AS l4 FROM t0),
t2 AS (SELECT claim_id, part, (list_transform(l0, lambda q: {{'k': 0, 'q': q}}) || list_transform(l1, lambda q: {{'k': 1, 'q': q}}) || list_transform(l2, lambda q: {{'k': 2, 'q': q}}) || list_transform(l3, lambda q: {{'k': 3, 'q': q}}) || list_transform(l4, lambda q: {{'k': 4, 'q': q}}))[1:8] AS qs FROM t1),
t3 AS (SELECT claim_id, part, list_filter(list_transform(qs, lambda x: {{'k': x.k, 'q': {CLEAR('x.q')}}}), lambda x: x.q <> '') AS qs FROM t2), t4 AS (SELECT claim_id, part, unnest(qs) AS x, unnest(range(1, len(qs) + 1)) AS place FROM t3),
t5 AS (SELECT claim_id, part, place::INTEGER AS place, x.q AS query, min(x.k) OVER (PARTITION BY claim_id, part, x.q) AS k FROM t4),
t6 AS (SELECT claim_id, part, place, query, CASE WHEN k < 2 THEN 'original' ELSE 'canonical' END AS track, ['support', 'refute', 'support', 'refute', 'authoritative'][k + 1] AS facet FROM t5)
"""


@query(f"WITH {QUERIES_SQL} SELECT * FROM t6")
def u45_part_queries(spark: SparkSession, d: str) -> DataFrame:
    return canonical.part_queries(_parts(spark, d))


@query(f"""
WITH {QUERIES_SQL}, f AS (SELECT claim_id, track, query, min((part, place)) AS pl FROM t6 GROUP BY ALL), g AS (SELECT claim_id, coalesce(string_agg(query, '|' ORDER BY pl) FILTER (track = 'original'), '') AS original, coalesce(string_agg(query, '|' ORDER BY pl) FILTER (track = 'canonical'), '') AS canonical FROM f GROUP BY 1),
m0 AS (SELECT claim_id, query, min((track = 'canonical', pl)) AS pl FROM f GROUP BY ALL), m AS (SELECT claim_id, string_agg(query, '|' ORDER BY pl) AS merged FROM m0 GROUP BY 1),
s AS (SELECT claim_id, coalesce(string_agg(o, '|' ORDER BY part) FILTER (o <> ''), '') AS originals, coalesce(string_agg(n, '|' ORDER BY part) FILTER (accepted AND n <> ''), '') AS canonicals FROM seg GROUP BY 1)
SELECT claim_id, originals, canonicals, coalesce(original, '') AS original, coalesce(canonical, '') AS canonical, coalesce(merged, '') AS merged FROM s LEFT JOIN g USING (claim_id) LEFT JOIN m USING (claim_id)
""")
def u45_u46_dual_tracks(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    listed = lambda x: F.coalesce(F.array_join(x, "|"), F.lit("")).alias(x)
    held = canonical.tracks(parts).select("claim_id", F.array_join("original", "|").alias("originals"), F.array_join("canonical", "|").alias("canonicals"))
    return held.join(canonical.claim_queries(canonical.part_queries(parts)), "claim_id", "left").select("claim_id", "originals", "canonicals", listed("original"), listed("canonical"), listed("merged"))


@query()
def u34_u42_u43_u44_canonical_claims(spark: SparkSession, d: str) -> DataFrame:
    passages, turns = read_table(spark, d, "benchmark"), read_table(spark, d, "conversations")
    texts = passages.select((-c("item_id")).alias("claim_id"), c("text").alias("claim")).union(turns.select(1000 * c("conv_id") + c("turn"), "text"))
    return canonical.canonicalized(segmented(texts))
