"""Queries on what search gives: enriched facts, aligned vector matches, graph candidates, metadata predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import facts, words
from plumbline.functions.policy import GENERIC
from plumbline.operators import alignment, retrieval
from plumbline.plans import worded
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import CLAIMS_SQL, EVIDENCE_SQL, s_any, s_low, s_set, s_shared, sql_pick, sql_text
from plumbline.session import by_value, read_table, written

DOMAIN_SQL = r"(CASE WHEN regexp_matches(coalesce(source_url, ''), '(?i)^https?://[^\s/$.?#].[^\s]*$') THEN regexp_replace(lower(regexp_extract(source_url, '://([^/?#]*)', 1)), '^www[.]', '') ELSE '' END)"


def _points(name: str) -> str:
    own = f"{s_shared('own', sql_text(facts.TOPICS[name]))}"
    hints = [f"CASE WHEN ends_with(dom, {sql_text(of)}) THEN 2 ELSE 0 END" for of, named in facts.DOMAIN_TOPICS.items() if name in named]
    return " + ".join([own, *hints])


POINTS = "[" + ", ".join(f"{{'p': -({_points(name)}), 't': {sql_text(name)}}}" for name in facts.TOPICS) + "]"


@query(f"""
WITH {EVIDENCE_SQL}, e0 AS (SELECT claim_id, seq, statement, source_url, {DOMAIN_SQL} AS dom, {s_set("lower(coalesce(statement, '') || ' | ' || array_to_string(coalesce(entities, []), ' | '))", words.ALPHA)} AS own FROM ev),
e1 AS (SELECT *, list_sort({POINTS}) AS pts FROM e0), e2 AS (SELECT *, -pts[1].p AS best, list_transform(list_filter(pts, lambda x: -x.p >= greatest(1, -pts[1].p - 1)), lambda x: x.t)[:2] AS tops FROM e1),
e3 AS (SELECT *, regexp_matches({s_low('statement')}, {sql_text(facts.RANGE)}) AS ranged, regexp_extract({s_low('statement')}, {sql_text(facts.NUMBER)}) AS num, {s_any('statement', facts.COUNTED)} AS counted FROM e2)
SELECT claim_id, seq, dom AS domain, CASE WHEN dom = '' THEN 'unknown' {' '.join(f"WHEN ends_with(dom, {sql_text(of)}) THEN {sql_text(n)}" for of, n in facts.SOURCES)} ELSE dom END AS source,
    CASE {' '.join(f"WHEN {s_any('source_url', marks)} THEN {sql_text(n)}" for n, marks in facts.DOC_TYPES)} ELSE 'web' END AS doc_type, CASE WHEN best > 0 THEN tops[1] ELSE 'other' END AS topic, CASE WHEN best > 0 THEN array_to_string(tops, ' ') ELSE '' END AS topics,
    round(CASE WHEN best > 0 THEN least(1, best / 5) ELSE 0 END, 6)::DOUBLE AS topic_confidence, CASE WHEN ranged THEN 'range' WHEN num <> '' AND counted THEN 'count' WHEN {s_any('statement', (' is ', ' are ', ' was ', ' were '))} THEN 'definition' WHEN {s_any('statement', facts.MECHANISM)} THEN 'mechanism' ELSE 'other' END AS fact_type,
    CASE WHEN NOT ranged AND num <> '' AND counted THEN replace(num, ',', '')::DOUBLE END AS count_value FROM e3
""")
def u61_u62_u63_u64_u65_j15_enriched_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select("claim_id", "seq", "statement", "source_url", "entities")

    def described(texts: DataFrame) -> DataFrame:
        more = written(facts.enriched(texts))
        return more.withColumn("topics", F.array_join(facts.topics(F.col("statement"), F.col("entities"), F.col("domain"))["topics"], " "))

    listed = by_value(rows, ["statement", "source_url", "entities"], described)
    return listed.select("claim_id", "seq", "domain", "source", "doc_type", "topic", "topics", _r(F.col("topic_confidence")).alias("topic_confidence"), "fact_type", "count_value")


# claims with anchors

#: Anchors of each of worded.CLAIMS.
ANCHORS = tuple(None if e is None else (*e, *("health", "vitamin")[: i % 3], *(("cold",) if i % 2 else ())) for i, e in enumerate(worded.ENTITIES))
CLEAN = "list_filter(list_transform(coalesce(anchors, []), lambda a: lower(trim(coalesce(a, '')))), lambda a: a <> '')"
TOKS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), {sql_text(words.ALPHA)}), lambda w: NOT list_contains({sql_text(words.STOP)}, w)))"
CONTEXT = f"""
k0 AS (SELECT o_orderkey AS claim_id, {sql_pick(worded.CLAIMS, 'o_orderkey')} AS claim, {sql_pick(ANCHORS, 'o_orderkey')} AS anchors FROM orders), k1 AS (SELECT *, {CLEAN} AS a0 FROM k0), k2 AS (SELECT *, list_filter(a0, lambda a, i: list_position(a0, a) = i) AS a1 FROM k1),
k3 AS (SELECT *, list_transform(a1, lambda a: {{'a': a, 't': {TOKS('a')}}}) AS aw FROM k2),
k4 AS (SELECT *, list_transform(list_filter(aw, lambda x: len(x.t) > 0 AND NOT (len(x.t) = 1 AND (len(list_filter(aw, lambda y: len(y.t) > 1 AND list_contains(y.t, x.t[1]))) > 0 OR (list_contains({sql_text(GENERIC)}, x.t[1]) AND len(aw) > 1)))), lambda x: x.a) AS a2 FROM k3),
kc AS (SELECT claim_id, claim, CASE WHEN len(a2) > 0 THEN a2 ELSE a1 END AS usable, {TOKS("coalesce(claim, '')")} AS ct, CASE WHEN trim(coalesce(claim, '')) = '' THEN '' ELSE left(sha1(regexp_replace(lower(trim(claim)), '\\s+', ' ', 'g')), 16) END AS chash FROM k4),
kx AS (SELECT *, {TOKS("array_to_string(usable, ' | ')")} AS atok, list_filter(ct, lambda t: NOT list_contains({sql_text(alignment.GENERIC_CLAIM)}, t)) AS spec, list_transform(usable, lambda a: {TOKS('a')}) AS asets FROM kc)
"""
STRONG = lambda tok: f"(len(list_filter(asets, lambda t: len(t) > 0 AND NOT (len(t) = 1 AND list_contains({sql_text(GENERIC)}, t[1])) AND len(list_intersect({tok}, t)) >= greatest(1, len(t) - 1))) > 0)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return worded.claims(spark, d).withColumn("anchors", worded.pick(ANCHORS, F.col("claim_id")))


@query(f"WITH {CONTEXT} SELECT claim_id, array_to_string(usable, '|') AS usable, chash AS claim_hash, array_to_string(list_sort(atok), ' ') AS anchor_tokens, array_to_string(list_sort(spec), ' ') AS specific FROM kx")
def f11_claim_context(spark: SparkSession, d: str) -> DataFrame:
    rows = alignment.claim_context(_claims(spark, d))
    return rows.select("claim_id", F.array_join("usable", "|").alias("usable"), "claim_hash", F.array_join(F.array_sort("anchor_tokens"), " ").alias("anchor_tokens"), F.array_join(F.array_sort("specific"), " ").alias("specific"))


MATCHED = f"""
a0 AS (SELECT claim_id, seq, score * 0.6 AS raw, statement, stance, CASE WHEN quantity > 30 THEN chash ELSE 'x' END AS ctx, kx.* EXCLUDE (claim_id), {TOKS("coalesce(statement, '') || ' | ' || array_to_string(coalesce(entities, []), ' | ')")} AS tok FROM ev JOIN kx USING (claim_id)),
a1 AS (SELECT *, {s_shared('tok', 'atok')} AS ao, {s_shared('tok', 'ct')} AS co, {s_shared('tok', 'spec')} AS so, chash <> '' AND ctx = chash AS same FROM a0),
a2 AS (SELECT *, CASE WHEN same THEN CASE WHEN stance = 'entails' THEN 0.20 ELSE 0.12 END ELSE 0 END + least(0.10, 0.02 * ao) + least(0.06, 0.01 * co) AS boost, same OR {STRONG('tok')} OR so > 0 OR ao >= 2 OR (len(spec) = 0 AND co >= 2) AS fits FROM a1),
a3 AS (SELECT *, round(least(1, raw + boost), 9) AS al FROM a2 WHERE NOT ((len(atok) > 0 OR len(ct) > 0 OR chash <> '') AND NOT fits AND raw < 0.45)),
a4 AS (SELECT *, al >= 0.28 AND coalesce(statement, '') <> '' AND NOT {s_any('statement', alignment.FURNITURE)} AS strict, al < 0.28 AND al >= 0.20 AS low FROM a3),
a5 AS (SELECT *, count(*) FILTER (strict) OVER (PARTITION BY claim_id) AS kept, row_number() OVER (PARTITION BY claim_id ORDER BY low DESC, al DESC, statement, seq) AS turn FROM a4)
"""


@query(f"WITH {EVIDENCE_SQL}, {CONTEXT}, {MATCHED} SELECT claim_id, seq, round(al, 6) AS aligned, strict, row_number() OVER (PARTITION BY claim_id ORDER BY al DESC, statement, seq) AS rank FROM a5 WHERE strict OR (low AND turn <= 5 - kept AND coalesce(statement, '') <> '' AND NOT {s_any('statement', ('javascript and cookies', 'human verification'))})")
def f7_f10_f12_aligned_matches(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    own = alignment.context_hash(c("claim"))
    rows = worded.evidence(spark, d).join(worded.claims(spark, d).select("claim_id", "claim"), "claim_id")
    matches = rows.select("claim_id", c("seq").alias("match_id"), (c("score") * 0.6).alias("score"), "statement", "entities", F.lit(None).cast("array<string>").alias("context_entities"), F.when(c("quantity") > 30, own).otherwise("x").alias("context_hash"), F.when(c("stance") == "entails", " supports").alias("stance"))
    out = alignment.aligned_matches(matches, _claims(spark, d))
    return out.select("claim_id", c("match_id").alias("seq"), _r(c("aligned")).alias("aligned"), "strict", "rank")


@query(f"WITH {EVIDENCE_SQL}, {CONTEXT}, t AS (SELECT claim_id, seq, kx.* EXCLUDE (claim_id), {TOKS("coalesce(statement, '') || ' | ' || array_to_string(coalesce(entities, []), ' | ')")} AS tok FROM ev JOIN kx USING (claim_id)) SELECT claim_id, seq FROM t WHERE len(tok) > 0 AND ({STRONG('tok')} OR CASE WHEN len(spec) > 0 THEN list_has_any(tok, spec) ELSE list_has_any(tok, ct) END)")
def f5_f6_f8_f9_anchor_prefilter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.evidence(spark, d).join(alignment.claim_context(_claims(spark, d)), "claim_id")
    tokens = words.token_set(F.concat_ws(" \n ", "statement", F.array_join(F.coalesce("entities", F.array().cast("array<string>")), " \n ")), words.ALPHA, words.STOP)
    return rows.filter(alignment.meets_claim(tokens, c("usable"), c("claim_tokens"))).select("claim_id", "seq")


# the graph

#: Relations of the graph in words.
TRIPLES = (
    ("Zinc supplements", "reduce", "common cold"), ("common cold", "caused_by", "viral infection"), ("Antibiotics", "does_not_treat", "viral infection"), ("smoking", "causes", "lung cancer"), ("lung cancer", "leads to", "heart disease"), ("Vitamin D", "prevents", "fracture"),
    ("fracture", "linked_to", "old age"), ("vaccine", "protects", "infection"), ("coffee", "increases", "alertness"), ("sugar", "increases", "diabetes"), ("diabetes", "associated with", "blood pressure"), ("garlic", "lowers", "cholesterol"), ("iron", "treats", "anemia"), ("exercise", "improves", "mood"),
)
SUBJECTS, VERBS, OBJECTS = zip(*TRIPLES, strict=True)
GRAPH_SQL = f"""
rel AS (SELECT l_partkey % {len(TRIPLES)} AS rid, any_value({sql_pick(SUBJECTS, 'l_partkey')}) AS subject, any_value({sql_pick(VERBS, 'l_partkey')}) AS relation, any_value({sql_pick(OBJECTS, 'l_partkey')}) AS object, round(avg(l_discount) * 12 + (l_partkey % {len(TRIPLES)}) / 40, 6) AS confidence FROM lineitem GROUP BY l_partkey % {len(TRIPLES)}),
src AS (SELECT l_partkey % {len(TRIPLES)} AS rid, min({sql_pick(worded.URLS, 'l_suppkey')}) AS source_url FROM lineitem WHERE l_partkey % {len(TRIPLES)} % 3 <> 0 AND l_quantity > 45 GROUP BY 1),
ed AS (SELECT rel.*, source_url FROM rel LEFT JOIN src USING (rid)), nm AS (SELECT subject AS name FROM ed UNION SELECT object FROM ed), ak AS (SELECT claim_id, lower(unnest(entities)) AS e FROM c),
hit AS (SELECT DISTINCT claim_id, name FROM ak, nm WHERE lower(name) = e OR (length(e) > 3 AND contains(lower(name), e))),
one AS (SELECT DISTINCT claim_id, subject, relation, object, confidence, source_url, 1 AS hop FROM ed JOIN hit ON name IN (subject, object)),
two AS (SELECT DISTINCT claim_id, a.subject, a.relation, a.object, greatest(a.confidence, b.confidence) AS confidence, coalesce(a.source_url, b.source_url) AS source_url, 2 AS hop, b.rid FROM ed a JOIN ed b ON a.object = b.subject JOIN hit ON name IN (a.subject, b.object)),
paths AS (SELECT * FROM one UNION ALL SELECT claim_id, subject, relation, object, confidence, source_url, hop FROM two)
"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lines = read_table(spark, d, "lineitem")
    rid = c("l_partkey") % len(TRIPLES)
    rels = lines.groupBy(rid.alias("rid")).agg(F.avg("l_discount").alias("m")).select("rid", worded.pick(SUBJECTS, c("rid")).alias("subject"), worded.pick(VERBS, c("rid")).alias("relation"), worded.pick(OBJECTS, c("rid")).alias("object"), F.round(c("m") * 12 + c("rid") / 40, 6).alias("confidence"))
    sources = lines.filter((rid % 3 != 0) & (c("l_quantity") > 45)).select(rid.alias("rid"), worded.pick(worded.URLS, c("l_suppkey")).alias("source_url")).distinct()
    asked = worded.claims(spark, d).select("claim_id", F.explode("entities").alias("entity")).filter("entity IS NOT NULL")
    return alignment.graph_paths(rels, sources, asked)


@query(f"WITH {CLAIMS_SQL}, {GRAPH_SQL} SELECT claim_id, subject, relation, object, confidence, source_url, hop, count(*) AS n FROM paths GROUP BY ALL")
def s5_j3_j4_j7_d16_graph_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {CLAIMS_SQL}, {GRAPH_SQL}, {CONTEXT},
g0 AS (SELECT claim_id, subject, relation, object, arg_min({{'c': confidence, 'u': source_url, 'h': hop}}, (hop, -confidence, coalesce(source_url, ''))) AS p FROM paths GROUP BY 1, 2, 3, 4),
g1 AS (SELECT claim_id, subject, relation, object, p.c AS confidence, p.u AS source_url, p.h AS hop, subject || ' ' || trim(replace(relation, '_', ' ')) || ' ' || object AS statement, greatest(0, p.c - CASE WHEN p.h = 2 THEN 0.15 ELSE 0 END) AS path, kx.* EXCLUDE (claim_id) FROM g0 JOIN kx USING (claim_id)),
g2 AS (SELECT *, {TOKS('statement')} AS tok, {TOKS('subject')} AS st, {TOKS('object')} AS ot, list_filter(asets, lambda t: len(t) > 0) AS sets FROM g1),
g3 AS (SELECT *, {s_shared('tok', 'atok')} AS ao, {s_shared('tok', 'ct')} AS co, {s_shared('tok', 'spec')} AS so, round(CASE WHEN len(sets) = 0 THEN 1 ELSE 0.6 * list_max(list_transform(sets, lambda t: len(list_intersect(st, t)) / len(t))) + 0.4 * list_max(list_transform(sets, lambda t: len(list_intersect(ot, t)) / len(t))) END, 9) AS role FROM g2),
g4 AS (SELECT *, round(least(1, least(1, least(1, path + least(0.15, 0.03 * ao)) + CASE WHEN so > 0 THEN least(0.08, 0.02 * so) WHEN len(spec) = 0 AND co > 0 THEN least(0.05, 0.01 * co) ELSE 0 END) + 0.05 * role), 9) AS score FROM g3
    WHERE NOT (len(atok) > 0 AND NOT {STRONG('tok')} AND ao = 0 AND so = 0 AND len(spec) = 0 AND co = 0 AND (hop > 1 OR path < 0.65)) AND NOT (len(atok) > 0 AND role < 0.34 AND (hop > 1 OR path < 0.75)))
SELECT claim_id, subject, object, statement, hop, round(score, 6) AS score, round(role, 6)::DOUBLE AS role, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, statement, subject, object) AS rank FROM g4) WHERE rank <= 10
""")
def f13_g1_g4_graph_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = alignment.graph_candidates(_paths(spark, d), _claims(spark, d))
    return out.select("claim_id", "subject", "object", "statement", "hop", _r(F.col("score")).alias("score"), _r(F.col("role")).alias("role"), "rank")


# metadata predicates

TAGS = ("anatomy", "nutrition", "other", "genetics", "pathology")
VECTORS = f"""
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, {sql_pick(TAGS, 'label')} AS tag, CASE WHEN vec_id % 7 = 0 THEN 'de' ELSE 'en' END AS lang FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM u),
p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, r.tag, {sql_pick((('anatomy',), ('rare',), (), None), 'q.vec_id // 100')} AS tags, round(list_dot_product(q.v, r.v) / (q.size * r.size), 6) AS score FROM n q JOIN n r ON q.lang = r.lang AND q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
s AS (SELECT *, len(coalesce(tags, [])) = 0 OR tag = 'other' OR list_contains(tags, tag) AS fits FROM p WHERE score >= 0.05), f AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query) AS any_fit FROM s) WHERE fits OR NOT any_fit)
"""


@query(f"WITH {VECTORS} SELECT query, neighbour, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM f) WHERE rank <= 10")
def s1_vector_topk_with_predicate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read_table(spark, d, "embeddings").withColumns({"tag": worded.pick(TAGS, c("label")), "lang": F.when(c("vec_id") % 7 == 0, "de").otherwise("en"), "tags": worded.pick((("anatomy",), ("rare",), (), None), F.floor(c("vec_id") / 100))})
    return retrieval.cosine_topk_with_retry(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", "tags", tag_col="tag", same_col="lang", least=0.05)


@query(r"""
WITH t AS (SELECT item_id AS claim, item_id % 3 = 0 AS only_en, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')) AS terms FROM benchmark), tt AS (SELECT claim, unnest(terms) AS term FROM t),
e AS (SELECT doc_id AS doc, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}') AS a FROM documents), size AS (SELECT count(*) AS n, avg(len(a)) AS mean FROM e),
tf AS (SELECT term, doc, lang, dl, count(*) AS tf FROM (SELECT doc, lang, len(a) AS dl, unnest(a) AS term FROM e) WHERE term IN (SELECT term FROM tt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT term, doc, lang, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM tf JOIN df USING (term), size),
h AS (SELECT claim, doc, lang, sum(part) AS score, count(*) AS got FROM s JOIN tt USING (term) GROUP BY 1, 2, 3), w AS (SELECT claim, only_en, len(terms) AS need FROM t),
o AS (SELECT claim, doc, round(-score, 6) AS bm25 FROM h JOIN w USING (claim) WHERE got = need AND (NOT only_en OR lang = 'en'))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY bm25, doc) AS rank FROM o) WHERE rank <= 20
""")
def s4_bm25_with_topics(spark: SparkSession, d: str) -> DataFrame:
    claims = read_table(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.array(F.lit("en"))).alias("topics"))
    return retrieval.bm25_topk(read_table(spark, d, "documents"), claims, "doc_id", "text", "item_id", "text", k=20, topic_col="lang", topics_col="topics")
