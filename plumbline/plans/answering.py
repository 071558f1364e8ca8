"""Queries on anchors, answers, replies of services, candidates of a round, and rounds of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType

from plumbline.functions import anchors, answers, fastpath, words
from plumbline.operators import hybrid, lists, retrieval, rounds
from plumbline.plans import worded
from plumbline.plans.registry import NOW, _evidence, query
from plumbline.plans.searching import CONTEXT, STRONG, TOKS, _claims
from plumbline.plans.worded import CLAIMS, ENTITIES, EVIDENCE_SQL, STATEMENTS, URLS, sql_pick, sql_text
from plumbline.session import read_table
from plumbline.sources import logs

c = F.col

# anchors


def s_norm(x: str) -> str:
    kept = f"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\-\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND NOT list_contains({sql_text(anchors.DROPPED)}, t))"
    return f"CASE WHEN len({kept}) = 1 AND length(({kept})[1]) < 3 THEN '' ELSE array_to_string({kept}, ' ') END"


@query(f"""
WITH p AS (SELECT o_orderkey AS id, {sql_pick(CLAIMS, 'o_orderkey')} AS part, {sql_pick(ENTITIES, 'o_custkey')} AS hints FROM orders),
q AS (SELECT id, lower(coalesce(part, '')) AS low, coalesce(hints, []) AS hints, regexp_extract_all(coalesce(part, ''), {sql_text(anchors.WORD)}) AS own FROM p),
r AS (SELECT id, low, list_filter(list_transform(own, lambda w: {s_norm('w')}), lambda w: w <> '') AS words,
    list_filter(list_transform(hints, lambda w: {s_norm('w')}), lambda h: h <> '' AND CASE WHEN contains(h, ' ') THEN contains(low, h) ELSE regexp_matches(low, '\\b' || h || '\\b') END) AS named,
    list_transform(list_transform(range(1, len(own) - 1), lambda i: lower(own[i] || ' ' || own[i + 1] || ' ' || own[i + 2])) || list_transform(range(1, len(own)), lambda i: lower(own[i] || ' ' || own[i + 1])), lambda w: {s_norm('w')}) AS runs FROM q),
s AS (SELECT id, low, words, list_filter(named || runs || words, lambda a: a <> '') AS every FROM r),
t AS (SELECT id, words, list_filter(every, lambda a, i: list_position(every, a) = i AND (contains(a, ' ') OR contains(low, a)))[1:4] AS kept FROM s),
u AS (SELECT id, words, CASE WHEN len(kept) > 0 THEN kept ELSE words[1:4] END AS kept FROM t)
SELECT id, array_to_string(CASE WHEN len(kept) < 2 THEN (kept || list_filter(words, lambda w: length(w) >= 3)[1:2])[1:4] ELSE kept END, '|') AS anchors FROM u
""")
def u31_u33_rule_anchors(spark: SparkSession, d: str) -> DataFrame:
    key = c("o_orderkey")
    own = anchors.rule_anchors(worded.pick(CLAIMS, key), worded.pick(ENTITIES, c("o_custkey")))
    return read_table(spark, d, "orders").select(key.alias("id"), F.array_join(own, "|").alias("anchors"))


#: What a model tells of a part: usable anchors, too few, and none.
TOLD = (("Zinc Supplements", "the common cold"), ("zinc", "iron"), ("cold",), (), None, ("lung cancer", "smoking", "smoking", "risk of cancer", "causes"), ("", "the of", None, "viral infections"), ("autism", "vaccines"), ("bones", "206 bones", "an adult"))


def s_anchors(name: str, source: str, hints: str) -> str:
    """CTEs from ``source`` (id, part, ..) to ``name``: the same with the list ``rule_`` of anchors by rule."""
    return f"""
{name}a AS (SELECT *, lower(coalesce(part, '')) AS low_, coalesce({hints}, []) AS hints_, regexp_extract_all(coalesce(part, ''), {sql_text(anchors.WORD)}) AS own_ FROM {source}),
{name}b AS (SELECT *, list_filter(list_transform(own_, lambda w: {s_norm('w')}), lambda w: w <> '') AS words_, list_filter(list_transform(hints_, lambda w: {s_norm('w')}), lambda h: h <> '' AND CASE WHEN contains(h, ' ') THEN contains(low_, h) ELSE regexp_matches(low_, '\\b' || h || '\\b') END) AS named_,
    list_transform(list_transform(range(1, len(own_) - 1), lambda i: lower(own_[i] || ' ' || own_[i + 1] || ' ' || own_[i + 2])) || list_transform(range(1, len(own_)), lambda i: lower(own_[i] || ' ' || own_[i + 1])), lambda w: {s_norm('w')}) AS runs_ FROM {name}a),
{name}c AS (SELECT *, list_filter(named_ || runs_ || words_, lambda a: a <> '') AS every_ FROM {name}b), {name}d AS (SELECT *, list_filter(every_, lambda a, i: list_position(every_, a) = i AND (contains(a, ' ') OR contains(low_, a)))[1:4] AS kept_ FROM {name}c),
{name}e AS (SELECT *, CASE WHEN len(kept_) > 0 THEN kept_ ELSE words_[1:4] END AS first_ FROM {name}d),
{name} AS (SELECT * EXCLUDE (low_, hints_, own_, words_, named_, runs_, every_, kept_, first_), CASE WHEN len(first_) < 2 THEN (first_ || list_filter(words_, lambda w: length(w) >= 3)[1:2])[1:4] ELSE first_ END AS rule_ FROM {name}e)"""


@query(f"""
WITH p AS (SELECT o_orderkey AS id, {sql_pick(CLAIMS, 'o_orderkey')} AS part, {sql_pick(ENTITIES, 'o_custkey')} AS hints, {sql_pick(TOLD, 'o_custkey')} AS told FROM orders), {s_anchors('r1', 'p', 'hints')},
q AS (SELECT * EXCLUDE (rule_), rule_ AS rule1 FROM r1), {s_anchors('r2', 'q', '[]')}, t0 AS (SELECT *, list_filter(list_transform(coalesce(told, []), lambda w: {s_norm("coalesce(w, '')")}), lambda a: a <> '') AS told0 FROM r2),
t AS (SELECT *, list_filter(told0, lambda a, i: list_position(told0, a) = i AND (contains(a, ' ') OR contains(lower(coalesce(part, '')), a)))[1:4] AS told1 FROM t0)
SELECT id, array_to_string(CASE WHEN len(told1) >= 2 THEN told1 WHEN len(rule1) < 2 THEN (rule1 || rule_)[1:4] ELSE rule1 END, '|') AS anchors FROM t
""")
def u32_claim_anchors(spark: SparkSession, d: str) -> DataFrame:
    key, other = c("o_orderkey"), c("o_custkey")
    own = anchors.claim_anchors(worded.pick(CLAIMS, key), worded.pick(ENTITIES, other), worded.pick(TOLD, other))
    return read_table(spark, d, "orders").select(key.alias("id"), F.array_join(own, "|").alias("anchors"))


# answers

STATUSES = ("valid", "INVALID", None, "PARTIALLY_VALID", "partially_invalid", "STRONGLY_VALID", "UNKNOWN", "")
VERDICTS = ("TRUE", "FALSE", "UNVERIFIABLE", "PARTIALLY_TRUE", None)
SEGMENTS_SQL = f"{EVIDENCE_SQL}, sg AS (SELECT l_orderkey AS claim_id, {worded.SEQUENCE_SQL} AS seq, {sql_pick(STATUSES, 'l_partkey')} AS status, {sql_pick(STATEMENTS, 'l_partkey + 3 * l_orderkey')} AS fact FROM lineitem)"


def _listed(rows: DataFrame, *columns: Column | str) -> Column:
    """A claim's rows, at most as many as an order has lines, in their order."""
    return F.array_sort(F.collect_list(F.struct("seq", *columns)))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(c("l_orderkey").alias("claim_id"), worded.sequence().alias("seq"), worded.pick(STATUSES, c("l_partkey")).alias("status"), worded.pick(STATEMENTS, c("l_partkey") + 3 * c("l_orderkey")).alias("supporting_fact"))


@query(f"""
WITH {SEGMENTS_SQL}, s AS (SELECT *, CASE WHEN coalesce(status, '') = '' THEN 'UNKNOWN' ELSE upper(status) END AS st, trim(fact) AS said FROM sg),
f AS (SELECT claim_id, seq, st || ': ' || said AS finding, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS n FROM s WHERE st IN ('VALID', 'INVALID', 'PARTIALLY_VALID', 'PARTIALLY_INVALID') AND said <> ''),
h AS (SELECT claim_id, string_agg(finding, '|' ORDER BY seq) AS findings FROM f WHERE n <= 5 GROUP BY 1),
g AS (SELECT claim_id, bool_or(st IN ('INVALID', 'PARTIALLY_INVALID')) AS bad, bool_or(st IN ('VALID', 'PARTIALLY_VALID', 'STRONGLY_VALID')) AS good, bool_or(st = 'UNKNOWN') AS open FROM s GROUP BY 1),
v AS (SELECT *, {sql_pick(VERDICTS, 'claim_id')} AS verdict FROM g LEFT JOIN h USING (claim_id))
SELECT claim_id, CASE {' '.join(f"WHEN verdict = '{name}' THEN '{text}'" for name, text in answers.BY_VERDICT.items())} WHEN bad AND good THEN '{answers.BOTH_WAYS}' WHEN open THEN '{answers.UNRESOLVED}' ELSE '{answers.WITH_CAVEATS}' END AS rationale,
    coalesce(findings, '') AS findings FROM v
""")
def u114_u115_rationale(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d)
    own = rows.groupBy("claim_id").agg(_listed(rows, "status", "supporting_fact").alias("segments"))
    return own.select("claim_id", answers.rationale(worded.pick(VERDICTS, c("claim_id")), c("segments")).alias("rationale"), F.array_join(answers.key_findings(c("segments")), "|").alias("findings"))


INTERNAL = (" true ", "PARTIALLY_TRUE", "", None, "misleading")
BINARY = ("TRUE", "", None, "false ", "maybe", "UNVERIFIABLE", "False")
CLEANED = "regexp_replace(regexp_replace(trim(coalesce({0}, '')), '\\s+', ' ', 'g'), '^[ \\-;,.]+|[ \\-;,.]+$', '', 'g')"


@query(f"""
WITH {EVIDENCE_SQL}, n AS (SELECT *, max(stance <> 'neutral') OVER (PARTITION BY claim_id) AS own FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY claim_id) AS held FROM n WHERE NOT own OR stance <> 'neutral'),
w AS (SELECT *, upper(trim(coalesce({sql_pick(INTERNAL, 'claim_id')}, ''))) AS i, upper(trim(coalesce({sql_pick(BINARY, 'claim_id')}, ''))) AS b FROM r WHERE place <= 5),
x AS (SELECT *, CASE WHEN i = '' THEN 'UNVERIFIABLE' ELSE i END AS inner_verdict FROM w)
SELECT claim_id, place::INT AS place, CASE WHEN b IN ('TRUE', 'FALSE') THEN b ELSE inner_verdict END AS verdict, inner_verdict AS verdict_internal, CASE WHEN claim_id % 3 = 0 THEN 0.0::DOUBLE ELSE round((claim_id % 7) / 7, 9) END AS confidence, CASE WHEN claim_id % 4 = 0 THEN round((claim_id % 5) / 5, 9) WHEN claim_id % 3 = 0 THEN 0.0::DOUBLE ELSE round((claim_id % 7) / 7, 9) END AS calibrated,
    CASE WHEN claim_id % 6 > 1 THEN claim_id % 6 WHEN claim_id % 6 = 1 THEN 1 ELSE held END::BIGINT AS evidence_count, {CLEANED.format('statement')} AS statement, coalesce(source_url, '') AS source_url, round(CASE WHEN is_backfill THEN weight ELSE score END, 3)::DOUBLE AS score,
    round(CASE WHEN side = 'sem' THEN trust WHEN is_backfill THEN 0.0 ELSE score END, 3)::DOUBLE AS sem_score, round(CASE WHEN side = 'kg' THEN trust ELSE 0 END, 3)::DOUBLE AS kg_score, coalesce(credibility, 0.5)::DOUBLE AS credibility, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'N/A' END AS grade FROM x
""")
def f57_response(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d)
    shown = F.struct(
        "seq", "statement", "source_url", F.when(~c("is_backfill"), c("score")).alias("score"), c("weight").alias("final_score"), F.when(c("side") == "sem", c("trust")).alias("sem_score"),
        F.when(c("side") == "kg", c("trust")).alias("kg_score"), "credibility", F.when(c("seq") % 2 == 0, "B").alias("grade"),
    )
    own = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.when(c("stance") != "neutral", shown))).alias("own"), F.array_sort(F.collect_list(shown)).alias("ranked"))
    key = c("claim_id")
    answer = answers.response(
        c("own"), c("ranked"), F.array(F.lit(" a fact [1] "), F.lit(" "), F.lit(None)), worded.pick(INTERNAL, key), worded.pick(BINARY, key), F.when(key % 3 != 0, F.round(key % 7 / 7, 9)), F.when(key % 4 == 0, F.round(key % 5 / 5, 9)), key % 6,
    )
    one = own.select("claim_id", *[v.alias(k) for k, v in answer.items()])
    each = one.select("claim_id", "verdict", "verdict_internal", "confidence", c("calibrated_confidence").alias("calibrated"), c("evidence_count").cast("long").alias("evidence_count"), F.posexplode("evidence").alias("place", "e"))
    return each.withColumn("place", c("place") + 1).select("*", "e.*").drop("e")


RELEVANCE = ("supports", "REFUTES", " neutral ", None, "SUPPORTS ", "mixed")
REASONS = ("", "weak subject", None, "no predicate", " weak subject ")
HOSTS = ("www.cdc.gov", "pubmed.ncbi.nlm.nih.gov", "www.cochrane.org:443", "news.example.com:80", "blog.example", "", "", "", "who.int", "sub.nhs.uk")


@query(f"""
WITH m AS (SELECT l_orderkey AS claim_id, {worded.SEQUENCE_SQL} AS seq, upper(trim(coalesce({sql_pick(RELEVANCE, 'l_partkey')}, ''))) AS rel, trim(coalesce({sql_pick(REASONS, 'l_suppkey')}, '')) AS reason, l_partkey % 2 = 0 AS sup, l_partkey % 3 = 0 AS con, l_suppkey % 4 = 0 AS gate, {sql_pick(HOSTS, 'l_suppkey')} AS host,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_discount ELSE l_tax END AS al FROM lineitem),
b AS (SELECT claim_id, reason, count(*) AS n FROM m WHERE reason <> '' GROUP BY 1, 2), t AS (SELECT claim_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM b GROUP BY 1),
g AS (SELECT claim_id, count(*) FILTER (rel = 'SUPPORTS')::INT AS support_count, count(*) FILTER (rel = 'REFUTES')::INT AS refute_count, count(*) FILTER (rel NOT IN ('SUPPORTS', 'REFUTES'))::INT AS neutral_count, count(*) FILTER (sup)::INT AS support_admitted, count(*) FILTER (con)::INT AS refute_admitted, count(*) FILTER (gate)::INT AS refute_gate_passed,
    coalesce(round(avg(al), 9), 0)::DOUBLE AS alignment_score, coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (host <> ''), '') AS sources FROM m GROUP BY 1)
SELECT g.*, coalesce(reasons, '') AS block_reasons FROM g LEFT JOIN t USING (claim_id)
""")
def f59_debug_block(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").withColumn("seq", worded.sequence())
    part, nth = c("l_partkey"), c("l_linenumber") % 3
    row = F.struct("seq", worded.pick(RELEVANCE, part).alias("relevance"), worded.pick(REASONS, c("l_suppkey")).alias("block_reason"), (part % 2 == 0).alias("to_support"), F.when(part % 3 == 0, True).alias("to_contradict"), (c("l_suppkey") % 4 == 0).alias("gate_passed"), worded.pick(URLS, c("l_suppkey")).alias("source_url"))
    segment = F.struct("seq", F.when(nth == 1, c("l_discount")).alias("final_score"), F.when(nth == 2, c("l_tax")).alias("score"), F.lit(None).cast("double").alias("predicate_match_score"))
    own = rows.groupBy(c("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_list(row)).alias("map"), F.array_sort(F.collect_list(segment)).alias("segments"))
    figures = answers.debug_figures(c("map"), c("map"), c("segments"))
    text = F.array_join(F.transform(F.map_entries(figures["block_reasons"]), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    shown = {**figures, "block_reasons": text, "alignment_score": F.round(figures["alignment_score"], 9), "sources": F.array_join(figures["sources"], ",")}
    return own.select("claim_id", *[v.alias(k) for k, v in shown.items()])


@query("SELECT o_orderkey AS id, array_to_string(range(1, least(5, o_custkey % 30) + 1), ',') AS flat, array_to_string(list_transform(range(0, least(5, o_custkey % 9)), lambda i: array_to_string(range(1, least(5, i + 1) + 1), ',')), ';') AS nested, array_to_string(range(1, least(5, o_custkey % 7) + 1), ',') AS mapped FROM orders")
def u119_log_sample(spark: SparkSession, d: str) -> DataFrame:
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), upto(c("o_custkey") % 30).alias("a"), upto(c("o_custkey") % 9).alias("b"), F.create_map(F.lit("k"), upto(c("o_custkey") % 7)).alias("m"))
    cut = lambda x, kind: answers.sampled(x, kind)
    longs = ArrayType(LongType())
    deep = F.transform(c("b"), upto)
    return rows.select("id", F.array_join(cut(c("a"), longs), ",").alias("flat"), F.array_join(F.transform(cut(deep, ArrayType(longs)), lambda x: F.array_join(x, ",")), ";").alias("nested"), F.array_join(cut(c("m"), MapType(StringType(), longs))["k"], ",").alias("mapped"))


# replies

#: Replies, their results as index:subject, and their queries.
REPLIES = (
    ('{"results": [{"index": 2, "triples": [{"subject": "zinc", "relation": "reduces", "object": "colds"}]}, {"index": 0, "triples": []}]}', "2:zinc|0:", ""),
    ('```json\n{"triples": [{"subject": "iron", "relation": "treats", "object": "anemia"},]}\n```', "0:iron", None),
    ('Here it is: {"results": [{"index": 1, "triples": [{"subject": "tea"}]},],} Thanks', "1:tea", None),
    ('{"queries": [" Zinc  zinc colds", 7, "", "iron anemia", "zinc colds"]}', None, "zinc colds|iron anemia"),
    ('{"queries": "One Query"}', None, "one query"), ('["B query", null, "a query", {"q": 1}]', None, "b query|a query"), ("no json", None, ""), ("", None, ""), (None, None, ""), ("[]", None, ""), ("{}", None, ""),
)
REPLY, RESULTS, QUERIES = zip(*[(r, x, q or "") for r, x, q in REPLIES], strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(RESULTS, 'o_orderkey')} AS results, {sql_pick(QUERIES, 'o_orderkey')} AS queries FROM orders")
def js2_js3_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = worded.pick(REPLY, c("o_orderkey"))
    first = lambda r: F.concat_ws(":", r["index"].cast("string"), F.coalesce(F.get(r["triples"], F.lit(0))["subject"], F.lit("")))
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.array_join(F.transform(answers.results_of(reply), first), "|").alias("results"), F.array_join(answers.queries_of(reply), "|").alias("queries"))


@query("""
WITH i AS (SELECT o_custkey AS batch, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index FROM orders),
r AS (SELECT o_custkey AS batch, o_orderkey % 12 AS index, count(*) AS names FROM orders GROUP BY 1, 2)
SELECT i.batch, i.item, i.index, coalesce(names, 0) AS names FROM i LEFT JOIN r USING (batch, index)
""")
def j13_results_by_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(c("o_custkey").alias("batch"), c("o_orderkey").alias("item"))
    results = rows.groupBy("batch", (c("item") % 12).alias("index")).agg(F.count(F.lit(1)).alias("names"))
    return lists.by_index(results, rows, "batch", "item", every_item=True).select("batch", "item", c("index").cast("long").alias("index"), F.coalesce("names", F.lit(0)).alias("names"))


# rounds


def _rounds_sql(number: int) -> str:
    """The pool of a round: the lines up to twice its number, alike in key once, and its figures."""
    return f"""
o{number} AS (SELECT *, row_number() OVER (PARTITION BY claim_id, key ORDER BY trust DESC, semantic_score DESC, evidence_id) AS nth FROM t WHERE line <= {2 * number}),
g{number} AS (SELECT claim_id, count(*) AS evidence, round(sum(trust * trust) / sum(trust), 9) AS post, round(avg(CASE WHEN stance <> 'contradicts' THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM o{number} WHERE nth = 1 GROUP BY 1),
n{number} AS (SELECT claim_id, count(*) AS new FROM t WHERE line <= {2 * number} GROUP BY 1)"""


def _state_sql(number: int) -> str:
    before = f"(SELECT claim_id, post AS before FROM s{number - 1} WHERE stop_reason IS NULL)" if number > 1 else "(SELECT o_orderkey AS claim_id, 0.0::DOUBLE AS before FROM orders)"
    stop = f"WHEN round(post - before, 9) < 0.02 THEN '{rounds.NO_GAIN}'" if number > 1 else ""
    return f"""
a{number} AS (SELECT claim_id, before, coalesce(post, 0)::DOUBLE AS post, coalesce(agreement, 0)::DOUBLE AS agreement, coalesce(evidence, 0) AS evidence, coalesce(new, 0) AS new FROM {before} LEFT JOIN g{number} USING (claim_id) LEFT JOIN n{number} USING (claim_id)),
d{number} AS (SELECT *, CASE WHEN post >= 0.75 THEN '{rounds.MET}' {stop} ELSE '{rounds.SEARCH}' END AS decision FROM a{number}),
s{number} AS (SELECT *, {number} AS round, CASE WHEN decision <> '{rounds.SEARCH}' THEN decision WHEN (claim_id // 32 + {number}) % 5 = 0 THEN '{rounds.NOTHING_NEW}' END AS stop_reason FROM d{number})"""


ROUNDS_EVIDENCE = f"""
v AS (SELECT l_orderkey AS claim_id, l_linenumber AS line, {worded.SEQUENCE_SQL} AS evidence_id, l_discount * 10 AS semantic_score,
    CASE WHEN l_suppkey % 12 < 2 THEN md5(lower(trim({sql_pick(STATEMENTS, 'l_partkey + 3 * l_orderkey')}))) ELSE 'https://s' || l_suppkey || '.example/p?b=' || (l_linenumber % 2) END AS key,
    CASE l_returnflag WHEN 'A' THEN 'entails' WHEN 'R' THEN 'contradicts' ELSE 'neutral' END AS stance, floor((epoch(TIMESTAMP '{NOW}') - epoch(l_shipdate)) / 86400) AS days FROM lineitem),
t0 AS (SELECT *, CASE WHEN days < 180 THEN 1.0::DOUBLE WHEN days < 365 THEN 0.8 WHEN days < 1095 THEN 0.6 WHEN days < 1825 THEN 0.4 ELSE 0.3 END AS rec, CASE stance WHEN 'entails' THEN 1.0::DOUBLE WHEN 'contradicts' THEN 0.0 ELSE 0.5 END AS sta FROM v),
t AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE * semantic_score + 0.3::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * rec + 0.2::DOUBLE * sta)) AS trust FROM t0)
"""


@query("WITH " + ROUNDS_EVIDENCE + "".join("," + _rounds_sql(i) for i in (1, 2, 3)) + "".join("," + _state_sql(i) for i in (1, 2, 3)) + " UNION ALL ".join(f" SELECT claim_id, round, post AS trust_post, agreement, evidence, new, decision, coalesce(stop_reason, '') AS stop_reason FROM s{i}" for i in (1, 2, 3)))
def t21_trust_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Round i finds an order's first 2i lines; one claim in five finds nothing new in its searches."""
    every = _evidence(spark, d, "l_linenumber")  # not from the evidence_id: large part keys run into its line number
    claims = read_table(spark, d, "orders").select(c("o_orderkey").alias("claim_id"))
    states = rounds.trust_rounds(
        claims, lambda still, i: every.filter(c("l_linenumber") <= 2 * i).drop("l_linenumber").join(still, "claim_id", "left_semi"), lambda going, i: going.filter((F.floor(c("claim_id") / 32) + i) % 5 != 0), F.lit(NOW).cast("timestamp_ntz"), F.lit(0.5),
    )
    return states.select("claim_id", "round", F.round("trust_post", 9).alias("trust_post"), F.round("agreement", 9).alias("agreement"), "evidence", "new", "decision", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"))


MEETS = f"(len(tok) > 0 AND ({STRONG('tok')} OR CASE WHEN len(spec) > 0 THEN list_has_any(tok, spec) ELSE list_has_any(tok, ct) END))"
SPOKEN = "CASE WHEN seq % 4 < 2 THEN coalesce(statement, '') ELSE '' END"


@query(f"""
WITH {EVIDENCE_SQL}, {CONTEXT}, m AS (SELECT claim_id, seq, statement, source_url, CASE WHEN quantity > 40 THEN round(trust - 0.48, 9) ELSE score * 0.8 END AS score, quantity > 40 AS lexical, quantity = 45 OR quantity = 5 AS ctx, kx.* EXCLUDE (claim_id), {TOKS("coalesce(statement, '') || ' | ' || array_to_string(coalesce(entities, []), ' | ')")} AS tok FROM ev JOIN kx USING (claim_id) WHERE side = 'sem'),
s AS (SELECT *, row_number() OVER (PARTITION BY claim_id, lower(trim(coalesce(statement, ''))), source_url ORDER BY score DESC, seq) AS nth FROM m WHERE NOT (lexical AND score <= 0) AND (len(usable) = 0 OR ctx OR score >= 0.72 OR {MEETS})),
p AS (SELECT claim_id, seq, {SPOKEN} AS statement, trim(concat_ws(' ', nullif(trim(coalesce(entities[1], '')), ''), 'linked to', nullif(trim(coalesce(entities[2], '')), ''))) AS said, source_url, greatest(score, weight)::DOUBLE AS raw, kx.* EXCLUDE (claim_id),
    {TOKS("coalesce(entities[1], '') || ' | ' || coalesce(entities[2], '') || ' | linked_to | ' || " + SPOKEN)} AS tok FROM ev JOIN kx USING (claim_id) WHERE side = 'kg')
SELECT claim_id, seq, 'sem' AS side, statement, source_url, score::DOUBLE AS score FROM s WHERE nth = 1
UNION ALL SELECT claim_id, seq, 'kg', CASE WHEN trim(statement) = '' THEN said ELSE statement END, source_url, CASE WHEN trim(coalesce(source_url, '')) <> '' THEN round(least(1, raw + 0.05), 9) ELSE round(raw, 9) END FROM p WHERE len(usable) = 0 OR {MEETS}
""")
def t19_retrieval_phase(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d)
    none = F.lit(None).cast("array<string>")
    found = rows.filter("side = 'sem'")
    shared = ["claim_id", "seq", "statement", "source_url", "entities", none.alias("context_entities"), c("quantity").isin(45, 5).alias("claim_context_match")]
    semantic = found.filter("quantity <= 40").select(*shared, (c("score") * 0.8).alias("score"))
    lexical = found.filter("quantity > 40").select(*shared, F.round(c("trust") - 0.48, 9).alias("score"), c("weight").alias("bm25"))
    missing = F.lit(None).cast("double")
    graph = rows.filter("side = 'kg'").select(
        "claim_id", "seq", F.get("entities", F.lit(0)).alias("subject"), F.lit("linked_to").alias("relation"), F.get("entities", F.lit(1)).alias("object"), F.when(c("seq") % 4 < 2, c("statement")).otherwise("").alias("statement"), "source_url",
        c("score").alias("kg_score_raw"), missing.alias("kg_score"), c("weight").alias("confidence"), missing.alias("path_quality_score"), missing.alias("score"),
    )
    out = rounds.retrieval_phase(_claims(spark, d), semantic, lexical, graph)
    return out.withColumn("score", F.when(c("side") == "kg", F.round("score", 9)).otherwise(c("score")))


STEP = "least(1, weight * 0.7 + 0.06 * {0})"


@query(f"""
WITH {EVIDENCE_SQL}, x AS (SELECT claim_id, round(max(weight * 0.7), 9) AS b0, round(max({STEP.format(1)}), 9) AS b1, round(max({STEP.format(2)}), 9) AS b2, (claim_id // 32) % 4 AS few FROM ev GROUP BY 1)
SELECT claim_id, CASE WHEN b0 >= 0.7 OR few = 1 THEN 0 WHEN b1 >= 0.66 OR few = 2 THEN 1 WHEN b2 >= 0.62 OR few = 3 THEN 2 ELSE 3 END::INT AS rounds,
    CASE WHEN b0 >= 0.7 THEN '{rounds.ENOUGH_NOW}' WHEN few = 1 THEN '{rounds.FEW_URLS}' WHEN b1 >= 0.66 THEN '{rounds.ENOUGH_NOW}' WHEN few = 2 THEN '{rounds.FEW_URLS}' WHEN b2 >= 0.62 THEN '{rounds.ENOUGH_NOW}' WHEN few = 3 THEN '{rounds.FEW_URLS}' ELSE '{rounds.LAST_ROUND}' END AS reason,
    round(CASE WHEN b0 >= 0.7 OR few = 1 THEN b0 WHEN b1 >= 0.66 OR few = 2 THEN b1 WHEN b2 >= 0.62 OR few = 3 THEN b2 ELSE least(1, b0 + 0.18) END, 6) AS best FROM x
""")
def t20_reinforced(spark: SparkSession, d: str) -> DataFrame:
    """Each round finds three addresses for a claim, but in round i only one for those whose key leaves i; scores rise with the rounds."""
    rows = worded.evidence(spark, d).select("claim_id", "seq", "weight")
    scored = lambda i: F.least(F.lit(1.0), c("weight") * 0.7 + 0.06 * i)
    known = rows.select("claim_id", F.lit("u").alias("url"))

    def search(weak: DataFrame, number: int) -> DataFrame:
        few = F.floor(c("claim_id") / 32) % 4 == number
        return weak.select("claim_id").distinct().select("claim_id", F.explode(F.array(F.lit("u"), F.lit(f"a{number}"), F.when(~few, f"b{number}"))).alias("url")).filter("url IS NOT NULL")

    def rank(fresh: DataFrame, number: int) -> DataFrame:
        return rows.join(fresh.select("claim_id").distinct(), "claim_id", "left_semi").withColumn("final_score", scored(number))

    ranked, ends = rounds.reinforced(rows.withColumn("final_score", scored(0)), known, search, rank, 0.7, least_new=2)
    return ends.join(ranked.groupBy("claim_id").agg(F.round(F.round(F.max("final_score"), 9), 6).alias("best")), "claim_id")


@query(f"""
WITH {EVIDENCE_SQL}, c AS (SELECT o_orderkey AS claim_id, {sql_pick(CLAIMS, 'o_orderkey')} AS claim FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS place FROM ev JOIN c USING (claim_id)),
m AS (SELECT *, place <= 5 AND coalesce(claim, '') <> '' AS asked, ((length(coalesce(statement, '')) + length(claim)) % 13 - 1) / 10 AS raw FROM r), p AS (SELECT *, CASE WHEN asked THEN CASE WHEN raw BETWEEN 0 AND 1 THEN raw ELSE 1 / (1 + exp(-raw)) END END AS pair FROM m),
b AS (SELECT *, CASE WHEN asked THEN 0.75 * score + 0.25 * pair ELSE score END AS final FROM p)
SELECT claim_id, seq, round(final, 6)::DOUBLE AS final_score, row_number() OVER (PARTITION BY claim_id ORDER BY pair IS NULL, CASE WHEN pair IS NULL THEN place END, round(final, 9) DESC, round(pair, 9) DESC, coalesce(statement, ''), place) AS rank FROM b
""")
def t4_pair_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d)
    ranked = rows.select("claim_id", "seq", "statement", c("score").alias("final_score"), F.row_number().over(Window.partitionBy("claim_id").orderBy("seq")).alias("rank"))
    out = hybrid.reranked(ranked, worded.claims(spark, d), lambda pairs: [((len(s) + len(q)) % 13 - 1) / 10 for q, s in pairs], most=3)
    return out.select("claim_id", "seq", F.round("final_score", 6).alias("final_score"), c("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey AS id, 'INFO' AS level, 'Verdict updated: f' || o_orderkey AS message, 'revalidation-d' || (o_custkey % 9) AS request_id, 'f' || o_orderkey AS fact_id, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice END AS price FROM orders")
def js1_st10_event_log(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "orders").select(F.concat(F.lit("f"), c("o_orderkey").cast("string")).alias("fact_id"), F.concat(F.lit("d"), (c("o_custkey") % 9).cast("string")).alias("domain"), F.when(c("o_custkey") % 4 != 0, c("o_totalprice")).alias("price"), c("o_orderkey").alias("id"))
    back = logs.from_context(logs.event_rows(events, "revalidation"), "fact_id string, price double, id bigint")
    return back.select("id", "level", "message", "request_id", "fact_id", "price")


PATH_VERDICTS = ("TRUE", "FALSE", "PARTIALLY_TRUE", "unverifiable", None)
PATH_REASONS = (None, "ok", "Ok", None, "ok", None, "ok", None, "ok", None, None, "ok", "ok", "no_relevant_evidence", "ok", "ok", None, "ok", "ok", None, "ok", "ok", "NO_RELEVANT_EVIDENCE")
PATH_STATUS = ("VALID", "partially_valid", "INVALID", "VALID", "PARTIALLY_INVALID", "VALID", "VALID", "", "INVALID", "VALID", "INVALID")
TAGS = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({x}, '')), {sql_text(p)}) THEN '{n}' END" for n, p in fastpath.BEHAVIOURS.items()) + "], lambda b: b IS NOT NULL)"
BAG = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), {sql_text(words.ALPHA)}), lambda w: NOT list_contains({sql_text(words.STOP)}, w)))"


@query(f"""
WITH s AS (SELECT l_orderkey AS claim_id, upper({sql_pick(PATH_STATUS, 'l_partkey')}) AS st, lower(coalesce({sql_pick(PATH_REASONS, 'l_suppkey')}, '')) AS reason, l_quantity / 50 + 0.5 AS pm, {sql_pick(CLAIMS, 'l_orderkey')} AS seg, {sql_pick(STATEMENTS, 'l_partkey + l_orderkey')} AS fact FROM lineitem),
t AS (SELECT *, {BAG('seg')} AS a, {BAG('fact')} AS b, {TAGS('seg')} AS ca, {TAGS('fact')} AS fa FROM s),
u AS (SELECT claim_id, count(*) AS parts, bool_or(reason IN ('no_relevant_evidence', 'insufficient_admissible_evidence')) AS lost, bool_or(st = '') AS unknown,
    bool_or(st IN ('VALID', 'PARTIALLY_VALID') AND NOT (pm >= 0.72 AND (len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) >= 0.3 * len(a)) AND (len(ca) = 0 OR len(fa) = 0 OR list_has_any(ca, fa)))) AS loose FROM t GROUP BY 1),
o AS (SELECT o_orderkey AS claim_id, o_custkey AS k, upper(coalesce({sql_pick(PATH_VERDICTS, 'o_custkey')}, '')) AS verdict, o_custkey % 17 = 0 AS none FROM orders),
p AS (SELECT *, k % 13 <> 0 AS enough, CASE WHEN k % 7 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS cov, k % 3 AS many FROM o LEFT JOIN u USING (claim_id))
SELECT claim_id, enough AND (none OR (verdict <> 'UNVERIFIABLE' AND (k % 10) / 10 * 0.6 < 0.5 AND (verdict NOT IN ('TRUE', 'FALSE') OR (claim_id % 20) / 20 + 0.3 >= 0.62))) AND (k % 5 = 0 OR k % 11 <> 0) AND
    CASE WHEN none AND many > 0 AND cov >= 0.99 THEN true ELSE (many = 0 OR cov >= 0.99) AND (none OR k % 4 = 0 OR ((claim_id % 9) / 9 >= 0.35 AND claim_id % 8 > 0)) AND (coalesce(parts, 0) = 0 OR NOT (lost OR loose)) AND
        CASE WHEN NOT none AND k % 6 = 0 THEN claim_id % 2 = 0 ELSE coalesce(parts, 0) > 0 AND NOT unknown END END AS allowed FROM p
""")
def f41_cache_fast_path(spark: SparkSession, d: str) -> DataFrame:
    seg = F.struct(
        worded.pick(PATH_STATUS, c("l_partkey")).alias("status"), worded.pick(PATH_REASONS, c("l_suppkey")).alias("reason"), (c("l_quantity") / 50 + 0.5).alias("predicate_match_score"),
        worded.pick(CLAIMS, c("l_orderkey")).alias("claim_segment"), worded.pick(STATEMENTS, c("l_partkey") + c("l_orderkey")).alias("supporting_fact"),
    )
    parts = read_table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("claim_id")).agg(F.collect_list(seg).alias("segments"))
    key, k = c("claim_id"), c("k")
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("claim_id"), c("o_custkey").alias("k")).join(parts, "claim_id", "left")
    trust = F.struct((k % 13 != 0).alias("is_sufficient"), F.when(k % 7 == 0, 0.9).otherwise(1.0).alias("coverage"), (k % 3).alias("num_subclaims"), (k % 3).alias("strong_covered"))
    result = F.struct(
        worded.pick(PATH_VERDICTS, k).alias("verdict"), (k % 10 / 10 * 0.6).alias("unverifiable"), (key % 20 / 20 + 0.3).alias("confidence"), F.when(k % 4 != 0, key % 9 / 9).alias("admissible_ratio"), (key % 8).alias("supports"),
        F.lit(0).alias("contradicts"), worded.pick(CLAIMS, key).alias("claim"), F.when(k % 6 == 0, key % 2 == 0).alias("required_resolved"),
    )
    context = F.when(k % 5 != 0, F.array(F.lit(False), F.lit(None).cast("boolean"), k % 11 != 0))
    return rows.withColumns({"trust": trust, "result": F.when(k % 17 != 0, result)}).select("claim_id", fastpath.allowed(c("trust"), c("result"), c("segments"), context).alias("allowed"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders)")
def s2_vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that orders name by their customers' keys, most of them more than once."""
    asked = read_table(spark, d, "orders").select(c("o_custkey").alias("vec_id"))
    return retrieval.by_ids(read_table(spark, d, "embeddings"), asked, "vec_id").select("vec_id", "label")
