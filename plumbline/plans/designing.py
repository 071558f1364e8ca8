"""Queries on what a claim asks of a search: slots, plans, and all queries of a claim's parts, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import design, queries, search, words
from plumbline.operators import state
from plumbline.plans import worded
from plumbline.plans.extracting import POINTS
from plumbline.plans.naming import CLEANED, ENTITIES, NOT, OTHER, PARTS, TEXTS, TOK, UNIQUE
from plumbline.plans.registry import query
from plumbline.plans.worded import s_ascii, s_has, s_low, s_set, sql_pick, sql_text
from plumbline.session import read_table

c = F.col
#: Claims with comparisons, outcomes, people and phrases.
ASKED = (
    *worded.CLAIMS, "Vaccines are safer than the disease in older adults and children", "Tea versus coffee for sleep, instead of pills", "No two fingerprints are identical; tongue prints are unique", 'The "Low-Fat diet" reduces the risk of heart attack or stroke in men',
    "There are more bacteria in the mouth than people on earth", "It is a myth that sugar causes hyperactivity because of insulin", "How many people sleep", "The rate of anemia in pregnant women is 40 percent", "Adults, adults & ADULTS", "x",
)
SPACED = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
PHRASE = lambda x: SPACED(f"regexp_replace({SPACED(f'lower({x})')}, '[^a-z0-9\\-\\s]', '', 'g')")
PHRASES = lambda xs: f"list_filter(list_transform({xs}, lambda x: {PHRASE('x')}), lambda x: x <> '')"
TAKE = lambda p, g: f"regexp_extract_all(m, {sql_text(p)}, {g})"
FORMS = "list_filter([CASE WHEN length(a) <= 3 THEN NULL WHEN ends_with(a, 's') THEN left(a, length(a) - 1) ELSE a || 's' END, CASE WHEN contains(a, '-') THEN replace(a, '-', ' ') END, CASE WHEN contains(a, ' ') THEN a END], lambda x: x IS NOT NULL)"

SLOTS = f"""
s0 AS (SELECT o_orderkey AS id, {sql_pick(ASKED, 'o_orderkey')} AS claim0 FROM orders UNION ALL SELECT -item_id, text FROM benchmark UNION ALL SELECT -1000000 - 1000 * conv_id - turn, text FROM conversations),
s1 AS (SELECT id, {SPACED("coalesce(claim0, '')")} AS t FROM s0), s2 AS (SELECT *, lower(t) AS low, {s_ascii('t')} AS m FROM s1),
s3 AS (SELECT *, {TAKE(design.COMPARED[1], 1)} AS ga, {TAKE(design.COMPARED[1], 2)} AS gb, list_filter(list_transform({TAKE(design.WORD, 0)}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({sql_text(design.STOP)}, w) AND NOT list_contains({sql_text(design.NO_TOPIC)}, w)) AS own FROM s2),
s4 AS (SELECT *, {PHRASES(f"{TAKE(design.COMPARED[0], 1)} || flatten(list_transform(range(1, len(ga) + 1), lambda i: [ga[i], gb[i]]))")} AS c0,
    list_filter({PHRASES(f"list_transform({TAKE(design.OUTCOMES[0], 1)} || {TAKE(design.OUTCOMES[1], 1)}, lambda r: regexp_replace(r, {sql_text(design.OUTCOME_ENDS)}, ''))")}, lambda x: len(string_split(x, ' ')) <= 8) AS o0,
    list_filter({sql_text(design.POPULATION)}, lambda p: contains(low, p)) AS people, {PHRASES("regexp_extract_all(t, '\"([^\"]+)\"', 1)")} || [x for x in [{', '.join(f"CASE WHEN contains(low, '{k}') THEN '{p}' END" for k, p in design.WHOLE)}] if x IS NOT NULL]
    || list_transform(list_sort(list_transform({UNIQUE('own')}, lambda w: {{'n': -len(list_filter(own, lambda x: x = w)), 'l': -length(w), 'w': w}}))[1:8], lambda r: r.w) AS t0 FROM s3),
s5 AS (SELECT *, {UNIQUE('c0')} AS comparator, {UNIQUE('o0')} AS outcome, list_filter(t0, lambda u, k: list_position(t0, u) = k AND NOT list_contains({sql_text(design.STOP)}, u)) AS topic FROM s4),
s6 AS (SELECT *, topic || outcome || comparator || people AS a0 FROM s5), s7 AS (SELECT *, {UNIQUE('a0')} AS an FROM s6),
s8 AS (SELECT *, list_transform(an, lambda a: {{'k': a, 'v': {FORMS}}}) AS sy0 FROM s7)
"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(claim_id, claim): claims in words, passages, and turns of conversations."""
    orders, passages, turns = (read_table(spark, d, t) for t in ("orders", "benchmark", "conversations"))
    out = orders.select(c("o_orderkey").alias("claim_id"), worded.pick(ASKED, c("o_orderkey")).alias("claim"))
    return out.union(passages.select(-c("item_id"), "text")).union(turns.select(-1000000 - 1000 * c("conv_id") - c("turn"), "text"))


@query(f"""
WITH {SLOTS} SELECT id AS claim_id, array_to_string(topic[1:6], '|') AS topic, array_to_string(outcome[1:4], '|') AS outcome, array_to_string(people[1:4], '|') AS population, array_to_string(comparator[1:3], '|') AS comparator, array_to_string(an[1:10], '|') AS anchors,
    array_to_string(list_transform(list_filter(sy0, lambda x: len(x.v) > 0), lambda x: x.k || '=' || array_to_string(list_filter(x.v, lambda u, k: list_position(x.v, u) = k), ',')), '|') AS synonyms FROM s8
""")
def u89_u92_claim_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d).select("claim_id", design.slots(c("claim")).alias("s"))
    forms = F.transform(c("s.synonyms"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["values"], ",")))
    return rows.select("claim_id", *[F.array_join(c("s")[n], "|").alias(n) for n in ("topic", "outcome", "population", "comparator", "anchors")], F.array_join(forms, "|").alias("synonyms"))


TYPED = f"CASE WHEN best = 0 THEN CASE WHEN {s_has('claim', r'\bhow many\b|\bnumber of\b|\brate of\b')} THEN 'STATISTICAL' ELSE 'GENERAL' END {' '.join(f"WHEN {n} = best THEN '{n}'" for n in POINTS)} END"
SITE = {n: search.trusted_routes(n)[: design.ROUTED] for n in design.HINTS}


def _typed(values: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in values.items()) + " END"


def _spec(template: str, goal: str, weight: float) -> str:
    text = "'" + template.replace("{p}", "' || p || '").replace("{s}", "' || s || '").replace("{h}", "' || h || '").replace("{f}", "' || f || '") + "'"
    return f"{{'q': trim({SPACED(text)} || tail), 'goal': {sql_text(goal)}, 'weight': {weight}::DOUBLE}}"


BACKUPS = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(_spec(*b) for b in listed)}]" for k, listed in design.BACKUPS.items()) + " ELSE [] END"
ROUTED = ", ".join(_spec("site:' || " + _typed({n: r[i] for n, r in SITE.items()}) + " || ' {p} {h}", f"trusted routing {i + 1}", max(0.70, 0.90 - i * 0.05)) for i in range(design.ROUTED))
NEGATIVES = "CASE kind " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in design.NEGATIVE_OF.items()) + " END"


@query(f"""
WITH {SLOTS}, u AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'SAFETY' WHEN event_type = 'click' THEN 'MYTH' ELSE 'GENERAL' END AS kind, ['pdf', 'manual', 'policy', 'handbook', 'template', 'brochure', 'procurement', NULL][event_id % 8 + 1] AS token FROM events),
dr AS (SELECT kind, list(token) AS tokens FROM u WHERE token IS NOT NULL GROUP BY 1), k0 AS (SELECT *, m AS claim FROM s7), k1 AS (SELECT *, {', '.join(f'round({v}, 6) AS {n}' for n, v in POINTS.items())} FROM k0), k2 AS (SELECT *, greatest({', '.join(POINTS)}) AS best FROM k1), k3 AS (SELECT id, t, low, an, {TYPED} AS kind FROM k2),
k4 AS (SELECT k3.*, list_sort(list_distinct({sql_text(design.NEGATIVE)} || {NEGATIVES} || coalesce(tokens, [])))[1:16] AS neg, CASE WHEN len(an) > 0 THEN an[1:10] ELSE [{PHRASE('t')}] END AS a FROM k3 LEFT JOIN dr USING (kind)),
k5 AS (SELECT *, array_to_string(list_transform(neg[1:8], lambda x: ' -' || x), '') AS tail, coalesce(list_filter(a, lambda x: contains(x, ' ') AND contains(low, x))[1], a[1]) AS p, {_typed({n: v[0] for n, v in design.HINTS.items()})} AS h, {_typed({n: v[1] for n, v in design.HINTS.items()})} AS f FROM k4),
k6 AS (SELECT *, coalesce(list_filter(a, lambda x: x <> p)[1], p) AS s FROM k5), k7 AS (SELECT *, [{', '.join(_spec(*x) for x in design.PLAN)}, {ROUTED}] || {BACKUPS} AS e0 FROM k6), k8 AS (SELECT *, list_transform(e0, lambda x: lower({SPACED('x.q')})) AS fd FROM k7),
k9 AS (SELECT *, list_filter(e0, lambda x, i: list_position(fd, fd[i]) = i)[1:8] AS e FROM k8), ka AS (SELECT id, kind, neg, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS place FROM k9)
SELECT id AS claim_id, kind AS claim_type, array_to_string(neg, ' ') AS negatives, place::INTEGER AS place, x.q AS q, x.goal AS goal, x.weight AS weight FROM ka
""")
def u90_u91_query_plans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(c("event_type") == "error", " safety").when(c("event_type") == "click", "MYTH").otherwise("unknown")
    said = worded.pick(("pdf", "manual", "policy", "handbook", "template", "brochure", "procurement", ""), c("event_id"))
    poor = read_table(spark, d, "events").select(kind.alias("claim_type"), F.when(said == "pdf", "https://a.example/x.PDF").otherwise("https://a.example/x").alias("url"), said.alias("title"), F.lit(None).cast("string").alias("snippet"))
    plans = design.query_plans(_asked(spark, d), state.drift_kept(state.drift_counts(poor)))
    rows = plans.select("claim_id", "claim_type", F.array_join("negatives", " ").alias("negatives"), F.posexplode("plan").alias("at", "x"))
    return rows.select("claim_id", "claim_type", "negatives", (c("at") + 1).alias("place"), "x.q", "x.goal", "x.weight")


# all queries of a claim: a customer's orders are the parts of a claim

WHOLE = "array_to_string(list_transform(parts0, lambda x: coalesce(x, '')), '. ')"
FOLD = lambda a: f"array_to_string({TOK(a)}, ' ')"
GOOD = lambda q: (
    f"(len(list_filter({TOK(q)}, lambda t: list_contains({sql_text(search.JUNK)}, t))) <= 1 AND len({TOK(q)}) >= 3 AND (len(an) = 0 OR len(list_filter(an, lambda a: {FOLD('a')} <> '' AND ((contains({FOLD('a')}, ' ') AND contains(lower({q}), {FOLD('a')})) OR list_contains({TOK(q)}, {FOLD('a')})))) > 0))"
)
QUESTION = ", ".join("CASE WHEN " + " AND ".join([*(f"list_has_any(tk, {sql_text(g)})" for g in groups), *([f"NOT list_has_any(tk, {sql_text(none)})"] if none else [])]) + f" THEN {sql_text(q)} END" for q, groups, none in queries.QUESTIONS)
TIDY = lambda q: f"CASE WHEN length({q}) - length(replace({q}, '\"', '')) IN (1, 3, 5, 7, 9) THEN {CLEANED(f'''replace({q}, chr(34), '')''')} ELSE {CLEANED(q)} END"
MARKED = lambda q: f"' ' || regexp_replace(lower({q}), '([^a-z0-9_])', ' \\1 ', 'g') || ' '"
HAS = lambda x: f"(len(list_filter(kn, lambda n: contains({x}.d, n))) > 0 OR len(list_filter(kt, lambda t: contains({x}.s, t))) > 0)"
HELD = lambda xs, form: f"list_transform({xs}, lambda q: {{'q': {form}, 's': {MARKED('q')}, 'd': replace(lower(q), ',', '')}})"


def s_fits(name: str, source: str, lists: dict[str, str]) -> str:
    """CTEs that add to ``source`` each list folded, without what names no term or ends in a stock phrase, each query once; the last is ``name``."""
    stock = " OR ".join(f"ends_with(x.q, '{e}')" for e in search.GENERIC_ENDS)
    made = ", ".join(f"list_transform(list_filter({HELD(v, 'trim(lower(q))')}, lambda x: x.q <> '' AND NOT ({stock}) AND {HAS('x')}), lambda x: x.q) AS {k}_" for k, v in lists.items())
    return f"{name}0 AS (SELECT *, {made} FROM {source}), {name} AS (SELECT * EXCLUDE ({', '.join(k + '_' for k in lists)}), {', '.join(f'{UNIQUE(k + chr(95))} AS {k}' for k in lists)} FROM {name}0)"


KEYS = tuple(dict.fromkeys((*search.NO_KEY, *search.ACTION, *search.JUNK)))

SEARCHES = f"""
w0 AS (SELECT o_custkey AS claim_id, list({sql_pick(TEXTS, 'o_orderkey')} ORDER BY o_orderkey) AS parts0, coalesce({sql_pick(ENTITIES, 'o_custkey')}, []) AS ents FROM orders GROUP BY o_custkey),
w1 AS (SELECT *, {WHOLE} AS claim FROM w0), p0 AS (SELECT o_orderkey AS id, trim({sql_pick(TEXTS, 'o_orderkey')}) AS part, coalesce({sql_pick(ENTITIES, 'o_custkey')}, []) AS ents FROM orders WHERE trim(coalesce({sql_pick(TEXTS, 'o_orderkey')}, '')) <> '' UNION ALL SELECT -1 - claim_id, claim, [] FROM w1),
{PARTS[PARTS.index('p1 AS'):]},
r0 AS (SELECT *, phe[1] AS v FROM p13), r1 AS (SELECT *, [v, {OTHER}, replace(v, '-', ' ')] AS vs0 FROM r0), r2 AS (SELECT *, {UNIQUE('vs0')} AS vs FROM r1),
r3 AS (SELECT *, CASE WHEN v IS NOT NULL AND len(vs) > 1 THEN ['(' || array_to_string(list_transform(vs, lambda x: '"' || x || '"'), ' OR ') || ')'] ELSE [] END || list_transform(phe[1:2], lambda x: '"' || x || '"') || nums[1:2]
    || [CASE {' '.join(f"WHEN contains(low, '{k}') THEN '{k}'" for k in queries.KINDS)} ELSE 'statistics' END] || (CASE WHEN contains(low, 'adult') THEN ['-fetal', '-pediatric'] ELSE [] END || CASE WHEN contains(low, 'human') THEN ['-veterinary'] ELSE [] END)[1:2] AS rp FROM r2),
r4 AS (SELECT *, array_to_string(rp, ' ') AS rq, CASE WHEN len(core) > 0 THEN {UNIQUE('aq0')} ELSE [] END AS aq, CASE WHEN len(pcore) > 0 THEN {UNIQUE('pq0')} ELSE [] END AS pq, list_filter([{QUESTION}], lambda q: q IS NOT NULL)[1:1] AS qq FROM r3),
r5 AS (SELECT id, pq, list_filter(aq, lambda q: {GOOD('q')}) AS aq, list_filter([rq, rq || ' filetype:pdf', 'intitle:"meta-analysis" ' || rq], lambda q: {GOOD('q')}) AS oq, list_filter([direct], lambda q: q <> '' AND {GOOD('q')}) AS dq, list_filter(qq, lambda q: {GOOD('q')}) AS qq FROM r4),
r6 AS (SELECT *, list_transform((aq || dq || qq)[1:1], lambda q: {TIDY('q')}) AS need FROM r5),
h0 AS (SELECT o_custkey AS claim_id, flatten(list(aq ORDER BY id)) AS aq, flatten(list(dq ORDER BY id)) AS dq, flatten(list(oq ORDER BY id)) AS oq, flatten(list(qq ORDER BY id)) AS qq, flatten(list(need ORDER BY id)) AS need FROM r6 JOIN orders ON id = o_orderkey GROUP BY 1),
h1 AS (SELECT w1.claim_id, claim, coalesce(aq, []) AS aq, coalesce(dq, []) AS dq, coalesce(oq, []) AS oq, coalesce(qq, []) AS qq, coalesce(need, []) AS need, pq, CASE WHEN len(ents) > 0 THEN [coalesce(ents[1], '') || ' trial results', 'unheard words'] ELSE [] END AS told,
    list_transform({s_set(s_low("claim || ' ' || array_to_string(ents, ' ')"), words.ALPHA, KEYS)}, lambda t: {MARKED('t')}) AS kt, list_distinct(list_transform(regexp_extract_all({s_low('claim')}, {sql_text(search.NUMBER)}), lambda n: replace(n, ',', ''))) AS kn
    FROM w1 LEFT JOIN h0 USING (claim_id) LEFT JOIN (SELECT -1 - id AS claim_id, pq FROM r5 WHERE id < 0) USING (claim_id)),
{s_fits('h2', 'h1', {'aqf': 'aq', 'dqf': 'dq', 'oqf': 'oq', 'qqf': 'qq', 'pqf': 'coalesce(pq, [])', 'tof': f"list_transform(told, lambda q: {TIDY('q')})"})},
h3 AS (SELECT *, CASE WHEN len(list_distinct(aqf || dqf || oqf || pqf)) < 6 THEN tof ELSE [] END AS tol FROM h2), h4 AS (SELECT *, aqf[1:1] || dqf[1:1] || tol[1:1] || oqf[1:1] AS b0 FROM h3), h4b AS (SELECT *, {UNIQUE('b0')} AS bu FROM h4),
h5 AS (SELECT *, flatten(list_transform(bu, lambda b: list_transform({sql_text(tuple(search.trusted_sites()[:4]))}, lambda s: 'site:' || s || ' ' || b))) AS sq FROM h4b), h6 AS (SELECT *, aqf || dqf || oqf || pqf || tol || qqf || sq AS all0 FROM h5), h6b AS (SELECT *, {UNIQUE('all0')} AS all1 FROM h6),
h6c AS (SELECT *, list_transform(all1, lambda q: {TIDY('q')}) AS all2 FROM h6b), {s_fits('h7a', 'h6c', {'oth': 'all2'})},
h7b AS (SELECT *, list_transform(list_filter({HELD('need', 'q')}, lambda x: x.q <> '' AND {HAS('x')}), lambda x: x.q) AS req0 FROM h7a), h7 AS (SELECT *, {UNIQUE('req0')} AS req FROM h7b)
"""


@query(f"WITH {SEARCHES} SELECT claim_id, array_to_string(req, '|') AS required, array_to_string((req || list_filter(oth, lambda q: NOT list_contains(req, q)))[1:6], '|') AS queries FROM h7")
def u106_search_queries(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "orders").select(c("o_custkey").alias("claim_id"), c("o_orderkey").alias("at"), worded.pick(TEXTS, c("o_orderkey")).alias("part"))
    held = parts.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("parts")).withColumn("entities", worded.pick(ENTITIES, c("claim_id")))
    claim = F.array_join(F.transform("parts", lambda x: F.coalesce(x, F.lit(""))), ". ")
    told = F.when(F.size("entities") > 0, F.array(F.concat(F.coalesce(c("entities")[0], F.lit("")), F.lit(" trial results")), F.lit("unheard words")))
    out = design.search_queries(held.withColumns({"claim": claim, "told": told}), 6, "told")
    return out.select("claim_id", F.array_join("required", "|").alias("required"), F.array_join("queries", "|").alias("queries"))
