"""Queries on facts out of pages, triples and their facts, search results and queries, and state that follows from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import search, words
from plumbline.operators import extraction, state
from plumbline.operators.ingest import NEGATION
from plumbline.plans import worded
from plumbline.plans.registry import _r, query
from plumbline.plans.searching import OBJECTS, SUBJECTS, VERBS
from plumbline.plans.worded import CLAIMS_SQL, EVIDENCE_SQL, s_any, s_has, s_low, s_set, s_shared, sql_pick, sql_text
from plumbline.session import read_table

#: Statements that the page texts are made of, beside worded.STATEMENTS.
MORE = (
    "Smoking increases the risk of lung cancer; vaccines do not cause autism", "Does zinc reduce colds?", "Vitamin D may prevent fractures in older adults.", "In 2019 some 12 adults and 24 children took zinc and 30 took none.",
    "The hands and feet have 106 bones and 54 joints", "It is believed that garlic lowers cholesterol.", "Iron *treats* anemia... in `most` patients", "Short.",
)
EVERY = (*worded.STATEMENTS, *MORE)
MUST = tuple(e[:1] if e and i % 3 == 0 else () for i, e in enumerate(worded.ENTITIES))
TOKS = lambda x: s_set(s_low(x), words.ALPHA, words.STOP)
NAMES = lambda a: s_set(f"lower(array_to_string(coalesce({a}, []), ' | '))", words.ALPHA, words.STOP)
FAMS = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {s_has(x, p)} THEN '{n}' END" for n, p in extraction.FAMILIES) + "], lambda f: f IS NOT NULL)"
CLEANED = lambda x: f"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), '[*_`#~]', '', 'g'), '\\.{{2,}}', '.', 'g'))"
GROUNDED = lambda x: f"(length(trim(coalesce({x}, ''))) >= 10 AND NOT contains({s_low(x)}, '?') AND NOT {s_has(x, extraction.HEDGED)} AND NOT {s_has(x, extraction.HEARSAY)})"
FACT_ID = lambda s, u: f"'f_' || left(sha256(rtrim(lower(coalesce({u}, '')), '/') || '|' || trim(regexp_replace(lower(coalesce({s}, '')), '\\s+', ' ', 'g'))), 16)"
PROFILE = f"pf AS (SELECT o_orderkey AS claim_id, {sql_pick(worded.CLAIMS, 'o_orderkey')} AS claim, {sql_pick(worded.ENTITIES, 'o_orderkey')} AS entities, {sql_pick(MUST, 'o_orderkey')} AS must FROM orders), pr AS (SELECT *, {TOKS('claim')} AS ct, {NAMES('entities')} AS et, {NAMES('must')} AS mt, {FAMS('claim')} AS cf, {s_has('claim', extraction.NEGATED)} AS cneg FROM pf)"


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    return worded.claims(spark, d).withColumn("must_have", worded.pick(MUST, F.col("claim_id")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read_table(spark, d, "lineitem").select(c("l_orderkey").alias("claim_id"), worded.sequence().alias("seq"), worded.pick(EVERY, c("l_partkey") + 3 * c("l_orderkey")).alias("statement"), worded.pick(worded.URLS, c("l_suppkey")).alias("source_url"))


LINES = f"ln AS (SELECT l_orderkey AS claim_id, {worded.SEQUENCE_SQL} AS seq, {sql_pick(EVERY, 'l_partkey + 3 * l_orderkey')} AS statement, {sql_pick(worded.URLS, 'l_suppkey')} AS source_url FROM lineitem)"


@query(f"""
WITH {LINES}, a AS (SELECT *, {CLEANED('statement')} AS cs FROM ln), b AS (SELECT *, list_filter(list_transform(string_split(cs, ';'), lambda p: trim(p)), lambda p: p <> '') AS by_semi, len(regexp_extract_all(cs, {sql_text(extraction.NUMBER)})) AS nums FROM a),
p AS (SELECT claim_id, seq, source_url, unnest(CASE WHEN cs = '' THEN []::VARCHAR[] WHEN len(by_semi) > 1 THEN by_semi WHEN nums >= 2 AND contains(lower(cs), ' and ') AND NOT contains(lower(cs), 'hands and feet') THEN list_filter(list_transform(string_split_regex(cs, '(?i)\\band\\b'), lambda x: trim(x)), lambda x: x <> '') ELSE [cs] END) AS part FROM b)
SELECT claim_id, seq, {CLEANED('part')} AS statement, {FACT_ID(CLEANED('part'), 'source_url')} AS fact_id, {GROUNDED(CLEANED('part'))} AS grounded FROM p WHERE length(part) >= 10 AND NOT {s_any('part', words.LOW_SIGNAL)}
""")
def f20_f21_u67_u68_atomic_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.atomic_facts(_lines(spark, d))
    return rows.select("claim_id", "seq", "statement", "fact_id", extraction.grounded(F.col("statement")).alias("grounded"))


PAGES = f"pg AS (SELECT claim_id, 'https://p' || claim_id || '.example' AS url, string_agg(statement || '. ', '' ORDER BY seq) AS content FROM (SELECT * REPLACE (coalesce(statement, '') AS statement) FROM ln) GROUP BY 1)"


@query(f"""
WITH {LINES}, {PAGES}, {PROFILE}, s0 AS (SELECT claim_id, url, list_transform(list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 10), lambda s: {CLEANED('s')}) AS ss FROM pg),
s1 AS (SELECT claim_id, url, unnest(ss[:280]) AS statement, unnest(range(0, len(ss[:280]))) AS place FROM s0), s2 AS (SELECT s1.*, pr.* EXCLUDE (claim_id), {TOKS('statement')} AS tok, {FAMS('statement')} AS sf FROM s1 JOIN pr USING (claim_id) WHERE {GROUNDED('statement')}),
s3 AS (SELECT *, {s_shared('tok', 'ct')} AS lex, CASE WHEN len(mt) > 0 THEN {s_shared('tok', 'mt')} ELSE {s_shared('tok', 'et')} END AS named, list_has_any(sf, cf) AS fam, CASE WHEN len(mt) > 0 THEN len(mt) ELSE len(et) END AS n_ask FROM s2),
s4 AS (SELECT *, round(0.5 * least(1.0, lex / greatest(1, len(ct))) + 0.3 * least(1.0, named / greatest(1, n_ask)) + 0.2 * fam::INT, 9) AS score, {s_has('statement', extraction.NEGATED)} AS neg FROM s3 WHERE len(tok) > 0 AND (lex > 0 OR named > 0 OR fam) AND NOT (len(mt) > 0 AND named = 0 AND lex < 2))
SELECT claim_id, place, statement, round(score, 6)::DOUBLE AS score, CASE WHEN cneg <> neg THEN 'REFUTES' WHEN NOT neg AND score >= 0.35 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS stance, {FACT_ID('statement', 'url')} AS fact_id FROM s4 WHERE score >= 0.16
""")
def u71_u73_sentence_facts(spark: SparkSession, d: str) -> DataFrame:
    texts = _lines(spark, d).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.coalesce("statement", F.lit("")), F.lit(". ")).alias("s")))).alias("x"))
    pages = texts.select("claim_id", F.concat(F.lit("https://p"), "claim_id", F.lit(".example")).alias("url"), F.array_join("x.s", "").alias("content"))
    return extraction.sentence_facts(pages, _profiled(spark, d)).select("claim_id", F.col("place").cast("long").alias("place"), "statement", _r(F.col("score")).alias("score"), "stance", "fact_id")


STRONG = lambda tok, sets: f"(len(list_filter(list_transform(coalesce({sets}, []), lambda a: list_distinct(list_filter(regexp_extract_all(lower(coalesce(a, '')), {sql_text(words.ALPHA)}), lambda w: NOT list_contains({sql_text(words.STOP)}, w)))), lambda t: len(t) > 0 AND NOT (len(t) = 1 AND list_contains(['health', 'healthy', 'immune', 'immunity', 'vitamin', 'supplement', 'supplements', 'disease', 'condition'], t[1])) AND len(list_intersect({tok}, t)) >= greatest(1, len(t) - 1))) > 0)"


@query(f"""
WITH {LINES}, {PROFILE}, a AS (SELECT seq, statement, pr.*, {TOKS('statement')} AS tok, {FAMS('statement')} AS sf FROM ln JOIN pr USING (claim_id)),
b AS (SELECT *, {s_shared('tok', 'ct')} AS n, list_has_any(tok, mt) AS m, list_has_any(tok, et) AS e FROM a WHERE len(tok) > 0),
k AS (SELECT *, CASE WHEN len(mt) > 0 THEN m OR {STRONG('tok', 'must')} WHEN len(et) > 0 THEN e OR {STRONG('tok', 'entities')} ELSE true END AND (len(ct) = 0 OR n > 0) AND (len(cf) = 0 OR list_has_any(sf, cf) OR ((m OR e) AND n >= 2)) AS inn, (len(mt) = 0 OR m) AND (len(ct) = 0 OR n >= 2) AS back FROM b)
SELECT claim_id, seq FROM (SELECT *, bool_or(inn) OVER (PARTITION BY claim_id) AS any_in FROM k) WHERE CASE WHEN any_in THEN inn ELSE back END
""")
def f22_admissible_facts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.admissible_facts(_lines(spark, d), _profiled(spark, d)).select("claim_id", "seq")


ALIGN = f"""
tr AS (SELECT claim_id, seq, statement, {sql_pick(SUBJECTS, 'seq // 100000')} AS subject, {sql_pick(VERBS, 'seq // 100000')} AS relation, {sql_pick(OBJECTS, 'seq // 100000')} AS object, row_number() OVER (PARTITION BY claim_id ORDER BY seq) - 1 AS idx FROM ln),
ta AS (SELECT t.claim_id, t.seq, t.idx, f.idx AS i, {TOKS('f.statement')} AS own, {TOKS('t.subject')} AS s, {TOKS('t.object')} AS o, {TOKS('t.relation')} AS r FROM tr t JOIN tr f USING (claim_id)),
tb AS (SELECT *, list_distinct(list_concat(s, o)) AS ends FROM ta),
tc AS (SELECT *, round(CASE WHEN len(own) = 0 OR (len(ends) = 0 AND len(r) = 0) THEN 0 ELSE least(1, 0.75 * CASE WHEN len(ends) > 0 THEN len(list_intersect(own, ends)) / len(ends) ELSE 0 END + 0.25 * CASE WHEN len(r) > 0 THEN len(list_intersect(own, r)) / len(r) ELSE 0 END
    + CASE WHEN len(s) > 0 AND len(list_intersect(own, s)) >= greatest(1, CASE WHEN len(s) = 1 THEN 1 ELSE len(s) - 1 END) THEN 0.12 ELSE 0 END + CASE WHEN len(o) > 0 AND len(list_intersect(own, o)) >= greatest(1, CASE WHEN len(o) = 1 THEN 1 ELSE len(o) - 1 END) THEN 0.12 ELSE 0 END) END, 9) AS al FROM tb)
"""


@query(f"""
WITH {LINES}, {ALIGN}, g AS (SELECT claim_id, seq, any_value(idx) AS idx, max(al) FILTER (i = idx) AS given, max(al) AS top, arg_min(i, (-al, i)) AS top_i FROM tc GROUP BY 1, 2)
SELECT claim_id, seq, CASE WHEN given >= 0.35 THEN idx WHEN top >= 0.45 THEN top_i ELSE -1 END AS resolved FROM g
""")
def u75_u76_j14_resolved_triples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = F.col
    rows = _lines(spark, d).withColumn("fact_index", F.row_number().over(Window.partitionBy("claim_id").orderBy("seq")) - 1).withColumnRenamed("claim_id", "batch")
    place = F.floor(c("seq") / 100000)
    triples = rows.select("batch", c("seq").alias("triple_id"), "fact_index", worded.pick(SUBJECTS, place).alias("subject"), worded.pick(VERBS, place).alias("relation"), worded.pick(OBJECTS, place).alias("object"))
    out = extraction.resolved_triples(triples, rows.select("batch", "fact_index", "statement"))
    return out.select(c("batch").alias("claim_id"), c("triple_id").alias("seq"), c("resolved").cast("long").alias("resolved"))


RELATIONS = ("causes", "contributes to", "associated_with", "is linked_to", "increase risk", "treats", "induces", "leads to", None)
DENIED = " OR ".join(f"regexp_matches({s_low('statement')}, {sql_text(p)})" for p in NEGATION)


@query(f"""
WITH {LINES}, r AS (SELECT claim_id, seq, statement, {sql_pick(RELATIONS, 'seq // 100')} AS relation, trim(replace(lower(coalesce({sql_pick(RELATIONS, 'seq // 100')}, '')), '_', ' ')) AS rel FROM ln)
SELECT claim_id, seq, CASE WHEN ({' OR '.join(f"contains(rel, {sql_text(m)})" for m in extraction.CAUSAL_MARKS)}) AND ({DENIED}) THEN CASE {' '.join(f"WHEN contains(rel, {sql_text(m)}) THEN {sql_text(n)}" for m, n in extraction.DENIALS)} END ELSE relation END AS relation FROM r
""")
def f24_u117_u118_negation_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("relation", worded.pick(RELATIONS, F.floor(F.col("seq") / 100)))
    return rows.select("claim_id", "seq", extraction.negation_guard(F.col("statement"), F.col("relation")).alias("relation"))


@query("""
WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS x FROM documents), c AS (SELECT *, CASE WHEN x = '' THEN 0 WHEN length(x) <= 600 THEN 1 ELSE least(6, ceil((length(x) - 600) / 500)::INT + 1) END AS n FROM t)
SELECT doc_id, i::INT AS i, trim(substr(x, i * 500 + 1, 600)) AS chunk FROM (SELECT doc_id, x, n, unnest(range(0, n)) AS i FROM c) WHERE trim(substr(x, i * 500 + 1, 600)) <> ''
""")
def u66_content_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.posexplode(extraction.content_chunks(F.col("text"), 600, 6)).alias("i", "chunk"))
    return rows


# search

POINTS = {n: " + ".join(["0.0", *[f"contains({s_low('claim')}, {sql_text(k)})::INT" for k in search.KEYWORDS.get(n, ())], *[f"CASE WHEN {s_has('claim', p)} THEN {w} ELSE 0 END" for of, p, w in search.STRONG if of == n]]) for n in search.PRIORITY}


@query(f"""
WITH {CLAIMS_SQL}, p AS (SELECT claim_id, claim, {', '.join(f'round({v}, 6) AS {n}' for n, v in POINTS.items())} FROM c), q AS (SELECT *, greatest({', '.join(POINTS)}) AS best FROM p)
SELECT claim_id, CASE WHEN best = 0 THEN CASE WHEN {s_has('claim', r'\bhow many\b|\bnumber of\b|\brate of\b')} THEN 'STATISTICAL' ELSE 'GENERAL' END {' '.join(f"WHEN {n} = best THEN '{n}'" for n in POINTS)} END AS claim_class, array_to_string(list_sort({s_set(s_low('claim'), words.ALPHA, tuple(dict.fromkeys((*search.NO_KEY, *search.ACTION, *search.JUNK))))}), ' ') AS key_terms,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({s_low('claim')}, {sql_text(search.NUMBER)}), lambda n: replace(n, ',', '')))), ' ') AS key_numbers FROM q
""")
def u88_u97_u98_claim_class(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim")
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    return worded.claims(spark, d).select("claim_id", search.claim_class(c).alias("claim_class"), joined(search.key_terms(c)).alias("key_terms"), joined(search.key_numbers(c)).alias("key_numbers"))


#: Search results: addresses, what they lead to, why they are not read.
RESULTS = (
    ("https://www.cdc.gov/flu/index.html", "https://www.cdc.gov/flu/index.html", None), ("https://www.google.com/url?sa=t&q=https%3A%2F%2Fwho.int%2Fnews%2Fzinc&x=1", "https://who.int/news/zinc", None), ("", "", "empty_url"), (None, "", "empty_url"),
    ("data:text/html,abc", "data:text/html,abc", "data_text_scheme"), ("https://nih.gov/view?pano=3", "https://nih.gov/view?pano=3", "pano_param"), ("https://nih.gov/QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=/", "https://nih.gov/QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=/", "base64_blob"),
    ("https://nih.gov/a/references", "https://nih.gov/a/references", "low_signal_pattern"), ("https://nih.gov/a?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=1&k=2&l=3&m=4", "https://nih.gov/a?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=1&k=2&l=3&m=4", "querystring_too_long"),
    ("https://nih.gov/a?utm_source=x&gclid=2", "https://nih.gov/a?utm_source=x&gclid=2", "tracking_only"), ("https://nih.gov/search/", "https://nih.gov/search/", "site_shell_page"), (" https://blog.example/Manual.pdf ", "https://blog.example/Manual.pdf", None), ("https://google.com/url?x=1", "https://google.com/url?x=1", None),
)
ADDRESSES, TARGETS, REASONS = zip(*RESULTS, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(TARGETS, 'o_orderkey')} AS target, {sql_pick(REASONS, 'o_orderkey')} AS reason FROM orders")
def f31_f32_u10_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    target = search.unwrapped(worded.pick(ADDRESSES, F.col("o_orderkey")))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), target.alias("target"), search.reject_reason(target, F.lit(""), F.lit(None).cast("string")).alias("reason"))


TRUSTED = "regexp_matches(lower(target), '^https?://(www[.])?(cdc[.]gov|who[.]int|nih[.]gov)(/|$)')"


@query(f"""
WITH r AS (SELECT o_custkey % 20 AS provider, {sql_pick(TARGETS, 'o_orderkey')} AS target, {sql_pick(REASONS, 'o_orderkey')} AS reason FROM orders)
SELECT provider, count(*) FILTER (target <> '' AND NOT {TRUSTED}) AS rejected_allowlist, count(*) FILTER ({TRUSTED} AND reason IS NOT NULL) AS rejected_quality, count(*) FILTER ({TRUSTED} AND reason IS NULL) AS trusted FROM r GROUP BY 1
""")
def f30_f33_trusted_urls(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.functions import domains

    c = F.col
    target = search.unwrapped(worded.pick(ADDRESSES, c("o_orderkey")))
    rows = read_table(spark, d, "orders").select((c("o_custkey") % 20).alias("provider"), target.alias("t"), domains.is_trusted(target).alias("ok"), search.reject_reason(target, F.lit(""), F.lit("")).alias("why"))
    return rows.groupBy("provider").agg(F.count_if((c("t") != "") & ~c("ok")).alias("rejected_allowlist"), F.count_if(c("ok") & c("why").isNotNull()).alias("rejected_quality"), F.count_if(c("ok") & c("why").isNull()).alias("trusted"))


TEXT = "lower(concat_ws(' ', coalesce(statement, ''), coalesce(claim, ''), coalesce(source_url, '')))"
TYPED = " OR ".join(f"({sql_pick(search.PRIORITY, 'claim_id')} = '{n}' AND ({' OR '.join(f'contains(tx, {sql_text(k)})' for k in keys)}))" for n, keys in search.KEYWORDS.items())


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, a AS (SELECT claim_id, seq, source_url, c.entities, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS place, {TEXT} AS tx FROM ev JOIN c USING (claim_id)),
b AS (SELECT *, len(list_filter(coalesce(entities, []), lambda e: coalesce(e, '') <> '' AND contains(tx, lower(e)))) > 0 AS m, ({TYPED}) AS ty, regexp_matches(lower(coalesce(source_url, '')), '^https?://(www[.])?(cdc[.]gov|pubmed[.]ncbi[.]nlm[.]nih[.]gov|cochrane[.]org|who[.]int|sub[.]nhs[.]uk)(:|/|$)') AS tr, {' OR '.join(f"contains(tx, '{x}')" for x in search.LOW_TEXTS)} AS lo FROM a),
g AS (SELECT *, 1.5 * m::INT + 1.0 * ty::INT + 0.75 * tr::INT - 1.0 * lo::INT AS score FROM b), h AS (SELECT *, score >= 1.5 AND (m OR ty) AS passed FROM g),
n AS (SELECT *, CASE WHEN cnt >= 2 THEN 3 WHEN cnt = 1 THEN 5 ELSE 8 END AS top_n FROM (SELECT *, count(*) FILTER (place <= 3 AND passed) OVER (PARTITION BY claim_id) AS cnt FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, coalesce(source_url, ''), seq) AS rank FROM n WHERE place <= 8)
SELECT claim_id, seq, score::DOUBLE AS score, passed, rank FROM o WHERE rank <= top_n
""")
def f36_t11_t12_selected_results(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.lists import selected_results

    c = F.col
    rows = worded.evidence(spark, d).drop("entities").join(worded.claims(spark, d), "claim_id")
    gate = search.quality_gate(worded.pick(search.PRIORITY, c("claim_id")), c("entities"), c("source_url"), c("statement"), c("claim"))
    return selected_results(rows.withColumn("gate", gate), "claim_id", "seq", "source_url").select("claim_id", "seq", c("gate.score").alias("score"), c("gate.passed").alias("passed"), "rank")


QUERIES = ("zinc reduces common cold", "new medical research on your body", "zinc", "Lung cancer rates medical evidence", "206 bones in adults", "vitamin d fractures", "  ", None, '"zinc "cold" cold', "do not do not treat treat flu", "coffee coffee tea not not helps")


@query(f"""
WITH {CLAIMS_SQL}, a AS (SELECT claim_id, entities, {sql_pick(QUERIES, 'claim_id // 3')} AS q FROM c), b AS (SELECT *, regexp_extract_all({s_low('q')}, {sql_text(words.ALPHA)}) AS tok, list_transform(coalesce(entities, []), lambda e: array_to_string(regexp_extract_all(lower(coalesce(e, '')), {sql_text(words.ALPHA)}), ' ')) AS nm FROM a),
h AS (SELECT *, len(list_filter(nm, lambda n: n <> '' AND ((contains(n, ' ') AND contains({s_low('q')}, n)) OR list_contains(tok, n)))) AS hits, len(list_filter(tok, lambda t: list_contains({sql_text(search.JUNK)}, t))) AS junk FROM b)
SELECT claim_id, hits AS anchor_hits, junk AS junk_hits, len(tok) AS token_count, junk <= 1 AND len(tok) >= 3 AND (len(nm) = 0 OR hits > 0) AS passed,
    {sql_pick(('zinc reduces common cold', 'new medical research on your body', 'zinc', 'Lung cancer rates medical evidence', '206 bones in adults', 'vitamin d fractures', '', '', 'zinc cold', 'do not treat flu', 'coffee tea not helps'), 'claim_id // 3')} AS sanitized FROM h
""")
def f37_f38_u94_query_quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.claims(spark, d).withColumn("q", worded.pick(QUERIES, F.floor(c("claim_id") / 3)))
    s = rows.select("claim_id", search.query_quality(c("q"), c("entities")).alias("s"), search.sanitized(c("q")).alias("sanitized"))
    return s.select("claim_id", *[c(f"s.{x}").cast("long").alias(x) for x in ("anchor_hits", "junk_hits", "token_count")], "s.passed", "sanitized")


LISTED = tuple(QUERIES[i : i + 4] for i in range(0, 8, 4))


@query(f"""
WITH {CLAIMS_SQL}, a AS (SELECT claim_id, {s_set(s_low('claim'), words.ALPHA, tuple(dict.fromkeys((*search.NO_KEY, *search.ACTION, *search.JUNK))))} AS kt, list_transform(regexp_extract_all({s_low('claim')}, {sql_text(search.NUMBER)}), lambda n: replace(n, ',', '')) AS kn, {sql_pick(LISTED, 'claim_id')} AS qs FROM c),
b AS (SELECT *, list_filter(list_transform(qs, lambda q: trim(lower(coalesce(q, '')))), lambda q: q <> '') AS q1 FROM a)
SELECT claim_id, array_to_string(list_filter(q1, lambda q: NOT ({' OR '.join(f"ends_with(q, '{e}')" for e in search.GENERIC_ENDS)}) AND (len(list_filter(kn, lambda n: contains(replace(q, ',', ''), n))) > 0 OR len(list_filter(kt, lambda t: regexp_matches(q, '\\b' || t || '\\b'))) > 0)), '|') AS kept FROM b
""")
def f39_f40_kept_queries(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim")
    return worded.claims(spark, d).select("claim_id", F.array_join(search.kept_queries(worded.pick(LISTED, F.col("claim_id")), search.term_marks(search.key_terms(c), search.key_numbers(c))), "|").alias("kept"))


# state that follows from events

def _domain_events(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kind = F.when(c("event_type").isin("error", "view"), "failure").when(c("event_type") == "purchase", "success").otherwise("cooldown")
    at = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    return read_table(spark, d, "events").select("event_id", F.concat(F.lit("m"), F.pmod("user_id", F.lit(50))).alias("domain"), at.alias("at"), kind.alias("kind"), (c("value") * 40).alias("seconds"))


@query("""
WITH e AS (SELECT event_id, 'm' || user_id % 50 AS domain, epoch_us(ts) / 1000000::DOUBLE AS t, CASE WHEN event_type IN ('error', 'view') THEN 'failure' WHEN event_type = 'purchase' THEN 'success' ELSE 'cooldown' END AS kind, value * 40 AS seconds FROM events),
a AS (SELECT *, count(*) FILTER (kind = 'success') OVER (PARTITION BY domain ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM e),
b AS (SELECT *, lag(t) OVER (PARTITION BY domain, life ORDER BY t, event_id) AS before FROM a), c AS (SELECT *, kind = 'failure' AND (before IS NULL OR t - before > 900) AS fresh FROM b),
d AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY domain, life ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT *, CASE WHEN kind = 'success' THEN 0 ELSE count(*) FILTER (kind = 'failure') OVER (PARTITION BY domain, life, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) END AS failures FROM d),
g AS (SELECT *, CASE WHEN kind = 'cooldown' THEN t + seconds WHEN kind = 'failure' AND failures >= 2 THEN t + 900 END AS until FROM f),
h AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY domain, life ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS last_until FROM g)
SELECT event_id, domain, failures, round(CASE WHEN kind = 'success' THEN 0 ELSE coalesce(last_until, 0) END, 3)::DOUBLE AS blocked_until FROM h
""")
def st5_st6_st7_f54_domain_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = state.domain_blocks(_domain_events(spark, d), ["at", "event_id"])
    return rows.select("event_id", "domain", "failures", F.round("blocked_until", 3).alias("blocked_until"))


@query("""
WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'SAFETY' WHEN event_type = 'click' THEN 'MYTH' ELSE 'GENERAL' END AS claim_type, ['pdf', 'manual', 'policy', 'handbook', 'template', 'brochure', 'procurement', NULL][event_id % 8 + 1] AS token FROM events), g AS (SELECT claim_type, token, count(*) AS n FROM r WHERE token IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY n DESC, token) AS rank FROM g
""")
def st4_drift_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    marks = ("pdf", "manual", "policy", "handbook", "template", "brochure", "procurement", "")
    kind = F.when(c("event_type") == "error", " safety").when(c("event_type") == "click", "MYTH").otherwise("unknown")
    said = worded.pick(marks, c("event_id"))
    rows = read_table(spark, d, "events").select(kind.alias("claim_type"), F.when(said == "pdf", "https://a.example/x.PDF?y=1").otherwise("https://a.example/x").alias("url"), F.when(said != "pdf", F.concat(F.lit("A "), said)).alias("title"), F.lit(None).cast("string").alias("snippet"))
    return state.drift_kept(state.drift_counts(rows))
