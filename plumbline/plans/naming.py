"""Queries on entities that count for a claim, its predicate, and queries made of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canonical, entities, queries, search, words
from plumbline.functions.pages import NOISE
from plumbline.plans import worded
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import CLAIMS, ENTITIES, sql_pick, sql_text
from plumbline.session import by_value, read_table

c = F.col

#: More entities, some of which do not count.
MORE = (("supplements", "Adults", "vitamin"), ("zinc that helps", "and the minerals", "prevent"), (), ("common cold symptoms", "cold", "study"), ("lung", "lung cancer risk in smokers", " "), ("Blood", "liver", "system"))

TOK = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), {sql_text(words.ALPHA)})"
PHRASE = lambda e: (
    f"array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(trim(lower(coalesce({e}, ''))), '^(and|or|but)\\s+', ''), '\\b(?:that|which|who|whom|whose)\\b.*$', ''), {sql_text(words.ALPHA)}), lambda t: NOT list_contains({sql_text(NOISE)}, t))[1:4], ' ')"
)
OUT = sql_text(entities.GENERAL + entities.VERBS)
SALIENT = lambda e: f"(NOT regexp_matches({e}, '\\b(that|which|who|whom|whose)\\b') AND NOT list_contains({OUT}, {e}) AND len(list_filter({TOK(e)}, lambda t: NOT list_contains({OUT}, t))) > 0)"
POINTS = f"""
CASE WHEN regexp_matches(low, '\\b' || e || '\\b') THEN 4 ELSE 0 END + CASE WHEN list_has_any(lead, t) THEN 2 ELSE 0 END + CASE len(t) WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE -1 END
- CASE WHEN len(list_distinct(t)) = 1 AND list_contains({sql_text(entities.WEAK)}, t[1]) THEN 4 ELSE 0 END
- CASE WHEN len(list_distinct(t)) = 1 AND len(list_filter(cand, lambda o: o <> e AND list_contains({TOK('o')}, t[1]) AND len(list_distinct({TOK('o')})) > 1)) > 0 THEN 3 ELSE 0 END - CASE WHEN list_has_all({sql_text(entities.BROAD)}, t) THEN 3 ELSE 0 END
"""
NAMING = f"""
n0 AS (SELECT o_orderkey AS claim_id, {sql_pick(CLAIMS, 'o_orderkey')} AS claim, coalesce({sql_pick(ENTITIES, 'o_orderkey')}, []) || coalesce({sql_pick(ENTITIES, 'o_custkey')}, []) || {sql_pick(MORE, 'o_custkey + o_orderkey')} AS ents FROM orders),
n1 AS (SELECT *, list_transform(ents, lambda e: {PHRASE('e')}) AS ph, lower(coalesce(claim, '')) AS low, {TOK('claim')} AS ct FROM n0),
n2 AS (SELECT *, list_filter(ph, lambda e: {SALIENT('e')}) AS good, ct[1:greatest(1, len(ct) // 2)] AS lead FROM n1),
n3 AS (SELECT *, CASE WHEN len(good) > 0 THEN good ELSE list_filter(ph, lambda e: e <> '') END AS cand FROM n2),
n4 AS (SELECT *, list_sort(list_transform(list_filter(cand, lambda e: len({TOK('e')}) > 0), lambda e: list_transform([{TOK('e')}], lambda t: {{'p': -({POINTS}), 'l': -length(e), 'e': e}})[1])) AS rated FROM n3),
n5 AS (SELECT *, CASE WHEN coalesce(claim, '') = '' THEN ents[1:1] ELSE list_transform(rated[1:1], lambda r: r.e) END AS must FROM n4),
n6 AS (SELECT *, list_filter(list_transform(must, lambda e: {PHRASE('e')}), lambda e: {SALIENT('e')}) AS firsts FROM n5),
n7 AS (SELECT *, firsts || list_filter(good, lambda e, i: list_position(good, e) = i AND NOT list_contains(firsts, e) AND (len(firsts) = 0 OR list_has_any({TOK('e')}, {TOK('firsts[1]')})))[1:greatest(1, 3 - len(firsts))] AS aliases, regexp_replace(trim(low), '\\s+', ' ', 'g') AS flat FROM n6),
n8 AS (SELECT *, coalesce(list_filter(list_transform(aliases, lambda e: {PHRASE('e')}) || ph, lambda e: {SALIENT('e')})[1], '') AS subject,
    CASE WHEN regexp_matches(flat, {sql_text(entities.DENIED)}) THEN 'not ' || regexp_extract(flat, {sql_text(entities.DENIED)}, 1) WHEN regexp_matches(flat, {sql_text(entities.STATED)}) THEN regexp_extract(flat, {sql_text(entities.STATED)}, 1) ELSE regexp_extract(flat, {sql_text(entities.NAMED)}, 1) END AS predicate FROM n7),
n9 AS (SELECT *, coalesce(list_filter(ph, lambda e: e <> '' AND e <> subject AND NOT (len({TOK('subject')}) > 0 AND len({TOK('e')}) > 0 AND list_has_all({TOK('subject')}, {TOK('e')})))[1], '') AS object FROM n8)
"""


@query(f"WITH {NAMING}, t AS (SELECT *, list_filter(list_transform(ents, lambda e: trim(lower(coalesce(e, '')))), lambda e: length(e) >= 2 AND NOT list_contains({sql_text(entities.ABOUT_SOURCES)}, e)) AS tr FROM n9) SELECT claim_id, array_to_string(list_filter(tr, lambda e, i: list_position(tr, e) = i), '|') AS truth, coalesce(array_to_string(must, '|'), '') AS must_have, array_to_string(aliases, '|') AS aliases, coalesce(subject, '') AS subject, predicate, object FROM t")
def f50_f51_t15_u80_u81_u82_entities(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    key = c("o_orderkey")
    ents = F.concat(F.coalesce(worded.pick(ENTITIES, key), none), F.coalesce(worded.pick(ENTITIES, c("o_custkey")), none), worded.pick(MORE, c("o_custkey") + key))
    rows = read_table(spark, d, "orders").select(key.alias("claim_id"), worded.pick(CLAIMS, key).alias("claim"), ents.alias("ents"))
    rows = rows.withColumn("must", entities.must_have(c("claim"), c("ents"))).withColumn("aliases", entities.aliases(c("ents"), c("must")))
    target = entities.predicate_target(c("claim"), c("ents"), c("aliases"))
    return rows.select("claim_id", F.array_join(entities.truth_entities(c("ents")), "|").alias("truth"), F.array_join("must", "|").alias("must_have"), F.array_join("aliases", "|").alias("aliases"), target.alias("t")).select("claim_id", "truth", "must_have", "aliases", *[F.coalesce(c("t")[x], F.lit("")).alias(x) for x in ("subject", "predicate", "object")])


HINT = lambda p: "coalesce(" + ", ".join(
    f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN array_to_string({a} || {b}, ' ') END" for a, b in [[f"list_filter({TOK(f'regexp_extract(trim({p}), {sql_text(x)}, {g})')}, lambda w: NOT list_contains({sql_text(words.STOP)}, w))" for g in (1, 2)] for x in entities.PARTED]
) + ", '')"


@query(f"""
WITH p AS (SELECT o_orderkey AS claim_id, trim(coalesce({sql_pick(CLAIMS, 'o_orderkey')}, '')) AS claim, list_transform(range(0, o_custkey % 5), lambda i: trim(coalesce({sql_pick(CLAIMS, 'o_orderkey + i')}, ''))) AS parts FROM orders),
q AS (SELECT claim_id, list_filter([claim] || flatten(list_transform(parts[1:3], lambda s: [s, {HINT('s')}])), lambda x: x <> '') AS every FROM p)
SELECT claim_id, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') AS queries FROM q
""")
def u83_retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    key = c("o_orderkey")
    parts = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), 1, (c("o_custkey") % 5).cast("int")), lambda i: worded.pick(CLAIMS, key + i))
    return read_table(spark, d, "orders").select(key.alias("claim_id"), F.array_join(entities.retrieval_queries(worded.pick(CLAIMS, key), parts), "|").alias("queries"))


#: Parts of claims, and their topics with confidence.
TOPICAL = (("Cancer is a disease", "pathology", 0.4), ("The drug dose", "pharmacology", 0.4), ("Diet and vitamin", "nutrition", 0.4), ("Gene mutation", "genetics", 0.4), ("Nothing here", None, 0.0), (None, None, 0.0), ("Bone muscle heart organ tongue hand", "anatomy", 1.0))
PART, TOPIC, SURE = zip(*TOPICAL, strict=True)


@query(f"""
WITH p AS (SELECT o_orderkey AS claim_id, unnest(range(0, o_custkey % 3 + 1)) AS i, o_custkey AS k FROM orders),
t AS (SELECT claim_id, {sql_pick(TOPIC, 'k + i')} AS topic, ([{', '.join(f'{s}::DOUBLE' for s in SURE)}])[(k + i) % {len(SURE)} + 1] AS sure FROM p)
SELECT claim_id, coalesce(string_agg(DISTINCT topic, '|' ORDER BY topic), '') AS topics, max(sure) AS confidence FROM t GROUP BY 1
""")
def u84_claim_topics(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), 1, (c("o_custkey") % 3 + 1).cast("int")), lambda i: worded.pick(PART, c("o_custkey") + i))
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("claim_id"), parts.alias("parts"), F.lit(None).cast("array<string>").alias("entities"))
    return entities.claim_topics(rows).select("claim_id", F.array_join("topics", "|").alias("topics"), _r(c("confidence")).alias("confidence"))


#: Queries, with their negation put right, and without operators.
ASKED = (
    ("vitamin c do not cure colds", "vitamin c does not cure colds", "vitamin c do not cure colds"), ("Vaccines do not  cause autism", "Vaccines do not cause autism", "Vaccines do not cause autism"), ("zinc does not cannot help", "zinc does not help", "zinc does not help"),
    ('intitle:"zinc" filetype:pdf (cold OR flu)', 'intitle:"zinc" filetype:pdf (cold OR flu)', "cold flu"), ('"Zinc" "zinc" "iron" trial "tea"', '"Zinc" "zinc" "iron" trial "tea"', '"Zinc" "iron" trial'), ('one "half', 'one "half', "one half"), ("", "", ""), (None, "", ""),
    ("people do not do not sleep", "people do not sleep", "people do not sleep"), ("you do not", "you do not", "you do not"),
)
ASK, GRAMMAR, PLAIN = zip(*ASKED, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(GRAMMAR, 'o_orderkey')} AS grammar, {sql_pick(PLAIN, 'o_orderkey')} AS plain FROM orders")
def u95_u96_query_forms(spark: SparkSession, d: str) -> DataFrame:
    x = worded.pick(ASK, c("o_orderkey"))
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), entities.negation_grammar(x).alias("grammar"), entities.without_operators(x).alias("plain"))


# search queries of a part

TEXTS = (
    *CLAIMS, "A diet rich in whole grains is good, and noncommunicable diseases follow", "The human heart beats 100,000 times a day", "Adults have 206 bones, hands and feet 106 bones", "New cells are made every second: 3,500,000 cells",
    "Tongue prints are unique", "People should take vitamin C without risk", "High levels low in iron is bad bad bad iron",
)
NOT = lambda *lists: sql_text(tuple(dict.fromkeys(w for a in lists for w in a)))
LESS = lambda items, out: f"list_filter({items}, lambda w: NOT list_contains({out}, w))"
UNIQUE = lambda x: f"list_filter({x}, lambda u, k: list_position({x}, u) = k)"
QUOTED = lambda a: f"CASE WHEN contains({a}, ' ') THEN '\"' || {a} || '\"' ELSE {a} END"
CLEANED = lambda q: f"array_to_string(list_transform([string_split({q}, ' ')], lambda p: list_filter(p, lambda t, k: k = 1 OR lower(t) <> lower(p[k - 1]))[1:18])[1], ' ')"
S, A, J, D = search.NO_KEY, search.ACTION, search.JUNK, queries.NO_ANCHOR
TAIL = "(?: (?:" + "|".join(A) + "))+$"
PARTS = f"""
p0 AS (SELECT o_orderkey AS id, {sql_pick(TEXTS, 'o_orderkey')} AS part, coalesce({sql_pick(ENTITIES, 'o_custkey')}, []) AS ents FROM orders),
p1 AS (SELECT id, lower(coalesce(part, '')) AS low, ents, {TOK('part')} AS tk, {TOK("array_to_string(ents, ' ')")} AS et FROM p0),
p2 AS (SELECT *, {LESS('tk', NOT(S, A))} AS telling, {LESS('tk', NOT(S, A, J, D))} AS own, {LESS('tk', NOT(S, A, J))} AS dt, regexp_extract_all(low, {sql_text(search.NUMBER)}) AS nums0,
    list_filter(list_transform(regexp_extract_all(low, {sql_text(queries.DIETARY)}), lambda p: regexp_replace(array_to_string({TOK('p')}, ' '), {sql_text(TAIL)}, '')), lambda p: len(string_split(p, ' ')) >= 3) || list_transform(regexp_extract_all(low, {sql_text(queries.CHRONIC)}), lambda p: array_to_string({TOK('p')}, ' ')) AS special FROM p1),
p3 AS (SELECT *, {UNIQUE('nums0')} AS nums, list_filter(list_transform(range(1, len(telling)), lambda i: telling[i] || ' ' || telling[i + 1]), lambda p: length(p) >= 8) AS pairs,
    list_transform(list_sort(list_transform({UNIQUE('own')}, lambda w: {{'n': -len(list_filter(own, lambda x: x = w)), 'l': -length(w), 'w': w}}))[1:8], lambda r: r.w) AS single,
    list_transform(list_filter(list_transform(ents, lambda e: {LESS(TOK('e'), NOT(S, J, D))}), lambda e: list_has_any(e, own)), lambda e: array_to_string(e, ' ')) AS named,
    list_transform(list_sort(list_transform({UNIQUE('dt')}, lambda w: {{'s': -(2.0 * len(list_filter(dt, lambda x: x = w)) + least(1.0, length(w) / 8.0) + CASE WHEN list_contains(et, w) THEN 1.0 ELSE 0.0 END), 'w': w}})), lambda r: r.w) AS best FROM p2),
p4 AS (SELECT *, special || pairs AS ph0, special || list_filter(list_transform(ents, lambda e: array_to_string({TOK('e')}, ' ')), lambda e: contains(e, ' ')) || pairs AS phe0, nums[1:3] || list_transform(nums, lambda n: replace(n, ',', ''))[1:3] || best AS dq0 FROM p3),
p5 AS (SELECT *, {UNIQUE('ph0')}[1:4] AS ph, {UNIQUE('phe0')}[1:4] AS phe, array_to_string({UNIQUE('dq0')}[1:8], ' ') AS direct FROM p4),
p6 AS (SELECT *, list_filter(ph || named || single, lambda a: a <> '' AND NOT list_has_any({TOK('a')}, {NOT(D)})) || nums AS an0, list_filter(ph || single, lambda a: a <> '' AND NOT list_has_any({TOK('a')}, {NOT(D)})) || nums AS pl0,
    CASE WHEN regexp_matches(low, {sql_text(queries.FIGURES)}) THEN {sql_text(queries.ENDS['figures'])} WHEN regexp_matches(low, {sql_text(queries.CAUSAL)}) AND regexp_matches(low, {sql_text(queries.DENIAL)}) THEN {sql_text(queries.ENDS['denied'])}
        WHEN regexp_matches(low, {sql_text(queries.CAUSAL)}) THEN {sql_text(queries.ENDS['causal'])} WHEN regexp_matches(low, {sql_text(queries.ADVICE)}) THEN {sql_text(queries.ENDS['advice'])} ELSE {sql_text(queries.ENDS['other'])} END AS ends FROM p5),
p7 AS (SELECT *, {UNIQUE('an0')}[1:10] AS an, {UNIQUE('pl0')}[1:10] AS pl FROM p6),
p8 AS (SELECT *, list_transform(list_sort(list_transform(an, lambda a: {{'s': -(CASE WHEN regexp_matches(a, '\\d') THEN 4.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(a, ' ') THEN 1.2 ELSE 0.0 END::DOUBLE + least(2.0, length(a) / 6) - CASE WHEN list_contains({NOT(queries.VAGUE)}, a) THEN 2.0 ELSE 0.0 END::DOUBLE), 'a': a}})), lambda r: r.a) AS ranked FROM p7),
p9 AS (SELECT *, list_filter(ranked, lambda a: contains(a, ' ') AND NOT regexp_matches(a, '\\d'))[1:2] AS w2, list_filter(ranked, lambda a: NOT contains(a, ' ') AND NOT regexp_matches(a, '\\d'))[1:3] AS s3, list_filter(ranked, lambda a: regexp_matches(a, '\\d'))[1:2] AS n2,
    list_transform(list_filter(pl, lambda a: contains(a, ' ') AND NOT regexp_matches(a, '\\d'))[1:2], lambda a: {QUOTED('a')}) || list_filter(pl, lambda a: NOT contains(a, ' ') AND NOT regexp_matches(a, '\\d'))[1:3] || list_filter(pl, lambda a: regexp_matches(a, '\\d'))[1:1] AS pcore FROM p8),
p10 AS (SELECT *, list_transform(w2, lambda a: {QUOTED('a')}) || list_filter(s3, lambda t: NOT list_contains(flatten(list_transform(w2, lambda a: {TOK('a')})), t)) || n2 AS c0 FROM p9),
p11 AS (SELECT *, c0 || list_transform(ranked, lambda a: {QUOTED('a')}) AS c1 FROM p10),
p12 AS (SELECT *, CASE WHEN len(c0) < 2 THEN {UNIQUE('c1')}[1:2] ELSE c0 END AS core FROM p11),
p13 AS (SELECT *, list_transform(list_transform(ends, lambda e: array_to_string(core, ' ') || ' ' || e) || ['site:pubmed.ncbi.nlm.nih.gov ' || array_to_string(core, ' ') || ' ' || ends[1]], lambda q: {CLEANED('q')}) AS aq0, list_transform(ends[1:2], lambda e: {CLEANED("array_to_string(pcore[1:6], ' ') || ' ' || e")}) AS pq0 FROM p12)
"""


@query(f"WITH {PARTS} SELECT id, array_to_string(phe, '|') AS phrases, array_to_string(an, '|') AS anchors, direct, array_to_string(ends, '|') AS ends, CASE WHEN len(core) > 0 THEN array_to_string({UNIQUE('aq0')}, '|') ELSE '' END AS anchored, CASE WHEN len(pcore) > 0 THEN array_to_string({UNIQUE('pq0')}, '|') ELSE '' END AS plain FROM p13")
def f52_u99_u100_u101_u104_u109_part_queries(spark: SparkSession, d: str) -> DataFrame:
    text, ents = c("text"), c("ents")
    made = {
        "phrases": queries.phrases(text, ents), "anchors": queries.part_anchors(text, ents), "ends": queries.ends(text), "anchored": queries.anchor_queries(text, ents), "plain": queries.plain_queries(text),
    }
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), worded.pick(TEXTS, c("o_orderkey")).alias("text"), worded.pick(ENTITIES, c("o_custkey")).alias("ents"))
    asked = by_value(rows, ["text", "ents"], lambda texts: texts.select("*", queries.direct_query(text, ents).alias("direct"), *[F.array_join(v, "|").alias(k) for k, v in made.items()]))
    return asked.drop("text", "ents")


#: Texts and the questions that they ask.
SPOKEN = (
    ("Adults have 206 bones, hands and feet 106", "how many bones are in adult human hands and feet|how many bones are in the hands and feet|how many bones does an adult human have"), ("a broken bone", "how many bones does a human have"),
    ("The heart beats daily", "how many times does the human heart beat per day"), ("The heart beats", ""), ("new cells each second", "how many new cells does the human body produce per second"),
    ("tongue print", "are tongue prints unique|unique tongue prints individuals"), ("", ""), (None, ""), ("bone foot", "how many bones are in adult human hands and feet|how many bones are in the hands and feet|how many bones does a human have"),
)
SAYS, ASKS = zip(*SPOKEN, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(ASKS, 'o_orderkey')} AS questions FROM orders")
def u102_question_queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.array_join(queries.question_queries(worded.pick(SAYS, c("o_orderkey"))), "|").alias("questions"))


#: Parts of claims, and what they are merged to.
FRAGMENTS = (
    (("Vaccines do not cause autism", "or the flu"), "Vaccines do not cause autism|Vaccines do not cause the flu"), (("Zinc helps, ", "and sleep"), "Zinc helps and sleep"), (("Zinc helps", "and the flu vaccine"), "Zinc helps|and the flu vaccine"),
    (("and first", None, " ", "But iron helps adults with severe anemia daily"), "and first|But iron helps adults with severe anemia daily"), ((), ""), (None, ""), (("Tea", "and cold", "or hot", "Coffee"), "Tea and cold or hot|Coffee"),
)
PIECES, MERGED = zip(*FRAGMENTS, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(MERGED, 'o_orderkey')} AS parts FROM orders")
def u93_merged_parts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.array_join(queries.merged_parts(worded.pick(PIECES, c("o_orderkey"))), "|").alias("parts"))


# parts of claims taken to pieces

SAID = (
    *CLAIMS, "Handwashing is the primary recommendation of the WHO guidelines.", "A daily walk is recommended by doctors", "Rest is advised by the  NHS", "The CDC recommends two doses over 6 months: ", "My doctor advises tea",
    "Children should take 25 mg of zinc daily", "Exercise never causes harm", "Tea has been linked to sleep in 3 weeks", "5 % versus 10 percent", ". : ;", "Vitamin C can't cure; it may help women",
)
CLEAR = lambda x: f"regexp_replace(regexp_replace(trim(coalesce({x}, '')), '\\s+', ' ', 'g'), '^[ .,:;]+|[ .,:;]+$', '', 'g')"
GROUP = lambda x, p, g: f"regexp_extract({x}, {sql_text(p)}, {g})"
AUTHORITY = lambda x: f"trim(regexp_replace(trim(regexp_replace({CLEAR(x)}, '(?i)^(?:the\\s+)?', '')), '(?i)\\s+(?:guidelines?|guidance|recommendations?)$', ''))"
RULES = canonical.RECOMMENDED
AUTHORITIES = ", ".join(f"{AUTHORITY(GROUP('t', p, who))} AS a{i}, {CLEAR(GROUP('t', p, what))} AS o{i}" for i, (p, who, what, _) in enumerate(RULES))
BY_RULE = lambda value, rest: "CASE " + " ".join(f"WHEN a{i} <> '' AND o{i} <> '' THEN {value(i)}" for i in range(len(RULES))) + f" ELSE {rest} END"
WORTH = " + ".join(f"CASE WHEN {n} <> '' THEN {w}::DOUBLE ELSE 0 END" for n, w in canonical.WORTH)


@query(f"""
WITH c0 AS (SELECT o_orderkey AS id, {CLEAR(sql_pick(SAID, 'o_orderkey'))} AS t FROM orders), c1 AS (SELECT *, {AUTHORITIES} FROM c0),
c2 AS (SELECT id, t, {BY_RULE(lambda i: f'a{i}', CLEAR(GROUP('t', canonical.SPLIT, 1)))} AS s0, {BY_RULE(lambda i: f"'{RULES[i][3]}'", CLEAR(GROUP('t', canonical.SPLIT, 2)))} AS predicate, {BY_RULE(lambda i: f'o{i}', CLEAR(GROUP('t', canonical.SPLIT, 3)))} AS object, {BY_RULE(lambda i: "'recommendation'", "''")} AS predicate_family FROM c1),
c3 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(s0, '(?i)\\b(?:never|not|no|none|without)\\b\\s*$', '')), '(?i)\\b(?:has|have|had|is|are|was|were)\\b\\s*$', '')) AS s1 FROM c2),
c4 AS (SELECT id, t AS original_text, CASE WHEN s1 <> '' THEN s1 ELSE {CLEAR("array_to_string(regexp_extract_all(t, '\\b[a-zA-Z][a-zA-Z\\-]{2,}\\b')[1:4], ' ')")} END AS subject, predicate, object, predicate_family, CASE WHEN regexp_matches(t, {sql_text(canonical.NEGATION)}) THEN 'negative' ELSE 'positive' END AS polarity,
    CASE WHEN regexp_matches(t, {sql_text(canonical.ABSOLUTE)}) THEN 'absolute' WHEN regexp_matches(t, {sql_text(canonical.PROBABLE)}) THEN 'probabilistic' ELSE '' END AS quantifier, {CLEAR(GROUP('t', canonical.COMPARATOR, 1))} AS comparator, {GROUP('t', canonical.NUMERIC, 1)} AS numeric_value,
    {CLEAR(GROUP('t', canonical.NUMERIC, 2))} AS unit, {CLEAR(GROUP('t', canonical.POPULATION, 0))} AS population, {CLEAR(GROUP('t', canonical.TIMEFRAME, 0))} AS timeframe, {CLEAR(GROUP('t', canonical.MODALITY, 1))} AS modality FROM c3),
c5 AS (SELECT *, {CLEAR("concat_ws(' ', nullif(subject, ''), nullif(predicate, ''), nullif(object, ''))")} AS joined FROM c4)
SELECT * EXCLUDE (joined), CASE WHEN joined <> '' THEN joined ELSE original_text END AS normalized_text, round(greatest(0.05, least(0.99, 0.30::DOUBLE + {WORTH})), 9)::DOUBLE AS parse_confidence FROM c5
""")
def u42_parsed_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), canonical.parsed(worded.pick(SAID, c("o_orderkey"))).alias("p")).select("id", "p.*")
    return rows.withColumn("parse_confidence", F.round("parse_confidence", 9))


HYPHENED = ("Low-fat meal-plans for human adults and incidence 12 13 14", "non-drinker", None, "Human-like robots", "The self-care guideline for an adult") + CLAIMS
RESEARCH = PARTS.replace(sql_text(TEXTS), sql_text(HYPHENED)).replace(f"% {len(TEXTS)} + 1", f"% {len(HYPHENED)} + 1")
OTHER = "CASE WHEN contains(v, ' ') THEN v WHEN NOT suffix(v, 's') THEN v || 's' WHEN length(v) > 3 THEN left(v, length(v) - 1) ELSE v END"


@query(f"""
WITH {RESEARCH}, r0 AS (SELECT *, phe[1] AS v FROM p13), r1 AS (SELECT *, [v, {OTHER}, replace(v, '-', ' ')] AS vs0 FROM r0), r2 AS (SELECT *, {UNIQUE('vs0')} AS vs FROM r1),
r3 AS (SELECT id, CASE WHEN v IS NOT NULL AND len(vs) > 1 THEN ['(' || array_to_string(list_transform(vs, lambda x: '"' || x || '"'), ' OR ') || ')'] ELSE [] END || list_transform(phe[1:2], lambda x: '"' || x || '"') || nums[1:2]
    || [CASE {' '.join(f"WHEN contains(low, '{k}') THEN '{k}'" for k in queries.KINDS)} ELSE 'statistics' END] || (CASE WHEN contains(low, 'adult') THEN ['-fetal', '-pediatric'] ELSE [] END || CASE WHEN contains(low, 'human') THEN ['-veterinary'] ELSE [] END)[1:2] AS parts FROM r2),
r4 AS (SELECT id, array_to_string(parts, ' ') AS q FROM r3)
SELECT id, q || '|' || q || ' filetype:pdf' || '|' || 'intitle:"meta-analysis" ' || q AS queries FROM r4
""")
def u103_operator_queries(spark: SparkSession, d: str) -> DataFrame:
    text, ents = worded.pick(HYPHENED, c("o_orderkey")), worded.pick(ENTITIES, c("o_custkey"))
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.array_join(queries.operator_queries(text, ents), "|").alias("queries"))
