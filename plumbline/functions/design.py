"""What a claim asks of a search: its slots, a weighted plan of queries, and all queries of its parts within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import queries, search, words
from plumbline.functions.once import once
from plumbline.session import by_value, written

#: Words that are no topic, and people that claims speak of.
STOP = (
    "the", "a", "an", "and", "or", "but", "to", "for", "of", "in", "on", "with", "by", "at", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "has", "have", "had",
    "does", "do", "did", "as", "it", "its", "their", "there", "into", "from", "about", "up", "down", "than",
)
POPULATION = (
    "adults", "adult", "children", "child", "babies", "baby", "infants", "infant", "newborns", "newborn", "pregnant", "women", "men", "elderly", "older adults", "patients", "humans", "people", "teens", "adolescents", "everyone",
)
#: Words, what a claim is compared with, what comes of it, and where that ends.
WORD = r"\b[a-zA-Z][a-zA-Z0-9\-]{1,}\b"
COMPARED = (r"(?i)\b(?:vs\.?|versus|compared to|instead of|in addition to)\s+([a-zA-Z0-9\-\s]{2,60})", r"(?i)\b([a-zA-Z0-9\-\s]{2,40})\s+\bthan\b\s+([a-zA-Z0-9\-\s]{2,40})")
OUTCOMES = (
    r"(?i)\b(?:reduce|reduces|prevent|prevents|improve|improves|increase|increases|cause|causes|cure|cures|reverses)\s+([a-zA-Z0-9\-\s]{2,70})",
    r"(?i)\b(?:risk of|rate of|odds of|associated with)\s+([a-zA-Z0-9\-\s]{2,70})",
)
OUTCOME_ENDS = r"\b(?:and|or|but|because)\b.*$"
#: Phrases that are topics as a whole, each with what a claim holds.
WHOLE = (("tongue print", "tongue print"), ("fingerprint", "fingerprints"), ("heart attack", "heart attack"))
#: What no query asks for, at all and by claim type.
NEGATIVE = ("reddit", "quora", "facebook", "pinterest", "youtube")
NEGATIVE_OF = {
    "EFFICACY": ("testimonial", "opinion"), "SAFETY": ("promo", "advertisement"), "STATISTICAL": ("lottery",), "NUMERIC_COMPARISON": ("lottery", "gambling"), "MECHANISM": ("astrology", "spiritual"), "MYTH": ("satire",),
    "UNIQUENESS": ("username", "logo", "tattoo", "wallpaper"), "GENERAL": (),
}
#: What queries of a claim type end in, at first and as a fallback.
HINTS = {
    "EFFICACY": ("randomized trial evidence review", "systematic review meta-analysis"), "SAFETY": ("adverse effects safety evidence", "risk profile cohort"), "STATISTICAL": ("statistics prevalence incidence", "population rate registry"),
    "NUMERIC_COMPARISON": ("estimated count comparison population statistics", "human population estimate comparative magnitude"), "MECHANISM": ("mechanism pathway biological", "causal pathway physiology"), "MYTH": ("evidence fact check", "debunk"),
    "UNIQUENESS": ("uniqueness individuality identification", "forensic biometrics"), "GENERAL": ("evidence study", "review"),
}
#: Backups of a claim type, with goal and weight; {p} and {s} are the first and the second anchor.
BACKUPS = {
    "STATISTICAL": (("{p} incidence prevalence proportion percentage", "stats backup", 0.82),),
    "NUMERIC_COMPARISON": (("{p} {s} estimated count comparison world population", "numeric comparison backup", 0.84), ('"{p}" "{s}" oral microbiome estimated oral bacteria human population comparison', "numeric comparison oral microbiome backup", 0.83)),
    "MYTH": (("{p} debunk evidence fact check", "myth backup", 0.82),),
    "UNIQUENESS": (("{p} biometrics individuality forensic study", "uniqueness backup", 0.82),),
}
#: The queries of every plan, in their order; {h} and {f} are the type's hint and fallback.
PLAN = (
    ('"{p}" {h}', "primary evidence (quoted)", 1.0), ("{p} {h}", "primary evidence (unquoted)", 0.97), ('"{p}" "{s}" {h}', "dual-anchor (quoted)", 0.95), ("{p} {s} {h}", "dual-anchor (unquoted)", 0.92), ("{p} {s} {f}", "lexical fallback", 0.85),
)
ROUTED, LEAST_QUERIES, MOST_QUERIES, PADDING = 4, 6, 8, 0.65
#: Words of claim types and people, which are no topic.
NO_TOPIC = tuple(sorted({w for k in (*(key for keys in search.KEYWORDS.values() for key in keys), *POPULATION) for w in k.replace("-", " ").split()} | set(POPULATION)))
#: What a text's queries end in where no other reformulation is at hand, and those of entities that were not found.
FALLBACK_ENDS, ENTITY_ENDS = ("medical evidence", "scientific research", "clinical verification", "factual analysis"), ("medical evidence", "health research", "scientific facts")


def _none() -> Column:
    return F.array().cast("array<string>")


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def phrase(x: Column) -> Column:
    """Lower-case letters, digits and hyphens of ASCII with single spaces."""
    return _spaced(F.regexp_replace(_spaced(F.lower(x)), r"[^a-z0-9\-\s]", ""))


def _phrases(x: Column) -> Column:
    return F.filter(F.transform(x, phrase), lambda p: p != "")


def slots(claim: Column) -> Column:
    """A struct of what a claim is about: topic, outcome, population, comparator, and anchors made of all, with their other forms."""
    text = _spaced(claim)

    def found(t: Column) -> Column:
        take = lambda pattern, g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
        than = F.flatten(F.zip_with(take(COMPARED[1], 1), take(COMPARED[1], 2), lambda a, b: F.array(a, b)))
        comparator = F.array_distinct(_phrases(F.concat(take(COMPARED[0], 1), than)))
        raw = F.concat(*[take(p, 1) for p in OUTCOMES])
        outcome = F.array_distinct(F.filter(_phrases(F.transform(raw, lambda r: F.regexp_replace(r, OUTCOME_ENDS, ""))), lambda p: F.size(F.split(p, " ")) <= 8))
        people = F.array_compact(F.array(*[F.when(F.contains(F.lower(t), F.lit(p)), F.lit(p)) for p in POPULATION]))
        whole = F.array_compact(F.array(*[F.when(F.contains(F.lower(t), F.lit(mark)), F.lit(p)) for mark, p in WHOLE]))
        own = F.filter(F.transform(take(WORD, 0), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*STOP) & ~w.isin(*NO_TOPIC))
        ranked = once(own, lambda o: F.transform(F.array_sort(F.transform(F.array_distinct(o), lambda w: F.struct((-F.size(F.filter(o, lambda x: x == w))).alias("n"), (-F.length(w)).alias("l"), w.alias("w")))), lambda r: r["w"]))
        topic = F.array_distinct(F.filter(F.concat(_phrases(take('"([^"]+)"', 1)), whole, F.slice(ranked, 1, 8)), lambda p: ~p.isin(*STOP)))
        return F.struct(topic.alias("t"), outcome.alias("o"), people.alias("p"), comparator.alias("c"))

    def filled(s: Column) -> Column:
        anchors = F.array_distinct(F.concat(s["t"], s["o"], s["c"], s["p"]))
        return F.struct(
            F.slice(s["t"], 1, 6).alias("topic"), F.slice(s["o"], 1, 4).alias("outcome"), F.slice(s["p"], 1, 4).alias("population"), F.slice(s["c"], 1, 3).alias("comparator"), F.slice(anchors, 1, 10).alias("anchors"),
            synonyms(anchors).alias("synonyms"),
        )

    return once(once(text, found), filled)


def synonyms(anchors: Column) -> Column:
    """(key, values) of anchors that have other forms: the other number, hyphens as spaces, and for several words themselves."""

    def forms(a: Column) -> Column:
        number = F.when(a.endswith("s") & (F.length(a) > 3), F.left(a, F.length(a) - 1)).when(~a.endswith("s") & (F.length(a) > 3), F.concat(a, F.lit("s")))
        made = F.array(number, F.when(F.contains(a, F.lit("-")), F.replace(a, F.lit("-"), F.lit(" "))), F.when(F.contains(a, F.lit(" ")), a))
        return F.struct(a.alias("key"), F.array_distinct(F.array_compact(made)).alias("values"))

    return F.filter(F.transform(anchors, forms), lambda x: F.size(x["values"]) > 0)


def negatives(kind: Column, drift: Column | None = None, most: int = 16) -> Column:
    """What queries of a claim type leave out, sorted: always, by type, and the marks of poor results met before."""
    by_type = _none()
    for name, listed in NEGATIVE_OF.items():
        by_type = F.when(kind == name, F.array(*[F.lit(x) for x in listed]).cast("array<string>")).otherwise(by_type)
    every = F.concat(F.array(*[F.lit(x) for x in NEGATIVE]), by_type, *([] if drift is None else [F.coalesce(drift, _none())]))
    return F.slice(F.array_sort(F.array_distinct(every)), 1, most)


def _by_type(kind: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def _filled(template: str, values: dict[str, Column]) -> Column:
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def query_plan(claim: Column, kind: Column, entities: Column, without: Column) -> Column:
    """Six to eight queries of a claim, as structs of q, goal and weight: its first two anchors with the type's words, trusted sites, and the type's backups.

    entities is the struct of slots(), without the array of negatives(); the
    first eight of these are left out by every query.
    """
    made = F.transform(without, lambda n: F.regexp_replace(F.lower(n), r"[^a-z0-9\-]", ""))
    tail = F.array_join(F.transform(F.filter(F.slice(made, 1, 8), lambda n: n != ""), lambda n: F.concat(F.lit(" -"), n)), "")
    anchors = F.when(F.size(entities["anchors"]) > 0, entities["anchors"]).otherwise(F.array(phrase(claim)))

    def planned(x: Column) -> Column:
        first = F.coalesce(F.get(F.filter(x["a"], lambda a: F.contains(a, F.lit(" ")) & F.contains(F.lower(x["claim"]), a)), F.lit(0)), F.get(x["a"], F.lit(0)))
        second = F.coalesce(F.get(F.filter(x["a"], lambda a: a != first), F.lit(0)), first)
        hint, fallback = (_by_type(kind, {k: v[i] for k, v in HINTS.items()}, other) for i, other in enumerate(("evidence", "study")))
        values = {"p": first, "s": second, "h": hint, "f": fallback}
        spec = lambda q, goal, weight: F.struct(F.trim(F.concat(_spaced(q), x["tail"])).alias("q"), F.lit(goal).alias("goal"), F.lit(weight).alias("weight"))
        candidates = [spec(_filled(t, values), goal, weight) for t, goal, weight in PLAN]
        routes = {name: search.trusted_routes(name)[:ROUTED] for name in HINTS}
        for i in range(ROUTED):
            site = _by_type(kind, {n: r[i] for n, r in routes.items() if len(r) > i}, routes["GENERAL"][i])
            candidates.append(spec(F.concat(F.lit("site:"), site, F.lit(" "), first, F.lit(" "), hint), f"trusted routing {i + 1}", max(0.70, 0.90 - i * 0.05)))
        backups = F.array().cast("array<struct<q:string,goal:string,weight:double>>")
        for name, listed in BACKUPS.items():
            backups = F.when(kind == name, F.array(*[spec(_filled(t, values), goal, weight) for t, goal, weight in listed])).otherwise(backups)
        padding = spec(_filled("{p} {s}", values), "padding fallback", PADDING)
        return F.struct(F.concat(F.array(*candidates), backups).alias("every"), padding.alias("padding"))

    def kept(x: Column) -> Column:
        folded = lambda q: F.lower(_spaced(q["q"]))
        once_each = F.filter(x["every"], lambda q, i: ~F.exists(F.slice(x["every"], 1, i), lambda o: folded(o) == folded(q)))
        padded = lambda e: F.when((F.size(e) < LEAST_QUERIES) & ~F.exists(e, lambda o: folded(o) == folded(x["padding"])), F.concat(e, F.array(x["padding"]))).otherwise(e)
        return once(F.slice(once_each, 1, MOST_QUERIES), padded)

    start = F.struct(_spaced(claim).alias("claim"), anchors.alias("a"), tail.alias("tail"))
    return once(once(start, planned), kept)


def query_plans(claims: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """claims (claim_id, claim, ..) with claim_type, entities, negatives and plan.

    drift: (claim_type, token, n) of drift_counts(), a row for each type and
    token, at most 48 of each of eight types: small enough to be broadcast.
    """

    def planned(texts: DataFrame) -> DataFrame:
        # the slots are written first, else the plan's expression works them out wherever it names them
        rows, met = written(texts.withColumn("claim_type", search.claim_class(F.col("claim"))).withColumn("entities", slots(F.col("claim")))), F.lit(None).cast("array<string>")
        if drift is not None:
            told = drift.filter("n >= 1").groupBy("claim_type").agg(F.sort_array(F.collect_set("token")).alias("_met"))
            rows, met = rows.join(F.broadcast(told), "claim_type", "left"), F.col("_met")
        rows = written(rows.withColumn("negatives", negatives(F.col("claim_type"), met)))
        return rows.withColumn("plan", query_plan(F.col("claim"), F.col("claim_type"), F.col("entities"), F.col("negatives"))).drop("_met")

    return by_value(claims, ["claim"], planned)


def fallback_queries(text: Column, failed: Column) -> Column:
    """Queries where nothing else reformulates a text: itself, and the entities that were not found, each with its endings."""
    own = F.array(*[F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(f" {e}")) for e in FALLBACK_ENDS])
    named = F.flatten(F.transform(F.coalesce(failed, _none()), lambda e: F.array(*[F.concat(e, F.lit(f" {x}")) for x in ENTITY_ENDS])))
    return F.array_distinct(F.concat(own, named))


def site_queries(q: Column, most: int = 4) -> Column:
    """A query at each of the first trusted sites."""
    return F.array(*[F.concat(F.lit(f"site:{site} "), q) for site in search.trusted_sites()[:most]])


def search_queries(claims: DataFrame, most: int = 6, reformulated: str | None = None) -> DataFrame:
    """(claim_id, parts, required, queries): all queries of a claim, within a budget.

    claims: claim_id (one row each), claim, parts (array of texts), entities
    (array), and where ``reformulated`` names it an array of queries from
    elsewhere, which are asked only where the rules give fewer than ``most``.

    Each part has its anchored, direct, operator and question queries, as far as
    they are good enough; its first anchored, direct or question query is
    required. All required ones come first, in the order of the parts, then the
    others by kind, each once, as long as there is room. A claim without parts
    or words has none.
    """
    c = F.col
    none = _none()
    rows = claims.select("claim_id", "claim", F.coalesce("entities", none).alias("entities"), F.coalesce(c(reformulated) if reformulated else none, none).alias("told"), queries.merged_parts(c("parts")).alias("parts"))
    every = F.concat(F.array("claim"), c("parts"))
    text = F.array_join(F.transform(every, lambda t: F.coalesce(t, F.lit(""))), " \n ")
    named = F.array_join(F.transform("entities", lambda e: F.coalesce(e, F.lit(""))), " \n ")
    rows = rows.withColumn("marks", search.term_marks(search.key_terms(F.concat_ws(" \n ", text, named)), search.key_numbers(text)))
    # the merged parts are written first, else each column of a claim works them out anew
    rows = written(rows)
    good = lambda q: search.query_quality(q, c("anchors"))["passed"]

    def asked(texts: DataFrame) -> DataFrame:
        own = written(texts.withColumn("anchors", queries.part_anchors(c("part"), c("entities"))))
        own = written(own.withColumns({
            "anchored": F.filter(queries.anchor_queries(c("part"), c("entities")), good), "operators": F.filter(queries.operator_queries(c("part"), c("entities")), good),
            "direct": F.filter(F.array(queries.direct_query(c("part"), c("entities"))), lambda q: (q != "") & good(q)), "question": F.filter(F.slice(queries.question_queries(c("part")), 1, 1), good),
        }).drop("anchors"))
        return own.withColumn("needed", F.transform(F.slice(F.concat("anchored", "direct", "question"), 1, 1), search.sanitized))

    each = by_value(rows.select("claim_id", "entities", F.posexplode("parts").alias("at", "part")), ["part", "entities"], asked)
    listed = each.groupBy(c("claim_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("at", "anchored", "operators", "direct", "question", "needed"))).alias("p"))
    held = rows.join(listed, c("claim_id").eqNullSafe(c("_id")), "left").withColumn("p", F.coalesce("p", F.array().cast(listed.schema["p"].dataType)))
    kept = lambda x: search.kept_queries(x, c("marks"))
    of = lambda name: kept(F.flatten(F.transform("p", lambda x: x[name])))
    held = held.withColumns({"anchored": of("anchored"), "direct": of("direct"), "operators": of("operators"), "question": of("question"), "plain": kept(queries.plain_queries(c("claim")))})
    ruled = F.array_distinct(F.concat("anchored", "direct", "operators", "plain"))
    held = held.withColumn("told", F.when(F.size(ruled) < most, kept(F.transform("told", search.sanitized))).otherwise(none))
    bases = F.array_distinct(F.concat(*[F.slice(x, 1, 1) for x in ("anchored", "direct", "told", "operators")]))
    held = held.withColumn("sites", F.flatten(F.transform(bases, lambda q: site_queries(q))))
    others = kept(F.transform(F.array_distinct(F.concat("anchored", "direct", "operators", "plain", "told", "question", "sites")), search.sanitized))
    required = F.filter(F.array_distinct(F.flatten(F.transform("p", lambda x: x["needed"]))), lambda q: (q != "") & search.names_term(q, c("marks")))
    held = held.withColumns({"required": required, "others": others})
    return held.select("claim_id", "parts", "required", F.slice(F.concat("required", F.array_except("others", "required")), 1, most).alias("queries"))
