"""What a verdict says in words, what a caller gets to see of it, and what services' loosely written JSON holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from plumbline.functions import search
from plumbline.functions.once import once

#: The sentences of a rationale.
BY_VERDICT = {
    "UNVERIFIABLE": "Available admissible evidence is mixed or insufficiently decisive for this claim, so the result is UNVERIFIABLE.",
    "FALSE": "Admissible evidence contradicts the claim on required segments.",
    "TRUE": "Admissible evidence consistently supports all required claim segments.",
}
BOTH_WAYS = "Evidence supports some parts of the claim while contradicting others."
UNRESOLVED = "Some claim segments remain unresolved by admissible evidence."
WITH_CAVEATS = "Evidence partially supports the claim with caveats."
#: Statuses of segments that count for and against, and those worth a finding.
AGAINST = ("INVALID", "PARTIALLY_INVALID")
IN_FAVOUR = ("VALID", "PARTIALLY_VALID", "STRONGLY_VALID")
TELLING = ("VALID", "INVALID", "PARTIALLY_VALID", "PARTIALLY_INVALID")

TRIPLE = "struct<subject:string,relation:string,object:string,confidence:double>"
RESULT = f"struct<index:bigint,triples:array<{TRIPLE}>>"
REPLY = f"results array<{RESULT}>, triples array<{TRIPLE}>"


def _status(segment: Column) -> Column:
    status = F.upper(F.coalesce(segment["status"], F.lit("")))
    return F.when(status == "", "UNKNOWN").otherwise(status)


def rationale(verdict: Column, segments: Column) -> Column:
    """The sentence for a verdict; for verdicts in between it hangs on the segments' statuses."""
    statuses = F.coalesce(F.transform(segments, _status), F.array().cast("array<string>"))
    against, for_it = F.exists(statuses, lambda s: s.isin(*AGAINST)), F.exists(statuses, lambda s: s.isin(*IN_FAVOUR))
    said = F.when(against & for_it, BOTH_WAYS).when(F.array_contains(statuses, "UNKNOWN"), UNRESOLVED).otherwise(WITH_CAVEATS)
    for name, sentence in BY_VERDICT.items():
        said = F.when(verdict == name, sentence).otherwise(said)
    return said


def key_findings(segments: Column, most: int = 5) -> Column:
    """'STATUS: fact' of the first ``most`` segments that have a telling status and a fact."""
    fact = lambda s: F.trim(F.coalesce(s["supporting_fact"], F.lit("")))
    told = F.filter(segments, lambda s: _status(s).isin(*TELLING) & (fact(s) != ""))
    return F.coalesce(F.slice(F.transform(told, lambda s: F.concat(_status(s), F.lit(": "), fact(s))), 1, most), F.array().cast("array<string>"))


def shown_verdict(internal: Column, binary: Column, binary_first: bool = True) -> Column:
    """The verdict that a caller gets: the binary one where there is one, else the internal one; unverifiable where that is blank."""
    clean = lambda x: F.upper(F.trim(F.coalesce(x, F.lit(""))))
    own = F.when(clean(internal) == "", "UNVERIFIABLE").otherwise(clean(internal))
    return F.when(clean(binary).isin("TRUE", "FALSE"), clean(binary)).otherwise(own) if binary_first else own


def shown_evidence(evidence: Column, most: int = 5) -> Column:
    """The first rows of evidence as a caller gets them: cleaned statements, scores to three places, defaults for what is missing."""

    def row(e: Column) -> Column:
        score = F.coalesce(e["score"], e["final_score"], F.lit(0.0))
        return F.struct(
            search.truth_cleaned(e["statement"]).alias("statement"), F.coalesce(e["source_url"], F.lit("")).alias("source_url"), F.round(score, 3).alias("score"),
            F.round(F.coalesce(e["sem_score"], e["score"], F.lit(0.0)), 3).alias("sem_score"), F.round(F.coalesce(e["kg_score"], F.lit(0.0)), 3).alias("kg_score"),
            F.coalesce(e["credibility"], F.lit(0.5)).alias("credibility"), F.coalesce(e["grade"], F.lit("N/A")).alias("grade"),
        )

    return F.transform(F.slice(evidence, 1, most), row)


def response(verdict_evidence: Column, ranked: Column, findings: Column, internal: Column, binary: Column, confidence: Column, calibrated: Column, count: Column) -> dict[str, Column]:
    """The columns of an answer: a verdict's own evidence, or the ranked rows where it has none, and five findings of 180 characters."""
    final = F.when(F.coalesce(F.size(verdict_evidence), F.lit(0)) > 0, verdict_evidence).otherwise(F.coalesce(ranked, F.slice(verdict_evidence, 1, 0)))
    spoken = F.filter(findings, lambda f: F.trim(F.coalesce(f, F.lit(""))) != "")
    sure = F.coalesce(confidence, F.lit(0.0))
    return {
        "verdict": shown_verdict(internal, binary), "verdict_internal": shown_verdict(internal, binary, binary_first=False), "confidence": sure, "calibrated_confidence": F.coalesce(calibrated, sure),
        "key_findings": F.slice(F.transform(spoken, lambda f: search.truth_cleaned(f, 180)), 1, 5), "evidence": shown_evidence(final),
        "evidence_count": F.when(F.coalesce(count, F.lit(0)) != 0, count).otherwise(F.coalesce(F.size(final), F.lit(0))),
    }


def debug_figures(evidence_map: Column, final: Column, segments: Column) -> dict[str, Column]:
    """Counts of a verdict's evidence by relevance and gate, why rows were blocked, the mean alignment of its segments, and its distinct hosts in order."""
    relevance = lambda e: F.upper(F.trim(F.coalesce(e["relevance"], F.lit(""))))
    counted = lambda holds: F.coalesce(F.size(F.filter(evidence_map, holds)), F.lit(0))
    flag = lambda name: lambda e: F.coalesce(e[name], F.lit(False))
    reasons = F.filter(F.transform(evidence_map, lambda e: F.trim(F.coalesce(e["block_reason"], F.lit("")))), lambda r: r != "")
    tally = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(reasons)), lambda r: F.struct(r, F.size(F.filter(reasons, lambda x: x == r)))))
    values = F.filter(F.transform(segments, lambda s: F.coalesce(s["final_score"], s["score"], s["predicate_match_score"])), lambda x: x.isNotNull())
    mean = once(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0))
    origin = F.when(F.coalesce(F.size(evidence_map), F.lit(0)) > 0, F.transform(evidence_map, lambda e: e["source_url"])).otherwise(F.transform(final, lambda e: e["source_url"]))
    hosts = F.filter(F.transform(origin, lambda u: F.lower(F.coalesce(F.try_parse_url(F.trim(F.coalesce(u, F.lit(""))), F.lit("AUTHORITY")), F.lit("")))), lambda h: h != "")
    return {
        "support_count": counted(lambda e: relevance(e) == "SUPPORTS"), "refute_count": counted(lambda e: relevance(e) == "REFUTES"), "neutral_count": counted(lambda e: ~relevance(e).isin("SUPPORTS", "REFUTES")),
        "support_admitted": counted(flag("to_support")), "refute_admitted": counted(flag("to_contradict")), "refute_gate_passed": counted(flag("gate_passed")),
        "block_reasons": tally, "alignment_score": mean, "sources": F.array_sort(F.array_distinct(hosts)),
    }


def sampled(x: Column, kind: DataType, most: int = 5, hard_most: int = 20) -> Column:
    """A value with all its lists, however deep, cut to their first items, as a log holds it."""
    n = max(1, min(most, hard_most))
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(x, 1, n), lambda e: sampled(e, kind.elementType, most, hard_most))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: sampled(v, kind.valueType, most, hard_most))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[sampled(x[f.name], f.dataType, most, hard_most).alias(f.name) for f in kind.fields]))
    return x


def repaired(text: Column) -> Column:
    """JSON without the fence around it, what stands before and after its outer braces, and commas before a closing bracket."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")

    def outer(x: Column) -> Column:
        first, last = F.instr(x, F.lit("{")), F.length(x) - F.instr(F.reverse(x), F.lit("}")) + 1
        return F.when((first > 0) & F.contains(x, F.lit("}")) & (last > first), F.substr(x, first, last - first + 1)).otherwise(x)

    return F.regexp_replace(once(bare, outer), r",\s*([}\]])", "$1")


def results_of(text: Column) -> Column:
    """The results in a reply: its ``results``, or bare ``triples`` as the result of index 0; of the repaired reply where it is no JSON; null where neither helps."""

    def parsed(x: Column) -> Column:
        alone = lambda r: F.when(r["triples"].isNotNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("index"), r["triples"].alias("triples"))))
        return once(F.from_json(x, REPLY), lambda r: F.coalesce(r["results"], alone(r)))

    whole = F.when(F.try_parse_json(text).isNotNull(), text)
    return F.when(whole.isNotNull(), parsed(whole)).otherwise(parsed(repaired(text)))


def queries_of(text: Column, most: int = 6) -> Column:
    """The queries in a reply: a list, or an object's ``queries``, a list or one text; what is no text is passed over, the first ``most`` stay, distinct."""
    reply = F.try_parse_json(text)
    within = F.try_variant_get(reply, "$.queries", "array<variant>")
    listed = F.coalesce(within, F.transform(F.array(F.try_variant_get(reply, "$.queries", "variant")), lambda v: v), F.array().cast("array<variant>"))
    items = F.when(F.schema_of_variant(reply).startswith("ARRAY"), F.try_variant_get(reply, "$", "array<variant>")).otherwise(listed)
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: search.sanitized(F.lower(F.trim(F.try_variant_get(v, "$", "string")))))
    return F.coalesce(F.array_distinct(F.slice(F.filter(texts, lambda q: q != ""), 1, most)), F.array().cast("array<string>"))
