"""Counts over ranked evidence and facts, lookups in the stores, and what is written to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import domains, facts, scoring, stance, text, urls, words
from plumbline.functions.once import apart
from plumbline.operators import hybrid, logic
from plumbline.operators.evidence import evidence_key
from plumbline.session import few_pairs, with_values


def track_hits(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim_id, hits): candidates (claim_id, seq, statement) that have 35 per cent of a segment's (claim_id, segment) words."""
    c = F.col
    want = segments.select("claim_id", words.token_set(c("segment"), words.ALPHA).alias("s")).filter(F.size("s") > 0)
    own = candidates.select("claim_id", "seq", words.token_set(c("statement"), words.ALPHA).alias("t")).filter(F.size("t") > 0)
    best = own.join(want, "claim_id").groupBy("claim_id", "seq").agg(F.max(words.shared(c("s"), c("t")) / F.size("s")).alias("best"))
    return best.groupBy("claim_id").agg(F.count_if(F.round("best", 9) >= 0.35).alias("hits"))


def comparative_hits(ranked: DataFrame, claims: DataFrame, top: int = 10) -> DataFrame:
    """(claim_id, hits): of a claim's first rows those that compare as the claim does."""
    rows = ranked.filter(F.col("rank") <= top).join(claims.select("claim_id", "claim"), "claim_id")
    return rows.groupBy("claim_id").agg(F.count_if(stance.comparative_hit(F.col("claim"), F.col("statement"))).alias("hits"))


def directional_keys(ranked: DataFrame, least: float = 0.58) -> DataFrame:
    """(claim_id, keys): distinct source and folded statement of rows that take a side, or score for one."""
    sided = F.lower(F.trim(F.coalesce("stance", F.lit("")))).isin("entails", "contradicts", "supports", "refutes")
    score = F.greatest(F.coalesce("support_score", F.lit(0.0)), F.coalesce("contradict_score", F.lit(0.0)))
    key = F.concat_ws("|", F.lower(F.trim(F.coalesce("source_url", F.lit("")))), text.folded(F.col("statement")))
    rows = ranked.filter(sided | (score >= least)).select("claim_id", key.alias("key")).filter(F.trim("key", F.lit("|")) != "")
    return rows.groupBy("claim_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def confidence_summary(rows: DataFrame) -> DataFrame:
    """Per group: least, largest and mean confidence, and how many facts are in which validation state."""
    state = lambda s: F.count_if(F.col("validation_state") == s)
    return rows.groupBy("claim_id").agg(
        F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.avg("confidence").alias("mean"),
        state("TRUSTED").alias("trusted"), state("UNTRUSTED").alias("untrusted"), state("PENDING_DOMAIN_TRUST").alias("pending"),
    )


def error_counts(attempts: DataFrame) -> DataFrame:
    """(error_code, n) of attempts that failed with one."""
    return attempts.filter("NOT success AND error_code IS NOT NULL").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def merged_groups(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): the values of rows alike in ``key``, in ``order``; nulls left out."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return rows.groupBy(key).agg(listed.alias("_l")).select(key, F.col(f"_l.{value}").alias("values"))


def keep_first_evidence(rows: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Of a claim's rows alike in evidence_key the first in ``order``, with all columns or only those that are asked for."""
    keyed = rows.withColumn("_key", evidence_key(F.col("source_url"), F.col("statement")))
    best = keyed.groupBy("claim_id", "_key").agg(F.min_by(F.struct(*(columns or rows.columns)), order).alias("_row"))
    return best.select("_row.*")


def embedding_text(statement: Column, side: Column) -> Column:
    """A fact's text as it is embedded: with its side before it, so that the sides lie apart."""
    s = F.upper(F.trim(F.coalesce(side, F.lit(""))))
    return F.when(s == "SUPPORTS", F.concat(F.lit("[SUPPORTS_CLAIM] "), statement)).when(s == "REFUTES", F.concat(F.lit("[REFUTES_CLAIM] "), statement)).otherwise(statement)


def vector_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts from trusted domains, enriched, as (fact_id, embed_text, metadata); metadata has no null values.

    decisions: (domain, approved), the newest on each domain.
    """
    from plumbline.operators.trust import validated

    c = F.col
    trusted = validated(rows, decisions).filter("validation_state = 'TRUSTED'")
    more = facts.enriched(trusted)
    fields = {"statement": c("statement"), "source_url": c("source_url"), "domain": c("domain"), "topic": c("topic"), "source": c("source"), "doc_type": c("doc_type"), "fact_type": c("fact_type"), "count_value": c("count_value").cast("string"), "stance": F.nullif(F.upper(F.trim(F.coalesce("stance", F.lit("")))), F.lit("")), "language": F.lit("en")}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return more.select("fact_id", embedding_text(c("statement"), c("stance")).alias("embed_text"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata"))


def lexical_rows(old: DataFrame | None, new: DataFrame, order: str) -> DataFrame:
    """The lexical index after an upsert of facts (fact_id, statement, topic, ..): a new row replaces the old of its id; blank ids and statements are left out."""
    from plumbline.operators.ingest import upsert

    return upsert(old, new.filter(F.coalesce("statement", F.lit("")) != "").withColumn("topic", F.coalesce("topic", F.lit("other"))), "fact_id", order)


def processed_urls(store: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Distinct source URLs of stored facts, of the topics asked for and 'other'; facts without a topic only if none is asked for."""
    rows = store.filter(F.coalesce("source_url", F.lit("")) != "")
    if topics:
        rows = rows.filter(F.lower(F.trim("topic")).isin(*{t.lower() for t in topics}, "other"))
    return rows.select("source_url").distinct()


def relations_for(relations: DataFrame, entity_ids: DataFrame, limit: int) -> DataFrame:
    """Relations (rid, subject_id, object_id, confidence) at either end of which one of the ids (id) stands, the surest first, at most ``limit``, which is held to 1 to 1000."""
    ids = entity_ids.select("id").distinct()
    hit = relations.join(ids, relations["subject_id"] == ids["id"], "left_semi").unionByName(relations.join(ids, relations["object_id"] == ids["id"], "left_semi")).distinct()
    return hit.orderBy(F.desc("confidence"), "rid").limit(max(1, min(1000, limit)))


def claim_relations(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(claim_id, rid): relations whose subject or object a claim mentions (claim_id, entity_id)."""
    by = lambda end: mentions.join(relations.withColumnRenamed(end, "entity_id"), "entity_id").select("claim_id", "rid")
    return by("subject_id").union(by("object_id")).distinct()


def merge_claims(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Claim records (claim_id, seq, status, verdict, processed_at): the newest of each claim, a blank field keeping what was there before, and when the claim was first seen."""
    rows = new.withColumn("_age", F.lit(1))
    if old is not None:
        rows = old.withColumn("_age", F.lit(0)).unionByName(rows)
    at = F.struct("_age", "seq")
    newest = lambda x: F.max(F.when(F.coalesce(F.col(x).cast("string"), F.lit("")) != "", F.struct("_age", "seq", x))).getField(x)
    return rows.groupBy("claim_id").agg(newest("status").alias("status"), newest("verdict").alias("verdict"), F.min("processed_at").alias("first_seen"), F.max_by("processed_at", at).alias("last_seen"), F.count(F.lit(1)).alias("writes"))


def best_cosine(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, score): each row's best cosine over the queries of its own claim, where it is above 0. rows: claim_id, id, v; queries: claim_id, q."""
    pairs = rows.join(queries, "claim_id").withColumn("c", F.round(scoring.cosine(F.col("v"), F.col("q")), 6))
    return pairs.groupBy("id").agg(F.max("c").alias("score")).filter("score > 0")


def phase_texts(rows: DataFrame) -> DataFrame:
    """Rows (claim, claim_entities, must_have, statement) with what the rank phase reads in these."""
    from plumbline.functions import policy

    c = F.col
    read = {"off": policy.family_mismatch(c("statement"), c("claim"), c("claim_entities")), "stance": stance.stance(c("claim"), c("statement")), "core": policy.has_must_have(c("statement"), c("must_have"))}
    return rows.withColumns(read | logic.conflict_texts(c("statement")))


def rank_phase(ranked: DataFrame, claims: DataFrame, k: int = 5, statements: DataFrame | None = None) -> DataFrame:
    """The k rows of each claim that go to the verdict, graded.

    ranked: hybrid_rank() rows. Other families of vitamins go; the stance is
    worked out; contradicting rows weigh 0.84 or 0.97 of their score by how
    surely they refute; neutral graph rows off the claim are damped; opposed
    copies of one source give way; of the k places one, or two where
    contradiction is strong and support is not, go to contradicting rows.
    claims: claim_id, claim, entities, must_have. Rows that name what a claim
    must have come first. ``statements`` may give all statements that the rows
    have: where they are few, texts are read once for each pair of distinct ones.
    """
    c = F.col
    from plumbline.functions import policy

    asked = claims.select("claim_id", "must_have", c("entities").alias("claim_entities"))
    # the lists that the scores were made of go, before rows are gathered whole
    d = ranked.drop(*hybrid.LISTS).join(asked, "claim_id")
    few = None if statements is None else few_pairs(claims.select("claim", c("entities").alias("claim_entities"), "must_have"), statements)
    read = None if few is None else with_values(d, ["claim", "claim_entities", "must_have", "statement"], phase_texts(few[0].crossJoin(few[1])))
    d = (phase_texts(d) if read is None else read).filter(~c("off")).drop("off", "claim_entities", "must_have")
    against = c("stance") == "contradicts"
    first = scoring.clamp01(0.42 * c("contradict_score") + 0.30 * c("negation_anchor") + 0.18 * (1 - c("predicate_match")) + F.when(against, 0.10).otherwise(0.0))
    d = d.withColumn("stage1", F.round(first, 9))
    bent = c("final_score") * F.when(c("stage1") >= 0.60, 0.97).otherwise(0.84)
    bent = F.when(c("conflict"), F.least(F.lit(0.99), bent + 0.04)).otherwise(bent)
    d = d.withColumn("final_score", F.when(against, bent).otherwise(c("final_score")))
    damping = policy.neutral_graph_damping(c("stance"), c("w_sem") * c("sem"), c("kg"), c("claim_overlap"), c("anchor_match_score"), c("predicate_match"))
    d = apart(d, {"final_score": F.round(c("final_score") * (1 - damping), 9), "sem_score": c("w_sem") * c("sem")}, "stage1").drop(*[x for x in d.columns if x.startswith("w_")])
    own = Window.partitionBy("claim_id")
    d = d.withColumn("seq", F.row_number().over(own.orderBy(c("final_score").desc(), c("sem_score").desc(), c("credibility").desc(), "statement", c("source_url").asc_nulls_first())))
    d = logic.without_conflicts(d)
    strong = (F.max("contradict_score").over(own) >= 0.62) & (F.max("support_score").over(own) <= 0.72)
    d = d.withColumns({"quota": F.when(strong, 2).otherwise(1), "_opposed": c("stance") == "contradicts"})
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy("claim_id", "_opposed").orderBy("seq")))
    held = F.least("quota", F.count_if("_opposed").over(own))
    d = d.withColumn("_first", F.when(c("_opposed"), c("_place") <= c("quota")).otherwise(c("_place") <= k - held))
    d = d.withColumn("_pick", F.row_number().over(own.orderBy(c("_first").desc(), "_opposed", "seq"))).filter(c("_pick") <= k)
    order = [c("core").desc(), c("final_score").desc(), c("support_score").desc(), c("sem_score").desc(), "statement", c("source_url").asc_nulls_first()]
    return logic.graded(d.withColumn("rank", F.row_number().over(own.orderBy(*order)))).drop("_opposed", "_place", "_first", "_pick", "seq")


def domain_of(u: Column) -> Column:
    """The domain under which a source is stored, with its port; blank for none."""
    return F.coalesce(urls.domain(u), F.lit(""))


def trusted_only(rows: DataFrame, url: str = "source_url") -> DataFrame:
    return rows.filter(domains.is_trusted(F.col(url)))
