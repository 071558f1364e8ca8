"""Thin queries of the operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.exact_dedup import exact_groups
from plumbline.llm.hard_negatives import hard_negatives
from plumbline.llm.importance import importance_scores
from plumbline.llm.license_scan import PHRASES, scan_licenses
from plumbline.llm.lm_score import score_texts
from plumbline.llm.mixing import mix_rates
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality_rules import BOILERPLATE, quality_columns
from plumbline.llm.secret_scan import ACCESS, ASSIGN, HEX, MIN_ASSIGN, OWNED, scan_secrets
from plumbline.llm.sql import OP2_BASE, OP3_BASE, OP5_BASE, OP11_SQL, OP12_SQL, OP13_SQL, op4_base
from plumbline.llm.toxicity import score_toxicity, train
from plumbline.llm.vector_dedup import vector_duplicates
from plumbline.llm.warc import round_trip
from plumbline.session import read_table


def tokenizer_file() -> str:
    """The public vocabulary that the packing query's contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, threshold_pct=85)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_columns(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


# base columns of operators that SQL cannot express as a whole

def base_of_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_near_dedup(spark, sf_dir).select("doc_id", "n_shingles")


def base_of_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def base_of_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_of_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_dedup, op2_near_dedup, op3_lm_score, op4_license_scan, op5_mixing, op6_warc, op7_secret_scan, op8_packing, op9_quality_rules, op10_toxicity, op11_importance, op12_hard_negatives, op13_vector_dedup)
    base = (base_of_near_dedup, base_of_lm_score, base_of_license_scan, base_of_mixing)
    return {f.__name__: f for f in (*every, *base)}


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits,
             min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j: CASE substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) WHEN '1' THEN CAST(2 ** (4 - j) AS BIGINT) ELSE 0 END))::BIGINT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM d
"""



def _sql_spans(pattern: str, group: int, least: int) -> str:
    """A list of (s, e, v) of a pattern's matches in t, from the pieces between them."""
    quoted = pattern.replace("'", "''")
    pieces, whole, part = f"string_split_regex(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}', {group})"
    ends = f"list_transform(range(1, len({whole}) + 1), lambda i: {{'e': list_sum(list_transform(({pieces})[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(({whole})[1:i], lambda x: length(x)))::BIGINT, 'w': length(({whole})[i]), 'v': ({part})[i]}})"
    return f"list_transform(list_filter({ends}, lambda x: length(x.v) >= {least}), lambda x: {{'s': x.e - x.w, 'e': x.e, 'v': x.v}})"


_LISTED = "array_to_string(list_transform(list_sort({0}), lambda x: ['assign', 'access', 'hex', 'owned'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
_KIND = "list_transform({0}, lambda x: {{'s': x.s, 'k': {1}, 'e': x.e, 'h': sha256(x.v)}})"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, doc_id, owner, {_KIND.format(_sql_spans(ASSIGN, 2, MIN_ASSIGN), 0)} AS a, {_KIND.format(_sql_spans(ACCESS, 0, 0), 1)} AS b, {_KIND.format(_sql_spans(HEX, 0, 0), 2)} AS c,
    {_KIND.format("list_filter(" + _sql_spans(OWNED, 0, 0) + ", lambda x: regexp_matches(x.v, '[A-Z]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[0-9].*[0-9]'))", 3)} AS o FROM d),
g AS (SELECT *, list_concat(a, b, c) AS base FROM f), r AS (SELECT rid, doc_id, owner, base, list_filter(o, lambda x: len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS more, len(a) AS n_assign, len(b) AS n_access, len(c) AS n_hex FROM g),
e AS (SELECT rid, doc_id, owner, unnest(list_concat(base, more)) AS x FROM r), n AS (SELECT x.h AS h, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT (coalesce(owner, chr(1)), doc_id)) AS repos FROM e GROUP BY 1),
j AS (SELECT rid, x, owners, repos, owners <= 2 AND repos <= 5 AS live FROM e JOIN n ON x.h = n.h),
k AS (SELECT rid, list({{'s': x.s, 'k': x.k, 'e': x.e, 'owners': owners, 'repos': repos, 'live': live}}) AS every, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j WHERE live OR x.k < 3 GROUP BY 1)
SELECT doc_id, n_assign, n_access, n_hex, sha256({_LISTED.format('base')}) AS base_sha256, coalesce({_LISTED.format('every')}, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
    coalesce(list_transform(list_sort(every), lambda x: x.live), []) AS live, coalesce(list_transform(list_sort(every), lambda x: x.owners), []) AS owners, coalesce(list_transform(list_sort(every), lambda x: x.repos), []) AS repos FROM r LEFT JOIN k USING (rid)
"""

_W = r"[^\x20\x09-\x0D]+"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '{_W}') AS w FROM d),
tri AS (SELECT rid, i, list_extract(w, i) || chr(1) || list_extract(w, i + 1) || chr(1) || list_extract(w, i + 2) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
tw AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1), rp AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tw) GROUP BY 1),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d), lw AS (SELECT *, regexp_extract_all(l, '{_W}') AS lw FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lf AS (SELECT rid, l, len(lw) AS n, regexp_matches(l, '(?i){'|'.join(BOILERPLATE)}') OR len(list_filter(lw, lambda x: list_contains(['|', '>', '»', '/', '-', '·'], x))) >= 0.2 * len(lw) OR length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) > 0.08 * length(l)
    OR (len(lw) >= 4 AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}')) OR (len(lw) >= 12 AND len(list_distinct(lw)) < 0.25 * len(lw)) OR (len(lw) >= 40 AND NOT regexp_matches(l, '[.!?,;:…。！？，؟۔]')) AS bad FROM lw),
la AS (SELECT rid, coalesce(sum(n) FILTER (NOT bad), 0) AS good, count(*) - count(DISTINCT l) AS dup FROM lf GROUP BY 1),
a AS (SELECT w.rid, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(good, 0) AS good FROM w LEFT JOIN la USING (rid) LEFT JOIN rp USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good >= 0.7 * n_words AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op7_secret_scan": OP7_SQL, "op9_quality_rules": OP9_SQL, "op11_importance": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_dedup": OP13_SQL} | {"base_of_near_dedup": OP2_BASE, "base_of_lm_score": OP3_BASE, "base_of_license_scan": op4_base(PHRASES), "base_of_mixing": OP5_BASE}
