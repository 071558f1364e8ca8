"""SQL of the operators on targets and vectors."""

from __future__ import annotations

def _nibble_table() -> str:
    """What four steps of CRC-32 (polynomial EDB88320, lowest bit first) make of each of the 16 values of half a byte."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return str(out)


def _features(table: str, key: str) -> str:
    """(rid, id, n, f): the n-grams of a table's texts."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    SELECT rid, id, 1 AS n, unnest(w) AS f FROM (SELECT row_number() OVER () AS rid, {key} AS id, {words} AS w FROM {table})
    UNION ALL SELECT rid, id, 2, list_extract(w, i) || ' ' || list_extract(w, i + 1) FROM (SELECT rid, id, w, unnest(range(1, len(w))) AS i FROM (SELECT row_number() OVER () AS rid, {key} AS id, {words} AS w FROM {table}))
    UNION ALL SELECT rid, id, 3, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) FROM (SELECT rid, id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT row_number() OVER () AS rid, {key} AS id, {words} AS w FROM {table}))"""


OP11_SQL = f"""
WITH d AS MATERIALIZED ({_features('documents', 'doc_id')}), b AS MATERIALIZED ({_features('benchmark', 'item_id')}),
crc AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, CAST(length(h) AS BIGINT), 2),
        lambda i: [strpos('123456789ABCDEF', substr(h, i + 1, 1))::BIGINT, strpos('123456789ABCDEF', substr(h, i, 1))::BIGINT]))),
        lambda c, v: xor(c >> 4, list_extract({_nibble_table()}::BIGINT[], (xor(c, v) & 15) + 1))), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b))),
s AS (SELECT bucket, count(*) AS s FROM d JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s)::DOUBLE + 10000)) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, count(*) AS n_features, count(*) FILTER (n = 1) AS words, sum(gain)::BIGINT AS weight FROM d JOIN crc USING (f) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(words, 0) >= 20 AS fits,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN w USING (rid)),
k AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (fits) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 5 * n // 100 THEN place END AS rank FROM k
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b, b.vec_id AS other FROM v AS a JOIN v AS b ON a.label = b.label AND a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a, min(v.vec_id) AS least FROM r JOIN v ON r.b = v.rid GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings AS e LEFT JOIN v USING (vec_id) LEFT JOIN c ON c.a = v.rid LEFT JOIN n ON n.a = v.rid
"""


# base columns: what SQL can say of operators whose other columns are beyond it

def _crc32(text: str) -> str:
    """The CRC-32 of a text as an integer."""
    halves = f"flatten(list_transform(range(1, CAST(length(hex(encode({text}))) AS BIGINT), 2), lambda i: [strpos('123456789ABCDEF', substr(hex(encode({text})), i + 1, 1))::BIGINT, strpos('123456789ABCDEF', substr(hex(encode({text})), i, 1))::BIGINT]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {halves}), lambda c, v: xor(c >> 4, list_extract({_nibble_table()}::BIGINT[], (xor(c, v) & 15) + 1))), 4294967295)"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"

OP2_BASE = f"""
SELECT doc_id, (CASE WHEN len(w) >= 3 THEN len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_shingles
FROM (SELECT doc_id, {_SPACED} AS w FROM documents)
"""

OP3_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held_out, list_append({_SPACED}, chr(10)) AS w FROM documents),
t AS (SELECT rid, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base FROM t LEFT JOIN c USING (x), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base, 6) AS base_score FROM d JOIN s USING (rid), n
"""


def op4_base(phrases: dict[str, str]) -> str:
    """Places and labels of phrases, by words that stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        fits = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        found.append(f"list_transform(list_filter(range(0, greatest(0, len(w) - {len(parts) - 1})), lambda i: {fits}), lambda i: {{'at': i, 'label': '{label}'}})")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), h AS (SELECT doc_id, len(w) AS n_words, {' || '.join(found)} AS hits FROM d)
SELECT doc_id, n_words, len(hits) AS n_base, list_min(list_transform(hits, lambda x: x.at)) AS first_word, list_max(list_transform(hits, lambda x: x.at)) AS last_word, coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ','), '') AS base_labels FROM h
"""


OP5_BASE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size FROM d
"""
