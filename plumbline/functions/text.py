"""Text scalars. Java's \\w is ASCII unless (?U) is set; the patterns here say which letters they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import words


def normalize_text(x: Column) -> Column:
    """Outer white space off, inner white space to one space; the case stays."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def clean_statement(x: Column) -> Column:
    """Normalised, without markdown marks, runs of dots as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(x), r"[*_`#~]", ""), r"\.{2,}", "."))


def truncate_content(x: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters and an ellipsis, cut at a space if one lies in the last fifth."""
    head = F.substring(x, 1, limit)
    last_space = F.length(head) - F.locate(" ", F.reverse(head))
    whole = F.when((F.locate(" ", F.reverse(head)) > 0) & (last_space > 0.8 * limit), F.left(head, last_space)).otherwise(head)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.trim(whole), F.lit("...")))


def remove_tags(x: Column) -> Column:
    """Tags out, then the five common entities decoded, in that order."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def sanitize_entity(x: Column) -> Column:
    """Lower case, letters, digits, hyphens and brackets only."""
    return F.trim(F.regexp_replace(F.lower(normalize_text(x)), r"(?U)[^\w\s\-()]", ""))


def sentences(x: Column) -> Column:
    """Sentences of more than ten characters."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 10)


def tokens(x: Column, pattern: str = r"[a-z][a-z\-]{2,}") -> Column:
    """Distinct lower-case tokens, first come first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(pattern), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 0 for no tokens."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def has_number(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"[0-9]")


def folded(x: Column) -> Column:
    """Lower case, outer white space off, inner white space to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def fact_id(statement: Column, source: Column) -> Column:
    """f_ and 16 hex digits of the SHA-256 of the source, without closing slashes, and the statement, both folded to lower case."""
    url = F.rtrim(F.lower(F.coalesce(source, F.lit(""))), F.lit("/"))
    return F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("|", url, folded(statement)), 256), 1, 16))


def entity_id(name: Column) -> Column:
    return F.substring(F.md5(F.trim(F.lower(name))), 1, 16)


#: Negations that a signature leaves out, so that a claim and its denial share it.
SIGNATURE_NEGATIONS = ("no", "not", "never", "without", "cannot", "can't", "doesn't", "don't", "didn't")


def statement_signature(x: Column) -> Column:
    """The sorted distinct words of three letters or more, without stop words and negations, as one string."""
    return F.array_join(F.array_sort(words.token_set(x, words.ALPHA, (*words.STOP, *SIGNATURE_NEGATIONS))), " ")
