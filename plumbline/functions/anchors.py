"""Anchors of a claim's part by rule: its hints, then runs of three and two words, then words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.once import once
from plumbline.operators.lists import ngrams

#: Words that no anchor keeps.
DROPPED = (
    "the", "a", "an", "and", "or", "but", "to", "for", "of", "in", "on", "with", "by", "at", "is", "are", "was", "were", "be", "been", "being", "it", "its", "their", "there", "that", "this", "these", "those",
    "as", "about", "from", "have", "has", "had", "do", "does", "did", "can", "could", "should", "would", "may", "might", "must", "i", "you", "he", "she", "we", "they", "them", "my", "your", "our", "his", "her", "also",
    "against", "work", "works", "working", "claim", "claims", "says", "said", "show", "shows", "study", "studies", "medical", "health", "fact", "facts",
)
#: Fixed value: what a word of a part is.
WORD = r"\b[a-zA-Z][a-zA-Z0-9\-']+\b"


def normalized(x: Column) -> Column:
    """Lower-case words of letters, digits and hyphens without the dropped ones; blank where a single word shorter than three is left."""
    spaced = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\-\s]", " ")
    kept = F.filter(F.split(spaced, r"\s+"), lambda w: (w != "") & ~w.isin(*DROPPED))
    return once(kept, lambda t: F.when((F.size(t) == 1) & (F.length(F.get(t, F.lit(0))) < 3), "").otherwise(F.array_join(t, " ")))


def held(part: Column, anchor: Column) -> Column:
    """A run of words stands anywhere in the part, a word only as a whole."""
    low = F.lower(F.coalesce(part, F.lit("")))
    return (anchor != "") & F.when(F.contains(anchor, F.lit(" ")), F.contains(low, anchor)).otherwise(F.rlike(low, F.concat(F.lit(r"\b"), anchor, F.lit(r"\b"))))


def usable(anchors: Column, part: Column, most: int) -> Column:
    """The first ``most`` distinct normalised anchors; a single word only where the part holds its letters."""
    low = F.lower(F.coalesce(part, F.lit("")))
    clean = F.array_distinct(F.filter(F.transform(anchors, normalized), lambda a: a != ""))
    return F.slice(F.filter(clean, lambda a: F.contains(a, F.lit(" ")) | F.contains(low, a)), 1, most)


def rule_anchors(part: Column, hints: Column, most: int = 4) -> Column:
    """Two to five anchors of a part, fewer only where it has not the words; a lone one stands with the part's first words beside it."""
    most = max(2, min(5, most))
    none = F.array().cast("array<string>")
    raw = F.regexp_extract_all(F.coalesce(part, F.lit("")), F.lit(WORD), F.lit(0))
    named = F.filter(F.transform(F.coalesce(hints, none), normalized), lambda h: held(part, h))

    def chosen(own: Column) -> Column:
        words = F.filter(F.transform(own, normalized), lambda w: w != "")
        runs = F.concat(*[ngrams(F.transform(own, F.lower), n) for n in (3, 2)])
        first = once(usable(F.concat(named, runs, words), part, most), lambda a: F.when(F.size(a) > 0, a).otherwise(F.slice(words, 1, most)))
        more = F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, 2)
        return once(first, lambda a: F.when(F.size(a) < 2, F.slice(F.concat(a, more), 1, most)).otherwise(a))

    return once(raw, chosen)


def claim_anchors(part: Column, hints: Column, told: Column, most: int = 4) -> Column:
    """Anchors that a model told of a part, if two at least are usable; else those by rule, and where these are fewer than two those without hints too."""
    most = max(2, min(5, most))
    none = F.array().cast("array<string>")

    def filled(own: Column) -> Column:
        again = rule_anchors(part, none, most)
        return F.when(F.size(own) < 2, F.slice(F.concat(own, again), 1, most)).otherwise(own)

    by_rule = once(rule_anchors(part, hints, most), filled)
    return once(usable(F.coalesce(told, none), part, most), lambda a: F.when(F.size(a) >= 2, a).otherwise(by_rule))
