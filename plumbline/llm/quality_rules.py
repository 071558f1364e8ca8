"""Quality rules, line by line first: failing lines go, then documents that lose too much.

Built-in functions only. All figures of a document come from one projection;
nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.native_text import let
from plumbline.session import spare_name

#: Up to so many repeated windows are looked up in a list.
FEW = 48
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as page furniture, not prose.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot your password",
    "javascript is disabled", "log in to", "lorem ipsum", "privacy policy", "read more", "sign in to", "sign up for",
    "skip to content", "subscribe to our", "terms of service", "terms of use", "we use cookies",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; the defaults are the production ones."""

    min_words: int = 50
    #: Percent of words in repeated 3-word windows above which a document fails at once.
    max_repeat_pct: int = 50
    #: A line of at least so many words must have a sentence end or comma somewhere.
    unpunctuated_words: int = 40
    #: A line is navigation when at least this share of its words are lone separators.
    nav_share: float = 0.2
    #: A line is noise when symbols make up more than this share of its characters.
    symbol_share: float = 0.08
    #: A line of at least so many words fails when all its letters are upper case.
    shout_words: int = 4
    #: A line of at least so many words fails when fewer than this share of them differ.
    stutter_words: int = 12
    stutter_share: float = 0.25
    #: The document is rejected when it keeps less than this share of its words.
    min_kept_share: float = 0.7


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the array, the first one included."""

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))

        def add(acc: Column, p: Column) -> Column:
            return F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))

        return F.aggregate(places, zero, add, lambda acc: acc["n"])

    def from_windows(h: Column) -> Column:
        def few(twice: Column) -> Column:
            at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
            return let(F.array_compact(at), covered)

        def many(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                return (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])

            at = F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"])
            return let(F.sort_array(at), covered)

        def of_sorted(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i - 1))))
            keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            # looking through a short list beats a sort of structs; both give the same places
            return let(twice, lambda t: F.when(F.size(t) <= FEW, few(t)).otherwise(let(keyed, many)))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(h), of_sorted)).otherwise(0)

    def windows(w: Column) -> Column:
        # from the third word on: hashes of the words two before, one before and here
        h = F.transform(w, lambda x: F.xxhash64(x))
        return let(h, lambda g: F.transform(F.slice(g, 3, F.greatest(F.size(g) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(g, i), F.get(g, i + 1), x)))

    return F.when(F.size(words) < 3, 0).otherwise(let(windows(words), from_windows))


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))


def line_passes(line: Column, furnished: Column, symbolic: Column, rules: LineRules) -> Column:
    """Whether a line that has words is prose enough to stay.

    ``furnished``, ``symbolic``: whether the document holds any boilerplate phrase, any
    symbol; where it holds none, no line of it needs to be searched.
    """

    def judged(words: Column) -> Column:
        n = F.size(words)
        furniture = furnished & line.rlike("(?i)" + "|".join(BOILERPLATE))
        nav = (symbolic | line.rlike("[»/·-]")) & (F.size(F.filter(words, lambda w: w.isin("|", ">", "»", "/", "-", "·"))) >= rules.nav_share * n)
        noise = symbolic & (symbols_in(line) > rules.symbol_share * F.length(line))
        shout = (n >= rules.shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
        stutter = (n >= rules.stutter_words) & (F.size(F.array_distinct(words)) < rules.stutter_share * n)
        bare = (n >= rules.unpunctuated_words) & ~line.rlike(r"[.!?,;:…。！？，।؟۔]")
        return ~(furniture | nav | noise | shout | stutter | bare)

    return let(words_of(line), judged)


def quality_columns(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, base_failed, kept and clean_text.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_pct``
    percent of them in repeated 3-word windows. kept: not base_failed, and the
    lines that pass hold at least ``min_kept_share`` of the words. clean_text:
    the lines that pass and those without words, in their order. Null text has
    no words; a text without words has base_failed true. Rows are judged one by
    one, repeated rows alike. An empty table gives no rows. Columns of ``docs`` with
    these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def from_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(n.alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).cast("long").alias("r"))

    def has_words(line: Column) -> Column:
        return line.rlike(r"[^\x20\x09-\x0D]")

    def furnished(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | low.contains(phrase)
        return found

    def from_lines(ls: Column) -> Column:
        def held(flags: Column) -> Column:
            good = F.filter(ls, lambda x: ~has_words(x) | line_passes(x, flags["f"], flags["s"] > 0, rules))
            twins = let(F.filter(ls, has_words), lambda own: F.size(own) - F.size(F.array_distinct(own)))

            def figures(good: Column) -> Column:
                kept = F.aggregate(good, F.lit(0), lambda n, x: n + F.size(words_of(x)))
                return F.struct(twins.cast("long").alias("d"), kept.cast("long").alias("g"), flags["s"].cast("long").alias("s"), F.array_join(good, "\n").alias("t"))

            return let(good, figures)

        return let(F.struct(let(F.lower(text), furnished).alias("f"), symbols_in(text).alias("s")), held)

    w, ls = spare_name(docs, "_w"), spare_name(docs, "_l")
    made = docs.select(*[F.col(f"`{c}`") for c in docs.columns], let(words_of(text), from_words).alias(w), let(F.split(text, "\n"), from_lines).alias(ls))
    n = F.col(f"{w}.n")
    failed = (n < rules.min_words) | (100 * F.col(f"{w}.r") > rules.max_repeat_pct * n)
    figures = {
        "n_words": n,
        "word_chars": F.col(f"{w}.c"),
        "n_symbols": F.col(f"{ls}.s"),
        "n_dup_lines": F.col(f"{ls}.d"),
        "n_repeat_words": F.col(f"{w}.r"),
        "kept_words": F.col(f"{ls}.g"),
        "base_failed": failed,
        "kept": ~failed & (F.col(f"{ls}.g") >= rules.min_kept_share * n),
        "clean_text": F.col(f"{ls}.t"),
    }
    own = [F.col(f"`{c}`") for c in docs.columns if c not in figures]
    return made.select(*own, *[v.alias(k) for k, v in figures.items()])


def keep_good(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their failing lines removed; other columns as they are, whatever their names.

    Null and empty texts have too few words and go, as do all rows that
    quality_columns() does not keep; repeated rows stay or go alike. An empty
    table gives no rows.
    """
    judged = quality_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text")), "_text", rules)
    return judged.filter("kept").select(*[(F.col("clean_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
