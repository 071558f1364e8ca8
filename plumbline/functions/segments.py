"""Claims cut to segments that can be checked one by one.

A sentence is tagged once: each word is an auxiliary, a verb, a joint, a
preposition and so on, at a depth of brackets. One pass over the tags then folds
the members between joints into segments: a member with a verb of its own
stands by itself, one that begins with its verb borrows the subject before it,
and one without a verb borrows all up to what governs it, or stays where it was.
Lists, comparisons and contrasts are found on the same tags.

Claims are a line or two, so this runs as Python over Arrow batches of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

AUXILIARIES = frozenset("is are was were be been being has have had do does did can could may might must should would will don't doesn't didn't can't cannot won't isn't aren't".split())
#: Verbs that claims are made with, in their base form.
VERBS = frozenset(
    "help prevent reduce increase decrease cause improve worsen protect lower raise release show lead result contribute support kill cure treat contain target affect work maintain build "
    "promote regulate need require link associate boost shorten lengthen replace renew hurt harm damage raise make bake take use eat drink grow spread trigger block slow speed".split()
)
JOINTS = frozenset("and or but however although while".split())
RELATIVES = frozenset("that which who".split())
GOVERNORS = frozenset("to for against in with without into from on of by".split())
ARTICLES = frozenset("a an the this these those some any other another additional different similar its their his her your our".split())
CONTINUING = frozenset("other another additional different similar else any".split())
COMPARATIVES = frozenset("more less higher lower greater fewer better worse".split())
SINGULAR = frozenset("he she it this that".split())
#: An appeal to research at a claim's end says nothing that can be checked.
APPEAL = re.compile(r",?\s*according to (?:medical|scientific) research\s*$", re.I)
ITEM = re.compile(r"(?:^|\s)(?:[-*•]|\d+\.|\(\d+\))\s+")
WORD = re.compile(r"\S+")
#: The shortest segment that is kept beside others.
SHORTEST = 10


class Token(NamedTuple):
    text: str
    low: str
    tag: str
    depth: int
    comma: bool


def lemma(word: str) -> str:
    """The base form among VERBS of a verb's form, blank if it is none."""
    for end, into in (("", ""), ("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("d", ""), ("ied", "y"), ("ing", ""), ("ing", "e")):
        if word.endswith(end) and len(word) > len(end) + 1 and word[: len(word) - len(end)] + into in VERBS:
            return word[: len(word) - len(end)] + into
    return ""


def tagged(sentence: str) -> list[Token]:
    """Words with their tags: X auxiliary, V verb, J joint, R relative, P preposition, D determiner, C comparative, T than, N not, W any other.

    A form of a verb after a determiner or a preposition is a noun, and joints in brackets join nothing outside.
    """
    out: list[Token] = []
    depth = 0
    for text in WORD.findall(sentence):
        depth += sum(text.count(b) for b in "([{")
        low = text.strip("()[]{},.;:!?\"").lower()
        before = out[-1].tag if out else ""
        if low in AUXILIARIES:
            tag = "X"
        elif low in JOINTS and not depth:
            tag = "J"
        elif low in RELATIVES and not depth and before not in ("", "J", "V", "X"):
            tag = "R"
        elif low in GOVERNORS:
            tag = "P"
        elif low in ARTICLES:
            tag = "D"
        elif low in COMPARATIVES and before not in ("P", "X", "J"):
            tag = "C"
        else:
            tag = {"than": "T", "not": "N"}.get(low) or ("V" if lemma(low) and before not in ("D", "P", "C") else "W")
        out.append(Token(text, low, tag, depth, text.endswith(",")))
        depth = max(0, depth - sum(text.count(b) for b in ")]}"))
    return out


def said(tokens: list[Token]) -> str:
    """Tokens as text, without marks around and without joints in front."""
    while tokens and tokens[0].tag == "J":
        tokens = tokens[1:]
    return APPEAL.sub("", " ".join(t.text for t in tokens).strip(" ,.;:!?")).strip(" ,.")


def _verb(tokens: list[Token]) -> int:
    """The place of the first verb outside brackets, or the number of tokens."""
    return next((i for i, t in enumerate(tokens) if t.tag in "XV" and not t.depth), len(tokens))


def _is_clause(tokens: list[Token]) -> bool:
    return len(tokens) > 1 and _verb(tokens) < len(tokens)


def _subject(tokens: list[Token]) -> list[Token]:
    """What stands before the first verb, five words at most, up to any relative."""
    stop = next((i for i, t in enumerate(tokens) if t.tag == "R"), len(tokens))
    return tokens[: min(_verb(tokens), stop, 5)]


def _governed(tokens: list[Token]) -> list[Token]:
    """All up to the last verb or preposition that something follows; nothing if there is none."""
    at = max((i for i, t in enumerate(tokens[:-1]) if t.tag in "XVP" and not t.depth), default=-1)
    return tokens[: at + 1]


def _same_phrase(left: list[Token], right: list[Token], joint: str) -> bool:
    """Whether a joint holds two words of one noun phrase together: 'a healthy and balanced gut', 'a cake or other food'."""
    described = len(left) > 1 and left[-2].low in ("a", "an", "the")
    return left[-1].tag in "XV" or (joint == "or" and right[0].low in CONTINUING) or (described and len(right) <= (4 if joint == "and" else 3))


def _purpose(tokens: list[Token]) -> bool:
    return any(t.low in ("for", "to") for t in tokens)


def _members(tokens: list[Token]) -> list[list[Token]]:
    """The runs between joints, each from the second on with its joint in front."""
    out: list[list[Token]] = [[]]
    for i, t in enumerate(tokens):
        if t.tag == "J" and i and out[-1]:
            out.append([])
        out[-1].append(t)
    return [m for m in out if m and len(m) > (m[0].tag == "J")]


def folded(tokens: list[Token]) -> list[list[Token]]:
    """The segments of a sentence, from its members left to right."""
    first, *rest = _members(tokens) or [[]]
    out, now = [], first
    verbless = not _is_clause(tokens)
    for member in rest:
        joint, right = member[0].low, member[1:]
        head = _governed(now)
        if not _is_clause(now):
            # no verb yet: subjects that share one, or parts that each say what something is for
            apart = verbless and _purpose(now) and _purpose(right)
            nxt = right if apart else None
        elif now[-1].tag in "XV" and right[0].tag == "V":
            nxt = None  # two verbs with one object
        elif right[0].tag in "XV":
            nxt = _subject(now) + right
        elif _is_clause(right) or joint not in ("and", "or"):
            nxt = right
        else:
            nxt = head + right if head and not _same_phrase(now, right, joint) else None
        if nxt is None:
            now = now + member
        else:
            out.append(now)
            now = nxt
    return [*out, now]


def _subjects(tokens: list[Token]) -> list[str]:
    """'X, Y and Z do it': each subject with what is said, in what the first one is governed by."""
    at = _verb(tokens)
    lead = tokens[:at]
    if at == len(tokens) or not lead or lead[0].tag in "PJ" or not any(t.comma for t in lead) or not any(t.low in ("and", "or") and t.tag == "J" for t in lead):
        return []
    items: list[list[Token]] = [[]]
    for t in lead:
        if t.tag == "J":
            items.append([])
        else:
            items[-1].append(t)
            if t.comma:
                items.append([])
    items = [i for i in items if i]
    frame = _governed(items[0])
    whole = [i if n == 0 or any(t.tag == "P" for t in i) else frame + i for n, i in enumerate(items)]
    return [said([*(t._replace(text=t.text.rstrip(",")) for t in i), *tokens[at:]]) for i in whole]


def _denied(left: list[Token], right: list[Token]) -> str:
    """What is said on the left, denied of what stands on the right."""
    at = _verb(left)
    if at == len(left):
        return f"not {said(right)}"
    verb, before = left[at], [t.text for t in left[:at]]
    if verb.tag == "X":
        more = next((i for i in range(len(left) - 1, at, -1) if left[i].tag in "VP"), at)
        words = [*before, verb.text, "not", *(t.text for t in left[at + 1 : more + 1])]
    else:
        helper = "does not" if verb.low.endswith("s") or (at and left[at - 1].low in SINGULAR) else "do not"
        linked = [left[at + 1].text] if at + 1 < len(left) and left[at + 1].tag == "P" else []
        words = [*before, helper, lemma(verb.low), *linked]
    return said(tagged(" ".join([*words, said(right)])))


def _sentence(sentence: str) -> list[str]:
    if ";" in sentence:
        return [said(tagged(p)) for p in sentence.split(";")]
    tokens = tagged(sentence)
    while tokens and tokens[0].tag == "J":
        tokens = tokens[1:]
    spread = _subjects(tokens)
    if spread:
        return spread
    than = next((i for i, t in enumerate(tokens) if t.tag == "T" and not t.depth), 0)
    more = next((i for i, t in enumerate(tokens[:than]) if t.tag == "C" and not t.depth), 0)
    if 0 < more < than - 1 and than < len(tokens) - 1:
        return [said(tokens[:more]), said(tokens[more:])]
    against = next((i for i, t in enumerate(tokens) if i and t.tag == "N" and tokens[i - 1].comma and not t.depth), 0)
    if 0 < against < len(tokens) - 1:
        left, right = tokens[:against], tokens[against + 1 :]
        left = [*left[:-1], left[-1]._replace(text=left[-1].text.rstrip(","))]
        return [said(left), said(right) if _is_clause(right) and right[0].tag not in "D" else _denied(left, right)]
    segments = folded(tokens)
    if len(segments) == 1:
        # a lone sentence gives its relative clause to its subject
        at = next((i for i, t in enumerate(tokens) if t.tag == "R"), 0)
        head, tail = tokens[:at], tokens[at + 1 :]
        if head and tail and tail[0].tag in "XV" and _verb(head) < len(head) and _subject(head):
            return [said(head), said(_subject(head) + tail)]
    return [said(s) for s in segments]


def segments_of(claim: str | None) -> list[str]:
    """A claim's segments in order, each once; the claim itself if nothing else is left, none for a blank one."""
    if not claim or not claim.strip():
        return []
    kept: dict[str, str] = {}
    # items of a list first: their numbers end like sentences
    for sentence in (s for item in ITEM.split(" ".join(claim.split())) for s in re.split(r"(?<=[.!?])\s+", item)):
        for segment in _sentence(sentence):
            if len(segment) >= SHORTEST:
                kept.setdefault(segment.lower(), segment)
    return list(kept.values()) or [x for x in [said(tagged(claim))] if x]


def segmented(claims: DataFrame, id_col: str = "claim_id", text_col: str = "claim") -> DataFrame:
    """(id, part, segment): the segments of each claim, numbered from 1; blank claims have none."""
    kind = claims.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments_of(t) for t in batch.column(1).to_pylist()]
            owner = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
            parts = pa.array([j + 1 for s in found for j in range(len(s))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), parts, pa.array([x for s in found for x in s], pa.string())], names=["id", "part", "segment"])

    return claims.select(claims[id_col].alias("id"), claims[text_col].alias("claim")).mapInArrow(run, f"id {kind}, part int, segment string").withColumnRenamed("id", id_col)
