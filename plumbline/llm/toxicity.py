"""Toxicity by a subsequence string kernel with Nystrom landmarks and a linear support vector machine.

Two strings are alike by the subsequences of three letters that they share,
each weighted by how far it is stretched: decay ** span, spans up to MAX_SPAN.
An insult with letters put in, left out or set apart keeps most of them.
Texts are compared as their words: the kernel of a text and a landmark, a word
of a labelled sentence, is the sum of the kernels of the text's words, where
words less alike than FLOOR count as nothing. The landmarks' own kernel matrix
turns these sums into Nystrom coordinates x, divided by SOFT + |x|: the kernel
saturates, so that one bent insult weighs almost as much as several plain ones.
On that the machine is linear; its margins are made probabilities by a logistic
fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.exchange import distinct
from plumbline.llm.tokens import Words, shingle_sets, text_chunks, tidy

DECAY, MAX_SPAN, FLOOR = 0.7, 6, 0.5
#: The kernel is this power of the normalised one, a kernel too, which parts the very alike from the rather alike.
POWER = 2
#: Landmarks, and the least number of labelled texts that hold a landmark.
LANDMARKS, LEAST_TEXTS = 48, 3
#: Frequent words of other texts, among which each landmark's nearest is looked for as a landmark too.
OTHERS = 20_000
#: What is added to the length of a text's coordinates before it divides them.
SOFT = 0.2
#: Bound of the labelled sample that the machine is fitted on: rows with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000
#: The pairs of steps that spread three letters over at most MAX_SPAN places.
STEPS = [(g, h) for g in range(1, MAX_SPAN) for h in range(1, MAX_SPAN - g)]


#: Letters and digits as small numbers, 0 for what stands between them. Of a longer
#: character the last byte counts; the few that then fall together count as one letter.
KLASS = np.zeros(256, dtype=np.int64)
KLASS[48:58] = np.arange(1, 11)
KLASS[65:91] = KLASS[97:123] = np.arange(11, 37)
KLASS[128:192] = 37 + np.arange(128, 192) % 27


def letters_of(raw: np.ndarray) -> np.ndarray:
    """Each byte's letter, 0 for bytes that are none: gaps have no width. Upper case is lowered, in Latin-1 too."""
    after_c3 = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw < 0x9F)
    out = KLASS[np.where(after_c3, raw + 32, raw)]
    out[:-1][(raw[1:] & 0xC0) == 0x80] = 0  # not the last byte of its character
    return out


#: Letters that stand before and after every word.
OPEN, CLOSE = 62, 63


def bounded(letters: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and owners with OPEN and CLOSE around each of the n owners' words."""
    all_owners = np.concatenate([np.arange(n), owner, np.arange(n)])
    order = np.argsort(all_owners, kind="stable")
    return np.concatenate([np.full(n, OPEN), letters, np.full(n, CLOSE)])[order], all_owners[order]


def subsequences(letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight) of all stretched three-letter subsequences; ``owner``: whose letter it is, in order."""
    parts = []
    for g, h in STEPS:
        n = len(letters) - g - h
        if n > 0:
            same = np.flatnonzero(owner[:n] == owner[g + h :])
            code = letters[same] * 4096 + letters[same + g] * 64 + letters[same + g + h]
            parts.append((owner[same], code, np.full(len(same), DECAY ** (g + h + 1))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def norms(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Square root of each owner's kernel with itself."""
    key, at = np.unique(owner * (1 << 18) + code, return_inverse=True)
    sums = np.bincount(at, weights=weight, minlength=len(key))
    return np.sqrt(np.bincount(key >> 18, weights=sums**2, minlength=n))


class Landmarks:
    """Landmark strings, and the likenesses of whole batches of texts to them."""

    #: Words whose likenesses a process remembers at most; then it starts anew.
    REMEMBERED = 300_000

    def __init__(self, strings: list[str]):
        self.strings, n = strings, len(strings)
        raw = [np.frombuffer(x.encode(), dtype=np.uint8) for x in strings]
        letters = [(k := letters_of(r))[k > 0] for r in raw]
        owner = np.repeat(np.arange(n), [len(x) for x in letters])
        o, code, weight = subsequences(*bounded(np.concatenate([*letters, np.zeros(0, np.int64)]), owner, n))
        size = norms(o, code, weight, n)
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), n))
        np.add.at(self.table, (at, o), weight / np.maximum(size[o], 1e-12))
        self.place = np.full(1 << 18, -1, dtype=np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        # landmarks of like spelling in groups: the largest weight of a group bounds all of its landmarks
        groups = np.array_split(np.argsort(strings), max(1, n // 6)) if n else []
        self.most = np.stack([self.table[:, g].max(axis=1) for g in groups], axis=1) if n and len(self.codes) else np.zeros((0, 1))
        gram = (self.table.T @ self.table) ** POWER
        values, vectors = np.linalg.eigh(gram) if n else (np.zeros(0), np.zeros((0, 0)))
        keep = values > 1e-3
        self.map = vectors[:, keep] / np.sqrt(values[keep])
        self.gram = gram
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.int64)
        self.row = np.zeros(0, dtype=np.int64)
        self.rows = np.zeros((1, len(self.strings)))

    def of_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Likenesses of the words at these places of ``raw``, those under FLOOR as 0."""
        size = end - start
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(begin[-1]) - np.repeat(begin[:-1] - start, size)
        word = np.repeat(np.arange(len(start)), size)
        letters = letters_of(raw[at])
        real = letters > 0
        letters, word = bounded(letters[real], word[real], len(start))
        o, code, weight = subsequences(letters, word)
        out = np.zeros((len(start), len(self.strings)))
        hit = np.flatnonzero(self.place[code] >= 0)
        ho, hc, hw = o[hit], self.place[code[hit]], weight[hit]
        order = np.argsort(ho, kind="stable")
        ho, hc, hw = ho[order], hc[order], hw[order]
        # a word's norm is at least that of its subsequences if all of them differed: most words fall here
        low = FLOOR * np.sqrt(np.bincount(o, weights=weight**2, minlength=len(start)))
        likely = np.zeros(len(start), dtype=bool)
        if len(ho):
            first = np.flatnonzero(np.diff(ho, prepend=-1))
            bound = np.add.reduceat(self.most[hc] * hw[:, None], first, axis=0).max(axis=1)
            likely[ho[first]] = bound >= low[ho[first]]
        few = np.flatnonzero(likely)
        if not len(few):
            return out
        some = likely[ho]
        ho, hc, hw = ho[some], hc[some], hw[some]
        first = np.flatnonzero(np.diff(ho, prepend=-1))
        dots = np.add.reduceat(self.table[hc] * hw[:, None], first, axis=0)
        mine = likely[o]
        size = norms(o[mine], code[mine], weight[mine], len(start))
        likeness = dots / size[ho[first]][:, None]
        out[ho[first]] = np.where(likeness >= FLOOR, likeness**POWER, 0.0)
        return out

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """A row of kernel values for each text: the sum over its words, and over runs of single letters put together."""
        out = np.zeros((len(texts), len(self.strings)))
        words = Words(texts)
        if not self.strings or not len(words.start):
            return out
        doc = np.repeat(np.arange(len(texts)), words.count)
        value, first, inverse = distinct((words.hashes() >> np.uint64(2)).astype(np.int64), 62)
        if len(self.known) > self.REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, value)
        old = np.zeros(len(value), dtype=bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == value[inside]
        new = np.flatnonzero(~old)
        got = self.of_words(words.bytes, words.start[first[new]], words.end[first[new]])
        alike = np.flatnonzero(got.any(axis=1))
        row = np.zeros(len(new), dtype=np.int64)
        row[alike] = len(self.rows) + np.arange(len(alike))
        self.rows = np.concatenate([self.rows, got[alike]])
        self.known, self.row = np.insert(self.known, place[new], value[new]), np.insert(self.row, place[new], row)
        mine = self.row[np.searchsorted(self.known, value)][inverse]
        hit = np.flatnonzero(mine)
        np.add.at(out, doc[hit], self.rows[mine[hit]])
        # runs of three or more single letters
        single = (words.end - words.start == 1) & (KLASS[words.bytes[words.start]] > 10)
        fresh = np.ones(len(single) + 1, dtype=bool)
        fresh[1:-1] = (single[1:] != single[:-1]) | (doc[1:] != doc[:-1])
        edges = np.flatnonzero(fresh)
        runs = np.flatnonzero(single[edges[:-1]] & (np.diff(edges) >= 3))
        if len(runs):
            lo, hi = edges[runs], edges[runs + 1]
            np.add.at(out, doc[lo], self.of_words(words.bytes, words.start[lo], words.end[hi - 1]))
        return out


def coordinates(marks: Landmarks, texts: list[str | None]) -> np.ndarray:
    """The texts' places on which the machine is linear."""
    x = marks.of_texts(texts) @ marks.map
    return x / (SOFT + np.linalg.norm(x, axis=1, keepdims=True))


_landmarks: dict[tuple[str, ...], Landmarks] = {}


def landmarks(strings: list[str]) -> Landmarks:
    """The process's own, with what it remembers of earlier batches."""
    if tuple(strings) not in _landmarks:
        _landmarks.clear()
        _landmarks[tuple(strings)] = Landmarks(strings)
    return _landmarks[tuple(strings)]


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scorer(self):
        marks = landmarks(self.landmarks)

        def score(texts: list[str | None]) -> np.ndarray:
            margin = coordinates(marks, texts) @ self.weights + self.bias if self.landmarks else np.full(len(texts), self.bias)
            return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

        return score


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 600) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted alike, by accelerated gradient steps."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    xb = np.hstack([x, np.ones((len(x), 1))])
    lam = np.append(np.full(x.shape[1], 1e-4 / c), 0.0)
    step = 1 / (2 * (weight[:, None] * xb**2).sum() + lam.max())
    w, v, t = np.zeros(xb.shape[1]), np.zeros(xb.shape[1]), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - sign * (xb @ v))
        grad = -2 * xb.T @ (weight * sign * slack) + lam * v
        nxt = v - step * grad
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by damped Newton steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    m = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ [a, b], -30, 30)))
        grad = m.T @ (p - goal) + np.array([1e-3 * a, 0])
        hess = (m * (p * (1 - p))[:, None]).T @ m + np.diag([1e-3, 1e-6])
        d = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def _words_of_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (toxic, word), each word of a text once."""
    for batch in batches:
        toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        y, out = [], []
        for t, text in zip(toxic, texts, strict=True):
            found = {"".join(c for c in w.lower() if c.isalnum()) for w in (text or "").split()}
            found = [w for w in found if 3 <= len(w) <= 24]
            y += [t] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.string())], names=["toxic", "word"])


def _with_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, toxic, text) with the least hash of the text's shingles: near copies mostly share it."""
    for batch in batches:
        sets = shingle_sets(Words(batch.column(2).to_pylist()), 3)
        mark = pa.array([int(s[0]) if len(s) else 0 for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, mark], names=["doc", "toxic", "text", "mark"])


def fold(id_value: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (3, 1), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold; near copies count once.

    The sample's size bounds all that reaches the driver or is broadcast. Labels
    that are null, or of null ids, are left out; of labels repeated for an id the
    largest counts; of texts repeated for it each. Without a text of either
    class, or an empty table, the model gives every text the share of toxic rows,
    0.5 for none. Ties among words go by spelling.
    """
    n, out = held_out
    usable = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc").isNotNull())
    usable = usable.filter(fold(F.col("doc"), n) != out).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc"), "doc").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    known = texts.join(F.broadcast(sample), "doc").select("doc", "toxic", "text")
    known = known.mapInArrow(_with_mark, f"doc {kind}, toxic int, text string, mark long")
    known = known.groupBy("mark", "toxic").agg(F.min_by("text", F.struct("doc", "text")).alias("text")).persist()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n1 or not n0:
        known.unpersist()
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model([], np.zeros(0), 0.0, 0.0, math.log(share / (1 - share)))
    counted = known.select("toxic", "text").mapInArrow(_words_of_labelled, "toxic int, word string")
    counted = counted.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    best = counted.filter((F.col("a") >= LEAST_TEXTS) & (odds > 2)).select("word", "a", "b", (odds * F.sqrt("a")).alias("w")).orderBy(F.desc("w"), "word").limit(30 * LANDMARKS)
    top = best.collect()
    ranked = [r["word"] for r in top]
    gram, chosen = Landmarks(ranked).gram, []
    for i in range(len(ranked)):  # the strongest words that are not too much alike
        if len(chosen) < LANDMARKS and all(gram[i, j] < 0.4 for j in chosen):
            chosen.append(i)
    strings = [ranked[i] for i in chosen]
    plain = counted.filter((F.col("b") >= LEAST_TEXTS) & (odds < 0.7)).orderBy(F.desc("b"), "word").limit(OTHERS).select("word").collect()
    if plain and strings:
        words = Words([r["word"] for r in plain])
        near = Landmarks(strings).of_words(words.bytes, words.start, words.end)
        strings += sorted({plain[i]["word"] for i, k in zip(near.argmax(axis=0), near.max(axis=0), strict=True) if k > 0} - set(strings))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = landmarks(strings)
        for rows in batches:
            yield pd.DataFrame({"toxic": rows["toxic"], "x": list(coordinates(own, rows["text"].tolist()))})

    got = known.select("toxic", "text").mapInPandas(features, "toxic int, x array<double>").toPandas()
    known.unpersist()
    y = (got["toxic"].to_numpy() == 1).astype(int)
    x = np.array(got["x"].tolist()).reshape(len(y), -1)
    weights, bias = fit_svm(x, y)
    slope, shift = fit_logistic(x @ weights + bias, y)
    return Model(strings, weights, bias, slope, shift)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Null text counts as empty; empty texts get the score of a text without any
    likeness. The score sees the text alone. Rows are scored one by one, so
    repeated rows agree and nothing is shuffled; other columns are ignored, and an
    empty table gives no rows. Without labels of both classes all scores are the share of toxic rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = [score(texts) for _, texts in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*values, np.zeros(0)]))], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, score double")
    n, out = held_out
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id"), n) == out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
