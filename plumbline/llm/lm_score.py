"""LM scoring with a weighted backoff automaton of order 3 that is never in one place.

States are the contexts seen in training; the root is the empty one. An arc
reads a word and carries the smoothed probability of its n-gram; a state's
failure arc reads nothing, carries the state's backoff weight and leads to the
context without its first word. Every word, and every pair and triple that
training texts hold ``least`` times or more, is an arc, so the model grows with
the corpus; ``least=1`` makes an arc of every n-gram. The tests hold a plain
version of it in memory.

Texts are read four times, in chunks of a few megabytes. First, each chunk asks
for the corpus-wide counts of its distinct words and pairs, sending its own
along (see ``exchange``). Then it asks for those of the triples whose two pairs
are kept, as others cannot be; then for what its states spend on their arcs.
Last, each text is traversed from left to right, the state being the last two
words that are a state. Memory is bounded by a chunk or a part of the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.exchange import ANSWERED, ASKED, answers_of, asked, distinct, exchange, key_bits, keys_of, met, same_splits
from plumbline.llm.tokens import Words, mix, text_chunks, tidy
from plumbline.session import shared_dir

#: What is added to each count of the base, and taken off each kept n-gram's count.
ADD, DISCOUNT = 0.1, 0.5
#: Pairs and triples seen less often have no arc of their own, unless score_texts() is told otherwise.
LEAST = 2
#: The end of a text, as a word.
END = np.int64(-1)
#: Bytes of a chunk, and of the text whose n-grams are summed in one part.
CHUNK, PART = 1 << 22, 16 << 20
#: Kinds of keys.
WORD, PAIR, TRIPLE = 0, 1, 2


def fold(id_value: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Stream:
    """A batch's tokens: 63-bit word hashes, END after each text; ``at[i]:at[i + 1]`` are text i's."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts)
        count = words.count + 1
        self.at = np.concatenate([[0], np.cumsum(count)])
        self.tokens = np.full(self.at[-1], END)
        body = np.ones(len(self.tokens), dtype=bool)
        body[self.at[1:] - 1] = False
        self.tokens[body] = (words.hashes() >> np.uint64(1)).astype(np.int64)
        self.begin = np.zeros(len(self.tokens), dtype=bool)
        self.begin[self.at[:-1]] = True
        self.text = np.repeat(np.arange(len(count)), count)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first) * np.uint64(0xD6E8FEB86659FD93) + second


class Grams:
    """A chunk's distinct n-grams.

    ``keys[kind]``: sorted keys. ``at[kind]``: at each token, the place there of
    the word, pair or triple that ends with it; -1 for none. ``where[kind]``: a
    token that each n-gram ends with.
    """

    def __init__(self, stream: Stream, bits: int, least: int = LEAST):
        self.stream, self.bits, self.least = stream, bits, least
        self.keys, self.at, self.where = {}, {}, {}
        tokens = stream.tokens.view(np.uint64)
        self._put(WORD, np.arange(len(tokens)), tokens)
        two = np.flatnonzero(~stream.begin)
        self.pair_hash = np.zeros(len(tokens), dtype=np.uint64)
        self.pair_hash[two] = _joined(tokens[two - 1], tokens[two])
        self._put(PAIR, two, self.pair_hash[two])

    def _put(self, kind: int, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.keys[kind], first, inverse = distinct(keys_of(hashes, self.bits), self.bits)
        self.where[kind] = ends[first]
        self.at[kind] = np.full(len(self.stream.tokens), -1, dtype=np.int64)
        self.at[kind][ends] = inverse

    def before(self, kind: int) -> np.ndarray:
        """At each token, the place of the n-gram that ends just before it in the same text."""
        out = np.append(-1, self.at[kind][:-1])
        out[self.stream.begin] = -1
        return out

    def with_triples(self, pair_counts: np.ndarray) -> Grams:
        """Adds the triples whose two pairs are kept."""
        pair, earlier = self.at[PAIR], self.before(PAIR)
        three = np.flatnonzero((pair >= 0) & (earlier >= 0))
        three = three[(pair_counts[pair[three]] >= self.least) & (pair_counts[earlier[three]] >= self.least)]
        self._put(TRIPLE, three, _joined(self.pair_hash[three - 1], self.stream.tokens.view(np.uint64)[three]))
        return self

    def counts(self, kind: int, training: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the texts that are for training."""
        at = self.at[kind][(self.at[kind] >= 0) & training[self.stream.text]]
        return np.bincount(at, minlength=len(self.keys[kind]))

    def spent(self, kind: int, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the arcs that this chunk asked for first take from the contexts one word shorter, twice so that it is whole."""
        arcs = np.flatnonzero(first & (counts >= self.least))
        context = self.at[kind - 1][self.where[kind][arcs] - 1]
        return np.bincount(context, weights=2 * counts[arcs] - 2 * DISCOUNT, minlength=len(self.keys[kind - 1])).astype(np.int64)


def traverse(grams: Grams, counts: dict[int, np.ndarray], spent: dict[int, np.ndarray], norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(base, probability) of every token, read from left to right.

    The state before a token is the pair that ends there, else the word, else the
    root; a token falls back from it along failure arcs, whose weights are what
    the states' arcs leave.
    """

    def step(state: int, lower: np.ndarray) -> np.ndarray:
        before, arc = grams.before(state), grams.at[state + 1]
        c, n = counts[state + 1], np.maximum(counts[state], 1)
        out = np.where(before >= 0, (1 - spent[state] / n)[before] * lower, lower)
        taken = np.flatnonzero(arc >= 0)
        taken = taken[c[arc[taken]] >= grams.least]
        out[taken] += (c[arc[taken]] - DISCOUNT) / n[before[taken]]
        return out

    base = (counts[WORD][grams.at[WORD]] + ADD) / norm
    return base, step(PAIR, step(WORD, base))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, part_bytes: int = PART, chunk_bytes: int = CHUNK, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose fold (crc32 of the id as text, modulo
    ``folds``) is not ``held``. Words are found between ASCII white space, A-Z
    lower-cased; every text ends with one end token. base_score adds
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score is the
    automaton's log10 probability, which sums to one over all next tokens. Pairs
    and triples seen fewer than ``least`` times have no arc of their own; with 1
    all have, at the cost of larger questions.

    Null text counts as empty: the end token alone. A null id is in fold 0.
    Repeated rows are counted and scored each. If nothing is left to train on,
    all tokens have count 0. An empty table gives no rows; other columns are
    ignored. ``docs`` is read several times and must give its rows in the same
    order each time, as a scan does; if not, an error says so.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), folds) != held).alias("training"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    class Known:
        """The answers that a task has got, read along with its chunks."""

        def __init__(self, task: int, *wanted: tuple[str, int]):
            self.answers = {(name, k): answers_of(f"{folder}/{name}", k, task) for name, k in wanted}

        def of(self, name: str, k: int, chunk: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            return met(self.answers[name, k], chunk, n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Grams]]:
        number = 0
        for batch in batches:
            for part, texts in text_chunks(batch.column(2), chunk_bytes):
                yield number, batch.slice(part.start, part.stop - part.start), Grams(Stream(texts), bits, least)
                number += 1

    def training_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).to_numpy(zero_copy_only=False).astype(bool)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch, grams in each(batches):
            for k in (WORD, PAIR):
                yield asked(k, task, number, grams.keys[k], grams.counts(k, training_of(batch)), parts, bits)

    def ask_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known = Known(task, ("pairs", PAIR))
        for number, batch, grams in each(batches):
            grams.with_triples(known.of("pairs", PAIR, number, len(grams.keys[PAIR]))[0])
            yield asked(TRIPLE, task, number, grams.keys[TRIPLE], grams.counts(TRIPLE, training_of(batch)), parts, bits)

    def counted(known: Known, number: int, grams: Grams) -> tuple[dict, dict]:
        """Counts by kind, and which n-grams this chunk was the first to ask for."""
        got = {k: known.of("pairs", k, number, len(grams.keys[k])) for k in (WORD, PAIR)}
        grams.with_triples(got[PAIR][0])
        got[TRIPLE] = known.of("triples", TRIPLE, number, len(grams.keys[TRIPLE]))
        return {k: c for k, (c, _) in got.items()}, {k: f for k, (_, f) in got.items()}

    def ask_spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known = Known(task, ("pairs", WORD), ("pairs", PAIR), ("triples", TRIPLE))
        for number, _, grams in each(batches):
            counts, first = counted(known, number, grams)
            for k in (WORD, PAIR):
                states = np.flatnonzero(counts[k] >= least)
                yield asked(k, task, number, grams.keys[k][states], grams.spent(k + 1, counts[k + 1], first[k + 1])[states], parts, bits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known = Known(task, ("pairs", WORD), ("pairs", PAIR), ("triples", TRIPLE), ("spent", WORD), ("spent", PAIR))
        for number, batch, grams in each(batches):
            counts, _ = counted(known, number, grams)
            spent = {}
            for k in (WORD, PAIR):
                states = np.flatnonzero(counts[k] >= least)
                spent[k] = np.zeros(len(counts[k]))
                spent[k][states] = known.of("spent", k, number, len(states))[0] / 2
            base, p = traverse(grams, counts, spent, norm)
            at = grams.stream.at[:-1]
            seen = np.add.reduceat((counts[WORD][grams.at[WORD]] > 0).astype(np.int64), at)
            columns = [pa.array(np.diff(grams.stream.at)), pa.array(seen), pa.array(np.add.reduceat(np.log10(base), at)), pa.array(np.add.reduceat(np.log10(p), at))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "training", "n_tokens", "n_known", "base_score", "score"])

    with same_splits(spark):
        size = rows.agg(F.sum(F.octet_length("text") + 1).alias("b")).first()["b"] or 0
        parts, bits = max(1, -(-size // part_bytes)), key_bits(size)
        exchange(rows.mapInArrow(tidy(ask_pairs), ASKED), f"{folder}/pairs", bits, least)
        words = spark.read.schema(ANSWERED).parquet(f"{folder}/pairs").filter(F.col("kind") == WORD)
        got = words.agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
        total, known_words = got["n"] or 0, got["v"] or 0
        norm = total + ADD * (known_words + 1)
        exchange(rows.mapInArrow(tidy(ask_triples), ASKED), f"{folder}/triples", bits, least)
        exchange(rows.mapInArrow(tidy(ask_spent), ASKED), f"{folder}/spent", bits)
        rows.mapInArrow(tidy(score), f"id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double").write.parquet(f"{folder}/scores")
    out = spark.read.parquet(f"{folder}/scores")
    return out.select(F.col("id").alias(id_col), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
