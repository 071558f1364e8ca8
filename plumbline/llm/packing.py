"""Lexical retrieval packing: a sharded BM25 index chooses which documents share a window.

Documents are dealt to shards of bounded size so that alike ones meet: each has
a sketch, the words that a draw weighted by their rarity in the whole corpus
picks, and shards are runs of the corpus in the order of sketches. Inside a
shard, a seed document asks the shard's inverted index with all its words for
its nearest unused neighbours, which follow it until the window is full; the
document that fills it is cut there and seeds the next window. What remains at
the ends of many shards is laid out together; only what remains there goes
into sequences whose lengths are powers of two, which take no padding.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.exchange import ASKED, answers_of, asked, distinct, exchange, key_bits, keys_of, met, same_splits
from plumbline.llm.ranges import with_running_sum
from plumbline.llm.tokens import SPACE, Words, mix, text_chunks, tidy, tidy_group
from plumbline.session import open_fs, shared_dir

#: Text of a shard on average, and shards whose remainders are laid out together.
SHARD_BYTES, TAIL_SHARDS = 4 << 20, 1024
K1, B = 1.2, 0.75
#: Words of a sketch, and how much rarity counts in their draw: the power of the IDF.
SKETCH, RARITY = 3, 3
#: Bytes of a chunk, and of the text whose words are counted in one part.
CHUNK, PART = 1 << 22, 32 << 20


#: The letters that byte-level vocabularies write bytes of Latin letters as: printable Latin-1
#: characters stand for themselves, all other bytes follow from 256 in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Lower-case Latin letters in UTF-8, read as Latin-1.
LATIN_WORD = re.compile("(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class WordTokenizer:
    """Ids of whole texts from the ids of their white-space-separated pieces, each encoded once.

    Right for vocabularies that lower case, whose pre-tokenizer drops white space
    and parts letters from punctuation, as no token then reaches over either.
    Pieces are remembered by 62-bit hash.
    """

    #: Pieces remembered at most; then it starts anew.
    REMEMBERED = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        probe = ["plain", "mêlé", "straße"]
        self.plain = False
        self.plain = all(list(self._encode_new([x])[0]) == [t.id for t in self.encoder.model.tokenize(x.translate(BYTE_LETTERS))] for x in (x.encode().decode("latin-1") for x in probe))
        self.specials = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.int64)
        self.place = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many are each piece's. Pieces are UTF-8 read as Latin-1."""
        out: list[list[int] | None] = [None] * len(pieces)
        if self.plain:
            # lower-case Latin letters pass the normaliser unchanged: the merges alone are left to do
            merge, byte = self.encoder.model.tokenize, BYTE_LETTERS
            for i, x in enumerate(pieces):
                if LATIN_WORD(x):
                    out[i] = [t.id for t in merge(x if x.isascii() else x.translate(byte))]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for lo in range(0, len(rest), 5000):
            part = rest[lo : lo + 5000]
            for i, e in zip(part, self.encoder.encode_batch_fast([pieces[i].encode("latin-1").decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter(chain.from_iterable(out), dtype=np.uint32, count=int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """(words, distinct-word number of each, all ids in order, number of ids of each word)."""
        words = Words(texts, SPACE)
        whole = words.bytes.tobytes()
        if any(c.lower().encode() in whole for c in self.specials):
            words = Words(texts, SPACE, lower=False)
        else:
            words.split_punctuation()
        value, at, inverse = distinct((words.hashes() >> np.uint64(2)).astype(np.int64), 62)
        if len(self.known) > self.REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, value)
        old = np.zeros(len(value), dtype=bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == value[inside]
        new = np.flatnonzero(~old)
        if len(new):
            letters = words.bytes.tobytes().decode("latin-1")
            flat, sizes = self._encode_new([letters[a:b] for a, b in zip(words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)])
            where = len(self.first) - 1 + np.arange(len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat])
            self.known, self.place = np.insert(self.known, place[new], value[new]), np.insert(self.place, place[new], where)
        mine = self.place[np.searchsorted(self.known, value)][inverse] if len(value) else np.zeros(0, np.int64)
        size = self.first[mine + 1] - self.first[mine]
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(begin[-1]) - np.repeat(begin[:-1] - self.first[mine], size)]
        return words, inverse, flat, size


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The process's own, with what it remembers of earlier shards."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Index:
    """BM25 over one shard: postings by term, and each document's terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: int):
        key = term * n + doc
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        tf = np.diff(np.append(new, len(key)))
        self.term, self.doc = np.divmod(key[new], max(n, 1))
        del key, new
        length = np.bincount(doc, minlength=n)
        terms = int(self.term[-1]) + 1 if len(self.term) else 0
        self.df = np.bincount(self.term, minlength=terms)
        idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        # a term of one document finds nobody
        ask = np.flatnonzero(self.df[self.term] > 1)
        ask = ask[np.argsort(self.doc[ask], kind="stable")]
        self.asks = self.term[ask]
        self.start = np.searchsorted(self.doc[ask], np.arange(n + 1))

    def scores(self, seed: int, n: int) -> np.ndarray:
        """Every document's BM25 score for all terms of the seed, each asked once."""
        terms = self.asks[self.start[seed] : self.start[seed + 1]]
        size = self.df[terms]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[terms] - end + size, size)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=n)


def order_documents(sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, window: int) -> list[int]:
    """The shard's documents in the order that they are laid out; ties of scores by place."""
    n = len(sizes)
    index = Index(doc, term, n)
    used, order, room, seed, at = np.zeros(n, dtype=bool), [], window, -1, 0
    while len(order) < n:
        if seed < 0:
            while used[at]:
                at += 1
            seed = at
            used[seed] = True
            order.append(seed)
            room -= sizes[seed]
        if room > 0:
            score = index.scores(seed, n)
            score[used] = 0
            hit = np.flatnonzero(score)
            best = hit[np.argsort(-score[hit], kind="stable")]
            # as many of the best as it takes to fill the window
            taken = best[: int(np.searchsorted(np.cumsum(sizes[best]), room)) + 1]
            used[taken] = True
            order.extend(taken.tolist())
            room -= int(sizes[taken].sum())
        # the document that is cut at the window's end asks for the next one; else a fresh seed
        seed = order[-1] if room < 0 else -1
        if room <= 0:
            room = window - (-room) % window
            if room == window and seed >= 0 and sizes[seed] >= window:
                seed = -1
    return order


def lay_out(sizes: list[int], window: int, tail: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents put end to end.

    Sequences are ``window`` long; the remainder is one shorter sequence or, at
    the ``tail`` of all, split into powers of two.
    """
    total = int(sum(sizes))
    rest = total % window
    lengths = [window] * (total // window)
    power = window
    while rest and tail:
        power //= 2
        if rest >= power:
            lengths.append(power)
            rest -= power
    if rest:
        lengths.append(rest)
    sequence, offset = 0, 0
    for d, size in enumerate(sizes):
        start = 0
        while start < size:
            take = min(size - start, lengths[sequence] - offset)
            yield d, start, take, sequence, offset
            start += take
            offset += take
            if offset == lengths[sequence]:
                sequence, offset = sequence + 1, 0


class Vocabulary:
    """A chunk's words: its distinct ``keys``, and each text's distinct words as places in them, text by text."""

    def __init__(self, texts: list[str], bits: int):
        words = Words(texts)
        self.keys, _, place = distinct(keys_of(words.hashes(), bits), bits)
        self.bytes = np.diff(words.base)
        pair = np.repeat(np.arange(len(texts)), words.count) * max(1, len(self.keys)) + place
        pair.sort()
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        self.text, self.place = np.divmod(pair, max(1, len(self.keys)))

    def lowest(self, value: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """k times: (texts, places of the word of the next lowest finite value)."""
        value = value[self.place]
        begin = np.flatnonzero(np.append(True, self.text[1:] != self.text[:-1])[: len(self.text)])
        own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(self.text))))
        for _ in range(k):
            least = np.minimum.reduceat(value, begin) if len(begin) else value
            at = np.flatnonzero((value == least[own]) & np.isfinite(value))
            # of equal values the first
            at = at[np.append(True, own[at][1:] != own[at][:-1])[: len(at)]]
            yield self.text[at], self.place[at]
            value[at] = np.inf


def _draw(h: np.ndarray) -> np.ndarray:
    """A word's exponential draw, the same wherever it stands."""
    u = (mix(h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64)
    return -np.log((u + 0.5) / (1 << 53))


def _sketches(rows: DataFrame, n: int, size: int, folder: str) -> DataFrame:
    """(task, row, bytes, k0, k1, ..) for ``rows`` (id, text), n in number: the SKETCH words of lowest draw / IDF ** RARITY.

    Words of one document or of more than an eighth of all cannot be drawn.
    """
    parts, bits = max(1, -(-size // PART)), key_bits(size)
    most = max(2, n // 8)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, texts in text_chunks(batch.column(1), CHUNK):
                own = Vocabulary(texts, bits)
                yield asked(0, task, number, own.keys, np.bincount(own.place, minlength=len(own.keys)), parts, bits)
                number += 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, row = TaskContext.get().partitionId(), 0, 0
        answers = answers_of(f"{folder}/words", 0, task)
        for batch in batches:
            for _, texts in text_chunks(batch.column(1), CHUNK):
                own = Vocabulary(texts, bits)
                m = len(texts)
                df, _ = met(answers, number, len(own.keys))
                value = np.full(len(df), np.inf)
                can = np.flatnonzero((df > 1) & (df <= most))
                value[can] = _draw(own.keys[can]) / np.log(1 + n / df[can]) ** RARITY
                k = []
                for text, place in own.lowest(value, SKETCH):
                    key, none = np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
                    key[text], none[text] = own.keys[place], False
                    k.append(pa.array(key, mask=none))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task)), pa.array(np.arange(row, row + m)), pa.array(own.bytes), *k], names=["task", "row", "bytes", *(f"k{i}" for i in range(SKETCH))])
                number, row = number + 1, row + m

    exchange(rows.mapInArrow(tidy(ask), ASKED), f"{folder}/words", bits)
    return rows.mapInArrow(tidy(sketch), "task long, row long, bytes long, " + ", ".join(f"k{i} long" for i in range(SKETCH)))


def _store_shards(sketched: DataFrame, shard_bytes: int, folder: str) -> None:
    """Write (row, shard) by task: shards are runs of about shard_bytes in the order of the sketches."""
    order = [*(f"k{i}" for i in range(SKETCH)), "task", "row"]
    placed = with_running_sum(sketched, order, "bytes", "before").select("task", "row", F.floor(F.col("before") / shard_bytes).alias("shard"))
    placed.repartition("task").sortWithinPartitions("task", "row").write.partitionBy("task").parquet(f"{folder}/shards")


def _shards_of(folder: str, task: int) -> np.ndarray:
    """The shards of a task's rows, in their order."""
    fs, root = open_fs(f"{folder}/shards/task={task}")
    out = []
    for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet")):
        with fs.open_input_file(f) as source:
            out.append(pq.read_table(source, columns=["shard"]).column(0).to_numpy())
    return np.concatenate(out)


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def _pieces(ids: pa.Array, rows: list[tuple], held: list[bytes | None]) -> pa.Table:
    """Rows (place of the id, start, length, crc, doc_tokens, sequence, offset) as a table, with the ids of pieces still to be laid out."""
    cols = list(zip(*rows, strict=True)) or [()] * 7
    last: dict[int, int] = {}
    for sequence, offset, length in zip(cols[5], cols[6], cols[2], strict=True):
        last[sequence] = offset + length
    arrays = [pa.array(c, pa.int64()) for c in cols[1:]]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "held"]
    return pa.table([ids.take(pa.array(cols[0], pa.int64())), *arrays, pa.array([last[s] for s in cols[5]], pa.int64()), pa.array(held, pa.binary())], names=names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document's ids are those of its text, then ``end_id``; a null text is an
    empty one, of that id alone. Every id lies in exactly one piece. window is a
    power of two. Rows are documents each, repeated ones too, and null ids are
    ids like others. padded_length is the length of the sequence: nothing is
    padded, as remainders have lengths that are powers of two. An empty table
    gives no rows; other columns are ignored.

    The number of shards follows the bytes of text, so a shard's memory does
    not grow with the table; texts cross the network once. Neighbours are
    searched inside a shard, with its own document frequencies; what a shard
    leaves over, less than a window, is cut anew with the remainders of up to
    TAIL_SHARDS shards. ``docs`` is read several times and must give its rows in
    the same order each time, as a scan does; if not, an error says so.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/pack-{uuid.uuid4().hex}"
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, at = None, 0
        for batch in batches:
            if shards is None:
                shards = _shards_of(folder, TaskContext.get().partitionId())
            own = shards[at : at + batch.num_rows]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], names=["shard", "id", "text"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        which = table.column("shard")[0].as_py()
        words, term, flat, size = tokenizer(tokenizer_path).encode(table.column("text").to_pylist())
        n = table.num_rows
        doc = np.repeat(np.arange(n), words.count)
        begin = np.concatenate([[0], np.cumsum(size)])[words.first]
        sizes = np.diff(begin) + 1
        # the index is the largest part of a shard's memory: what it does not need goes first
        ids_col = table.column("id").combine_chunks()
        del words, size, table
        order = order_documents(sizes, doc, term, window)
        del doc, term
        whole = int(sizes.sum()) // window
        out, held = [], []
        end = np.array([end_id], dtype="<u4").tobytes()
        for d, start, length, sequence, offset in lay_out([int(sizes[i]) for i in order], window, False):
            i = order[d]
            ids = flat[begin[i] + start : min(begin[i] + start + length, begin[i + 1])].astype("<u4").tobytes()
            if start + length == sizes[i]:
                ids += end
            out.append((i, start, length, zlib.crc32(ids), int(sizes[i]), (which << 32) | sequence, offset))
            held.append(ids if sequence == whole else None)
        return _pieces(ids_col, out, held)

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = (table.column("sequence_id")[0].as_py() >> 32) // TAIL_SHARDS
        ids = [x.as_py() for x in table.column("held")]
        start, total = table.column("start").to_pylist(), table.column("doc_tokens").to_pylist()
        out = []
        for i, cut_at, length, sequence, offset in lay_out(table.column("length").to_pylist(), window, True):
            part = ids[i][4 * cut_at : 4 * (cut_at + length)]
            out.append((i, start[i] + cut_at, length, zlib.crc32(part), total[i], (1 << 62) | (group << 32) | sequence, offset))
        return _pieces(table.column("id").combine_chunks(), out, [None] * len(out))

    with same_splits(spark):
        got = rows.agg(F.sum(F.octet_length("text") + 1).alias("b"), F.count(F.lit(1)).alias("n")).first()
        if (got["b"] or 0) > shard_bytes:
            _store_shards(_sketches(rows, got["n"], got["b"], folder), shard_bytes, folder)
            dealt = rows.mapInArrow(tidy(deal), f"shard long, id {kind}, text string")
        else:
            dealt = rows.select(F.lit(0).cast("long").alias("shard"), "id", "text")
        dealt.groupBy("shard").applyInArrow(tidy_group(run), f"id {kind}, {_PIECE}, held binary").write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema(f"id {kind}, {_PIECE}, held binary").parquet(f"{folder}/pieces")
    tails = pieces.filter("held IS NOT NULL").groupBy(F.floor(F.shiftright("sequence_id", 32) / TAIL_SHARDS)).applyInArrow(tidy_group(finish), f"id {kind}, {_PIECE}, held binary")
    return pieces.filter("held IS NULL").unionByName(tails).drop("held").withColumnRenamed("id", id_col)
