"""Corpus-wide sums by key, asked for by chunks of texts and answered in the order of the question.

A chunk is named by its task and its number in the task. Its question is its
distinct keys of a kind, sorted, with its own counts; keys are dealt to parts by
ranges, summed there, and the sums go back to every chunk that asked. They are
stored by task, where a later pass over the same texts reads them, chunk by
chunk. So a pass knows sums over the whole corpus without a join of texts, and
nothing that grows with the corpus is ever in one place.

A key is as many bits of a hash as keep chance meetings rare at the corpus's
size. Sorted keys go as low bits and as unary steps of the rest, 3 to 4
bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.tokens import mix, tidy_group
from plumbline.session import open_fs

#: A key meets another of its corpus by chance with a probability of 2 ** -SPARE at most (below 2 ** 44 keys).
SPARE = 14
ASKED = "kind int, part long, task long, chunk long, n long, keys binary, counts binary"
ANSWERED = "kind int, task long, chunk long, part long, n long, counts binary, first binary, total long, known long"


def key_bits(size: int) -> int:
    """Bits of a key for a corpus of ``size`` bytes, which has fewer words than that."""
    return min(62, max(40, size.bit_length() + SPARE))


def keys_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, where each first stands, each one's place among them).

    A key's top bits and its place share one number, as plain numbers sort
    faster than places by key; the few that only differ further down are put right.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    shift = max(1, (n - 1).bit_length())
    drop = max(0, bits + shift - 64)
    both = (keys.view(np.uint64) >> np.uint64(drop)) << np.uint64(shift) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << shift) - 1)).astype(np.int64)
    own = keys[order]
    if drop and (own[1:] < own[:-1]).any():
        right = np.argsort(own, kind="stable")
        order, own = order[right], own[right]
    new = np.append(True, own[1:] != own[:-1])
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return own[new], order[new], inverse


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True) if data else b""


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, the number of low bits, these bits, and the rest as unary steps."""
    base = int(keys[0])
    rest = keys - base
    low = max(0, (int(rest[-1]) // len(keys)).bit_length() - 1)
    high = (rest >> low) + np.arange(len(rest))
    steps = np.zeros(int(high[-1]) + 1, dtype=bool)
    steps[high] = True
    width = (low + 7) // 8
    lows = np.unpackbits(rest.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width], axis=1, bitorder="little")[:, :low]
    return base.to_bytes(8, "little") + bytes([low]) + np.packbits(lows).tobytes() + np.packbits(steps).tobytes()


def unpack_keys(n: int, data: bytes) -> np.ndarray:
    base, low = int.from_bytes(data[:8], "little"), data[8]
    size = (n * low + 7) // 8
    width = (low + 7) // 8
    bits = np.zeros((n, 8 * width), dtype=np.uint8)
    bits[:, :low] = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=size, offset=9), count=n * low).reshape(n, low)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=9 + size)))[:n] - np.arange(n)
    return wide.view("<i8").ravel() + (high << low) + base


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more follow in full."""
    return _squeeze(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes())


def unpack_counts(n: int, data: bytes) -> np.ndarray:
    data = _expand(data)
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<i8", offset=n)
    return out


def asked(kind: int, task: int, chunk: int, keys: np.ndarray, counts: np.ndarray, parts: int, bits: int) -> pa.RecordBatch:
    """A chunk's question about sorted distinct keys: a row for each part that they fall into."""
    part = (keys >> (bits - 32)) * parts >> 32
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    edges = np.append(first, len(keys))
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    same = np.ones(len(first), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(same * kind, pa.int32()),
            pa.array(part[first]),
            pa.array(same * task),
            pa.array(same * chunk),
            pa.array([b - a for a, b in spans], pa.int64()),
            pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary()),
        ],
        names=[x.split()[0] for x in ASKED.split(", ")],
    )


def exchange(questions: DataFrame, folder: str, bits: int, least: int = 0) -> None:
    """Answer all questions, and store the answers by the kind and the task that asked, in the order of its chunks.

    Sums below ``least`` are answered as 0, but for kind 0. Of the chunks that
    ask for a key whose sum is not 0, the first is told so. Every part's sum over
    its keys (total) and number of keys of other sums than 0 (known) is told once.
    """

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("chunk", "ascending")])
        n = table.column("n").to_numpy()
        keys = np.concatenate([unpack_keys(m, k.as_buffer().to_pybytes()) for m, k in zip(n, table.column("keys"), strict=True)])
        counts = np.concatenate([unpack_counts(m, c.as_buffer().to_pybytes()) for m, c in zip(n, table.column("counts"), strict=True)])
        _, index, inverse = distinct(keys, bits)
        sums = np.bincount(inverse, weights=counts, minlength=len(index)).astype(np.int64)
        total, known = int(sums.sum()), int(np.count_nonzero(sums))
        if table.column("kind")[0].as_py():
            sums[sums < least] = 0
        first = np.zeros(len(keys), dtype=bool)
        first[index[sums > 0]] = True
        every = sums[inverse]
        edges = np.append(0, np.cumsum(n))
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        once = np.zeros(len(n), dtype=np.int64)
        once[0] = 1
        told = [pa.array([pack_counts(every[a:b]) for a, b in spans], pa.binary()), pa.array([_squeeze(np.packbits(first[a:b]).tobytes()) for a, b in spans], pa.binary())]
        own = [table.column(x) for x in ("kind", "task", "chunk", "part", "n")]
        return pa.table([*own, *told, pa.array(once * total), pa.array(once * known)], names=[x.split()[0] for x in ANSWERED.split(", ")])

    answers = questions.groupBy("kind", "part").applyInArrow(tidy_group(answer), ANSWERED)
    answers.repartition("task").sortWithinPartitions("kind", "task", "chunk", "part").write.partitionBy("kind", "task").parquet(folder)


def answers_of(folder: str, kind: int, task: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, counts, first) for the chunks of a task, one after the other."""
    fs, root = open_fs(f"{folder}/kind={kind}/task={task}")
    held: tuple[int, list, list] | None = None
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    for path in files:
        with fs.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=256, columns=["chunk", "n", "counts", "first"]):
                for chunk, n, counts, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if held is not None and held[0] != chunk.as_py():
                        yield held[0], np.concatenate(held[1]), np.concatenate(held[2])
                        held = None
                    if held is None:
                        held = chunk.as_py(), [], []
                    n = n.as_py()
                    held[1].append(unpack_counts(n, counts.as_buffer().to_pybytes()))
                    held[2].append(np.unpackbits(np.frombuffer(_expand(first.as_buffer().to_pybytes()), dtype=np.uint8), count=n).astype(bool))
    if held is not None:
        yield held[0], np.concatenate(held[1]), np.concatenate(held[2])


def met(answers: Iterator[tuple[int, np.ndarray, np.ndarray]], chunk: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers to a chunk's question about n keys; a chunk without keys asked nothing."""
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    got, counts, first = next(answers, (-1, (), ()))
    if got != chunk or len(counts) != n:
        raise RuntimeError("the table did not give the same rows in the same order when it was read again")
    return counts, first


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike while this lasts, also when executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(name, None)
    if old is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
