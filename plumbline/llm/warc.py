"""WARC: a deterministic sharded writer, and the reader of its archives.

Records are range-sorted by id. Shards are ranges of ids whose payloads add up
to a given number of bytes. Each shard is written by one task, as files that
roll when their compressed size reaches a limit; a record is a gzip member of
its own. Tasks write under temporary names. The commit
renames one attempt's files of each shard and writes a manifest; readers open
what the manifest names and nothing else, so lost or repeated attempts leave
no trace in the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.ranges import with_running_sum
from plumbline.llm.tokens import tidy
from plumbline.session import cut, open_fs, shared_dir

#: Payload bytes of a shard at least, and how many shards there are at most (one number each reaches the driver).
SHARD_BYTES, MAX_SHARDS = 32 << 20, 1 << 15
#: Records carry this date; a crawl would pass its own.
DATE = "1970-01-01T00:00:00Z"
FORMAT = "WARC/1.1"


def record_id(page: object, digest: str) -> str:
    """The same for the same page and payload in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; line breaks inside header values become spaces."""
    lines = [FORMAT, *(f"{k}: {' '.join(v.splitlines())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name or time, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page: int | None, url: str | None, html: str | None, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    payload = (html or "").encode()
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or "urn:x-none"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Page-Id", "" if page is None else str(page)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    return record_bytes(headers, block)


def info_record(name: str, date: str = DATE) -> bytes:
    body = f"software: plumbline\r\nformat: {FORMAT}\r\n".encode()
    return record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "info")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def shard_bounds(pages: DataFrame, id_col: str, bytes_col: str, shard_bytes: int) -> list[int]:
    """Ids at which shards end: those that bring the running sum of bytes over all smaller ids to a multiple of ``shard_bytes``.

    The bounds depend on the rows alone. A few jobs whatever the table's size:
    rows are narrow, sorted in ranges, and one sum per range reaches the driver.
    """
    total = pages.agg(F.sum(bytes_col).alias("b")).first()["b"]
    if not total:
        return []
    ranges = max(1, min(-(-total // shard_bytes), MAX_SHARDS))
    sized = pages.groupBy(F.col(id_col).alias("id")).agg(F.sum(bytes_col).alias("b"))
    cell = with_running_sum(sized, ["id"], "b", "before", ranges).withColumn("cell", F.floor((F.col("before") + F.col("b") - 1) / shard_bytes))
    return sorted(r["last"] + 1 for r in cell.groupBy("cell").agg(F.max("id").alias("last")).collect())[:-1]


_WRITTEN = "shard int, seq int, temp string, name string, records long, bytes long, attempt long"


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int | None = None, shard_bytes: int | None = None, date: str = DATE) -> DataFrame:
    """Write one record per row of ``pages`` under ``out``; returns the manifest (shard, seq, name, records, bytes).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest id becomes a response, the others revisits of it. Of rows repeated
    with that id each is a response. Null html is an empty payload, a null url
    is written as urn:x-none, a null id as none: such rows go to the first shard,
    revisit the smallest id, and are responses where no row of their payload has
    an id. An empty table gives an empty manifest; other columns are ignored.
    ``out`` must be reachable by all executors, through pyarrow.

    ``shard_bytes`` of payload make a shard; by default SHARD_BYTES, or what
    makes MAX_SHARDS of them where the table is larger. A file rolls at
    ``roll_bytes`` compressed, by default an eighth of that. Payloads cross the
    network once: what a page revisits goes to its shard as a row of its own,
    which the writer reads before the page.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    narrow = cut(rows.select("page", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").cast("long").alias("bytes")))
    first = narrow.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    # only rows that revisit another take part in the way back
    refers = narrow.join(first, "digest").filter(~F.col("page").eqNullSafe(F.col("first"))).select("page", "digest", "first").distinct()
    if shard_bytes is None:
        shard_bytes = max(SHARD_BYTES, (narrow.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // MAX_SHARDS)
    if roll_bytes is None:
        roll_bytes = shard_bytes // 8
    bounds = shard_bounds(narrow.filter("page IS NOT NULL"), "page", "bytes", shard_bytes)
    shards = len(bounds) + 1
    none = {k: F.lit(None).cast(t) for k, t in (("url", "string"), ("html", "string"), ("digest", "binary"), ("first", "long"))}
    marks = refers.select("page", none["url"].alias("url"), none["html"].alias("html"), "digest", "first")
    every = rows.select("page", "url", "html", none["digest"].alias("digest"), none["first"].alias("first")).unionByName(marks)
    shard = F.lit(0)
    if bounds:
        shard = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("page"))), F.lit(0)) if len(bounds) <= 64 else _shard_of(bounds)
    # a page's marks have no html, so they come first
    dealt = every.withColumn("shard", shard.cast("int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page").asc_nulls_first(), F.col("html").asc_nulls_first(), F.col("url").asc_nulls_first())
    token = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        attempt = TaskContext.get().taskAttemptId()
        done, sink, size, records, current, seq = [], None, 0, 0, None, 0
        marked, of = {}, None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((current, seq, temp, name, records, size, attempt))
                sink = None

        temp = name = ""
        for batch in batches:
            for page, url, page_html, digest, refers_to, own in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if page_html is None:
                    if of != page:
                        marked, of = {}, page
                    marked[digest] = refers_to
                    continue
                refers_to = marked.get(hashlib.sha256(page_html.encode()).digest()) if marked and of == page else None
                if sink is not None and (own != current or size >= roll_bytes):
                    close()
                    seq = seq + 1 if own == current else 0
                if sink is None:
                    if own != current:
                        current, seq = own, 0
                    name = f"plumbline-{current:06d}-{seq:04d}.warc.gz"
                    temp = f"_temporary/{token}-{attempt}-{name}"
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    sink = fs.open_output_stream(f"{root}/{temp}", compression=None)
                    size = sink.write(gzip_member(info_record(name, date)))
                    records = 0
                size += sink.write(gzip_member(page_record(page, url, page_html, refers_to, date)))
                records += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "seq", "temp", "name", "records", "bytes", "attempt"])

    # the checkpoint fixes one attempt per shard before anything is renamed
    written = cut(dealt.mapInArrow(tidy(write), _WRITTEN))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        for batch in batches:
            for temp, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{root}/{temp}")
            yield batch

    manifest = cut(written.mapInArrow(commit, _WRITTEN).select("shard", "seq", "name", "records", "bytes"))
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    fs, root = open_fs(out)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{out}/manifest")


def _shard_of(bounds: list[int]):
    """A column function for many bounds: binary search over Arrow batches."""
    import numpy as np
    import pandas as pd

    at = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(page: pd.Series) -> pd.Series:
        return pd.Series(np.where(page.isna(), 0, np.searchsorted(at, page.fillna(-(2**62)).astype(np.int64), side="right")))

    return place(F.col("page"))


def members(source: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream of bytes, one after the other."""
    z, held = zlib.decompressobj(31), []
    for data in source:
        while data:
            held.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(held)
                data, z, held = z.unused_data, zlib.decompressobj(31), []
    if any(held):
        raise EOFError("the archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, lower-cased names, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    return headers, rest[:size]


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, valid boolean, file string"


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of the archives that ``out``'s manifest names, a row for each response and revisit.

    ``valid``: the digests of block and payload, worked out anew, are those of
    the headers. A revisit's payload is null; its length and digest are the
    headers'.
    """
    files = spark.read.parquet(f"{out}/manifest").select("name", "shard", "seq")
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(iter(lambda: stream.read(1 << 20), b"")):
                        h, block = parse_record(data)
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        whole = h["warc-type"] == "response"
                        valid = h["warc-block-digest"] == f"sha1:{sha1_base32(block)}" and (not whole or (sha1_base32(payload) == digest and len(payload) == int(h["x-payload-length"])))
                        page, refers = h["x-page-id"], h.get("x-refers-to-page")
                        rows.append((int(page) if page else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], int(refers) if refers else None, payload if whole else None, valid, name))
                        held += len(payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return files.repartition(n, "shard", "seq").mapInArrow(tidy(read), _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder of the shared one and read the archives back."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, out, **options)
    return read_warc(spark, out)
