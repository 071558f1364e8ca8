"""Services outside the engine, as functions that the caller passes in: pages, searches, embeddings, answers.

Each operator calls its function in tasks, once per distinct request, over
Arrow batches; what it gives is a row, a failure too. The functions must be
picklable. Nothing here opens a connection by itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import domains, search, urls
from plumbline.functions.text import folded


class QuotaExceeded(Exception):
    """A provider will give nothing more for now."""


def cache_key(query: Column, claim: Column | None = None, kind: Column | None = None) -> Column:
    """What names a search result: the SHA-1 of the claim, its type and the query, folded."""
    part = lambda x: folded(F.lit("") if x is None else x)
    return F.sha1(F.concat_ws("|", part(claim), part(kind), part(query)))


def _called(run: Callable[[], object]) -> tuple[object, str | None, float]:
    begin = time.monotonic()
    try:
        return run(), None, time.monotonic() - begin
    except Exception as error:  # a failure is a row, whatever it is
        return None, type(error).__name__, time.monotonic() - begin


def fetched(requests: DataFrame, fetch: Callable[[str], str], blocks: DataFrame | None = None, now: float = 0.0) -> DataFrame:
    """(url, domain, content, chars, success, error_code, latency): each distinct page once, but for domains blocked after ``now``.

    requests: url. blocks: (domain, blocked_until), the newest of each domain.
    What fails has no content; an empty page is a failure, too.
    """
    rows = requests.select("url", F.coalesce(urls.domain(F.col("url")), F.lit("")).alias("domain")).filter(F.col("url").isNotNull()).distinct()
    if blocks is not None:
        rows = rows.join(blocks.filter(F.col("blocked_until") > now).select("domain"), "domain", "left_anti").select("url", "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_called(lambda u=u: fetch(u)) for u in batch.column(0).to_pylist()]
            texts = [x if e is None and x else None for x, e, _ in out]
            errors = [e or (None if t else "empty_page") for t, (_, e, _) in zip(texts, out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([t is not None for t in texts]), pa.array(errors, pa.string()), pa.array([s for _, _, s in out], pa.float64())],
                names=["url", "domain", "content", "chars", "success", "error_code", "latency"],
            )

    return rows.mapInArrow(run, "url string, domain string, content string, chars long, success boolean, error_code string, latency double")


def searched(queries: DataFrame, providers: Sequence[tuple[str, Callable[[str], Sequence[dict]]]], cache: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(key, query, provider, place, url, title, snippet): trusted pages that each distinct query finds.

    Providers are asked in turn until ``least`` trusted pages are found; one
    that raises QuotaExceeded is not asked again by the task. Pages that
    reject_reason() names, or whose address is known already, are left out.
    ``cache`` holds earlier results by key; its queries are not sent.
    """
    c = F.col
    asked = queries.select(search.sanitized(c("query")).alias("query")).filter("query <> ''").distinct().withColumn("key", cache_key(c("query")))
    if cache is not None:
        asked = asked.join(cache.select("key").distinct(), "key", "left_anti").select("query", "key")
    trusted = tuple(domains.TRUSTED_ROOTS)

    def known(url: str) -> bool:
        host = url.split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower().removeprefix("www.")
        return any(host == t or host.endswith("." + t) for t in trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: set[str] = set()
        for batch in batches:
            out = []
            for query, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                good = 0
                for name, ask in providers:
                    if name in spent or good >= least:
                        continue
                    try:
                        items = list(ask(query))
                    except QuotaExceeded:
                        spent.add(name)
                        continue
                    except Exception:  # the next provider is asked instead
                        continue
                    good += sum(known(str(i.get("url") or "")) for i in items)
                    out += [(key, query, name, n, i.get("url"), i.get("title"), i.get("snippet")) for n, i in enumerate(items)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["key", "query", "provider", "place", "url", "title", "snippet"])

    found = asked.mapInArrow(run, "key string, query string, provider string, place int, url string, title string, snippet string")
    found = found.withColumn("url", search.unwrapped(c("url"))).filter(domains.is_trusted(c("url")) & search.reject_reason(c("url"), c("title"), c("snippet")).isNull())
    order = {name: i for i, (name, _) in enumerate(providers)}
    turn = F.coalesce(*[F.when(c("provider") == n, i) for n, i in order.items()], F.lit(len(order)))
    first = F.row_number().over(Window.partitionBy("key", "url").orderBy(turn, "place"))
    return found.withColumn("_n", first).filter("_n = 1").drop("_n")


def embedded(texts: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], text_col: str = "text", batch: int = 64) -> DataFrame:
    """(text, vector) of each distinct text, in batches; blank texts have none."""
    rows = texts.select(F.col(text_col).alias("text")).filter(F.trim("text") != "").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            given = own.column(0).to_pylist()
            vectors = [list(map(float, v)) for i in range(0, len(given), batch) for v in embed(given[i : i + batch])]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["text", "vector"])

    return rows.mapInArrow(run, "text string, vector array<float>")


def answered(prompts: DataFrame, ask: Callable[[str], str], per_job: int, reserves: dict[str, int] | None = None) -> DataFrame:
    """(job, call, tag, prompt, answer, skipped): what a model says to each prompt (job, call, tag, prompt), within each job's budget.

    Calls count in order; ``reserves`` keeps places of a job's budget for a tag,
    which others cannot use. A call beyond the budget, or one that fails, has no
    answer.
    """
    c = F.col
    reserves = reserves or {}
    held = sum(reserves.values())
    spare = F.when(c("tag").isin(*reserves) if reserves else F.lit(False), c("tag")).otherwise("_")
    place = F.row_number().over(Window.partitionBy("job", spare).orderBy("call"))
    room = F.lit(max(0, per_job - held))
    for tag, n in reserves.items():
        room = F.when(c("tag") == tag, n).otherwise(room)
    rows = prompts.withColumn("skipped", place > room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if skip else _called(lambda p=p: ask(p))[0] for p, skip in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["job", "call", "tag", "prompt", "skipped", "answer"])

    return rows.select("job", "call", "tag", "prompt", "skipped").mapInArrow(run, "job string, call long, tag string, prompt string, skipped boolean, answer string")


def read_decisions(spark, path: str) -> DataFrame:
    """Domain decisions as (domain, approved, at, seq) from their JSON file: {"approved": {domain: record}, "rejected": {..}}."""
    record = "struct<approved_at:timestamp>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"approved map<string,{record}>, rejected map<string,{record}>").alias("d"))
    side = lambda name, approved: raw.select(F.explode(f"d.{name}").alias("domain", "r"), F.lit(approved).alias("approved"))
    return side("approved", True).union(side("rejected", False)).select("domain", "approved", F.col("r.approved_at").alias("at"), F.monotonically_increasing_id().alias("seq"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """The newest decision on each domain as one JSON file; domains are decided by hand, so the driver holds them."""
    out: dict[str, dict] = {"approved": {}, "rejected": {}}
    for r in decisions.select("domain", "approved", F.col("at").cast("string").alias("at")).collect():
        out["approved" if r["approved"] else "rejected"][r["domain"]] = {"domain": r["domain"], "is_trusted": r["approved"], "approved_at": r["at"]}
    decisions.sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_rows(spark, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array in one file, such as lexicons and regression cases."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select("r.*")



def archived(requests: DataFrame, fetch: Callable[[str], str], render: Callable[[str], str]) -> DataFrame:
    """(url, kind, method, content, chars, success, error_code): each distinct page or document of an archive once.

    ``fetch`` gives a page's markup, or a document's text after the mark of PDF
    text. A landing page without content of its own is left for the document
    that it links to; what is still without content goes to ``render``. method is
    http, pdf or browser, whichever was the last. Each round is written before
    the next one, so no page is fetched twice.
    """
    from plumbline.functions import pages
    from plumbline.functions.content import scraped
    from plumbline.session import written

    c = F.col
    asked = requests.select("url").filter("url IS NOT NULL").distinct()

    def round_of(rows: DataFrame, get: Callable[[str], str]) -> DataFrame:
        got = fetched(rows, get).select("url", c("content").alias("html"), "error_code")
        return written(scraped(got).select("url", "html", "content", "error_code"))

    first = round_of(asked, fetch)
    kind = pages.url_type(c("url"))
    linked = first.filter((kind == "iris_html") & c("content").isNull() & c("html").isNotNull()).select(c("url").alias("page"), pages.pdf_link(c("html"), c("url")).alias("url")).filter("url IS NOT NULL")
    documents = linked.join(round_of(linked, fetch).select("url", c("content").alias("linked_content")), "url").select(c("page").alias("url"), "linked_content")
    rows = written(first.join(documents, "url", "left"))
    open_rows = rows.filter("content IS NULL AND linked_content IS NULL").select("url")
    last = round_of(open_rows, render).select("url", c("content").alias("rendered"), c("error_code").alias("last_error"), F.lit(True).alias("tried"))
    both = rows.join(last, "url", "left")
    content = F.coalesce("content", "linked_content", "rendered")
    method = F.when(c("content").isNotNull(), "http").when(c("linked_content").isNotNull(), "pdf").otherwise("browser")
    error = F.when(content.isNull(), F.coalesce("last_error", "error_code", F.lit("no_content")))
    return both.select("url", kind.alias("kind"), method.alias("method"), content.alias("content"), F.coalesce(F.length(content), F.lit(0)).alias("chars"), content.isNotNull().alias("success"), error.alias("error_code"))
