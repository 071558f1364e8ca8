"""Services passed in as functions: pages, searches, embeddings, answers; and JSON files."""

from pyspark.sql import functions as F

from plumbline.operators.trust import newest_decisions
from plumbline.sources import providers


def test_fetched(spark):
    def page(url):
        if "broken" in url:
            raise TimeoutError(url)
        return "" if "empty" in url else f"text of {url}"

    requests = spark.createDataFrame([("https://a.org/1",), ("https://a.org/1",), ("https://b.org/broken",), ("https://b.org/empty",), ("https://c.org/x",), (None,)], "url string")
    blocks = spark.createDataFrame([("c.org", 50.0), ("a.org", 5.0)], "domain string, blocked_until double")
    got = {r["url"]: r for r in providers.fetched(requests, page, blocks, now=10.0).collect()}
    assert set(got) == {"https://a.org/1", "https://b.org/broken", "https://b.org/empty"}
    assert got["https://a.org/1"]["chars"] == 23 and got["https://a.org/1"]["success"]
    assert (got["https://b.org/broken"]["error_code"], got["https://b.org/empty"]["error_code"]) == ("TimeoutError", "empty_page")


def test_searched(spark):
    from plumbline.sources.providers import QuotaExceeded

    def first(query):
        if "quota" in query:
            raise QuotaExceeded
        hits = [{"url": "https://www.cdc.gov/flu/a", "title": "a"}, {"url": "https://blog.example/x", "title": "b"}]
        return hits * 2 if "flu" in query else []

    def second(query):
        return [{"url": "https://www.google.com/url?q=https%3A%2F%2Fwho.int%2Fz", "title": "z"}, {"url": "https://nih.gov/?utm_source=a", "title": "t"}, {"url": "https://cdc.gov/flu/b", "title": "c"}]

    queries = spark.createDataFrame([("flu flu shots",), ("flu shots",), ("zinc",), (" ",), ("old",)], "query string")
    cache = spark.createDataFrame([("old",)], "query string").select(providers.cache_key(F.col("query")).alias("key"))
    rows = providers.searched(queries, [("one", first), ("two", second)], cache).collect()
    got = {(r["query"], r["provider"], r["url"]) for r in rows}
    assert got == {("flu shots", "one", "https://www.cdc.gov/flu/a"), ("flu shots", "two", "https://who.int/z"), ("flu shots", "two", "https://cdc.gov/flu/b"), ("zinc", "two", "https://who.int/z"), ("zinc", "two", "https://cdc.gov/flu/b")}
    only = providers.searched(queries.filter("query = 'zinc'").selectExpr("'quota ' || query AS query"), [("one", first), ("two", second)]).collect()
    assert {r["provider"] for r in only} == {"two"}


def test_embedded_and_answered(spark):
    texts = spark.createDataFrame([("ab",), ("ab",), ("abc",), ("",), (None,)], "text string")
    assert {r["text"]: r["vector"] for r in providers.embedded(texts, lambda xs: [[len(x), 1.0] for x in xs], batch=1).collect()} == {"ab": [2.0, 1.0], "abc": [3.0, 1.0]}
    prompts = spark.createDataFrame([("j", i, "verdict" if i == 5 else "any", f"p{i}") for i in range(6)] + [("k", 0, "any", "boom")], "job string, call long, tag string, prompt string")

    def ask(prompt):
        if prompt == "boom":
            raise ValueError(prompt)
        return prompt.upper()

    got = {(r["job"], r["call"]): r["answer"] for r in providers.answered(prompts, ask, 4, {"verdict": 1}).collect()}
    assert [got["j", i] for i in range(6)] == ["P0", "P1", "P2", None, None, "P5"] and got["k", 0] is None


def test_json_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.org", True, "2024-01-02 00:00:00", 1), ("b.org", False, "2024-01-03 00:00:00", 2), ("a.org", False, "2023-01-01 00:00:00", 3)], "domain string, approved boolean, at string, seq long").withColumn("at", F.col("at").cast("timestamp"))
    newest = rows.groupBy("domain").agg(F.max_by("approved", "at").alias("approved"), F.max("at").alias("at"))
    providers.write_decisions(newest, str(tmp_path / "trust"))
    back = newest_decisions(providers.read_decisions(spark, str(tmp_path / "trust"))).collect()
    assert {r["domain"]: r["approved"] for r in back} == {"a.org": True, "b.org": False}
    (tmp_path / "cases.json").write_text('[{"claim": "x", "verdict": "TRUE"}, {"claim": "y"}]')
    assert [tuple(r) for r in providers.read_rows(spark, str(tmp_path / "cases.json"), "claim:string,verdict:string").collect()] == [("x", "TRUE"), ("y", None)]


def test_archived(spark):
    text = "A report on zinc and colds, with a sentence that is long enough."

    def fetch(url):
        if "gone" in url:
            raise TimeoutError(url)
        if url.endswith(".pdf"):
            return f"[[PDF_TEXT]]{text} pdf"
        return '<nav>menu</nav><a href="/docs/full.pdf">x</a>' if "landing" in url else "<nav>menu</nav>" if "script" in url else f"<p>{text}</p>"

    def render(url):
        return "" if "gone" in url else f"<p>{text} rendered</p>"

    places = ["https://iris.who.int/page", "https://iris.who.int/landing", "https://other.org/script", "https://other.org/gone", "https://iris.who.int/direct.pdf", "https://iris.who.int/page", None]
    got = {r["url"]: r for r in providers.archived(spark.createDataFrame([(p,) for p in places], "url string"), fetch, render).collect()}
    assert len(got) == 5
    assert [got[p]["method"] for p in places[:5]] == ["http", "pdf", "browser", "browser", "http"]
    assert got[places[1]]["content"] == f"{text} pdf" and got[places[2]]["content"] == f"{text} rendered" and got[places[4]]["kind"] == "pdf_direct"
    assert not got[places[3]]["success"] and got[places[3]]["error_code"] == "empty_page" and got[places[3]]["chars"] == 0
