"""Search results are read once for each distinct one, and what they teach is worked out once."""

from pyspark.sql import functions as F
from test_registry import SF
from test_streams import RESULTS

from plumbline.plans import registry
from plumbline.streaming import learning

GIVEN = [
    ("https://www.cdc.gov/p/zinc", "Zinc prevents the common cold", None), ("https://www.cdc.gov/p/zinc", "A manual", "policy"), ("https://www.who.int/a.pdf", None, "A manual of Vaccines"), ("https://www.nhs.uk/sleep", "", ""),
    ("https://blog.example/zinc", "Zinc works", "zinc"), ("", None, None), (None, "Zinc", None), ("https://www.who.int/references", "zinc", "x"), ("https://www.who.int/zinc", "Not TRUE: zinc", "handbook"),
]
KINDS = ("EFFICACY", "MYTH", "GENERAL", None, "no type")
ANCHORS = (["Zinc", None, ""], [], None, ["vaccines"])


def test_pages_give_what_results_give(spark):
    listed = [(KINDS[k], f"{k}-{i}-{n}", float(n), ANCHORS[i], (GIVEN[n:] + GIVEN[:n])[: 2 * n]) for k in range(5) for i in range(4) for n in range(5)]
    rows = spark.createDataFrame([(*x[:4], x[4] if x[2] else None) for x in listed], RESULTS)
    columns = ("query", "trusted", "selected", "learned")
    want = sorted(map(tuple, learning.processed(rows).select(*columns).collect()))
    flat = rows.select("query", F.posexplode("results").alias("n", "r")).select("query", "n", "r.*")
    pages = learning.with_pages(flat).filter("page.usable")
    held = pages.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "page"))), lambda x: x["page"]).alias("pages"))
    got = learning.processed(rows.drop("results").join(held, "query", "left")).select(*columns)
    assert sorted(map(tuple, got.collect())) == want
    assert any(x[2] for x in want) and any(x[3] for x in want) and len({tuple(x[3]) for x in want}) > 2


def test_results_are_not_read_row_by_row(spark):
    plan = registry.queries()["f34_f35_selected_and_learned"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "mayoclinic.org" not in plan
