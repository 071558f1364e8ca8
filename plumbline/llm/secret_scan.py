"""Secret scans with corpus-wide ownership: who else has this value?

Built-in functions only. One pass over the texts finds candidates; from then on
rows are narrow. A candidate's value is counted over distinct repositories and
owners: a value that many owners or many repositories have is a copied example,
one that a single owner (or two) has in few repositories looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.native_text import spans
from plumbline.session import cut

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the limits hold no match, so the limits stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further key-like strings, of which the method takes those with few owners.
OWNED = r"[A-Za-z0-9_+/-]{16,}"
#: The kinds, in the order that ties are listed in.
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN = 12


def _listed(found: Column) -> Column:
    """Spans as kind:start:end, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"]))
    return F.array_join(one, ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live, owners, repos.

    Base spans stand whatever their ownership. The method adds key-like strings
    (``owned``: 16 characters or more of a key's alphabet, with upper case, lower
    case and two digits, not inside a base span) whose value at most
    ``max_owners`` owners hold, in at most ``max_repos`` repositories. n_live and
    n_copied count all spans of the row by those same limits; live, owners and
    repos have the verdict on each listed span's value and the counts that it
    rests on, in the order of spans.
    ``repo_col`` names the repository; by default each document is one. Places are code points, ends exclusive.

    Null and empty texts have no spans. Null owners are one owner, null ids one
    repository. Repeated rows are scanned each and are one repository. An empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("h")))

    assign = kind(0, F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= MIN_ASSIGN))
    own = F.filter(spans(text, OWNED), lambda x: x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]") & x["v"].rlike("[0-9].*[0-9]"))
    first = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.concat(assign, kind(1, spans(text, ACCESS)), kind(2, spans(text, HEX))).alias("base"),
        kind(3, own).alias("more"),
    )
    clear = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    rows = cut(first.withColumn("more", clear))
    each = rows.filter("size(base) + size(more) > 0").select("rid", "owner", "repo", F.explode(F.concat("base", "more")).alias("x"))
    by_repo = each.groupBy(F.col("x.h").alias("h"), "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("one").alias("repos"))
    ownership = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    judged = each.select("rid", "x", F.col("x.h").alias("h")).join(ownership, "h").select("rid", "x", "owners", "repos", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"))
    kept = judged.filter(F.col("live") | (F.col("x.k") < 3))
    per_row = kept.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("x.s", "x.k", "x.e", "owners", "repos", "live"))).alias("all"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied")
    )
    out = rows.join(per_row, "rid", "left")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return out.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        F.coalesce(_listed("all"), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("all.live", F.array().cast("array<boolean>")).alias("live"),
        F.coalesce("all.owners", F.array().cast("array<long>")).alias("owners"),
        F.coalesce("all.repos", F.array().cast("array<long>")).alias("repos"),
    )
