"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Finds, leftmost and without overlap within each kind (fixed values):
assign: a keyword, a sign and a value of 8 or more characters; access: AKIA and
capitals or digits, 16 or more characters; hex: 32 or more of 0-9a-f; opaque: 24
or more of A-Za-z0-9+/_- with a small letter, a capital and two digits.

Every find's value is hashed.  Over the whole corpus each hash is counted by
distinct repositories and distinct owners: a value that several owners have is a
widely copied example, one that a single owner has looks live.  The first three
kinds are always reported; opaque values have no other evidence than their
ownership, so they are added to a document's spans where they look live.

Positions: a text with finds is cut into gaps and matches by one expression,
`(?s)(.*?)(pattern|\\z)`; a window sum over their lengths (code points) within the
text gives the starts, so the work is linear in the text however many there are.

Scale: the texts stay where they are read; only lengths, hashes and ids are
shuffled.  Ownership is counted from distinct (hash, owner) and (hash, repository)
rows, both aggregated on the map side first, so a hash in a third of all rows is
spread by its second part; the counts go back by a sort-merge join that AQE
splits.  The finds are written once to the shared folder, as three steps read them.

Edge cases: null and empty texts have no finds; a null owner or repository counts
as one of its own; null ids are joined as equal; repeated rows (same id and text)
each get the same result and count once as a repository; an empty table gives an
empty result; only the columns named are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kind, pattern, group of the value within it, least length of the value (fixed values).
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
    ("opaque", r"([A-Za-z0-9+/_-]{24,})", 1, 24),
)
BASE = 3
#: What a text with a find of each kind has at least.
HINTS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "AKIA",
    "[0-9a-f]{32}",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{24})(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])",
)
#: So many owners make a value a widely copied example.
COPIED = 2


def _matches(text: Column, number: int) -> Column:
    """array<struct> of a kind's gaps and matches, the last one empty."""
    kind, pattern, group, least = KINDS[number]
    whole = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    parts = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("g"), F.regexp_extract_all(text, whole, F.lit(2)).alias("m"), F.regexp_extract_all(text, whole, F.lit(2 + group)).alias("v"))

    def row(x: Column, i: Column) -> Column:
        good = (F.char_length(x["v"]) >= least) & (F.char_length(x["m"]) > 0)
        if kind == "opaque":
            good = good & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[0-9].*[0-9]")
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"), F.when(good, F.xxhash64(x["v"], F.char_length(x["v"]))).alias("value"))

    return F.when(text.rlike(HINTS[number]), F.transform(parts, row)).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:bigint>>"))


def find(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per find: doc_id, body (hash of the text), repo, owner, kind, start, stop, value."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    rows = rows.filter(F.col("t").rlike("|".join(f"(?:{h})" for h in HINTS))).withColumn("body", F.xxhash64("t"))
    found = F.concat(*(_matches(F.col("t"), k) for k in range(len(KINDS))))
    cells = rows.select("doc_id", "body", "repo", "owner", F.inline(found))
    key = ["doc_id", "body", "repo", "owner", "kind"]
    cells = cells.dropDuplicates([*key, "i"])
    before = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(before))
    return cells.filter(F.col("value").isNotNull()).select(*key, (F.col("stop") - F.col("len")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "value")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over all finds; a null counts as one of its own."""

    def distinct(name: str) -> DataFrame:
        one = found.select("value", F.struct(name).alias("x")).distinct()
        return one.groupBy("value").agg(F.count("x").alias(f"n_{name}s"))

    return distinct("repo").join(distinct("owner"), "value")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied: int = COPIED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of every row."""
    found = common.cut(find(docs, id_col, text_col, repo_col, owner_col))
    # ownership is grouped by value; with a second key both sides are shuffled for the join, and AQE can split a hot value
    owned = ownership(found).withColumn("h", F.xxhash64("value"))
    judged = found.withColumn("h", F.xxhash64("value")).join(owned, ["value", "h"]).withColumn("live", F.col("n_owners") < copied)
    base = F.col("kind") < BASE
    span = F.struct("start", "kind", "stop")
    spans = judged.groupBy("doc_id", "body", "repo", "owner").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), span))).alias("all"),
    )
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")
    key = ["doc_id", "body", "repo", "owner"]
    spans = spans.select(*(F.col(c).alias(f"_{c}") for c in key), *(f"n_{KINDS[k][0]}" for k in range(BASE)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("all")).alias("spans"), "n_live", "n_copied")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    same = F.lit(True)
    for c in key:
        same = same & rows[c].eqNullSafe(spans[f"_{c}"])
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(spans, same, "left").select("doc_id", *(none(f"n_{KINDS[k][0]}") for k in range(BASE)), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), none("n_live"), none("n_copied"))
