"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

Built bottom up: each level is a written table of runs (up to FAN nodes in a row), whose digests are the nodes of the level above.
Proofs are pushed top down: each level is joined to the proofs of the nodes above it, and every child puts its siblings
before what its parent has inherited. Texts stay where they lie; only digests and ids are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import few, staged
from lacuna.operators.ranks import numbered

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings of a node on its two sides, by level from the lowest.
PROOF = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """runs: of the sources' trees, by level from the lowest (g: source, n: nodes of the level, k, nodes), with lone leaves in
    `lone`; subroots (g, n: leaves, node); upper: runs of the tree over the subroots."""

    lone: DataFrame
    runs: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields, each '-' if null, else its length in bytes, ':' and its value."""
    texts = [c.cast("string") for c in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def siblings(proof: Column) -> Column:
    """The digests of a proof in one word, from the leaf's level to the root's."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def _above(n: Column) -> Column:
    return F.ceil(n / FAN).cast("bigint")


def _levels(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs by level, and what remains of each g (g, node). nodes: g, n (of the g), i, node and more; most: the largest n."""
    levels, rows, tops = [], nodes, nodes.where("n = 1").select("g", "node")
    while most > 1:
        child = F.struct("i", *(c for c in rows.columns if c not in ("g", "n", "i")))
        made = rows.where("n > 1").groupBy("g", "n", F.floor(F.col("i") / FAN).alias("k")).agg(F.array_sort(F.collect_list(child)).alias("nodes"))
        made = staged(made.withColumn("node", F.sha2(F.array_join("nodes.node", ""), 256)), f"{name}-runs")
        levels.append(made)
        rows = made.select("g", _above(F.col("n")).alias("n"), F.col("k").alias("i"), "node")
        tops = tops.unionAll(rows.where("n = 1").select("g", "node"))
        most = -(-most // FAN)
    return levels, tops


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, **carried: Column) -> Manifest:
    """The manifest of docs: a leaf for each row, ascending by id within its source, null ids first; rows of one id by leaf.

    Equal rows have leaves of their own. A null source is a source, the first. carried: more columns to keep beside each leaf.
    Columns that `fields` does not name are not read. An empty table has no root.
    """
    kept = [c.alias(name) for name, c in carried.items()]
    rows = docs.select(docs[group_col].alias("source"), docs[id_col].alias("id"), leaf_of(*(docs[c] for c in fields)).alias("node"), *kept, F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "leaves")
    # equal rows may be many: where they stood parts them
    rows = staged(numbered(rows, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.col("node"), F.col("row")]).drop("row"), "leaves-in-order")
    groups = rows.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = staged(numbered(staged(groups, "sources"), [F.col("first")], "g"), "sources-in-order")
    size, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    mine = few(groups.withColumnRenamed("source", "_source"), size)
    placed = rows.join(mine, F.col("source").eqNullSafe(F.col("_source"))).select("g", "n", (F.col("number") - F.col("first")).alias("i"), "node", "id", *carried)
    runs, tops = _levels(placed, most, "leaf")
    subroots = staged(tops.join(groups.select("g", "n"), "g"), "subroots")
    upper, top = _levels(subroots.select(F.lit(0).cast("bigint").alias("g"), F.lit(size).cast("bigint").alias("n"), F.col("g").alias("i"), "node"), size, "source")
    found = top.first()
    return Manifest(placed.where("n = 1"), runs, subroots, upper, found and found["node"])


def _pushed(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """(g, child, proof, subroot) for each child of the lowest level. tops: g, n (nodes of its lowest level), proof, subroot."""
    depth = sum((F.col("n") > FAN**j).cast("int") for j in range(len(levels)))
    above = None
    for j in range(len(levels) - 1, -1, -1):
        inherited = tops.where(depth == j + 1).select("g", F.lit(0).cast("bigint").alias("k"), "proof", "subroot")
        if above is not None:
            made = staged(above.select("g", F.col("child.i").alias("k"), "proof", "subroot"), f"{name}-proofs")
            inherited = inherited.unionAll(made)
        met = levels[j].drop("n", "node").join(inherited, ["g", "k"])
        children = met.select("g", "nodes", "proof", "subroot", F.posexplode("nodes").alias("at", "child"))
        both = F.struct(F.array_join(F.slice("nodes.node", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("nodes.node", F.col("at") + 2, F.lit(FAN)), "").alias("right"))
        above = children.select("g", "child", F.concat(F.array(both), "proof").alias("proof"), "subroot")
    return above


def proofs(made: Manifest) -> DataFrame:
    """Per leaf: id, node, carried columns, subroot, proof."""
    none = F.array().cast(PROOF)
    if made.upper:
        size = made.subroots.count()
        top = made.subroots.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("g"), F.lit(size).cast("bigint").alias("n"), none.alias("proof"), F.lit(None).cast("string").alias("subroot"))
        given = _pushed(made.upper, top, "source").select(F.col("child.i").alias("g"), "proof")
        tops = staged(made.subroots.join(given, "g").select("g", "n", "proof", F.col("node").alias("subroot")), "subroot-proofs")
    else:
        tops = made.subroots.select("g", "n", none.alias("proof"), F.col("node").alias("subroot"))
    carried = [c for c in made.lone.columns if c not in ("g", "n", "i", "node", "id")]
    lone = made.lone.join(tops.where("n = 1").drop("n"), "g").select("id", "node", *carried, "subroot", "proof")
    if not made.runs:
        return lone
    return _pushed(made.runs, tops, "leaf").select("child.id", "child.node", *(f"child.{c}" for c in carried), "subroot", "proof").unionAll(lone)


def audit(docs: DataFrame, tampered: dict[str, Column], id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root: what the leaf of the row with its
    `tampered` columns gives with the row's own siblings, verified: whether that is the root."""
    altered = leaf_of(*(tampered.get(c, docs[c]) for c in fields))
    made = build(docs, id_col, group_col, fields, altered=F.nullif(altered, leaf_of(*(docs[c] for c in fields))))
    rows = proofs(made).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("altered", "node"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_in_fifths(docs: DataFrame) -> dict[str, Column]:
    """The text with A-Z in lower case where 5 divides the id's checksum."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))}
