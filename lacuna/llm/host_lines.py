"""How many documents of a host hold each line: shared by line dedup and the quality rules.

DataFrame operations only. Lines are known by 128-bit hashes, so their text is never shuffled. Every
shuffle by (host, line) carries partial counts, and a line that many documents of a hot host share costs
one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import BROADCAST_ROWS, WHITE, content_key, staged

HOST, LINES, GONE = "_host", "_lines", "_gone"


def normal_lines(text: Column) -> Column:
    """The \\n-split lines, lower-cased, with runs of white space made one space, and trimmed."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))


def hashed(lines: Column) -> Column:
    """Two hashes of each line, null for a line without a word."""
    return F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def with_lines(docs: DataFrame, text: str, host: str | None) -> DataFrame:
    """docs with HOST (never null; a null host is a host of its own) and LINES (hashes)."""
    key = F.lit("h") if host is None else F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))
    return docs.withColumns({HOST: key, LINES: hashed(normal_lines(F.col(text)))})


def line_counts(lined: DataFrame, least: int) -> DataFrame:
    """HOST, a, b, n_docs: for each line that at least `least` rows of its host hold, how many hold it."""
    # array_distinct compares all pairs of structs: sorted, repeats stand beside each other
    ordered = F.sort_array(F.array_compact(LINES))
    before = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), ordered)
    once = F.array_compact(F.zip_with(ordered, before, lambda x, y: F.when(x.isNotNull() & ~x.eqNullSafe(y), x)))
    rows = lined.select(HOST, F.explode(once).alias("x"))
    return rows.groupBy(HOST, "x.a", "x.b").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)


def host_totals(lined: DataFrame) -> DataFrame:
    return lined.groupBy(HOST).agg(F.count(F.lit(1)).alias("host_docs"))


def _by_host(frequent: DataFrame) -> DataFrame:
    """HOST, _set: its frequent lines in buckets of about eight by hash, so that a line is looked up among few."""
    sizes = frequent.groupBy(HOST).agg(F.ceil(F.count(F.lit(1)) / 8).cast("int").alias("n"))
    line = F.struct("a", "b")
    rows = frequent.join(sizes, HOST).select(HOST, F.pmod(F.col("a"), F.col("n")).cast("int").alias("k"), line.alias("x"))
    empty = sizes.select(HOST, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("x"))
    buckets = rows.unionAll(empty).groupBy(HOST, "k").agg(F.collect_list("x").alias("x"))
    return buckets.groupBy(HOST).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("_set"))


def flag(lined: DataFrame, frequent: DataFrame, key: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lined with GONE: for each line whether `frequent` (HOST, a, b, unique) names it; null if it can name none.

    frequent is broadcast if it has at most broadcast_rows rows. Else the line hashes are joined to it by
    shuffle, and the places of the lines joined back by a hash of the columns of `key`.
    """
    frequent = staged(frequent.select(HOST, "a", "b"), "frequent-lines")
    if frequent.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = lined.join(F.broadcast(_by_host(frequent)), HOST, "left")
        found = F.transform(LINES, lambda x: x.isNotNull() & F.coalesce(F.array_contains(F.get(F.col("_set"), F.pmod(x["a"], F.size("_set")).cast("int")), x), F.lit(False)))
        return joined.withColumn(GONE, F.when(F.col("_set").isNotNull(), found)).drop("_set")
    k1, k2 = content_key(*key)
    keyed = lined.withColumns({"_k1": k1, "_k2": k2})
    rows = keyed.select("_k1", "_k2", HOST, F.posexplode(LINES).alias("i", "x")).where("x is not null")
    rows = rows.select("_k1", "_k2", HOST, "i", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    marks = staged(rows.join(frequent.hint("merge"), [HOST, "a", "b"]).select("_k1", "_k2", "i"), "line-marks")
    marks = marks.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("i")).alias("_at"))
    joined = keyed.join(marks, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    # the places as a word of noughts and ones, one letter a line
    ones = F.array_join(F.transform("_at", lambda i, k: F.concat(F.repeat(F.lit("0"), i - F.coalesce(F.get(F.col("_at"), k - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    return joined.withColumn(GONE, F.when(F.col("_at").isNotNull(), F.transform(F.split(F.rpad(ones, F.size(LINES), F.lit("0")), ""), lambda c: c == "1"))).drop("_at")


def without_gone(text: str) -> Column:
    """The text without the lines that GONE marks; one without such lines stays as it is. The text is cut once, not for
    each line, so the work grows with its length."""
    kept = F.zip_with(F.split(text, "\n"), F.col(GONE), lambda line, gone: F.when(~gone, line))
    return F.when(n_gone() == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))


def n_gone() -> Column:
    return F.when(F.col(GONE).isNull(), 0).otherwise(F.size(F.filter(GONE, lambda x: x)))


def gone_chars(text: str) -> Column:
    """How many characters other than white space the lines that GONE marks have."""
    sizes = F.zip_with(F.split(F.coalesce(text, F.lit("")), "\n"), F.col(GONE), lambda line, gone: F.when(gone, F.length(words_only(line))).otherwise(0))
    return F.when(n_gone() == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, x: s + x))


def words_only(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, WHITE, "")
