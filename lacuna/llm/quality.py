"""Quality rules: fixed counts of each text, and how much of it is lines that its host repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import host_lines as H
from lacuna.llm.common import BROADCAST_ROWS, WHITE, WHITE_RE

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _with_stats(df: DataFrame, text: str) -> DataFrame:
    """df with STATS. Each step is a column of its own so that it is computed once."""
    words = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    df = df.withColumn("_words", F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, WHITE_RE)))
    df = df.withColumn("_full_lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: H.words_only(x) != ""))
    word = F.col("_words")
    windows = F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))
    df = df.withColumn("_windows", F.when(F.size(word) < 3, F.array().cast("array<bigint>")).otherwise(windows))
    df = df.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    in_order = F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_sorted", in_order)
    row = F.col("_sorted")
    twice = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda k: (F.get(row, k - 1)["h"] == F.get(row, k)["h"]) | (F.get(row, k + 1)["h"] == F.get(row, k)["h"]))
    df = df.withColumn("_places", F.when(F.col("_repeats"), F.sort_array(F.transform(twice, lambda k: F.get(row, k)["i"]))))
    place = F.col("_places")
    # a window covers three words, or as many as lie before the next such window
    covered = F.aggregate(F.sequence(F.lit(0), F.size(place) - 1), F.lit(0), lambda s, k: s + F.least(F.lit(3), F.coalesce(F.get(place, k + 1) - F.get(place, k), F.lit(3))))
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(H.words_only(whole)).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("_full_lines") - F.size(F.array_distinct("_full_lines"))).cast("bigint"),
        "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(0).cast("bigint"),
    }).drop("_words", "_full_lines", "_windows", "_repeats", "_sorted", "_places")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", least_docs: int = 10, share: float = 0.05, most_removed: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, without the too frequent lines in text_col, with STATS, n_removed_chars, base_failed and kept.

    A line is too frequent if more than least_docs rows of its host, and more than `share` of them, hold it
    (lines compared lower-cased, white space made single). It is removed from the text, and its word characters
    count as removed; STATS and base_failed are those of the text as it was. A document
    is rejected if base_failed (under 50 words, or over half of them in repeated 3-word windows) or if over
    most_removed of its word characters are removed.

    A null text has no words, so it is rejected. A null host is a host of its own; each row is a document,
    also where ids are null or repeated. All other columns are kept; ones named like a result are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in (*STATS, "n_removed_chars", "base_failed", "kept")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in own if c != text_col]).alias("_row"), docs[id_col].alias("_id"), docs[text_col].alias("_text"), (F.lit(None).cast("string") if host_col is None else docs[host_col]).alias("_site"))
    lined = H.with_lines(packed, "_text", None if host_col is None else "_site")
    counts = H.line_counts(lined, least_docs + 1)
    frequent = counts.join(H.host_totals(lined), H.HOST).where(F.col("n_docs") > F.col("host_docs") * F.lit(share))
    marked = H.flag(lined, frequent, ["_id", "_site", "_text"], broadcast_rows)
    df = _with_stats(marked.withColumn("n_removed_chars", H.gone_chars("_text")), "_text").withColumn("base_failed", _failed())
    kept = ~F.col("base_failed") & (F.col("n_removed_chars") <= F.col("word_chars") * F.lit(most_removed))
    result = F.struct(*[(H.without_gone("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in own], *STATS, "n_removed_chars", "base_failed", kept.alias("kept"))
    # Filters on the result stop at the generator. Pushed below the steps of _with_stats they would repeat each step in
    # the next one's lambda, for every element.
    return df.select(F.explode(F.array(result)).alias("_result")).select("_result.*")
