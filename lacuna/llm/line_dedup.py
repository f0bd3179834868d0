"""Line dedup by site-relative frequency: drops the lines that too large a share of a host's pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import host_lines as H
from lacuna.llm.common import BROADCAST_ROWS


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", ratio: float = 0.06, least_pages: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the boilerplate lines dropped from text_col, and n_lines and n_dropped (bigint).

    A line is boilerplate on its host if at least least_pages of the host's pages hold it and they are more
    than `ratio` of all its pages. Lines are compared lower-cased and with white space made single; the
    lines kept stay as they were. Lines without a word are never dropped. A null text stays null, with no
    lines; a text that only has boilerplate becomes empty. A null host is a host of its own; each row is a
    page, also where ids are null or repeated. Other columns are kept, whatever their names, except that
    columns named n_lines or n_dropped are replaced.
    """
    own = docs.columns
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in own if c != text_col]).alias("_row"), docs[id_col].alias("_id"), docs[text_col].alias("_text"), (F.lit(None).cast("string") if host_col is None else docs[host_col]).alias("_site"))
    lined = H.with_lines(packed, "_text", None if host_col is None else "_site")
    counts = H.line_counts(lined, max(1, least_pages))
    frequent = counts.join(H.host_totals(lined), H.HOST).where(F.col("n_docs") > F.col("host_docs") * F.lit(ratio))
    marked = H.flag(lined, frequent, ["_id", "_site", "_text"], broadcast_rows)
    rest = H.without_gone("_text")
    return marked.select(
        *[(F.when(F.col("_text").isNotNull(), rest) if c == text_col else F.col("_row").getField(c)).alias(c) for c in own if c.lower() not in ("n_lines", "n_dropped")],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(H.LINES)).cast("bigint").alias("n_lines"),
        H.n_gone().cast("bigint").alias("n_dropped"),
    )
