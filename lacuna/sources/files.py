"""Readers and writers of panel, submission and fold files."""

from __future__ import annotations

import csv
import hashlib
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

from lacuna.staging import remove

KEYS = ("anon_polygon_id", "date")
VALUES = ("s2_ndvi", "s2_evi", "s2_ndwi", "landsat_ndvi", "landsat_evi", "landsat_ndwi", "modis_ndvi", "modis_evi", "era5_temp_c", "era5_precip_mm", "year", "doy", "primary_ndvi", "ndvi_climatology_mean", "ndvi_climatology_std", "n_reference_years")
KINDS = {"train": (*KEYS, *VALUES, "ndvi_zscore", "status", "crop_type"), "test": (*KEYS, *VALUES, "crop_type", "is_synthetic_gap")}


#: Files whose header is read at the same time.
OPEN_FILES = 32


def schema_of(kind: str) -> StructType:
    types = {"anon_polygon_id": StringType(), "date": DateType(), "status": StringType(), "crop_type": StringType(), "is_synthetic_gap": BooleanType()}
    return StructType([StructField(c, types.get(c, DoubleType())) for c in KINDS[kind]])


def _matching(spark: SparkSession, path: str) -> tuple[object, list]:
    """The store, and the data files that a path, folder or glob names, in order of name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = list(store.globStatus(place) or []), []
    while found:
        status = found.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            found += list(store.listStatus(status.getPath()))
        elif not name.startswith(("_", ".")):
            out.append(status.getPath())
    return store, sorted(out, key=lambda p: p.toString())


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header line, as CSV quotes it. Only the first line of a file is read, of many files at a time: a task's reader
    would have to go through a whole split for it."""
    store, places = _matching(spark, path)

    def first_line(place) -> str:
        stream = store.open(place)
        try:
            return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
        finally:
            stream.close()

    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        for place, line in zip(places, pool.map(first_line, places)):
            names = tuple(next(csv.reader([line.lstrip("\ufeff").strip()]), []))
            out.setdefault(names, []).append(place.toString())
    return out


def read_panel(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Panel CSVs of exactly the columns of their kind, each file in the order that its own header tells. Missing, extra or repeated
    columns, and values that do not parse, are errors; NaN and infinities become null."""
    types = {f.name: f.dataType for f in schema_of(kind)}
    parts = []
    for names, files in _headers(spark, path).items():
        if len(set(names)) != len(names):
            raise ValueError("repeated column names")
        if set(names) != set(KINDS[kind]):
            raise ValueError(f"missing {sorted(set(KINDS[kind]) - set(names))}, extra {sorted(set(names) - set(KINDS[kind]))}")
        df = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).csv(files, header=True, mode="FAILFAST")
        parts.append(df.select(*[F.col(c).cast(types[c]).alias(c) for c in KINDS[kind]]))  # in ANSI mode what does not parse is an error
    if not parts:
        raise ValueError(f"no file at {path}")
    df, inf = reduce(DataFrame.unionAll, parts), float("inf")
    return df.select(*[(F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c)).alias(c) if isinstance(types[c], DoubleType) else F.col(c)) for c in KINDS[kind]])


def control_totals(panel: DataFrame, keys: tuple[str, str] = KEYS, target: str = "primary_ndvi") -> DataFrame:
    """One row: rows, entities, first and last date, targets and their sum, keys that repeat; one aggregation and one by key."""
    one = panel.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(keys[0]).alias("entities"), F.min(keys[1]).alias("first_date"), F.max(keys[1]).alias("last_date"), F.count(target).alias("targets"), F.sum(F.col(target).cast("decimal(20,10)")).cast("double").alias("total"))
    repeats = panel.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    return one.crossJoin(F.broadcast(repeats))


def read_union(spark: SparkSession, paths: dict[str, str], hashes: dict[str, str] | None = None) -> DataFrame:
    """The panels of several kinds (kind: path) in one table with `dataset`, year, doy and day. Files must have the SHA-256 given
    for their kind; a key that stands twice, in one or in two of them, is an error."""
    for kind, wanted in (hashes or {}).items():
        found = {r.sha256 for r in file_sha256(spark, paths[kind]).collect()}  # a handful of files
        if found != {wanted}:
            raise ValueError(f"{kind} is not the file that was meant")
    parts = [read_panel(spark, path, kind).withColumn("dataset", F.lit(kind)) for kind, path in paths.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not both.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys")
    return both.withColumns({"year": F.year("date"), "doy": F.dayofyear("date"), "day": F.unix_date("date")})


def available_datasets(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """Pairs of files named {generation}_train.csv and {generation}_test.csv: only whole pairs, so generations never mix."""
    _, places = _matching(spark, folder)
    found: dict[str, dict[str, str]] = {}
    for place in places:
        if m := re.fullmatch(r"(.+)_(train|test)\.csv(?:\.gz)?", place.getName()):
            found.setdefault(m[1], {})[m[2]] = place.toString()
    return {name: pair for name, pair in sorted(found.items()) if len(pair) == 2}


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """The strings of a submission CSV; a semicolon file is an error."""
    first = spark.read.text(path).limit(1).first()
    if first and ";" in first[0]:
        raise ValueError("fields must be parted by commas")
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])  # a byte order mark is no part of a name


def write_submission(predictions: DataFrame, path: str, decimals: int | None = 10) -> None:
    """id, date and prediction in key order; with fixed decimals, or (None) so that they read back as the same numbers. A row without
    a finite prediction is an error.

    Written beside the path, read again and compared with what was meant, row by row in one grouping, and only then put in its place:
    whatever fails before, the old output stays.
    """
    spark = predictions.sparkSession
    p = F.col("primary_ndvi_pred").cast("double")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    text = F.format_string(f"%.{decimals}f", p) if decimals is not None else p.cast("string")
    rows = predictions.select("anon_polygon_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.when(bad, F.raise_error(F.lit("a prediction is no number"))).otherwise(text).alias("primary_ndvi_pred"))
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange("anon_polygon_id", "date").sortWithinPartitions("anon_polygon_id", "date")
    ordered.write.csv(beside, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    both = rows.withColumn("_n", F.lit(1)).unionAll(read_submission(spark, beside).select(*rows.columns, F.lit(-1)))
    if not both.groupBy(*rows.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty():
        remove(spark, beside)
        raise ValueError("what was written is not what was meant")
    place, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, beside))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    had = store.exists(place)
    if had and not store.rename(place, old) or not store.rename(new, place):
        raise OSError(f"cannot put the output at {path}")
    if had:
        store.delete(old, True)


def strict_lines(spark: SparkSession, path: str, fields: int = 3) -> DataFrame:
    """(path, rule, n) of what the bytes of submission files break: byte_order_mark, not_utf8, wrong_field_count (lines)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x != "")
    counts = {
        "byte_order_mark": F.startswith(F.hex("content"), F.lit("EFBBBF")).cast("bigint"),
        "not_utf8": text.isNull().cast("bigint"),
        "wrong_field_count": F.coalesce(F.size(F.filter(lines, lambda x: F.size(F.split(x, ",")) != fields)), F.lit(0)).cast("bigint"),
    }
    found = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("n")) for k, v in counts.items()])
    return files.select("path", F.explode(found).alias("x")).select("path", "x.*").where("n > 0")


def write_artifact(rows: DataFrame, path: str, order: list[str]) -> str:
    """Writes a table as gzipped CSV parts in order and returns its digest: the hash of the parts' hashes. The bytes of a gzip
    file depend on the library that packs it, so the digest is good for reading back, not for comparing machines."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "gzip").csv(path, header=True)
    return artifact_digest(rows.sparkSession, path)


def artifact_digest(spark: SparkSession, path: str) -> str:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.sha2("content", 256).alias("h"))
    return fingerprint("".join(sorted(r.h for r in found.collect())))  # one row a part


def read_artifact(spark: SparkSession, path: str, digest: str, schema: StructType | str) -> DataFrame:
    """A table of write_artifact; another digest is an error."""
    if artifact_digest(spark, path) != digest:
        raise ValueError("the artifact has changed")
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def export_series(series: DataFrame) -> DataFrame:
    """Every column as text: booleans 0/1, null empty; in order of date."""
    kinds = dict(series.dtypes)
    return series.orderBy("date").select(*[F.coalesce((F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("string"), F.lit("")).alias(c) for c in series.columns])


def save_folds(folds: DataFrame, path: str, version: str = "1") -> None:
    folds.withColumn("fold_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_folds(spark: SparkSession, path: str, version: str = "1") -> DataFrame:
    """Folds of this version with distinct keys, else an error."""
    folds = spark.read.parquet(path)
    if not folds.where(~F.col("fold_version").eqNullSafe(version)).isEmpty():
        raise ValueError("folds of another version")
    if not folds.groupBy("mode", "repeat", "fold", "entity", "date").count().where("count > 1").isEmpty():
        raise ValueError("repeated fold keys")
    return folds.drop("fold_version")


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file, hashed where it is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def bundle_ok(spark: SparkSession, path: str, manifest: dict[str, str]) -> bool:
    """Whether a folder holds exactly the files of the manifest (name: SHA-256)."""
    found = {r.path.rsplit("/", 1)[1]: r.sha256 for r in file_sha256(spark, path).collect()}  # a handful of files
    return found == manifest


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
