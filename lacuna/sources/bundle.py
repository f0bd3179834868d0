"""Fitted state kept in a folder: tables, a configuration, and a manifest that is checked before any table is read.

The tables are Parquet, so nothing that a bundle holds is code. Hashes show that a bundle has changed, not who made it: what was learned is
loaded only on the word of the caller (trusted).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Version of the manifest's own form, and the fields that it has.
SCHEMA_VERSION = "1.0"
FIELDS = {"schema_version", "kind", "feature_version", "files", "schemas", "metadata"}
KINDS = ("baseline", "trained")


@dataclass(frozen=True)
class Bundle:
    manifest: dict
    config: dict
    tables: dict[str, DataFrame]


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place, store = _store(spark, path)
    stream = store.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def _json(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n"


def _safe(name: str) -> bool:
    """A relative path that stays in the folder and is not the manifest."""
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and "\\" not in name and ":" not in name and not {"", ".", ".."} & set(parts) and parts[0] != "manifest.json"


def _listed(spark: SparkSession, root: str) -> tuple[dict[str, str], list[str]]:
    """({relative path: path} of the bundle's files but the manifest, the links among what lies in the folder). Spark's and Hadoop's own
    marks and checksums are no files of a bundle."""
    place, store = _store(spark, root)
    if not store.exists(place):
        raise ValueError("no such bundle")
    top = store.getFileStatus(place).getPath().toUri().getPath().rstrip("/")
    local, links, files = store.getScheme() == "file", [], {}
    waiting = [place]
    while waiting:
        for status in store.listStatus(waiting.pop()):
            uri = status.getPath().toUri()
            name = uri.getPath()[len(top) + 1 :]
            linked = status.isSymlink() or (local and spark._jvm.java.nio.file.Files.isSymbolicLink(spark._jvm.java.io.File(uri.getPath()).toPath()))
            if linked:
                links.append(name)
            elif status.isDirectory():
                waiting.append(status.getPath())
            elif not re.search(r"(^|/)(_SUCCESS|\.[^/]*\.crc)$", name) and name != "manifest.json":
                files[name] = status.getPath().toString()
    return files, links


def _hashes(spark: SparkSession, files: dict[str, str]) -> dict[str, str]:
    """{relative path: SHA-256}, hashed where the files are read. A bundle has as many files as its tables have parts."""
    if not files:
        return {}
    names = {spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath(): n for n, p in files.items()}
    rows = spark.read.format("binaryFile").load(list(files.values())).select("path", F.sha2("content", 256).alias("h")).collect()
    return {names[spark._jvm.org.apache.hadoop.fs.Path(r.path).toUri().getPath()]: r.h for r in rows}


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], config: dict, feature_version: str, kind: str = "baseline", metadata: dict | None = None) -> dict:
    """Writes tables, configuration and, last, the manifest, which it returns: a folder without a manifest is no bundle, so one that was
    cut short is never loaded. An existing bundle is not overwritten."""
    root = path.rstrip("/")
    place, store = _store(spark, root)
    if kind not in KINDS or any(not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", n) or n == "config" for n in tables):
        raise ValueError("no such kind or table name")
    if store.exists(place):
        raise FileExistsError(f"there is something at {root}")
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    _write_text(spark, f"{root}/config.json", _json(config))
    files, _ = _listed(spark, root)
    manifest = {"schema_version": SCHEMA_VERSION, "kind": kind, "feature_version": feature_version, "files": _hashes(spark, files), "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}, "metadata": metadata or {}}
    _write_text(spark, f"{root}/manifest.json", _json(manifest))
    return manifest


def checked(manifest: object) -> dict:
    """A manifest of exactly the known fields, this version, safe paths and hashes that can be some, each file in a table that has a schema."""
    if not isinstance(manifest, dict) or manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("a manifest of another version")
    if set(manifest) != FIELDS or manifest["kind"] not in KINDS or not all(isinstance(manifest[k], dict) for k in ("files", "schemas", "metadata")) or not isinstance(manifest["feature_version"], str):
        raise ValueError("a manifest of another form")
    for name, digest in manifest["files"].items():
        if not _safe(name):
            raise ValueError(f"an unsafe path: {name}")
        if not isinstance(digest, str) or not re.fullmatch("[0-9a-f]{64}", digest):
            raise ValueError(f"no hash of {name}")
        if name != "config.json" and (name.count("/") != 1 or name.split("/")[0] not in manifest["schemas"]):
            raise ValueError(f"a file of no table: {name}")
    if "config.json" not in manifest["files"]:
        raise ValueError("no configuration")
    return manifest


def load(spark: SparkSession, path: str, feature_version: str, trusted: bool = False) -> Bundle:
    """The bundle of a folder. Before any of its tables is read: the manifest's version and form, links and files that the manifest does not
    name or that are missing, every file's hash, the version of the features, and, for a trained bundle, the caller's word."""
    root = path.rstrip("/")
    files, links = _listed(spark, root)
    if links:
        raise ValueError(f"links in a bundle: {sorted(links)}")
    place, store = _store(spark, f"{root}/manifest.json")
    if not store.exists(place):
        raise ValueError("no manifest")
    try:
        manifest = checked(json.loads(_read_text(spark, f"{root}/manifest.json")))
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ValueError("a manifest of another form") from e
    if set(files) != set(manifest["files"]):
        raise ValueError(f"files that differ from the manifest's: {sorted(set(files) ^ set(manifest['files']))}")
    found = _hashes(spark, files)
    if changed := sorted(n for n, h in manifest["files"].items() if found.get(n) != h):
        raise ValueError(f"changed files: {changed}")
    if manifest["feature_version"] != feature_version:
        raise ValueError("features of another version")
    if manifest["kind"] == "trained" and not trusted:
        raise ValueError("a trained bundle is loaded only if trusted")
    tables = {n: spark.read.schema(StructType.fromJson(s)).parquet(f"{root}/{n}") for n, s in manifest["schemas"].items()}
    return Bundle(manifest, json.loads(_read_text(spark, f"{root}/config.json")), tables)
