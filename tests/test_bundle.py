"""Saved state: what is loaded equals what was saved; whatever has been tampered with is refused before a table is read."""

import json
import os
import tempfile

import pytest

from lacuna.sources import bundle


def saved(spark, kind="baseline"):
    path = f"{tempfile.mkdtemp()}/state"
    tables = {"priors": spark.createDataFrame([("a", 1, 0.5), ("b", None, 0.25)], "name string, season int, m double"), "empty": spark.createDataFrame([], "x date, y array<double>")}
    return path, tables, bundle.save(spark, path, tables, {"clip": [0, 1], "method": "prior"}, "2", kind, {"seeds": [1, 2]})


def parts(path, table="priors"):
    return [f"{path}/{table}/{f}" for f in sorted(os.listdir(f"{path}/{table}")) if f.startswith("part-")]


def rewrite(path, **changes):
    manifest = json.load(open(f"{path}/manifest.json"))
    manifest.update(changes)
    for crc in (f"{path}/.manifest.json.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    json.dump({k: v for k, v in manifest.items() if v is not ...}, open(f"{path}/manifest.json", "w"))
    return manifest


def test_round_trip(spark):
    path, tables, manifest = saved(spark)
    found = bundle.load(spark, path, "2")
    assert found.manifest == manifest and found.config == {"clip": [0, 1], "method": "prior"} and found.manifest["metadata"] == {"seeds": [1, 2]}
    assert set(found.tables) == {"priors", "empty"} and found.tables["empty"].schema == tables["empty"].schema
    assert sorted(map(str, found.tables["priors"].collect())) == sorted(map(str, tables["priors"].collect()))
    assert bundle.load(spark, path + "/", "2").config == found.config
    with pytest.raises(FileExistsError):
        bundle.save(spark, path, tables, {}, "2")


def test_trained_only_on_the_callers_word(spark):
    path, _, _ = saved(spark, "trained")
    with pytest.raises(ValueError, match="trusted"):
        bundle.load(spark, path, "2")
    assert bundle.load(spark, path, "2", trusted=True).config


@pytest.mark.parametrize("change", ["byte", "missing", "extra", "config", "no manifest", "no folder"])
def test_changed_files_are_refused(spark, change):
    path, _, _ = saved(spark)
    first = parts(path)[0]
    for name in os.listdir(os.path.dirname(first)):
        if name.endswith(".crc"):
            os.remove(f"{os.path.dirname(first)}/{name}")
    if change == "byte":
        data = bytearray(open(first, "rb").read())
        data[len(data) // 2] ^= 1
        open(first, "wb").write(data)
    elif change == "missing":
        os.remove(first)
    elif change == "extra":
        open(f"{path}/priors/part-99999.parquet", "wb").write(b"x")
    elif change == "config":
        os.remove(f"{path}/.config.json.crc")
        open(f"{path}/config.json", "w").write("{}")
    elif change == "no manifest":
        os.remove(f"{path}/manifest.json")
    else:
        path += "-not"
    with pytest.raises(ValueError):
        bundle.load(spark, path, "2")


@pytest.mark.parametrize("link", ["file", "folder", "manifest"])
def test_links_are_refused(spark, link):
    path, _, _ = saved(spark)
    target = {"file": parts(path)[0], "folder": f"{path}/priors", "manifest": f"{path}/manifest.json"}[link]
    moved = f"{tempfile.mkdtemp()}/elsewhere"
    os.rename(target, moved)
    os.symlink(moved, target)
    with pytest.raises(ValueError, match="links"):
        bundle.load(spark, path, "2")


def test_manifests_of_another_form_are_refused(spark):
    path, _, good = saved(spark)
    digest = "0" * 64
    bad = [
        {"schema_version": "2.0"}, {"kind": "other"}, {"extra": 1}, {"metadata": ...}, {"files": []}, {"feature_version": 2},
        *[{"files": {**good["files"], name: digest}} for name in ("../x", "/etc/x", "priors/../x", "priors\\x", "", "manifest.json", "other/part-0", "priors/a/b", "file:x/y")],
        {"files": {**good["files"], "config.json": "abc"}}, {"files": {k: v for k, v in good["files"].items() if k != "config.json"}},
    ]
    for change in bad:
        rewrite(path, **change)
        with pytest.raises(ValueError):
            bundle.load(spark, path, "2")
        rewrite(path, **{**good, **{k: ... for k in change if k not in good}})
    assert bundle.load(spark, path, "2").config
    open(f"{path}/manifest.json", "w").write("[")
    with pytest.raises(ValueError, match="another form"):
        bundle.load(spark, path, "2")
    rewrite_ok = json.dumps(good)
    open(f"{path}/manifest.json", "w").write(rewrite_ok)
    with pytest.raises(ValueError, match="version"):
        bundle.load(spark, path, "3")


def test_names_of_tables(spark):
    df = spark.range(1)
    for name in ("../x", "config", "a/b", "_x", ""):
        with pytest.raises(ValueError):
            bundle.save(spark, f"{tempfile.mkdtemp()}/s", {name: df}, {}, "1")
    with pytest.raises(ValueError):
        bundle.save(spark, f"{tempfile.mkdtemp()}/s", {"a": df}, {}, "1", "pickle")
