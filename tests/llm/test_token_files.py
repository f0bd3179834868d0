import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import token_files as T
from lacuna.staging import remove

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900), st.data())
def test_blocks_round_trip(ids, data):
    ids = np.array(ids, np.uint32)
    raw = T.segment((3, 1), np.array([5]), np.array([True]), np.array([len(ids)]), ids) + T.END.encode()
    (s,) = T.segments(raw)
    assert (s.part, s.number, s.n_ids) == (3, 1, len(ids))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert np.array_equal(s.read_ids(a, b), ids[a:b])


def test_outliers_are_exceptions():
    ids = np.full(256, 1000, np.uint32)
    ids[::2] = 1007
    ids[5] = 50_000
    minima, widths, *_, places, values, payload = T.pack(ids)
    assert minima.tolist() == [1000, 1000] and widths.tolist() == [4, 4] and places.tolist() == [5] and values.tolist() == [49_000] and len(payload) == 128


def test_round_trip(spark):
    texts = {7: "The cat  sat.\n", 3: None, 90: "", 11: "<|endoftext|> déjà vu " * 50, 2: " x" * 3000, 4: "word"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, start int").repartition(3)
    got = {x.doc_id: x for x in T.round_trip(df, PATH).collect()}
    library, start = Tokenizer.from_file(PATH), 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_edges(spark):
    assert T.round_trip(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b")], "doc_id bigint, text string")
    got = sorted((x.start, str(x.doc_id), x.n_tokens) for x in T.round_trip(df, PATH).collect())
    assert got == [(0, "None", 2), (2, "5", 2), (4, "5", 2)]


def test_small_segments(spark):
    df = spark.range(200).selectExpr("id as doc_id", "repeat('ab cd ', cast(id as int)) as text")
    path = T.new_path(spark, "small")
    T.write(df, PATH, path, segment_ids=50)
    for broadcast_rows in (0, 1000):
        rows = sorted((x.doc_id, x.start, x.n_tokens) for x in T.read(spark, path, broadcast_rows=broadcast_rows).collect())
        assert [r[0] for r in rows] == list(range(200)) and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_files_are_rolled(spark):
    df = spark.range(300).selectExpr("id as doc_id", "repeat('ab cd ', 20) as text")
    path = T.new_path(spark, "rolled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        T.write(df, PATH, path, segment_ids=50, segments_a_file=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = sorted((x.doc_id, x.start, x.n_tokens) for x in T.read(spark, path).collect())
    assert files.count() >= 30 and [r[0] for r in rows] == list(range(300)) and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_files_are_read_once(spark):
    df = spark.range(200).selectExpr("id as doc_id", "repeat('ab cd ', cast(id as int)) as text")
    path = T.new_path(spark, "once")
    T.write(df, PATH, path, segment_ids=50)
    read = T.read(spark, path)
    remove(spark, path)
    rows = sorted((x.doc_id, x.start, x.n_tokens) for x in read.collect())
    assert [r[0] for r in rows] == list(range(200)) and rows[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_one_id_in_many_partitions(spark):
    df = spark.range(400).selectExpr("if(id < 300, 7, id) as doc_id", "cast(id as string) as text")
    parts = T.by_range(df.selectExpr("doc_id as id", "text"), "id", 4).rdd.glom().map(lambda rows: [r.id for r in rows]).collect()
    assert [i for p in parts for i in p] == [7] * 300 + list(range(300, 400)) and max(map(len, parts)) < 200


def test_batches_are_bounded_while_files_are_written(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    class Watched(type(spark.range(0).write)):
        def text(self, *a, **b):
            seen.append(spark.conf.get(name, None))
            return super().text(*a, **b)

    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda df: Watched(df)))
    T.write(spark.range(5).selectExpr("id as doc_id", "'ab' as text"), PATH, T.new_path(spark, "bounded"))
    assert seen == [str(4 << 20)] and spark.conf.get(name, None) is None
