"""What single stages of the pipeline pass on."""

import corpus_pipeline
from lacuna.llm import decontamination


def test_quality_removes_lines(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{words} {i}\nMenu  of the site\n \nend {i}", "en", "s", 1) for i in range(20)] + [(30, None, "en", "s", None), (31, f"{words}\nx", "en", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.keep_quality(spark, docs, "").collect()}
    want = {i: f"{words} {i}\n \nend {i}" for i in range(20)}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {31: (f"{words}\nx", 7)}


def test_items_with_equal_or_no_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, f"x {three} y"), (4, "nothing of all this")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, one), (7, two), (None, three)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (3, None)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [4]
