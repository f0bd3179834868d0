"""Decontamination whatever the blocks of items, and short items."""

import random

import pytest

from lacuna.llm import decontamination as D


@pytest.mark.parametrize("block, order", [(1, 1), (1, -1), (3, 1), (1000, 1), (1000, -1)])
def test_blocks_change_nothing(spark, monkeypatch, block, order):
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(words, k=r.choice([8, 12, 20])))) for k in range(7)]
    texts = []
    for k in range(40):
        text = r.choices(words, k=60)
        if k % 3 == 0:
            a, b = items[k % 7][1].split(), items[(k + 1) % 7][1].split()
            text[5 : 5 + len(a)] = a
            text[40 : 40 + len(b) // 2] = b[: len(b) // 2]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items[::order], "item_id bigint, text string").coalesce(1)
    found = {(x.doc_id, x.item_id, round(x.similarity, 9), x.end_word) for x in D.contaminated(docs, bench).collect()}
    test_blocks_change_nothing.first = getattr(test_blocks_change_nothing, "first", found)
    assert found == test_blocks_change_nothing.first and len(found) > 10
    assert {x.doc_id for x in D.drop_contaminated(docs, bench).collect()} == set(range(40)) - {x[0] for x in found}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "see the Quick, brown fox jump"), (2, "a brown dog, a fox"), (3, "fox"), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "brown fox"), (2, "fox"), (3, "see the quick brown fox")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated(docs, bench).collect()} == {(1, 1), (1, 2), (1, 3), (2, 2), (3, 2)}


def test_clashing_and_repeated_columns(spark):
    kind = "doc_id string, text string, item_id int, similarity string, id int"
    docs = spark.createDataFrame([(None, "one two three four five", 1, "x", 2), ("a", "one two three four five", 1, "x", 2), ("a", "one two three four five", 1, "x", 2)], kind)
    bench = spark.createDataFrame([(5, "two three four")], "item_id bigint, text string")
    assert sorted((str(x.doc_id), x.item_id) for x in D.contaminated(docs, bench).collect()) == [("None", 5), ("a", 5), ("a", 5)]
    assert D.drop_contaminated(docs, bench).columns == docs.columns and D.drop_contaminated(docs, bench).count() == 0
