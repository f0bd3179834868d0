"""Encoders and counters against the library: characters of every plane, long pre-tokens, odd tables."""

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import bpe_automaton, chunk_store, pretokens, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CLASSES = pretokens.classes(PATH)


def random_text(r):
    out = []
    for _ in range(r.choice([0, 1, 2, 5, 20, 60])):
        kind = r.random()
        if kind < 0.3:
            out.append(chr(r.randrange(32, 127)))
        elif kind < 0.45:
            out.append(r.choice([" ", "  ", "\n", "\t", "\u3000", "\xa0", "\x85", "\x1c", "\0", "'", "<|endoftext|>", "'ll", "'S", "e", "the", "²", "Ⅷ"]))
        elif kind < 0.7:
            out.append(chr(r.choice([r.randrange(0x80, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x10000)])))
        else:
            out.append(chr(r.randrange(0x10000, 0x110000)))
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    parts = ["The", "cat", "é", "déjà", "漢字", "²", ",", ".", "'s", " ", "  ", "\n", "ª", "12", "x.", "Ⅷ", "ǅ", "_"]
    return [random_text(r) for _ in range(10_000)] + [" ".join("".join(r.choice(parts) for _ in range(r.randrange(4))) for _ in range(r.randrange(9))) for _ in range(3000)]


def by_library(texts):
    return [x.ids for x in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_ids(texts):
    want = by_library(texts)
    for encoder in (bpe_automaton.encoder(PATH, CLASSES), token_files.Encoder(PATH, CLASSES)):
        for k in range(0, len(texts), 4000):
            ids, counts = encoder.encode(texts[k : k + 4000])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[k : k + 4000]


def test_decoding(texts):
    encoder = bpe_automaton.encoder(PATH, CLASSES)
    ids, counts = encoder.encode(texts)
    assert [x.decode() for x in encoder.decoded(ids, counts)] == LIBRARY.decode_batch(by_library(texts), skip_special_tokens=False)
    odd = [[0, 187, 50256, 255], [128, 129, 130]]  # bytes that are no text by themselves
    assert [encoder.decode(np.array(x)) for x in odd] == [LIBRARY.decode(x, skip_special_tokens=False) for x in odd]


def test_counts(texts):
    assert token_counts.counter(PATH, CLASSES).count(texts) == list(map(len, by_library(texts)))


def test_classes_agree_on_all_characters():
    splitter, split = pretokens.Splitter(CLASSES), LIBRARY.pre_tokenizer.pre_tokenize_str
    for first in range(0, 0x110000, 0x10000):
        characters = [chr(c) for c in range(first, first + 0x10000) if not 0xD800 <= c < 0xE000]
        texts = ["".join(characters), "".join(reversed(characters))] + ["".join(f"A{c}1{c}\n" for c in characters)] * (first == 0)
        for text in texts:
            assert [text[a:b] for _, (a, b) in split(text)] == splitter.pieces(text)


def test_forgetting(texts, monkeypatch):
    monkeypatch.setattr(chunk_store.ChunkStore, "KEEP", 300)
    encoder, want = token_files.Encoder(PATH, CLASSES), by_library(texts[-3000:])
    for k in range(0, 3000, 100):
        ids, counts = encoder.encode(texts[-3000:][k : k + 100])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[k : k + 100]


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    given = []
    store = chunk_store.ChunkStore(pretokens.Splitter(CLASSES), lambda words: (given.extend(words), (np.arange(len(words), dtype=np.int32), np.ones(len(words), np.int64)))[1])
    for text in ("a cat sat", "a cat, sat.", "a\ncat; <|endoftext|>\n cat  sat", "a cat"):
        store.encode([text, text])
    assert given.count(" cat") == given.count(" sat") == 1 and len(given) == len(set(given))


def test_the_store_stays_small():
    store = chunk_store.ChunkStore(pretokens.Splitter(CLASSES), lambda words: (np.arange(2 * len(words), dtype=np.int32), np.full(len(words), 2)))
    tracemalloc.start()
    try:
        for k in range(0, 390_000, 10_000):
            ids, counts = store.encode([" ".join(["a", *(f"w{j}" for j in range(k, k + 10_000))])])
            assert counts.sum() == len(ids) == 40_002  # a word and a number, each with a space or without
        assert tracemalloc.get_traced_memory()[0] < 40e6
    finally:
        tracemalloc.stop()


def test_the_tables_of_a_worker_are_small():
    automaton = bpe_automaton.encoder(PATH, CLASSES).automaton
    assert sum(x.nbytes for x in vars(automaton).values() if isinstance(x, np.ndarray)) < 30e6


def test_arcs():
    automaton, r = bpe_automaton.encoder(PATH, CLASSES).automaton, random.Random(4)
    alive = [t for t in range(50_256) if automaton.born[t] >= -1]
    state, token = (np.array(r.choices(alive, k=50_000)) for _ in range(2))
    assert automaton.follows(state, token).tolist() == [automaton.has_arc(a, b) for a, b in zip(state.tolist(), token.tolist())]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "ACGT", "é漢"])
def test_long_words(letters):
    r = random.Random(5)
    texts = ["".join(r.choices(letters, k=n)) for n in (513, 5000, 30_000)]
    want = list(map(len, by_library(texts)))
    ids, counts = bpe_automaton.encoder(PATH, CLASSES).encode(texts)
    assert counts.tolist() == want and token_counts.counter(PATH, CLASSES).count(texts) == want
    assert ids.tolist() == [i for x in by_library(texts) for i in x]


def test_very_long_word_takes_seconds():
    word = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    began = time.process_time()
    (n,) = token_counts.counter(PATH, CLASSES).count([word])
    assert time.process_time() - began < 60
    _, counts = bpe_automaton.encoder(PATH, CLASSES).encode([word])
    assert time.process_time() - began < 180 and counts.tolist() == [n]


def test_odd_tables(spark):
    kind = "doc_id string, id int, text string, n_tokens string, ids string, n_bytes int"
    rows = [(None, 1, "a b", "x", "y", 9), ("k", 1, None, "x", "y", 9), ("k", 1, "", "x", "y", 9), ("k", 1, "a b", "x", "y", 9), ("k", 1, "a b", "x", "y", 9)]
    df = spark.createDataFrame(rows, kind)
    want = sorted([("None", 2), ("k", 0), ("k", 0), ("k", 2), ("k", 2)])
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe_automaton.encode(df, PATH).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect()) == want
    assert bpe_automaton.encode(df.limit(0), PATH).count() == token_counts.count_tokens(df.limit(0), PATH).count() == 0
