import random
import re

import pytest

from lacuna.llm import pii

KEY = b"test key"


def test_detection_and_formats():
    text = "Mail ann.b@mail3.example.com or call +1 (337) 555-7349, card 4242 4242 4242 4242, 10.0.0.1, GB82 WEST 1234 5698 7654 32, 123-45-6789. Mrs Ann Lee met Mr. LEE and Господин Иванов. version 3.0, 2024-01-02, 63815530"
    kinds = [(k, text[a:b]) for a, b, k in pii.find(text)]
    assert kinds == [("email", "ann.b@mail3.example.com"), ("phone", "+1 (337) 555-7349"), ("card", "4242 4242 4242 4242"), ("ip", "10.0.0.1"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("name_f", "Ann"), ("surname", "Lee"), ("surname", "LEE"), ("surname", "Иванов")]
    new, n = pii._replaced(text, KEY, {}, {})
    assert n == len(kinds) and len(pii.find(new)) == n
    for (kind, old), (a, b, same) in zip(kinds, pii.find(new)):
        made = new[a:b]
        assert same == kind and made != old
        if kind not in ("ip", "name_f", "surname"):
            assert re.sub(r"\w", "x", made) == re.sub(r"\w", "x", old)
        if kind == "card":
            assert pii.luhn(made.replace(" ", ""))
        if kind == "iban":
            assert pii.iban_ok(made)
    assert re.search("[а-я]", new) and new.endswith("version 3.0, 2024-01-02, 63815530")
    assert pii.surrogate(KEY, "name_f", "anna", 0)[-1] == "a" and pii.surrogate(KEY, "name_m", "anna", 0)[-1] in "nrs"


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_distinct_and_coreferent(spark, broadcast_rows):
    r = random.Random(2)
    mails = [f"{a}{b}@m.example.com" for a in "abcdefghij" for b in range(10)]  # nearly all that the format has
    texts = [None, "", "no entity"] + [" and ".join(r.sample(mails, 5)) for _ in range(200)] + [mails[3].upper() + " " + mails[3]]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_entities int, `row` string").repartition(3)
    got = {x.doc_id: x for x in pii.replace(df, KEY, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(texts) and got[0].text is None and got[1].text == "" and got[2].text == "no entity" and got[5].row == "x"
    made = {}
    for i, t in enumerate(texts[3:], 3):
        old = [t[a:b].lower() for a, b, _ in pii.find(t)]
        new = [got[i].text[a:b].lower() for a, b, _ in pii.find(got[i].text)]
        assert len(old) == len(new) == got[i].n_entities
        for a, b in zip(old, new):
            assert made.setdefault(a, b) == b
    assert len(set(made.values())) == len(made) and not set(made.values()) & set(mails)


def test_edges(spark):
    assert pii.replace(spark.createDataFrame([], "doc_id bigint, text string"), KEY).count() == 0
    df = spark.createDataFrame([(None, "a@b.com"), (None, "a@b.com")], "doc_id bigint, text string")
    a, b = pii.replace(df, KEY).collect()
    assert a == b and a.text != "a@b.com" and a.n_entities == 1


def test_whole_names_and_bare_mentions():
    text = "Smith came. Mr Juan Carlos Garcia Lopez met Dr John Smith's aunt; Lopez spoke, Smith's aunt and John left, smith stayed"
    got = [(k, text[a:b]) for a, b, k in pii.find(text)]
    assert got == [("surname", "Smith"), ("name_m", "Juan"), ("name_m", "Carlos"), ("name_m", "Garcia"), ("surname", "Lopez"), ("name", "John"), ("surname", "Smith"), ("surname", "Lopez"), ("surname", "Smith"), ("name", "John")]


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_one_surrogate_of_a_given_name(spark, broadcast_rows):
    texts = ["Mr John Smith", "Dr John Smith", "Prof Kim Lee", "Mr Kim Lee", "Mrs Kim Lee", "Dr Ann Poe", "Miss Ann Poe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = [r.text.split()[1:] for r in sorted(pii.replace(df, KEY, broadcast_rows=broadcast_rows).collect())]
    assert got[0] == got[1] and got[2] == got[3] == got[4] and got[5] == got[6]
    assert got[0][0][-1] in "nrs" and got[5][0][-1] == "a" and len({tuple(x) for x in got}) == 3


def plain_replace(texts, key):
    """The whole operator in plain Python: genders, rounds of draws, replacement."""
    found = {(k, pii.normal(k, t[a:b])) for t in texts for a, b, k in pii.find(t or "")}
    given = ("name", "name_m", "name_f")
    shown = {}
    for k, n in found:
        if k in given:
            shown.setdefault(n, set()).add(k)
    kind_of = {(k, n): ({"name_m": "name_m", "name_f": "name_f"}.get(next(iter(g)), "name") if k in given and len(g := shown[n] - {"name"}) == 1 else "name" if k in given else k) for k, n in found}
    group = {"name": "name", "name_m": "name", "name_f": "name", "surname": "name"}
    taken = {(group.get(k, k), n) for k, n in found}
    todo, attempt, made = {(kind_of[x], x[1]) for x in found}, 0, {}
    while todo:
        drawn = {x: (group.get(x[0], x[0]), pii.surrogate(key, *x, attempt)) for x in todo}
        won = {}
        for x, y in sorted(drawn.items()):
            if y not in taken:
                won.setdefault(y, x)
        made |= {x: y[1] for y, x in won.items()}
        taken |= won.keys()
        todo, attempt = todo - set(won.values()), attempt + 1
    out = []
    for t in texts:
        if t is None:
            out.append((None, 0))
            continue
        spans, at, parts = pii.find(t), 0, []
        for a, b, k in spans:
            n = pii.normal(k, t[a:b])
            parts += [t[at:a], pii.dressed(k, t[a:b], made[kind_of[k, n], n])]
            at = b
        out.append(("".join(parts) + t[at:], len(spans)))
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_against_plain(spark, broadcast_rows):
    r = random.Random(3)
    parts = ["Mr John Smith", "Dr John Smith", "Mrs Ann Lee", "Miss Kim", "Mr Kim", "Smith said", "Jean-Luc", "Dr Jean-Luc Picard", "Mr 王小明", "a1@b.de", "a2@b.de", "A1@B.de", "10.0.0.1", "10.0.0.2", "fe80::1ff:fe23:4567:890a", "call 555-1234", "tel. 555-1235", "+1 (337) 555-7349", "123-45-6789", "plain words", "12:30:45", "std::vector"]
    texts = [None, "", *[" and ".join(r.choices(parts, k=r.randrange(1, 7))) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = [(x.text, x.n_entities) for x in sorted(pii.replace(df, KEY, broadcast_rows=broadcast_rows).collect())]
    assert got == plain_replace(texts, KEY)


def test_formats_of_names_and_addresses():
    text = "Dr Jean-Luc Picard and Mr. O'Neil's car, Mr 王小明 spoke, fe80::1ff:fe23:4567:890a at 12:30:45, call 555-1234, std::be x::1"
    found = [(k, text[a:b]) for a, b, k in pii.find(text)]
    assert found == [("name", "Jean-Luc"), ("surname", "Picard"), ("surname", "O'Neil"), ("surname", "王小明"), ("ip6", "fe80::1ff:fe23:4567:890a"), ("phone", "555-1234")]
    new, _ = pii._replaced(text, KEY, {}, {})
    a, b = new.split(" ")[1:3]
    assert re.fullmatch(r"[A-Z][a-z]+-[A-Z][a-z]+", a) and b[0].isupper() and re.search(r"[A-Z][a-z]+'[A-Z][a-z]+'s car", new)
    name = re.search(r"Mr (\w+) spoke", new)[1]
    assert len(name) == 3 and name != "王小明" and all("一" <= c <= "鿿" for c in name)


def test_full_formats_grow():
    """Late attempts are longer, so rounds end also where a format is full."""
    assert len(pii.surrogate(KEY, "email", "a@x.com", 0).split("@")[0]) == 1 and len(pii.surrogate(KEY, "email", "a@x.com", 20).split("@")[0]) == 2
    assert len(pii.surrogate(KEY, "ssn", "123456789", 70)) == 10 and pii.dressed("ssn", "123-45-6789", "9876543210") == "987-65-43210"
