import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leaks

WORDS = [f"w{k}" for k in range(40)] + ["Ünï", "x_1", "数"]


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i, s in items:
            v = leaks.words_of(s)
            if any(tuple(v[k : k + size]) in have for k in range(len(v) - size + 1)):
                out.add((d, i))
    return out


def cases(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.choice([5, 20, 25, 40, 60])))) for i in range(12)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        parts = [rnd.choices(WORDS, k=rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            w = leaks.words_of(rnd.choice(items[:12])[1])
            a = rnd.randrange(len(w))
            parts += [[x.upper() for x in w[a : a + rnd.choice([24, 25, 26, 60])]], rnd.choices(WORDS, k=rnd.randrange(9))]
        docs.append((d, rnd.choice([", ", "\n  ", " -- "]).join(x for p in parts for x in p)))
    return docs + [(97, None), (98, ""), (99, "  \n")], items


def test_words():
    assert leaks.words_of("Foo_bar,BAZ-1 é́ß") == ["foo_bar", "baz", "1", "é", "ß"]
    assert leaks.words_of("Aİb") == ["ai̇b"]
    assert leaks.words_of(None) == [] == leaks.words_of("")


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = cases(seed)
        d = spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS window")
        i = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
        got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i).collect()}
        assert got == brute(docs, items, leaks.WINDOW)
    assert leaks.find_leaks(d.limit(0), i).count() == 0
    assert leaks.find_leaks(d, i.limit(0)).count() == 0


def test_blocks_of_items_make_no_difference(spark, monkeypatch):
    docs, items = cases(5)
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i).collect()} == brute(docs, items, leaks.WINDOW)


def test_recall_of_edited_passages():
    rnd = random.Random(7)
    items = [(i, " ".join(f"t{rnd.randrange(500)}" for _ in range(25))) for i in range(60)]
    index = leaks.ItemIndex(items, max_edits=1)
    docs = []
    for _, t in items:
        w = t.split()
        w[rnd.randrange(5, 20)] = "changed"
        docs.append(" ".join(["start", *w, "end"]))
    found = {(d, i) for d, i, _ in zip(*index.find(docs))}
    assert len({(i, i) for i in range(60)} & found) >= 0.9 * 60
    assert all(d == i for d, i in found)


def edited(rnd, words, edits, k):
    """words with so many substitutions, insertions and deletions at any place; k makes the new words unlike others."""
    w = list(words)
    for e in range(edits):
        kind, at = rnd.randrange(3), rnd.randrange(len(w))
        if kind == 0:
            w[at] = f"new{k}_{e}"
        elif kind == 1:
            w.insert(at, f"new{k}_{e}")
        else:
            del w[at]
    return w


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("joined", [False, True])
def test_recall_of_edits_of_all_kinds_at_all_places(spark, monkeypatch, edits, joined):
    """At least 0.9 of the passages that are so many edits apart, also at their borders; and no pair that is further apart."""
    rnd = random.Random(edits)
    items = [(i, " ".join(f"t{rnd.randrange(900)}" for _ in range(25))) for i in range(150)]
    docs = []
    for i, t in items:
        w = edited(rnd, t.split(), edits, i)
        docs.append((i, " ".join([*(f"x{rnd.randrange(99)}" for _ in range(rnd.randrange(9))), *w, *(f"y{rnd.randrange(99)}" for _ in range(rnd.choice([0, 3, 40])))])))
    if joined:
        monkeypatch.setattr(leaks, "BLOCK_CHARS", 10)
    if not joined:
        index = leaks.ItemIndex(items, max_edits=edits)
        found = {(d, i): e for d, i, e in zip(*index.find([t for _, t in docs]))}
    else:
        d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        found = {(r.doc_id, r.item_id): r.edits for r in leaks.find_leaks(d, i, max_edits=edits).collect()}
    assert sum((k, k) in found for k in range(150)) >= 0.9 * 150
    assert all(d == i and 0 <= e <= edits for (d, i), e in found.items())
    assert leaks.repetitions(25, leaks.SAMPLES, edits, leaks.RECALL) < 20


def test_equal_passages_are_all_found_whatever_edits_are_allowed(spark):
    docs, items = cases(9)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i, max_edits=1).where("edits = 0").collect()}
    assert got == brute(docs, items, leaks.WINDOW)


def test_sigma_between_words():
    assert leaks.words_of("ΟΔΟΣ κάτι") == leaks.words_of("ΟΔΟΣ.κάτι") == leaks.words_of("οδος Κάτι") == ["οδοσ", "κάτι"]


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    table = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    if a and b:
        # The least distance to any beginning of b.
        got = leaks.edit_distances(np.array([a]) + 1, np.array([b]) + 1)[0]
        assert got == min(table[-1])
