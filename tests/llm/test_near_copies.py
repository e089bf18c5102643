"""Near copies by Jaccard similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from palisade.llm import near_copies


def brute_kept(items, least=0.8):
    """The least id of each component, by sets of word tuples."""
    sets = []
    for _, t in items:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    comp = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and len(a & b) / len(a | b) >= least):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    first = {}
    for (i, _), c in zip(items, comp, strict=True):
        first[c] = min(first.get(c, i), i)
    return sorted(first.values())


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    texts = [None, "", " \n", "two words", "Two  words", "two other words"]
    for _ in range(25):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts += [" ".join(edited(w, n, rng)) for n in (0, 1, 2, 4, 8)]
    chain = [f"c{i}" for i in range(300)]
    for _ in range(12):
        chain = edited(chain, 5, rng)  # each near the one before, the ends unlike
        texts.append(" ".join(chain))
    base = [f"b{i}" for i in range(120)]  # a group larger than SMALL
    texts += [" ".join(edited(base, rng.randrange(0, 3), rng)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_copies_of_similarity_080(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:50], "x", *words[51:150], "y", *words[151:]]  # 186 of 206 shingles: 0.90
    far = [f"z{i}" if i % 20 == 0 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in enumerate((words, near, far))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_against_brute_force(spark, items):
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in items], "doc_id long, text string, n int")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(items)


def test_groups_larger_than_the_hubs(spark, items, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "HUBS", 1)
    monkeypatch.setattr(near_copies, "MORE", 3)  # rounds of 1, 3, 9... hubs
    docs = spark.createDataFrame(items, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(items)


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a B"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, near_copies.keep_one(docs).collect())) == sorted(["Row(doc_id=4, text='a B')", "Row(doc_id=None, text='c')"])
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_sets_and_bands():
    a = near_copies.shingle_set("A b c d e f g")
    assert len(a) == 3 and near_copies.similarity(a, near_copies.shingle_set("a  b c d e f\tg")) == 1.0
    assert near_copies.similarity(a, near_copies.shingle_set("a b c d e f x")) == 0.5
    rng = np.random.default_rng(1)
    for _ in range(200):  # pairs at 0.8 share a band
        h = rng.integers(0, 2**63, 180, dtype=np.uint64)
        x, y = np.unique(h[:160]), np.unique(np.concatenate([h[:160][20:], h[160:175]]))
        assert near_copies.similarity(x, y) >= 0.8
        assert set(near_copies.bands(x)) & set(near_copies.bands(y))


def test_sketches_leave_out_no_link():
    rng = np.random.default_rng(2)
    out = 0
    for _ in range(400):
        n, gone, new = int(rng.integers(1, 3000)), rng.random() * 0.5, rng.random() * 0.5
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        x, y = h, np.unique(np.concatenate([h[int(gone * n) :], rng.integers(0, 2**63, int(new * n), dtype=np.uint64)]))
        sketches = [np.frombuffer(near_copies.sketch(s), np.uint8) for s in (x, y)]
        may = near_copies.may_link(np.int64(len(x)), sketches[0], np.int64(len(y)), sketches[1], 0.8)
        assert may or near_copies.similarity(x, y) < 0.8
        out += not may
    assert out > 200
    full = np.frombuffer(near_copies.sketch(np.zeros(1000, dtype=np.uint64)), np.uint8)  # counts stop at 255
    assert full[0] == 255 and near_copies.may_link(np.int64(1000), full, np.int64(1000), full, 0.8)


def test_tiles_are_split(spark, items, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "HUBS", 8)
    monkeypatch.setattr(near_copies, "TILE", 3)
    docs = spark.createDataFrame(items, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(items)
