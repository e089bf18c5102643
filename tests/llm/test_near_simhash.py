"""Near copies by SimHash groups against brute-force similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from palisade.llm import near_copies, near_simhash
from test_near_copies import brute_kept, edited, items  # noqa: F401


def test_stage_groups_by_simhash(spark, monkeypatch):
    """The stage's links come through the fingerprints: with radii that nothing meets there are none."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(near_simhash, "candidates", lambda distinct, least, tile: spark.createDataFrame([], "a long, b long"))
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2


@pytest.mark.parametrize("tile, set_tile", [(near_simhash.TILE, near_simhash.SET_TILE), (7, 900)])
def test_against_brute_force(spark, items, tile, set_tile):  # noqa: F811
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in items], "doc_id long, text string, n int")
    kept = near_simhash.keep_one(docs, tile=tile, set_tile=set_tile)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(items)


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a B"), (None, "c"), (None, "c"), (None, None), (5, "d"), (5, "d")], "doc_id long, text string")
    assert sorted(map(str, near_simhash.keep_one(docs).collect())) == sorted(["Row(doc_id=4, text='a B')", "Row(doc_id=None, text='c')", "Row(doc_id=None, text=None)", "Row(doc_id=5, text='d')"])
    assert near_simhash.keep_one(docs.where("false")).count() == 0


def test_rows_are_shuffled_once(spark, items):  # noqa: F811
    kept = near_simhash.keep_one(spark.createDataFrame(items, "doc_id long, text string"))
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # rows, and what stays


def test_fingerprints_tell_080_from_unlike():
    rng = random.Random(3)
    far, near = [], []
    for _ in range(300):
        n = rng.randrange(46, 500)
        drawn = lambda k: np.array([rng.getrandbits(64) for _ in range(k)], dtype=np.uint64)
        both, a, b = drawn(n - n // 9), drawn(n // 9), drawn(n // 9)
        x, y, z = np.concatenate([both, a]), np.concatenate([both, b]), drawn(n)
        assert near_copies.similarity(np.sort(x), np.sort(y)) >= 0.8
        bits = [near_simhash.wide_fingerprint(s).view(np.uint64) for s in (x, y, z)]
        near.append(int(np.bitwise_count(bits[0] ^ bits[1]).sum()))
        far.append(int(np.bitwise_count(bits[0] ^ bits[2]).sum()))
    assert max(near) <= near_simhash.RADIUS < min(far)
