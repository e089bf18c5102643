"""The pipeline over small tables, each stage against what it should keep."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def brute_shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(stages):
    from palisade.llm import quality

    docs, good, known, one, mixed, coded = stages
    assert all(s.columns == docs.columns for s in (good, known, one, mixed))
    rules = {**quality.BASE_RULES, **quality.MORE_RULES}
    want = {r.doc_id for r in docs.collect() if not any(t(quality.Features(r.text)) for t in rules.values())}
    assert {r.doc_id for r in good.collect()} == want
    assert known.count() > 0.9 * good.count()
    # One document of each group at a similarity of 0.8 in five-word shingles, by brute force.
    items = [(r.doc_id, brute_shingles(r.text)) for r in known.collect()]
    comp = {i: i for i, _ in items}
    for i, a in items:
        for j, b in items:
            if len(a & b) >= 0.8 * len(a | b):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {k: new if c == old else c for k, c in comp.items()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comp.values()))
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(comp.values())
    assert coded.count() == mixed.count()


def test_mix_follows_targets(stages):
    one, mixed = stages[3], stages[4]
    words = lambda df: collections.Counter({s: sum(len(t.encode().split()) for t in ts) for s, ts in _by_source(df).items()})
    have, got = words(one), words(mixed)
    assert 1.2 * sum(have.values()) < sum(got.values()) < 1.8 * sum(have.values())


def _by_source(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.source].append(r.text)
    return out


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1].collect()))
