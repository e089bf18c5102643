"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bpe, ctw, langid, merkle, mixing, quality, simhash, tokens_out, viterbi, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, size long, fp string, row string, key string, n int, copy int, chunk int, block int, ll double"
EXTRA = (1, "kept?", 2, "fp", "row", "key", 3, 4, 5, 6, 0.5)
LONG = " ".join(f"word{i % 997} and then." for i in range(12_000)) + "\n" + "x" * 3000


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRA)


ROWS = [
    doc(1, "the quick brown fox jumps over the lazy dog. " * 4),
    doc(2, "the quick brown fox jumps over the lazy dog. " * 4),
    doc(3, None, None, None),
    doc(4, ""),
    doc(4, ""),
    doc(5, " \t\n\v\f\r "),
    doc(None, "a document without an id, but with some words in it.", "fr", "b"),
    doc(None, "a document without an id, but with some words in it.", "fr", "b"),
    doc(6, LONG, "en", "b"),
    doc(7, "Ünïcode — “quotes” 中文 😀 and <|endoftext|> or <|startoftext|> in text \x1c\x85\xa0 end", None, "c"),
    doc(8, "two words", "de", "c"),
    doc(8, "different text of a repeated id", "de", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, v) for v in x)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def test_quality(docs, none):
    got = quality.quality_report(docs)
    want = []
    for r in ROWS:
        w = (r[1] or "").encode().split()
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if x.encode().split()]
        want.append((r[0], len(w), sum(len(x.decode()) for x in w), sum((r[1] or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=key)
    assert not [r for r in got.collect() if r.base_failed and r.kept]
    assert quality.quality_report(none).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.collect())
    assert quality.filter_quality(none).count() == 0


def test_rule_order_changes_work_not_verdicts():
    texts = [r[1] for r in ROWS]
    rules = {**quality.BASE_RULES, **quality.MORE_RULES}
    order = quality.order_rules(map(quality.Features, texts), rules)
    assert sorted(order) == sorted(rules)
    for t in texts:
        verdicts = {quality.passes(o, rules)(quality.Features(t)) for o in (order, order[::-1], sorted(rules))}
        assert len(verdicts) == 1


def test_cascade_saves_evaluations():
    """Rules run by rejection per cost among the texts that are left, and none runs after a rejection."""
    now, runs = [0.0], collections.Counter()

    def rule(name, cost, rejects):
        def test(f):
            now[0] += cost
            runs[name] += 1
            return rejects(int(f.text))

        return test

    rules = {
        "dear": rule("dear", 50.0, lambda i: i % 2 == 0),  # 50 of 100 at 50 a text
        "cheap": rule("cheap", 1.0, lambda i: i % 5 == 0),  # 20 of 100 at 1
        "same": rule("same", 1.0, lambda i: i % 10 == 0),  # 10 of 100, but none once cheap has run
        "last": rule("last", 10.0, lambda i: i < 30),  # 24 of the 80 that are left
    }
    texts = [quality.Features(str(i)) for i in range(100)]
    order = quality.order_rules(texts, rules, clock=lambda: now[0])
    assert order == ["cheap", "last", "dear", "same"]
    runs.clear()
    now[0] = 0.0
    keep = quality.passes(order, rules)
    kept = [i for i, f in enumerate(texts) if keep(f)]
    assert kept == [i for i in range(30, 100) if i % 2 and i % 5]
    assert runs == {"cheap": 100, "last": 80, "dear": 56, "same": 28} and now[0] < 0.65 * 6200  # 6200: all rules on all texts


def test_counts_are_made_once(monkeypatch):
    made = collections.Counter()
    for name in ("words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
        whole = vars(quality.Features)[name].func
        again = quality.cached_property(lambda self, name=name, whole=whole: (made.update([name]), whole(self))[1])
        again.__set_name__(quality.Features, name)
        monkeypatch.setattr(quality.Features, name, again)
    f = quality.counted("some words of a text. " * 30)
    quality.base_failed(f)
    quality.passes(list(quality.MORE_RULES), quality.MORE_RULES)(f)
    assert set(made.values()) == {1}


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)
    assert bpe.encode_decode(none).count() == 0


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens_out.default_path())
    got = tokens_out.round_trip(docs).collect()
    want = []
    for r in ROWS:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert tokens_out.round_trip(none).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary, unk = viterbi.load_vocabulary(viterbi.default_path())
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unk))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=viterbi.META, prepend_scheme="always", split=True)])
    want = [(r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    assert rows(viterbi.token_counts(docs), "doc_id", "n_tokens") == sorted(want, key=key)
    assert viterbi.token_counts(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_report(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted(((r.doc_id, r.size) for r in got), key=key) == sorted(((r[0], size(r[1])) for r in ROWS), key=key)
    sources = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s))
    sizes = {s: sum(size(r[1]) for r in ROWS if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, open_ = 1.5 * sum(sizes.values()), set(sources)
    target = {}
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    assert all(r.taken <= 2 * r.size for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r.source_size, round(r.target, 6)] += r.taken
    want = collections.defaultdict(int)
    for s in sources:
        want[sizes[s], round(target[s], 6)] += round(target[s])
    words = round(total)
    block = words / mixing.lattice(words)[0]
    assert set(by) == set(want) and all(abs(by[k] - want[k]) < 2 * block + 1 for k in want)  # whole blocks
    assert sorted(got, key=str) == sorted(mixing.mix_report(docs).collect(), key=str)
    assert mixing.mix_report(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixing.mix(none).count() == 0


def test_schedule_decides_the_mix(spark, docs, monkeypatch):
    shares = spark.createDataFrame([(0, 50_000.0), (1, 20_000.0), (2, 9_000.0), (3, 1_000.0)], "s int, target double")
    placed = sorted(mixing.slots(shares, 80_000).collect(), key=lambda r: r.j)
    n, _ = mixing.lattice(80_000)
    assert [r.j for r in placed] == list(range(n))
    for r in placed:  # by definition: the interval that the point lies in
        r_point = r.j * mixing.lattice(80_000)[1] % n
        edges = [n * 50_000 // 80_000, n * 70_000 // 80_000, n * 79_000 // 80_000, n]
        assert r.s == next(i for i, e in enumerate(edges) if r_point < e)
    for prefix in (50, 500, 5000, n):  # every prefix of the mix has the shares of the weights, to a few slots
        have = collections.Counter(r.s for r in placed[:prefix])
        assert all(abs(have[s] - prefix * w / 80) < 4 for s, w in enumerate((50, 20, 9, 1)))
    ranks = collections.Counter()
    for r in placed:
        assert r.k == ranks[r.s]
        ranks[r.s] += 1
    words = lambda: rows(mixing.mix_report(docs), "doc_id", "size", "taken")
    want = words()
    plain = lambda shares, words: shares.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mixing.lattice(words)[0] - 1).cast("long"))).alias("k")).withColumn("j", F.col("k"))
    monkeypatch.setattr(mixing, "slots", plain)
    assert words() != want  # not the order alone: without the schedule, streams are played on beyond their targets


def test_taken_by_independent_model(spark):
    """taken and slot of each document, by walking the slots one by one over the stream of words."""
    texts = [(i, f"w{i} " * (1 + i * 7 % 40), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame([*texts, texts[7], texts[7]], "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    sizes = mixing.sized(df)
    order = [(r.source, r.doc_id, r.size * r.m) for r in sizes.orderBy(F.shiftrightunsigned("h", 64 - mixing.HASH_BITS), "h").collect()]
    goal = {r.source: r.target for r in mixing.targets(sizes).collect()}
    words = round(sum(goal.values()))
    n, p = mixing.lattice(words)
    edges = np.round(np.cumsum([goal[s] for s in "abc"])).astype(int) * n // words
    taken, first, rank = collections.Counter(), {}, collections.Counter()
    stream = {s: [d for _ in range(2) for t, d, k in order if t == s for _ in range(k)] for s in "abc"}
    for j in range(n):
        s = "abc"[int(np.searchsorted(edges, j * p % n, side="right"))]
        k = rank[s]
        rank[s] += 1
        for w in range(-(-k * words // n), -(-(k + 1) * words // n)):
            if w < len(stream[s]):
                taken[stream[s][w]] += 1
                first.setdefault(stream[s][w], j)
    have = collections.Counter()
    for r in got:
        have[r.doc_id] += r.taken
        assert r.slot == first.get(r.doc_id)
    assert {d: c for d, c in have.items() if c} == dict(taken)


def test_repeats_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEAT_CHUNK", 4)
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 11)], "v int, n long")
    assert sorted((r.v, r.i) for r in mixing.repeated(rows, "n").collect()) == [(v, i) for v, n in ((1, 0), (2, 1), (3, 4), (4, 5), (5, 11)) for i in range(n)]


def test_lm(docs, none):
    got = ctw.score_documents(docs).collect()
    c = collections.Counter()
    tokens = [ctw.lower_words(r[1]) + [b" "] for r in ROWS]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in ROWS]
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = [(r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for r, t, h in zip(ROWS, tokens, held)]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.score < 0 for r in got)
    assert ctw.score_documents(none).count() == 0


def test_op7_block_is_summed_in_bounded_memory():
    """Counting a block of many chunks holds little beside its distinct keys: no list of all chunks' keys."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(200)]
    texts = [pool[i % 200] for i in range(3000)]  # about 7 MB, few distinct contexts
    tracemalloc.start()
    asked = ctw._requests(pa.chunked_array([texts]), [False] * len(texts), 0, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    counts = sum(int(ctw.unpack(c.as_py(), np.int64).sum()) for c, b in zip(asked.column("counts"), asked.column("bucket"), strict=True) if b.as_py() < 0)
    assert counts == 3000 * 401  # words and ends


def test_op7_sums_as_parts_come():
    rng = np.random.default_rng(6)
    parts = [(np.unique(rng.integers(0, 500, n).astype(np.uint64)), n) for n in (300, 1, 50, 400, 2, 900)]
    found, want = ctw.Sums(), {}
    for keys, n in parts:
        found.add(keys, np.full(len(keys), n, dtype=np.int64))
        want = {k: want.get(k, 0) + (n if k in set(keys.tolist()) else 0) for k in {*want, *keys.tolist()}}
        assert found.waits <= found.n
    keys, counts = found.whole()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def naive_ctw(train, line):
    """The mixture by dictionaries and recursion, bit by bit."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    pad = bytes([ctw.END]) * ctw.DEPTH
    for t in train:
        data = pad + t + bytes([ctw.END])
        for i in range(ctw.DEPTH, len(data)):
            ctx = data[i - ctw.DEPTH : i][::-1]
            for k in range(8):
                node = (1 << k) | (data[i] >> (8 - k))
                for d in range(ctw.DEPTH + 1):
                    counts[ctx[:d], node][(data[i] >> (7 - k)) & 1] += 1
                    if d:
                        children[ctx[: d - 1], node].add(ctx[:d])

    def kt(s):
        a, b = counts[s]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def pw(ctx, node):
        if (ctx, node) not in memo:
            own = kt((ctx, node))
            memo[ctx, node] = own if len(ctx) == ctw.DEPTH else math.log(0.5) + np.logaddexp(own, sum(pw(x, node) for x in children[ctx, node]))
        return memo[ctx, node]

    total, data = 0.0, pad + line + bytes([ctw.END])
    for i in range(ctw.DEPTH, len(data)):
        ctx = data[i - ctw.DEPTH : i][::-1]
        for k in range(8):
            node, p = (1 << k) | (data[i] >> (8 - k)), None
            for d in range(ctw.DEPTH, -1, -1):
                if (ctx[:d], node) not in counts:
                    continue
                a, b = counts[ctx[:d], node]
                own = (b + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    w = 1 / (1 + math.exp(sum(pw(x, node) for x in children[ctx[:d], node]) - kt((ctx[:d], node))))
                    p = w * own + (1 - w) * p
            p = 0.5 if p is None else p
            total += math.log10(p if (data[i] >> (7 - k)) & 1 else 1 - p)
    return total


def test_lm_against_recursion(spark):
    texts = ["abra cadabra abra", "cad abra cad", "the cat sat on the mat", "a mat for the cat", "Abra the Cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    lines = [b" ".join(ctw.lower_words(t)) for t in texts]
    train = [x for x, h in zip(lines, held) if not h]
    got = {r.doc_id: r.score for r in ctw.score_documents(df).collect()}
    for i, x in enumerate(lines):
        assert abs(got[i] - naive_ctw(train, x)) < 1e-4


def test_lm_over_many_blocks(spark, monkeypatch):
    """Blocks, rounds of sums and groups of requests change no score; and the code length per byte is that of the score."""
    texts = ["abra cadabra abra", "cad abra cad", "the cat sat on the mat", "a mat for the cat", "Abra the Cat", "", None, "été à la mer"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in ctw.score_documents(df).collect()}
    for name, n in (("BLOCK_BYTES", 40), ("FAN", 2), ("GROUP", 3), ("MAX_BUCKETS", 11)):
        monkeypatch.setattr(ctw, name, n)
    got = {r.doc_id: r for r in ctw.score_documents(df).collect()}
    assert set(got) == set(whole)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[i].n_tokens, whole[i].n_known, whole[i].train_tokens)
        assert abs(r.score - whole[i].score) < 1e-5 and abs(r.base_score - whole[i].base_score) < 1e-9
        size = len(b" ".join(ctw.lower_words(texts[i]))) + 1
        assert abs(r.bits_per_byte + r.score / math.log10(2) / size) < 1e-9


def test_lm_probabilities_sum_to_one():
    keys, _ = ctw.context_keys([b"abracadabra", b"a cat"])
    keys, counts = ctw.summed(keys, np.ones(len(keys), dtype=np.int64))
    trees = ctw.Subtrees(keys, counts)
    roots = ctw.Roots([tuple(x) for x in zip(*trees.tops())])
    for base in (int(keys[0]) & ~255, int(keys[3]) & ~255, 0):
        every = np.arange(256, dtype=np.uint64) | np.uint64(base)
        assert abs((10 ** trees.log10_probability(every, roots)).sum() - 1) < 1e-9


def test_merkle(docs, none):
    got = merkle.document_fingerprints(docs)
    assert got.count() == len(ROWS)
    tie = {tuple(r): h for *r, h in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[0], r[1]], r[1] or ""))
    want = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        a, b = merkle.fingerprint(text), merkle.fingerprint(edited)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, merkle.fingerprint(following))))
    assert rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want, key=key)
    assert merkle.document_fingerprints(none).count() == 0
    assert merkle.document_fingerprints(docs.where("doc_id = 7")).first().near_next == 1.0


def test_merkle_parts():
    for r in ROWS:
        parts = merkle.paragraphs(r[1] or "")
        assert "".join(x for p in parts for x in p) == (r[1] or "")
        assert all(0 < len(x) <= merkle.MAX_LEAF for p in parts for x in p)
        assert all(len(x) >= merkle.MIN_LEAF for p in parts for x in p[:-1])
    text = "First sentence here.\nSecond sentence there.\nThird one now.\n\nNew section starts.\nIt ends."
    changed = text.replace("Second sentence there.", "Altered words.")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert a != b and merkle.fingerprint(text) == a
    (start, end), = merkle.differences(a, b)
    assert text[start:end] == "Second sentence there.\n"
    assert 0.5 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1.0 and merkle.differences(a, a) == []


def naive_tree(text):
    """(root, [(leaf, start, end)]): the tree by definition, character by character and without shortcuts."""
    from xxhash import xxh3_128_digest as digest

    codes, mask = [ord(c) for c in text], (1 << 32) - 1

    def mixed(c):
        x = c * 0x9E3779B1 & mask
        return (x ^ x >> 15) * 0x85EBCA6B & mask

    picks = set()
    for i in range(len(codes)):
        h = sum(mixed(codes[i - k]) * pow(0xC2B2AE35, k, 1 << 32) for k in range(merkle.WINDOW) if i >= k) & mask
        if (h >> 12) % merkle.MEAN_CUT == 0:
            picks.add(i + 1)
    leaves, nodes, sections, own, start = [], [], [], [], 0
    for i in range(1, len(text) + 1):
        last = i == len(text)
        line = text[i - 1] == "\n" and (last or text[i] != "\n") or last
        n = i - start
        if line or n == merkle.MAX_LEAF and not (i in picks and not line) or i in picks and n >= merkle.MIN_LEAF:
            leaves.append((text[start:i], start, i))
            own.append(digest(text[start:i].encode()))
            start = i
        if line:
            node = digest(b"paragraph" + b"".join(own))
            nodes.append(node)
            own = []
            if node[0] % merkle.SECTION_CUT == 0 or text[:i].endswith("\n\n") or last:
                sections.append(digest(b"section" + b"".join(nodes)))
                nodes = []
    return digest(b"root" + b"".join(sections)).hex(), leaves


def test_merkle_against_definition():
    rng = np.random.default_rng(2)
    texts = []
    for kind in range(4):
        alphabet = ["abcdefgh ", "ab\n", "中文字符日本語 ", "aé😀. \n"][kind]
        for _ in range(8):
            texts.append("".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 1500)))))
    texts += ["", "\n", "a" * 1000, "\n\n\n"]
    for t in texts:
        u = t[: len(t) // 2] + "X" * int(rng.integers(0, 3)) + t[len(t) // 2 + int(rng.integers(0, 9)) :]
        (root, leaves), (other, theirs) = naive_tree(t), naive_tree(u)
        a, b = merkle.fingerprint(t), merkle.fingerprint(u)
        assert a.partition(":")[0] == root and b.partition(":")[0] == other and (root == other) == (t == u)
        both = collections.Counter(x for x, _, _ in leaves) & collections.Counter(x for x, _, _ in theirs)
        shared = sum(len(x) * n for x, n in both.items())
        assert t == u or abs(merkle.likeness(a, b) - (2 * shared / (len(t) + len(u)) if t or u else 0)) < 1e-8
        covered = sum(y - x for x, y in merkle.differences(a, b))
        assert covered == (0 if t == u else len(t) - shared)
        left = collections.Counter(x for x, _, _ in leaves) - collections.Counter(x for x, _, _ in theirs)
        for x, y in merkle.differences(a, b):  # spans are whole leaves, none of which the other text has to spare
            inside = [leaf for leaf, s, e in leaves if x <= s and e <= y]
            assert sum(map(len, inside)) == y - x and t == u or not collections.Counter(inside) - left or len(left) == 0


def test_merkle_long_texts_are_hashed_in_steps(monkeypatch):
    whole = [merkle.cut_places(r[1] or "") for r in ROWS]
    monkeypatch.setattr(merkle, "HASH_STEP", 50)
    assert [merkle.cut_places(r[1] or "") for r in ROWS] == whole


def test_merkle_edits_are_found_in_any_script():
    rng = np.random.default_rng(6)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz    ", "中文字符日本語漢字仮名交文", "0123456789abcdef"):
        for n in (300, 3000):
            text = "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))
            edited = text[: n // 2] + "#" + text[n // 2 + 1 :]
            a, b = merkle.fingerprint(text), merkle.fingerprint(edited)
            (start, end), = merkle.differences(a, b)
            assert start <= n // 2 < end and end - start <= 2 * merkle.MAX_LEAF
            assert merkle.likeness(a, b) >= 1 - 2 * merkle.MAX_LEAF / n


def brute_components(items):
    fps = [simhash.fingerprint(t) & (2**64 - 1) for _, t in items]
    comp = list(range(len(items)))
    for _ in items:
        for i in range(len(items)):
            for j in range(len(items)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    ids = {c: min((i for (i, _), k in zip(items, comp) if k == c and i is not None), default=None) for c in set(comp)}
    return [(i, f"{f:016x}", ids[c]) for (i, _), f, c in zip(items, fps, comp)], len(ids)


def test_simhash(docs, none):
    want, parts = brute_components([(r[0], r[1]) for r in ROWS])
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == parts
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_fingerprint_by_definition():
    import xxhash

    for r in ROWS:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(r[1]) & (2**64 - 1) == want


def test_simhash_chains(spark):
    """Links by bit flips, in chains across bands and population counts, against brute force."""
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(30):
        x = int(rng.integers(0, 2**63))
        for _ in range(12):
            fps.add(x if x < 2**63 else x - 2**64)
            for b in rng.choice(64, size=int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    fps |= {int(v) for v in rng.integers(-(2**63), 2**63, 500)}
    order = sorted(fps)
    u = np.array(order, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    comp = np.arange(len(u))
    while True:
        new = np.where(near, comp[None, :], len(u)).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(order)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_components(prints).collect()}
    assert [got[f] for f in order] == comp.tolist()


def test_simhash_hot_key_is_split(spark):
    """Very many fingerprints under one band key: found as by brute force, and no task gets more than a few of them."""
    rng = np.random.default_rng(8)
    low = rng.choice(1 << 32, 4000, replace=False).astype(np.uint64)
    fps = np.unique(np.concatenate([low, low ^ np.uint64(1 << 7), low ^ np.uint64((1 << 30) | 2)]))  # the upper bands are zero in all
    prints = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = _forest_classes(fps, [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist() if j > i])
    for hot_key in (100, 1 << 20):
        at = {int(f): i for i, f in enumerate(fps)}
        got = [(at[r.a], at[r.b]) for r in simhash.links(prints, hot_key=hot_key).collect()]
        assert _forest_classes(fps, got) == want
    masks = simhash.band_masks(list(range(64)), 2, 4)
    for m in masks:
        finer = simhash.band_masks([b for b in range(64) if not m >> b & 1], 2, 4)
        assert len(finer) == 6 and all((m | x).bit_count() == 48 and not m & x for x in finer)


def _forest_classes(fps, pairs):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_components_of_any_graph(spark):
    rng = np.random.default_rng(12)
    shapes = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "random": [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(150)], "none": []}
    for pairs in shapes.values():
        want = _forest_classes(range(200), pairs)
        got = {r.v: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert [got.get(i, i) for i in range(200)] == want


def test_warc(spark):
    big, other = "<html>" + "x" * 200 + "</html>", "é" * 60
    pages = [(5, "http://a.example/1", big), (3, "http://a.example/2", big), (None, None, big), (9, "http://b.example/\r\nX: y", other), (4, "u", other), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (3, "u", big)]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, digest string, refers_to int")
    got = warc.archive_round_trip(spark, df)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        least = min(j for j, _, g in pages if g == h and j is not None)
        revisit = len(data) >= 100 and (i is None or i > least)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=key)
    assert warc.archive_round_trip(spark, df.where("false")).count() == 0


def test_warc_reader_refuses_bad_archives():
    import io

    def archive(*records):
        out = io.BytesIO()
        w = warc.ArchiveWriter(out, warc.train_dictionary([b"abc" * 50]))
        for r in records:
            w.add(r)
        return out.getvalue()

    good = warc.build_record(1, "http://x", b"hello world", None)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(archive(good, good)))] == [b"hello world"] * 2
    assert list(warc.read_records(io.BytesIO(archive()))) == []
    data = archive(good)
    for bad in (data[:-3], data[8:], b"", data[:6], b"\x00" * 40, archive(good[:-4]), archive(good.replace(b"hello", b"jello")), archive(good.replace(b"WARC/1.1", b"WORC/1.1")), archive(good.replace(b"Content-Length: 1", b"Content-Length: 9")), archive(good.replace(b"WARC-Date", b"WARC Date;"))):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(bad)))


MARKED = [("en", "the house and the garden are near the river where we walk in the evening"), ("fr", "la maison et le jardin sont près de la rivière où nous marchons le soir"), ("de", "das haus und der garten sind nahe am fluss wo wir am abend spazieren gehen")]


def test_language(spark, docs, none):
    model = langid.TextModel([(t, lang) for lang, t in MARKED for _ in range(3)])
    pages = []
    for i, (lang, t) in enumerate(MARKED * 4):
        pages.append((i, f"https://{lang}.site{i % 2}.example.{lang}/x", f'<html lang="{lang}"><script>the the the</script><body>{t}</body></html>'))
    pages += [(100, None, None), (None, "nonsense", ""), (101, "http://fr.site0.example.fr/y", "<html><body>12 34</body></html>"), (102, "http://h", "<html lang='xx'>" + "das haus " * 20000)]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in langid.identify_pages(df, model).collect()}
    assert len(got) == len(pages)
    assert all(got[i].lang == lang for i, (lang, _) in enumerate(MARKED * 4))
    assert got[101].text_lang is None and got[101].lang == "fr"  # of the host alone
    assert got[102].lang == "de" and got[100].text_lang is None and got[100].lang is not None
    assert langid.identify_pages(df.where("false"), model).count() == 0
    kept = langid.accept_documents(docs, model)
    assert kept.columns == docs.columns and langid.accept_documents(none, model).count() == 0
    assert 4 not in {r.doc_id for r in kept.collect()}


def test_language_posterior_by_definition(spark, monkeypatch):
    """The fused posterior against sums over lists of rows; hot domains and suffixes by the broadcast way."""
    from palisade.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 3)
    model = langid.TextModel([(t, lang) for lang, t in MARKED])
    rng = np.random.default_rng(3)
    pages = []
    for i in range(60):
        lang, t = MARKED[int(rng.integers(3))]
        said = ["", f' lang="{lang}"', ' lang="fr"', " lang=xx"][int(rng.integers(4))]
        words = [t.split()[int(j)] for j in rng.integers(0, len(t.split()), int(rng.integers(0, 6)))]
        host = f"h{int(rng.integers(4))}.d{int(rng.integers(3))}.{'com' if i % 4 else 'fr'}"
        pages.append((i, f"http://{host}/p", f"<html{said}>{' '.join(words)}</html>"))
    got = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    langs, rows = model.languages, []
    for i, url, page in pages:
        ll = model.score(langid.visible_text(page))
        said = langid.declared_language(page)
        rows.append((i, url.split("/")[2], "none" if said is None else said if said in langs else "other", ll, None if ll is None else int(np.argmax(ll))))
    kinds = len(langs) + 2

    def log_said(s, i):
        n = sum(r[4] == i for r in rows)
        hits = sum(r[4] == i and r[2] == s for r in rows)
        return math.log((hits + langid.BETA * (len(langs) + 2 if s == langs[i] else 1)) / (n + langid.BETA * (kinds + len(langs) + 1)))

    def count(i, end):
        return sum(r[4] == i and r[1].endswith(end) for r in rows)

    def prior(host):
        level = [(count(i, "") + 1) / (sum(count(j, "") for j in range(len(langs))) + len(langs)) for i in range(len(langs))]
        for end in ("." + host.split(".")[-1], ".".join(host.split(".")[-2:]), host):
            total = sum(count(i, end) for i in range(len(langs)))
            level = [(count(i, end) + langid.ALPHA * w) / (total + langid.ALPHA) for i, w in enumerate(level)]
        return level

    for i, host, said, ll, _ in rows:
        logs = np.array([math.log(p) + log_said(said, k) + (ll[k] if ll else 0.0) for k, p in enumerate(prior(host))])
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i].lang == langs[int(np.argmax(want))] and abs(got[i].posterior - want.max()) < 1e-9


def test_markup_is_scanned_once():
    import time

    cases = {
        "a<b>c</b>d": "a c d",
        "x<script a>no <b> this</Script >y": "x y",
        "x<!-- <b>no</b> -->y": "x y",
        "x<!-- open <b>y": "x y",
        "x<style>open <b>y": "x open  y",
        "1 < 2": "1 < 2",
        "<scripts>shown</scripts>": " shown ",
        "&lt;p&gt; &amp;": "<p> &",
    }
    for page, want in cases.items():
        assert langid.visible_text(page) == want, page
    for page, want in {'<html data-lang="fr" lang="en">': "en", "<HTML LANG=De-at>": "de", "<html><html lang='pt'>": "pt", "<html lang=": None, "<p lang='en'>": None}.items():
        assert langid.declared_language(page) == want, page
    for unit in ("<!--", "<script>", "<style", "<", "<html ", "<html lang ", "</script ", "<script></script", "<html lang=" + " " * 50):
        page = unit * (5_000_000 // len(unit))
        began = time.process_time()
        langid.visible_text(page)
        langid.declared_language(page)
        assert time.process_time() - began < 8, unit  # a quadratic scan takes hours


def test_language_sample(spark):
    """Copies enter the sample once, and a rare language has its share of it."""
    rows = [("the same text again and again", "en")] * 300 + [(f"text number {i} of the common language", "en") for i in range(100)] + [("uno dos tres quatro", "es")]
    seen = {}

    class Probe(langid.TextModel):
        def __init__(self, sample, languages):
            seen["rows"], seen["languages"] = sample, languages

    Probe.fit(spark.createDataFrame([(*r, 1) for r in rows] + [(None, "de", 1), ("x", None, 1)], "text string, lang string, h int"), rows=20)
    assert seen["languages"] == ["en", "es"] and ("uno dos tres quatro", "es") in seen["rows"]
    assert len(set(seen["rows"])) == len(seen["rows"]) == 11


def test_language_model_of_no_rows(none):
    model = langid.TextModel.fit(none)
    assert langid.accept_documents(none, model).count() == 0
