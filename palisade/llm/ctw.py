"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case (A-Z), joined by one space, and an end symbol (byte 0xFF, which UTF-8 never has). Each
byte is eight binary decisions; each decision, under the DEPTH bytes before it, has a Krichevsky-Trofimov estimate at
every depth from 0 to DEPTH, and the estimates are mixed by context-tree weighting: a node's weighted probability is the
mean of its own estimate and the product of its children's weighted probabilities, over the training data. A context
that training never had adds no node, so the mixture ends at the deepest context seen. A document's score is the log10
probability of its bytes under the trees of the training documents, which are fixed before any document is scored.

Documents are dealt by hash into blocks of about BLOCK_BYTES. A block names, to the buckets that hold them, the distinct
contexts and words that it has, with its training counts (a context bucket holds whole subtrees below two-byte contexts).
Counts of a bucket are summed FAN blocks at a time, in rounds, to one table of its distinct keys; its trees are built of
that, and give the log probability of each context and byte, or the count of each word. Tables then meet the requests
of GROUP blocks at a time, however many there are: no task gets all requests of a bucket. Nothing else goes anywhere
but the two shallowest levels of the trees, whose at most 65,280 nodes are summed in Spark and handed to all. The number
of buckets follows that of blocks, to MAX_BUCKETS. Words are told apart by 64-bit hashes.

Nulls: a null text is an empty one; a null doc_id isn't held out. Repeated rows and ids are rows of their own, and all count;
an empty table gives no rows; extra columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DEPTH, END = 5, 0xFF
BLOCK_BYTES, BLOCK_ROWS, CHUNK_BYTES = 32_000_000, 500_000, 1 << 19
#: Blocks whose counts are summed at a time, and whose requests are answered at a time.
FAN, GROUP, MAX_BUCKETS = 16, 64, 4096
FOLDS, HELD_OUT_FOLD = 10, 0
#: The key of the end token: no word has a space.
END_WORD = b" "
ROOT_NODES = 256 * 256


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0 by Stirling's series, after a shift by eight."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    with np.errstate(over="ignore"):
        small = np.where(np.isfinite(shift), np.log(shift), 0.0)
    large = x > 1e15
    if large.any():
        y, small, series = np.where(large, x, y), np.where(large, 0.0, small), np.where(large, 0.0, series)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - small


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any one sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Sums:
    """Distinct keys with their counts, summed as parts come: what waits is no more than what is summed, or one part."""

    def __init__(self) -> None:
        self.parts, self.n, self.waits = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waits += len(keys)
        if self.waits > self.n:
            self.n, self.waits = len(self.whole()[0]), 0

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.parts = [summed(keys, counts)]
        return self.parts[0]


def context_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its line) of every byte and end symbol; a key has the context, nearest byte first, and the byte itself last."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + x + bytes([END]) for x in lines), dtype=np.uint8)
    sizes = np.array([len(x) + 1 for x in lines])
    own = np.ones(len(data), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    for j in range(DEPTH):
        own[starts + j] = False
    key = np.zeros(len(data) - DEPTH, dtype=np.uint64)
    for j in range(1, DEPTH + 1):
        key |= data[DEPTH - j : len(data) - j].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - j))
    key |= data[DEPTH:]
    own = own[DEPTH:]
    return key[own], np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[list[bytes]], list[bytes]]]:
    """(index of the first, words, joined lines) of runs of texts of about CHUNK_BYTES, 65,536 at most."""
    at, words, lines, size = 0, [], [], 0
    for i, text in enumerate(texts):
        words.append(lower_words(text))
        lines.append(b" ".join(words[-1]))
        size += len(lines[-1])
        if size >= CHUNK_BYTES or len(lines) == 65_536:
            yield at, words, lines
            at, words, lines, size = i + 1, [], [], 0
    if lines:
        yield at, words, lines


def word_keys(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its text) of every word and end."""
    from xxhash import xxh3_64_intdigest as digest

    sizes = [len(w) + 1 for w in words]
    keys = np.fromiter((digest(w) for ws in words for w in (*ws, END_WORD)), dtype=np.uint64, count=sum(sizes))
    return keys, np.repeat(np.arange(len(words)), sizes)


def pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as their differences, the bytes of equal weight together."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy())


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n: int, contexts: bool) -> np.ndarray:
    """Bucket of each key: contexts by their nearest two bytes, words by their hash."""
    if contexts:
        top = keys >> np.uint64(8 * (DEPTH - 1))
        return ((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(n)
    return keys % np.uint64(n)


class Level:
    """Nodes at one depth and bit: ids in order, ones and total, own weight in the mixture, ln of the weighted probability."""

    def __init__(self, ids: np.ndarray, n1: np.ndarray, n: np.ndarray, below: np.ndarray | None):
        self.ids, self.n1, self.n = ids, n1, n
        own = log_kt((n - n1).astype(np.float64), n1.astype(np.float64))
        if below is None:
            self.weight, self.log_pw = np.ones(len(ids)), own
        else:
            self.weight = 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700)))
            self.log_pw = np.logaddexp(own, below) - np.log(2)


class Subtrees:
    """The context trees below two-byte contexts, of the counts of one bucket."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: dict[tuple[int, int], Level] = {}
        comp, c = keys[counts > 0], counts[counts > 0].astype(np.int64)
        for depth in range(DEPTH, 1, -1):
            if depth < DEPTH:
                comp, c = summed(((comp >> np.uint64(16)) << np.uint64(8)) | (comp & np.uint64(255)), c)
            for k in range(8):
                ids = comp >> np.uint64(8 - k)
                at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, dtype=int)
                one = ((comp >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
                n = np.add.reduceat(c, at) if len(at) else c
                n1 = np.add.reduceat(c * one, at) if len(at) else c
                ids, below = ids[at], None
                if depth < DEPTH:
                    deeper = self.levels[depth + 1, k]
                    mask = np.uint64((1 << k) - 1)
                    up = ((deeper.ids >> np.uint64(8 + k)) << np.uint64(k)) | (deeper.ids & mask)
                    below = np.bincount(np.searchsorted(ids, up), weights=deeper.log_pw, minlength=len(ids))
                self.levels[depth, k] = Level(ids, n1, n, below)

    def tops(self) -> tuple[np.ndarray, ...]:
        """(node, zeros, ones, ln weighted probability below), summed over the children of each depth-one node."""
        node, n0, n1, below = [], [], [], []
        for k in range(8):
            lv = self.levels[2, k]
            node.append((lv.ids >> np.uint64(8 + k)) * np.uint64(256) + (np.uint64(1 << k) | (lv.ids & np.uint64((1 << k) - 1))))
            n0.append(lv.n - lv.n1)
            n1.append(lv.n1)
            below.append(lv.log_pw)
        ids, inverse = np.unique(np.concatenate(node), return_inverse=True)
        total = lambda v: np.bincount(inverse, weights=np.concatenate(v).astype(np.float64), minlength=len(ids))
        return ids.astype(np.int64), total(n0).astype(np.int64), total(n1).astype(np.int64), total(below)

    def log10_probability(self, keys: np.ndarray, roots: Roots) -> np.ndarray:
        """log10 of the mixture's probability of each key's byte under its context."""
        total = np.zeros(len(keys))
        y = keys & np.uint64(255)
        for k in range(8):
            p, has = np.full(len(keys), 0.5), np.zeros(len(keys), dtype=bool)
            prefix = y >> np.uint64(8 - k)
            for depth in range(DEPTH, 1, -1):
                lv = self.levels[depth, k]
                if not len(lv.ids):
                    continue
                ids = ((keys >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(k)) | prefix
                at = np.minimum(np.searchsorted(lv.ids, ids), len(lv.ids) - 1)
                p, has = _mix(p, has, lv.ids[at] == ids, lv.n1[at], lv.n[at], lv.weight[at])
            node = (np.uint64(1 << k) | prefix).astype(np.int64)
            one = (keys >> np.uint64(8 * DEPTH)).astype(np.int64) * 256 + node
            p, has = _mix(p, has, roots.n[one] > 0, roots.n1[one], roots.n[one], roots.weight[one])
            p, has = _mix(p, has, roots.n_top[node] > 0, roots.n1_top[node], roots.n_top[node], roots.weight_top[node])
            bit = (y >> np.uint64(7 - k)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, p, 1.0 - p))
        return total


def _mix(p, has, found, n1, n, weight):
    own = (n1 + 0.5) / (n + 1.0)
    return np.where(found, np.where(has, weight * own + (1.0 - weight) * p, own), p), has | found


class Roots:
    """Depths one and zero of the trees: at most 255 nodes for each nearest byte, and 255 without context."""

    def __init__(self, rows: list[tuple[int, int, int, float]]):
        self.n, self.n1, below = np.zeros(ROOT_NODES, dtype=np.int64), np.zeros(ROOT_NODES, dtype=np.int64), np.zeros(ROOT_NODES)
        for node, n0, n1, b in rows:
            self.n[node], self.n1[node], below[node] = n0 + n1, n1, b
        level = Level(np.arange(ROOT_NODES), self.n1, self.n, below)
        self.weight = level.weight
        by_byte = lambda v: v.reshape(256, 256).sum(axis=0)
        self.n_top, self.n1_top = by_byte(self.n), by_byte(self.n1)
        top = Level(np.arange(256), self.n1_top, self.n_top, by_byte(np.where(self.n > 0, level.log_pw, 0.0)))
        self.weight_top = top.weight


REQUEST = "block int, bucket int, keys binary, counts binary"
TABLE = "bucket int, part int, keys binary, counts binary"
VALUES = "bucket int, keys binary, found binary"
ANSWER = "block int, bucket int, keys binary, found binary"


def _requests(texts: pa.ChunkedArray, held: list[bool], block: int, buckets: int) -> pa.Table:
    """What a block asks: its distinct contexts and words with their training counts, by bucket."""
    found = {True: Sums(), False: Sums()}
    for at, words, lines in chunks(_each(texts)):
        train = ~np.array(held[at : at + len(lines)], dtype=bool)
        for contexts in (True, False):
            keys, index = context_keys(lines) if contexts else word_keys(words)
            found[contexts].add(*summed_fast(keys, train[index.astype(np.int64)]))
    out = {"block": [], "bucket": [], "keys": [], "counts": []}
    for contexts, sums in found.items():
        keys, counts = sums.whole()
        where = bucket_of(keys, buckets, contexts)
        for b in np.unique(where):
            mine = where == b
            out["block"].append(block)
            out["bucket"].append(int(b) if contexts else -1 - int(b))
            out["keys"].append(pack_keys(keys[mine]))
            out["counts"].append(pack(counts[mine]))
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _each(texts: pa.ChunkedArray) -> Iterator[str | None]:
    """The texts one at a time: no second copy of a block."""
    return (x.as_py() for x in texts)


def summed_fast(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the number of times that each is in training."""
    if len(keys) and int(keys.max()) < 1 << 63:
        both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
        keys, train = both >> np.uint64(1), both & np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(train.astype(np.int64), at)
    return summed(keys, train.astype(np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of each row, one at a time."""
    for batch in batches:
        for bucket, keys, counts in zip(batch.column("bucket"), batch.column("keys"), batch.column("counts"), strict=True):
            yield bucket.as_py(), unpack_keys(keys.as_py()), unpack(counts.as_py(), np.int64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket with their counts: rows are unpacked one at a time."""
    found = Sums()
    for _, keys, counts in _rows(table.to_batches()):
        found.add(keys, counts)
    return found.whole()


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out_fold: int = HELD_OUT_FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length per byte of the scored text) of every document."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total[0]) // BLOCK_BYTES), -(-int(total[1]) // BLOCK_ROWS))
    buckets = min(MAX_BUCKETS, max(8, 2 * blocks))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    dealt = docs.select("doc_id", "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def ask(table: pa.Table) -> pa.Table:
        return _requests(table.column("text"), table.column("held_out").to_pylist(), table.column("block")[0].as_py(), buckets)

    requests = cut(dealt.groupBy("block").applyInArrow(ask, REQUEST))

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        first = table.slice(0, 1)
        return pa.table({"bucket": first.column("bucket"), "part": first.column("part"), "keys": pa.array([pack_keys(keys)], pa.binary()), "counts": pa.array([pack(counts)], pa.binary())})

    tables, left = requests.withColumnRenamed("block", "part"), blocks
    while True:
        tables = tables.select("bucket", F.expr(f"part div {FAN}").cast("int").alias("part"), "keys", "counts").groupBy("bucket", "part").applyInArrow(merge, TABLE)
        left = -(-left // FAN)
        if left == 1:
            break
    tables = cut(tables)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a context bucket its part of the depth-one nodes; of a word bucket, as node -1, tokens and types of training."""
        for bucket, keys, counts in _rows(batches):
            cols = ([-1], [int(counts.sum())], [int((counts > 0).sum())], [0.0]) if bucket < 0 else Subtrees(keys, counts).tops()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["node", "n0", "n1", "below"])

    nodes = tables.mapInArrow(sums, "node long, n0 long, n1 long, below double")
    # Summed by Spark to 65,281 rows at most.
    rows = [tuple(r) for r in nodes.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()]
    train_tokens, train_types = next(((r[1], r[2]) for r in rows if r[0] == -1), (0, 0))
    roots = docs.sparkSession.sparkContext.broadcast(Roots([r for r in rows if r[0] >= 0]))  # 65,280 nodes: 1.6 MB

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, counts in _rows(batches):
            found = counts.astype(np.int64) if bucket < 0 else Subtrees(keys, counts).log10_probability(keys, roots.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(found)], pa.binary())], names=["bucket", "keys", "found"])

    values = tables.mapInArrow(value, VALUES).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // GROUP))))

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        kind = np.int64 if asked.column("bucket")[0].as_py() < 0 else np.float32
        keys, found = unpack_keys(table.column("keys")[0].as_py()), unpack(table.column("found")[0].as_py(), kind)
        answers = [pack(found[np.searchsorted(keys, unpack_keys(k))]) for k in asked.column("keys").to_pylist()]
        return asked.select(["block", "bucket", "keys"]).append_column("found", pa.array(answers, pa.binary()))

    asked = requests.select("block", "bucket", "keys", F.expr(f"block div {GROUP}").cast("int").alias("group"))
    # Only groups of blocks that ask a bucket are met: an inner join, as a group without requests has no answers.
    met = lambda a, v: answer(a, v) if a.num_rows else pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("found", pa.binary())]).empty_table()
    answers = asked.groupBy("bucket", "group").cogroup(values.groupBy("bucket", "group")).applyInArrow(met, ANSWER)
    floor = 0.1 * (train_types + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = {}
        buckets_of = right.column("bucket").to_pylist()
        for contexts, kind in ((True, np.float32), (False, np.int64)):
            mine = [i for i, b in enumerate(buckets_of) if (b >= 0) == contexts]
            keys = np.concatenate([unpack_keys(right.column("keys")[i].as_py()) for i in mine])
            found = np.concatenate([unpack(right.column("found")[i].as_py(), kind) for i in mine])
            order = np.argsort(keys)
            tables[contexts] = keys[order], found[order]
        n_tokens, n_known, base, model, sizes = [], [], [], [], []
        for _, words, lines in chunks(_each(left.column("text"))):
            n = len(lines)
            sizes += [len(x) + 1 for x in lines]
            keys, index = context_keys(lines)
            both = np.sort((keys << np.uint64(16)) | index)  # 48 bits of key, 16 of index
            keys, index = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            value = tables[True][1][np.searchsorted(tables[True][0], keys[at])].astype(np.float64)
            model.append(np.bincount(index, weights=np.repeat(value, np.diff(np.append(at, len(keys)))), minlength=n))
            keys, index = word_keys(words)
            c = tables[False][1][np.searchsorted(tables[False][0], keys)]
            n_tokens.append(np.bincount(index, minlength=n))
            n_known.append(np.bincount(index, weights=c > 0, minlength=n).astype(np.int64))
            base.append(np.bincount(index, weights=np.log10((c + 0.1) / (train_tokens + floor)), minlength=n))
        rows = left.num_rows
        bits = np.concatenate(model) / (-np.log10(2) * np.array(sizes))
        cols = [pa.array(np.concatenate(n_tokens)), pa.array(np.concatenate(n_known)), pa.array(np.full(rows, train_tokens, dtype=np.int64)), pa.array(np.concatenate(base)), pa.array(np.concatenate(model)), pa.array(bits)]
        return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
