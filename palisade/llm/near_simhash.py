"""Near copies by SimHash: tiles of wide fingerprints propose groups, whole shingle sets decide the links in them.

A text is the set of its 5-word shingles, as in near_copies, and its fingerprint has a bit for each of 64 * WORDS bits that is
1 if set in over half of the shingles' hashes. Distinct sets whose fingerprints differ in at most RADIUS bits are candidates,
found by tiled exclusive-or and bit counts as in simhash; a tile gives a spanning forest of them, never all pairs, and linked
fingerprints become groups by the same star steps. Two sets of similarity 0.8 differ in 15 % of the bits, 39 of 256 (standard
deviation 6), unrelated ones in 128 (8): RADIUS leaves out fewer than one pair of similarity 0.8 in a million, and lets
through nearly none that has no text in common. Fewer than SHORT shingles make rougher bits, so their radius is wider.

Sets are compared only with those whose sizes allow a similarity of 0.8: by classes of sizes, STEPS of them a factor of 1.25,
split by hash into parts of about TILE; a pair of parts is a tile, and each text is sent to the tiles of its part. Nothing
is capped or sampled: the comparisons, of 32 bytes each, grow with the square of the number of distinct sets.

Then every two sets of a group are compared whole, through an index of the group's shingles: a link is a similarity of 0.8 or
more, and components of links are near copies of one another. A group of more than SET_TILE shingles is split by hash into parts, and a
task holds two at a time. Only texts in groups are fetched. Copies of a set enter as one; rows move once, when the kept ones
are taken from the documents.

Nulls: a null text, like one without words, is the empty set, and these are copies of one another; a null doc_id comes
after all others. Of repeated rows one stays; an empty table gives no rows; extra columns come out as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, to_arrow
from .near_copies import FILTER_BITS, SHINGLE, SIMILARITY, shingle_set
from .simhash import components

#: 64-bit words of a fingerprint; bits in which candidates may differ in all, and in the first two words.
WORDS, RADIUS, FIRST_RADIUS = 4, 68, 48
SHORT, SHORT_RADIUS = 32, 84
#: Classes of sizes in the factor between the least and the largest size that can be linked; texts of a part; shingles of a part of a group.
STEPS, TILE, SET_TILE = 4, 1 << 15, 1 << 20
#: Fingerprints compared at a time within a tile.
ACROSS, DOWN = 256, 1024
_PRINT = [f"f{i}" for i in range(WORDS)]


def spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else other hashes of them (splitmix64)."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingle hashes, as WORDS signed 64-bit words; zero of none."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        wide = np.stack([spread(hashes[at : at + 255], w) for w in range(WORDS)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def set_key(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a shingle set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of docs beside t (the hash of the text) and key (the doc_id in a struct, equal for nulls), which tell rows apart."""
    return docs.select(*columns, F.xxhash64("text").alias("t"), F.struct(F.col("doc_id").alias("id")).alias("key"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id, t, v (key of the shingle set), size (of the set) and fingerprint of every document."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("id", to_arrow(kind)), ("t", pa.int64()), ("v", pa.int64()), ("size", pa.int32()), *((f, pa.int64()) for f in _PRINT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                prints = np.array([wide_fingerprint(s) for s in sets]).T
                columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(p, pa.int64()) for p in prints)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), *columns], schema=schema)

    words = ", ".join(f"{f} long" for f in _PRINT)
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"id {kind.simpleString()}, t long, v long, size int, {words}")


class Forest:
    """Spanning forest of n vertices, by the links given so far."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links of vertices a to vertices b; of all of them, one for each two components as they are now."""
        if not len(a):
            return
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        own = np.array([self.root(i) for i in ends.tolist()])[at]
        n = len(self.parent)
        for pair in np.unique(own[: len(a)] * n + own[len(a) :]).tolist():
            i, j = self.root(pair // n), self.root(pair % n)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def edges(self, v: np.ndarray) -> pa.RecordBatch:
        roots = np.array([self.root(i) for i in range(len(v))], dtype=np.int64)
        of = np.flatnonzero(roots != np.arange(len(v)))
        return pa.RecordBatch.from_arrays([pa.array(v[of], pa.int64()), pa.array(v[roots[of]], pa.int64())], names=["a", "b"])


def near_fingerprints(v: np.ndarray, size: np.ndarray, prints: np.ndarray, right: np.ndarray, least: float) -> pa.RecordBatch:
    """A spanning forest, as (a, b), of the candidates between the texts on the left and on the right of a tile; with none on the right, among all.

    prints: a row for each word.
    """
    order = np.argsort(size, kind="stable")
    v, size, prints, right = v[order], size[order].astype(np.int64), prints[:, order], right[order]
    same, forest = not right.any(), Forest(len(v))
    at_l, at_r = np.flatnonzero(~right), np.flatnonzero(right) if not same else np.arange(len(v))
    size_l, size_r = size[at_l], size[at_r]
    left, other = np.ascontiguousarray(prints[:, at_l]), np.ascontiguousarray(prints[:, at_r])
    for a in range(0, len(at_l), ACROSS):
        e = min(a + ACROSS, len(at_l))
        low = np.searchsorted(size_r, least * size_l[a] - 1e-6)
        high = np.searchsorted(size_r, size_l[e - 1] / least + 1e-6, "right")
        for b in range(max(low, a) if same else low, high, DOWN):
            d = min(b + DOWN, high)
            apart = np.bitwise_count(left[0, a:e, None] ^ other[0, None, b:d])
            apart += np.bitwise_count(left[1, a:e, None] ^ other[1, None, b:d])
            i, j = np.nonzero(apart <= FIRST_RADIUS)
            total = apart[i, j].astype(np.int64)
            i, j = i + a, j + b
            for w in range(2, WORDS):
                total += np.bitwise_count(left[w, i] ^ other[w, j])
            small, large = np.minimum(size_l[i], size_r[j]), np.maximum(size_l[i], size_r[j])
            near = (total <= np.where(small < SHORT, SHORT_RADIUS, RADIUS)) & (small >= least * large - 1e-6)
            if same:
                near &= i < j
            forest.link(at_l[i[near]], at_r[j[near]])
    return forest.edges(v)


def near_sets(v: np.ndarray, sets: list[np.ndarray], right: np.ndarray, least: float) -> pa.RecordBatch:
    """A spanning forest, as (a, b), of the links between the sets on the left and on the right of a tile; with none on the right, among all. Every such two are compared."""
    same, forest = not right.any(), Forest(len(v))
    at_l, at_r = np.flatnonzero(~right).tolist(), np.flatnonzero(right) if not same else np.arange(len(v))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(at_r)), size[at_r])
    hashes = np.concatenate([sets[i] for i in at_r])
    order = np.argsort(hashes, kind="stable")
    owner, (known, start, count) = owner[order], np.unique(hashes[order], return_index=True, return_counts=True)
    for i in at_l:
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        at = at[known[at] == sets[i]]
        n = count[at]
        have = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[have], minlength=len(at_r))
        j = at_r[shared / (size[i] + size[at_r] - shared) >= least]
        if same:
            j = j[j > i]
        forest.link(np.full(len(j), i), j)
    return forest.edges(v)


def in_tiles(rows: DataFrame, by: list[str], compare: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """The pairs (a, b) that compare gives of each tile of rows: those that agree in the columns by, of integers. A task holds a tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            of = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in by])
            bounds = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                now = tuple(of[:, lo].tolist())
                if now != key:
                    if held:
                        yield compare(pa.Table.from_batches(held))
                    held, key = [], now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield compare(pa.Table.from_batches(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def candidates(distinct: DataFrame, least: float, tile: int) -> DataFrame:
    """(a, b) pairs of keys whose components are those of all candidates. distinct: v, size and fingerprint of each set."""
    step = math.log(1 / least) / STEPS * (1 + 1e-9)
    # Two different sets can be linked only if they share so many shingles.
    sized = distinct.where(F.col("size") >= least / (1 - least) - 1e-6).select("v", "size", *_PRINT, F.floor(F.log("size") / step).cast("int").alias("c"))
    # Classes of sizes: fewer than 400, whatever the input; tiles: a few for each of them and of the parts that they are split into.
    parts = cut(sized.groupBy("c").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = parts.select("c", "parts", F.explode(F.sequence("c", F.col("c") + STEPS)).alias("d")).join(F.broadcast(parts.toDF("d", "others")), "d")
    tiles = cut(pairs.select("c", "d", "others", F.explode(up_to("parts")).alias("p")).select("c", "d", "p", F.explode(up_to("others")).alias("q")).where("c < d OR p <= q"))
    placed = sized.join(F.broadcast(parts), "c").withColumn("p", F.pmod(F.xxhash64("v"), "parts").cast("int")).drop("parts")
    left = placed.join(F.broadcast(tiles), ["c", "p"]).withColumn("right", F.lit(False))
    right = placed.withColumnsRenamed({"c": "d", "p": "q"}).join(F.broadcast(tiles.where("c < d OR p < q")), ["d", "q"]).withColumn("right", F.lit(True))

    def compare(tile: pa.Table) -> pa.RecordBatch:
        v, size, right, *prints = (tile.column(x).to_numpy() for x in ("v", "size", "right", *_PRINT))
        return near_fingerprints(v, size, np.stack([p.view(np.uint64) for p in prints]), right, least)

    columns = ["c", "p", "d", "q", "right", "v", "size", *_PRINT]
    return in_tiles(left.select(columns).unionByName(right.select(columns)), ["c", "p", "d", "q"], compare)


def links(docs: DataFrame, members: DataFrame, shingle: int, least: float, set_tile: int) -> DataFrame:
    """(a, b) pairs of keys whose components are those of all links within groups. members: g (the group), v, size and t, key of a document for each."""
    parts = members.groupBy("g").agg(F.ceil(F.sum("size") / set_tile).cast("int").alias("parts"))
    members = cut(members.join(parts, "g").select("g", "v", "t", "key", "parts"))
    at = F.pmod(F.xxhash64("t", "key"), F.lit(FILTER_BITS))
    # FILTER_BITS / 64 rows at most, whatever the input: 2 MB. It spares most texts the way to the join, and leaves out none that is asked for.
    words = members.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    asked = rows_of(docs, "text").withColumn("at", at).join(F.broadcast(words), F.expr("at div 64 = word")).where("getbit(bits, cast(at % 64 AS int)) = 1").select("t", "key", "text")
    x, q = F.pmod(F.xxhash64("v"), "parts").cast("int"), F.col("q")
    found = asked.join(members, ["t", "key"]).select("g", "v", "text", x.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    rows = found.select("g", F.least("own", q).alias("x"), F.greatest("own", q).alias("y"), (F.col("own") > q).alias("right"), "v", "text")

    def compare(tile: pa.Table) -> pa.RecordBatch:
        v, first = np.unique(tile.column("v").to_numpy(), return_index=True)  # a document may be there more than once
        texts = tile.column("text").take(pa.array(first))
        return near_sets(v, [shingle_set(t.as_py(), shingle) for t in texts], tile.column("right").to_numpy()[first], least)

    return in_tiles(rows, ["g", "x", "y"], compare)


def near_components(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """v, first (none, id, t), component of every distinct shingle set: its key, its least document, and the least key of its near copies."""
    marks = fingerprints(docs, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    distinct = cut(marks.groupBy("v").agg(first, *(F.min(c).alias(c) for c in ("size", *_PRINT))))
    roots = components(candidates(distinct, least, tile))
    groups = roots.withColumnRenamed("root", "g").unionByName(roots.select(F.col("root").alias("v"), F.col("root").alias("g")).distinct())
    members = groups.join(distinct, "v").select("g", "v", "size", "first.t", F.struct("first.id").alias("key"))
    roots = components(links(docs, members, shingle, least, set_tile))
    return distinct.select("v", "first").join(roots, "v", "left").select("v", "first", F.coalesce("root", "v").alias("component"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, min_similarity: float = SIMILARITY, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """One document of each component, with all its columns: the one of least doc_id (null last), then least key and text hash."""
    parts = near_components(docs, shingle, min_similarity, tile, set_tile)
    least = F.min(F.struct("first.none", "first.id", "v", "first.t")).alias("s")
    stays = cut(parts.groupBy("component").agg(least).select("s.t", F.struct("s.id").alias("key")))
    # Rows are shuffled once: the window deals them as the join does.
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("t"), F.struct(F.col("doc_id").alias("id")).alias("key"))
    one = whole.join(stays, ["t", "key"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("t", "key").orderBy("row.text")))
    return one.where("n = 1").select("row.*")
