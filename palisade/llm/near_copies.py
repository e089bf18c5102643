"""Near copies by the Jaccard similarity of word shingles: MinHash bands propose pairs, shingle sets decide them.

A text is the set of its 5-word shingles (A-Z in lower case, white space as one space; a shorter text is one shingle).
Texts are linked at a similarity of SIMILARITY or more, and components of links are near copies of one another. Texts
that share a band, ROWS least values of as many permutations, are candidates. Two texts of similarity s share none of
BANDS bands with a probability of (1 - s^ROWS)^BANDS: under 1e-9 at 0.8. Every link is decided by the whole sets.

Before sets are fetched, sketches are compared: how many of a text's shingles fall into each of SKETCH slots. Two sets
differ in at least as many shingles as their counts do in all, so a pair whose counts differ too much is no link,
whatever its sets; nothing else is left out.

No group is capped. Small groups are compared whole. Each text of large ones is first compared with one other, that of
all its groups whose own groups are the largest; then the sketches of texts under one band are compared with those of a few
of them (hubs), in tiles, but for those already in a hub's component; hubs are then done with, and what lies in several
components still goes on to the next round with more hubs. A large group of near copies is one component after the first
step, in a number of comparisons that grows with the group and not with its square. Copies are told by a 64-bit hash of
their words and enter as one text. Texts are hashed once, and their keys written beside the rows to the shared folder.

Nulls: a null text, like one without words, is the empty set, and these are copies of one another; a null doc_id comes
after all others. Of repeated rows one stays; an empty table gives no rows; extra columns come out as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, written
from .simhash import components, kept_rows

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 4
#: Groups of at most so many texts are compared pair by pair at once; larger ones, after one pair a text, with so many hubs, and MORE times as many in each round after.
SMALL, HUBS, MORE = 16, 16, 256
#: Slots of a sketch, a byte each; texts and hubs of a group that a task compares at a time, roughly.
SKETCH, TILE = 256, 4096
#: Bits of the filter that spares most rows the way to the comparison; it lets through too many, never too few.
FILTER_BITS = 1 << 23
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] << np.uint64(1) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def text_key(text: str | None) -> int:
    """Signed 64-bit hash of the words: equal for copies."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(b" ".join(words_of(text)))).astype(np.int64))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return np.empty(0, dtype="<u8")
    view = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[shingle - 1 :] - 1).tolist() or [len(view)]
    starts = [0, *ends[:-shingle].tolist()] if len(words) >= shingle else [0]
    return np.unique(np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, last, strict=True)], dtype="<u8"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed 64-bit keys of the MinHash bands of a set; none of the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[at : at + 256, None] ^ _FLIP) * _TIMES).min(axis=0))
    view, step = memoryview(least.tobytes()), 8 * ROWS
    return np.array([xxh64_intdigest(view[i * step : (i + 1) * step], i) for i in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each slot, 255 at most."""
    return np.minimum(np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def may_link(size_a, sketch_a: np.ndarray, size_b, sketch_b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes and sketches (rows of counts) can have a similarity of least: false only where they can't."""
    apart = np.abs(sketch_a.astype(np.int16) - sketch_b).sum(axis=-1, dtype=np.int64)
    both = size_a.astype(np.int64) + size_b
    return both - apart >= least * (both + apart) - 1e-6


def marked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row (a document whole), v (its text's key), bands, sketch and size (of its set) of every document, from the shared folder."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                whole = pa.StructArray.from_arrays([part.column(c) for c in names], names=names)
                keys, of = [], []
                for text in part.column("text").to_pylist():
                    hashes = shingle_set(text, shingle)
                    keys.append(text_key(text))
                    of.append((bands(hashes), sketch(hashes), len(hashes)))
                columns = [pa.array(x, k) for x, k in zip(zip(*of, strict=True), (pa.list_(pa.int64()), pa.binary(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([whole, pa.array(keys, pa.int64()), *columns], names=["row", "v", "bands", "sketch", "size"])

    kind = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("v long, bands array<long>, sketch binary, size int")])
    return written(docs.mapInArrow(run, kind), "near-copies")


def linked(marks: DataFrame, pairs: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys whose sets reach min_similarity."""
    at = F.pmod("v", F.lit(FILTER_BITS))
    # FILTER_BITS / 64 rows at most, whatever the input: 2 MB.
    words = pairs.select(F.explode(F.array("a", "b")).alias("v")).select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    asked = marks.select("v", F.col("row.text").alias("text")).withColumn("at", at).join(F.broadcast(words), F.expr("at div 64 = word"))
    # Copies have the same words, and a task sends on one of them: a text with many isn't one task's.
    asked = asked.where("getbit(bits, cast(at % 64 AS int)) = 1").groupBy("v").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                whole = [shingle_set(t, shingle).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array(whole, pa.binary())], names=["key", "hashes"])

    found = cut(asked.mapInArrow(sets, "key long, hashes binary"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= min_similarity for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(found.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b").join(found.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a")
    return both.select("a", "b", "ha", "hb").mapInArrow(decide, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs (a, b) that may be links by their sketches. sketches: v, size, sketch."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (_counts(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            may = may_link(batch.column("size_a").to_numpy(), sa, batch.column("size_b").to_numpy(), sb, min_similarity)
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("v").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(decide, "a long, b long")


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def tiled_pairs(met: DataFrame, most: int, min_similarity: float) -> DataFrame:
    """The pairs (a, b) of a text of met (k, v, c, n, size, sketch, hub) and a hub of its group in another component that may be links by their sketches.

    A group has most hubs at most. Its texts and its hubs are split by hash into parts of about TILE; a part of each is a
    tile, and a task holds a tile at a time.
    """
    over = F.ceil(F.col("n") / TILE).cast("int")
    down = F.ceil(F.least("n", F.lit(most)) / TILE).cast("int")
    row, column = F.pmod(F.xxhash64("v"), over).cast("int"), F.pmod(F.xxhash64("v"), down).cast("int")
    tile = lambda x, y, hub: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(hub).alias("hub"))
    texts = F.transform(F.sequence(F.lit(0), down - 1), lambda y: tile(row, y, False))
    hubs = F.when(F.col("hub"), F.transform(F.sequence(F.lit(0), over - 1), lambda x: tile(x, column, True))).otherwise(F.slice(texts, 1, 0))
    rows = met.select("k", "v", "c", "size", "sketch", F.explode(F.concat(texts, hubs)).alias("at")).select("k", "at.*", "v", "c", "size", "sketch")

    def compare(tile: pa.Table) -> pa.RecordBatch:
        is_hub, v, c, size = (tile.column(x).to_numpy() for x in ("hub", "v", "c", "size"))
        counts = _counts(tile.column("sketch").combine_chunks())
        others, found = ~is_hub, []
        ov, oc, osize, ocounts = v[others], c[others], size[others], counts[others]
        for i in np.flatnonzero(is_hub):
            # Of other components, and not too unlike in size alone.
            near = np.flatnonzero((oc != c[i]) & (np.minimum(osize, size[i]) >= min_similarity * np.maximum(osize, size[i]) - 1e-6))
            near = near[may_link(osize[near], ocounts[near], size[i], counts[i], min_similarity)]
            found.append(np.stack([np.minimum(ov[near], v[i]), np.maximum(ov[near], v[i])]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile: a tile at a time."""
        held, key = [], None
        for batch in batches:
            of = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("k", "x", "y")])
            bounds = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                now = tuple(of[:, lo])
                if now != key:
                    if held:
                        yield compare(pa.Table.from_batches(held))
                    held, key = [], now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield compare(pa.Table.from_batches(held))

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, "a long, b long")


def near_components(marks: DataFrame, shingle: int = SHINGLE, min_similarity: float = SIMILARITY) -> DataFrame:
    """v, first (none, id), component of every distinct text of marked(): its key, its least doc_id, and the least key of its near copies."""
    doc_id = F.col("row.doc_id")
    distinct = cut(marks.groupBy("v").agg(F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))).alias("first"), F.first(F.struct("bands", "size", "sketch")).alias("of")))
    sketches = distinct.select("v", "of.size", "of.sketch")
    keyed = distinct.select("v", F.explode("of.bands").alias("k"))
    met = cut(keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k"))
    small, met = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)
    # First, small groups whole, and of large ones each text with the least hub of all its groups: one pair a text.
    # Texts whose groups are the largest come first: an original is under nearly every band of its edited copies.
    met = cut(met.join(met.groupBy("v").agg((-F.sum("n")).alias("rank")), "v").select("k", "v", "rank"))
    hub = met.groupBy("k").agg(F.min(F.struct("rank", "v")).alias("hub"))
    one = met.join(hub, "k").where("hub.v <> v").groupBy(F.col("v").alias("b")).agg(F.min("hub").alias("hub")).select(F.col("hub.v").alias("a"), "b")
    pairs = small.join(small.select("k", F.col("v").alias("a")), "k").where("a < v").select("a", F.col("v").alias("b")).unionByName(one)
    roots = components(linked(marks, cut(plausible(pairs.distinct(), sketches, min_similarity)), shingle, min_similarity))
    met, most = _placed(met, roots), HUBS
    while not met.isEmpty():
        # Then what lies in several components still, with all texts of the group as hubs, or the first of each of so many hash slices.
        slices = F.when(F.col("n") <= most, F.col("v")).otherwise(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(most)))
        hubs = met.groupBy("k", slices.alias("slice")).agg(F.min(F.struct("rank", "v")).alias("hub")).select("k", "hub.v", F.lit(True).alias("hub"))
        met = cut(met.join(hubs, ["k", "v"], "left").withColumn("hub", F.coalesce("hub", F.lit(False))))
        pairs = cut(tiled_pairs(met.join(sketches, "v"), most, min_similarity).distinct())
        met = met.where("NOT hub").drop("hub")
        if not pairs.isEmpty():
            found = cut(linked(marks, pairs, shingle, min_similarity))
            if not found.isEmpty():
                # What is known of components stands for the links that they came of.
                roots = components(found.unionByName(roots.toDF("a", "b")))
        if not met.isEmpty():
            met = _placed(met, roots)
        most *= MORE
    return distinct.select("v", "first").join(roots, "v", "left").select("v", "first", F.coalesce("root", "v").alias("component"))


def _placed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """k, v, rank of groups with the components c of their texts and the number n of these, of groups that lie in several. Groups are summed before they are shuffled."""
    now = met.select("k", "v", "rank").join(roots, "v", "left").select("k", "v", "rank", F.coalesce("root", "v").alias("c"))
    spread = now.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high")
    return cut(now.join(spread.select("k", "n"), "k"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, min_similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, with all its columns: the one of least doc_id (null last), then least key and text hash."""
    marks = marked(docs, shingle)
    parts = near_components(marks, shingle, min_similarity)
    stays = parts.groupBy("component").agg(F.min(F.struct("first.none", "first.id", "v")).alias("s")).select(F.col("s.id").alias("id"), F.col("s.v").alias("fp"))
    return kept_rows(marks.select("row", F.col("v").alias("fp")), stays)
