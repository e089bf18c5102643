"""SimHash near-duplicates by tiled exact comparison.

Each text becomes a 64-bit fingerprint. Distinct fingerprints within the radius are found exactly: a fingerprint is
cut into BANDS bands, and two that differ in at most RADIUS bits agree in at least BANDS - RADIUS of them, so every
such pair meets under one of the C(BANDS, RADIUS) keys made of the other bands. Under a key the fingerprints are sorted
by population count and compared tile by tile with exclusive-or and bit counts in numpy; tile pairs whose population
counts lie further apart than the radius are skipped. A key emits a spanning forest of its links, never all pairs, and
linked fingerprints become components by alternating large-star and small-star steps over DataFrames, with lineage cut
by checkpoints. Copies of a text share a fingerprint and are never expanded into pairs.

A key with more than HOT_KEY fingerprints is split: the bits that it leaves free are cut into BANDS bands in turn, and its
fingerprints meet under the keys of those. Such a key fixes 48 of 64 bits, so no task ever gets more than 65,536
fingerprints of a key, however many share it. Hubs of the star steps are dealt out by Spark's skew join.

Repeated rows and ids are rows of their own; an empty table gives no rows; of extra columns, keep_one() returns all as they
are and near_duplicates() none.

Nulls: a null text, like one without words, has fingerprint zero and is linked like any other; a null doc_id counts in no
minimum (a component of null ids alone has a null component_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_skewed, map_texts, pieces, written

SHINGLE, SEED, RADIUS, BANDS, TILE = 3, 42, 2, 4, 512
#: Fingerprints under one key beyond which the key is split.
HOT_KEY = 1 << 13


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles, repeats included, of the text with A-Z in lower case."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        h = np.array([digest(line, SEED)], dtype="<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -SHINGLE].tolist()]
        h = np.array([digest(view[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every document."""
    return map_texts(docs, "text", lambda t: (fingerprint(t),), ["doc_id"], "fp long")


def tiled_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest, as (member, root) index pairs, of the links among distinct fps (unsigned)."""
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order].astype(np.int64)
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, len(fps), tile):
        top = ones[min(a + tile, len(fps)) - 1]
        for b in range(a, len(fps), tile):
            if ones[b] - top > radius:
                break  # counts only rise from here
            at_a, at_b = np.nonzero(np.bitwise_count(fps[a : a + tile, None] ^ fps[None, b : b + tile]) <= radius)
            if a == b:
                at_a, at_b = at_a[at_a < at_b], at_b[at_a < at_b]
            if not len(at_a):
                continue
            # Of all near pairs in the tile, one for each two components as they are now.
            own = [np.array([root(i) for i in range(s, min(s + tile, len(fps)))]) for s in (a, b)]
            pairs = np.unique(own[0][at_a] * len(fps) + own[1][at_b])
            for ri, rj in zip((pairs // len(fps)).tolist(), (pairs % len(fps)).tolist(), strict=True):
                ri, rj = root(ri), root(rj)
                if ri != rj:
                    parent[max(ri, rj)] = min(ri, rj)
    roots = [root(i) for i in range(len(fps))]
    return [(int(order[i]), int(order[r])) for i, r in enumerate(roots) if r != i]


def band_masks(bits: list[int], radius: int, bands: int) -> list[int]:
    """Masks (of the bits fixed among the given ones) of the keys under which any two that differ in at most radius of the bits meet."""
    width = len(bits) // bands
    parts = [sum(1 << b for b in bits[i * width : (i + 1) * width]) for i in range(bands)]
    return [sum(p for i, p in enumerate(parts) if i not in free) for free in combinations(range(bands), radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _meeting(keyed: DataFrame) -> DataFrame:
    """keyed (m, k, fp) with n, the number of fingerprints under the key, where it is two or more. Counts are summed before they are shuffled; a key's rows may be many tasks'."""
    counts = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, ["m", "k"])


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) pairs of linked fingerprints whose components are those of all links. distinct: fp, each once."""
    masks = band_masks(list(range(64)), radius, bands)
    keys = F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)))
    met = cut(_meeting(distinct.select("fp", F.explode(keys).alias("key")).select("key.m", "key.k", "fp")))
    groups = met.where(F.col("n") <= hot_key)
    if (met.agg(F.max("n")).first()[0] or 0) > hot_key:
        finer = F.lit(None)
        for i, m in enumerate(masks):
            below = [m | x for x in band_masks([b for b in range(64) if not m >> b & 1], radius, bands)]
            finer = F.when(F.col("m") == i, F.array(*(F.struct(F.lit((i + 1) * 1000 + j).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for j, x in enumerate(below)))).otherwise(finer)
        split = met.where(F.col("n") > hot_key).select("fp", F.explode(finer).alias("key")).select("key.m", "key.k", "fp")
        groups = groups.unionByName(_meeting(split))

    def compare(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        found = tiled_links(fps, radius)
        of = fps.view(np.int64)
        return pa.table({"a": pa.array([of[i] for i, _ in found], pa.int64()), "b": pa.array([of[j] for _, j in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: a group at a time."""
        held, key = [], None
        for batch in batches:
            m, k = batch.column("m").to_numpy(), batch.column("k").to_numpy()
            cuts = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(m)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                if (m[lo], k[lo]) != key:
                    if held:
                        yield from compare(pa.Table.from_batches(held)).to_batches()
                    held, key = [], (m[lo], k[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare(pa.Table.from_batches(held)).to_batches()

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = groups.select("m", "k", "fp").repartition(n, "m", "k").sortWithinPartitions("m", "k")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex reachable. Large-star and small-star, to a fixed point."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))  # checkpointed


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge down or is the end of such, never both: then edges lead to the least vertices."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("end")), F.struct(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("end")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("end").alias("end")).where("down > 1 OR down = 1 AND end = 1").isEmpty()


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """fp, n_rows, component_id, and component (its least fingerprint), for each distinct fp of prints (doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    placed = cut(distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp")))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "component").select("fp", "n_rows", "component_id", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    prints = cut(fingerprints(docs))
    placed = join_skewed(prints, cut(fingerprint_components(prints).drop("component")), ["fp"])
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(marked: DataFrame, stays: DataFrame) -> DataFrame:
    """Of marked (row, fp) the rows, one each, of the doc_id and fp in stays (id, fp): of several, the one of least text hash."""
    row_id = F.col("row.doc_id")
    found = marked.withColumn("id", row_id).join(stays.withColumnRenamed("fp", "kept_fp").withColumnRenamed("id", "kept_id"), (F.col("fp") == F.col("kept_fp")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    one = found.withColumn("n", F.row_number().over(Window.partitionBy("fp", "id").orderBy(F.xxhash64("row.text"), "row.text")))
    return one.where("n = 1").select("row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one of least doc_id (null last), then least fingerprint and text hash."""
    kind, names = docs.schema["doc_id"].dataType, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                whole = pa.StructArray.from_arrays([part.column(c) for c in names], names=names)
                yield pa.RecordBatch.from_arrays([whole, pa.array([fingerprint(t) for t in part.column("text").to_pylist()], pa.int64())], names=["row", "fp"])

    marked = written(docs.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("fp", T.LongType())])), "simhash")
    prints = marked.select(F.col("row.doc_id").alias("doc_id"), "fp")
    parts = fingerprint_components(prints)
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first"))
    stays = parts.join(least, "fp").groupBy("component").agg(F.min(F.struct("first.none", "first.id", "fp")).alias("s")).select(F.col("s.id").cast(kind).alias("id"), F.col("s.fp").alias("fp"))
    return kept_rows(marked, stays)
