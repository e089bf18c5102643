"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The mix is a sequence of slots, each a block of as many words. Slot j has the golden-ratio point frac(j / phi), in its
exact integer form: with n slots, n a Fibonacci number and p the one before it, j * p mod n, which takes each of 0..n-1
once and is spread as evenly over every prefix of the slots. The point falls into one source's interval of the
cumulative targets; that source's slots are ranked, and rank k takes the k-th block of the source's stream: its
documents in hashed order, played EPOCHS times. What no slot names isn't taken, and the slots give the order of the mix.
A source's words so are its target but for less than two blocks; a block is 1/n of the mix, n being the greatest
Fibonacci number that leaves a word a block, MAX_SLOTS at most.

Nothing is numbered by one task over all rows: documents are summed within hash slices, slices offset by sums over the
(few) slices. Only the table of sources, one row each, is put in order as a whole; slots are MAX_SLOTS at most.

Nulls: a null source is a source of its own, last in order; a null text has no words. Documents without words take none.
Rows of equal id are separate documents; rows that agree in id, source and text are placed as one group, and share what
it takes evenly. An empty table gives no rows; extra columns aren't looked at, and mix() returns them as they are.
Products of words and slots must stay below 2^63, which they do up to 4 * 10^13 words; beyond, Spark raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_skewed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, TOTAL_SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
MAX_SLOTS = 200_000
HASH_BITS, POINT_BUCKETS = 12, 4096
#: Rows that are repeated more often than this are dealt out before.
REPEAT_CHUNK = 1 << 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """key, doc_id, source, size, h, m: documents without their texts; m rows agree in id, source and text."""
    key = F.xxhash64("doc_id", "source", "text")
    rows = docs.select(key.alias("key"), "doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "source", "text").alias("h"))
    return rows.groupBy("key", "doc_id", "source", "size", "h").agg(F.count("*").alias("m"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: float = EPOCHS) -> DataFrame:
    """source, s (its rank), source_size, target: weights repeat over the sources in order; targets fill up to cap times the size."""
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    ranked = by.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("s") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("r", F.col("cap") / F.col("w"))
    every, rising = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("r", "s")
    below, above = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above)
    filled = ranked.withColumn("level", level).withColumn("at", F.row_number().over(rising))
    # The water level: that of the first source, in order of cap per weight, that it doesn't fill.
    water = F.min_by("level", F.when(F.col("level") <= F.col("r"), F.col("at"))).over(every)
    return filled.select("source", "s", "source_size", F.least(F.col("cap"), F.coalesce(water * F.col("w"), F.col("cap"))).alias("target"))


def lattice(words: int, most: int = MAX_SLOTS) -> tuple[int, int]:
    """(n, p): the greatest Fibonacci number n of at most so many words and slots, and the one before it."""
    n, p = 1, 1
    while n + p <= min(words, most):
        n, p = n + p, n
    return n, p


def slots(shares: DataFrame, words: int) -> DataFrame:
    """j, s, k: the source of slot j of a mix of so many words, and the slot's rank within the source."""
    n, p = lattice(words)
    rising = Window.partitionBy(F.lit(0)).orderBy("s")
    edges = shares.select("s", (F.round(F.sum("target").over(rising)).cast("long") * n).alias("hi")).select("s", F.expr(f"hi div {max(words, 1)}").alias("hi"))
    bounds = cut(edges.select("s", F.coalesce(F.lag("hi").over(rising), F.lit(0)).alias("lo"), "hi").where("hi > lo"))
    # Points meet intervals through equal buckets.
    bucket = lambda x: F.expr(f"({x}) * {POINT_BUCKETS} div {n}")
    spread = bounds.select("s", "lo", "hi", F.explode(F.sequence(bucket("lo"), bucket("hi - 1"))).alias("bucket"))
    points = shares.sparkSession.range(n if words else 0).select(F.col("id").alias("j"), (F.col("id") * p % n).alias("u")).withColumn("bucket", bucket("u"))
    placed = points.join(spread, "bucket").where("u >= lo AND u < hi").select("j", "s")
    return placed.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("j")).cast("long") - 1)


def streams(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """sizes with s, source_size, target and a: the words before the group of rows in its source's shuffled stream."""
    counts = sizes.groupBy("source").agg(F.count("*").alias("n_rows"))
    known = join_skewed(sizes, cut(counts.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")), ["source"])
    known = known.withColumn("b", F.shiftrightunsigned("h", 64 - HASH_BITS)).withColumn("words", F.col("size") * F.col("m"))
    sums = known.groupBy("s", "b").agg(F.sum("words").alias("n"))
    offsets = sums.select("s", "b", (F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).alias("base"))
    running = F.sum("words").over(Window.partitionBy("s", "b").orderBy("h", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    local = known.withColumn("before", F.coalesce(running, F.lit(0)))
    return local.join(offsets, ["s", "b"]).withColumn("a", F.col("base") + F.col("before")).drop("b", "base", "before", "n")


def take(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(sizes with source_size, target, taken, slot; number of slots). taken: the words that the mix takes of the m rows, repeats counted; slot: the first that takes any."""
    shares = cut(targets(sizes))
    words = int(shares.agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0))).first()[0])
    n, t = lattice(words)[0], max(words, 1)
    ends = streams(sizes, shares).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    ends = ends.withColumn("from", F.col("a") + F.col("at") * F.col("source_size")).withColumn("to", F.col("from") + F.col("words"))
    # Blocks that the words lie in; -1, which no slot has, keeps a document without words.
    parts = ends.withColumn("k", F.explode(F.expr(f"if(words > 0, sequence(from * {n} div {t}, (to - 1) * {n} div {t}), array(-1L))")))
    within = F.expr(f"least(to, ((k + 1) * {t} + {n - 1}) div {n}) - greatest(from, (k * {t} + {n - 1}) div {n})")
    got = parts.withColumn("within", within).join(slots(shares, words), ["s", "k"], "left")
    row = ["key", "doc_id", "size", "m", "s", "source_size", "target"]
    return got.groupBy(*row).agg(F.coalesce(F.sum(F.when(F.col("j").isNotNull(), F.col("within"))), F.lit(0)).alias("taken"), F.min("j").alias("slot")), n


def repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column n says, with i from 0 to n - 1; those of many repeats are dealt out before."""
    few = rows.where(F.col(n).between(1, REPEAT_CHUNK)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = rows.where(F.col(n) > REPEAT_CHUNK).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {REPEAT_CHUNK}"))))
    many = many.repartition("c").withColumn("i", F.explode(F.sequence(F.col("c") * REPEAT_CHUNK, F.least(F.col(n), (F.col("c") + 1) * REPEAT_CHUNK) - 1)))
    return few.unionByName(many.drop("c"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and slot, the first slot of the mix that takes from it (null: none)."""
    each = repeated(cut(take(cut(sized(docs)))[0]), "m")
    taken = F.expr("taken div m + if(i < taken % m, 1, 0)")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "slot")


def mix(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs, with all their columns, in order of their first slots: each document as often as its taken words make it whole, rounded."""
    got, n = take(cut(sized(docs)))
    got = cut(got.where("size > 0").select("key", "m", "slot", F.round(F.col("taken") / F.col("size")).cast("long").alias("copies")).where("copies > 0"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "source", "text").alias("key"))
    found = rows.join(got, "key")
    # All m rows of a group come copies / m times; what is left over of the division, one of them.
    whole = found.select("row", "slot", F.explode(F.array_repeat(F.lit(1), F.expr("cast(copies div m AS int)"))))
    rest = found.where("copies % m > 0").groupBy("key").agg(F.first("row").alias("row"), F.first("slot").alias("slot"), F.first(F.expr("copies % m")).alias("left"))
    mixed = whole.select("row", "slot").unionByName(repeated(rest, "left").select("row", "slot"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(parts, F.expr(f"cast(slot * {parts} div {n} AS int)")).sortWithinPartitions("slot").select("row.*")
