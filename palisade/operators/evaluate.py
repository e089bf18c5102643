"""Detection-quality metrics: funnels, confusion matrices, rates, latency statistics, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_input(df: DataFrame, blocked: str = "blocked", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn of blocked against label (1: attack)."""
    b, attack = F.col(blocked), F.col(label) == 1
    return df.agg(F.count_if(b & attack).alias("tp"), F.count_if(b & ~attack).alias("fp"), F.count_if(~b & attack).alias("fn"), F.count_if(~b & ~attack).alias("tn"))


def confusion_policy(df: DataFrame, verdict: str = "verdict", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn of SQL verdicts: a malicious query counts as stopped if blocked or rewritten, a benign one as served unless blocked."""
    v, bad = F.col(verdict), F.col(label) == 1
    return df.agg(F.count_if(bad & v.isin("BLOCKED", "REWRITTEN")).alias("tp"), F.count_if(~bad & (v == "BLOCKED")).alias("fp"), F.count_if(bad & (v == "PASSED")).alias("fn"), F.count_if(~bad & v.isin("PASSED", "REWRITTEN")).alias("tn"))


def percent(part: Column, whole: Column) -> Column:
    return F.bround(F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0)), 2)


def rates_input(confusion: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.select("*", percent(tp, tp + fn).alias("block_rate"), percent(fp, fp + tn).alias("false_positive_rate"), percent(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def rates_policy(confusion: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    block = percent(tp, tp + fn)
    return confusion.select("*", block.alias("block_rate"), percent(tn, tn + fp).alias("pass_rate"), percent(fp, fp + tn).alias("false_positive_rate"), percent(tp + tn, tp + fp + fn + tn).alias("accuracy"), block.alias("attack_reduction"), F.bround(F.lit(100.0) - block, 2).alias("injection_success"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


#: An order statistic is looked for among the values between the approximate quantiles this far on either side of it.
BRACKET, ACCURACY = 0.002, 10_000


def order_statistic(df: DataFrame, value: str, by: list[str], share: float, rank: Column, name: str) -> DataFrame:
    """by..., name: the value of 1-based rank (an expression of the group's count n), which lies near share of the way up.

    Approximate quantiles bracket the rank; exact counts of the values below and, by distinct value, of those within
    the bracket then give it. So no task sorts a whole group, however large.
    """
    keys = df.select(*by, F.col(value).alias("__v"))
    bounds = F.percentile_approx("__v", [max(0.0, share - BRACKET), min(1.0, share + BRACKET)], ACCURACY)
    known = keys.groupBy(*by).agg(F.count("*").alias("n"), bounds.alias("__b"))
    placed = keys.join(known, by)
    below = placed.groupBy(*by).agg(F.count_if(F.col("__v") < F.col("__b")[0]).alias("__below"), F.first("n").alias("n"))
    inside = placed.where((F.col("__v") >= F.col("__b")[0]) & (F.col("__v") <= F.col("__b")[1])).groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    upto = inside.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by).orderBy("__v"))).join(below, by)
    return upto.where(F.col("__below") + F.col("__upto") >= rank).groupBy(*by).agg(F.min("__v").alias(name))


def latency_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, min, max and p95 of value by group; p95 is the value of 0-based rank floor(0.95 n)."""
    known = df.where(F.col(value).isNotNull())
    n = F.col("n")
    stats = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    low = order_statistic(known, value, by, 0.5, F.floor((n + 1) / 2), "__low")
    high = order_statistic(known, value, by, 0.5, F.floor(n / 2) + 1, "__high")
    p95 = order_statistic(known, value, by, 0.95, F.floor(n * 95 / 100) + 1, "p95")
    return stats.join(low, by).join(high, by).join(p95, by).withColumn("median", (F.col("__low") + F.col("__high")) / 2).drop("__low", "__high")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected (key, expected) against actual (key, verdict), with passed."""
    return expected.join(actual, key, "left").withColumn("passed", F.col("expected").eqNullSafe(F.col("verdict")))


def key_hash(key: str, seed: int) -> Column:
    """Hexadecimal MD5 of seed and key: an order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold: rows of each label dealt in hashed order, so labels are spread evenly over folds.

    Deals within the 4,096 slices of the hash, each beginning at another fold, so no task holds a whole label.
    """
    h = key_hash(key, seed)
    slice_ = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    w = Window.partitionBy(label, slice_).orderBy(h, key)
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1 + slice_, F.lit(k)).cast("int"))


def split(df: DataFrame, label: str, key: str, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with is_test: of each label about test_share, by hash of label and key."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(label).cast("string"), F.lit(":"), F.col(key).cast("string")))
    return df.withColumn("is_test", F.conv(F.substring(h, 1, 6), 16, 10).cast("long") < int(test_share * (1 << 24)))


def kfold_scores(df: DataFrame, fold: str, label: str, predicted: str) -> DataFrame:
    """accuracy_mean, accuracy_std (sample) over folds."""
    per = df.groupBy(fold).agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("a"))
    return per.agg(F.avg("a").alias("accuracy_mean"), F.stddev_samp("a").alias("accuracy_std"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1."""
    sides = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")))
    seen = df.select(F.explode(sides).alias("s"), (F.col(label) == F.col(predicted)).alias("right")).select("s.*", "right")
    c = seen.groupBy("class").agg(F.sum("is_true").alias("support"), F.sum("is_pred").alias("predicted"), F.count_if(F.col("right") & (F.col("is_true") == 1)).alias("hits"))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    return c.select("class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def shuffled_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in an order given by a hash of key."""
    return df.orderBy(key_hash(key, seed), key).limit(n)
