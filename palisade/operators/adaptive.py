"""Adaptation: new attack patterns are routed by the taxonomy to the part that learns them.

A pattern of a class whose target is the signature corpus is learned with its windows and logged; a target of `none`
learns nothing; `restricted_columns` is reported but learns nothing either, and an unknown class is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import SignatureSet, corpus_grams
from ..sources import files

LEARNED = "bloom_corpus"


def route(patterns: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """patterns (attack_id, pattern) with routed_to and learned. The taxonomy has a row a class, a handful, so it is broadcast."""
    targets = taxonomy.select(F.col("id").alias("attack_id"), F.col("update_target").alias("routed_to"))
    return patterns.join(F.broadcast(targets), "attack_id", "left").withColumn("learned", F.coalesce(F.col("routed_to") == LEARNED, F.lit(False)))


def learn(grams: DataFrame, routed: DataFrame) -> DataFrame:
    """The signature table with the windows of the learned patterns added."""
    new = corpus_grams(routed.where("learned").select(F.col("pattern").alias("phrase")))
    return grams.select("gram").unionByName(new).distinct()


def known_instances(taxonomy: DataFrame, learned: DataFrame) -> DataFrame:
    """id, instances: those of the taxonomy, then the learned ones in order of pattern."""
    more = learned.where("learned").groupBy(F.col("attack_id").alias("id")).agg(F.array_sort(F.collect_set("pattern")).alias("more"))
    return taxonomy.join(more, "id", "left").select("id", F.concat("known_instances", F.coalesce("more", F.array().cast("array<string>"))).alias("instances"))


def coverage(taxonomy: DataFrame) -> DataFrame:
    """dimension, value, n_classes, n_instances: the taxonomy counted by layer, severity, boundary and target."""
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("handled_by_layer", "severity", "boundary", "update_target")))
    return taxonomy.select(F.explode(dims).alias("d"), F.size("known_instances").alias("n")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_instances"))


class AdaptiveEngine:
    """Adaptation within a session: a signature set on the driver, shared with the detectors made from it, and a log.

    replay() learns again what the log holds, so a restart loses nothing.
    """

    def __init__(self, spark: SparkSession, signatures: SignatureSet, log_path: str, taxonomy: DataFrame | None = None):
        self.spark, self.signatures, self.log_path = spark, signatures, log_path
        rows = (taxonomy or files.read_taxonomy(spark)).collect()  # a handful
        self.targets = {r.id: r.update_target for r in rows}
        self.instances = {r.id: list(r.known_instances) for r in rows}

    def update_target(self, attack_id: str) -> str:
        return self.targets[attack_id]

    def add_pattern(self, attack_id: str, pattern: str) -> str:
        target = self.targets[attack_id]
        if target == LEARNED:
            self.signatures.load([pattern])
            self.instances[attack_id].append(pattern)
            files.append_log(self.spark.createDataFrame([(attack_id, pattern, target)], "attack_id string, pattern string, routed_to string").coalesce(1), self.log_path)
        return target

    def add_instance(self, attack_id: str, instance: str) -> None:
        self.instances[attack_id].append(instance)

    def all_known_instances(self, attack_id: str) -> list[str]:
        return list(self.instances[attack_id])

    def adaptation_count(self) -> int:
        return files.count_log_lines(self.spark, self.log_path)

    def adaptation_log(self) -> DataFrame:
        return files.read_log(self.spark, self.log_path)

    def replay(self) -> int:
        """Learns the log's patterns, which are as many as were learned one by one."""
        rows = [r for r in self.adaptation_log().toLocalIterator() if r.routed_to == LEARNED]
        for r in rows:
            self.signatures.load([r.pattern])
            self.instances[r.attack_id].append(r.pattern)
        return len(rows)
