"""Sources and sinks: phrase files, labelled CSV, JSON results, SQL scripts, the taxonomy and the adaptation log."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.text import WHITE

#: Words of which a line of a script must have one to count as SQL, and the statements used if none does.
SQL_LINE_WORDS = ["SELECT", "DROP", "DELETE", "UPDATE", "INSERT", "UNION"]
FALLBACK_SQL = ["DROP TABLE users", "SELECT * FROM users", "DELETE FROM orders", "UPDATE users SET role = 'admin'", "SELECT password_hash FROM users", "SELECT id FROM users UNION SELECT password FROM admins"]

TAXONOMY_SCHEMA = "id string, name string, boundary string, handled_by_layer int, detection_method string, update_target string, severity string, known_instances array<string>"
LOG_SCHEMA = "timestamp string, attack_id string, pattern string, routed_to string"


def _strip(c):
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase: a line each, stripped; blank lines and lines that begin with # are left out (an indented # is text)."""
    lines = spark.read.text(path)
    return lines.where((_strip(F.col("value")) != "") & ~F.startswith("value", F.lit("#"))).select(_strip(F.col("value")).alias("phrase"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """prompt string, label int and further columns of a CSV file with a header; a column `text` serves as prompt."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "prompt" not in df.columns and "text" in df.columns:
        df = df.withColumnRenamed("text", "prompt")
    for name in ("prompt", "label"):
        if name not in df.columns:
            raise ValueError(f"{path} has no column {name}")
    return df.withColumn("label", F.col("label").cast("int"))


def write_csv(df: DataFrame, path: str, key: str, seed: int = 42) -> None:
    """CSV with a header, rows in an order given by a hash of key."""
    df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).write.csv(path, header=True, escape='"')


def write_json_document(df: DataFrame, path: str) -> None:
    """Rows of df as JSON objects, a line each, nested columns included."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_sql_lines(spark: SparkSession, folder: str, glob: str = "*.{sql,txt}") -> DataFrame:
    """sql: lines of the scripts below a folder that hold an SQL word in any case; the fallback statements if there are none."""
    fallback = spark.createDataFrame([(s,) for s in FALLBACK_SQL], "sql string")
    try:
        lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter=glob)
    except AnalysisException:
        return fallback
    upper = F.upper("value")
    any_word = F.lit(False)
    for w in SQL_LINE_WORDS:
        any_word = any_word | F.contains(upper, F.lit(w))
    found = lines.where(any_word & (F.trim("value") != "")).select(F.trim("value").alias("sql"))
    return fallback if found.isEmpty() else found


def read_taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row for each class of attack."""
    import yaml

    text = Path(path).read_text(encoding="utf-8") if path else (Path(__file__).parent / "taxonomy.yaml").read_text(encoding="utf-8")
    schema = T._parse_datatype_string(TAXONOMY_SCHEMA)
    rows = [tuple(c.get(n) if n != "known_instances" else c.get(n) or [] for n in schema.names) for c in yaml.safe_load(text)["attack_classes"]]
    return spark.createDataFrame(rows, schema)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows of attack_id, pattern, routed_to to a JSONL log, stamped with the time in UTC."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    df.select(stamp.alias("timestamp"), "attack_id", "pattern", "routed_to").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; none if there is no log."""
    try:
        return spark.read.schema(LOG_SCHEMA).json(path).where("attack_id IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], LOG_SCHEMA)


def count_log_lines(spark: SparkSession, path: str) -> int:
    """Lines of the log, blank ones included; 0 without a log."""
    try:
        return spark.read.text(path).count()
    except AnalysisException:
        return 0


def register_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """The Parquet tables of a folder as temporary views, for guarded SQL."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, by Spark's JDBC source; register it as a view to guard queries on it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
