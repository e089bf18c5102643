"""Scan of query results: string fields that carry injected instructions are replaced.

Only top-level string columns are looked at; others, nested ones included, pass unchanged. Null fields pass unchanged.
The scan works on normalised text: signature set, then anchored rules, then field rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.fixed import PLACEHOLDER
from ..functions.signatures import SignatureSet
from ..functions.text import normalize, regex_prefix

RESULT_TYPE = "struct<flagged:boolean,original:string,sanitized:string,reason:string,pattern_name:string,category:string>"


def _result(text: Column, norm: Column, bloom: Column, rule: Column, field: Column) -> Column:
    def flagged(reason: Column, name: Column, category: Column) -> Column:
        return F.struct(F.lit(True).alias("flagged"), text.alias("original"), F.lit(PLACEHOLDER).alias("sanitized"), reason.alias("reason"), name.alias("pattern_name"), category.alias("category"))

    empty = F.lit("")
    clean = F.struct(F.lit(False).alias("flagged"), text.alias("original"), text.alias("sanitized"), empty.alias("reason"), empty.alias("pattern_name"), empty.alias("category"))
    return (
        F.when(norm.isNull(), clean)
        .when(bloom, flagged(F.lit("bloom_filter_hit"), F.lit("bloom"), empty))
        .when(rule.isNotNull(), flagged(F.concat(F.lit("regex_match:"), rules.category_of(rule)), rule, empty))
        .when(field.isNotNull(), flagged(F.lit("db_field_injection_pattern"), field, rules.field_category(field)))
        .otherwise(clean)
    )


def with_scan(df: DataFrame, columns: dict[str, str], signatures: SignatureSet | None = None, normalizer: Callable[[Column], Column] = normalize) -> DataFrame:
    """df with a result column for each of columns (text column -> name of its result). Shared parts are columns of their own, made once."""
    signatures = signatures or SignatureSet.with_defaults()
    tag = lambda kind, i: f"__{kind}_{i}"
    each = list(enumerate(columns.items()))
    out = df.withColumns({tag("norm", i): normalizer(F.col(f"`{c}`")) for i, (c, _) in each})
    out = out.withColumns({tag("pre", i): regex_prefix(F.col(tag("norm", i))) for i, _ in each})
    out = out.withColumns({tag("gate", i): rules.gates(F.col(tag("pre", i))) for i, _ in each})
    out = out.withColumns({tag("hit", i): signatures.hit(F.col(tag("norm", i)), F.col(tag("norm", i))) for i, _ in each})
    # Later stages run only where earlier ones found nothing.
    out = out.withColumns({tag("rule", i): F.when(~F.col(tag("hit", i)), rules.first_name(F.col(tag("pre", i)), F.col(tag("gate", i)))) for i, _ in each})
    out = out.withColumns({tag("field", i): F.when(~F.col(tag("hit", i)) & F.col(tag("rule", i)).isNull(), rules.field_match(F.col(tag("norm", i)))) for i, _ in each})
    out = out.withColumns({name: _result(F.col(f"`{c}`"), *(F.col(tag(k, i)) for k in ("norm", "hit", "rule", "field"))) for i, (c, name) in each})
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *columns.values())


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def scan_rows(df: DataFrame, signatures: SignatureSet | None = None, columns: list[str] | None = None) -> DataFrame:
    """df with flagged string fields replaced; same columns, same rows."""
    names = string_columns(df) if columns is None else columns
    if not names:
        return df
    scanned = with_scan(df, {c: f"__scan_{i}" for i, c in enumerate(names)}, signatures)
    of = {c: f"__scan_{i}" for i, c in enumerate(names)}
    return scanned.select(*(F.col(of[c])["sanitized"].alias(c) if c in of else F.col(f"`{c}`") for c in df.columns))


def scan_flags(df: DataFrame, keys: list[str], signatures: SignatureSet | None = None) -> DataFrame:
    """keys..., field, and the scan result, a row for each flagged field."""
    names = [c for c in string_columns(df) if c not in keys]
    if not names:
        empty = F.from_json(F.lit("{}"), RESULT_TYPE)
        return df.select(*keys, F.lit("").alias("field"), empty.alias("r")).where("false").select(*keys, "field", "r.*")
    scanned = with_scan(df, {c: f"__scan_{i}" for i, c in enumerate(names)}, signatures)
    # Clean fields are left out before rows are made of them.
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"__scan_{i}").alias("r")) for i, c in enumerate(names)))
    flagged = F.explode(F.filter(fields, lambda f: f["r"]["flagged"]))
    return scanned.select(*keys, flagged.alias("f")).select(*keys, "f.field", "f.r.*")


def scan_text(df: DataFrame, column: str, result: str = "scan", signatures: SignatureSet | None = None) -> DataFrame:
    return with_scan(df, {column: result}, signatures)


def scan_list(df: DataFrame, column: str, key: str, signatures: SignatureSet | None = None) -> DataFrame:
    """key, sanitized (the list in order), n_flagged, for a column of string lists."""
    items = df.select(key, F.posexplode_outer(column).alias("i", "item"))
    scanned = scan_text(items, "item", "r", signatures)
    got = scanned.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.col("r.sanitized").alias("s"))))).alias("a"), F.count(F.when(F.col("r.flagged"), 1)).alias("n_flagged"))
    return got.select(key, F.transform("a", lambda x: x["s"]).alias("sanitized"), "n_flagged")
