"""Traces of agents' tool calls: the exfiltration test on neighbouring calls, and a roll-up of each trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DB_TOOL_PARTS, DROPPED_TOOL, NETWORK_TOOL_PARTS, NETWORK_TOOLS, QUERY_TOOL
from ..functions.signatures import SignatureSet
from ..functions.text import python_bool
from .scan import scan_text


def _any_part(name: Column, parts: list[str]) -> Column:
    out = F.contains(name, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(name, F.lit(p))
    return out


def is_db_tool(name: Column) -> Column:
    return _any_part(F.lower(name), DB_TOOL_PARTS)


def is_network_tool(name: Column) -> Column:
    return F.lower(name).isin(NETWORK_TOOLS) | _any_part(F.lower(name), NETWORK_TOOL_PARTS)


def without_checker(tools: DataFrame, name: str = "tool_name") -> DataFrame:
    return tools.where(F.col(name) != DROPPED_TOOL)


def exfiltration(steps: DataFrame, trace: str = "trace_id", order: list[str] | None = None, tool: str = "tool_name") -> DataFrame:
    """trace, exfiltration_flag, exfil_reason: of the first database call followed at once by a network call."""
    order = order or ["step_index"]
    w = Window.partitionBy(trace).orderBy(*order)
    low = F.lower(tool)
    pairs = steps.select(trace, F.struct(*order).alias("at"), low.alias("a"), F.lead(low).over(w).alias("b"))
    reason = F.concat(F.lit("Potential RI.2 exfiltration: '"), F.col("a"), F.lit("' -> '"), F.col("b"), F.lit("'"))
    bad = F.col("b").isNotNull() & is_db_tool(F.col("a")) & is_network_tool(F.col("b"))
    found = pairs.groupBy(trace).agg(F.min_by(F.when(bad, reason), F.when(bad, F.col("at"))).alias("exfil_reason"))
    return found.select(trace, F.col("exfil_reason").isNotNull().alias("exfiltration_flag"), "exfil_reason")


def capture(steps: DataFrame, signatures: SignatureSet | None = None) -> DataFrame:
    """steps (tool_name, tool_output, verdict) with blocked, layer3_flagged, and the output replaced where the scan flags it.

    Verdicts and scans concern query calls only, and scans only those that weren't blocked.
    """
    query = F.col("tool_name") == QUERY_TOOL
    scanned = scan_text(steps, "tool_output", "__scan", signatures)
    blocked = F.coalesce(query & (F.col("verdict") == "BLOCKED"), F.lit(False))
    flagged = query & ~blocked & F.col("__scan.flagged")
    out = scanned.withColumn("blocked", blocked).withColumn("layer3_flagged", F.coalesce(flagged, F.lit(False)))
    return out.withColumn("tool_output", F.when(F.col("layer3_flagged"), F.col("__scan.sanitized")).otherwise(F.col("tool_output"))).drop("__scan")


def rollup(steps: DataFrame, trace: str = "trace_id") -> DataFrame:
    """One row a trace, of captured steps (step_index, tool_name, verdict, violations, latency_ms, blocked, layer3_flagged)."""
    query = F.col("tool_name") == QUERY_TOOL
    got = steps.groupBy(trace).agg(
        F.count("*").alias("n_steps"),
        F.count_if(query).alias("policy_hit_count"),
        F.count_if(F.col("blocked")).alias("block_count"),
        F.count_if(query & (F.col("verdict") == "REWRITTEN")).alias("rewrite_count"),
        F.count_if(F.col("layer3_flagged")).alias("layer3_hits"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.max(F.when(F.col("blocked"), F.col("step_index"))).alias("blocked_at_step"),
        F.max_by(F.when(F.col("blocked"), F.col("violations")), F.when(F.col("blocked"), F.col("step_index"))).alias("last_violations"),
    )
    exfil = exfiltration(steps, trace)
    out = got.join(exfil, trace)
    return out.withColumn("block_reason", F.coalesce("exfil_reason", "last_violations")).drop("exfil_reason", "last_violations")


def summary(rolled: DataFrame, trace: str = "trace_id") -> DataFrame:
    text = F.format_string(
        "latency=%.1fms | steps=%d | hits=%d | blocked=%d | rewritten=%d | exfil=%s | layer3=%d",
        "total_latency_ms", "n_steps", "policy_hit_count", "block_count", "rewrite_count", python_bool(F.col("exfiltration_flag")), "layer3_hits",
    )
    return rolled.select(trace, text.alias("summary"))


def last_verdict(steps: DataFrame, order: list[str] | None = None, trace: str = "trace_id") -> DataFrame:
    """trace, last_verdict, last_blocked: of the latest query call."""
    query = F.col("tool_name") == QUERY_TOOL
    at = F.struct(*(order or ["step_index"]))
    got = steps.groupBy(trace).agg(F.max_by(F.when(query, F.col("verdict")), F.when(query, at)).alias("last_verdict"))
    return got.withColumn("last_blocked", F.coalesce(F.col("last_verdict") == "BLOCKED", F.lit(False)))
