"""Policy checks of SQL columns, and guarded execution of SQL on a session."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import ALL_OPERATIONS, ALWAYS_REFUSED
from ..operators.scan import scan_rows
from .policy import PolicyEngine, PolicyVerdict, SQLPolicy, Verdict
from .sqllex import analyse

_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_BY_NAME = re.compile(r"(?i)(?:plan|expression)withunresolvedidentifier|unresolvedidentifier")
VERDICT_TYPE = "verdict string, safe_sql string, violations array<string>"


def operation_scan(sql: str, policy: SQLPolicy):
    """First stage of the policy as a Column over a SQL text column: the reason, or null. No Python."""
    refused = sorted(set(ALL_OPERATIONS) - {o.upper() for o in policy.permitted_operations})
    words = F.split(F.upper(F.trim(F.coalesce(F.col(sql), F.lit("")))), r"\s+")
    first = F.element_at(words, 1)
    return F.when(first == "", "Empty query").when(first.isin(refused), F.concat(F.lit("Forbidden operation: "), first)).when(F.arrays_overlap(words, F.array(*map(F.lit, ALWAYS_REFUSED))), "Forbidden keyword in query")


def with_verdicts(df: DataFrame, sql: str, policy: SQLPolicy, user_id: int | None = None, compat: bool = False) -> DataFrame:
    """df with verdict, safe_sql (null iff blocked) and violations. A null query is an empty one."""
    engine = PolicyEngine(policy, user_id, compat)
    # Other columns pass as one struct, so no name can clash with the new ones.
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{sql}`").alias("sql"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(VERDICT_TYPE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [engine.validate(s) for s in batch.column("sql").to_pylist()]
            cols = [pa.array([v.verdict.value for v in found], pa.string()), pa.array([v.safe_sql for v in found], pa.string()), pa.array([v.violations for v in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], names=["row", "verdict", "safe_sql", "violations"])

    return rows.mapInArrow(run, schema).select("row.*", "verdict", "safe_sql", "violations")


@dataclass
class GuardedResult:
    verdict: PolicyVerdict
    rows: DataFrame | None

    @property
    def message(self) -> str | None:
        return f"[BLOCKED] {'; '.join(self.verdict.violations)}" if self.rows is None else None


def planned_tables(plan: str) -> Counter:
    """How often each table is read in a parsed plan, by last name; a name that is made at run time counts as a table without one."""
    found = Counter(x.split(",")[-1].strip().lower() for x in _RELATION.findall(plan))
    return found + Counter({"": len(_BY_NAME.findall(plan))})


def guarded_sql(spark: SparkSession, sql: str, policy: SQLPolicy, user_id: int | None = None, scan: bool = True, compat: bool = False) -> GuardedResult:
    """Runs sql if the policy lets it, in its safe form, with injected instructions in the result replaced.

    The safe form is parsed by Spark too: nothing runs that either parser refuses, or in which Spark finds other tables
    than the policy has judged. The user filter and the cap are part of the plan: Catalyst pushes the filter to the scan
    and joins the cap with the query's own limits.
    """
    verdict = PolicyEngine(policy, user_id, compat).validate(sql)
    if verdict.verdict != Verdict.BLOCKED:
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(verdict.safe_sql).toString()
        except Exception as e:  # py4j wraps every parser error
            verdict = PolicyVerdict.blocked(verdict.original_sql, f"Invalid SQL: {str(e).splitlines()[0][:200]}")
        else:
            if Counter(t.name for t in analyse(verdict.safe_sql).tables) != planned_tables(plan):
                verdict = PolicyVerdict.blocked(verdict.original_sql, "Invalid SQL: Spark finds other tables in it than the policy")
    if verdict.verdict == Verdict.BLOCKED:
        return GuardedResult(verdict, None)
    rows = spark.sql(verdict.safe_sql)
    return GuardedResult(verdict, scan_rows(rows) if scan else rows)
