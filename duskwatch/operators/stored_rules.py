"""Rules kept in a table as SQL: all rules over one table run in one scan of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A rule of this form is a condition on the rows of one table.
_CONDITION = re.compile(r"\s*SELECT\s+(?:\*|(?:\w+\s*\.\s*)?log_id)\s+FROM\s+(\w+)\s*(?:\bWHERE\b(.*))?;?\s*", re.I | re.S)
# Conditions evaluated by one expression; more rules mean more of them in the same scan.
_TOGETHER = 200
HITS = "log_id bigint, rule_id bigint, anomaly_type string, description string, detected_by string, score double"
FAILURES = "rule_id bigint, name string, error string"


@dataclass
class Compiled:
    """Conditions by table, whole queries that are more than a condition, and rules that cannot run."""

    conditions: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    queries: list[tuple[int, DataFrame]] = field(default_factory=list)
    failures: list[tuple[int, str, str]] = field(default_factory=list)


def compile_rules(rules: DataFrame, tables: dict[str, DataFrame]) -> Compiled:
    """Sort the rules of ``rules(rule_id, name, sql_query)`` by how they can run.

    Spark analyses every condition against its table; nothing is run. What is
    not a plain condition (a join, a grouping, a sub-query) stays a query of its
    own. The rule table is small by nature: its rows become parts of the plan.
    """
    spark = rules.sparkSession
    out = Compiled()
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    known = {name.lower(): name for name in tables}
    for rule in rules.select("rule_id", "name", "sql_query").orderBy("rule_id").collect():
        text = rule["sql_query"] or ""
        plain = _CONDITION.fullmatch(text)
        table = known.get(plain.group(1).lower()) if plain else None
        if table is not None:
            condition = (plain.group(2) or "TRUE").rstrip("; \n")
            try:
                tables[table].filter(F.expr(condition)).schema
                out.conditions.setdefault(table, []).append((rule["rule_id"], condition))
                continue
            except (AnalysisException, ParseException):
                pass
        try:
            out.queries.append((rule["rule_id"], spark.sql(text).select(F.col("log_id").cast("bigint"))))
        except (AnalysisException, ParseException) as error:
            out.failures.append((rule["rule_id"], rule["name"], _first_line(error)))
    return out


def _first_line(error: Exception) -> str:
    condition = getattr(error, "getCondition", lambda: None)()
    return condition or str(error).strip().splitlines()[0]


def run_stored_rules(rules: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(hits, failures)`` of ``rules(rule_id, name, description, sql_query)`` over named tables.

    A table is read once: every row gets the ids of the rules whose condition it
    meets. ``hits`` has a row per log and rule, ``failures`` a row per rule that
    Spark cannot analyse, with the reason. A condition that is null does not hold.
    Values that a condition cannot convert at run time end the job, as in any
    query.
    """
    spark = rules.sparkSession
    compiled = compile_rules(rules, tables)
    found = None

    def add(hits: DataFrame) -> None:
        nonlocal found
        found = hits if found is None else found.unionByName(hits)

    for table, conditions in compiled.conditions.items():
        groups = [conditions[i : i + _TOGETHER] for i in range(0, len(conditions), _TOGETHER)]
        met = [
            F.array_compact(F.array(*[F.when(F.expr(c), F.lit(i).cast("bigint")) for i, c in group])) for group in groups
        ]
        ids = F.flatten(F.array(*met)) if len(met) > 1 else met[0]
        add(
            tables[table]
            .select(F.col("log_id").cast("bigint"), ids.alias("_rules"))
            .filter(F.size("_rules") > 0)
            .select("log_id", F.explode("_rules").alias("rule_id"))
        )
    for rule_id, hits in compiled.queries:
        add(hits.select("log_id", F.lit(rule_id).cast("bigint").alias("rule_id")))
    failures = spark.createDataFrame(compiled.failures, FAILURES)
    if found is None:
        return spark.createDataFrame([], HITS), failures
    named = rules.select("rule_id", F.col("name").alias("anomaly_type"), "description")
    out = found.join(F.broadcast(named), "rule_id").select(  # the rules this plan was made from
        "log_id", "rule_id", "anomaly_type", "description", F.lit("rules").alias("detected_by"), F.lit(1.0).alias("score")
    )
    return out, failures
