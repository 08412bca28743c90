"""Rules that fail alone: each is planned, run and written by itself, and reported."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from roadtrace.operators.rules import COLUMNS, RULES, Rule, RuleInput
from roadtrace.schemas import VIOLATION
from roadtrace.session import new_folder

#: Rules whose jobs are in flight together; Spark shares its executors among them.
AT_ONCE = 3
REPORT = "rule string, status string, condition string, error string, violations long"


def cause_of(error: BaseException) -> tuple[str | None, str]:
    """The error condition that Spark names, if any, and the first line of the innermost message."""
    condition = None
    while error is not None:
        if isinstance(error, PySparkException) and error.getCondition():
            condition = error.getCondition()
        inner = getattr(error, "_cause", None) or error.__cause__
        if inner is None:
            break
        error = inner
    text = (str(error).strip() or type(error).__name__).splitlines()[0]
    return condition, text[:300]


def _one(name: str, rule: Rule, x: RuleInput, path: str) -> tuple[str, str, str | None, str | None, int]:
    seen = Observation()
    try:
        rows = rule(x).select(*COLUMNS).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{path}/rule={name}")
    except Exception as e:  # noqa: BLE001  whatever it is, it is this rule's and is reported
        return name, "failed", *cause_of(e), 0
    return name, "ok", None, None, seen.get["n"]


def run_isolated(x: RuleInput, rules: dict[str, Rule] | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The violations of the rules that ran, and a report with a row for every rule.

    A union of rules is one plan, and fails as one. Here each rule is planned and written on
    its own, to path/rule=name (by default a folder that goes with the application), a few at
    a time: one that cannot be planned, or fails on its rows, leaves no violations, and the
    others stay. The report has rule, status ('ok' or 'failed'), Spark's error condition and
    the first line of the error, and the number of violations. Tracks are built once for all;
    where that fails, no rule can run and the error is raised.
    """
    spark = x.detections.sparkSession
    path = path or new_folder(spark, "rules")
    x = x.written()
    named = rules or RULES
    with ThreadPoolExecutor(AT_ONCE) as pool:
        run = inheritable_thread_target(spark)(_one)
        report = list(pool.map(lambda kv: run(kv[0], kv[1], x, path), named.items()))
    good = [f"{path}/rule={name}" for name, status, *_ in report if status == "ok"]
    rows = spark.read.schema(VIOLATION).parquet(*good) if good else spark.createDataFrame([], VIOLATION)
    return rows, spark.createDataFrame(report, REPORT)
