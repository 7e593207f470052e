"""A verification run: named checks, one status each, the worst of them overall."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.filters import DETAIL_CAP
from tallyframe.operators.quality import CHECKS, FAMILY, FINDING
from tallyframe.session import cut_lineage, shared_checkpoints

Check = Callable[[], DataFrame]

STATUS_SQL = "CASE WHEN severity IN ('fail', 'error') THEN 2 WHEN severity = 'warn' THEN 1 ELSE 0 END"


#: Checks that run side by side; Spark shares its tasks among them.
AT_ONCE = 4


def run_checks(
    spark: SparkSession, checks: Mapping[str, Check], only: Iterable[str] = (), alone: Mapping[str, Check] | None = None
) -> DataFrame:
    """Findings of all checks, or of some. A check that cannot be built or that fails as it runs is one ``error`` finding.

    Each check runs as a job of its own and its findings are checkpointed, so one bad check leaves
    the others as they are. Checks that share inputs may fail by what another one reads: such a check
    runs once more as ``alone`` has it, on inputs of its own.
    """
    alone = alone or {}
    wanted = list(only) or [name for name, _ in CHECKS if name in checks]
    unknown = [name for name in wanted if name not in checks]
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    if not wanted:
        raise ValueError("no checks to run")

    def settled(check: Check) -> DataFrame:
        return cut_lineage(check().select(*FINDING))

    def run(name: str) -> DataFrame:
        try:
            try:
                return settled(checks[name])
            except Exception:  # noqa: BLE001
                if name not in alone:
                    raise
                return settled(alone[name])
        except Exception as error:  # noqa: BLE001
            row = (name, FAMILY.get(name, "meta"), "error", None, name, f"{type(error).__name__}: {error}", 0, None)
            return spark.createDataFrame(
                [row],
                "check string, family string, severity string, household_id string, subject string, problem string, row_count bigint, amount double",
            )

    # the folder is set before several threads ask for it
    shared_checkpoints(spark)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(run), wanted))


def check_status(spark: SparkSession, found: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row per check: its worst severity (pass when it found nothing) and how many findings."""
    listed = spark.createDataFrame([(n, FAMILY.get(n, "meta"), i) for i, n in enumerate(names)], "check string, family string, position int")
    counts = found.groupBy("check").agg(
        F.count("*").alias("details_total"), F.max(F.expr(STATUS_SQL)).alias("rank"), F.max(F.col("severity") == "error").alias("errored")
    )
    status = (
        F.when(F.col("rank").isNull(), "pass")
        .when(F.col("errored"), "error")
        .when(F.col("rank") == 2, "fail")
        .when(F.col("rank") == 1, "warn")
        .otherwise("info")
    )
    return listed.join(counts, "check", "left").select(
        "check", "family", "position", status.alias("status"), F.coalesce("details_total", F.lit(0)).alias("details_total")
    )


def overall(statuses: DataFrame) -> DataFrame:
    """Counts per status and the worst status of a run."""
    count = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(
        F.when(count("fail") + count("error") > 0, "fail").when(count("warn") > 0, "warn").otherwise("pass").alias("status"),
        *[count(s).alias(s) for s in ("fail", "warn", "info", "pass", "error")],
    )


def capped(found: DataFrame, cap: int = DETAIL_CAP) -> DataFrame:
    """The first findings of each check, worst first, with the full count beside them."""
    totals = found.groupBy("check").agg(F.count("*").alias("details_total"))
    ranked = Window.partitionBy("check").orderBy(F.expr(STATUS_SQL).desc(), "subject", "problem")
    few = found.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= cap)
    return few.join(totals, "check")
