"""Run reports: counters per source, states of runs, events and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
RUN_WARNING = "Nem todas as fontes concluíram com sucesso, mas o CSV final foi gerado."
NO_OUTPUT = "Nenhuma frente gerou um CSV válido."
NOTHING_KEPT = "Os CSVs gerados não continham leads com contacto público válido."


def source_counters(found: DataFrame) -> DataFrame:
    """Found and written rows of each source, numbers of its notes and blockers, and the first blocker.

    ``found`` has run_id, profile, ``written`` (boolean) and the texts
    ``blocker`` and ``note`` (null: none), in the order ``seq``.  All of it
    combines before the shuffle, so a large source is one row per task.
    """
    first = F.min_by("blocker", F.when(F.col("blocker").isNotNull(), F.col("seq")))
    return found.groupBy("run_id", "profile").agg(F.count(F.lit(1)).alias("foundRows"), F.count_if("written").alias("writtenRows"), F.count("note").alias("n_notes"), F.count("blocker").alias("n_blockers"), first.alias("first_blocker"))


def source_texts(found: DataFrame, kind: str) -> DataFrame:
    """The notes (``note``) or blockers (``blocker``) of each source, a row each: run_id, profile, seq and text."""
    return found.where(F.col(kind).isNotNull()).select("run_id", "profile", "seq", F.col(kind).alias("text"))


def source_status(exit_code: Column, has_output: Column) -> Column:
    return F.when((exit_code == 0) & has_output, "completed").when(has_output, "completed_with_warning").otherwise("failed")


def run_status(sources: DataFrame, stats: DataFrame) -> DataFrame:
    """State of each run from its sources (run_id, profile, exit_code, has_output) and its stats (run_id, kept)."""
    status = source_status(F.col("exit_code"), F.col("has_output"))
    per_run = sources.groupBy("run_id").agg(F.max("has_output").alias("any_output"), F.min(status == "completed").alias("all_completed"))
    joined = per_run.join(stats.select("run_id", "kept"), "run_id", "left")
    kept = F.coalesce("kept", F.lit(0))
    failed = ~F.col("any_output") | (kept <= 0)
    return joined.select(
        "run_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed & ~F.col("all_completed"), RUN_WARNING).alias("warning"),
        F.when(~F.col("any_output"), NO_OUTPUT).when(kept <= 0, NOTHING_KEPT).alias("error"),
    )


def last_rows(df: DataFrame, by: list[str], order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The last ``most`` rows of each group, 1 for the newest."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= most)


def last_events(events: DataFrame, most: int = 30) -> DataFrame:
    """The last events of each run; ``events`` has run_id, ts and event_id."""
    return last_rows(events, ["run_id"], [F.desc("ts"), F.desc("event_id")], most)


def progress_changes(ticks: DataFrame, state: list[str]) -> DataFrame:
    """Ticks (run_id, tick) at which the state differs from the tick before."""
    before = Window.partitionBy("run_id").orderBy("tick")
    now = F.struct(*state)
    return ticks.withColumn("_before", F.lag(now).over(before)).where(~F.col("_before").eqNullSafe(now)).drop("_before")


def first_total(pages: DataFrame, by: list[str]) -> DataFrame:
    """First total that a result page names, and the number of cards."""
    total = F.min_by("total_results", F.when(F.col("total_results").isNotNull(), F.col("page")))
    return pages.groupBy(*by).agg(total.alias("total_results"), F.sum("n_cards").alias("n_cards"))


def run_stamp(ts: Column) -> Column:
    """Text form of a run's time."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")
