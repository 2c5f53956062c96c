"""Continuous consolidation over immutable part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import consolidate as C


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of contact rows; files never change once written."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def merged_stream(leads: DataFrame, lead_type: Column | str, geography: Column | str, by: list[str] | None = None) -> DataFrame:
    """Row scope as one stateful aggregation (complete mode), to be made whole by ``merged_rows`` in foreachBatch."""
    judged = C.judged_rows(leads, lead_type, geography, by or [], verdict_scope="row")
    return C.merge_state(judged.where("merge_key is not null"), by or [])


def keyed_verdicts(leads: DataFrame, lead_type: Column | str, geography: Column | str) -> DataFrame:
    """A stream of the row that stands for each (run_id, cache_key), with its first place and the rows counted so far (update mode).

    The first batch that holds a key fixes its row, the last one of that batch;
    later rows only count.  A batch has one time, kept in the stream's log, so
    this is a plain aggregation, which combines before the shuffle.
    """
    passed = C.candidates(leads, lead_type, geography).where("skip_reason is null")
    timed = passed.withColumn("_at", F.current_timestamp())
    rank, number = F.col("seq.profile_rank"), F.col("seq.row_no")
    found = timed.groupBy("run_id", "cache_key").agg(F.min_by(F.struct(*C.FIELDS), F.struct("_at", -rank, -number)).alias("row"), F.min(F.struct(rank.alias("profile_rank"), number.alias("row_no"))).alias("seq"), F.count(F.lit(1)).alias("n"))
    return found.select("run_id", "cache_key", "row.*", "seq", "n")


def first_per_key_stream(rows: DataFrame, time_column: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each (run_id, profile, key) that arrives.

    With a time column, keys are forgotten when the watermark is ``delay`` past
    them, so the state stays bounded; copies further apart both pass.
    """
    keys = ["run_id", "profile", "key"]
    if time_column is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


def first_in_order_stream(rows: DataFrame, time_column: str, delay: str = "1 day", seq: str = "seq") -> DataFrame:
    """The first row by ``seq`` of each (run_id, profile, key), whatever the order of arrival (append mode).

    Rows of a key whose times lie within ``delay`` of one another are one group;
    only its least row is kept, which combines before the shuffle, and it comes
    out when the watermark is ``delay`` past the group.
    """
    keys = ["run_id", "profile", "key"]
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.withWatermark(time_column, delay).groupBy(*keys, F.session_window(time_column, delay))
    return grouped.agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*keys, "_row.*")


class Consolidator:
    """Micro-batches merged as they come, with verdicts at intervals.

    Each batch adds one row per key of its candidates under ``path/keys``.  Keys
    get their verdict (the last row that is known then) when a validation is due,
    under ``path/verdicts``; rows whose key has none are pending and left out of
    the result.  A batch merges again only what shares a merge key with the keys
    that it brings or judges, and adds that under ``path/result``; of each merge
    key the newest version counts.  Batches are written under their number, so
    one that is run again replaces itself.  A clock stream gives batches when no
    file comes, so pending rows don't wait for one.
    """

    def __init__(self, spark: SparkSession, path: str, lead_type: str, geography: str, interval_s: float = 120.0, clock=None):
        import time

        self.spark, self.path, self.lead_type, self.geography = spark, path.rstrip("/"), lead_type, geography
        self.interval_s, self.clock = interval_s, clock or time.time
        self.last_validation: float | None = None

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def due(self) -> bool:
        return self.last_validation is None or self.clock() - self.last_validation >= self.interval_s

    def _waiting(self) -> DataFrame | None:
        """Keys without a verdict, as often as batches brought them."""
        known, judged = self._read("keys"), self._read("verdicts")
        return known if known is None or judged is None else known.join(judged.select("cache_key"), "cache_key", "left_anti")

    def pending(self) -> bool:
        """Whether rows wait for their verdict."""
        waiting = self._waiting()
        return waiting is not None and not waiting.isEmpty()

    @property
    def result(self) -> DataFrame:
        """The merged rows, one per merge key."""
        written = self._read("result")
        if written is None:  # no batch yet
            fields = ", ".join(f"{f} string" for f in C.FIELDS)
            return self.spark.createDataFrame([], f"merge_key string, {fields}, seq struct<profile_rank:int,row_no:bigint>, n long")
        found = written.groupBy("merge_key").agg(F.max_by(F.struct(*C.FIELDS, "seq", "n"), "version").alias("r"))
        return found.select("merge_key", "r.*")

    @property
    def stats(self) -> DataFrame:
        """One row: rows that wait, merged rows, and rows merged into others."""
        waiting = self._waiting()
        waiting = self.spark.createDataFrame([], "n long") if waiting is None else waiting
        pending = waiting.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pendingValidation"))
        kept = self.result.agg(F.count(F.lit(1)).alias("kept"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))
        return pending.crossJoin(kept)  # one row each

    def process(self, batch: DataFrame, batch_id: int, force: bool = False) -> None:
        """The body of foreachBatch."""
        passed = C.candidates(batch, self.lead_type, self.geography).where("skip_reason is null")
        keys = passed.groupBy("cache_key").agg(F.max_by(F.struct(*C.FIELDS), "seq").alias("row"), F.max("seq").alias("last"), F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch_id}")
        known, judged = self._read("keys"), self._read("verdicts")
        touched = known.where(F.col("batch") == batch_id).select("cache_key")
        if force or self.due():
            if judged is not None:  # what this batch judged when it was run before is judged anew
                judged = judged.where(F.col("batch") != batch_id)
            todo = known if judged is None else known.join(judged.select("cache_key"), "cache_key", "left_anti")
            rows = todo.groupBy("cache_key").agg(F.max_by("row", "last").alias("row")).select("cache_key", "row.*")
            C.approved_rows(rows).select("cache_key", *C.FIELDS, "merge_key").write.mode("overwrite").parquet(f"{self.path}/verdicts/batch={batch_id}")
            self.last_validation = self.clock()
            judged = self._read("verdicts")
            touched = touched.unionByName(judged.where(F.col("batch") == batch_id).select("cache_key"))
        good = judged.where("merge_key is not null")
        again = good.join(touched.distinct(), "cache_key", "left_semi").select("merge_key").distinct()
        rows = good.join(again, "merge_key", "left_semi").select("cache_key", *C.FIELDS, "merge_key")
        counts = known.join(rows.select("cache_key"), "cache_key", "left_semi").groupBy("cache_key").agg(F.sum("n").alias("n"), F.min("first").alias("seq"))
        C.merge_leads(rows.join(counts, "cache_key")).write.mode("overwrite").parquet(f"{self.path}/result/version={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False, tick: str = "1 second"):
        """The running query: a batch each ``tick``, or all files there are with validation forced."""
        if once:
            writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.process(df, i, force=True))
            return writer.trigger(availableNow=True).start()
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        ticks = clock.select(F.lit(True).alias("_tick"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
        both = stream.withColumn("_tick", F.lit(False)).unionByName(ticks)
        writer = both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self._tick)
        return writer.trigger(processingTime=tick).start()

    def _tick(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("not _tick").drop("_tick")
        if not rows.isEmpty() or self.due() and self.pending():
            self.process(rows, batch_id)
