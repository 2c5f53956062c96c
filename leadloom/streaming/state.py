"""Validation by keyed state with timers, and its results as a log that is merged when read.

A batch reads the state of the keys that it brings and nothing else, and writes
the rows that it judges or counts; what a run has gathered before isn't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from leadloom.operators import consolidate as C

#: State stores that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = ", ".join(f"{f} string" for f in C.FIELDS)
_COMBINED = f"run_id string, cache_key string, {_ROW}, profile_rank int, row_no long, last_rank int, last_no long, n long"
_OUT = f"run_id string, cache_key string, {_ROW}, profile_rank int, row_no long, n long"

_STATE = f"{_ROW}, profile_rank int, row_no long, last_rank int, last_no long, n long, judged boolean, seen long"
_NAMES = [f.split(" ")[0] for f in _STATE.split(", ")]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each key the last row, its place, the first place and the number of rows: one row a key and batch of rows, however many come."""
    keys = ["run_id", "cache_key"]
    for rows in batches:
        rows = rows.sort_values(["profile_rank", "row_no"], kind="stable")
        grouped = rows.groupby(keys, sort=False, dropna=False)
        last = grouped.tail(1).set_index(keys).rename(columns={"profile_rank": "last_rank", "row_no": "last_no"})
        first = grouped[["profile_rank", "row_no"]].first()
        yield last.join(first).join(grouped.size().rename("n")).reset_index()[[c.split(" ")[0] for c in _COMBINED.split(", ")]]


class KeyState(StatefulProcessor):
    """The state of one (run_id, cache_key): the row that stands for it, its first place, the rows so far, whether it is judged.

    Until it is judged the last row by place stands for the key; then the row is
    fixed and later ones only count.  Keys are judged at the full multiples of
    the interval, by a timer; without an interval, when they come.  A key that no
    row has reached for the time ``forget`` after its judgement is forgotten, so
    the state of finished runs goes; its next row would begin anew.
    """

    def __init__(self, interval_ms: int, forget_ms: int | None):
        self.interval, self.forget = interval_ms, forget_ms
        self.timers = bool(interval_ms) or forget_ms is not None

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("key", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else 0
        old = self.state.get() if self.state.exists() else None
        held = dict(zip(_NAMES, old, strict=True)) if old is not None else None
        for r in rows:
            new = {**{f: r[f] for f in C.FIELDS}, **{f: r[f] for f in ("profile_rank", "row_no", "last_rank", "last_no", "n")}, "judged": False}
            if held is None:
                held = new
                continue
            fixed, later = held["judged"], (new["last_rank"], new["last_no"]) >= (held["last_rank"], held["last_no"])
            first = min((held["profile_rank"], held["row_no"]), (new["profile_rank"], new["row_no"]))
            row = held if fixed or not later else new
            held = {**row, "profile_rank": first[0], "row_no": first[1], "n": held["n"] + new["n"], "judged": fixed}
        if old is None and self.interval:
            self.handle.registerTimer(now - now % self.interval + self.interval)
        held["judged"] = held["judged"] or not self.interval
        held["seen"] = now
        if old is None and not self.interval and self.forget is not None:
            self.handle.registerTimer(now + self.forget)
        self.state.update(tuple(held[f] for f in _NAMES))
        if held["judged"]:
            yield self._out(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = dict(zip(_NAMES, self.state.get(), strict=True))
        now = timerValues.getCurrentProcessingTimeInMs()
        if held["judged"]:
            if now - held["seen"] >= self.forget:
                self.state.clear()
            else:
                self.handle.registerTimer(held["seen"] + self.forget)
            return
        held["judged"] = True
        self.state.update(tuple(held[f] for f in _NAMES))
        if self.forget is not None:
            self.handle.registerTimer(now + self.forget)
        yield self._out(key, held)

    def close(self) -> None:
        pass

    @staticmethod
    def _out(key, held: dict) -> Row:
        return Row(run_id=key[0], cache_key=key[1], **{f: held[f] for f in (*C.FIELDS, "profile_rank", "row_no", "n")})


def judged_stream(leads: DataFrame, lead_type: Column | str, geography: Column | str, interval_s: float = 120.0, forget_s: float | None = None) -> DataFrame:
    """A stream of judged keys (update mode): each when it is judged and when rows are counted for it, with ``merge_key`` (null: rejected), ``seq`` and ``n``.

    Rows of a key combine before the shuffle.  The session needs ``STORE`` as the
    provider of its state stores.
    """
    passed = C.candidates(leads, lead_type, geography).where("skip_reason is null")
    rows = passed.select("run_id", "cache_key", *C.FIELDS, "seq.profile_rank", "seq.row_no")
    combined = rows.mapInPandas(_combine, _COMBINED)
    state = KeyState(round(interval_s * 1000), None if forget_s is None else round(forget_s * 1000))
    judged = combined.groupBy("run_id", "cache_key").transformWithState(state, _OUT, "Update", "ProcessingTime" if state.timers else "None")
    approved = C.approved_rows(judged)
    return approved.select("run_id", "cache_key", *C.FIELDS, "merge_key", F.struct("profile_rank", "row_no").alias("seq"), "n")


class MergeLog:
    """The newest row of each (run_id, cache_key) as tables of batches that are put together in steps.

    A batch adds one table and reads none.  When ``fan`` tables of a level lie
    side by side they become one of the next, which holds the newest row of each
    key, in files by a hash of the key; so ``b`` batches leave fewer than ``fan`` times log b tables,
    and each row is rewritten log b times.  A table counts when its success mark
    is there, and one that lies within the batches of another doesn't, so a
    broken step loses nothing and counts nothing twice.  A batch that is written
    again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, files: int = 8):
        self.spark, self.path, self.fan, self.files = spark, path.rstrip("/"), fan, files

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/batches={first:012d}-{last:012d}"

    def _all(self) -> list[tuple[int, int]]:
        fs, at = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = [(int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"batches=(\d+)-(\d+)", n))]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(t for t in found if fs.exists(path(self._folder(*t) + "/_SUCCESS")))

    def tables(self) -> list[tuple[int, int]]:
        """First and last batch of the tables that count."""
        found = self._all()
        return [t for t in found if not any(o != t and o[0] <= t[0] and t[1] <= o[1] for o in found)]

    def _read(self, tables: Sequence[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[self._folder(*t) for t in tables])

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("run_id", "cache_key", "batch")]
        newest = rows.groupBy("run_id", "cache_key").agg(F.max_by(F.struct("batch", *rest), "batch").alias("r"))
        return newest.select("run_id", "cache_key", "r.*")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """The body of foreachBatch."""
        if any(first <= batch_id <= last and first < last for first, last in self.tables()):
            return  # written and put together before the stream noted it
        batch.withColumn("batch", F.lit(batch_id).cast("long")).coalesce(self.files).write.mode("overwrite").parquet(self._folder(batch_id, batch_id))
        self.compact()

    def compact(self) -> None:
        """Put together the tables at the end as long as ``fan`` of about one size lie there, and remove what others hold."""
        while True:
            tables = self.tables()
            sizes = [last - first + 1 for first, last in tables]
            run = next((tables[i : i + self.fan] for i in range(len(tables) - self.fan + 1) if max(sizes[i : i + self.fan]) < self.fan * min(sizes[i : i + self.fan])), None)
            if run is None:
                break
            merged = self._newest(self._read(run)).repartition(self.files, "run_id", "cache_key")
            merged.write.mode("overwrite").parquet(self._folder(run[0][0], run[-1][1]))
        fs, _ = self._fs()
        for t in set(self._all()) - set(self.tables()):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(*t)), True)

    def rows(self) -> DataFrame | None:
        """The newest row of each key; None before the first batch."""
        tables = self.tables()
        return self._newest(self._read(tables)) if tables else None

    def result(self) -> DataFrame | None:
        """Merged contacts of each run, as ``consolidate`` gives them."""
        rows = self.rows()
        return None if rows is None else C.merge_leads(rows.where("merge_key is not null"), ["run_id"])


def start(judged: DataFrame, log: MergeLog, checkpoint: str, once: bool = False, tick: str = "1 second") -> StreamingQuery:
    """The running query: a batch each ``tick``, which timers need, or all that there is (only without timers, which never end)."""
    writer = judged.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(log.add)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=tick)).start()
