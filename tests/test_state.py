"""Keyed state with timers, and the log that is merged when read."""

import time

import pytest
from pyspark.sql import functions as F

from leadloom.operators import consolidate as C
from leadloom.streaming.state import STORE, MergeLog, judged_stream, start

SCHEMA = "run_id string, " + ", ".join(f"{f} string" for f in C.FIELDS) + ", profile_rank int, row_no long"


def row(name, email, number, notes="", run="r"):
    cells = {"name": name, "email": email, "notes": notes}
    return (run, *[cells.get(f, "") for f in C.FIELDS], 0, number)


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder)).withColumn("seq", F.struct("profile_rank", "row_no"))


def test_log(spark, tmp_path):
    """Many batches leave few tables; the newest row of each key counts, whatever was put together, written again or broken."""
    log = MergeLog(spark, str(tmp_path), fan=3, files=2)
    assert log.rows() is None and log.result() is None
    schema = "run_id string, cache_key string, " + ", ".join(f"{f} string" for f in C.FIELDS) + ", merge_key string, seq struct<profile_rank:int,row_no:long>, n long"
    want = {}
    for b in range(20):
        found = [("r", f"k{k}", *[f"{f}{k}" for f in C.FIELDS], None if k == 4 else f"m{k % 4}", (0, k), b + 1) for k in range(b % 6, 8, 2)]
        for _ in range(1 + (b % 7 == 3)):
            log.add(spark.createDataFrame(found, schema), b)
        want |= {r[1]: r for r in found}
        assert len(log.tables()) <= 2 * 4
        if b == 11:
            broken = tmp_path / "batches=000000000000-000000000019"
            broken.mkdir()
            (broken / "part-0.parquet").write_bytes(b"x")
    assert sum(len(list(p.glob("part-*"))) for p in tmp_path.glob("batches=*")) <= 2 * 8 + 1
    assert sorted((r.cache_key, r.n) for r in log.rows().collect()) == sorted((k, r[-1]) for k, r in want.items())
    log.add(spark.createDataFrame([("r", "k0", *["late"] * 9, "m0", (0, 0), 99)], schema), 1)  # a batch that is in a larger table already
    merged = {r.merge_key: r.n for r in log.result().collect()}
    assert merged == {m: sum(r[-1] for r in want.values() if r[11] == m) for m in {r[11] for r in want.values()} - {None}}


def test_keys_wait_for_their_timer(spark, tmp_path, store):
    """Keys are judged together when the interval is full, by their last row; later rows only count; idle keys are forgotten."""
    folder = tmp_path / "in"

    def bring(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    bring(row("Barbearia X", "a@b.pt", 5, "last"), row("Barbearia X", "a@b.pt", 2, "first"), row("Barbearia Y", "y@b.pt", 3))
    seen = []
    judged = judged_stream(stream_of(spark, folder), "barbearia", "Portugal", interval_s=4, forget_s=6)
    query = judged.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: seen.extend((r.merge_key, r.notes.split(" | ")[0], r.seq.row_no, r.n) for r in b.collect())).trigger(processingTime="1 second").start()

    def until(n):
        end = time.time() + 120
        while time.time() < end and len(seen) < n and query.isActive:
            time.sleep(0.3)
        assert len(seen) == n, (seen, query.exception())

    try:
        until(2)
        assert sorted(seen)[0] == ("email:a@b.pt", "last", 2, 2)
        bring(row("Barbearia X", "a@b.pt", 9, "later"))
        until(3)
        assert seen[2] == ("email:a@b.pt", "last", 2, 3)
        time.sleep(14)
        bring(row("Barbearia X", "a@b.pt", 11, "anew"))
        until(4)
        assert seen[3] == ("email:a@b.pt", "anew", 11, 1)
    finally:
        query.stop()


def test_restart(spark, tmp_path, store):
    """State outlives the query; a batch brings only its keys to the log."""
    folder, log = tmp_path / "in", MergeLog(spark, str(tmp_path / "log"))
    sizes = []
    for part in ([row("Barbearia X", "a@b.pt", 1, "a"), row("Barbearia Y", "y@b.pt", 2), row("Talho", "t@b.pt", 3)], [row("Barbearia X", "a@b.pt", 4, "b")] * 50, [row("Barbearia X", "a@b.pt", 1, run="s")]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(folder))
        start(judged_stream(stream_of(spark, folder), "barbearia", "Portugal", interval_s=0), log, str(tmp_path / "cp"), once=True).awaitTermination()
        last = log.tables()[-1]
        sizes.append(log._read([last]).count())
    assert sizes == [2, 1, 1]
    assert sorted((r.run_id, r.merge_key, r.notes.split(" | ")[0], r.n) for r in log.result().collect()) == [("r", "email:a@b.pt", "a", 51), ("r", "email:y@b.pt", C.NO_REVIEWER, 1), ("s", "email:a@b.pt", C.NO_REVIEWER, 1)]
