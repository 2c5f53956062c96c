"""Properties of consolidation, files and streams."""

import random

import pytest

from pyspark.sql import functions as F

from leadloom.operators import consolidate as C
from leadloom.plans import consolidation as Q
from leadloom.sources import io
from leadloom.streaming.consolidate import Consolidator, first_per_key_stream, keyed_verdicts

SF_DIR = "/root/testdata/sf0.001"
KEPT = ["merge_key", *C.FIELDS, "n"]


def rows(df, columns=KEPT):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lead(**fields):
    return tuple(fields.get(f, "") for f in C.FIELDS)


def table(spark, leads):
    schema = ",".join(f"{f} string" for f in C.FIELDS) + ", row_no long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(leads)], schema).withColumn("seq", F.struct(F.lit(0).alias("profile_rank"), "row_no"))


def test_funnel_adds_up(spark):
    leads = Q.raw_leads(spark, SF_DIR)
    for scope in ("key", "row"):
        for kind, place in (("barbearia", "Portugal"), ("leads", "Europe")):
            s = C.funnel_stats(leads, kind, place, verdict_scope=scope).first().asDict()
            parts = ["skippedNoContact", "skippedNoName", "skippedWrongType", "pendingValidation", "rejectedByValidation", "validationErrors", "duplicates", "totalValid"]
            assert sum(s[p] for p in parts) == leads.count()


def test_order_of_partitions_does_not_matter(spark):
    leads = Q.raw_leads(spark, SF_DIR)
    once = rows(C.consolidate(leads, "barbearia", "Portugal"))
    again = rows(C.consolidate(leads.repartition(7, "phone"), "barbearia", "Portugal"))
    assert once == again and len({r[0] for r in once}) == len(once)


def test_merge_rules(spark):
    leads = [
        lead(name="Barbearia A", email="a@b.pt", sources="s1 | s2", notes="n"),
        lead(name="Barbearia A", email="A@b.pt ", phone="912345678", sources="s2 | s3", notes="n"),
        lead(name="Barbearia B", email="info@booksy.com", phone="911111111"),
        lead(name="Barbearia C", email="info@booksy.com", phone="922222222"),
        lead(name="Barbearia D", phone="12"),
    ]
    by_row = {r.merge_key: r for r in C.consolidate(table(spark, leads), "barbearia", "Portugal", verdict_scope="row").collect()}
    assert by_row["email:a@b.pt"].sources == "s1 | s2 | s3" and by_row["email:a@b.pt"].phone == "912345678"
    assert set(by_row) == {"email:a@b.pt", "phone:911111111", "phone:922222222"}
    by_key = {r.merge_key: r for r in C.consolidate(table(spark, leads), "barbearia", "Portugal").collect()}
    assert set(by_key) == {"email:a@b.pt", "phone:922222222"}  # the last row of a shared mail stands for both
    assert by_key["email:a@b.pt"].sources == "s2 | s3"


def test_against_a_plain_model(spark):
    rng = random.Random(5)
    leads = [lead(name=rng.choice(["Barber X", "Barber Y", ""]), email=rng.choice(["", "a@b.pt", "c@d.pt", "x@fresha.com"]), phone=rng.choice(["", "912345678", "12"]), sources=rng.choice(["", "s1", "s2 | s1"])) for _ in range(200)]
    model, input_rows = {}, 0
    for r in leads:
        d = dict(zip(C.FIELDS, r, strict=True))
        if not d["name"] or not (d["email"] or d["phone"]):
            continue
        input_rows += 1
        d["phone"] = d["phone"] if len(d["phone"]) >= 9 else ""
        d["email"] = "" if d["email"].endswith("fresha.com") else d["email"]
        if d["email"] or d["phone"]:
            key = "email:" + d["email"] if d["email"] else "phone:" + d["phone"]
            model.setdefault(key, []).append(d)
    found = {r.merge_key: r for r in C.consolidate(table(spark, leads), "barber", "Portugal", verdict_scope="row").collect()}
    assert set(found) == set(model)
    for key, group in model.items():
        assert found[key].name == group[0]["name"] and found[key].n == len(group)
        given = [d["sources"] for d in group if d["sources"]]
        tokens = list(dict.fromkeys(t for s in given for t in s.split(" | ")))
        assert found[key].sources == ("" if not given else given[0] if len(set(given)) == 1 else " | ".join(tokens))


def test_limit(spark):
    leads = Q.raw_leads(spark, SF_DIR)
    assert C.consolidate(leads, "barbearia", "Portugal", limit=-1).count() == 0
    assert C.consolidate(leads, "barbearia", "Portugal", limit=3).count() == 3
    assert C.limit_rows(leads, float("nan")).count() == leads.count()


def test_empty_and_null_rows(spark):
    empty = table(spark, [])
    assert C.consolidate(empty, "barbearia", "Portugal").count() == 0
    assert C.funnel_stats(empty, "barbearia", "Portugal").first().kept == 0
    nulls = table(spark, [tuple([None] * 9)])
    assert C.funnel_stats(nulls, "barbearia", "Portugal").first().skippedNoContact == 1


def test_csv_round_trip(spark, tmp_path):
    cells = [lead(name='Talho "Ação"; x', email="a@b.pt", notes="n | m"), lead(name="B", phone="912345678")]
    df = table(spark, cells)
    io.write_leads_csv(df, str(tmp_path / "one"), single_file=True)
    back = io.read_leads_csv(spark, str(tmp_path / "one"))
    assert sorted(tuple(r)[:9] for r in back.collect()) == sorted(cells)
    raw = next((tmp_path / "one").glob("part-*")).read_bytes()
    assert raw.startswith("﻿Nome;Pagina web".encode()) and raw.endswith(b"\r\n")
    io.write_leads_csv(df, str(tmp_path / "many"))
    assert sorted(tuple(r)[:9] for r in io.read_leads_csv(spark, str(tmp_path / "many")).collect()) == sorted(cells)


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿Name;Website;E-mail;City\r\n\r\n A ;"a;""b"\nB;b.pt;b@c.pt;Faro;zzz\n'.encode())
    found = [(r.name, r.website, r.email, r.locality) for r in io.read_leads_csv(spark, str(tmp_path / "x.csv")).orderBy("seq").collect()]
    assert found == [("A", 'a;"b', "", ""), ("B", "b.pt", "b@c.pt", "Faro")]


def test_reports_requests_and_layout(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"status":"completed","writtenRows":3,"notes":["a"]}')
    assert io.read_source_reports(spark, str(tmp_path / "r.json")).first().notes == ["a"]
    (tmp_path / "q.json").write_text('{"run_id":"1","leadType":" "}')
    request = io.read_requests(spark, str(tmp_path / "q.json")).first()
    assert (request.leadType, request.geography, request.outputName) == ("leads", "Portugal", "leads.csv")
    df = spark.createDataFrame([("r", "web", "a"), ("r", "maps", "b")], "run_id string, profile string, name string")
    io.write_by_source(df, str(tmp_path / "runs"))
    assert io.read_by_source(spark, str(tmp_path / "runs")).where("profile = 'maps'").first().name == "b"
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>x\n</p>")
    page = io.read_pages(spark, str(tmp_path / "pages"), "html").first()
    assert page.url.endswith("a.html") and page.html == "<p>x\n</p>"
    for version in (1, 2):
        df.write.parquet(f"{tmp_path}/out/run_id=r/version={version}") if version == 1 else df.limit(1).drop("run_id").write.parquet(f"{tmp_path}/out/run_id=r/version={version}")


def test_verdicts_wait(spark):
    leads = Q.raw_leads(spark, SF_DIR)
    verdicts = Q.verdict_table(spark, SF_DIR)
    s = C.funnel_stats(leads, "barbearia", "Portugal", verdicts=verdicts, pending=True).first()
    total = s.skippedNoContact + s.skippedNoName + s.skippedWrongType + s.pendingValidation + s.rejectedByValidation + s.duplicates + s.totalValid
    assert s.pendingValidation > 0 and total == leads.count()


def test_micro_batches(spark, tmp_path):
    leads = Q.raw_leads(spark, SF_DIR)
    now = [0.0]
    c = Consolidator(spark, str(tmp_path), "barbearia", "Portugal", clock=lambda: now[0])
    c.process(leads.where("row_no % 2 = 0"), 0)
    first = c.result.count()
    now[0] = 60
    c.process(leads.where("row_no % 2 = 1"), 1)
    assert c.stats.first().pendingValidation > 0
    c.process(leads.where("row_no % 2 = 1"), 1)  # a batch that runs again replaces itself
    now[0] = 200
    c.process(leads.limit(0), 2)
    assert c.stats.first().pendingValidation == 0 and c.result.count() >= first


def test_keyed_state(spark, tmp_path):
    leads = Q.raw_leads(spark, SF_DIR).withColumn("run_id", F.lit("r")).drop("seq")
    leads.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(leads.schema).parquet(str(tmp_path / "in")).withColumn("seq", F.struct("profile_rank", "row_no"))
    query = keyed_verdicts(stream, "barbearia", "Portugal").writeStream.outputMode("update").format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = C.verdict_per_key(C.candidates(Q.raw_leads(spark, SF_DIR), "barbearia", "Portugal").where("skip_reason is null"))
    columns = ["cache_key", *C.FIELDS, "n"]
    assert {tuple(r) for r in spark.table("verdicts").select(*columns).collect()} == {tuple(r) for r in want.select(*columns).collect()}


def test_batches_merge_what_they_touch(spark, tmp_path):
    """After every batch the result is that of a merge of all keys judged so far; a batch run again changes nothing."""
    leads = Q.raw_leads(spark, SF_DIR)
    c = Consolidator(spark, str(tmp_path), "barbearia", "Portugal")
    assert c.result.count() == 0 and not c.pending() and tuple(c.stats.first()) == (0, 0, 0)
    parts = [leads.where(f"row_no % 5 = {k}") for k in range(5)]
    for k, part in enumerate(parts):
        for _ in range(2):
            c.process(part, k, force=True)
        judged = spark.read.parquet(f"{tmp_path}/verdicts").where("merge_key is not null").drop("batch")
        counts = spark.read.parquet(f"{tmp_path}/keys").groupBy("cache_key").agg(F.sum("n").alias("n"), F.min("first").alias("seq"))
        want = C.merge_leads(judged.join(counts, "cache_key"))
        columns = ["merge_key", *C.FIELDS, "n"]
        assert sorted(map(tuple, c.result.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/result").groupBy("version").count().orderBy("version").collect()]
    assert sizes[-1] < c.result.count()


def test_run_folder(spark):
    from pathlib import Path

    from leadloom.sources import shared

    spark2 = spark.newSession()
    path = shared.fresh_folder(spark2, "x")
    spark2.range(3).write.parquet(path)
    assert spark2.read.parquet(path).count() == 3
    shared.drop_run(spark2)
    assert not Path(path.removeprefix("file://")).exists() and shared.fresh_folder(spark2, "x").rsplit("/", 1)[0] != path.rsplit("/", 1)[0]


def test_first_batch_fixes_the_row(spark, tmp_path):
    """Later batches only count, and a batch without news changes nothing."""
    rows = [lead(name="Barbearia X", email="a@b.pt", notes=n) for n in ("first", "last of the batch", "later", "later still")]
    schema = ", ".join(f"{f} string" for f in C.FIELDS) + ", run_id string, profile_rank int, row_no long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("seq", F.struct("profile_rank", "row_no"))
    seen = []
    for part in ([2, 1], [9, 8], []):
        data = [(*rows[0][:8], rows[{1: 0, 2: 1, 8: 2, 9: 3}[k]][8], "r", 0, k) for k in part]
        if data:
            spark.createDataFrame(data, schema).write.mode("append").parquet(str(tmp_path / "in"))
        keyed_verdicts(stream, "barbearia", "Portugal").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: seen.extend((r.notes, r.seq.row_no, r.n) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert seen == [("last of the batch", 1, 2), ("last of the batch", 1, 4)]


def test_rows_wait_for_the_clock_only(spark, tmp_path):
    """With no new file, the ticks judge what waits once validation is due."""
    import time

    leads = Q.raw_leads(spark, SF_DIR).drop("seq")
    now = [0.0]
    c = Consolidator(spark, str(tmp_path / "work"), "barbearia", "Portugal", clock=lambda: now[0])
    c.last_validation = 0.0
    c.process(Q.raw_leads(spark, SF_DIR).where("row_no % 2 = 0"), 1000, force=True)
    leads.where("row_no % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(leads.schema).parquet(str(tmp_path / "in")).withColumn("seq", F.struct("profile_rank", "row_no"))
    query = c.start(stream, str(tmp_path / "cp"))
    try:
        until = time.time() + 90
        while time.time() < until and not c.pending():
            time.sleep(0.5)
        assert c.pending()
        now[0] = 200.0
        while time.time() < until and c.pending():
            time.sleep(0.5)
        assert not c.pending()
    finally:
        query.stop()


def test_keys_are_forgotten(spark, tmp_path):
    rows = [("r", "web", "k", 0), ("r", "web", "k", 1), ("r", "web", "l", 10 * 86400)]
    df = spark.createDataFrame(rows, "run_id string, profile string, key string, at long").withColumn("at", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = []
    first_per_key_stream(stream, "at").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: out.extend(r.key for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == ["k", "l"]


@pytest.mark.parametrize("most", [10_000, 1])
def test_requests_by_key(spark, most):
    """Every lead with every request, row by row, against the joins by key; few places and many."""
    leads = C.conform(Q.raw_leads(spark, SF_DIR).limit(400)).cache()
    asked = [("a", "barbearia", "EUROPE"), ("b", "leads", "Portugal"), ("c", "Barber", ""), ("d", "talhos", "são joão"), ("e", "", "ASIA"), ("f", "barbeiro", "zz"), ("g", None, None), ("h", "x", "e"), ("i", "x", "ur"), ("a2", "barbearia", "europe")]
    requests = spark.createDataFrame(asked, "run_id string, lead_type string, geography string")
    from leadloom.functions.predicates import matches_geography, matches_type

    want = []
    for run, kind, place in asked:
        hit = leads.where(matches_type(F.lit(kind).cast("string")) & matches_geography(F.lit(place).cast("string")))
        want += [(run, r.row_no) for r in hit.select("row_no").collect()]
    got = C.match_requests(leads, requests, most)
    assert sorted((r.run_id, r.row_no) for r in got.collect()) == sorted(want) and got.columns == [*leads.columns, "run_id"]
    assert C.match_requests(leads, requests.limit(0), most).count() == 0 == C.match_requests(leads.limit(0), requests, most).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan or most > 1


def test_texts_meet_the_places_that_they_name(spark):
    """Where every text holds a common run of letters, a text meets few places that it doesn't name, and all that it does."""
    hays = spark.createDataFrame([(f"vila nova de {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i % 7} porto",) for i in range(2000)], "_hay string").distinct()
    places = spark.createDataFrame([(f"vila nova de {chr(97 + i % 26)}{chr(97 + i // 26)}x",) for i in range(600)] + [("porto",), ("zz nowhere",), ("x",), ("de",)], "_place string")
    met = C.places_met(hays, places).cache()
    named = sorted((r._hay, r._place) for r in met.where(F.contains("_hay", "_place")).collect())
    all_hays, all_places = ([r[0] for r in df.collect()] for df in (hays, places))
    assert named == sorted((h, p) for h in all_hays for p in all_places if p in h)
    assert met.count() <= 2 * len(named)


def test_one_scan(spark, tmp_path):
    """Merge and funnel read their input once."""
    Q.raw_leads(spark, SF_DIR).write.parquet(str(tmp_path / "leads"))
    leads = spark.read.parquet(str(tmp_path / "leads"))
    for df in (C.consolidate(leads, "barbearia", "Portugal"), C.funnel_stats(leads, "barbearia", "Portugal")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
