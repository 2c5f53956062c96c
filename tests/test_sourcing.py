"""Queries of requests and search results over all of their rows, against counts made by hand."""

import glob

from pyspark.sql import functions as F

import __spark_entry__
from leadloom.operators import consolidate as C
from leadloom.operators import frontier as N
from leadloom.operators import report as O
from leadloom.operators.consolidate import merged_rows
from leadloom.streaming.consolidate import merged_stream

SF_DIR = "/root/testdata/sf0.001"


def test_addresses_of_every_query(spark):
    queries = __spark_entry__.queries()
    urls = queries["provider_urls"](spark, SF_DIR)
    found = {(r.run_id, r.profile): (r.n, r.last) for r in urls.groupBy("run_id", "profile").agg(F.count(F.lit(1)).alias("n"), F.max("query_ord").alias("last")).collect()}
    # run0 asks for Barbearias in Portugal: 3 words, 3 endings, the country and its towns (alone too: directories, free), then the sites
    counts = {"directories": (3 * 3 * 22 + 3 * 6, 7), "web": (3 * 3 * 6, 7), "maps": (3 * 3 * 7 + 3 * 2, 6), "social": (3 * 3 * 5 + 3 * 2, 6), "free": (3 * 3 * 22 + 3 * 3, 7)}
    assert {p: found["run0", p] for p in counts} == {p: (n * providers, n) for p, (n, providers) in counts.items()}
    assert {(r.run_id, r.profile, r.query_ord) for r in urls.select("run_id", "profile", "query_ord").distinct().collect()} == {(r.run_id, r.profile, r.query_ord) for r in queries["build_queries"](spark, SF_DIR).collect()}


def test_links_past_the_third(spark, tmp_path):
    # one query, q0 of run4: 25 pages of google with a link of their own each, and the shops' page that all share
    spark.range(0, 25).selectExpr("id * 15 AS s_suppkey", "4L AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    queries = __spark_entry__.queries()
    shops = [f"https://loja{n}.example.pt/a" for n in (0, 15, 30, 5, 20, 35, 10, 25)]
    others = [f"https://b{n}.example.pt/p" for n in (0, 1, 2, 3, 4, 5, 6)]
    links = []
    for i in range(8):
        links += [shops[i], *([others[i]] if i < 7 else [])]
    top = {r.rank: r.url for r in queries["frontier_topk"](spark, str(tmp_path)).collect()}
    assert top == dict(enumerate(links, 1))
    assert {r.url for r in queries["frontier_first_seen"](spark, str(tmp_path)).collect()} == set(links)


def test_smaller_and_default_top(spark):
    urls = spark.createDataFrame([("r", "web", "q", 0, (0, i), f"https://x{i}.pt/") for i in range(25)], "run_id string, profile string, query string, query_ord int, position struct<provider_ord: int, place: int>, url string")
    assert sorted(r["rank"] for r in N.frontier_topk(urls).collect()) == list(range(1, 19))
    assert sorted((r["rank"], r.url) for r in N.frontier_topk(urls, 3).collect()) == [(i + 1, f"https://x{i}.pt/") for i in range(3)]


def test_requests_and_searches_follow_the_tables(spark, tmp_path):
    spark.range(0, 60).selectExpr("id AS s_suppkey", "7L AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 7L AS n_nationkey, 'GERMANY' AS n_name, 0L AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    found = {name: __spark_entry__.queries()[name](spark, str(tmp_path)) for name in ("build_queries", "directory_urls", "page_stop", "directory_cards", "directory_details", "directory_leads")}
    runs = {name: df.select("run_id").distinct().count() for name, df in found.items() if "run_id" in df.columns}
    assert runs == dict.fromkeys(runs, 60)
    # one business is found by every fifth search; its two pages come once
    assert found["directory_cards"].where("detail_url = 'https://www.pai.pt/ms/0-1'").count() == 12
    assert found["directory_details"].count() == 2 * (1 + 48)
    assert found["directory_leads"].where("email = 't0@example.pt'").count() == 12


def test_counters_hold_no_lists(spark):
    found = spark.createDataFrame([("r", "web", i, i % 3 == 0, f"b{i}" if i % 4 == 3 else None, f"n{i}" if i % 3 else None) for i in range(12)] + [("r", "maps", 1, True, None, None)], "run_id string, profile string, seq int, written boolean, blocker string, note string")
    counters = O.source_counters(found)
    assert not [c for c, kind in counters.dtypes if kind.startswith("array")]
    assert {tuple(r) for r in counters.select("profile", "foundRows", "writtenRows", "n_notes", "n_blockers", "first_blocker").collect()} == {("web", 12, 4, 8, 3, "b3"), ("maps", 1, 1, 0, 0, None)}
    assert sorted((r.profile, r.seq, r.text) for r in O.source_texts(found, "blocker").collect()) == [("web", 3, "b3"), ("web", 7, "b7"), ("web", 11, "b11")]
    assert O.source_texts(found, "note").count() == 8


def test_stream_state_holds_distinct_parts_of_a_hot_key(spark):
    lead = {"name": "Barbearia A", "website": "https://a.example.pt", "email": "a@a.example.pt", "phone": "912345678", "locality": "Lisboa", "district": "Lisboa", "notes": "Fonte web"}
    rows = [({**lead, "sources": f"https://s{i % 3}.pt | https://s{i % 2}.pt"}, i) for i in range(300)]
    schema = ",".join(f"{f} string" for f in C.FIELDS) + ", row_no long"
    leads = spark.createDataFrame([(*[r.get(f, "") for f in C.FIELDS], i) for r, i in rows], schema).withColumn("seq", F.struct(F.lit(0).alias("profile_rank"), "row_no"))
    state = merged_stream(leads, "barbearia", "Portugal")
    assert not [c for c, kind in state.dtypes if kind.startswith("array")]
    assert state.where("_field = 'sources'").count() == 3 and state.count() < 10
    wanted = C.merge_leads(C.judged_rows(leads, "barbearia", "Portugal", verdict_scope="row").where("merge_key is not null"))
    got = [tuple(r) for r in merged_rows(state).select("merge_key", *C.FIELDS, "seq", "n").collect()]
    assert got == [tuple(r) for r in wanted.select("merge_key", *C.FIELDS, "seq", "n").collect()] and got[0][-1] == 300


def test_part_files_are_even(spark):
    __spark_entry__.queries()["stream_consolidate"](spark, SF_DIR)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for path in glob.glob(f"{shared}/stream-*/in"):
        counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
        assert len(counts) >= 4 and max(counts) <= min(counts) + 4


def test_pages_in_buckets_are_not_shuffled(spark, tmp_path):
    """Joining the frontier to pages in buckets moves the frontier only."""
    from leadloom.operators import frontier as N
    from leadloom.sources import io

    pages = spark.createDataFrame([(f"https://a.pt/{i}", f"<p>{i}") for i in range(100)], "url string, html string")
    io.write_pages(pages, "pages_in_buckets", str(tmp_path / "pages"), buckets=4)
    frontier = spark.createDataFrame([("r", "web", f"https://a.pt/{i}") for i in range(50, 150)], "run_id string, profile string, url string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, missing = N.fetch(frontier, spark.table("pages_in_buckets"))
        assert sorted(r.html for r in found.collect()) == sorted(f"<p>{i}" for i in range(50, 100)) and missing.count() == 50
        lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table pages_in_buckets")
    scan = next(i for i, x in enumerate(lines) if "pages_in_buckets" in x)
    branch = [x for x in lines[:scan] if not x.lstrip().startswith(":") and ": " not in x[:12]]
    assert any("Join" in x for x in branch) and not any("Exchange" in x or "ShuffleQueryStage" in x for x in branch)
