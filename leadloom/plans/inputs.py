"""Queries of odd inputs: spelled hosts, links behind redirects, several files, quotes inside cells, committed outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions.urls import clean_url, normalize_domain
from leadloom.operators import consolidate as C
from leadloom.sources import io
from leadloom.sources.shared import fresh_folder

from .consolidation import RAW, d_conformed, d_strip, raw_leads, read

Query = Callable[[SparkSession, str], DataFrame]

#: Addresses by the key of a supplier, and the host that a URL parser finds in each, written by hand.
SPELLINGS = [
    ("'https://loja' || k || '.café.pt/x'", "'loja' || k || '.xn--caf-dma.pt'"),
    ("'HTTP://www.LOJA' || k || '.CAFÉ.PT'", "'loja' || k || '.xn--caf-dma.pt'"),
    ("'loja' || k || '.xn--caf-dma.pt/contacto'", "'loja' || k || '.xn--caf-dma.pt'"),
    ("'https://loja' || k || '.caf%C3%A9.pt'", "'loja' || k || '.xn--caf-dma.pt'"),
    ("'http://user:pw@loja' || k || '.straße.de:8080/'", "'loja' || k || '.xn--strae-oqa.de'"),
    ("'https://東京.loja' || k || '.jp?q=1'", "'xn--1lqs71d.loja' || k || '.jp'"),
    ("'http://127.' || k || '/a'", "'127.' || (k // 65536) || '.' || (k // 256 % 256) || '.' || (k % 256)"),
    ("'0x7f.0.0.' || (k % 250 + 6)", "'127.0.0.' || (k % 250 + 6)"),
    ("'http://' || k || '.300.1.1/a?b'", "k || '.300.1.1'"),
    ("'loja' || k || '.example.pt | https://y.pt'", "'loja' || k || '.example.pt | https:'"),
]


def q_host_spellings(spark, sf):
    """The host of each of a supplier's addresses."""
    keys = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    text = [F.expr(address) for address, _ in SPELLINGS]
    spelled = keys.select("k", F.posexplode(F.array(*text)).alias("i", "address"))
    return spelled.select(F.col("k").cast("long").alias("k"), F.col("i").cast("int").alias("i"), normalize_domain(F.col("address")).alias("domain"))


def q_one_business_per_host(spark, sf):
    """Businesses by merge key, each known under four spellings of its host."""
    keys = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    spelled = keys.select("k", F.explode(F.array(*[F.expr(address) for address, _ in SPELLINGS[:4]])).alias("website"))
    blank = [F.lit("").alias(f) for f in C.FIELDS if f not in ("name", "website")]
    leads = spelled.select("website", F.concat(F.lit("Barbearia "), F.col("k").cast("string")).alias("name"), *blank)
    return leads.groupBy(C.merge_key().alias("merge_key")).agg(F.count(F.lit(1)).alias("n"))


#: Redirects that may be nested.
AROUND = ["https://www.google.com/url?q=", "https://duckduckgo.com/l/?uddg=", "https://bing.com/aclick?u=", "https://www.google.com/url?sa=t&url="]


def q_nested_redirects(spark, sf):
    """Links of suppliers behind none to eight redirects."""
    link = F.concat(F.lit("https://loja"), F.col("k").cast("string"), F.lit(".example.pt/a?b=1"))
    links = [link]
    for depth in range(8):
        links.append(F.concat(F.lit(AROUND[depth % 4]), F.url_encode(links[-1])))
    keys = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return keys.select("k", F.posexplode(F.array(*links)).alias("depth", "link")).select("k", "depth", clean_url(F.col("link")).alias("url"))


#: Sources in an order of their own; their tables differ in size.
SOURCES = ["web", "free", "directories", "social", "maps"]


def _in_files(spark, sf) -> DataFrame:
    """Contacts written source by source, each in several files, and read again by the list of their paths."""
    path = fresh_folder(spark, "sources")
    raw = raw_leads(spark, sf).withColumn("notes", F.col("row_no").cast("string"))
    for source in SOURCES:
        few = raw.where((F.col("profile") == source) & (F.col("row_no") % (2 + SOURCES.index(source)) < 2))
        io.write_leads_csv(few, f"{path}/{source}", order=["row_no"])
    return io.read_leads_csv(spark, [f"{path}/{s}" for s in [*SOURCES[:2], "missing", *SOURCES[2:]]])


def q_file_order(spark, sf):
    """Rank of each contact within its source as read, and as read over all files of its district."""
    rows = _in_files(spark, sf).select("district", F.col("notes").cast("long").alias("row_no"), "seq", F.regexp_extract("_file", "/([a-z]+)/[^/]*$", 1).alias("source"))
    in_source, in_district = Window.partitionBy("source", "district").orderBy("seq"), Window.partitionBy("district").orderBy("seq")
    return rows.select("source", "district", "row_no", F.row_number().over(in_source).alias("rank"), F.row_number().over(in_district).alias("place"))


def q_first_of_files(spark, sf):
    """The first contact of each locality over all files, as merging takes it."""
    rows = _in_files(spark, sf)
    return rows.groupBy("locality").agg(F.min_by("name", "seq").alias("name"), F.min_by(F.col("notes").cast("long"), F.col("seq")).alias("row_no"), F.count(F.lit(1)).alias("n"))


#: Lines by the key of a supplier and their three cells, written by hand.
LINES = [
    ("'ab \"x;y\" z' || k || ';1'", ["'ab x;y z' || k", "'1'", "''"]),
    ("'\"a\"\"b' || k || '\";c;d;e'", ["'a\"b' || k", "'c'", "'d'"]),
    ("'\"open;' || k", ["'open;' || k", "''", "''"]),
    ("'  ' || k || ' ; \"b\" ;'", ["k || ''", "'b'", "''"]),
    ("'\"\"' || k || ';\"\";x'", ["k || ''", "''", "'x'"]),
    ("'a\"b;\"c\"d;' || k", ["'ab;cd;' || k", "''", "''"]),
    ("'\"\"\"' || k || '\"\"\";\"y\"\"\"'", ["'\"' || k || '\"'", "'y\"'", "''"]),
    ("'#' || k || ';;\"z\"\"\"\"\"'", ["'#' || k", "''", "'z\"\"'"]),
]


def _case(choices: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN k % {len(choices)} = {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def q_odd_csv_lines(spark, sf):
    """Cells of lines with quotes in every place, under two headers in two files."""
    path = fresh_folder(spark, "lines")
    lines = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).select("k", F.expr(_case([line for line, _ in LINES])).alias("value"))
    for i, header in enumerate(["Nome;Telefone; Notas ", "﻿Nome;Telefone;\"Not\"as"]):
        half = lines.where(F.expr(f"floor(k / 8) % 2 = {i}"))
        first = spark.createDataFrame([(header,), (" ",)], "value string")
        first.coalesce(1).union(half.select("value").coalesce(1)).coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/{i}")
    rows = io.read_csv(spark, [f"{path}/0", f"{path}/1"])
    return rows.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in (("Nome", "nome"), ("Telefone", "telefone"), ("Notas", "notas"))])


def q_ordered_export(spark, sf):
    """One file written from ranges and read again: the place of each contact within its locality."""
    path = fresh_folder(spark, "export")
    leads = C.conform(raw_leads(spark, sf)).withColumn("notes", F.concat(F.lit(' "'), "district", F.lit('"; '), F.col("seq.row_no").cast("string")))
    io.write_leads_csv(leads, path, columns="Nome;Localidade;Observacoes", single_file=True)
    rank = F.row_number().over(Window.partitionBy("Localidade").orderBy("_row"))
    return io.read_csv(spark, path).select(F.col("Nome").alias("nome"), F.col("Localidade").alias("localidade"), F.col("Observacoes").alias("notas"), rank.alias("rank"))


def q_committed_result(spark, sf):
    """The newest committed output of a run; a newer one that was never committed and one of another run hold more rows."""
    path = fresh_folder(spark, "results")
    leads = raw_leads(spark, sf).select("row_no", "name")
    for run, version in (("a", 1), ("a", 10), ("a", 2), ("b/c", 30)):
        io.write_result(leads.where(F.col("row_no") % version == 0), path, run, version)
    leads.write.parquet(f"{path}/run=a/version=11")
    return io.latest_result(spark, path, "a").select("run_id", "version", "row_no", "name")


QUERIES: dict[str, Query] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

# --- SQL ---------------------------------------------------------------------

_KEYS = "keys AS (SELECT s_suppkey AS k FROM supplier)"
_PLACE = "list_position([" + ", ".join(repr(s) for s in SOURCES) + "], profile)"
_FILES = f"{RAW}, rows_of AS (SELECT *, {_PLACE} AS p FROM raw_leads WHERE row_no % (1 + {_PLACE}) < 2)"

ORACLE_SQL: dict[str, str] = {
    "host_spellings": f"WITH {_KEYS} " + " UNION ALL ".join(f"SELECT k::BIGINT AS k, {i}::INT AS i, {host} AS domain FROM keys" for i, (_, host) in enumerate(SPELLINGS)),
    "one_business_per_host": f"WITH {_KEYS} SELECT 'web:loja' || k || '.xn--caf-dma.pt|barbearia ' || k AS merge_key, 4::BIGINT AS n FROM keys",
    "nested_redirects": f"WITH {_KEYS} SELECT k::BIGINT AS k, d::INT AS depth, 'https://loja' || k || '.example.pt/a?b=1' AS url FROM keys, range(9) r(d)",
    "file_order": f"WITH {_FILES} SELECT profile AS source, {d_strip('district')} AS district, row_no, row_number() OVER (PARTITION BY profile, district ORDER BY row_no)::INT AS rank, row_number() OVER (PARTITION BY district ORDER BY p, row_no)::INT AS place FROM rows_of",
    "first_of_files": f"WITH {_FILES} SELECT {d_strip('locality')} AS locality, {d_strip('arg_min(name, (p, row_no))')} AS name, arg_min(row_no, (p, row_no)) AS row_no, count(*) AS n FROM rows_of GROUP BY locality",
    "odd_csv_lines": f"WITH {_KEYS} SELECT " + ", ".join(f"{_case([cells[i] for _, cells in LINES])} AS {name}" for i, name in enumerate(("nome", "telefone", "notas"))) + " FROM keys",
    "ordered_export": f"""WITH {d_conformed()} SELECT name AS nome, locality AS localidade, '"' || district || '"; ' || (seq % 1000000000000) AS notas,
  row_number() OVER (PARTITION BY locality ORDER BY seq)::INT AS rank FROM conformed""",
    "committed_result": f"WITH {RAW} SELECT 'a' AS run_id, 10::INT AS version, row_no, name FROM raw_leads WHERE row_no % 10 = 0",
}
