"""Queries of sources, sinks, unions and streaming validation: each writes to the shared folder and reads back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import or_null
from leadloom.operators import consolidate as C
from leadloom.operators.frontier import PROFILES
from leadloom.operators.report import source_counters
from leadloom.sources import io
from leadloom.sources.shared import fresh_folder
from leadloom.streaming.consolidate import Consolidator, first_in_order_stream, first_per_key_stream, keyed_verdicts
from leadloom.streaming.state import STORE, MergeLog, judged_stream, start

from .consolidation import D_OUT, LEAD_TYPE, ORD, OUT, RAW, d_candidates, d_conformed, d_key, d_merged, d_strip, raw_leads, read, tables
from .sourcing import REQUESTS

Query = Callable[[SparkSession, str], DataFrame]

# --- files -------------------------------------------------------------------


def q_write_leads_csv(spark, sf):
    """The lines of the written files: a header each, rows in no order, quotes where a cell needs them."""
    leads = C.conform(raw_leads(spark, sf)).withColumn("notes", F.concat(F.lit('"'), "district", F.lit('"; '), "notes"))
    path = fresh_folder(spark, "csv")
    io.write_leads_csv(leads, path, columns="Nome;Telefone;Observacoes;Sem valor")
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n")).select("line", F.when(F.col("line").startswith("Nome;"), 1).otherwise(F.col("n")).cast("long").alias("n"))


def q_read_leads_csv(spark, sf):
    """Contact files under other headers, written and read back as the nine fields."""
    names = {"name": "Name", "website": "Site", "socials": "Redes", "email": "E-mail", "phone": "Telemóvel", "locality": "City", "district": "Região", "sources": "Fontes", "notes": "Notas"}
    leads, path = raw_leads(spark, sf), fresh_folder(spark, "csv")
    leads.select(*[F.col(f).alias(h) for f, h in names.items()], "row_no").write.options(sep=";", header="true", escape='"', emptyValue="").csv(path)
    rows = io.read_csv(spark, path)
    return C.coalesce_aliases(rows).select(F.col("row_no").cast("long").alias("row_no"), *C.FIELDS)


def reported(spark, sf):
    leads = C.conform(raw_leads(spark, sf)).withColumn("run_id", F.col("district"))
    return leads.withColumns({"written": F.col("email") != "", "note": or_null(F.col("notes")), "blocker": F.when(F.col("website") == "", F.concat(F.lit("sem site "), F.col("row_no").cast("string")))})


def q_source_reports(spark, sf):
    """Reports of all sources as JSON documents, with the first blocker, read back."""
    counted = source_counters(reported(spark, sf))
    blockers = F.filter(F.array("first_blocker"), lambda x: x.isNotNull())
    path = fresh_folder(spark, "reports")
    io.write_source_reports(counted.select(F.lit("completed").alias("status"), F.concat_ws("/", "run_id", "profile").alias("profile"), "writtenRows", "foundRows", blockers.alias("blockers")), path)
    return io.read_source_reports(spark, path, lines=True).select("status", "profile", "writtenRows", "foundRows", F.array_join("blockers", " | ").alias("blockers"), F.col("notes").isNull().alias("no_notes"))


def q_read_requests(spark, sf):
    """Request documents without what they leave blank, read with the defaults."""
    tables(spark, sf, "supplier", "nation")
    asked = spark.sql(REQUESTS)
    path = fresh_folder(spark, "requests")
    asked.select("run_id", F.col("lead_type").alias("leadType"), or_null(F.col("geography")).alias("geography")).write.json(path)
    return io.read_requests(spark, path, lines=True).select("run_id", "leadType", "geography", "outputName", "columns")


def q_read_pages(spark, sf):
    return io.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


def q_read_by_source(spark, sf):
    """Contacts in folders by run and profile, read back with both from the path."""
    path = fresh_folder(spark, "runs")
    leads = raw_leads(spark, sf).select(F.concat(F.lit("run "), "district").alias("run_id"), "profile", "row_no", "name")
    io.write_by_source(leads.repartition("run_id", "profile", F.pmod("row_no", F.lit(16))), path)
    return io.read_by_source(spark, path).select("run_id", "profile", "row_no", "name")


def q_latest_result(spark, sf):
    """The newest of three outputs of a run; another run and older outputs hold more rows."""
    path = fresh_folder(spark, "results")
    leads = raw_leads(spark, sf).select("row_no", "name")
    for run, version in (("a", 1), ("b", 1), ("a", 10), ("a", 2), ("b", 2)):
        io.write_result(leads.where(F.col("row_no") % version == 0), path, run, version)
    return io.latest_result(spark, path, "a").select("version", "row_no", "name")


def q_coalesce_aliases(spark, sf):
    """Rows with several headers of one field: the first with a value counts."""
    raw = raw_leads(spark, sf)
    even = F.col("row_no") % 2 == 0
    given = raw.select("row_no", F.when(even, F.col("name")).otherwise(" ").alias("Nome"), F.concat(F.lit("x "), "name").alias("Name"), F.col("website").alias("Site"), F.lit(None).cast("string").alias("Website"), F.col("email").alias("E mail"), F.col("phone").alias("Phone"), F.col("district").alias("Region"), F.col("locality").alias("City"))
    return C.coalesce_aliases(given).select("row_no", *C.FIELDS)


def q_conform_columns(spark, sf):
    found = C.conform_columns(raw_leads(spark, sf), " name;phone; ;fax;email")
    return found.groupBy("name", "phone", "fax", "email").agg(F.count(F.lit(1)).alias("n"))


def q_union_sources(spark, sf):
    """One table per profile, each without some of the columns, put together and conformed."""
    raw = raw_leads(spark, sf)
    sources = [raw.where(F.col("profile") == p).select("profile", "row_no", *C.FIELDS[: 5 + k]) for k, (p, _) in enumerate(PROFILES)]
    return C.union_sources(*sources).select("profile", "row_no", *[F.coalesce(f, F.lit("")).alias(f) for f in C.FIELDS])


# --- streaming validation ----------------------------------------------------

#: Rows come in three batches; the first and the last are validated.
BATCH = "CASE WHEN row_no % 3 = 1 THEN 0 WHEN row_no % 2 = 1 THEN 1 ELSE 2 END"


def _batched(spark, sf, stop: int) -> Consolidator:
    """Batches up to ``stop``, a minute apart, the last of three forced."""
    leads = raw_leads(spark, sf).withColumn("_batch", F.expr(BATCH))
    now = [0.0]
    c = Consolidator(spark, fresh_folder(spark, "batches"), LEAD_TYPE, "Portugal", clock=lambda: now[0])
    for k in range(stop + 1):
        now[0] = 50.0 * k
        c.process(leads.where(F.col("_batch") == k).drop("_batch"), k, force=k == 2)
    return c


def q_timed_validation(spark, sf):
    """After two batches, the second within the interval: rows of new keys wait."""
    return _batched(spark, sf, 1).stats.select("pendingValidation", "kept", "duplicates")


def q_forced_validation(spark, sf):
    """After the last batch: keys keep the verdict of the batch that brought them, all are judged."""
    return _batched(spark, sf, 2).result.select(*OUT, "n")


def _streamed(spark, sf, name: str):
    """Contacts as a file stream."""
    path = fresh_folder(spark, name)
    leads = raw_leads(spark, sf).withColumn("run_id", F.col("district")).drop("seq")
    leads.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(leads.schema).parquet(f"{path}/in")
    return path, stream.withColumn("seq", F.struct("profile_rank", "row_no"))


def _drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """The last state of each row of a stream after all its files."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def q_keyed_verdicts(spark, sf):
    """State by run and key; all files come in one batch."""
    path, stream = _streamed(spark, sf, "verdicts")
    return _drain(keyed_verdicts(stream, LEAD_TYPE, "Portugal"), path, "update").select("run_id", "cache_key", *C.FIELDS, F.col("seq.row_no").alias("row_no"), "n")


def q_stream_first_per_key(spark, sf):
    """Keys that pass a stream once each; which of their rows comes first is the stream's affair."""
    path, stream = _streamed(spark, sf, "firsts")
    keyed = C.conform(stream).withColumn("key", C.merge_key(check_listing=False))
    return _drain(first_per_key_stream(keyed.select("run_id", "profile", "key", "row_no")), path, "append").select("run_id", "profile", "key")


def q_stream_first_in_order(spark, sf):
    """The first contact of each key by its place, though later ones arrive first; a late row moves the watermark past all."""
    path = fresh_folder(spark, "ordered")
    keyed = C.conform(raw_leads(spark, sf)).withColumn("key", C.merge_key(check_listing=False))
    rows = keyed.select(F.col("district").alias("run_id"), "profile", "key", "seq", F.timestamp_seconds(F.col("seq.row_no")).alias("at"))
    last = spark.createDataFrame([("", "", "", (9, 0), 100 * 86400)], "run_id string, profile string, key string, seq struct<profile_rank:int,row_no:bigint>, at long").withColumn("at", F.timestamp_seconds("at"))
    for part in (rows.where("seq.row_no % 3 = 2"), rows.where("seq.row_no % 3 = 1"), rows.where("seq.row_no % 3 = 0"), last):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return _drain(first_in_order_stream(stream, "at"), path, "append").select("run_id", "profile", "key", F.col("seq.row_no").alias("row_no"))


def q_stream_unchanged(spark, sf):
    """A stream started again over the same files does nothing: one output, the same rows as the batch job."""
    path, stream = _streamed(spark, sf, "unchanged")
    c = Consolidator(spark, f"{path}/work", LEAD_TYPE, "Portugal")
    for _ in range(2):
        c.start(stream, f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/work/result").select("version", *OUT, "n").withColumn("version", F.col("version").cast("long"))


def q_stateful_validation(spark, sf):
    """Contacts by keyed state and the log that is merged when read; keys are judged when they come."""
    path, stream = _streamed(spark, sf, "stateful")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        log = MergeLog(spark, f"{path}/log")
        start(judged_stream(stream.withColumn("run_id", F.lit("all")), LEAD_TYPE, "Portugal", interval_s=0), log, f"{path}/checkpoint", once=True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return log.result().select(*OUT, "n")


QUERIES: dict[str, Query] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

# --- SQL ---------------------------------------------------------------------

_CELL = "CASE WHEN contains({x}, ';') OR contains({x}, '\"') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
_REQUESTS = f"requests AS ({REQUESTS.replace(' STRING)', ' VARCHAR)')})"
_ROW = "seq % 1000000000000 AS row_no"
_PROFILES = [p for p, _ in PROFILES]
_UNION = ", ".join(f"CASE WHEN list_position([{', '.join(repr(p) for p in _PROFILES)}], profile) > {max(0, k - 4)} THEN {f} ELSE '' END AS {f}" for k, f in enumerate(C.FIELDS))


def _epochs() -> str:
    """Candidates with the validation that judges their batch; the first one of a key fixes its row."""
    return f"{d_candidates()}, epochs AS (SELECT c.*, {BATCH.replace('row_no', '(c.seq % 1000000000000)')} AS batch FROM cand c), fixed AS (SELECT cache_key, min(CASE WHEN batch = 0 THEN 0 ELSE 1 END) AS e FROM epochs GROUP BY cache_key)"


def _by_epoch(seen: str) -> str:
    """The merge of the epochs that are seen, each key's row from its own one."""
    sql = d_merged()
    rest = sql[sql.index(", winners AS (") :]
    fields = ", ".join(f"arg_max({f}, CASE WHEN (batch = 0) = (e = 0) THEN seq END) AS {f}" for f in C.FIELDS)
    return f"{_epochs()}, winners AS (SELECT cache_key, {fields}, min(seq) AS s, count(*) AS n FROM epochs JOIN fixed USING (cache_key) WHERE {seen} GROUP BY cache_key{rest[rest.index('), cleanup AS (') :]}"


ORACLE_SQL: dict[str, str] = {
    "write_leads_csv": f"""WITH {d_conformed()}, lines AS (SELECT {_CELL.format(x='name')} || ';' || {_CELL.format(x='phone')} || ';' || {_CELL.format(x="('\"' || district || '\"; ' || notes)")} || ';' AS line FROM conformed)
SELECT line, count(*) AS n FROM lines GROUP BY line UNION ALL SELECT 'Nome;Telefone;Observacoes;Sem valor', 1""",
    "read_leads_csv": f"WITH {RAW} SELECT row_no, {', '.join(f'{d_strip(f)} AS {f}' for f in C.FIELDS)} FROM raw_leads",
    "source_reports": f"""WITH {d_conformed()} SELECT 'completed' AS status, district || '/' || profile AS profile, count(*) FILTER (WHERE email <> '') AS "writtenRows", count(*) AS "foundRows",
  coalesce('sem site ' || arg_min(seq % 1000000000000, seq) FILTER (WHERE website = ''), '') AS blockers, true AS no_notes FROM conformed GROUP BY district, conformed.profile""",
    "read_requests": f"""WITH {_REQUESTS} SELECT run_id, coalesce(nullif(trim(lead_type), ''), 'leads') AS "leadType", coalesce(nullif(geography, ''), 'Portugal') AS geography, 'leads.csv' AS "outputName",
  'Nome;Pagina web;Redes sociais;Email;Telefone;Localidade;Distrito;Fontes consultadas;Observacoes' AS columns FROM requests""",
    "read_pages": "SELECT page_id, url, octet_length(encode(html))::BIGINT AS n_bytes FROM pages",
    "read_by_source": f"WITH {RAW} SELECT 'run ' || district AS run_id, profile, row_no, name FROM raw_leads",
    "latest_result": f"WITH {RAW} SELECT 10::INT AS version, row_no, name FROM raw_leads WHERE row_no % 10 = 0",
    "coalesce_aliases": f"WITH {RAW} SELECT row_no, CASE WHEN row_no % 2 = 0 AND {d_strip('name')} <> '' THEN {d_strip('name')} ELSE {d_strip("('x ' || name)")} END AS name, {', '.join(f'{d_strip(f)} AS {f}' for f in ('website', 'email', 'phone', 'locality', 'district'))}, '' AS socials, '' AS sources, '' AS notes FROM raw_leads",
    "conform_columns": f"WITH {RAW}, s AS (SELECT {', '.join(f'{d_strip(f)} AS {f}' for f in ('name', 'phone', 'email'))} FROM raw_leads) SELECT name, phone, '' AS fax, email, count(*) AS n FROM s GROUP BY ALL",
    "union_sources": f"WITH {RAW} SELECT profile, row_no, {_UNION} FROM raw_leads",
    "timed_validation": f"""WITH {_by_epoch('e = 0 AND batch < 2')}
SELECT (SELECT count(*) FROM epochs JOIN fixed USING (cache_key) WHERE e = 1 AND batch < 2) AS "pendingValidation", count(*) AS kept, (coalesce(sum(n), 0) - count(*))::BIGINT AS duplicates FROM merged""",
    "forced_validation": f"WITH {_by_epoch('true')} SELECT {D_OUT}, n FROM merged",
    "keyed_verdicts": f"WITH {d_candidates()}, runs AS (SELECT c.*, r.district AS run_id FROM cand c JOIN (SELECT {ORD} AS seq, district FROM raw_leads) r USING (seq)) SELECT run_id, cache_key, {', '.join(f'arg_max({f}, seq) AS {f}' for f in C.FIELDS)}, min(seq) % 1000000000000 AS row_no, count(*) AS n FROM runs GROUP BY run_id, cache_key",
    "stream_first_per_key": f"WITH {d_conformed()} SELECT DISTINCT run_id, profile, {d_key(False)} AS key FROM conformed JOIN (SELECT {ORD} AS seq, district AS run_id FROM raw_leads) r USING (seq)",
    "stream_first_in_order": f"WITH {d_conformed()} SELECT run_id, profile, {d_key(False)} AS key, min(seq % 1000000000000) AS row_no FROM conformed JOIN (SELECT {ORD} AS seq, district AS run_id FROM raw_leads) r USING (seq) GROUP BY ALL",
    "stateful_validation": f"WITH {d_merged()} SELECT {D_OUT}, n FROM merged",
    "stream_unchanged": f"WITH {d_merged()} SELECT 0::BIGINT AS version, {D_OUT}, n FROM merged",
}
