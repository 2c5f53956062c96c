"""Queries of extraction, frontier, directory, review, reports and streaming, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import predicates as P
from leadloom.functions import review as R
from leadloom.operators import consolidate as C
from leadloom.operators import directory as D
from leadloom.operators import extract as X
from leadloom.operators import frontier as N
from leadloom.operators import report as O
from leadloom.sources import io
from leadloom.sources.shared import fresh_folder
from leadloom.streaming.consolidate import merged_stream

from .consolidation import HTML, LEAD_TYPE, RAW, d_digits, html_pages, raw_leads, read, tables

Query = Callable[[SparkSession, str], DataFrame]


def derived(sql: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, *names)
        return spark.sql(sql)

    return load


# --- input tables derived from the star schema, in SQL for both engines ------

#: One request per supplier; a quarter asks for the whole country, a quarter for one place.
REQUESTS = """
SELECT concat('run', s_suppkey) AS run_id,
  CASE s_suppkey % 6 WHEN 0 THEN 'Barbearias' WHEN 1 THEN 'talhos' WHEN 2 THEN 'HACCP' WHEN 3 THEN 'cozinha regional' WHEN 4 THEN n_name ELSE '' END AS lead_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'Portugal' WHEN 1 THEN 'Bragança' WHEN 2 THEN '' ELSE n_name END AS geography
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
#: One result page per supplier: a redirect, a repeat in other case, an engine's own page and plain links.
RESULTS = """
SELECT concat('run', s_nationkey) AS run_id, 'web' AS profile, concat('q', s_suppkey % 3) AS query, CAST(s_suppkey % 3 AS INT) AS query_ord,
  CAST(s_suppkey AS INT) AS provider_ord,
  CASE s_suppkey % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' WHEN 2 THEN 'duckduckgo' WHEN 3 THEN 'yahoo' ELSE 'mojeek' END AS provider,
  CASE s_suppkey % 5
    WHEN 0 THEN concat('<a href="/url?q=https://loja', s_suppkey % 40, '.example.pt/a&sa=U">x</a><a href="/url?q=https%3A%2F%2Fb', s_suppkey % 7, '.example.pt%2Fp&x=1">y</a>')
    WHEN 1 THEN concat('<li class="b_algo"><h2><a href="https://loja', s_suppkey % 40, '.example.pt/A">x</a></h2></li><li class="b_algo"><h2> <a href="https://www.bing.com/search?q=1">y</a></h2></li>')
    WHEN 2 THEN concat('<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Floja', s_suppkey % 40, '.example.pt%2Fa">x</a>')
    WHEN 3 THEN concat('<a class="d ac-algo fz" href="https://loja', s_suppkey % 40, '.example.pt/y">x</a>')
    ELSE concat('<a class="z" href="https://www.mojeek.com/about">own</a><a href="https://loja', s_suppkey % 40, '.example.pt/m">x</a><a href="mailto:x@example.pt">m</a>') END AS html
FROM supplier
"""
#: City listing pages: a complete card, one without phone, one without a heading link.
LISTINGS = """
SELECT s_suppkey AS page_id, concat('https://ondecortar.pt/cidades/', lower(replace(n_name, '_', '-')), '/') AS url,
  concat('<article class="card"><h3><a href="/salao/', s_suppkey, '">Barbearia &amp; Salão ', s_suppkey, '</a></h3><a href="tel:+35191', lpad(CAST(s_suppkey AS STRING), 7, '0'), '">t</a><strong>Morada:</strong> Rua ', s_suppkey, '</article>',
    '<article class="card"><h3><a href="/salao/x">Sem telefone</a></h3></article><article class="card"><h3>Sem ligação</h3><a href="tel:1">t</a></article>') AS html
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
#: A directory search per supplier; every fifth is for the same place and finds the same business.
SEARCHES = "SELECT s_suppkey AS s, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS n, CASE WHEN s_suppkey % 5 = 0 THEN 'LISBOA' ELSE n_name END AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
#: Result pages of each search: three pages, the last without a next link; every fourth search is empty on page 2.
DIRECTORY = f"""
SELECT concat('run', s) AS run_id, CAST(p.page AS INT) AS page, concat('https://www.pai.pt/searches?n=', s, '&page=', p.page) AS search_url,
  concat('<div class="results-title"><b>Encontrámos 1', s, ' resultados</b></div>',
    CASE WHEN s % 4 = 1 AND p.page = 2 THEN '' ELSE concat(
      '<div class="card card--result"><div class="card-metadata">Talho</div>sem ligação</div>',
      '<div class="card card--result x"><h6 class="card-title"><a href="/ms/', n, '-', p.page, '">Talho <b>', n_name, '</b> ', p.page % 2, '</a></h6><div class="card-metadata">Talhos e carnes</div><p class="card-description">Carne  fresca</p><div class="card-address">Rua A, ', n_name, '</div><button title="Copiar número: 21', n, '000">c</button></div>') END,
    CASE WHEN p.page < 3 THEN '<a rel="next" href="/n">next</a>' ELSE '' END) AS html
FROM ({SEARCHES}) CROSS JOIN (SELECT 1 AS page UNION ALL SELECT 2 UNION ALL SELECT 3) p
"""
#: Detail pages of each search; the shared business comes once for each search that found it.
DETAILS = f"""
SELECT concat('https://www.pai.pt/ms/', n, '-', p.page) AS detail_url,
  concat('<html><head><title>t</title><meta name="description" content="Talho em ', n_name, '">',
    CASE WHEN n % 3 = 0 THEN concat('<script type="application/ld+json">{{"@type":"LocalBusiness","telephone":"21000', lpad(CAST(n AS STRING), 4, '0'), '","address":{{"streetAddress":"Rua A","addressLocality":"L', n, '"}}}}</script>') ELSE '' END,
    '</head><body><h1>Talho ', n_name, ' ', p.page % 2, '</h1><a href="https://www.facebook.com/sharer/x">s</a><a href="https://www.facebook.com/t', n, '">f</a><a href="https://instagram.com/a">i</a>',
    '<a href="https://t', n, '.example.pt">Visitar <i>website</i></a>',
    CASE WHEN n % 2 = 0 THEN concat('<a href="mailto:t', n, '@example.pt">m</a>') ELSE '' END,
    '<div class="info-directions">Rua A, ', n_name, ' , Portugal</div></body></html>') AS html
FROM ({SEARCHES}) CROSS JOIN (SELECT 1 AS page UNION ALL SELECT 3) p
"""
ANSWERS = """
SELECT c_custkey AS id, CASE c_custkey % 6
  WHEN 0 THEN concat('{"item":{"type":"agent_message","text":"{\\\\"approved\\\\":true,\\\\"reason\\\\":\\\\"ok ', c_custkey, '\\\\"}"}}')
  WHEN 1 THEN '```json\n{"approved":false,"issues":["a"]}\n```'
  WHEN 2 THEN concat('Veja: {"approved":true,"normalized":{"Nome":"N', c_custkey, '"}} fim')
  WHEN 3 THEN 'nada' WHEN 4 THEN '' ELSE '{"approved":false,"reason":" "}' END AS stdout
FROM customer
"""
LOGS = """
SELECT event_id, CASE event_id % 7
  WHEN 0 THEN '{"type":"turn.started"}' WHEN 1 THEN concat('{"type":"item.completed","item":{"type":"web_search","query":"q', user_id, '"}}')
  WHEN 2 THEN '' WHEN 3 THEN concat('Reading prompt from stdin ', user_id) WHEN 4 THEN '{"type":"error","message":"falhou"}'
  WHEN 5 THEN concat('{"type":"item.completed","item":{"type":"agent_message","text":"olá  mundo ', user_id, '"}}') ELSE concat('{broken ', user_id) END AS line
FROM events
"""

requests_table = derived(REQUESTS, "supplier", "nation")
results_table = derived(RESULTS, "supplier")
listings_table = derived(LISTINGS, "supplier", "nation")
directory_table = derived(DIRECTORY, "supplier", "nation")
details_table = derived(DETAILS, "supplier", "nation")
answers_table = derived(ANSWERS, "customer")
logs_table = derived(LOGS, "events")

# --- queries -----------------------------------------------------------------


def joined(c):
    return F.array_join(c, " | ")


def q_extract_emails(spark, sf):
    return html_pages(spark, sf).select("page_id", joined(X.emails(F.col("html"))).alias("emails"))


def q_page_emails(spark, sf):
    return read(spark, sf, "pages").select("page_id", joined(X.emails(F.col("html"))).alias("emails"))


def q_extract_phones(spark, sf):
    return html_pages(spark, sf).select("page_id", joined(X.phones(F.col("html"))).alias("phones"))


def q_page_phones(spark, sf):
    return read(spark, sf, "pages").select("page_id", joined(X.phones(F.col("html"))).alias("phones"))


def q_extract_social_links(spark, sf):
    return html_pages(spark, sf).select("page_id", joined(X.social_links(F.col("html"))).alias("socials"))


def q_extract_meta(spark, sf):
    return html_pages(spark, sf).select("page_id", *[c.alias(k) for k, c in X.meta_columns(F.col("html")).items()])


def q_extract_json_ld(spark, sf):
    ld = html_pages(spark, sf).select("page_id", X.business(X.json_ld_objects(F.col("html"))).alias("v"))
    v = F.col("v")
    return ld.where("v is not null").select("page_id", X.variant_text(v, "$.name").alias("name"), X.variant_text(v, "$.telephone").alias("phone"), X.variant_text(v, "$.address.addressLocality").alias("locality"))


def q_extract_leads(spark, sf):
    return X.extract_leads(html_pages(spark, sf), "Portugal", "maps").select("page_id", *C.FIELDS)


def q_extract_listing_cards(spark, sf):
    return X.extract_listing_cards(listings_table(spark, sf), "", "directories").select("page_id", "card", *C.FIELDS)


def q_extract_rows(spark, sf):
    both = listings_table(spark, sf).unionByName(html_pages(spark, sf).withColumn("page_id", F.col("page_id") + 1_000_000_000))
    return X.extract_rows(both, "", "free", key="page_id").select("page_id", "card", "name", "phone", "locality")


def q_build_queries(spark, sf):
    return N.build_queries(requests_table(spark, sf))


def q_seed_urls(spark, sf):
    return N.direct_seed_urls(requests_table(spark, sf))


def q_provider_urls(spark, sf):
    queries = N.build_queries(requests_table(spark, sf))
    return N.provider_search_urls(queries).select("run_id", "profile", "query_ord", "provider_ord", "provider", "search_url")


def q_serp_urls(spark, sf):
    found = N.result_urls(results_table(spark, sf))
    return found.select("run_id", "query", "position.provider_ord", "position.place", "url")


def q_frontier_topk(spark, sf):
    return N.frontier_topk(N.result_urls(results_table(spark, sf))).select("run_id", "query", "rank", "url")


def q_frontier_first_seen(spark, sf):
    return N.frontier_first_seen(N.frontier_topk(N.result_urls(results_table(spark, sf)))).select("run_id", "url", "query_ord", "rank")


def q_queries_without_results(spark, sf):
    results = results_table(spark, sf)
    queries = results.select("run_id", "profile", "query").distinct().unionByName(results.select("run_id", "profile", F.lit("q9").alias("query")).distinct())
    return N.queries_without_results(queries, N.result_urls(results)).select("run_id", "query", "blocker")


def q_unvisited_urls(spark, sf):
    top = N.frontier_first_seen(N.frontier_topk(N.result_urls(results_table(spark, sf))))
    return N.unvisited(top, top.where("query_ord = 0")).select("run_id", "url")


def q_fetch_blockers(spark, sf):
    pages = html_pages(spark, sf).select(F.regexp_replace(F.regexp_replace("url", "www[.]", ""), "/$", "/a").alias("url"), "html")
    _, missing = N.fetch(N.frontier_first_seen(N.frontier_topk(N.result_urls(results_table(spark, sf)))), pages)
    return missing.select("run_id", "blocker")


def q_fetch_bucketed(spark, sf):
    """Fetched pages of the frontier from a table in buckets by address."""
    pages = html_pages(spark, sf).select(F.regexp_replace(F.regexp_replace("url", "www[.]", ""), "/$", "/a").alias("url"), "html")
    path = fresh_folder(spark, "pages")
    table = "pages_" + path.rsplit("-", 1)[1]
    io.write_pages(pages, table, path, buckets=8)
    found, _ = N.fetch(N.frontier_first_seen(N.frontier_topk(N.result_urls(results_table(spark, sf)))), spark.table(table))
    return found.select("run_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


def q_directory_urls(spark, sf):
    asked = requests_table(spark, sf).select("run_id", F.col("lead_type").alias("query"), F.col("geography").alias("place"))
    return D.directory_search_urls(asked).select("run_id", "page", "search_url")


def directory_pages(spark, sf):
    return D.pages_read(D.result_pages(directory_table(spark, sf)), ["run_id"])


def q_page_stop(spark, sf):
    return directory_pages(spark, sf).select("run_id", "page", "has_next", "n_cards", "total_results")


def q_first_total(spark, sf):
    return O.first_total(directory_pages(spark, sf), ["run_id"])


def q_directory_cards(spark, sf):
    return D.directory_cards(directory_pages(spark, sf)).drop("page")


def directory_joined(spark, sf):
    return D.directory_rows(D.directory_cards(directory_pages(spark, sf)), D.directory_details(details_table(spark, sf)))


def q_directory_details(spark, sf):
    return D.directory_details(details_table(spark, sf))


def q_directory_leads(spark, sf):
    rows, _ = directory_joined(spark, sf)
    return D.directory_leads(rows, F.lit("talhos"), F.lit("Portugal")).select("run_id", "key", *C.FIELDS)


def q_directory_blockers(spark, sf):
    return directory_joined(spark, sf)[1]


def q_parse_reviews(spark, sf):
    v = R.to_verdict(R.review_payload(R.review_text(F.col("stdout"))))
    told = answers_table(spark, sf).select("id", v.alias("v"))
    return told.select("id", "v.approved", "v.reason", F.array_join("v.issues", ",").alias("issues"), F.coalesce(F.col("v.normalized")["Nome"], F.lit("")).alias("name"))


def q_log_messages(spark, sf):
    return logs_table(spark, sf).select("event_id", R.humanize(R.describe_event(F.col("line"))).alias("message"))


def q_review_prompts(spark, sf):
    prompt = R.review_prompt(F.lit("barbearia"), F.col("district"), F.col("profile"), F.struct("name"))
    return raw_leads(spark, sf).select("row_no", prompt.alias("prompt"))


#: Error texts of fetches, from the event, for both engines.
ERRORS = """CASE event_id % 6 WHEN 0 THEN concat('http 429: ', event_type) WHEN 1 THEN 'HTTP 403' WHEN 2 THEN concat('HTTP 500 after HTTP 403 of ', event_type) WHEN 3 THEN concat('timeout ', CAST(user_id AS STRING))
  WHEN 4 THEN '' ELSE CAST(NULL AS STRING) END"""


def q_error_classes(spark, sf):
    errors = read(spark, sf, "events").select("event_id", F.expr(ERRORS).alias("error"))
    return errors.select("event_id", P.classify_error(F.col("error")).alias("message"), P.is_temporary_block(F.col("error")).alias("temporary"))


def q_last_events(spark, sf):
    events = read(spark, sf, "events").withColumn("run_id", F.col("user_id"))
    return O.last_events(events).select("run_id", "event_id", "rank")


def q_progress_changes(spark, sf):
    ticks = read(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("tick"), "event_type")
    return O.progress_changes(ticks, ["event_type"])


def counted(spark, sf):
    leads = C.conform(raw_leads(spark, sf)).withColumn("run_id", F.col("district"))
    fits = P.matches_type_at_source(F.lit(LEAD_TYPE))
    return leads.withColumns({"written": fits, "note": F.when(~fits, F.concat(F.lit("Ignorado por categoria: "), F.col("name"))), "blocker": F.when(F.col("website") == "", F.concat(F.lit("sem site "), F.col("row_no").cast("string")))})


def q_source_counters(spark, sf):
    return O.source_counters(counted(spark, sf)).drop("n_blockers")


def q_run_status(spark, sf):
    leads = raw_leads(spark, sf).withColumn("run_id", F.col("district"))
    sources = leads.groupBy("run_id", "profile").agg((F.count(F.lit(1)) % 3).alias("exit_code"), (F.max("row_no") % 7 > 0).alias("has_output"))
    stats = leads.groupBy("run_id").agg((F.count(F.lit(1)) % 4).alias("kept"))
    return O.run_status(sources, stats)


def q_first_per_key(spark, sf):
    keyed = C.conform(raw_leads(spark, sf)).withColumns({"key": C.merge_key(check_listing=False), "run_id": F.lit("run")})
    return N.first_per_key(keyed.select("run_id", "profile", "key", "row_no", "name", "seq"), ["run_id", "profile"], "key", "seq").select("profile", "key", "row_no", "name")


def q_stream_consolidate(spark, sf):
    """The stream's result after all files: raw leads dealt evenly to part files, half of them per trigger."""
    base = fresh_folder(spark, "stream")
    leads = raw_leads(spark, sf).drop("seq")
    files = max(4, read(spark, sf, "customer").rdd.getNumPartitions())
    leads.repartition(files).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(leads.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{base}/in")
    merged = merged_stream(stream.withColumn("seq", F.struct("profile_rank", "row_no")), LEAD_TYPE, "Portugal")

    def save(df: DataFrame, batch: int) -> None:
        C.merged_rows(df).select("merge_key", *C.FIELDS, "n").write.mode("overwrite").parquet(f"{base}/out")

    query = merged.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES: dict[str, Query] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

# --- SQL ---------------------------------------------------------------------


def _duck(sql: str) -> str:
    return sql.replace(" STRING)", " VARCHAR)")


def _ordered(x: str) -> str:
    return f"array_to_string(list_filter({x}, lambda y, i: list_position({x}, y) = i), ' | ')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''").replace('\\"', '"')


_EMAILS = f"list_concat(regexp_extract_all(html, '{_q(X.EMAIL)}'), list_transform(regexp_extract_all(html, '{_q(X.MAILTO)}', 1), lambda m: url_decode(replace(m, '+', ' '))))"
_NUMBERS = f"list_filter(list_transform(regexp_extract_all(html, '{_q(X.PHONE)}'), lambda m: trim(m)), lambda m: length({d_digits('m')}) >= 7)"
_PHONES = f"list_concat(list_transform(regexp_extract_all(html, '{_q(X.TEL)}', 1), lambda m: url_decode(replace(m, '+', ' '))), {_NUMBERS})"
_META = """regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1) AS description,
  regexp_extract(html, '(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1) AS canonical, '' AS og_title"""
_LD = """regexp_extract(html, '(?is)<script[^>]+type="application/ld[+]json"[^>]*>(.*?)</script>', 1)"""
_LEADS = f"""WITH {HTML}, m AS (
  SELECT page_id, url, {_META}, CASE WHEN {_LD} <> '' THEN {_LD} END::JSON AS ld,
    {_ordered("list_filter(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1), lambda h: regexp_matches(h, 'facebook[.]com'))")} AS socials, {_EMAILS} AS e, {_PHONES} AS p FROM html_pages)"""
_LIST = f"listings AS ({_duck(LISTINGS)})"
_RES = f"results AS ({_duck(RESULTS)})"
_LINKS = f"""{_RES}, raw AS (
  SELECT run_id, query, query_ord, provider_ord, u.* FROM results, LATERAL (SELECT unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS place FROM (SELECT CASE provider
    WHEN 'google' THEN list_transform(regexp_extract_all(html, 'href="/url[?]q=([^"&]+)[^"]*"', 1), lambda x: url_decode(x))
    WHEN 'bing' THEN regexp_extract_all(html, '(?is)<li class="b_algo".*?<h2>\\s*<a href="([^"]+)"', 1)
    WHEN 'duckduckgo' THEN list_transform(regexp_extract_all(html, 'uddg=([^&"]+)', 1), lambda x: url_decode(x))
    WHEN 'yahoo' THEN regexp_extract_all(html, 'href="([^"]+)"', 1)
    ELSE list_filter(regexp_extract_all(html, '(?i)<a[^>]+href="(https?://[^"]+)"', 1), lambda x: NOT contains(x, 'mojeek')) END AS l)) u
), links AS (SELECT run_id, query, query_ord, provider_ord, place, raw AS url FROM raw WHERE NOT contains(raw, 'bing.com/search')),
once AS (SELECT run_id, query, query_ord, lower(url) AS low, min(provider_ord * 1000 + place) AS pos, arg_min(url, provider_ord * 1000 + place) AS url FROM links GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY pos) AS rank FROM once QUALIFY rank <= 18),
seen AS (SELECT run_id, url, min(query_ord * 1000 + rank) AS s FROM top GROUP BY ALL)"""
_LINKS = _LINKS.replace("query_ord, lower(url) AS low, min(provider_ord * 1000 + place) AS pos, arg_min(url, provider_ord * 1000 + place) AS url FROM links GROUP BY ALL", "query_ord, lower(url) AS low, min(provider_ord * 1000 + place) AS pos, arg_min(url, provider_ord * 1000 + place) AS url FROM links GROUP BY run_id, query, query_ord, lower(url)")
_REQ = f"requests AS ({REQUESTS})"
_ENC = "replace(replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '+', '%20')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_VARIANTS = "CASE " + " ".join(f"WHEN regexp_matches(lower(kind), '{p}') THEN {_list(v)}" for p, v in N.VARIANTS) + " ELSE [kind] END"
_WIDE = "lower(place) IN ('portugal', 'portugal continental', 'pt', 'pt-pt')"
_TERMS = f"CASE WHEN NOT {_WIDE} THEN [place] WHEN st IN ('directories', 'free') THEN list_concat([place], {_list(N.DISTRICTS)}) WHEN st = 'maps' THEN list_concat([place], {_list(N.MAP_PLACES)}) WHEN st = 'social' THEN list_concat([place], {_list(N.SOCIAL_PLACES)}) ELSE list_concat([place], {_list(N.OTHER_PLACES)}) END"
_ENDINGS = "['', ' telefone email', ' website']"
_QUERIES = f"""{_REQ}, profiles AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{s}')" for p, s in N.PROFILES)}) t(profile, st)),
asked AS (SELECT run_id, profile, st, CASE WHEN lead_type = '' THEN 'leads' ELSE lead_type END AS kind, CASE WHEN geography = '' THEN 'Portugal' ELSE geography END AS place FROM requests CROSS JOIN profiles),
lists AS (SELECT *, {_VARIANTS} AS vs, {_TERMS} AS ts FROM asked),
named AS (
  SELECT run_id, profile, st, iv * 1000000 + it * 1000 + ie AS o, CASE WHEN it = 0 THEN v ELSE v || ' ' || ts[it] END || e AS query
  FROM (SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) AS iv FROM lists) a, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS it) b, LATERAL (SELECT unnest({_ENDINGS}) AS e, generate_subscripts({_ENDINGS}, 1) AS ie) c
  WHERE it > 0 OR ({_WIDE} AND st IN ('directories', 'free'))
  UNION ALL
  SELECT run_id, profile, st, 1000000000 + iv * 1000 + isite, CASE WHEN st = 'free' THEN v || ' ' || place || ' ' || site ELSE 'site:' || site || ' ' || v || ' ' || place END
  FROM (SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) AS iv, CASE st WHEN 'social' THEN {_list(N.SITES['social'])} WHEN 'maps' THEN {_list(N.SITES['maps'])} WHEN 'directories' THEN {_list(N.SITES['directories'])} WHEN 'free' THEN {_list(N.FREE_ENDINGS)} ELSE [] END AS sites FROM lists) a,
    LATERAL (SELECT unnest(sites) AS site, generate_subscripts(sites, 1) AS isite) b
), queries AS (SELECT run_id, profile, st AS source_type, query, row_number() OVER (PARTITION BY run_id, profile ORDER BY o)::INT AS query_ord FROM (SELECT run_id, profile, st, query, min(o) AS o FROM named GROUP BY ALL))"""
_SLUG = "trim(regexp_replace(strip_accents(lower(geography)), '[^a-z0-9]+', '-', 'g'), '-')"
_PAI = "https://www.pai.pt/searches?search%5Bquery%5D="
_IN = "&search%5Blocation%5D="
_PROVIDER_LIST = f"CASE source_type WHEN 'maps' THEN {_list(N.PROVIDERS['maps'])} WHEN 'social' THEN {_list(N.PROVIDERS['social'])} WHEN 'directories' THEN {_list(N.PROVIDERS['directories'])} ELSE {_list(N.BROAD_PROVIDERS)} END"
_PROVIDER_URL = "CASE provider " + " ".join(f"WHEN '{k}' THEN '{t.split('{}')[0]}' || {_ENC.format(x='query')} || '{t.split('{}')[1]}'" for k, t in N.PROVIDER_URLS.items()) + " END"
_FORM_SQL = " || '&' || ".join("replace(url_encode('{k}'), '%20', '+') || '=' || ".format(k=k) + (f"replace(url_encode({v}), '%20', '+')" if v in ("query", "place") else f"replace(url_encode('{v}'), '%20', '+')") for k, v in D.SEARCH_PARAMETERS)
# pages of a search: 1..3, those of s % 4 = 1 end with their empty page 2
_CARDS = f"SELECT s, n, n_name, p.page FROM ({SEARCHES}) CROSS JOIN (SELECT unnest([1, 2, 3]) AS page) p WHERE NOT (s % 4 = 1 AND page >= 2)"
_FOUND = f"SELECT * FROM ({_CARDS}) WHERE page <> 2"
_DETAIL = """SELECT 'https://www.pai.pt/ms/' || n || '-' || page AS detail_url, n, page, 'Talho ' || n_name || ' ' || page % 2 AS name, 'https://t' || n || '.example.pt' AS website,
  'https://instagram.com/a | https://www.facebook.com/t' || n AS socials, CASE WHEN n % 2 = 0 THEN 't' || n || '@example.pt' ELSE '' END AS email, CASE WHEN n % 3 = 0 THEN '21000' || lpad(n::VARCHAR, 4, '0') ELSE '' END AS phone,
  CASE WHEN n % 3 = 0 THEN 'L' || n ELSE n_name END AS locality, CASE WHEN n % 3 = 0 THEN 'Rua A L' || n ELSE n_name END AS district, 'Meta descrição confirmada. | Deteção via Páginas Amarelas.' AS notes"""
_ANSWERED = f"answers AS ({ANSWERS.replace(chr(92) * 2, chr(92)).replace(chr(92) + 'n', chr(10))})"

ORACLE_SQL: dict[str, str] = {
    "extract_emails": f"WITH {HTML} SELECT page_id, {_ordered(_EMAILS)} AS emails FROM html_pages",
    "page_emails": f"SELECT page_id, {_ordered(_EMAILS)} AS emails FROM pages",
    "extract_phones": f"WITH {HTML} SELECT page_id, {_ordered(_PHONES)} AS phones FROM html_pages",
    "page_phones": f"SELECT page_id, {_ordered(_PHONES)} AS phones FROM pages",
    "extract_social_links": f"{_LEADS} SELECT page_id, socials FROM m",
    "extract_meta": f"WITH {HTML} SELECT page_id, {_META} FROM html_pages",
    "extract_json_ld": f"{_LEADS} SELECT page_id, ld->>'$.name' AS name, ld->>'$.telephone' AS phone, ld->>'$.address.addressLocality' AS locality FROM m WHERE ld IS NOT NULL",
    "extract_leads": f"""{_LEADS} SELECT page_id, coalesce(ld->>'$.name', title) AS name, coalesce(nullif(canonical, ''), url) AS website, socials, coalesce(e[1], '') AS email, coalesce(p[1], ld->>'$.telephone', '') AS phone,
  coalesce(ld->>'$.address.addressLocality', 'Portugal') AS locality, coalesce(ld->>'$.address.addressRegion', '') AS district, concat_ws(' | ', url, nullif(canonical, ''), nullif(description, '')) AS sources,
  concat_ws(' | ', 'Fonte Maps', CASE WHEN description <> '' THEN '{X.META_NOTE}' END, CASE WHEN socials <> '' THEN '{X.SOCIAL_NOTE}' END) AS notes FROM m""",
    "extract_listing_cards": f"""WITH {_LIST} SELECT page_id, 0::INT AS card, 'Barbearia & Salão ' || page_id AS name, 'https://ondecortar.pt/salao/' || page_id AS website, '' AS socials, '' AS email, '+35191' || lpad(page_id::VARCHAR, 7, '0') AS phone,
  replace(split_part(url, '/', 5), '-', ' ') AS locality, replace(split_part(url, '/', 5), '-', ' ') AS district, url AS sources, 'Fonte diretórios | {X.CARD_NOTE} | Morada: Rua ' || page_id AS notes FROM listings""",
    "extract_rows": f"""{_LEADS}, {_LIST} SELECT page_id, 0::INT AS card, 'Barbearia & Salão ' || page_id AS name, '+35191' || lpad(page_id::VARCHAR, 7, '0') AS phone, replace(split_part(url, '/', 5), '-', ' ') AS locality FROM listings
UNION ALL SELECT page_id + 1000000000, 0, coalesce(ld->>'$.name', title), coalesce(p[1], ld->>'$.telephone', ''), coalesce(ld->>'$.address.addressLocality', '') FROM m""",
    "build_queries": f"WITH {_QUERIES} SELECT run_id, profile, source_type, query, query_ord FROM queries",
    "seed_urls": f"""WITH {_REQ}, s AS (SELECT run_id, list_concat(
  CASE WHEN {_SLUG} <> '' AND regexp_matches(lower(lead_type), 'barbear|barber') THEN ['https://ondecortar.pt/cidades/' || {_SLUG} || '/', 'https://www.fresha.com/lp/pt/bt/barbershops/in/pt-' || {_SLUG}, 'https://www.fresha.com/lp/en/bt/barbershops/in/pt-' || {_SLUG}, 'https://booksy.com/pt-pt/s/barbearia/' || {_ENC.format(x='geography')}, 'https://www.agendoor.com/pt/explore/portugal/' || {_SLUG}] ELSE [] END,
  CASE WHEN NOT regexp_matches(lower(lead_type), 'talh|carn') THEN [] ELSE ['{_PAI}talhos{_IN}' || {_ENC.format(x="coalesce(nullif(geography, ''), 'Portugal')")}, '{_PAI}talho{_IN}' || {_ENC.format(x="coalesce(nullif(geography, ''), 'Portugal')")}] END,
  CASE WHEN regexp_matches(lower(lead_type), 'talh|carn') AND geography = 'Portugal' THEN list_transform({_list(N.DISTRICTS)}, lambda d: '{_PAI}talhos{_IN}' || {_ENC.format(x='d')}) ELSE [] END) AS l FROM requests)
SELECT run_id, unnest(l) AS url, (generate_subscripts(l, 1) - 1)::INT AS position FROM s""",
    "provider_urls": f"WITH {_QUERIES}, l AS (SELECT *, {_PROVIDER_LIST} AS ps FROM queries), u AS (SELECT run_id, profile, query, query_ord, unnest(ps) AS provider, (generate_subscripts(ps, 1) - 1)::INT AS provider_ord FROM l) SELECT run_id, profile, query_ord, provider_ord, provider, {_PROVIDER_URL} AS search_url FROM u",
    "serp_urls": f"WITH {_LINKS} SELECT run_id, query, provider_ord, place::INT AS place, url FROM links",
    "frontier_topk": f"WITH {_LINKS} SELECT run_id, query, rank::INT AS rank, url FROM top",
    "frontier_first_seen": f"WITH {_LINKS} SELECT run_id, url, (s // 1000)::INT AS query_ord, (s % 1000)::INT AS rank FROM seen",
    "queries_without_results": "WITH r AS (SELECT DISTINCT concat('run', s_nationkey) AS run_id FROM supplier) SELECT run_id, 'q9' AS query, 'Sem resultados para \"q9\"' AS blocker FROM r",
    "unvisited_urls": f"WITH {_LINKS} SELECT run_id, url FROM seen WHERE s // 1000 <> 0",
    "fetch_blockers": f"WITH {_LINKS}, have AS (SELECT 'https://loja' || s_suppkey || '.example.pt/a' AS url FROM supplier) SELECT run_id, url || ' -> Failed to fetch' AS blocker FROM seen ANTI JOIN have USING (url)",
    "fetch_bucketed": f"WITH {_LINKS}, {HTML} SELECT run_id, seen.url, octet_length(encode(html))::BIGINT AS n_bytes FROM seen JOIN html_pages p ON seen.url = regexp_replace(replace(p.url, 'www.', ''), '/$', '/a')",
    "directory_urls": f"WITH {_REQ}, a AS (SELECT run_id, lead_type AS query, geography AS place, unnest([1, 2, 3, 4, 5])::INT AS page FROM requests) SELECT run_id, page, 'https://www.pai.pt/searches?' || {_FORM_SQL} || CASE WHEN page <> 1 THEN '&page=' || page ELSE '' END AS search_url FROM a",
    "page_stop": "SELECT 'run' || s_suppkey AS run_id, page::INT AS page, page < 3 AS has_next, CASE WHEN s_suppkey % 4 = 1 AND page = 2 THEN 0 ELSE 1 END::BIGINT AS n_cards, ('1' || s_suppkey)::BIGINT AS total_results FROM supplier CROSS JOIN (SELECT unnest([1, 2, 3]) AS page) p WHERE NOT (s_suppkey % 4 = 1 AND page = 3)",
    "first_total": "SELECT 'run' || s_suppkey AS run_id, ('1' || s_suppkey)::BIGINT AS total_results, CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE 3 END::BIGINT AS n_cards FROM supplier",
    "directory_cards": f"SELECT 'run' || s AS run_id, 'https://www.pai.pt/searches?n=' || s || '&page=' || page AS search_url, page::INT AS search_page, 2::INT AS search_rank, 'Talho ' || n_name || ' ' || page % 2 AS search_title, 'Talhos e carnes' AS search_category, 'Carne fresca' AS search_description, 'Rua A, ' || n_name AS search_address, '21' || n || '000' AS search_phone, 'https://www.pai.pt/ms/' || n || '-' || page AS detail_url FROM ({_CARDS})",
    "directory_details": f"SELECT detail_url, name, website, socials, email, phone, locality, district, notes FROM ({_DETAIL} FROM (SELECT DISTINCT n, n_name, unnest([1, 3]) AS page FROM ({SEARCHES})))",
    "directory_leads": f"""WITH d AS ({_DETAIL}, 'run' || s AS run_id, s FROM ({_FOUND})), k AS (SELECT *, CASE WHEN email <> '' THEN 'email:' || email WHEN phone <> '' THEN 'phone:' || phone ELSE 'website:' || website || '|' || lower(name) END AS key FROM d)
SELECT run_id, key, name, website, socials, email, phone, locality, district, 'https://www.pai.pt/searches?n=' || s || '&page=' || page || ' | ' || detail_url AS sources, notes FROM k QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY page) = 1""",
    "directory_blockers": f"SELECT 'run' || s AS run_id, 'https://www.pai.pt/ms/' || n || '-' || page || ' -> missing' AS blocker FROM ({_CARDS}) WHERE page = 2",
    "parse_reviews": f"""SELECT c_custkey AS id, c_custkey % 6 <> 5 AS approved, CASE c_custkey % 6 WHEN 0 THEN 'ok ' || c_custkey WHEN 2 THEN '{R.APPROVED}' WHEN 5 THEN '{R.REJECTED}' ELSE '{R.INCONCLUSIVE}' END AS reason,
  '' AS issues, CASE WHEN c_custkey % 6 = 2 THEN 'N' || c_custkey ELSE '' END AS name FROM customer""",
    "log_messages": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Codex a pensar' WHEN 1 THEN 'Pesquisa concluída: q' || user_id WHEN 3 THEN 'A receber o briefing' WHEN 4 THEN 'falhou' WHEN 5 THEN 'olá mundo ' || user_id WHEN 6 THEN '{broken ' || user_id END AS message FROM events",
    "review_prompts": f"""WITH {RAW} SELECT row_no, concat_ws(chr(10), '{R.PROMPT_HEAD}', '{R.PROMPT_SHAPE}', 'Requested business type: barbearia', 'Requested geography: ' || district, 'Source context: ' || profile, '{R.PROMPT_RULE.replace("'", "''")}', 'Lead JSON:', '{{', '  "name" : "' || name || '"', '}}') AS prompt FROM raw_leads""",
    "error_classes": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'motor bloqueou temporariamente (429)' WHEN 1 THEN 'motor sem acesso publico (403)' WHEN 2 THEN 'motor sem acesso publico (403)' WHEN 3 THEN 'timeout ' || user_id ELSE '' END AS message, event_id % 6 = 0 AS temporary FROM events",
    "last_events": "SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= 30",
    "progress_changes": "SELECT user_id AS run_id, event_id AS tick, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type",
    "run_status": f"""WITH {RAW}, s AS (SELECT district AS run_id, profile, count(*) % 3 AS code, max(row_no) % 7 > 0 AS o FROM raw_leads GROUP BY ALL), k AS (SELECT district AS run_id, count(*) % 4 AS kept FROM raw_leads GROUP BY ALL),
r AS (SELECT run_id, bool_or(o) AS o, bool_and(code = 0 AND o) AS whole FROM s GROUP BY run_id)
SELECT run_id, CASE WHEN NOT o OR kept <= 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o AND kept > 0 AND NOT whole THEN '{O.RUN_WARNING}' END AS warning, CASE WHEN NOT o THEN '{O.NO_OUTPUT}' WHEN kept <= 0 THEN '{O.NOTHING_KEPT}' END AS error FROM r JOIN k USING (run_id)""",
}


def _more() -> None:
    from .consolidation import ORACLE_SQL as SQL
    from .consolidation import d_conformed, d_hay, d_key, d_norm, d_words

    hay = d_norm(d_hay("name", "website", "socials", "notes", "sources"))
    fits = f"({d_words(hay, P.BARBER_WORDS)} AND NOT {d_words(hay, P.HAIR_WORDS_SOURCE)})"
    ORACLE_SQL["source_counters"] = f"WITH {d_conformed()} SELECT district AS run_id, profile, count(*) AS \"foundRows\", count(*) FILTER (WHERE {fits}) AS \"writtenRows\", count(*) FILTER (WHERE NOT {fits}) AS n_notes, arg_min('sem site ' || seq % 1000000000000, seq) FILTER (WHERE website = '') AS first_blocker FROM conformed GROUP BY district, profile"
    ORACLE_SQL["first_per_key"] = f"WITH {d_conformed()}, k AS (SELECT *, ({d_key(False)}) AS key FROM conformed) SELECT profile, key, seq % 1000000000000 AS row_no, name FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY profile, key ORDER BY seq) = 1"
    ORACLE_SQL["stream_consolidate"] = SQL["merge_leads_row_scope"]


_more()
