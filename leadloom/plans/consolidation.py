"""Queries of functions, predicates and consolidation, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import predicates as P
from leadloom.functions import text as T
from leadloom.functions.urls import is_blocked_url, normalize_domain, normalize_platform_name
from leadloom.operators import consolidate as C

from .fixtures import HTML_PAGES, RAW_LEADS

Query = Callable[[SparkSession, str], DataFrame]
LEAD_TYPE = "barbearia"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source outputs before consolidation, with their order."""
    tables(spark, sf_dir, "customer", "nation", "region")
    return spark.sql(RAW_LEADS).withColumn("seq", F.struct("profile_rank", "row_no"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "supplier", "nation")
    return spark.sql(HTML_PAGES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces for DuckDB -------------------------------------------------


def d_strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\s\x0B\x{{00A0}}]+|[\s\x0B\x{{00A0}}]+$', '', 'g')"


def d_norm(x: str) -> str:
    return rf"regexp_replace(lower({d_strip(x)}), '[\s\x0B\x{{00A0}}]+', ' ', 'g')"


def d_fold(x: str) -> str:
    return f"strip_accents({d_norm(x)})"


def d_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def d_url(x: str) -> str:
    t = f"lower({d_strip(x)})"
    return f"CASE WHEN starts_with({t}, 'http') THEN {t} ELSE 'https://' || {t} END"


def d_host(x: str) -> str:
    """Of a lower-case URL; empty if it can't be parsed."""
    host = rf"regexp_extract({x}, '^https?:[/\\]*(?:[^/?#\\@]*@)?([^/?#\\:@]*)(?::\d*)?(?:[/?#\\]|$)', 1)"
    return rf"CASE WHEN regexp_matches({host}, '[\s%<>\[\]^|]') THEN '' ELSE {host} END"


def d_path(x: str) -> str:
    return rf"coalesce(nullif(regexp_extract({x}, '^https?:[/\\]*[^/?#\\]*([^?#]*)', 1), ''), '/')"


def d_domain(x: str) -> str:
    t, host = f"lower({d_strip(x)})", d_host(f"({d_url(x)})")
    rough = rf"regexp_replace(regexp_replace({t}, '^https?://', ''), '^www\.', '')"
    return rf"CASE WHEN {t} = '' THEN '' WHEN ({host}) <> '' THEN regexp_replace({host}, '^www\.', '') ELSE regexp_extract({rough}, '^[^/?#]*') END"


def d_rules(x: str, rules: list[tuple[str, str]], rough: str) -> str:
    u = f"({d_url(x)})"
    host, path = rf"regexp_replace({d_host(u)}, '^www\.', '')", d_path(u)
    hits = [f"(contains({host}, '{h}')" + (f" AND regexp_matches({path}, '{p}'))" if p else ")") for h, p in rules]
    return f"CASE WHEN lower({d_strip(x)}) = '' THEN false WHEN ({d_host(u)}) <> '' THEN {' OR '.join(hits)} ELSE regexp_matches(lower({d_strip(x)}), '{rough}') END"


def d_listing(x: str) -> str:
    return d_rules(x, P.LISTING_RULES, P.LISTING_ROUGH)


def d_email_ok(x: str) -> str:
    e = f"lower({d_strip(x)})"
    return rf"(regexp_matches({e}, '^[^\s@]+@[^\s@]+\.[^\s@]+$') AND NOT regexp_matches({e}, '(?:sentry\.io|booksy\.com|fresha\.com|example\.com)$'))"


def d_phone_ok(x: str) -> str:
    return f"(length({d_digits(x)}) BETWEEN 9 AND 15)"


def d_words(hay: str, words: list[str]) -> str:
    return rf"regexp_matches({hay}, '\b(?:{'|'.join(words)})\b')"


def d_hay(*fields: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"coalesce({f}, '')" for f in fields) + ")"


def d_type(lead_type: str) -> str:
    hay = d_norm(d_hay("name", "website", "socials", "notes"))
    r = d_norm(lead_type)
    # RE2's word border is ASCII
    return f"CASE WHEN {r} IN ('', 'leads') THEN true WHEN regexp_matches({r}, '{P.BARBER_REQUEST}') THEN {d_words(hay, P.BARBER_WORDS)} AND NOT {d_words(hay, P.HAIR_WORDS)} ELSE true END"


def d_place(place: str, *fields: str) -> str:
    return f"({d_fold(place)} IN ('', 'portugal') OR contains({d_fold(d_hay(*fields))}, {d_fold(place)}))"


def d_portal() -> str:
    return d_words(d_fold(d_hay("name", "website", "socials", "email", "notes", "sources")), ["yahoo", r"example@email\.com"])


def d_social(x: str) -> str:
    allowed = " OR ".join(f"contains(lower(y), '{d}')" for d in C.SOCIAL_DOMAINS)
    blocked = " OR ".join(f"contains(lower(y), '{d}')" for d in C.SOCIAL_BLOCKED)
    parts = f"list_filter(list_transform(string_split(coalesce({x}, ''), ' | '), lambda y: {d_strip('y')}), lambda y: y <> '' AND ({allowed}) AND NOT ({blocked}))"
    return f"array_to_string(list_filter({parts}, lambda y, i: list_position({parts}, y) = i), ' | ')"


def d_key(listing: bool = True) -> str:
    web = d_domain("website")
    if listing:
        web = f"CASE WHEN {d_listing('website')} THEN '' ELSE {web} END"
    soc, name = d_domain("socials"), d_norm("name")
    full = ", ".join(f"nullif({d_norm(f)}, '')" for f in ("name", "locality", "district"))
    return f"CASE WHEN {d_norm('email')} <> '' THEN 'email:' || {d_norm('email')} WHEN {d_digits('phone')} <> '' THEN 'phone:' || {d_digits('phone')} WHEN ({web}) <> '' THEN 'web:' || ({web}) || '|' || {name} WHEN ({soc}) <> '' THEN 'social:' || ({soc}) || '|' || {name} ELSE concat_ws('|', {full}) END"


RAW = f"raw_leads AS ({RAW_LEADS.replace('STRING', 'VARCHAR')})"
HTML = f"html_pages AS ({HTML_PAGES.replace('STRING', 'VARCHAR')})"
ORD = "(profile_rank::BIGINT * 1000000000000 + row_no)"


def d_conformed() -> str:
    """CTEs from raw leads to gated candidates."""
    stripped = ", ".join(f"{d_strip(f)} AS {f}" for f in C.FIELDS if f != "socials")
    return f"""{RAW}, stripped AS (
  SELECT {ORD} AS seq, profile, {stripped}, {d_social('socials')} AS socials FROM raw_leads
), flagged AS (SELECT *, {d_listing('website')} AS cleared FROM stripped),
conformed AS (
  SELECT seq, profile, cleared, name, socials, email, phone, locality, district,
    CASE WHEN cleared THEN '' ELSE website END AS website,
    CASE WHEN cleared THEN concat_ws(' | ', nullif(sources, ''), website) ELSE sources END AS sources,
    CASE WHEN cleared THEN concat_ws(' | ', nullif(notes, ''), '{C.LISTING_NOTE}') ELSE notes END AS notes
  FROM flagged
)"""


def d_candidates(lead_type: str = LEAD_TYPE, place: str = "Portugal") -> str:
    lt, pl = f"'{lead_type}'", f"'{place}'"
    return f"""{d_conformed()}, gated AS (
  SELECT *, CASE WHEN email = '' AND phone = '' THEN 'no_contact' WHEN name = '' THEN 'no_name'
    WHEN NOT ({d_type(lt)}) THEN 'wrong_type' WHEN NOT {d_place(pl, 'locality', 'district', 'name', 'website', 'socials')} THEN 'wrong_type' END AS skip_reason
  FROM conformed
), cand AS (SELECT *, ({d_key()}) || '|' || {d_norm(lt)} || '|' || {d_fold(pl)} AS cache_key FROM gated WHERE skip_reason IS NULL)"""


def d_judged(scope: str = "key", lead_type: str = LEAD_TYPE, place: str = "Portugal") -> str:
    if scope == "key":
        rows = "SELECT cache_key, " + ", ".join(f"arg_max({f}, seq) AS {f}" for f in C.FIELDS) + ", min(seq) AS s, count(*) AS n FROM cand GROUP BY cache_key"
    else:
        rows = "SELECT cache_key, " + ", ".join(C.FIELDS) + ", seq AS s, 1 AS n FROM cand"
    rest = ", ".join(f for f in C.FIELDS if f not in ("phone", "email"))
    category = rf"regexp_matches({d_fold('name')}, '^barbearias?\s+em\b|onde cortar')"
    return f"""{d_candidates(lead_type, place)}, winners AS ({rows}), cleanup AS (
  SELECT cache_key, s, n, {rest}, CASE WHEN {d_phone_ok('phone')} THEN phone ELSE '' END AS phone, CASE WHEN {d_email_ok('email')} THEN email ELSE '' END AS email FROM winners
), told AS (
  SELECT *, CASE WHEN name = '' THEN '{C.NO_NAME}' WHEN email = '' AND phone = '' THEN '{C.NO_CONTACT}' WHEN {category} THEN '{C.CATEGORY_PAGE}' WHEN {d_portal()} THEN '{C.SEARCH_PORTAL}' END AS rejected FROM cleanup
), judged AS (
  SELECT * REPLACE (CASE WHEN rejected IS NULL THEN concat_ws(' | ', nullif(notes, ''), '{C.NO_REVIEWER}') ELSE notes END AS notes),
    CASE WHEN rejected IS NULL THEN ({d_key()}) END AS merge_key FROM told
)"""


def d_merged(scope: str = "key", lead_type: str = LEAD_TYPE, place: str = "Portugal") -> str:
    scalars = ", ".join(f"coalesce(arg_min({f}, s) FILTER (WHERE {f} <> ''), '') AS {f}" for f in C.FIELDS if f not in ("sources", "notes"))
    heads = ", ".join(f"arg_min({f}, s) FILTER (WHERE {f} <> '') AS raw_{f}, count(DISTINCT nullif({f}, '')) AS k_{f}" for f in ("sources", "notes"))

    def parts(f: str) -> str:
        return f"""SELECT merge_key, string_agg(part, ' | ' ORDER BY o) AS l_{f} FROM (
    SELECT merge_key, part, min(o) AS o FROM (
      SELECT merge_key, {d_strip('part')} AS part, s * 1000 + i AS o FROM (SELECT merge_key, s, unnest(string_split({f}, ' | ')) AS part, generate_subscripts(string_split({f}, ' | '), 1) AS i FROM ok)
    ) WHERE part <> '' GROUP BY merge_key, part) GROUP BY merge_key"""

    return f"""{d_judged(scope, lead_type, place)}, ok AS (SELECT * FROM judged WHERE merge_key IS NOT NULL),
heads AS (SELECT merge_key, {scalars}, {heads}, min(s) AS s, sum(n) AS n FROM ok GROUP BY merge_key),
ls AS ({parts('sources')}), ln AS ({parts('notes')}),
merged AS (
  SELECT h.merge_key, name, website, socials, email, phone, locality, district,
    coalesce(CASE WHEN k_sources <= 1 THEN raw_sources ELSE l_sources END, '') AS sources,
    coalesce(CASE WHEN k_notes <= 1 THEN raw_notes ELSE l_notes END, '') AS notes, s, n::BIGINT AS n
  FROM heads h LEFT JOIN ls USING (merge_key) LEFT JOIN ln USING (merge_key)
)"""


OUT = ["merge_key", *C.FIELDS]
D_OUT = ", ".join(OUT)

# --- queries -----------------------------------------------------------------


def q_normalize_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def q_fold_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fold_text(F.col("text")).alias("folded"))


def q_slugify(spark, sf):
    return raw_leads(spark, sf).select("row_no", T.slugify(F.col("name")).alias("slug"), T.title_from_slug(T.slugify(F.col("name"))).alias("title"))


def q_strip_tags(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def q_split_words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.split_words(F.col("text"))).cast("long").alias("n_words"))


def q_url_codec(spark, sf):
    names = raw_leads(spark, sf)
    cell = F.concat(F.lit("a%20b+"), "name", F.when(F.col("row_no") % 3 == 0, "%zz").otherwise("%C3%A9"))  # a third is malformed
    return names.select("row_no", T.encode_uri_component(F.col("name")).alias("encoded"), T.decode_url(cell).alias("decoded"))


def q_normalize_domain(spark, sf):
    return raw_leads(spark, sf).select("row_no", normalize_domain(F.col("website")).alias("website"), normalize_domain(F.col("socials")).alias("socials"))


#: Addresses of pages, engines' own pages and other schemes, for both engines.
_LINKS = """CASE page_id % 8 WHEN 1 THEN concat('https://www.google.pt/search?q=', CAST(page_id AS STRING)) WHEN 2 THEN concat('mailto:p', CAST(page_id AS STRING), '@x.pt') WHEN 3 THEN 'https://th.bing.com/th/id/1'
  WHEN 4 THEN 'https://www.qwant.com/?q=a' WHEN 5 THEN 'https://www.qwant.com/about' ELSE url END"""


def q_page_domains(spark, sf):
    links = read(spark, sf, "pages").select("page_id", F.expr(_LINKS).alias("url"))
    return links.select("page_id", normalize_domain(F.col("url")).alias("domain"), is_blocked_url(F.col("url")).alias("blocked"))


def q_listing_url_flags(spark, sf):
    w = F.col("website")
    return raw_leads(spark, sf).select("row_no", P.is_generic_listing_url(w).alias("listing"), P.is_generic_lead_website(w).alias("lead_website"))


def q_public_email_flags(spark, sf):
    return raw_leads(spark, sf).select("row_no", P.is_public_business_email(F.col("email")).alias("public_email"))


def q_phone_flags(spark, sf):
    p = F.col("phone")
    return raw_leads(spark, sf).select("row_no", T.normalize_phone(p).alias("digits"), P.is_plausible_phone(p).alias("plausible"), P.is_portuguese_phone(p).alias("portuguese"), P.is_brazilian_phone(p).alias("brazilian"))


def q_type_match(spark, sf):
    out = raw_leads(spark, sf)
    return out.select("row_no", P.matches_type(F.lit("Barbearias")).alias("barber"), P.matches_type_at_source(F.lit("talhos")).alias("meat"), P.matches_type(F.lit("leads")).alias("any_type"))


def q_geography_match(spark, sf):
    return raw_leads(spark, sf).select("row_no", P.matches_geography(F.lit("Europe")).alias("europe"), P.matches_geography(F.lit("Açores")).alias("acores"), P.matches_geography(F.lit("Portugal")).alias("anywhere"), P.is_country_wide(F.col("locality")).alias("wide"), P.requested_country(F.col("locality")).alias("country"))


def q_portal_flags(spark, sf):
    return raw_leads(spark, sf).select("row_no", P.looks_like_search_portal().alias("portal"), P.is_category_page(F.col("name")).alias("category_page"))


def q_platform_names(spark, sf):
    named = raw_leads(spark, sf).select("row_no", F.concat(F.lit("Fresha - "), F.col("name")).alias("title"), F.concat(F.lit("https://www.fresha.com/a/barbearia-"), T.slugify(F.col("locality")), F.lit(".html")).alias("url"))
    return named.select("row_no", normalize_platform_name(F.col("title"), F.col("url")).alias("name"))


def q_sanitize_socials(spark, sf):
    return raw_leads(spark, sf).select("row_no", C.sanitize_social_links(F.col("socials")).alias("socials"))


def q_conform_leads(spark, sf):
    return C.conform(raw_leads(spark, sf)).select("row_no", "cleared", *C.FIELDS)


def q_merge_keys(spark, sf):
    c = C.conform(raw_leads(spark, sf))
    return c.select("row_no", C.merge_key().alias("master_key"), C.merge_key(check_listing=False).alias("source_key"), C.directory_key().alias("directory_key"))


def q_skip_reasons(spark, sf):
    return C.candidates(raw_leads(spark, sf), LEAD_TYPE, "Europe").select("row_no", "skip_reason", "cache_key")


def q_verdict_per_key(spark, sf):
    found = C.verdict_per_key(C.candidates(raw_leads(spark, sf), LEAD_TYPE, "Portugal").where("skip_reason is null"))
    return found.select("cache_key", *C.FIELDS, "n")


def q_consolidate_leads(spark, sf):
    return C.consolidate(raw_leads(spark, sf), LEAD_TYPE, "Portugal").select(*OUT, "n")


def q_merge_leads_row_scope(spark, sf):
    return C.consolidate(raw_leads(spark, sf), LEAD_TYPE, "Portugal", verdict_scope="row").select(*OUT, "n")


def q_consolidate_limit(spark, sf):
    return C.consolidate(raw_leads(spark, sf), "leads", "Europe", limit=20).select(*OUT, "n")


def q_funnel_stats(spark, sf):
    return C.funnel_stats(raw_leads(spark, sf), LEAD_TYPE, "Portugal")


def requests_by_region(spark, sf):
    tables(spark, sf, "region")
    return spark.sql("SELECT concat('run', r_regionkey) AS run_id, CASE r_regionkey % 2 WHEN 0 THEN 'barbearia' ELSE 'leads' END AS lead_type, r_name AS geography FROM region")


def q_match_requests(spark, sf):
    matched = C.match_requests(C.conform(raw_leads(spark, sf)), requests_by_region(spark, sf))
    return matched.select("run_id", "row_no", "name")


def q_consolidate_by_run(spark, sf):
    matched = C.match_requests(C.conform(raw_leads(spark, sf)), requests_by_region(spark, sf))
    out = C.consolidate(matched.drop("cleared"), "leads", "Portugal", by=["run_id"])
    return out.select("run_id", "merge_key", "name", "email", "phone", "n")


def verdict_table(spark, sf):
    """Outside verdicts for two thirds of the keys, from the keys themselves."""
    keys = C.candidates(raw_leads(spark, sf), LEAD_TYPE, "Portugal").where("cache_key is not null").select("cache_key").distinct()
    n = F.length("cache_key") % 3
    fixed = F.create_map(F.lit("Localidade"), F.lit("Lisboa"), F.lit("Distrito"), F.lit(" "))
    return keys.where(n < 2).select("cache_key", (n == 0).alias("approved"), F.when(n == 0, " ").otherwise("Fora do pedido.").alias("reason"), F.when(n == 0, fixed).alias("normalized"))


def q_apply_verdicts(spark, sf):
    leads = raw_leads(spark, sf)
    return C.consolidate(leads, LEAD_TYPE, "Portugal", verdicts=verdict_table(spark, sf), pending=True).select(*OUT, "n")


def q_pending_keys(spark, sf):
    keyed = C.candidates(raw_leads(spark, sf), LEAD_TYPE, "Portugal").where("cache_key is not null")
    return C.pending_keys(keyed, verdict_table(spark, sf)).select("row_no", "cache_key")


QUERIES: dict[str, Query] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_TITLE_PLACES = "'pt', 'pt-pt', 'portugal', 'braganca', 'lisboa', 'porto', 'coimbra', 'faro', 'setubal', 'aveiro', 'viseu'"
_SLUG = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '-', 'g'), '-')"
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">")]


def d_strip_tags(x: str) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    out = d_strip(rf"regexp_replace({out}, '[\s\x0B\x{{00A0}}]+', ' ', 'g')")
    for entity, character in _ENTITIES:
        out = f"regexp_replace({out}, '(?i){entity}', '{character}', 'g')"
    return out


def _title(slug: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({slug}, '-'), lambda y: y <> '' AND y NOT IN ({_TITLE_PLACES})), lambda y: upper(y[1]) || lower(y[2:])), ' ')"


_RUNS = "runs AS (SELECT concat('run', r_regionkey) AS run_id, CASE r_regionkey % 2 WHEN 0 THEN 'barbearia' ELSE 'leads' END AS lead_type, r_name AS geography FROM region)"
_MATCHED = f"{d_conformed()}, {_RUNS}, matched AS (SELECT run_id, c.* FROM conformed c JOIN runs ON ({d_type('lead_type')}) AND {d_place('geography', 'locality', 'district', 'name', 'website', 'socials')})"
_VERDICT = "verdict AS (SELECT DISTINCT cache_key, length(cache_key) % 3 AS v FROM cand WHERE length(cache_key) % 3 < 2)"


def _with_verdicts() -> str:
    """The merge with the outside verdicts overlaid: 0 approves and sets the place, 1 rejects, none waits."""
    sql = d_merged()
    overlay = f"""judged AS (
  SELECT * REPLACE (concat_ws(' | ', nullif(notes, ''), 'Aprovada pela IA.') AS notes, 'Lisboa' AS locality), ({d_key()}) AS merge_key
  FROM told SEMI JOIN (SELECT cache_key FROM verdict WHERE v = 0) USING (cache_key) WHERE rejected IS NULL
)"""
    a, b = sql.index("judged AS ("), sql.index(", ok AS (")
    return f"WITH {sql[:a]}{_VERDICT}, {overlay.replace(d_key(), d_key())}{sql[b:]}"


_KEYS_FOR_RUNS = f"""SELECT run_id, merge_key, coalesce(arg_min(name, s) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_min(email, s) FILTER (WHERE email <> ''), '') AS email, coalesce(arg_min(phone, s) FILTER (WHERE phone <> ''), '') AS phone, sum(n)::BIGINT AS n
FROM (SELECT *, ({d_key()}) AS merge_key FROM fine) GROUP BY run_id, merge_key"""

ORACLE_SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {d_norm('text')} AS normalized FROM documents",
    "fold_text": f"SELECT doc_id, {d_fold('text')} AS folded FROM documents",
    "slugify": f"WITH {RAW}, s AS (SELECT row_no, {_SLUG.format(x='name')} AS slug FROM raw_leads) SELECT row_no, slug, {_title('slug')} AS title FROM s",
    "strip_tags": f"SELECT page_id, {d_strip_tags('html')} AS text FROM pages",
    "split_words": r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda y: y <> ''))::BIGINT AS n_words FROM documents",
    "url_codec": f"WITH {RAW} SELECT row_no, replace(replace(replace(replace(replace(url_encode(name), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '+', '%20') AS encoded, CASE WHEN row_no % 3 = 0 THEN 'a%20b+' || name || '%zz' ELSE 'a b ' || name || 'é' END AS decoded FROM raw_leads",
    "normalize_domain": f"WITH {RAW} SELECT row_no, {d_domain('website')} AS website, {d_domain('socials')} AS socials FROM raw_leads",
    "page_domains": f"WITH links AS (SELECT page_id, {_LINKS.replace('STRING', 'VARCHAR')} AS url FROM pages) SELECT page_id, {d_domain('url')} AS domain, page_id % 8 BETWEEN 1 AND 4 AS blocked FROM links",
    "listing_url_flags": f"WITH {RAW} SELECT row_no, {d_listing('website')} AS listing, {d_rules('website', P.LEAD_WEBSITE_RULES, P.LEAD_WEBSITE_ROUGH)} AS lead_website FROM raw_leads",
    "public_email_flags": f"WITH {RAW} SELECT row_no, {d_email_ok('email')} AS public_email FROM raw_leads",
    "phone_flags": rf"WITH {RAW}, d AS (SELECT row_no, {d_digits('phone')} AS digits FROM raw_leads) SELECT row_no, digits, length(digits) BETWEEN 9 AND 15 AS plausible, CASE WHEN starts_with(digits, '351') THEN length(digits) = 12 AND regexp_matches(digits, '^351[23569]') ELSE length(digits) = 9 AND regexp_matches(digits, '^[23569]') END AS portuguese, CASE WHEN starts_with(digits, '55') THEN length(digits) BETWEEN 12 AND 13 ELSE length(digits) BETWEEN 10 AND 11 END AS brazilian FROM d",
    "type_match": f"WITH {RAW}, h AS (SELECT row_no, {d_norm(d_hay('name', 'website', 'socials', 'notes'))} AS a, {d_norm(d_hay('name', 'website', 'socials', 'notes', 'sources'))} AS b FROM raw_leads) SELECT row_no, {d_words('a', P.BARBER_WORDS)} AND NOT {d_words('a', P.HAIR_WORDS)} AS barber, {d_words('b', P.MEAT_WORDS)} AS meat, true AS any_type FROM h",
    "geography_match": f"WITH {RAW}, h AS (SELECT row_no, locality, {d_fold(d_hay('locality', 'district', 'name', 'website', 'socials'))} AS a FROM raw_leads) SELECT row_no, contains(a, 'europe') AS europe, contains(a, 'acores') AS acores, true AS anywhere, lower(locality) IN ('portugal', 'portugal continental', 'pt', 'pt-pt') AS wide, CASE WHEN {d_words(d_fold('locality'), ['brasil', 'brazil', 'sp', 'sao paulo', 'braganca paulista'])} THEN 'BR' ELSE 'PT' END AS country FROM h",
    "portal_flags": rf"WITH {RAW} SELECT row_no, {d_portal()} AS portal, regexp_matches({d_fold('name')}, '^barbearias?\s+em\b|onde cortar') AS category_page FROM raw_leads",
    "platform_names": f"WITH {RAW} SELECT row_no, {_title('''('barbearia-' || ''' + _SLUG.format(x='locality') + ')')} AS name FROM raw_leads",
    "sanitize_socials": f"WITH {RAW} SELECT row_no, {d_social('socials')} AS socials FROM raw_leads",
    "conform_leads": f"WITH {d_conformed()} SELECT seq % 1000000000000 AS row_no, cleared, {', '.join(C.FIELDS)} FROM conformed",
    "merge_keys": f"WITH {d_conformed()} SELECT seq % 1000000000000 AS row_no, {d_key()} AS master_key, {d_key(False)} AS source_key, CASE WHEN {d_norm('email')} <> '' THEN 'email:' || {d_norm('email')} WHEN {d_digits('phone')} <> '' THEN 'phone:' || {d_digits('phone')} WHEN website <> '' THEN 'website:' || {d_norm('website')} || '|' || {d_norm('name')} ELSE concat_ws('|', nullif({d_norm('name')}, ''), nullif({d_norm('locality')}, '')) END AS directory_key FROM conformed",
    "skip_reasons": f"WITH {d_candidates(place='Europe')} SELECT g.seq % 1000000000000 AS row_no, g.skip_reason, c.cache_key FROM gated g LEFT JOIN cand c ON g.seq = c.seq",
    "verdict_per_key": f"WITH {d_judged()} SELECT cache_key, {', '.join(C.FIELDS)}, n::BIGINT AS n FROM winners",
    "consolidate_leads": f"WITH {d_merged()} SELECT {D_OUT}, n FROM merged",
    "merge_leads_row_scope": f"WITH {d_merged('row')} SELECT {D_OUT}, n FROM merged",
    "consolidate_limit": f"WITH {d_merged(lead_type='leads', place='Europe')} SELECT {D_OUT}, n FROM merged ORDER BY s LIMIT 20",
    "funnel_stats": f"""WITH {d_judged()}, g AS (SELECT merge_key, sum(n) AS n FROM judged GROUP BY merge_key)
SELECT (SELECT count(*) FROM conformed WHERE cleared) AS "clearedGenericWebsite", (SELECT count(*) FROM gated WHERE skip_reason = 'no_contact') AS "skippedNoContact",
  (SELECT count(*) FROM gated WHERE skip_reason = 'no_name') AS "skippedNoName", (SELECT count(*) FROM gated WHERE skip_reason = 'wrong_type') AS "skippedWrongType",
  0::BIGINT AS "pendingValidation", coalesce((SELECT sum(n) FROM g WHERE merge_key IS NULL), 0)::BIGINT AS "rejectedByValidation", 0::BIGINT AS "validationErrors",
  coalesce((SELECT sum(n - 1) FROM g WHERE merge_key IS NOT NULL), 0)::BIGINT AS duplicates, (SELECT count(*) FROM g WHERE merge_key IS NOT NULL) AS "totalValid", (SELECT count(*) FROM g WHERE merge_key IS NOT NULL) AS kept""",
    "match_requests": f"WITH {_MATCHED} SELECT run_id, seq % 1000000000000 AS row_no, name FROM matched",
    "consolidate_by_run": rf"""WITH {_MATCHED}, again AS (SELECT * REPLACE ({d_social('socials')} AS socials) FROM matched WHERE (email <> '' OR phone <> '') AND name <> ''),
w AS (SELECT run_id, ({d_key()}) AS ck, {', '.join(f'arg_max({f}, seq) AS {f}' for f in C.FIELDS)}, min(seq) AS s, count(*) AS n FROM again GROUP BY ALL HAVING true),
x AS (SELECT * REPLACE (CASE WHEN {d_phone_ok('phone')} THEN phone ELSE '' END AS phone, CASE WHEN {d_email_ok('email')} THEN email ELSE '' END AS email) FROM w),
fine AS (SELECT * FROM x WHERE (email <> '' OR phone <> '') AND NOT regexp_matches({d_fold('name')}, '^barbearias?\s+em\b|onde cortar') AND NOT {d_portal()})
{_KEYS_FOR_RUNS}""",
    "apply_verdicts": f"{_with_verdicts()} SELECT {D_OUT}, n FROM merged",
    "pending_keys": f"WITH {d_candidates()} SELECT seq % 1000000000000 AS row_no, cache_key FROM cand WHERE length(cache_key) % 3 = 2",
}
