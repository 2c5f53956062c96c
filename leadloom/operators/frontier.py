"""From requests to search queries, result links and the pages to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.predicates import is_country_wide
from leadloom.functions.text import blank, decode_url, encode_uri_component, html_decode, or_null, slugify, split_words, strip
from leadloom.functions.urls import clean_url, is_blocked_url, url_host

#: Source profiles in their order, with source type.
PROFILES = [("directories", "directories"), ("web", "search"), ("maps", "maps"), ("social", "social"), ("free", "free")]
DISTRICTS = ["Lisboa", "Porto", "Braga", "Aveiro", "Coimbra", "Faro", "Setúbal", "Viseu", "Leiria", "Bragança", "Vila Real", "Guarda", "Castelo Branco", "Évora", "Portalegre", "Santarém", "Beja", "Viana do Castelo", "Madeira", "Açores"]
MAP_PLACES = ["Lisboa", "Porto", "Braga", "Coimbra", "Faro", "Setúbal"]
SOCIAL_PLACES = ["Lisboa", "Porto", "Braga", "Coimbra"]
OTHER_PLACES = ["Lisboa", "Porto", "Braga", "Aveiro", "Coimbra"]
VARIANTS = [
    ("barbear|barber", ["barbearia", "barber shop", "barbershop"]),
    ("talh|carn", ["talho", "talhos", "butcher", "butcher shop"]),
    ("padar|bolo|p[aã]o", ["padaria", "pastelaria", "bolos", "pao", "pão"]),
    ("haccp", ["haccp", "consultoria haccp", "implementação haccp"]),
    ("cozinha", ["cozinha regional", "cozinha tradicional", "restaurante regional"]),
]
SITES = {
    "social": ["facebook.com", "instagram.com"],
    "maps": ["google.com/maps", "google.pt/maps"],
    "directories": ["pai.pt", "hotfrog.pt", "cylex.pt", "tuugo.pt", "misterwhat.pt", "infobel.com"],
}
FREE_ENDINGS = ["contacto", "redes sociais", "diretório"]
PROVIDERS = {
    "maps": ["bing", "qwant", "yahoo", "brave", "google", "duckduckgo"],
    "social": ["yahoo", "brave", "bing", "qwant", "google", "duckduckgo"],
    "directories": ["mojeek", "bing", "qwant", "yahoo", "brave", "google", "duckduckgo"],
}
BROAD_PROVIDERS = ["bing", "yahoo", "qwant", "mojeek", "brave", "duckduckgo", "google"]
PROVIDER_URLS = {
    "google": "https://www.google.com/search?hl=pt-PT&gl=pt&num=10&q={}",
    "bing": "https://www.bing.com/search?cc=pt&setlang=pt-PT&count=10&q={}",
    "duckduckgo": "https://lite.duckduckgo.com/lite/?q={}",
    "yahoo": "https://search.yahoo.com/search?p={}",
    "brave": "https://search.brave.com/search?q={}&source=web",
    "mojeek": "https://www.mojeek.com/search?q={}",
    "qwant": "https://www.qwant.com/?q={}&t=web",
}
#: Links kept of each query.
TOP = 18


def texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keyword_variants(lead_type: Column) -> Column:
    """Search words of a business type, in order; other types stand for themselves."""
    normalized = F.lower(strip(lead_type))
    pattern, found = VARIANTS[0]
    out = F.when(normalized.rlike(pattern), texts(found))
    for pattern, found in VARIANTS[1:]:
        out = out.when(normalized.rlike(pattern), texts(found))
    return out.when(F.size(split_words(lead_type)) > 0, F.array(lead_type)).otherwise(texts(["leads"]))


def geography_terms(geography: Column, source_type: Column) -> Column:
    """Places to search in: the place itself, and for the whole country its larger towns too."""
    text = strip(geography)
    more = F.when(source_type.isin("directories", "free"), texts(DISTRICTS)).when(source_type == "maps", texts(MAP_PLACES)).when(source_type == "social", texts(SOCIAL_PLACES)).otherwise(texts(OTHER_PLACES))
    return F.when(~is_country_wide(text), F.array(text)).otherwise(F.concat(F.array(text), more))


def build_queries(requests: DataFrame) -> DataFrame:
    """Search queries of each request and source: run_id, profile, source_type, query and its place ``query_ord``, from 1.

    ``requests`` has run_id, lead_type and geography; blank types count as
    ``leads``, blank places as Portugal.  Equal queries of a source are one.
    """
    profiles = requests.sparkSession.createDataFrame([(r, *p) for r, p in enumerate(PROFILES)], "profile_rank int, profile string, source_type string")  # five rows
    place = F.coalesce(or_null(strip(F.col("geography"))), F.lit("Portugal"))
    kind = F.coalesce(or_null(blank(F.col("lead_type"))), F.lit("leads"))
    wide = requests.select("run_id", kind.alias("kind"), place.alias("place")).crossJoin(F.broadcast(profiles))
    variants = keyword_variants(F.col("kind"))
    st, p = F.col("source_type"), F.col("place")
    endings = texts(["", " telefone email", " website"])

    def with_endings(base: Column) -> Column:
        return F.transform(endings, lambda e: F.concat(base, e))

    alone = is_country_wide(p) & st.isin("directories", "free")

    def of_variant(v: Column) -> Column:
        named = F.flatten(F.transform(geography_terms(p, st), lambda g: with_endings(F.concat(v, F.when(g != "", F.concat(F.lit(" "), g)).otherwise("")))))
        return F.when(alone, F.concat(with_endings(v), named)).otherwise(named)

    def special(v: Column) -> Column:
        sites = {k: F.transform(texts(s), lambda site: F.concat(F.lit("site:"), site, F.lit(" "), v, F.lit(" "), p)) for k, s in SITES.items()}
        free = F.transform(texts(FREE_ENDINGS), lambda e: F.concat(v, F.lit(" "), p, F.lit(" "), e))
        out = F.when(st == "free", free)
        for k, s in sites.items():
            out = out.when(st == k, s)
        return out.otherwise(F.array().cast("array<string>"))

    both = F.concat(F.flatten(F.transform(variants, of_variant)), F.flatten(F.transform(variants, special)))
    queries = F.array_distinct(F.filter(F.transform(both, strip), lambda q: q != ""))
    return wide.select("run_id", "profile", "source_type", F.posexplode(queries).alias("_at", "query")).select("run_id", "profile", "source_type", "query", (F.col("_at") + 1).alias("query_ord"))


def direct_seed_urls(requests: DataFrame) -> DataFrame:
    """Addresses known from the request alone: run_id, ``position`` and url."""
    kind, place = F.lower(strip(F.col("lead_type"))), strip(F.col("geography"))
    city = slugify(place)
    # fixed values
    barber = F.array(F.concat(F.lit("https://ondecortar.pt/cidades/"), city, F.lit("/")), F.concat(F.lit("https://www.fresha.com/lp/pt/bt/barbershops/in/pt-"), city), F.concat(F.lit("https://www.fresha.com/lp/en/bt/barbershops/in/pt-"), city), F.concat(F.lit("https://booksy.com/pt-pt/s/barbearia/"), encode_uri_component(place)), F.concat(F.lit("https://www.agendoor.com/pt/explore/portugal/"), city))
    search = "https://www.pai.pt/searches?search%5Bquery%5D={}&search%5Blocation%5D="

    def in_place(word: str, where: Column) -> Column:
        return F.concat(F.lit(search.format(word)), encode_uri_component(where))

    none = F.array().cast("array<string>")
    meat = F.array(*[in_place(w, F.coalesce(or_null(place), F.lit("Portugal"))) for w in ("talhos", "talho")])
    everywhere = F.transform(texts(DISTRICTS), lambda d: in_place("talhos", d))
    urls = F.concat(F.when((city != "") & kind.rlike("barbear|barber"), barber).otherwise(none), F.when(kind.rlike("talh|carn"), F.when(is_country_wide(place), F.concat(meat, everywhere)).otherwise(meat)).otherwise(none))
    return requests.select("run_id", F.posexplode(F.array_distinct(urls)).alias("position", "url"))


def provider_search_urls(queries: DataFrame) -> DataFrame:
    """The address of each query at each search provider of its source, in provider order."""
    order = F.when(F.col("source_type") == "maps", texts(PROVIDERS["maps"])).when(F.col("source_type") == "social", texts(PROVIDERS["social"])).when(F.col("source_type") == "directories", texts(PROVIDERS["directories"])).otherwise(texts(BROAD_PROVIDERS))
    spread = queries.select("*", F.posexplode(order).alias("provider_ord", "provider"))
    encoded = encode_uri_component(F.col("query"))
    url = F.lit("")
    for name, template in PROVIDER_URLS.items():
        head, tail = template.split("{}")
        url = F.when(F.col("provider") == name, F.concat(F.lit(head), encoded, F.lit(tail))).otherwise(url)
    return spread.withColumn("search_url", url)


def _links(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(blank(html), F.lit(pattern), F.lit(1))


def extract_search_urls(provider: Column, html: Column) -> Column:
    """Result links of a provider's page, in order."""
    # fixed values
    google = F.transform(_links(html, r'href="/url\?q=([^"&]+)[^"]*"'), decode_url)
    bing = _links(html, r'(?is)<li class="b_algo".*?<h2>\s*<a href="([^"]+)"')
    duck = F.concat(F.transform(_links(html, r'uddg=([^&"]+)'), decode_url), _links(html, r'(?i)class="result__a"[^>]+href="([^"]+)"'))
    yahoo = F.concat(_links(html, r'(?i)<a[^>]+class="[^"]*\bac-algo\b[^"]*"[^>]+href="([^"]+)"'), _links(html, r'(?i)href="([^"]*/RU=[^"]+)"'))
    anchors = F.transform(_links(html, r'(?i)<a[^>]+href="(https?://[^"]+)"'), html_decode)

    def foreign(h: Column) -> Column:
        host = url_host(F.lower(h))
        return (host != "") & ~host.rlike("google|bing|duckduckgo|yahoo|brave|mojeek|qwant")

    return F.when(provider == "google", google).when(provider == "bing", bing).when(provider == "duckduckgo", duck).when(provider == "yahoo", yahoo).otherwise(F.filter(anchors, foreign))


def result_urls(results: DataFrame) -> DataFrame:
    """Links of result pages, cleaned; engines' own pages and blocked addresses go.

    ``results`` has run_id, profile, query, query_ord, provider_ord, provider and
    html; ``position`` orders the links of a query by provider and place.  Each
    distinct link is cleaned once.
    """
    keep = ["run_id", "profile", "query", "query_ord", "provider_ord"]
    links = results.select(*keep, F.posexplode(extract_search_urls(F.col("provider"), F.col("html"))).alias("place", "raw"))
    cleaned = links.select("raw").distinct().select("raw", clean_url(F.col("raw")).alias("url"))
    joined = links.join(cleaned, "raw").where((F.col("url") != "") & ~is_blocked_url(F.col("url")))
    return joined.select(*keep[:4], F.struct("provider_ord", "place").alias("position"), "url")


def frontier_topk(urls: DataFrame, most: int = TOP) -> DataFrame:
    """The first links of each query, without repeats that differ in case only."""
    of_query = ["run_id", "profile", "query", "query_ord"]
    first = urls.groupBy(*of_query, F.lower("url").alias("_low")).agg(F.min(F.struct("position", "url")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(*of_query).orderBy("position"))
    return first.select(*of_query, "f.position", "f.url").withColumn("rank", rank).where(F.col("rank") <= most)


def frontier_first_seen(top: DataFrame) -> DataFrame:
    """The first sight of each exact link over all queries of a source.  A minimum, so popular links don't pile up."""
    return top.groupBy("run_id", "profile", "url").agg(F.min(F.struct("query_ord", "rank")).alias("seen")).select("run_id", "profile", "url", "seen.query_ord", "seen.rank")


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("run_id", "profile", "url").distinct(), ["run_id", "profile", "url"], "left_anti")


def fetch(frontier: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frontier rows with their pages, and blockers for those without (``error`` of the page, if it names one)."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    joined = frontier.join(pages.select("url", "html", error.alias("_error")), "url", "left")
    text = F.concat(F.col("url"), F.lit(" -> "), F.coalesce("_error", F.lit("Failed to fetch")))
    missing = joined.where("html is null").select("run_id", "profile", text.alias("blocker"))
    return joined.where("html is not null").drop("_error"), missing


def queries_without_results(queries: DataFrame, urls: DataFrame) -> DataFrame:
    """Blockers for queries that gave no link."""
    keys = ["run_id", "profile", "query"]
    empty = queries.join(urls.select(*keys).distinct(), keys, "left_anti")
    return empty.select(*keys, F.concat(F.lit('Sem resultados para "'), F.col("query"), F.lit('"')).alias("blocker"))


def first_per_key(rows: DataFrame, by: Sequence[str], key: str, seq: str) -> DataFrame:
    """The first row of each key within a source; a minimum, so hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in (*by, key)]
    found = rows.where(F.col(key) != "").groupBy(*by, key).agg(F.min_by(F.struct(*rest), seq).alias("_row"))
    return found.select(*by, key, "_row.*")
