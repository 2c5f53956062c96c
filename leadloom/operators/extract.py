"""Contact rows from fetched pages, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.predicates import source_note
from leadloom.functions.text import WS, blank, clean_spaces, decode_url, html_decode, join_full, or_null, strip, strip_tags
from leadloom.functions.urls import is_google_maps, is_parsable, join_url, normalize_platform_name, url_host, url_path

from .barrier import computed_once

#: The patterns by which values are found.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
MAILTO = r"(?i)mailto:([^\"'>\s]+)"
TEL = r"(?i)tel:([^\"'>\s]+)"
PHONE = r"(?:\+?351[\s.-]?)?(?:\(?\d{2,3}\)?[\s.-]?){3,4}\d{2,4}"
SOCIAL = r"(?i)facebook\.com|instagram\.com|linkedin\.com|tiktok\.com|youtube\.com|x\.com|twitter\.com"
META_NOTE, SOCIAL_NOTE = "Meta descrição confirmada.", "Rede social pública encontrada."
CARD_NOTE = "Barbearia extraida de listagem OndeCortar."


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(pattern), F.lit(group))


def _first(c: Column, pattern: str) -> Column:
    return F.regexp_extract(blank(c), pattern, 1)


def json_ld_objects(html: Column) -> Column:
    """Parsed JSON-LD blocks as an array of variants; arrays are flattened, malformed blocks skipped."""
    blocks = F.filter(F.transform(_all(html, r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>', 1), lambda b: F.try_parse_json(strip(b))), lambda v: v.isNotNull())
    lists = F.transform(blocks, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>")).otherwise(F.array(v)))
    return F.flatten(lists)


def business(objects: Column) -> Column:
    """The first object of a business or organization; a list of types doesn't count."""
    return F.get(F.filter(objects, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string").isin("LocalBusiness", "Organization"), F.lit(False))), F.lit(0))


def variant_text(v: Column, path: str) -> Column:
    return blank(F.try_variant_get(v, path, "string"))


def social_links(html: Column) -> Column:
    """Distinct links to social networks, in order."""
    links = F.transform(_all(html, r'(?i)href="([^"]+)"', 1), html_decode)
    return F.array_distinct(F.filter(links, lambda h: h.rlike(SOCIAL)))


def emails(html: Column) -> Column:
    """Distinct addresses: those in the text first, then mail links with their query strings."""
    found = F.transform(_all(html, MAILTO, 1), lambda m: F.regexp_replace(decode_url(m), "(?i)^mailto:", ""))
    return F.array_distinct(F.concat(_all(html, EMAIL, 0), found))


def phones(html: Column) -> Column:
    """Distinct numbers: phone links first, then numbers of seven digits and more in the page."""
    links = F.transform(_all(html, TEL, 1), lambda m: F.regexp_replace(decode_url(m), "(?i)^tel:", ""))
    numbers = F.transform(_all(html, PHONE, 0), strip)
    return F.array_distinct(F.concat(links, F.filter(numbers, lambda n: F.length(F.regexp_replace(n, "[^0-9]", "")) >= 7)))


def meta_columns(html: Column) -> dict[str, Column]:
    description = F.coalesce(or_null(_first(html, r'(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"')), or_null(_first(html, r'(?i)<meta[^>]+property="og:description"[^>]+content="([^"]*)"')), F.lit(""))
    canonical = F.coalesce(or_null(_first(html, r'(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"')), or_null(_first(html, r'(?i)<meta[^>]+property="og:url"[^>]+content="([^"]+)"')), F.lit(""))
    return {
        "title": _first(html, r"(?is)<title[^>]*>(.*?)</title>"),
        "description": description,
        "canonical": canonical,
        "og_title": _first(html, r'(?i)<meta[^>]+property="og:title"[^>]+content="([^"]+)"'),
    }


def extract_leads(pages: DataFrame, geography: Column | str, source_type: Column | str) -> DataFrame:
    """The generic contact row of each page (``url``, ``html``); the markup goes, other columns stay.

    Each pattern runs once per page: values are taken first, rows made of them after.
    """
    geography = F.lit(geography) if isinstance(geography, str) else geography
    source_type = F.lit(source_type) if isinstance(source_type, str) else source_type
    html = F.col("html")
    rest = [c for c in pages.columns if c != "html"]
    meta = {f"_{k}": v for k, v in meta_columns(html).items()}
    taken = pages.select(
        *rest,
        *[v.alias(k) for k, v in meta.items()],
        business(json_ld_objects(html)).alias("_ld"),
        F.array_join(social_links(html), " | ").alias("_social"),
        emails(html).alias("_emails"),
        phones(html).alias("_phones"),
        F.substring(strip_tags(html), 1, 100).alias("_head"),
        blank(geography).alias("_place"),
        source_note(source_type).alias("_note"),
    )
    ld = F.col("_ld")
    known = taken.select(
        *[c for c in taken.columns if c != "_ld"],
        *[variant_text(ld, path).alias(f"_ld_{name}") for name, path in (("name", "$.name"), ("url", "$.url"), ("phone", "$.telephone"), ("locality", "$.address.addressLocality"), ("region", "$.address.addressRegion"))],
    )
    # one step per value that is used more than once, so that it is computed once
    known = known.withColumns({"_site": strip(F.coalesce(or_null(F.col("_ld_url")), or_null(F.col("_canonical")), F.col("url"))), "_name": clean_spaces(F.coalesce(or_null(F.col("_ld_name")), or_null(F.col("_og_title")), F.col("_title")))})
    site = F.col("_site")
    known = known.withColumn("_site", F.when(is_parsable(site) & ~is_google_maps(site), site).otherwise(""))
    known = known.withColumn("_link", F.coalesce(or_null(F.col("_site")), F.col("url")))
    known = known.withColumn("_named", normalize_platform_name(F.col("_name"), F.col("_link")))
    named = F.col("_named")
    listed = F.array_distinct(F.filter(F.array(F.col("url"), F.col("_canonical"), F.substring("_description", 1, 120)), lambda x: x != ""))
    wide = F.lower("_place").contains("portugal")
    return known.select(
        *rest,
        F.coalesce(or_null(named), F.col("_head")).alias("name"),
        F.col("_site").alias("website"),
        F.col("_social").alias("socials"),
        F.coalesce(F.get("_emails", F.lit(0)), F.lit("")).alias("email"),
        F.coalesce(or_null(F.get("_phones", F.lit(0))), strip(F.col("_ld_phone"))).alias("phone"),
        strip(F.coalesce(or_null(F.col("_ld_locality")), or_null(F.col("_ld_region")), F.col("_place"))).alias("locality"),
        strip(F.coalesce(or_null(F.col("_ld_region")), F.when(wide, "").otherwise(F.col("_place")))).alias("district"),
        F.array_join(listed, " | ").alias("sources"),
        join_full(" | ", F.col("_note"), F.when(F.col("_description") != "", META_NOTE).otherwise(""), F.when(F.col("_social") != "", SOCIAL_NOTE).otherwise("")).alias("notes"),
    )


def is_city_listing(url: Column) -> Column:
    u = F.lower(blank(url))
    return F.contains(url_host(u), F.lit("ondecortar.pt")) & F.contains(url_path(u), F.lit("/cidades/"))  # fixed values


def extract_listing_cards(pages: DataFrame, geography: Column | str, source_type: Column | str) -> DataFrame:
    """A row for each card with a name and a phone of city listing pages; ``card`` is its place on the page."""
    geography = F.lit(geography) if isinstance(geography, str) else geography
    source_type = F.lit(source_type) if isinstance(source_type, str) else source_type
    rest = [c for c in pages.columns if c != "html"]
    last = F.replace(F.coalesce(F.try_element_at(F.filter(F.split(url_path(F.col("url")), "/"), lambda p: p != ""), F.lit(-1)), F.lit("")), F.lit("-"), F.lit(" "))
    place = F.coalesce(or_null(strip(geography)), last)
    cards = pages.where(is_city_listing(F.col("url"))).select(*rest, place.alias("_place"), source_note(source_type).alias("_note"), F.posexplode(_all(F.col("html"), r'(?is)<article\s+class="card".*?</article>', 0)).alias("card", "_block"))
    block = F.col("_block")
    heading = r'(?is)<h3>\s*<a\s+href="([^"]+)">(.*?)</a>\s*</h3>'
    parts = cards.select(
        *rest, "card", "_place", "_note",
        html_decode(F.regexp_extract(block, heading, 1)).alias("_href"),
        strip_tags(F.regexp_extract(block, heading, 2)).alias("name"),
        strip(html_decode(_first(block, r'(?i)href="tel:([^"]+)"'))).alias("phone"),
        strip(html_decode(_first(block, r"(?i)<strong>\s*Morada:\s*</strong>\s*([^<]+)"))).alias("_address"),
    )
    empty = F.lit("")
    return computed_once(parts).where("_href <> '' and name <> '' and phone <> ''").select(
        *rest, "card", "name", join_url(F.col("url"), F.col("_href")).alias("website"), empty.alias("socials"), empty.alias("email"), "phone",
        F.col("_place").alias("locality"), F.col("_place").alias("district"), F.col("url").alias("sources"),
        join_full(" | ", F.col("_note"), F.lit(CARD_NOTE), F.concat(F.lit("Morada: "), or_null(F.col("_address")))).alias("notes"),
    )


def extract_rows(pages: DataFrame, geography: Column | str, source_type: Column | str, key: str = "url") -> DataFrame:
    """Cards of pages that have any, the generic row of all others; rows without a name go."""
    cards = extract_listing_cards(pages, geography, source_type)
    others = pages.join(cards.select(key).distinct(), key, "left_anti") if key in pages.columns else pages
    generic = extract_leads(others, geography, source_type).withColumn("card", F.lit(0))
    return cards.unionByName(computed_once(generic).where("name <> ''"))


def visible_words(html: Column) -> Column:
    return F.split(strip_tags(html), f"[{WS}]+")
