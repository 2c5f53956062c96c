"""Predicates over columns of contact rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import END, START, blank, fold_text, normalize_phone, normalize_text, strip
from .urls import bare_host, url_path, with_scheme

Field = Callable[[str], Column]


def words(*alternatives: str) -> str:
    """A pattern for whole words."""
    return f"{START}(?:{'|'.join(alternatives)}){END}"


def _listing(value: Column, rules: list[tuple[str, str]], rough: str) -> Column:
    """One pattern over ``host, space, path``; texts that are no URL are matched roughly."""
    places = "|".join(rf"^[^ ]*{h.replace('.', chr(92) + '.')}[^ ]* .*(?:{p})" for h, p in rules)
    u = with_scheme(value)
    host = bare_host(u)
    return F.when(host != "", F.concat_ws(" ", host, url_path(u)).rlike(places)).otherwise(u.rlike(rough))


#: Host parts with a pattern for the path; an empty pattern takes every path.
LISTING_RULES = [
    ("barberhead.com", ""), ("google.", "/maps"), ("maps.google.", ""), ("maps.app.goo.gl", ""), ("hotfrog.", "/search/"),
    ("fresha.", ""), ("booksy.", ""), ("noona.", ""), ("agendoor.", ""), ("ondecortar.pt", "/cidades/"),
    ("cylex.", "/barbearia/?$|/cabeleireiro/?$|/talho/?$"), ("pai.pt", "/pesquisa/"), ("empresite.", "/actividade/"), ("racius.", "/pesquisa/"),
]
LISTING_ROUGH = r"/search/|/lp/|/pesquisa/|google\.com/maps|barberhead\.com"
LEAD_WEBSITE_RULES = [
    ("pai.pt", "/search"), ("google.", "/maps"), ("maps.google.", ""), ("maps.app.goo.gl", ""), ("booksy.com", "/search"),
    ("fresha.", ""), ("booksy.", ""), ("noona.", ""), ("agendoor.", ""), ("ondecortar.pt", "/cidades/"),
    ("cylex.", "/search"), ("hotfrog.", "/search"), ("infobel.", "/search"), ("tuugo.", "/search"),
]
LEAD_WEBSITE_ROUGH = r"/search/|/maps|maps\.app\.goo\.gl"


def is_generic_listing_url(value: Column) -> Column:
    return _listing(value, LISTING_RULES, LISTING_ROUGH)


def is_generic_lead_website(value: Column) -> Column:
    return _listing(value, LEAD_WEBSITE_RULES, LEAD_WEBSITE_ROUGH)


def is_public_business_email(value: Column) -> Column:
    """One address in the cell, and none of a platform (by its ending, without a border)."""
    email = F.lower(strip(value))
    # fixed values
    return email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & ~email.rlike(r"(?:sentry\.io|booksy\.com|fresha\.com|example\.com)$")


def is_plausible_phone(value: Column) -> Column:
    return F.length(normalize_phone(value)).between(9, 15)


def is_portuguese_phone(value: Column) -> Column:
    return normalize_phone(value).rlike(r"^(?:351[23569]\d{8}|(?!351)[23569]\d{8})$")


def is_brazilian_phone(value: Column) -> Column:
    return normalize_phone(value).rlike(r"^(?:55\d{10,11}|(?!55)\d{10,11})$")


def requested_country(geography: Column) -> Column:
    # fixed values
    return F.when(fold_text(geography).rlike(words("brasil", "brazil", "sp", "sao paulo", "braganca paulista")), "BR").otherwise("PT")


def _haystack(field: Field, names: list[str]) -> Column:
    return F.concat_ws(" ", *[blank(field(n)) for n in names])


#: Fixed values of the type rules.
BARBER_REQUEST, MEAT_REQUEST = "barbear|barber", "talh|carn"
BARBER_WORDS = ["barbearia", "barbeiro", "barber", "barbershop", "barber shop", "grooming"]
HAIR_WORDS = ["cabeleireir", "cabeleireiro", "cabeleireira", "cabeleireiros", "cabeleireiras", "estetica", "estética"]
HAIR_WORDS_SOURCE = ["cabeleireir", "cabeleireiro", "cabeleireira", "estetica", "estética"]
MEAT_WORDS = ["talho", "talhos", "butcher", "butcher shop", "carne", "carnes"]


def asks_for_barber(lead_type: Column) -> Column:
    """Whether ``matches_type`` looks for barbers; all other requests take every type."""
    requested = normalize_text(lead_type)
    return ~requested.isin("", "leads") & requested.rlike(BARBER_REQUEST)


def matches_type(lead_type: Column, field: Field = F.col) -> Column:
    """The rule for consolidated rows."""
    requested = normalize_text(lead_type)
    hay = normalize_text(_haystack(field, ["name", "website", "socials", "notes"]))
    barber = hay.rlike(words(*BARBER_WORDS)) & ~hay.rlike(words(*HAIR_WORDS))
    return F.when(requested.isin("", "leads"), True).when(requested.rlike(BARBER_REQUEST), barber).otherwise(True)


def matches_type_at_source(lead_type: Column, field: Field = F.col) -> Column:
    """The rule for rows just extracted: sources count too, and meat has a rule."""
    requested = normalize_text(lead_type)
    hay = normalize_text(_haystack(field, ["name", "website", "socials", "notes", "sources"]))
    barber = hay.rlike(words(*BARBER_WORDS)) & ~hay.rlike(words(*HAIR_WORDS_SOURCE))
    return F.when(requested.isin("", "leads"), True).when(requested.rlike(BARBER_REQUEST), barber).when(requested.rlike(MEAT_REQUEST), hay.rlike(words(*MEAT_WORDS))).otherwise(True)


def matches_type_in_directory(lead_type: Column, field: Field = F.col) -> Column:
    """The rule for directory rows: parts of words count."""
    requested = fold_text(lead_type)
    hay = fold_text(_haystack(field, ["name", "search_title", "search_category", "search_description", "notes"]))
    # fixed values
    barber = ~hay.rlike("produto|associacao") & hay.rlike("barbearia|barbeiro|barber")
    return F.when(requested.rlike(BARBER_REQUEST), barber).when(requested.rlike(MEAT_REQUEST), hay.rlike("talho|carne")).otherwise(True)


def _in_place(geography: Column, names: list[str], field: Field) -> Column:
    requested = fold_text(geography)
    return requested.isin("", "portugal") | F.contains(fold_text(_haystack(field, names)), requested)


_PLACE_FIELDS = ["locality", "district", "name", "website", "socials"]


def place_haystack(field: Field = F.col) -> Column:
    """The text in which ``matches_geography`` looks for a place."""
    return fold_text(_haystack(field, _PLACE_FIELDS))


def matches_geography(geography: Column, field: Field = F.col) -> Column:
    return _in_place(geography, _PLACE_FIELDS, field)


def matches_geography_in_directory(geography: Column, field: Field = F.col) -> Column:
    return _in_place(geography, ["name", "locality", "district", "search_title", "search_address", "search_description"], field)


def looks_like_search_portal(field: Field = F.col) -> Column:
    hay = fold_text(_haystack(field, ["name", "website", "socials", "email", "notes", "sources"]))
    # fixed values
    return hay.rlike(words("yahoo", r"example@email\.com"))


def is_category_page(name: Column) -> Column:
    # fixed values
    return fold_text(name).rlike(rf"^barbearias?\s+em{END}|onde cortar")


def is_country_wide(geography: Column) -> Column:
    # fixed values
    return fold_text(geography).isin("portugal", "portugal continental", "pt", "pt-pt")


def is_temporary_block(error: Column) -> Column:
    return blank(error).rlike("(?i)HTTP 429")


def classify_error(error: Column) -> Column:
    text = blank(error)
    # fixed values
    return F.when(is_temporary_block(error), "motor bloqueou temporariamente (429)").when(text.rlike("(?i)HTTP 403"), "motor sem acesso publico (403)").otherwise(text)


def source_note(source_type: Column) -> Column:
    # fixed values
    return F.when(source_type == "maps", "Fonte Maps").when(source_type == "social", "Fonte redes sociais").when(source_type == "directories", "Fonte diretórios").when(source_type == "free", "Fonte livre").otherwise("Fonte web")
