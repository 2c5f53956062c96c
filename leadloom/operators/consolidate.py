"""Consolidation: conform, gate, validate and merge the contact rows of many sources.

Rows have the nine text columns of ``FIELDS`` and an order ``seq``, a struct that
sorts as the sources do.  ``by`` names columns that keep runs apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.predicates import (
    asks_for_barber,
    is_category_page,
    is_generic_listing_url,
    is_plausible_phone,
    is_public_business_email,
    looks_like_search_portal,
    matches_geography,
    matches_type,
    place_haystack,
)
from leadloom.functions.text import blank, clean_spaces, fold_text, join_full, normalize_phone, normalize_text, or_null, split_tokens, strip
from leadloom.functions.urls import normalize_domain

from .barrier import computed_once

FIELDS = ["name", "website", "socials", "email", "phone", "locality", "district", "sources", "notes"]
#: Header of the exchanged files, and the headers read as each field, first choice first.
HEADER = {
    "name": "Nome", "website": "Pagina web", "socials": "Redes sociais", "email": "Email", "phone": "Telefone",
    "locality": "Localidade", "district": "Distrito", "sources": "Fontes consultadas", "notes": "Observacoes",
}
ALIASES = {
    "name": ["Nome", "Name"],
    "website": ["Pagina web", "Website", "Site", "Página web"],
    "socials": ["Redes sociais", "Facebook", "Instagram", "Social", "Redes"],
    "email": ["Email", "E-mail", "E mail"],
    "phone": ["Telefone", "Phone", "Telemóvel", "Telemovel"],
    "locality": ["Localidade", "Cidade", "City"],
    "district": ["Distrito", "Região", "Regiao", "Region"],
    "sources": ["Fontes consultadas", "Fontes", "Sources"],
    "notes": ["Observacoes", "Observações", "Notas", "Notes"],
}
SOCIAL_DOMAINS = ["facebook.com", "instagram.com", "tiktok.com", "linkedin.com", "youtube.com", "x.com", "twitter.com"]
SOCIAL_BLOCKED = ["getbarberhead", "barberheadcom", "frizurd", "paginasamarelas", "pai.pt", "fresha", "booksy", "shedul", "heyfresha"]
LISTING_NOTE = "Pagina web removida por ser uma listagem generica."
NO_REVIEWER = "Validador AI indisponível; validação local aplicada."
NO_NAME, NO_CONTACT = "Sem nome.", "Sem contacto público."
CATEGORY_PAGE = "Página de categoria/listagem, não é uma lead."
SEARCH_PORTAL = "Resultado de portal/motor de busca, não é uma lead."


def as_column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def coalesce_aliases(df: DataFrame) -> DataFrame:
    """Add the nine fields: of each, the first header alias with a value.  Other columns stay."""
    present = {c: f"`{c}`" for c in df.columns}
    fields = {f: F.coalesce(*[or_null(strip(F.col(present[a]))) for a in aliases if a in present], F.lit("")) for f, aliases in ALIASES.items()}
    kept = [F.col(p) for c, p in present.items() if c not in FIELDS and c.lower() not in FIELDS]
    return df.select(*kept, *[c.alias(f) for f, c in fields.items()])


def conform_columns(df: DataFrame, columns: str) -> DataFrame:
    """Project to a ``;`` list of columns; missing ones are empty."""
    wanted = [c.strip() for c in columns.split(";") if c.strip()]
    return df.select(*[strip(F.col(f"`{c}`")).alias(c) if c in df.columns else F.lit("").alias(c) for c in wanted])


def sanitize_social_links(c: Column) -> Column:
    """Distinct links to social networks, in order; platform profiles go."""

    def holds(part: Column, markers: list[str]) -> Column:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.lower(part).contains(m)
        return hit

    parts = F.filter(split_tokens(c), lambda p: holds(p, SOCIAL_DOMAINS) & ~holds(p, SOCIAL_BLOCKED))
    return F.array_join(F.array_distinct(parts), " | ")


def conform(df: DataFrame) -> DataFrame:
    """Trim the fields, keep social links only, and demote listing websites to sources (``cleared``)."""
    df = df.withColumns({f: strip(F.col(f)) for f in FIELDS})
    df = df.withColumns({"socials": sanitize_social_links(F.col("socials")), "cleared": is_generic_listing_url(F.col("website"))})
    cleared = F.col("cleared")
    return df.withColumns(
        {
            "sources": F.when(cleared, join_full(" | ", F.col("sources"), F.col("website"))).otherwise(F.col("sources")),
            "notes": F.when(cleared, join_full(" | ", F.col("notes"), F.lit(LISTING_NOTE))).otherwise(F.col("notes")),
            "website": F.when(cleared, "").otherwise(F.col("website")),
        }
    )


def merge_key(field=F.col, check_listing: bool = True) -> Column:
    """The key under which rows are one business: e-mail, else phone, else website, else social profile, else name and place."""
    name = normalize_text(field("name"))
    website, socials = normalize_domain(field("website")), normalize_domain(field("socials"))
    if check_listing:
        website = F.when(~is_generic_listing_url(field("website")), website)
    return F.coalesce(
        F.concat(F.lit("email:"), or_null(normalize_text(field("email")))),
        F.concat(F.lit("phone:"), or_null(normalize_phone(field("phone")))),
        F.concat(F.lit("web:"), or_null(website), F.lit("|"), name),
        F.concat(F.lit("social:"), or_null(socials), F.lit("|"), name),
        join_full("|", name, normalize_text(field("locality")), normalize_text(field("district"))),
    )


def directory_key(field=F.col) -> Column:
    """The key of directory rows: whole website address, no social profile, no district."""
    name, email, website, locality = (F.lower(clean_spaces(field(f))) for f in ("name", "email", "website", "locality"))
    return F.coalesce(
        F.concat(F.lit("email:"), or_null(email)),
        F.concat(F.lit("phone:"), or_null(normalize_phone(field("phone")))),
        F.concat(F.lit("website:"), or_null(website), F.lit("|"), name),
        join_full("|", name, locality),
    )


def gate(df: DataFrame, lead_type: Column | str, geography: Column | str) -> DataFrame:
    """Add ``skip_reason``: no_contact, no_name, wrong_type (also of place) or null."""
    lead_type, geography = as_column(lead_type), as_column(geography)
    reason = (
        F.when((F.col("email") == "") & (F.col("phone") == ""), "no_contact")
        .when(F.col("name") == "", "no_name")
        .when(~matches_type(lead_type), "wrong_type")
        .when(~matches_geography(geography), "wrong_type")
    )
    return df.withColumn("skip_reason", reason)


def candidates(leads: DataFrame, lead_type: Column | str, geography: Column | str) -> DataFrame:
    """Conformed rows with ``skip_reason`` and, for those that pass, ``cache_key``."""
    lead_type, geography = as_column(lead_type), as_column(geography)
    gated = computed_once(gate(computed_once(conform(leads)), lead_type, geography))
    # conform has blanked listing websites
    key = F.concat_ws("|", merge_key(check_listing=False), normalize_text(lead_type), fold_text(geography))
    return gated.withColumn("cache_key", F.when(F.col("skip_reason").isNull(), key))


def validate(df: DataFrame) -> DataFrame:
    """Local rules on each row: clear bad phones and e-mails, then ``approved`` and ``reason``."""
    df = df.withColumns(
        {
            "phone": F.when(is_plausible_phone(F.col("phone")), F.col("phone")).otherwise(""),
            "email": F.when(is_public_business_email(F.col("email")), F.col("email")).otherwise(""),
        }
    )
    reason = (
        F.when(strip(F.col("name")) == "", NO_NAME)
        .when((F.col("email") == "") & (F.col("phone") == ""), NO_CONTACT)
        .when(is_category_page(F.col("name")), CATEGORY_PAGE)
        .when(looks_like_search_portal(), SEARCH_PORTAL)
    )
    return df.withColumns({"approved": reason.isNull(), "reason": F.coalesce(reason, F.lit(NO_REVIEWER))})


def verdict_per_key(passed: DataFrame, by: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """One row per ``cache_key``: the last row of the key, its place (the first), and how many it stands for.

    The last row decides for the whole key, so its copies need no merging; sums
    and extremes combine before the shuffle, however hot the key.
    """
    row = F.struct(*FIELDS)
    found = passed.groupBy(*by, "cache_key").agg(F.max_by(row, seq).alias("r"), F.min(seq).alias("seq"), F.count(F.lit(1)).alias("n"))
    return found.select(*by, "cache_key", "r.*", "seq", "n")


def apply_verdicts(validated: DataFrame, verdicts: DataFrame | None, pending: bool = False) -> DataFrame:
    """Overlay outside verdicts (cache_key, approved, reason, normalized) on locally approved rows.

    Non-blank normalized values replace fields; keys without a verdict stay as
    they are, or wait (``pending``).
    """
    if verdicts is None:
        return validated.withColumn("pending", F.lit(False))
    v = verdicts.select("cache_key", F.col("approved").alias("_approved"), F.col("reason").alias("_reason"), F.col("normalized").alias("_normalized"))
    joined = validated.join(v, "cache_key", "left")
    judged = F.col("approved") & F.col("_approved").isNotNull()
    fields = {f: F.when(judged & F.col("_approved"), F.coalesce(or_null(strip(F.coalesce(F.col("_normalized")[HEADER[f]], F.col("_normalized")[f]))), F.col(f))).otherwise(F.col(f)) for f in FIELDS}
    default = F.when(F.col("_approved"), "Aprovada pela IA.").otherwise("Rejeitada pela IA.")  # fixed values
    reason = F.when(judged, F.coalesce(or_null(strip(F.col("_reason"))), default)).otherwise(F.col("reason"))
    wait = F.col("approved") & F.col("_approved").isNull() & F.lit(pending)
    return joined.withColumns(fields | {"reason": reason, "pending": wait, "approved": F.when(judged, F.col("_approved")).otherwise(F.col("approved"))}).drop("_approved", "_reason", "_normalized")


def pending_keys(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows whose cache_key has no verdict yet."""
    return keyed.join(verdicts.select("cache_key").distinct(), "cache_key", "left_anti")


LISTS = ("sources", "notes")


def merge_state(df: DataFrame, by: Sequence[str] = (), key: str = "merge_key", seq: str = "seq", weight: str = "n") -> DataFrame:
    """What a merge has to know, as one aggregation over one pass; also the state of the streaming merge.

    A row for each key with the first value of each field, and one for each
    distinct (key, field, part) of sources and notes with its first place, so a
    hot key takes as many rows as it has distinct parts.
    """
    head = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("part"), F.lit(0).alias("pos")))

    def parts(f: str) -> Column:
        found = F.transform(split_tokens(F.col(f)), lambda x, i: F.struct(F.lit(f).alias("field"), x.alias("part"), i.alias("pos")))
        return F.coalesce(found, F.slice(head, 1, 0))

    spread = df.select(*by, key, *FIELDS, seq, weight, F.explode(F.concat(head, *map(parts, LISTS))).alias("_p"))
    of_key = F.col("_p.field") == ""
    value = {f: F.when(of_key & (F.col(f) != ""), F.col(f)) for f in FIELDS}
    firsts = [F.min_by(value[f], F.when(value[f].isNotNull(), F.col(seq))).alias(f) for f in FIELDS]
    same = [(F.min(value[f]) == F.max(value[f])).alias(f"_same_{f}") for f in LISTS]
    place = F.min(F.struct(F.col(seq).alias("seq"), F.col("_p.pos").alias("pos"))).alias("_ord")
    return spread.groupBy(*by, key, F.col("_p.field").alias("_field"), F.col("_p.part").alias("_part")).agg(*firsts, *same, place, F.sum(weight).alias("n"))


def merged_rows(state: DataFrame, by: Sequence[str] = (), key: str = "merge_key") -> DataFrame:
    """One row per key of the state of ``merge_state``, which is read once."""
    of_key = F.struct(*FIELDS, *[f"_same_{f}" for f in LISTS], F.col("_ord.seq").alias("seq"), "n")
    found = [F.collect_list(F.when(F.col("_field") == f, F.struct("_ord", "_part"))).alias(f"_list_{f}") for f in LISTS]
    grouped = state.groupBy(*by, key).agg(F.first(F.when(F.col("_field") == "", of_key), ignorenulls=True).alias("h"), *found)

    def union(f: str) -> Column:
        joined = F.array_join(F.transform(F.array_sort(f"_list_{f}"), lambda x: x["_part"]), " | ")
        return F.when(F.coalesce(F.col(f"h._same_{f}"), F.lit(True)), blank(F.col(f"h.{f}"))).otherwise(joined).alias(f)

    scalars = [blank(F.col(f"h.{f}")).alias(f) for f in FIELDS if f not in LISTS]
    return grouped.select(*by, key, *scalars, *map(union, LISTS), "h.seq", "h.n")


def merge_leads(df: DataFrame, by: Sequence[str] = (), key: str = "merge_key", seq: str = "seq", weight: str = "n") -> DataFrame:
    """One row per key: of each field the first value by ``seq``, of sources and notes the ordered union of their parts.

    If all values of a field are equal the text stays as it is.
    """
    return merged_rows(merge_state(df, by, key, seq, weight), by, key)


def approved_rows(found: DataFrame, verdicts: DataFrame | None = None, pending: bool = False) -> DataFrame:
    """Validated rows with verdicts, the reason in the notes of the approved, and ``merge_key``."""
    judged = apply_verdicts(computed_once(validate(found)), verdicts, pending)
    noted = judged.withColumn("notes", F.when(F.col("approved"), join_full(" | ", F.col("notes"), F.col("reason"))).otherwise(F.col("notes")))
    # only a verdict can bring a listing website back
    return computed_once(noted.withColumn("merge_key", F.when(F.col("approved") & ~F.col("pending"), merge_key(check_listing=verdicts is not None))))


def judged_rows(leads: DataFrame, lead_type: Column | str, geography: Column | str, by: Sequence[str] = (), verdicts: DataFrame | None = None, verdict_scope: str = "key", pending: bool = False) -> DataFrame:
    """Candidates that passed the gate, judged per key (the last row of a key stands for all) or per row."""
    passed = candidates(leads, lead_type, geography).where("skip_reason is null")
    if verdict_scope == "key":
        passed = verdict_per_key(passed, by)
    elif verdict_scope == "row":
        passed = passed.select(*by, "cache_key", *FIELDS, "seq").withColumn("n", F.lit(1).cast("long"))
    else:
        raise ValueError("verdict_scope is 'key' or 'row'")
    return approved_rows(passed, verdicts, pending)


def limit_rows(df: DataFrame, limit: int | float | None) -> DataFrame:
    """The first rows by ``seq``: all without a finite limit, none with a negative one."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")):
        return df
    return df.orderBy("seq").limit(max(0, int(limit)))


def consolidate(leads: DataFrame, lead_type: Column | str, geography: Column | str, by: Sequence[str] = (), verdicts: DataFrame | None = None, verdict_scope: str = "key", pending: bool = False, limit: int | None = None) -> DataFrame:
    """Merged contacts: the nine fields, ``merge_key``, ``seq`` (first appearance) and ``n`` (rows merged)."""
    judged = judged_rows(leads, lead_type, geography, by, verdicts, verdict_scope, pending)
    return limit_rows(merge_leads(judged.where("merge_key is not null"), by), limit)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All source tables one below the other; missing columns are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def funnel_stats(leads: DataFrame, lead_type: Column | str, geography: Column | str, by: Sequence[str] = (), verdicts: DataFrame | None = None, verdict_scope: str = "key", pending: bool = False, limit: int | None = None) -> DataFrame:
    """The funnel's counters; they add up to the input: skipped, pending, rejected, errors, duplicates and valid.

    One pass: skipped rows ride along as one group for each reason.
    """
    gated = candidates(leads, lead_type, geography)
    if verdict_scope == "key":
        row = F.struct(*FIELDS)
        found = gated.groupBy(*by, "skip_reason", "cache_key").agg(F.max_by(row, "seq").alias("r"), F.count(F.lit(1)).alias("n"), F.count_if("cleared").alias("_cleared"))
        found = found.select(*by, "skip_reason", "cache_key", "r.*", "n", "_cleared")
    elif verdict_scope == "row":
        found = gated.select(*by, "skip_reason", "cache_key", *FIELDS, F.lit(1).cast("long").alias("n"), F.col("cleared").cast("long").alias("_cleared"))
    else:
        raise ValueError("verdict_scope is 'key' or 'row'")
    judged = approved_rows(found, verdicts, pending)
    passed = F.col("skip_reason").isNull()
    key = F.when(passed, F.col("merge_key"))
    waiting = F.when(passed & F.col("pending"), F.col("n")).otherwise(0)
    per_key = judged.groupBy(*by, "skip_reason", key.alias("merge_key")).agg(F.sum("n").alias("n"), F.sum(waiting).alias("waiting"), F.sum("_cleared").alias("cleared"))
    good = F.col("merge_key").isNotNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0).cast("long"))

    def skipped(reason: str) -> Column:
        return total(F.when(F.col("skip_reason") == reason, F.col("n")))

    counts = per_key.groupBy(*by).agg(
        total(F.col("cleared")).alias("clearedGenericWebsite"),
        skipped("no_contact").alias("skippedNoContact"),
        skipped("no_name").alias("skippedNoName"),
        skipped("wrong_type").alias("skippedWrongType"),
        total(F.col("waiting")).alias("pendingValidation"),
        total(F.when(passed & ~good, F.col("n") - F.col("waiting"))).alias("rejectedByValidation"),
        F.lit(0).cast("long").alias("validationErrors"),
        total(F.when(good, F.col("n") - 1)).alias("duplicates"),
        F.count_if(good).alias("totalValid"),
    )
    kept = F.col("totalValid") if limit is None else F.least(F.col("totalValid"), F.lit(max(0, limit)).cast("long"))
    return counts.withColumn("kept", kept)


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of ``n`` letters of a text of at least so many."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(last > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def places_met(hays: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct texts (``_hay``) with the places (``_place``) that they may name.

    An inverted index: a place is looked up by the one of its runs of three
    letters (of its own, if it is shorter) that the fewest texts hold, which is
    counted.  A place with a run that no text holds meets none.
    """
    of_place = places.select("_place", F.explode(_grams(F.col("_place"), F.least(F.lit(3), F.length("_place")))).alias("_gram"))
    of_text = hays.select("_hay", F.explode(F.concat(*[_grams(F.col("_hay"), n) for n in (1, 2, 3)])).alias("_gram"))
    held = of_text.join(of_place.select("_gram").distinct(), "_gram", "left_semi")
    counted = of_place.join(held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")), "_gram", "left")
    rarest = counted.groupBy("_place").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
    return held.join(rarest.where("_r.n > 0").select("_place", F.col("_r.gram").alias("_gram")), "_gram").select("_hay", "_place")


def match_requests(leads: DataFrame, requests: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows of ``leads`` for each request (run_id, lead_type, geography) that they satisfy.

    A request asks for any type or for barbers, and for any place or for one that
    a row must name.  The types that a row fits and the places that it names are
    found once per row and joined to the requests as keys.  Distinct places are
    looked for in every row if there are ``most`` or fewer, which is counted;
    beyond that each text meets the places whose rarest letters it holds.
    """
    barber = F.lit("barber")
    place = fold_text(F.col("geography"))
    wanted = requests.select("run_id", F.when(asks_for_barber(F.col("lead_type")), barber).otherwise("any").alias("_type"), F.when(place.isin("", "portugal"), "").otherwise(place).alias("_place"))
    fits = F.when(matches_type(barber), F.array(F.lit("any"), barber)).otherwise(F.array(F.lit("any")))
    rows = computed_once(leads.select("*", fits.alias("_fits"), place_haystack().alias("_hay")))
    places = wanted.where("_place <> ''").select("_place").distinct()
    if places.limit(most + 1).count() <= most:
        all_places = places.agg(F.collect_list("_place").alias("_all"))  # one row of checked size
        named = F.filter("_all", lambda p: F.contains(F.col("_hay"), p))
        met = rows.crossJoin(F.broadcast(all_places)).withColumn("_place", F.explode(F.concat(F.array(F.lit("")), named))).drop("_all")
    else:
        pairs = places_met(rows.select("_hay").distinct(), places).where(F.contains("_hay", "_place"))
        named = rows.join(pairs.select("_hay", "_place"), "_hay").select(*rows.columns, "_place")
        met = named.unionByName(rows.withColumn("_place", F.lit("")))
    typed = met.withColumn("_type", F.explode("_fits"))
    return typed.join(wanted, ["_type", "_place"]).drop("_type", "_place", "_fits", "_hay")
