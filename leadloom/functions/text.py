"""Text functions over columns.  Null counts as the empty string throughout."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a Java character class body: all Unicode spaces and the byte-order mark.
WS = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same, each character.
WS_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: ASCII word borders (Java's \b also counts accented letters as parts of words).
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(blank(c), F.lit(WS_CHARACTERS))


def or_null(c: Column) -> Column:
    """The column without its blank values."""
    return F.nullif(c, F.lit(""))


def join_full(separator: str, *parts: Column) -> Column:
    """The parts that are not empty, joined."""
    return F.concat_ws(separator, *[or_null(p) for p in parts])


def clean_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"[{WS}]+", " ")


def normalize_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"[{WS}]+", " ")


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Letters with accents and their bases, followed by the bare accents (which go)."""
    source, target = [], []
    for cp in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(cp))
        base = "".join(p for p in parts if not "\u0300" <= p <= "\u036F")
        if len(parts) > 1 and len(base) == 1:
            source.append(chr(cp))
            target.append(base)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


def fold(c: Column) -> Column:
    """Letters without accents; ASCII texts have none and are left as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, *fold_table()))


def fold_text(c: Column) -> Column:
    return fold(normalize_text(c))


def normalize_phone(c: Column) -> Column:
    return F.regexp_replace(blank(c), "[^0-9]", "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.lower(strip(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def title_from_slug(c: Column) -> Column:
    """Words of a URL segment in title case, without file endings and place names."""
    # fixed values
    places = "pt|pt-pt|portugal|braganca|lisboa|porto|coimbra|faro|setubal|aveiro|viseu"
    parts = F.split(F.regexp_replace(blank(c), r"(?i)\.(html?|php)$", ""), "[-_]+")
    kept = F.filter(parts, lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{places})$"))
    return strip(F.array_join(F.transform(kept, capitalized), " "))


def html_decode(c: Column) -> Column:
    """The six common entities, one after the other."""
    out = blank(c)
    # fixed values
    for entity, character in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.regexp_replace(out, f"(?i){entity}", character)
    return out


def strip_tags(c: Column) -> Column:
    out = F.regexp_replace(blank(c), r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return html_decode(strip(F.regexp_replace(out, f"[{WS}]+", " ")))


def decode_url(c: Column) -> Column:
    """Percent and plus decoding; malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(blank(c)), blank(c))


def encode_uri_component(c: Column) -> Column:
    out = F.replace(F.url_encode(blank(c)), F.lit("+"), F.lit("%20"))
    for code, character in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(character))
    return out


def split_words(c: Column) -> Column:
    return F.filter(F.split(blank(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_tokens(c: Column) -> Column:
    """Trimmed, non-blank parts of a cell that holds several values."""
    return F.filter(F.transform(F.split(blank(c), r" [|] "), strip), lambda x: x != "")
