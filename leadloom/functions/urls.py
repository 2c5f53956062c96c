"""URL functions over columns."""

from __future__ import annotations

from urllib.parse import parse_qs, quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .hosts import ascii_host
from .text import END, START, blank, decode_url, or_null, strip, title_from_slug

#: What stands before a host, and the host as it is written.
_BEFORE, _RAW = r"^https?:[/\\]*(?:[^/?#\\]*@)?", r"([^/?#\\:@]*)(?::\d*)?(?=[/?#\\]|$)"
_ENDS_IN_NUMBER = r"(?:[^/?#\\:@]*\.)?(?:[0-9]+|0x[0-9a-f]*)\.?(?:[:/?#\\]|$)"
#: A host as it is written, without characters that none holds.
_WRITTEN = _BEFORE + r"([^/?#\\:@\x00-\x20%<>\[\]^|\x7F]*)(?::\d*)?(?=[/?#\\]|$)"
_WRITTEN_BARE = _WRITTEN.replace("*@)?(", r"*@)?(?:www\.)?(")
#: A host of plain characters that is no number; and hosts that have to be spelled otherwise.
_HOST = _BEFORE + f"(?!{_ENDS_IN_NUMBER})" + r"([^/?#\\:@\x00-\x20%<>\[\]^|\x7F-\x{10FFFF}]*)(?::\d*)?(?=[/?#\\]|$)"
_ODD = _BEFORE + r"(?=[^/?#\\:@]*[%\x80-\x{10FFFF}]|" + _ENDS_IN_NUMBER + ")"
_PATH = r"^https?:[/\\]*[^/?#\\]*([^?#]*)"


def with_scheme(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "^(?!http)", "https://")


@F.pandas_udf(StringType())
def _odd_host(hosts: pd.Series) -> pd.Series:
    """Hosts that are spelled otherwise; null stays null."""
    return hosts.map(ascii_host, na_action="ignore")


def url_host(u: Column) -> Column:
    """Host of a lower-case URL as it is written; empty if the URL can't be parsed.

    Hosts of other scripts and numbers aren't spelled anew: the rules that look
    at this know ASCII names only.
    """
    return F.regexp_extract(u, _WRITTEN, 1)


def bare_host(u: Column) -> Column:
    """The host without ``www.``."""
    return F.regexp_extract(u, _WRITTEN_BARE, 1)


def ascii_url_host(u: Column) -> Column:
    """``url_host`` as a URL parser spells it: in ASCII, numbers as dotted addresses.

    Nearly all hosts are spelled so; Python sees the others only.
    """
    odd = _odd_host(F.when(u.rlike(_ODD), F.regexp_extract(u, _BEFORE + _RAW, 1)))
    return F.coalesce(or_null(F.regexp_extract(u, _HOST, 1)), odd, F.lit(""))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, _PATH, 1)


def normalize_domain(c: Column) -> Column:
    """Host without ``www.``; of several links in a cell, that of the first."""
    rough = F.regexp_extract(F.lower(strip(c)), r"^(?:https?://)?(?:www\.)?([^/?#]*)", 1)
    return F.coalesce(or_null(F.regexp_replace(ascii_url_host(with_scheme(c)), r"^www\.", "")), rough)


def is_google_maps(c: Column) -> Column:
    u = F.lower(strip(c))
    return url_host(u).rlike(r"google\.(?:com|pt)") & url_path(u).contains("maps")


def is_parsable(c: Column) -> Column:
    """Whether the text is an absolute web address."""
    return url_host(F.lower(strip(c))) != ""


def normalize_platform_name(name: Column, url: Column) -> Column:
    """A booking platform's page title gives way to the business name in its address."""
    current = strip(name)
    slug = F.try_element_at(F.filter(F.split(F.regexp_extract(blank(url), r"^https?:[/\\]*[^/?#\\]*([^?#]*)", 1), "/"), lambda p: p != ""), F.lit(-1))
    candidate = title_from_slug(slug)
    # fixed values
    platform = f"(?i)^(?:agendoor|booksy|fresha|noona){END}"
    business = f"(?i){START}(?:barbearia|barbeiro|barber|barbershop|grooming|talho|padaria){END}"
    return F.when(current.rlike(platform) & is_parsable(url) & candidate.rlike(business), candidate).otherwise(current)


def _resolved(path: str) -> str:
    """A path without dot segments."""
    out: list[str] = []
    segments = path.split("/")[1:]
    for segment in segments:
        dots = segment.lower().replace("%2e", ".")
        if dots == "..":
            del out[-1:]
        elif dots != ".":
            out.append(segment)
    if segments and segments[-1].lower().replace("%2e", ".") in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


#: Redirects and the parameters that hold their targets (fixed values).
_REDIRECTS = {("www.google.com", "/url"): ("q", "url", "uddg"), ("duckduckgo.com", "/l/"): ("uddg",), ("bing.com", "/aclick"): ("u",)}


def _clean(text: str | None) -> str:
    """A result link without the search engines' redirects around it, however many."""
    while True:
        text = (text or "").strip()
        if not text:
            return ""
        try:
            full = urljoin("https://example.com", text)
            parts = urlsplit(full)
            path = _resolved(parts.path or "/")
            web = parts.scheme in ("http", "https")
            host = ascii_host(parts.hostname or "") if web else parts.hostname or ""
            if host is None or web and any(ch in parts.hostname for ch in " <>[]^|"):
                return text
            port = "" if parts.port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{parts.port}"
        except ValueError:
            return text
        names = _REDIRECTS.get((host, path))
        if names:
            query = parse_qs(parts.query, keep_blank_values=True)
            text = next((query[n][0] for n in names if query.get(n, [""])[0]), "")
        elif "yahoo." in host and "/RU=" in path:
            text = unquote(path.split("/RU=", 1)[1].split("/", 1)[0].replace("+", " "))
        else:
            break  # each target is shorter than the link around it
    # fixed values: pages of results
    pages = (("google.", "/search"), ("bing.com", "/search"), ("duckduckgo.com", "/html/"), ("search.brave.com", "/search"), ("mojeek.com", "/search"), ("qwant.com", "/"))
    if any(h in host and path == p for h, p in pages):
        return ""
    if not web:
        return full
    safe = "%/:@!$&'()*+,;=~-._"
    out = f"{parts.scheme}://{host}{port}{quote(path, safe=safe + '[]|')}"
    if parts.query:
        out += "?" + quote(parts.query, safe=safe + "?[]{}|\\^`")
    if parts.fragment:
        out += "#" + quote(parts.fragment, safe=safe + "?#[]{}|\\^")
    return out


@F.pandas_udf(StringType())
def _clean_odd(urls: pd.Series) -> pd.Series:
    """Addresses that need decoding or encoding; null stays null."""
    return urls.map(_clean, na_action="ignore")


#: Addresses that are canonical as they stand: plain characters, no dot segments, no port, no engine that redirects.
_CANONICAL = r"^https?://(?:(?!google\.|bing\.com|duckduckgo\.com|yahoo\.|search\.brave\.com|mojeek\.com|qwant\.com)[a-z0-9.-])+/(?:(?!/\.)[A-Za-z0-9/_.~-])*(?:\?[A-Za-z0-9/_.~=&-]+)?$"


def clean_url(c: Column) -> Column:
    """Canonical address of a search result; empty for the engines' own pages.

    Most links are canonical and stay as they are; Python sees the others only.
    """
    text = blank(c)
    plain = text.rlike(_CANONICAL) & ~text.contains("/./") & ~text.contains("/../") & ~text.rlike(r"/\.{1,2}$|^https?:///|^https?://\.")
    return F.when(plain, text).otherwise(_clean_odd(F.when(~plain, text)))


def is_blocked_url(c: Column) -> Column:
    """Addresses that are no search results."""
    # fixed values
    patterns = [r"javascript:|mailto:|tel:", r"google\.(?:com|pt)/search", r"bing\.com/search", r"search\.yahoo\.com/search", r"search\.brave\.com/search", r"mojeek\.com/search", r"qwant\.com/\?q=", r"//(?:r|th|www)\.bing\.com/", r"//(?:www\.)?microsoft\.com/", r"/fd/ls/", r"duckduckgo\.com/html"]
    return F.lower(blank(c)).rlike("|".join(patterns))


def join_url(base: Column, href: Column) -> Column:
    """``href`` made absolute against the page's address; dot segments stay."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]*(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).when(href == "", base).otherwise(F.concat(folder, href))


def decoded(c: Column) -> Column:
    return or_null(decode_url(c))
