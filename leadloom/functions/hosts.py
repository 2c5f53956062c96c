"""Host names as a URL parser writes them: international labels in ASCII, numbers as dotted addresses."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

#: Other dots, and characters that count for nothing.
DOTS, IGNORED = "\u3002\uFF0E\uFF61", "\u00AD\u200B\u2060\uFEFF" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Characters that no host holds once it is decoded.
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]")
_NUMBER = re.compile(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")


def ascii_host(host: str) -> str | None:
    """The host as it is looked up; None if no host can be spelled so.

    Percent codes are decoded, letters become small and are put together with
    their accents, labels with other characters get their ``xn--`` form, and a
    host that ends in a number (decimal, octal or hexadecimal) becomes a dotted
    address.  Labels that are in ``xn--`` form already are not checked.
    """
    try:
        text = "".join(c.lower() for c in unquote(host, errors="strict") if c not in IGNORED)
        text = unicodedata.normalize("NFKC", text).translate(dict.fromkeys(map(ord, DOTS), "."))
        labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in text.lower().split(".")]
    except UnicodeError:
        return None
    out = ".".join(labels)
    if not out or _FORBIDDEN.search(out):
        return None
    return _dotted(out.removesuffix(".").split(".")) if _NUMBER.search(out) else out


def _dotted(parts: list[str]) -> str | None:
    try:
        values = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8 if len(p) > 1 and p[0] == "0" else 10) for p in parts]
    except ValueError:
        return None
    if len(values) > 4 or max(values[:-1], default=0) > 255 or values[-1] >= 256 ** (5 - len(values)) or not all(p.isalnum() for p in parts):
        return None
    total = values[-1] + sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1]))
    return ".".join(str(total >> s & 255) for s in (24, 16, 8, 0))
