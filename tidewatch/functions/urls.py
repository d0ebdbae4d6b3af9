"""URLs: canonical form for comparison, import check, listing ids.

Plain ASCII URLs are handled by column expressions.  The rest (international
hosts, characters that need percent-encoding, dot segments, repeated "=") goes
through one Arrow-batched helper, which receives NULL for every plain URL.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.constants import TRACKING_PARAMS
from tidewatch.functions.text import strip

# Every "/" opens the next repetition, so a mismatch is found without backtracking.
_PLAIN = (
    r"^(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"
    r"(?:/[A-Za-z0-9_.~!$&()*+,;=:@-]*+)*+"
    r"(?:\?[A-Za-z0-9_.*-]*+(?:=[A-Za-z0-9_.*-]*+)?(?:&[A-Za-z0-9_.*-]*+(?:=[A-Za-z0-9_.*-]*+)?)*+)?"
    r"(?:#[A-Za-z0-9_.~!$&()*+,;=:@/?-]*+)?$"
)
# Dot segments and all-numeric hosts need more than string surgery.
_SPECIAL = r"(?:/\.{1,2}(?:[/?#]|$))|(?:^[A-Za-z]+://[0-9.]+(?:[:/?#]|$))"
_PARTS = r"^([A-Za-z]+)://([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ROOM = r"(?i)/rooms/(?:[a-z0-9_-]+/)?([0-9]+)(?:[/?#]|$)"
ROOM_PARAMETER = r"(?i)[?&](?:listing_id|room_id|id)=([0-9]+)"
_PATH_SAFE = "/!$&'()*+,;=:@~%-._|[]^"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _resolve_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _canonical(text: str, strip_tracking: bool) -> str | None:
    text = re.sub(r"[\t\r\n]", "", text)
    match = re.match(r"(?i)^(https?):[/\\]*(.*)$", text, re.S)
    if not match:
        return None
    scheme, rest = match[1].lower(), match[2]
    head, *tail = re.split(r"(?=[?#])", rest, maxsplit=1)
    head = head.replace("\\", "/")
    try:
        parts = urlsplit(f"{scheme}://{head}{tail[0] if tail else ''}")
        host, port = parts.hostname or "", parts.port
        if not host.isascii():
            host = host.encode("idna").decode("ascii")
    except (ValueError, UnicodeError):
        return None
    if not host or re.search(r"[\s<>^|%]", host):
        return None
    user = parts.netloc.rpartition("@")[0]
    shown = "" if port in (None, {"http": 80, "https": 443}[scheme]) else f":{port}"
    path = _resolve_dots(quote(parts.path or "/", safe=_PATH_SAFE))
    query, fragment = parts.query, parts.fragment
    if strip_tracking:
        pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True)
                 if not (k.lower().startswith("utm_") or k.lower() in TRACKING_PARAMS)]
        query = urlencode(sorted(pairs), safe="*").replace("~", "%7E")
        fragment = ""
        if len(path) > 1:
            path = path.rstrip("/") or "/"
    else:
        query = quote(query, safe="/?:@!$&()*+,;=~%-._|[]{}^`\\")
        fragment = quote(fragment, safe="/?:@!$&'()*+,;=~%-._|[]{}^#")
    return (
        f"{scheme}://{user + '@' if user else ''}{host}{shown}{path}"
        f"{'?' + query if query else ''}{'#' + fragment if fragment else ''}"
    )


@F.pandas_udf(StringType())
def _normalize_rest(values: pd.Series) -> pd.Series:
    if values.isna().all():
        return values
    return values.map(lambda v: _canonical(v, True), na_action="ignore")


@F.pandas_udf(StringType())
def _parse_rest(values: pd.Series) -> pd.Series:
    if values.isna().all():
        return values
    return values.map(lambda v: _canonical(v, False), na_action="ignore")


def _pieces(c: Column) -> dict[str, Column]:
    def part(n: int) -> Column:
        return F.regexp_extract(c, _PARTS, n)

    scheme, port = F.lower(part(1)), part(3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    shown = F.when((port == "") | default, "").otherwise(
        F.concat(F.lit(":"), port.try_cast("int").cast("string")))
    return {"base": F.concat(scheme, F.lit("://"), F.lower(part(2)), shown),
            "path": part(4), "query": part(5), "fragment": part(6)}


def normalize_url(c: Column | str) -> Column:
    """Canonical http(s) URL without tracking parameters; NULL when it is not one."""
    c = strip(c)
    piece = _pieces(c)
    pairs = F.transform(
        F.filter(F.split(piece["query"], "&"), lambda p: p != ""),
        lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"),
                           F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")),
    )
    kept = F.filter(pairs, lambda p: ~(
        F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*TRACKING_PARAMS)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(
        p["k"], F.lit("="), p["v"])), "&")
    path = F.regexp_replace(piece["path"], "/+$", "")
    built = F.concat(
        piece["base"], F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return _with_rest(c, built, _normalize_rest)


def parse_http_url(c: Column | str, trimmed: bool = False) -> Column:
    """The URL as a browser would print it, nothing removed; NULL when not http(s)."""
    c = _col(c) if trimmed else strip(c)
    piece = _pieces(c)
    built = F.concat(
        piece["base"], F.when(piece["path"] == "", "/").otherwise(piece["path"]),
        F.regexp_extract(c, r"(\?[^#]*)", 1), F.regexp_extract(c, r"(#.*)$", 1))
    return _with_rest(c, built, _parse_rest)


def _with_rest(c: Column, built: Column, rest) -> Column:
    plain = c.rlike(_PLAIN) & ~c.rlike(_SPECIAL)
    return F.when(plain, built).otherwise(rest(F.when(~plain, c)))


def listing_id_from_url(c: Column | str) -> Column:
    """Digits after /rooms/ (one segment may stand between) or an id parameter."""
    c = strip(c)
    room, param = F.regexp_extract(c, ROOM, 1), F.regexp_extract(c, ROOM_PARAMETER, 1)
    return F.coalesce(F.nullif(room, F.lit("")), F.nullif(param, F.lit("")))


def normalize_listing_id(c: Column | str) -> Column:
    return F.nullif(strip(_col(c).cast("string")), F.lit(""))
