"""URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import TRACKING

_PARTS = r"^(?i)(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def is_web(url: Column) -> Column:
    return url.rlike(_PARTS)


def host(url: Column) -> Column:
    """Lower-case host with port; the empty text for other than web URLs."""
    return F.lower(F.regexp_extract(url, _PARTS, 2))


#: The insides of character classes that a path, a query and a fragment can't hold as they are.
_NO_PATH, _NO_QUERY, _NO_FRAGMENT = (rf"\x00-\x20\x7F-\x{{10FFFF}}{marks}" for marks in ("\"#<>?^`{}", "\"#<>'", "\"<>`"))
_DOTS = r"(?i)^(\.|%2e)$"
_TWO_DOTS = r"(?i)^(\.|%2e){2}$"


def _coded(text: Column, marks: str) -> Column:
    """``text`` with the characters of ``marks`` percent-coded as UTF-8; codes that stand there stay."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{marks}]|[^{marks}]+"), F.lit(0))
    one = lambda t: F.when(t.rlike(f"^[{marks}]$"), F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")).otherwise(t)
    return F.when(text.rlike(f"[{marks}]"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, plain or coded."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)

    def step(stack: Column, segment: Column) -> Column:
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment.rlike(_TWO_DOTS), shorter).when(segment.rlike(_DOTS), stack).otherwise(F.array_append(stack, segment))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    ended = F.when(last.rlike(_DOTS) | last.rlike(_TWO_DOTS), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def _form_decoded(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(url: Column) -> Column:
    """NULL for other than http and https and for hosts that can't be; else the URL in one form.

    Blanks around it, tabs and line ends go, scheme and host are lower-cased, default ports and dot segments go, what a
    part can't hold is percent-coded, and one trailing slash of a longer path goes. Parameters that only track are deleted,
    by their decoded names; a query that lost one is written again in form encoding, any other stays as it is. Host names
    beyond ASCII are lower-cased only.
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    shape = r"^(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(plain, shape, k)
    scheme = F.lower(part(1))
    user = F.regexp_extract(part(2), "^(.*@)?", 1)
    authority = F.regexp_extract(part(2), "[^@]*$", 0)
    name, port = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(authority, r":([0-9]*)$", 1).try_cast("int")
    given = F.when(port.isNotNull() & ~((scheme == "http") & (port == 80)) & ~((scheme == "https") & (port == 443)), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    good = F.coalesce(plain.rlike(shape) & authority.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20\x7F\"#%/:<>?@\[\\\]^`{|}]+)(:[0-9]*)?$") & (F.coalesce(port, F.lit(0)) <= 65535), F.lit(False))

    path = _without_dots(_coded(F.translate(part(3), "\\", "/"), _NO_PATH))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    query = F.substring(part(4), 2, 1 << 30)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    tracks = lambda p: _form_decoded(F.substring_index(p, "=", 1)).rlike(TRACKING)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    again = F.transform(F.filter(pairs, lambda p: ~tracks(p)), lambda p: F.concat(F.url_encode(_form_decoded(F.substring_index(p, "=", 1))), F.lit("="), F.url_encode(_form_decoded(value(p)))))
    rewritten = F.when(F.size(again) > 0, F.concat(F.lit("?"), F.array_join(again, "&"))).otherwise("")
    asked = F.when(F.exists(pairs, tracks), rewritten).when(part(4) == "", "").otherwise(F.concat(F.lit("?"), _coded(query, _NO_QUERY)))
    return F.when(good, F.concat(scheme, F.lit("://"), user, name, given, path, asked, _coded(part(5), _NO_FRAGMENT)))


def percent_normal(text: Column) -> Column:
    """``text`` of a URL in one percent-coding: octets that need none are decoded, other codes are in capitals, and what a URL can't hold is coded as UTF-8.

    Marks that may be separators stay as they are, coded or not, for they differ in meaning.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"%[0-9A-Fa-f]{2}|(?s:.)"), F.lit(0))

    def one(t: Column) -> Column:
        plain = F.char(F.conv(F.substring(t, 2, 2), 16, 10).cast("int"))
        coded = F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")
        return F.when((F.length(t) == 3) & plain.rlike("^[A-Za-z0-9._~-]$"), plain).when(F.length(t) == 3, F.upper(t)).when(t.rlike(r"^[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]$"), t).otherwise(coded)

    return F.array_join(F.transform(tokens, one), "")


def url_key(url: Column) -> Column:
    return F.sha2(F.lower(F.trim(url)), 256)


def source_name(explicit: Column, site: Column, url: Column) -> Column:
    """The explicit name, else the site's, else the host without a leading www., else NULL."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(explicit), blank(site), F.nullif(F.regexp_replace(host(url), r"^(?i)www\.", ""), F.lit("")))


def embed_provider(url: Column) -> Column:
    """instagram, tiktok, youtube or none, by host and path."""
    site = F.regexp_replace(host(url), r"^(www\.|m\.)", "")
    path = F.regexp_extract(url, _PARTS, 3)
    query = F.regexp_extract(url, _PARTS, 4)
    return (
        F.when((site == "instagram.com") & path.rlike(r"^/(p|reel|tv)/[^/]+"), "instagram")
        .when((site == "tiktok.com") & path.rlike(r"^/@[^/]+/video/\d+"), "tiktok")
        .when((site == "youtube.com") & ((path == "/watch") & query.rlike(r"[?&]v=[^&]+") | path.rlike(r"^/shorts/[^/]+")), "youtube")
        .when((site == "youtu.be") & path.rlike(r"^/[^/]+"), "youtube")
        .otherwise("none")
    )
