"""URL functions over built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, squeeze, text, title_from_slug

# fixed values: query parameters that only track
TRACKING = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "utm_id",
    "fbclid",
    "gclid",
    "msclkid",
    "mc_cid",
    "mc_eid",
)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column | str, n: int) -> Column:
    return F.regexp_extract(clean(url), _PARTS, n)


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column | str) -> Column:
    return F.lower(part(url, 2))


def path(url: Column | str) -> Column:
    return part(url, 3)


def query(url: Column | str) -> Column:
    return part(url, 4)


def host(url: Column | str) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def domain(url: Column | str) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def absolute(url: Column | str, base: Column | str) -> Column:
    """A link made absolute against the page it stands on."""
    u, b = clean(url), clean(base)
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    folder = F.regexp_replace(path(b), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = F.concat(root, folder, u)
    return (
        F.when(u == "", b)
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), u)
        .when(b == "", u)
        .when(u.startswith("//"), F.concat(scheme(b), F.lit(":"), u))
        .when(u.startswith("/"), F.concat(root, u))
        .when(u.startswith("?"), F.concat(root, path(b), u))
        .when(u.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), u))
        .otherwise(_without_dots(joined))
    )


def _without_dots(url: Column) -> Column:
    """./ removed and folder/../ resolved, a few levels deep."""
    out = F.regexp_replace(url, r"/(?:\./)+", "/")
    for _ in range(4):
        out = F.regexp_replace(out, r"(?<=[^:/])/[^/]+/\.\./", "/")
    return out


def canonical(url: Column | str, tracking: Sequence[str] = TRACKING) -> Column:
    """Scheme (https if none) and host in lower case, single slashes, no slash at the end, no
    tracking parameters, the other parameters sorted, no fragment."""
    p = F.regexp_replace(path(url), "/{2,}", "/")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    pairs = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*tracking))
    pairs = F.array_sort(F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("=")))))
    q = F.array_join(pairs, "&")
    s = F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url))
    return F.concat(s, F.lit("://"), netloc(url), p, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def plain(url: Column | str) -> Column:
    """The laxer form of registries: without www, click ids and utm parameters; parameters keep their order."""
    skip = lambda x: F.lower(x).rlike("^(utm_|fbclid|gclid|mc_cid|mc_eid)") | ~x.rlike("=.")
    q = F.array_join(F.filter(F.split(query(url), "&"), lambda x: ~skip(x)), "&")
    body = F.concat(F.regexp_replace(netloc(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    head = F.when((scheme(url) == "") & (netloc(url) == ""), F.lit("")).when(scheme(url) == "", F.lit("//")).otherwise(F.concat(scheme(url), F.lit("://")))
    return F.concat(head, body)


def same_site(a: Column | str, b: Column | str) -> Column:
    """Whether one host is the other or a subdomain of it (www aside)."""
    x, y = domain(a), domain(b)
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def below(base: Column | str, url: Column | str) -> Column:
    """Whether a link stays on the host of its page or goes to a subdomain of it (www aside); no host stays."""
    x, y = domain(base), domain(url)
    return (x == "") | (y == "") | (x == y) | y.endswith(F.concat(F.lit("."), x))


def file_title(url: Column | str) -> Column:
    """A title from a file's name; from the last part of the path as a slug where that is short."""
    name = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    name = F.regexp_replace(F.try_url_decode(name), r"(?i)\.(pdf|html?|aspx?)$", "")
    name = squeeze(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), r"\bBB\b", ""))
    return F.when(F.length(name) < 20, title_from_slug(url)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20)))


def within(url: Column | str, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below it."""
    h = domain(url)
    ok = F.lit(False)
    for d in domains:
        ok = ok | (h == d) | h.endswith("." + d)
    return ok


def allowed(url: Column | str, domains: Sequence[str]) -> Column:
    """https, no user, port 443 or none, and a host within the domains."""
    loc = netloc(url)
    port = F.regexp_extract(loc, r":(\d+)$", 1)
    return (scheme(url) == "https") & ~loc.contains("@") & port.isin("", "443") & within(url, domains)


def public_target(url: Column | str) -> Column:
    """The checks of a safe fetch that need no network: http(s), usual ports, no private address."""
    h, port = host(url), F.regexp_extract(netloc(url), r":(\d+)$", 1)
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[)") | h.rlike(r"\.(local|internal)$")
    return scheme(url).isin("http", "https") & (h != "") & ~private & port.isin("", "80", "443")


def kind(url: Column | str) -> Column:
    """search, listing root, or item: by query and depth of the path."""
    p = F.regexp_replace(path(url), "/+$", "")
    return (
        F.when(F.lower(query(url)).rlike(r"(^|&)(q|s|query|search)=") | F.lower(p).rlike(r"/search(/|$)"), "search")
        .when(p == "", "root")
        .when(F.size(F.split(p, "/")) <= 2, "listing")
        .otherwise("item")
    )


def dated(url: Column | str) -> Column:
    """The date in a path or query such as /2026/05/12/; null if there is none or it is not a date."""
    where = F.concat_ws(" ", path(url), query(url))
    p = r"(?:/|-|_)(20\d{2})(?:/|-|_)(\d{1,2})(?:/|-|_)(\d{1,2})(?:/|-|_|$| )"
    y, m, d = (F.regexp_extract(where, p, i) for i in (1, 2, 3))
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def first_http(*columns: Column | str) -> Column:
    """The first of the columns that is an http(s) url."""
    return F.coalesce(*[F.when(text(c).rlike("^https?://"), text(c)) for c in columns])
