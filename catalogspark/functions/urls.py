"""URL parts, keys and classification."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col, fold

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _URL, 1))


def authority(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _URL, 2)


def host(c: Column | str) -> Column:
    """Lower-case host without credentials and port; '' when the text is no URL."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(c), "^.*@", ""), r":\d*$", ""))


def path(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _URL, 3)


def query(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _URL, 4)


def fragment(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _URL, 5)


def url_key(c: Column | str) -> Column:
    """Identity of a page: no query, no fragment, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"[?#].*$", ""), "/+$", "")


def is_safe_link(c: Column | str) -> Column:
    """https and no credentials inside the URL."""
    return F.coalesce((scheme(c) == "https") & ~authority(c).contains("@"), F.lit(False))


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on ``base``; null for other schemes such as mailto."""
    base, href = _col(base), F.trim(_col(href))
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    page = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(href.rlike(r"^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.rlike("^[?#]") | (href == ""), F.concat(page, href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


@dataclass(frozen=True)
class SitePattern:
    """URL rules of one source: which hosts are official and which paths are products or listings."""

    site: str
    hosts: str
    product: str
    listings: tuple[str, ...] = ()
    reference: str = ""


def classify_url(c: Column | str, sites: Sequence[SitePattern], require_https: bool = True) -> Column:
    """'product' / 'listing' / null. Queries and fragments are never official pages."""
    result = F.lit(None).cast("string")
    clean_url = (query(c) == "") & (fragment(c) == "")
    if require_https:
        clean_url = clean_url & (scheme(c) == "https")
    for site in reversed(sites):
        official = clean_url & host(c).rlike(f"^(?:{site.hosts})$")
        result = F.when(official & path(c).rlike(f"(?i)^(?:{site.product})$"), "product").otherwise(result)
        for listing in site.listings:
            result = F.when(official & path(c).rlike(f"(?i)^(?:{listing})$"), "listing").otherwise(result)
    return result


def url_reference(c: Column | str, sites: Sequence[SitePattern]) -> Column:
    """Reference printed in the tail of a product path, upper-case; null when the site states none."""
    result = F.lit(None).cast("string")
    for site in reversed(sites):
        found = F.regexp_extract(path(c), f"(?i){site.reference}", 1)
        hit = host(c).rlike(f"^(?:{site.hosts})$") & (found != "")
        result = F.when(hit, F.upper(found)).otherwise(result)
    return result


def search_query(brand: Column | str, reference: Column | str) -> Column:
    return F.format_string('%s "%s" watch price -replica', _col(brand), _col(reference))


def search_link(brand: Column | str, reference: Column | str, country: str = "us") -> Column:
    """Web-search link for a product; form encoding, as in a browser address."""
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(search_query(brand, reference)),
                    F.lit(f"&gl={country}&hl=en"))


# Fixed value: the unreserved characters of the URI standard.
_UNRESERVED = "[A-Za-z0-9._~-]"


def normalise_octets(c: Column | str) -> Column:
    """Percent-encoding normal form of a path: unreserved characters plain, other escapes in upper case, everything
    beyond ASCII escaped. Runs of plain characters are one piece, so most paths have few."""
    c = _col(c)
    pieces = F.regexp_extract_all(c, F.lit(r"%[0-9A-Fa-f]{2}|[\x00-\x7F&&[^%]]+|[^\x00-\x7F]+|%"), F.lit(0))

    def normal(piece: Column) -> Column:
        char = F.char(F.conv(F.substring(piece, 2, 2), 16, 10).cast("int"))
        escaped = F.regexp_replace(F.hex(F.encode(piece, "UTF-8")), "(..)", "%$1")
        return (F.when(piece.rlike("^%[0-9A-Fa-f]{2}$"), F.when(piece.rlike("^%[0-7]") & char.rlike(f"^{_UNRESERVED}$"), char).otherwise(F.upper(piece)))
                .when(piece.rlike(r"[^\x00-\x7F]"), escaped).otherwise(piece))

    return F.when(c.rlike(r"%|[^\x00-\x7F]"), F.array_join(F.transform(pieces, normal), "")).otherwise(c)


# A reference matches with its separators ignored but not inside a longer word. Text is read as runs of tokens: '<a> <b>'
# are two tokens with nothing but separators between them, '|' stands for any other gap.
_SEPARATORS = r"[\s._/–-]+"
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def token_runs(text: Column | str) -> Column:
    """Tokens of a folded or lower-case text, each in angle brackets, with a blank for separators and '|' for other gaps."""
    plain = F.regexp_replace(F.regexp_replace(_col(text), _SEPARATORS, " "), r" ?[^a-z0-9 ][^a-z0-9]*", "|")
    return F.regexp_replace(plain, "[a-z0-9]+", "<$0>")


def shape(text: Column) -> Column:
    """Lower-case letters as 'a', digits as '0'."""
    return F.translate(text, _LETTERS + _DIGITS, "a" * 26 + "0" * 10)


def reference_form(reference: Column | str) -> Column:
    """struct(key, joined, spaced, borders, shape): one product reference, prepared once.

    ``key`` is the compacted reference, ``joined`` and ``spaced`` its token runs without and with separators,
    ``borders`` the lengths after which a separator may stand, and ``shape`` the pattern of its letters and digits; null
    for bare numbers, which look like prices.
    """
    reference = _col(reference)

    def borders(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")))

    def form(parts: Column, raw: Column) -> Column:
        key = F.array_join(parts, "")
        shaped = F.when((F.size(raw) > 0) & ~reference.rlike(r"^\d+$"), shape(F.array_join(raw, "")))
        return F.when(F.size(parts) > 0, F.struct(
            key.alias("key"), F.concat(F.lit("<"), key, F.lit(">")).alias("joined"),
            F.concat(F.lit("<"), F.array_join(parts, "> <"), F.lit(">")).alias("spaced"), borders(parts).alias("borders"),
            shaped.alias("shape"), F.when(shaped.isNotNull(), borders(raw)).alias("shape_borders")))

    tokens = F.regexp_extract_all(fold(reference), F.lit("[a-z0-9]+"), F.lit(0))
    raw = F.transform(F.regexp_extract_all(reference, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.transform(F.array(F.struct(tokens.alias("t"), raw.alias("r"))), lambda x: form(x["t"], x["r"]))[0]


def _stretches(runs: Column) -> Column:
    """Token arrays of the stretches between other gaps."""
    tokens = F.transform(F.split(runs, r"\|"), lambda s: F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(tokens, lambda ts: F.size(ts) > 0)


def _run_at(ts: Column, i: Column, borders: Column) -> Column:
    """Text of the run of tokens from the i-th on that ends with the last of ``borders`` and breaks at borders only; null
    where there is none."""
    lengths = F.transform(F.sequence(F.lit(1), F.least(F.size(borders), F.size(ts) - i + 1)), lambda k: F.length(F.array_join(F.slice(ts, i, k), "")))
    ends = F.array_position(lengths, F.element_at(borders, -1)).cast("int")
    inner = F.forall(F.slice(lengths, 1, ends), lambda n: F.array_contains(borders, n))
    return F.when((ends > 0) & inner, F.array_join(F.slice(ts, i, ends), ""))


def mentions(runs: Column, form: Column) -> Column:
    """Exact reference evidence: the prepared ``form`` occurs in the token runs of a folded text. Plain containment decides
    nearly all rows; only texts that hold the key in another division are read run by run."""
    def anywhere(ts: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(ts)), lambda i: F.coalesce(_run_at(ts, i, form["borders"]) == form["key"], F.lit(False)))

    whole = runs.contains(form["joined"]) | runs.contains(form["spaced"])
    near = F.regexp_replace(runs, "[<> |]", "").contains(form["key"])
    return F.coalesce(whole | (near & F.exists(_stretches(runs), anywhere)), F.lit(False))


def mentions_other(runs: Column, form: Column) -> Column:
    """A different reference of the same shape is in the token runs of a lower-case text. Runs are taken from left to
    right and do not overlap."""
    def other(ts: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            found = F.when(i >= state["free"], _run_at(ts, i, form["shape_borders"]))
            hit = F.coalesce(shape(found) == form["shape"], F.lit(False))
            tokens = F.size(F.filter(F.sequence(F.lit(1), F.size(ts) - i + 1), lambda k: F.length(F.array_join(F.slice(ts, i, k), "")) <= F.length(found)))
            return F.when(hit, F.struct((i + tokens).alias("free"), (state["other"] | (found != form["key"])).alias("other"))).otherwise(state)

        start = F.struct(F.lit(1).alias("free"), F.lit(False).alias("other"))
        return F.aggregate(F.sequence(F.lit(1), F.size(ts)), start, step, lambda state: state["other"])

    whole = runs.contains(form["joined"]) | runs.contains(form["spaced"])

    def seen(compacted: Column, shaped: Column) -> Column:
        first = F.position(form["shape"], shaped)
        after = F.substring(shaped, first + F.length(form["shape"]), F.length(shaped))
        # The only run of the shape is the reference itself: nothing of its shape begins before it or after it.
        alone = whole & (first == F.position(form["key"], compacted)) & ~after.contains(form["shape"])
        return (first > 0) & ~alone & F.exists(_stretches(runs), other)

    return F.coalesce(_let(F.regexp_replace(runs, "[<> |]", ""), lambda c: _let(shape(c), lambda s: seen(c, s))), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def has_reference(text: Column | str, reference: Column | str) -> Column:
    return _let(token_runs(fold(text)), lambda runs: _let(reference_form(reference), lambda form: mentions(runs, form)))


def has_other_reference(text: Column | str, reference: Column | str) -> Column:
    return _let(token_runs(F.lower(_col(text))), lambda runs: _let(reference_form(reference), lambda form: mentions_other(runs, form)))
