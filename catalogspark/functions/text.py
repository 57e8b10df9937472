"""Text normalisation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """'' is how sources say "unknown"; inside Spark unknown is always null."""
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def clean(c: Column | str) -> Column:
    """Collapse whitespace and trim; null becomes the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")), F.lit(""))


def clean_list(c: Column | str) -> Column:
    """Join the non-null members of an array with '; ', each one cleaned."""
    return F.array_join(F.transform(F.filter(_col(c), lambda x: x.isNotNull()), clean), "; ")


def _accent_table() -> tuple[str, str]:
    """Single-character replacements found by decomposing every Latin letter; combining marks map to nothing."""
    source, target, marks = [], [], [chr(i) for i in range(0x300, 0x370)]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(ch for ch in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Latin letters without their marks; pure ASCII text skips the character table."""
    c = _col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, _ACCENTED, _PLAIN)).otherwise(c)


def fold(c: Column | str) -> Column:
    """Lower-case without accents: the form every text comparison uses."""
    return F.lower(strip_accents(c))


def tokens(c: Column | str) -> Column:
    """Array of folded ASCII alphanumeric terms in text order."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def compact(c: Column | str) -> Column:
    """Folded text with everything but letters and digits removed; null when nothing is left."""
    key = F.regexp_replace(fold(c), "[^a-z0-9]", "")
    return F.when(key != "", key)


def norm_ref(c: Column | str) -> Column:
    """Match key of a printed reference: upper-case ASCII alphanumerics."""
    return F.regexp_replace(F.upper(F.coalesce(_col(c), F.lit(""))), "[^A-Z0-9]", "")


def label_key(c: Column | str) -> Column:
    """Key under which a printed specification label is looked up."""
    lowered = F.regexp_replace(F.lower(clean(c)), "-", " ")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9 ]", ""))


# Entities that appear in published fragments.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·",
            "&copy;": "©", "&amp;": "&"}


def html_text(c: Column | str) -> Column:
    """Visible text of an HTML fragment: scripts, styles, comments and tags go, entities are decoded.

    A tag becomes a space so words of neighbouring blocks never join.
    """
    text = F.regexp_replace(_col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean(text)


def format_reference(c: Column | str) -> Column:
    """Dotted form of a bare 14- or 8-digit reference; anything else is null."""
    c = _col(c)
    long_form = F.regexp_replace(c, r"^(\d{3})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})$", "$1.$2.$3.$4.$5.$6")
    short_form = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1.$2.$3")
    return F.when(c.rlike(r"^\d{14}$"), long_form).when(c.rlike(r"^\d{8}$"), short_form)


def slug_title(c: Column | str) -> Column:
    """'reine-de-naples' -> 'Reine De Naples'."""
    return F.initcap(F.translate(_col(c), "-", " "))


def ordered_distinct(c: Column | str) -> Column:
    return F.array_distinct(_col(c))


def decode_octets(c: Column | str) -> Column:
    """Decode space-separated 8-bit binary octets as UTF-8; null for any other text."""
    c = _col(c)
    hexes = F.transform(F.split(c, r"\s+"), lambda octet: F.lpad(F.conv(octet, 2, 16), 2, "0"))
    decoded = F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")
    return F.when(c.rlike(r"^[01]{8}(\s+[01]{8})*$"), decoded)


def csv_cell(c: Column | str) -> Column:
    """Quoted CSV cell; a leading formula sign, even after spaces, is neutralised with an apostrophe."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    guarded = F.when(c.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
