"""Money is (amount, currency, source); amounts are never converted and ambiguity gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col

# Printed currency marks and the ISO code each one proves. '$' and '¥' alone prove nothing.
CURRENCY_MARKS = {
    "US$": "USD", "USD": "USD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP", "CHF": "CHF", "INR": "INR",
    "₹": "INR", "RS.": "INR", "RS": "INR", "AED": "AED", "HKD": "HKD", "HK$": "HKD", "SGD": "SGD", "S$": "SGD",
    "JPY": "JPY",
}
# Shapes of a printed price.
_MARKS = r"US\$|HK\$|S\$|USD|EUR|GBP|CHF|INR|AED|HKD|SGD|JPY|Rs\.?|[$€£₹¥]"
_CODES = r"USD|EUR|GBP|CHF|INR|AED|HKD|SGD|JPY"
_NUMBER = r"(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?"
_TOKEN = (
    rf"(?:(?<![A-Za-z0-9])(?:{_MARKS})\s*{_NUMBER}(?!\d|[,.]\d)"
    rf"|(?<![\d.,]){_NUMBER}\s*(?:{_CODES})(?![A-Za-z0-9_]))"
)
# Wording near a figure that means it is not a plain asking price.
_NOT_A_PRICE = (
    r"(?i)(?<![A-Za-z0-9_])(?:per month|monthly|installment|instalment|shipping|deposit|save|discount|off|from|starting at)(?![A-Za-z0-9_])"
    r"|/\s*(?:mo|month)|[-–]\s*(?:[$€£₹¥]|\d)|(?<![A-Za-z0-9_])to\s*(?:USD|EUR|GBP|CHF|INR|[$€£₹¥])?\s*\d"
)
CONTEXT_BEFORE, CONTEXT_AFTER, SMALLEST_PRICE = 30, 35, 100
# Digit grouping styles.
_WESTERN = r"^\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?$"
_INDIAN = r"^\d{1,2}(?:,\d{2})*,\d{3}(?:\.\d{1,2})?$"


def currency_code(mark: Column | str) -> Column:
    """ISO code of a printed mark, null when the mark is ambiguous."""
    table = F.create_map(*[F.lit(x) for pair in CURRENCY_MARKS.items() for x in pair])
    return F.try_element_at(table, F.upper(_col(mark)))


def grouped_price(c: Column | str) -> Column:
    """'6,900' -> 6900; malformed grouping such as '6,90' -> null."""
    c = F.trim(_col(c))
    well_formed = c.rlike(_WESTERN) | c.rlike(r"^\d+(?:\.\d{1,2})?$")
    return F.when(well_formed, F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))


def positive_amount(c: Column | str) -> Column:
    """Finite decimal above zero, else null."""
    value = F.trim(_col(c).cast("string")).try_cast("decimal(18,2)")
    return F.when(value > 0, value)


def display_price(currency: Column | str, amount: Column | str) -> Column:
    return F.concat(_col(currency), F.lit(" "), F.format_number(_col(amount), 0))


_MARKS_OF_A_MATCH = "\x01\x02"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``: array functions are not shared between expressions."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def price_candidates(text: Column | str) -> Column:
    """array<struct<amount,currency,mark,raw>> of the figures in ``text`` that read as a plain asking price."""
    text = _col(text)
    text = F.when(text.rlike(f"[{_MARKS_OF_A_MATCH}]"), F.translate(text, _MARKS_OF_A_MATCH, "  ")).otherwise(text)
    # Matches are marked in one pass; cut at the marks, every second piece is one.
    pieces = F.split(F.regexp_replace(text, f"(?i){_TOKEN}", "{}$0{}".format(*_MARKS_OF_A_MATCH)), f"[{_MARKS_OF_A_MATCH}]")

    def in_context(p: Column, ends: Column, starts: Column) -> Column:
        # Longer pieces are cut to what a context can hold, so a match costs the same in a text of any length.
        def match(i: Column) -> Column:
            at = 2 * i
            first = F.greatest(at - 2 * CONTEXT_BEFORE, F.lit(1))
            return F.struct(F.right(F.array_join(F.slice(ends, first, at - first), ""), F.lit(CONTEXT_BEFORE)).alias("before"), F.get(p, at - 1).alias("raw"),
                            F.left(F.array_join(F.slice(starts, at + 1, 2 * CONTEXT_AFTER), ""), F.lit(CONTEXT_AFTER)).alias("after"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int")), lambda i: i > 0), match)

    matches = _let(pieces, lambda p: _let(F.transform(p, lambda x: F.right(x, F.lit(CONTEXT_BEFORE))), lambda ends: _let(
        F.transform(p, lambda x: F.left(x, F.lit(CONTEXT_AFTER))), lambda starts: in_context(p, ends, starts))))

    def read(m: Column) -> Column:
        number = F.regexp_extract(m["raw"], _NUMBER, 0)
        return _let(number, lambda n: F.struct(
            F.replace(n, F.lit(","), F.lit("")).try_cast("double").alias("amount"),
            currency_code(F.trim(F.replace(m["raw"], n, F.lit("")))).alias("currency"),
            F.upper(F.trim(F.replace(m["raw"], n, F.lit("")))).alias("mark"),
            m["raw"].alias("raw"), n.alias("number"),
            F.concat(m["before"], m["raw"], m["after"]).alias("around"),
        ))

    def plain(p: Column) -> Column:
        grouping = (
            ~p["number"].contains(",")
            | p["number"].rlike(_WESTERN)
            | (F.coalesce(p["currency"] == "INR", F.lit(False)) & p["number"].rlike(_INDIAN))
        )
        return (p["amount"] >= SMALLEST_PRICE) & ~p["around"].rlike(_NOT_A_PRICE) & grouping

    return F.filter(F.transform(matches, read), plain)


def sole_price(text: Column | str) -> Column:
    """struct<amount,currency,raw> when the text states exactly one distinct price, else null."""
    def decide(found: Column) -> Column:
        keys = F.transform(found, lambda p: F.concat_ws("|", F.coalesce(p["currency"], p["mark"]), p["amount"].cast("string")))
        last = F.element_at(found, -1)
        price = F.struct(last["amount"].alias("amount"), last["currency"].alias("currency"), last["raw"].alias("raw"))
        return F.when(F.size(F.array_distinct(keys)) == 1, price)

    return _let(price_candidates(text), decide)


def condition_label(evidence: Column | str) -> Column:
    """Price basis stated in the evidence; mixed or absent wording stays unspecified."""
    evidence = _col(evidence)
    used = evidence.rlike(r"(?i)pre[- ]?owned|used|second[- ]hand")
    retail = evidence.rlike(r"(?i)retail|msrp|rrp")
    return (
        F.when(used & ~retail, "Pre-owned listing")
        .when(retail & ~used, "Reported retail price")
        .otherwise("Condition / price basis unspecified")
    )
