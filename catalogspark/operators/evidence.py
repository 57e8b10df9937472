"""Price evidence: search hits of a product become at most three dated, unambiguous price reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.dates import reported_date
from catalogspark.functions.money import condition_label, sole_price
from catalogspark.functions.text import _col, fold
from catalogspark.functions.urls import host, is_safe_link, mentions, mentions_other, path, reference_form, token_runs
from catalogspark.operators.merge import latest_state
from catalogspark.operators.ordered import top_per_key
from catalogspark.shaping import once

# Titles of accessories, copies and parts.
ACCESSORY_TITLE = (
    r"(?i)\b(?:replica|counterfeit|replacement|watch bands?|watch straps?|box only|parts only)\b"
    r"|^(?:strap|bracelet|box|buckle)\s+(?:for|compatible)"
)
REPORTS_PER_PRODUCT = 3


def is_accessory(title: Column | str) -> Column:
    return _col(title).rlike(ACCESSORY_TITLE)


def brand_word(brand: Column | str) -> Column:
    """First word of three letters or more, in lower case; null when the brand has none."""
    word = F.lower(F.regexp_extract(_col(brand), r"(?i)[a-z]{3,}", 0))
    return F.when(word != "", word)


def names_brand(text: Column, word: Column, runs: Column) -> Column:
    """The brand's word (see ``brand_word``) stands alone in the text, of which ``runs`` may hold the token runs of a part.
    Everything but word characters becomes a space, so containment of ' word ' is the whole-word test and no pattern is
    compiled per row; in plain text without underscores a token of the runs tells as much."""
    plain = ~text.rlike(r"[^\x00-\x5E\x60-\x7F]") & runs.contains(F.concat(F.lit("<"), word, F.lit(">")))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]", " "), F.lit(" "))
    return F.coalesce(plain | F.contains(words, F.concat(F.lit(" "), word, F.lit(" "))), F.lit(False))


def is_identified(title: Column, snippet: Column, link: Column, form: Column) -> Column:
    """The snippet names the reference, or the title and the link's path both do. Texts are token runs."""
    return mentions(snippet, form) | (mentions(title, form) & mentions(link, form))


def worth_reading(hits: DataFrame) -> DataFrame:
    """Hits with a safe link and a title that is no accessory's."""
    return hits.where(is_safe_link("link") & ~is_accessory("title"))


def match_hits(products: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (id, title, snippet, link, date, position) that identify their product and are no accessory."""
    return identified(products, worth_reading(hits))


def identified(products: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose texts name the product's reference and brand, and no other reference of that shape.

    References are prepared once per product, texts are cut into token runs once per hit; a match is a comparison
    of the two, and no pattern is compiled per row.
    """
    prepared = products.select("id", "brand", "reference", reference_form("reference").alias("__form"), brand_word("brand").alias("__word"))
    cut = once(hits, __snippet=token_runs(fold("snippet"))).join(prepared, "id")
    form = F.col("__form")
    title, link = token_runs(fold("title")), token_runs(fold(path("link")))
    # A text in plain ASCII is its own fold.
    lowered = F.when(F.col("snippet").rlike(r"[^\x00-\x7F]"), token_runs(F.lower("snippet"))).otherwise(F.col("__snippet"))
    matched = cut.where(
        is_identified(title, F.col("__snippet"), link, form)
        & names_brand(F.concat_ws(" ", "title", "snippet"), F.col("__word"), F.col("__snippet")) & ~mentions_other(lowered, form)
    )
    return matched.drop("__form", "__snippet", "__word")


def price_reports(products: DataFrame, hits: DataFrame, now: Column, n: int = REPORTS_PER_PRODUCT) -> DataFrame:
    """Up to ``n`` reports per product: one per url (the last hit wins, of hits at one position the dearer), dated first, newest first, then position.

    The price needs no product, so hits without one go before the join. Both the url dedupe and the top-n are
    trimmed inside the map tasks before the shuffle.
    """
    evidence = F.concat_ws(" ", "title", "snippet")
    priced = once(worth_reading(hits), __p=sole_price("snippet")).where(F.col("__p").isNotNull())
    found = identified(products, priced)
    reports = found.select(
        "id", F.col("link").alias("source_url"), host("link").alias("source_domain"), F.col("position"),
        reported_date("date", now).alias("source_date"), condition_label(evidence).alias("condition"),
        F.col("__p.amount").alias("amount"), F.col("__p.currency").alias("currency"), F.col("__p.raw").alias("raw"),
    )
    values = ["source_domain", "position", "source_date", "condition", "amount", "currency", "raw"]
    unique = latest_state(reports, ["id", "source_url"], ["position", "amount"], values)
    order = [F.col("source_date").desc_nulls_last(), F.col("position").asc(), F.col("source_url").asc()]
    return top_per_key(unique, ["id"], order, n)


def eligible_identities(products: DataFrame, priced: DataFrame, reference: str = "reference") -> DataFrame:
    """Products without any recorded price and with a usable reference: the only ones worth a lookup."""
    usable = products.where(F.length(reference) >= 3)
    return usable.join(priced.select("id"), "id", "left_anti")
