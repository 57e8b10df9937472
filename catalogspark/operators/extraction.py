"""Pages to records: one fact job, mapping tables, and identity-safe selection.

Site differences are rows of the mapping, not code. Only ``extract_facts`` runs Python, because HTML is not
well-formed XML and Spark has no reader for it; it streams Arrow batches of pages and emits small fact rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import clean, label_key, norm_ref
from catalogspark.operators.merge import first_by_priority
from catalogspark.schema import COLUMNS, FACT_SCHEMA

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset(("h2", "h3", "h4", "h5", "label"))
_CELLS = frozenset(("dt", "dd", "th", "td", "title", "h1", *_HEADINGS))
_SIBLINGS = frozenset(("p", "span", "div"))
# An opening tag ends an open one of its own group, as browsers do when the end tag is left out.
_IMPLIED_END = {"p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
                "th": ("td", "th"), "li": ("li",)}
_CONTAINERS = frozenset("html body main article section div ul ol dl table form".split())
#: Section of labelled facts that stand in the page's menus, side columns or footer and tell nothing of its product.
OUTSIDE = "(outside the page's own content)"
_OUTER, _SCOPED = frozenset(("nav", "aside", "footer")), frozenset(("spec", "pair", "h1", "description"))


class _FactParser(HTMLParser):
    """Collects label/value facts of one page while it is read; nothing but the facts outlives the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.facts: list[tuple[str, str, str, str, str]] = []
        self._open: list[tuple[str, list[str] | None, dict]] = []
        self._script: tuple[str, list[str]] | None = None
        self._label: dict[int, str] = {}
        self._row: list[str] = []
        self._section = ""
        self._outside = 0

    def _add(self, kind: str, label: str, value: str, locator: str) -> None:
        label, value = " ".join(label.split()), " ".join(value.split())
        if value:
            section = OUTSIDE if self._outside and kind in _SCOPED else self._section
            self.facts.append((kind, section, label, value, locator))

    def handle_starttag(self, tag: str, attributes: list) -> None:
        attrs = {k: v or "" for k, v in attributes}
        self._end_implied(tag)
        if tag == "script":
            self._script = (attrs.get("type", ""), [])
        elif tag == "meta":
            name = attrs.get("name") or attrs.get("property") or ""
            self._add("meta", name, attrs.get("content", ""), f"meta[{name}]")
        elif tag == "link" and attrs.get("rel") == "canonical":
            self._add("canonical", "canonical", attrs.get("href", ""), "link[rel=canonical]")
        elif tag == "img":
            self._add("image", attrs.get("alt", ""), attrs.get("src", ""), "img[src]")
        elif tag == "a" and attrs.get("href"):
            self._add("link", "href", attrs["href"], "a[href]")
        elif tag == "tr":
            self._row = []
        if "data-specification-name" in attrs and attrs.get("data-specification-value"):
            self._add("spec", attrs["data-specification-name"], attrs["data-specification-value"], "data-specification")
        if tag == "br":
            self.handle_data("\n")
        elif tag not in _VOID and tag != "script":
            depth = len(self._open)
            if tag not in _SIBLINGS and tag != "dd":
                self._label.pop(depth, None)
            wanted = tag in _CELLS or (
                tag in _SIBLINGS and (depth in self._label or attrs.get("itemprop") == "description"))
            self._open.append((tag, [] if wanted else None, attrs))
            self._outside += tag in _OUTER

    def _end_implied(self, tag: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            name = self._open[i][0]
            if name in _IMPLIED_END.get(tag, ()):
                self._close_to(i)
                return
            if name in _CONTAINERS:
                return

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script[1].append(data)
            return
        for _, pieces, _ in self._open:
            if pieces is not None:
                pieces.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._script is not None:
            kind, pieces = self._script
            self._script = None
            if kind in ("application/ld+json", "application/json"):
                self._json(kind, "".join(pieces))
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                self._close_to(i)
                return

    def _close_to(self, index: int) -> None:
        while len(self._open) > index:
            name, pieces, attrs = self._open.pop()
            self._close(name, " ".join("".join(pieces or ()).split()), attrs, len(self._open))
            self._outside -= name in _OUTER

    def _close(self, tag: str, text: str, attrs: dict, depth: int) -> None:
        if tag in ("title", "h1"):
            self._add(tag, tag, text, tag)
        elif tag == "dt":
            self._label[depth] = text
        elif tag == "dd":
            self._add("spec", self._label.pop(depth, ""), text, "dl/dt+dd")
        elif tag in ("th", "td"):
            self._row.append(text)
        elif tag == "tr":
            if len(self._row) == 2:
                self._add("spec", self._row[0], self._row[1], "table/tr")
            self._row = []
        elif tag in _HEADINGS:
            self._label[depth] = text
            self._section = text if tag == "h2" else self._section
        elif tag in _SIBLINGS:
            label = self._label.pop(depth, None)
            if label is not None:
                self._add("pair", label, text, "heading+sibling")
            if attrs.get("itemprop") == "description":
                self._add("description", "description", text, "itemprop=description")

    def _json(self, kind: str, text: str) -> None:
        try:
            json.loads(text)
        except ValueError:
            self._add("warning", kind, "Invalid embedded JSON", "script")
            return
        self.facts.append(("json", self._section, kind, text.strip(), "script"))


def page_facts(page_id: str, html: str) -> Iterator[tuple]:
    """Fact rows of one page; also usable from a UDTF."""
    parser = _FactParser()
    parser.feed(html or "")
    parser.close()
    for i, (kind, section, label, value, locator) in enumerate(parser.facts):
        yield page_id, kind, section, label, value, locator, i


def extract_facts(pages: DataFrame, id_col: str, body: str) -> DataFrame:
    """(page_id, kind, section, label, value, locator, ord) for whole pages, partition-parallel."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = FACT_SCHEMA.fieldNames()
        for batch in batches:
            rows = [fact for key, html in zip(batch["k"], batch["b"]) for fact in page_facts(key, html)]
            yield pd.DataFrame(rows, columns=names)

    rows = pages.select(F.col(id_col).cast("string").alias("k"), F.col(body).alias("b"))
    return rows.mapInPandas(run, FACT_SCHEMA)


def register_udtf(spark, name: str = "page_facts") -> None:
    """SQL table function over one page, for ad-hoc lateral joins."""
    class PageFacts:
        def eval(self, page_id: str, html: str):
            yield from page_facts(page_id, html)

    spark.udtf.register(name, F.udtf(PageFacts, returnType=FACT_SCHEMA))


@dataclass(frozen=True)
class FieldMap:
    """One mapping row: which label of which site and section feeds which column, and with what precedence."""

    label: str
    field: str
    site: str = "*"
    section: str = "*"
    priority: int = 100


# Printed labels and the record column each one fills, for every site.
LABELS: tuple[tuple[str, str], ...] = (
    ("reference", "reference_number"), ("reference number", "reference_number"), ("ref", "reference_number"), ("collection", "parent_model"),
    ("model", "specific_model"), ("gender", "type"), ("country of origin", "made_in"), ("case material", "case_material"),
    ("material of the case", "case_material"), ("case shape", "case_shape"), ("case finish", "case_finish"), ("case back", "caseback"),
    ("caseback", "caseback"), ("diameter", "diameter"), ("case diameter", "diameter"), ("diameter of the case", "diameter"),
    ("case size", "diameter"), ("thickness", "case_thickness"), ("case thickness", "case_thickness"), ("height", "case_thickness"),
    ("lug width", "between_lugs"), ("between lugs", "between_lugs"), ("lugs", "between_lugs"), ("lug to lug", "lug_to_lug"),
    ("bezel material", "bezel_material"), ("bezel color", "bezel_color"), ("crystal", "crystal"), ("glass", "crystal"),
    ("water resistance", "water_resistance"), ("waterproofness", "water_resistance"), ("water resistant", "water_resistance"), ("weight", "weight"),
    ("dial color", "dial_color"), ("dial colour", "dial_color"), ("dial", "dial_color"), ("hour markers", "numerals"), ("numerals", "numerals"),
    ("strap material", "bracelet_material"), ("bracelet material", "bracelet_material"), ("bracelet", "bracelet_material"),
    ("strap", "bracelet_material"), ("strap color", "bracelet_color"), ("strap colour", "bracelet_color"), ("clasp", "clasp_type"),
    ("buckle", "clasp_type"), ("clasp type", "clasp_type"), ("movement", "movement"), ("movement type", "movement"), ("caliber", "caliber"),
    ("calibre", "caliber"), ("power reserve", "power_reserve"), ("frequency", "frequency"), ("vibrations", "frequency"), ("jewels", "jewels"),
    ("number of jewels", "jewels"), ("functions", "features"), ("complications", "features"), ("features", "features"), ("price", "price"),
    ("currency", "currency"), ("year introduced", "year_introduced"),
)
# Facts that state themselves: the page's own meta, canonical and structured facts come under these labels.
STATED: tuple[tuple[str, str], ...] = (("description", "description"), ("short description", "short_description"), ("image", "image_URL"))
DEFAULT_MAPPING: tuple[FieldMap, ...] = tuple(FieldMap(label, column) for label, column in LABELS + STATED)


def mapping_table(spark, mapping: Sequence[FieldMap] = DEFAULT_MAPPING) -> DataFrame:
    return spark.createDataFrame([(m.site, m.section, m.label, m.field, m.priority) for m in mapping],
                                 "site string, section string, label string, field string, priority int")


def map_fields(facts: DataFrame, mapping: DataFrame, site: Column | None = None) -> DataFrame:
    """(page_id, field, value, locator): the fact of highest precedence per column.

    The mapping, a list of printed labels, goes to all tasks: without a hint Spark takes rows of the driver for larger than
    any file and would broadcast the facts. The facts are dealt by page before they are sorted and grouped, so a task holds
    its share of the pages, not of the files; grouping by page afterwards needs no other shuffle.
    """
    keyed = facts.withColumns({"__label": label_key("label"), "__site": site if site is not None else F.lit("*"),
                               "value": clean("value")})
    rules = mapping.select(F.col("label").alias("__label"), F.col("site").alias("__rsite"),
                           F.col("section").alias("__rsection"), "field", "priority")
    hits = keyed.join(F.broadcast(rules), "__label").where(
        F.col("__rsite").isin("*") | (F.col("__rsite") == F.col("__site"))
    ).where((F.col("__rsection") == "*") | (label_key("__rsection") == label_key("section")))
    dealt = hits.select("page_id", "field", "value", "locator", "priority", "ord").repartition("page_id")
    return first_by_priority(dealt, ["page_id", "field"], "value", "locator", ["priority", "ord"])


def pivot_records(fields: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One wide row per page with the fixed columns and a provenance map, in one grouped pass. A page has at most one
    fact per column, so the group is bounded."""
    values = [F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns]
    located = F.map_from_entries(F.collect_list(F.struct("field", F.struct("locator", "value"))))
    return fields.groupBy("page_id").agg(*values, located.alias("provenance"))


def single_offer(offers: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Price of a page with exactly one offer; several offers select none and are counted."""
    grouped = offers.groupBy(*keys).agg(F.count("*").alias("n_offers"), F.min(price).alias("__p"))
    return grouped.select(*keys, "n_offers", F.when(F.col("n_offers") == 1, F.col("__p")).alias("price"))


def own_images(images: Column, reference: Column) -> Column:
    """Gallery images whose address names the selected reference."""
    return F.filter(images, lambda u: F.contains(norm_ref(u), norm_ref(reference)))
