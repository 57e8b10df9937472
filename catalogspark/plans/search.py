"""Faceted search, rules, ranking and text relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import facets as fc
from catalogspark.operators import rules as rl
from catalogspark.operators import search as se
from catalogspark.operators import search_many as sm
from catalogspark.operators import text_search as tx
from catalogspark.operators.annotate import annotate_queries
from catalogspark.plans.registry import CATALOG, FACETS, PRICES, query

WORDS = ["red", "blue"]


@query("facet_any", f"""WITH {FACETS} SELECT id FROM facets WHERE facet = 'complication' AND value IN ('red','blue') GROUP BY id""")
def _(t):
    return fc.facet_any(t.facets, "complication", WORDS)


@query("facet_all", f"""WITH {FACETS} SELECT id FROM facets WHERE facet = 'complication' AND value IN ('red','ring')
 GROUP BY id HAVING count(DISTINCT value) = 2""")
def _(t):
    return fc.facet_all(t.facets, "complication", ["red", "ring"])


@query("facet_and", f"""WITH {FACETS} SELECT DISTINCT id FROM facets
 WHERE id IN (SELECT id FROM facets WHERE facet='brand' AND value IN ('Brand#1','Brand#2','Brand#3'))
   AND id IN (SELECT id FROM facets WHERE facet='collection' AND value IN ('LARGE','SMALL'))
   AND id IN (SELECT id FROM facets WHERE facet='complication' AND value='gear')""")
def _(t):
    return fc.facet_and(t.facets, {"brand": ["Brand#1", "Brand#2", "Brand#3"], "collection": ["LARGE", "SMALL"],
                                   "complication": ["gear"]}, all_of=("complication",))


@query("facet_vocabulary", f"WITH {FACETS} SELECT facet, value, count(*) AS n FROM facets GROUP BY 1, 2")
def _(t):
    return fc.vocabulary(t.facets)


@query("numeric_bounds", f"WITH {CATALOG} SELECT id, diameter FROM catalog WHERE diameter >= 10 AND diameter < 30")
def _(t):
    return t.catalog.where(se.numeric_predicate({("diameter", "min"): 10, ("diameter", "lt"): 30})).select("id", "diameter")


@query("left_price", f"""WITH {CATALOG}, {PRICES} SELECT c.id, p.amount AS price FROM catalog c
 LEFT JOIN prices p ON p.id = c.id AND p.source = 'official_retail' AND p.currency = 'USD'""")
def _(t):
    return se.with_price(t.catalog.select("id"), t.prices, "official_retail", "USD")


@query("price_bound", f"""WITH {CATALOG}, {PRICES} SELECT c.id, p.amount AS price FROM catalog c
 JOIN prices p ON p.id = c.id AND p.source = 'recorded_catalog' AND p.currency = 'INR' WHERE p.amount <= 5000""")
def _(t):
    priced = se.with_price(t.catalog.select("id"), t.prices, "recorded_catalog", "INR")
    return priced.where(se.numeric_predicate({("price", "max"): 5000}))


@query("reference_prefix", f"""WITH {CATALOG} SELECT id, reference FROM catalog WHERE reference_key LIKE 'la0001%'""")
def _(t):
    return t.catalog.where(se.reference_predicate("LA-0001", F.col("reference_key"))).select("id", "reference")


_TOK = "regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+')"


@query("text_match", f"""SELECT doc_id AS id FROM documents WHERE list_contains({_TOK.format('text')}, 'and')
 AND len(list_filter({_TOK.format('text')}, lambda x: starts_with(x, 'thn'))) > 0""")
def _(t):
    return tx.match_text(t.texts, "doc_id", [F.col("text")], "And thn")


def _bm25_sql(source: str, fields: list[tuple[str, float]], slots: list[tuple[str, bool]]) -> str:
    length = " + ".join(f"len({_TOK.format(c)})" for c, _ in fields)
    tfs = []
    for i, (term, prefix) in enumerate(slots):
        test = f"starts_with(x, '{term}')" if prefix else f"x = '{term}'"
        tfs.append(" + ".join(f"{w} * len(list_filter({_TOK.format(c)}, lambda x: {test}))" for c, w in fields) + f" AS tf_{i}")
    ns = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS n_{i}" for i in range(len(slots)))
    score = " + ".join(
        f"greatest(ln((docs - n_{i} + 0.5) / (n_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / avg_length))"
        for i in range(len(slots)))
    every = " AND ".join(f"tf_{i} > 0" for i in range(len(slots)))
    return f"""counted AS (SELECT id, {length} AS length, {', '.join(tfs)} FROM {source}),
 stats AS (SELECT count(*) AS docs, avg(length) AS avg_length, {ns} FROM counted),
 scored AS (SELECT id, {score} AS score FROM counted, stats WHERE {every})"""


_DOCS = "(SELECT doc_id AS id, source, text FROM documents)"


@query("bm25_topk", f"""WITH {_bm25_sql(_DOCS, [('source', 8.0), ('text', 1.0)], [('and', False), ('thn', True)])}
 SELECT rank, id, round(score, 6) AS score FROM (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, * FROM scored) WHERE rank <= 24""")
def _(t):
    scored = tx.search_text(t.texts, "doc_id", {"source": (F.col("source"), 8.0), "text": (F.col("text"), 1.0)}, "And thn")
    page = se.page_of(scored, [F.round("score", 9).desc(), F.col("id").asc()])
    return page.select(F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


_INDEX_FIELDS = [("model", 8.0), ("collection", 2.0), ("brand", 8.0)]


@query("bm25_index", f"""WITH {CATALOG}, {_bm25_sql('catalog', _INDEX_FIELDS, [('red', False), ('ri', True)])}
 SELECT id, round(score, 6) AS score FROM scored""")
def _(t):
    fields = {"model": F.col("model"), "collection": F.col("collection"), "brand": F.col("brand")}
    postings, stats = tx.build_postings(t.catalog, "id", fields), tx.build_doc_stats(t.catalog, "id", fields)
    scored = tx.search_postings(postings, stats, "red ri", dict(_INDEX_FIELDS))
    return scored.select("id", F.round("score", 6).alias("score"))


def _index_scores(t, q):
    fields = {"identity": F.concat_ws(" ", "brand", "collection", "model"), "reference_key": F.col("reference_key")}
    return tx.search_postings(tx.build_postings(t.catalog, "id", fields), tx.build_doc_stats(t.catalog, "id", fields), q)


_ID_FIELDS = [("concat_ws(' ', brand, collection, model)", 8.0), ("coalesce(reference_key, '')", 12.0)]
_SEARCH = f"""WITH {CATALOG}, {FACETS}, {PRICES}, {_bm25_sql('catalog', _ID_FIELDS, [('la0001', True)])},
 found AS (SELECT c.*, p.amount AS price, s.score FROM catalog c LEFT JOIN scored s ON s.id = c.id
  LEFT JOIN prices p ON p.id = c.id AND p.source = 'official_retail' AND p.currency = 'USD'
  WHERE (s.score IS NOT NULL OR c.reference_key LIKE 'la0001%') AND c.diameter <= 40)"""


@query("search_combined", f"""{_SEARCH} SELECT id, round(score, 6) AS score, price,
 CASE WHEN reference_key = 'la0001' THEN 0 WHEN reference_key LIKE 'la0001%' THEN 1
  WHEN lower(model) = 'la0001' OR lower(collection) = 'la0001' THEN 2 ELSE 3 END AS tier FROM found""")
def _(t):
    spec = se.SearchSpec(q="LA0001", bounds={("diameter", "max"): 40})
    found = se.matches(t.catalog, t.facets, t.prices, spec, _index_scores(t, "LA0001"))
    return found.select("id", F.round("score", 6).alias("score"), "price", "tier")


@query("rank_tiers", f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY tier, id) AS rank, id, tier FROM (
 SELECT id, CASE WHEN reference_key = 'redring' THEN 0 WHEN reference_key LIKE 'redring%' THEN 1
  WHEN lower(model) = 'red ring' OR lower(collection) = 'red ring' THEN 2 ELSE 3 END AS tier FROM catalog
  WHERE list_contains(string_split(model, ' '), 'red')) ORDER BY tier, id LIMIT 24""")
def _(t):
    rows = t.catalog.join(fc.facet_any(t.facets, "complication", ["red"]), "id", "left_semi")
    tier = se.rank_tier("Red ring", F.col("reference_key"), F.col("model"), F.col("collection"))
    page = se.page_of(rows.select("id", tier.alias("tier")), [F.col("tier").asc(), F.col("id").asc()])
    return page.select(F.col("rank").cast("long").alias("rank"), "id", "tier")


_PAGE_SPEC = se.SearchSpec(
    facets={"collection": ["LARGE", "MEDIUM", "PROMO"], "complication": ["gear"]},
    bounds={("diameter", "lt"): 41, ("price", "lt"): 60000}, sort="price-asc")


@query("search_page", f"""WITH {CATALOG}, {FACETS}, {PRICES}, found AS (SELECT c.id, c.brand, c.model, c.diameter, p.amount AS price
 FROM catalog c JOIN prices p ON p.id = c.id AND p.source = 'official_retail' AND p.currency = 'USD'
 WHERE c.diameter < 41 AND p.amount < 60000 AND c.collection IN ('LARGE','MEDIUM','PROMO')
  AND c.id IN (SELECT id FROM facets WHERE facet = 'complication' AND value = 'gear'))
 SELECT row_number() OVER (ORDER BY price, id) AS rank, id, brand, model, diameter, price, (SELECT count(*) FROM found) AS total
 FROM found ORDER BY price, id LIMIT 24""")
def _(t):
    page = se.search(t.catalog, t.facets, t.prices, _PAGE_SPEC)
    return page.select(F.col("rank").cast("long").alias("rank"), "id", "brand", "model", "diameter", "price", "total")


@query("search_total", f"""WITH {CATALOG}, found AS (SELECT * FROM catalog WHERE collection = 'LARGE')
 SELECT id, (SELECT count(*) FROM found) AS total FROM found ORDER BY id LIMIT 24""")
def _(t):
    found = t.catalog.where(F.col("collection") == "LARGE")
    return se.with_total(found, se.page_of(found, [F.col("id").asc()])).select("id", "total")


_SORTS = {
    "brand": "lower(brand), lower(model), id", "newest": "captured DESC NULLS LAST, id",
    "price-asc": "price ASC NULLS LAST, id", "price-desc": "price DESC NULLS LAST, id",
    "diameter-asc": "diameter ASC NULLS LAST, id", "diameter-desc": "diameter DESC NULLS LAST, id",
    "default": "status = 'Historical · unverified', lower(brand), lower(model), id",
}
_SORT_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS sort, row_number() OVER (ORDER BY {o}) AS rank, id FROM priced) WHERE rank <= 24"
    for m, o in _SORTS.items())


@query("sort_modes", f"""WITH {CATALOG}, {PRICES}, priced AS (SELECT c.*, p.amount AS price, p.captured FROM catalog c
 LEFT JOIN prices p ON p.id = c.id AND p.source = 'official_retail' AND p.currency = 'USD') {_SORT_SQL}""")
def _(t):
    fact = t.prices.where((F.col("source") == "official_retail") & (F.col("currency") == "USD"))
    priced = t.catalog.join(fact.select("id", F.col("amount").alias("price"), "captured"), "id", "left")
    pages = [se.page_of(priced, se.sort_order(m)).select(F.lit(m).alias("sort"), F.col("rank").cast("long").alias("rank"), "id")
             for m in _SORTS]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@query("page_two", f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY lower(brand), lower(model), id) AS rank, id FROM catalog
 QUALIFY rank BETWEEN 25 AND 48""")
def _(t):
    page = se.page_of(t.catalog, se.sort_order("brand"), page=2)
    return page.select(F.col("rank").cast("long").alias("rank"), "id")


@query("page_seven", f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY diameter DESC NULLS LAST, id) AS rank, id, diameter FROM catalog QUALIFY rank BETWEEN 145 AND 168""")
def _(t):
    page = se.page_of(t.catalog.select("id", "diameter"), se.sort_order("diameter-desc"), page=7)
    return page.select(F.col("rank").cast("long").alias("rank"), "id", "diameter")


@query("page_keyset", f"""WITH {CATALOG} SELECT id, diameter FROM catalog WHERE (diameter, id) > (20, 100) AND diameter IS NOT NULL
 ORDER BY diameter, id LIMIT 24""")
def _(t):
    after = (F.col("diameter") > 20) | ((F.col("diameter") == 20) & (F.col("id") > 100))
    return se.page_after(t.catalog.select("id", "diameter"), [F.col("diameter").asc(), F.col("id").asc()], after)


@query("by_ids", f"WITH {CATALOG} SELECT * FROM catalog WHERE id IN (3, 1, 17)")
def _(t):
    return se.by_ids(t.catalog.drop("model_key"), [3, 1, 3, 17])


@query("compare_candidates", f"""WITH {CATALOG} SELECT id, diameter FROM catalog WHERE diameter <= 30 ORDER BY id LIMIT 500""")
def _(t):
    rules = [rl.Rule("diameter", "lte", "30")]
    rows = rl.match_rules(t.catalog, rules, _fields()).select("id", "diameter")
    return rows.orderBy("id").limit(500)


@query("reversed_ranges", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'range minimum exceeds maximum' AS error
 FROM lineitem WHERE l_quantity > l_extendedprice / 1000""")
def _(t):
    bounds = F.create_map(F.lit("range.min"), F.col("l_quantity").cast("double"), F.lit("range.lt"), (F.col("l_extendedprice") / 1000).cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(sm.spec_errors(bounds)).alias("error"))


@query("suggest_all", f"""WITH {CATALOG}, found AS (SELECT * FROM catalog WHERE lower(brand) LIKE 'brand#1%'),
 b AS (SELECT DISTINCT brand FROM found), cl AS (SELECT brand, collection, count(*) n FROM found GROUP BY 1, 2)
 SELECT 'Brands' AS grp, rank, label FROM (SELECT row_number() OVER (ORDER BY brand) AS rank, brand AS label FROM b) WHERE rank <= 3
 UNION ALL SELECT 'Collections', rank, label FROM (SELECT row_number() OVER (ORDER BY n DESC, collection, brand) AS rank,
  brand || ' ' || collection AS label FROM cl) WHERE rank <= 3
 UNION ALL SELECT 'References', rank, label FROM (SELECT row_number() OVER (ORDER BY id) AS rank,
  concat_ws(' ', brand, reference) AS label FROM found) WHERE rank <= 5
 UNION ALL SELECT 'Suggested searches', 1, 'Brand#1'
 UNION ALL SELECT 'Suggested searches', 2, min(brand) || ' watches under 40mm' FROM b HAVING count(*) > 0""")
def _(t):
    found = t.catalog.where(F.lower("brand").startswith("brand#1")).withColumns(
        {"tier": F.lit(3), "score": F.lit(None).cast("double")})
    out = se.suggest(t.catalog.select("brand").distinct(), found, "Brand#1", {})
    return out.select("grp", F.col("rank").cast("long").alias("rank"), "label")


@query("suggest_groups", f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY count(*) DESC, collection, brand) AS rank, brand || ' ' || collection AS label
 FROM catalog WHERE reference_key LIKE 'sm%' GROUP BY brand, collection QUALIFY rank <= 3""")
def _(t):
    found = t.catalog.where(F.col("reference_key").startswith("sm")).withColumns({"tier": F.lit(1), "score": F.lit(None).cast("double")})
    out = se.suggest(t.catalog.select("brand").distinct(), found, "sm", {}).where(F.col("grp") == "Collections")
    return out.select(F.col("rank").cast("long").alias("rank"), "label")


_RELAX = [("brand", "brand IN ('Brand#7','Brand#8')"), ("collection", "collection = 'LARGE'"),
          ("complication", "contains(model, 'gear')"), ("diameter.max", "diameter <= 12"), ("diameter.min", "diameter >= 44")]
_RELAX_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS key, {i} AS ord, count(*) FILTER (WHERE " + " AND ".join(f"({c})" for j, (_, c) in enumerate(_RELAX) if j != i)
    + ") AS n FROM catalog" for i, (k, _) in enumerate(_RELAX))


@query("relaxations", f"""WITH {CATALOG} SELECT key, ord, n FROM ({_RELAX_SQL}) WHERE n > 0 ORDER BY ord LIMIT 3""")
def _(t):
    return se.relaxations(t.catalog, {
        "brand": F.col("brand").isin("Brand#7", "Brand#8"), "collection": F.col("collection") == "LARGE",
        "complication": F.col("model").contains("gear"), "diameter.max": F.col("diameter") <= 12,
        "diameter.min": F.col("diameter") >= 44})


# --- comparison rules -------------------------------------------------------------------------------------------

def _fields():
    return {
        "diameter": rl.Field("diameter", "number", F.col("diameter")),
        "retail": rl.Field("retail", "number", F.col("retail")),
        "model": rl.Field("model", "text", F.col("model")),
        "reference": rl.Field("reference", "text", F.col("reference")),
        "movement": rl.Field("movement", "text", rl.movement_or_null(
            F.when(F.col("collection") == "PROMO", "Not specified").otherwise(F.col("collection")))),
    }


@query("rule_known", f"WITH {CATALOG} SELECT id FROM catalog WHERE reference IS NOT NULL")
def _(t):
    return rl.match_rules(t.catalog, [rl.Rule("reference", "known")], _fields()).select("id")


@query("rule_numeric", f"WITH {CATALOG} SELECT id FROM catalog WHERE diameter BETWEEN 12 AND 30 AND retail >= 920 AND retail <= 980")
def _(t):
    rules = [rl.Rule("diameter", "between", "12", "30"), rl.Rule("retail", "gte", "920"), rl.Rule("retail", "lte", "980")]
    return rl.match_rules(t.catalog, rules, _fields()).select("id")


@query("rule_equals", f"""WITH {CATALOG} SELECT id FROM catalog WHERE lower(model) = 'hot ring'""")
def _(t):
    return rl.match_rules(t.catalog, [rl.Rule("model", "equals", "Hot RING")], _fields()).select("id")


@query("rule_text", f"""WITH {CATALOG} SELECT id FROM catalog WHERE lower(model) LIKE '%ring%' AND lower(model) NOT LIKE '%red%'
 AND lower(reference) LIKE '%la%'""")
def _(t):
    rules = [rl.Rule("model", "contains", "RING"), rl.Rule("model", "excludes", "Red"), rl.Rule("reference", "contains", "la")]
    return rl.match_rules(t.catalog, rules, _fields()).select("id")


@query("rule_price", f"""WITH {PRICES} SELECT id, source, currency, amount FROM prices WHERE amount <= 7000 AND currency = 'USD'""")
def _(t):
    fields = {"price": rl.Field("price", "price", F.col("amount"), F.col("currency"))}
    rows = rl.match_rules(t.prices, [rl.Rule("price", "lte", "7000", currency="USD")], fields)
    return rows.select("id", "source", "currency", "amount")


@query("rule_unknown", f"""WITH {CATALOG} SELECT id, diameter IS NOT NULL AND diameter <= 20 AS strict,
 diameter IS NULL OR diameter <= 20 AS lenient,
 reference IS NOT NULL AND NOT contains(lower(reference), 'la') AS excluded FROM catalog""")
def _(t):
    f = _fields()
    low, ex = rl.Rule("diameter", "lte", "20"), rl.Rule("reference", "excludes", "LA")
    return t.catalog.select("id", rl.rule_predicate(low, f).alias("strict"), rl.rule_predicate(low, f, True).alias("lenient"),
                            rl.rule_predicate(ex, f).alias("excluded"))


@query("rule_report", f"""WITH {CATALOG} SELECT id, coalesce(diameter <= 30, false) AND coalesce(reference LIKE '%LA%', false) AS passes,
 (diameter IS NULL)::INT + (reference IS NULL)::INT AS unknown_count FROM catalog""")
def _(t):
    rules = [rl.Rule("diameter", "lte", "30"), rl.Rule("reference", "contains", "la")]
    return rl.evaluate_rules(t.catalog, rules, _fields()).select("id", "passes", "unknown_count")


@query("rule_defaults", f"""WITH {CATALOG} SELECT id, nullif(CASE WHEN collection = 'PROMO' THEN 'Not specified' ELSE collection END, 'Not specified') AS movement,
 coalesce(CASE WHEN collection = 'SMALL' THEN 'Pocket watch' END, 'Wristwatch') AS kind,
 CASE WHEN collection = 'LARGE' THEN 'October' ELSE '2023–2024 archive' END AS captured FROM catalog""")
def _(t):
    kind = F.when(F.col("collection") == "SMALL", "Pocket watch").otherwise("")
    captured = F.when(F.col("collection") == "LARGE", "October").otherwise(" ")
    return t.catalog.select("id", _fields()["movement"].expr.alias("movement"), rl.kind_or_default(kind).alias("kind"),
                            rl.captured_or_archive(captured).alias("captured"))


@query("difference_rows", f"""WITH {CATALOG} SELECT brand, field, n > 1 AS differs FROM (
 SELECT brand, 'diameter' AS field, count(DISTINCT coalesce(CAST(diameter AS VARCHAR), '?')) AS n FROM catalog GROUP BY brand
 UNION ALL SELECT brand, 'collection', count(DISTINCT collection) FROM catalog GROUP BY brand
 UNION ALL SELECT brand, 'maker', count(DISTINCT substr(brand, 1, 5)) FROM catalog GROUP BY brand)""")
def _(t):
    return rl.difference_rows(t.catalog, "brand", {"diameter": F.col("diameter"), "collection": F.col("collection"),
                                                   "maker": F.substring("brand", 1, 5)})


@query("search_batch", f"""WITH {CATALOG}, specs AS (SELECT c_custkey AS spec, 'Brand#' || (1 + c_nationkey % 25) AS brand,
  CAST(5 + c_nationkey AS DOUBLE) AS max_diameter FROM customer)
 SELECT s.spec, count(c.id) AS n FROM specs s LEFT JOIN catalog c ON c.brand = s.brand AND c.diameter <= s.max_diameter GROUP BY 1""")
def _(t):
    # Many specs at once: the catalog is counted per (brand, diameter) and specs are told apart by what they ask. Only
    # distinct limits meet distinct diameters, whatever the number of specs and products.
    specs = t.customer.select(F.col("c_custkey").alias("spec"), F.concat(F.lit("Brand#"), 1 + F.col("c_nationkey") % 25).alias("brand"),
                              (5 + F.col("c_nationkey")).cast("double").alias("max_diameter"))
    bins = t.catalog.where("diameter is not null").groupBy("brand", "diameter").agg(F.count("*").alias("n"))
    asked = specs.select("brand", "max_diameter").distinct()
    found = asked.join(bins, "brand").where("diameter <= max_diameter").groupBy("brand", "max_diameter").agg(F.sum("n").alias("n"))
    joined = specs.join(found, ["brand", "max_diameter"], "left")
    return joined.select("spec", F.coalesce("n", F.lit(0)).alias("n"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_WORDS_OF = {"brand": [f"Brand#{i}" for i in range(1, 26)], "collection": _TYPES, "complication": ["gear", "ring", "bolt", "widget"]}


def _asked(t):
    """One search text per customer, read by the annotator."""
    brand, kind = F.concat(F.lit("Brand#"), 1 + F.col("c_nationkey") % 25), F.col("c_custkey") % 5
    limit = 5 + F.col("c_nationkey")
    text = (F.when(kind == 0, F.concat(F.lit("Show me "), F.lower(F.element_at(F.array(*map(F.lit, _TYPES)), (1 + F.col("c_custkey") % 6).cast("int"))),
                                       F.lit(" "), brand, F.lit(" watches under "), limit, F.lit("mm")))
            .when(kind == 1, F.concat(brand, F.lit(" gear over 20mm"))).when(kind == 2, "watches below USD 2k")
            .when(kind == 3, F.concat(F.lit("Red "), brand)).otherwise("LA0001"))
    rows = t.customer.select(F.col("c_custkey").alias("spec"), text.alias("q"))
    # Each distinct text is read once, by all tasks; a left join, so that the customers are never broadcast.
    return rows.join(annotate_queries(rows.select("q").distinct(), "q", _WORDS_OF), "q", "left")


_SPECS = f"""WITH {CATALOG}, {PRICES}, specs AS (SELECT c_custkey AS spec, c_custkey % 5 AS kind, 'Brand#' || (1 + c_nationkey % 25) AS brand,
  list_extract({_TYPES}, 1 + c_custkey % 6) AS type, 5 + c_nationkey AS mm FROM customer),
 priced AS (SELECT c.*, p.amount AS price FROM catalog c LEFT JOIN prices p ON p.id = c.id AND p.source = 'official_retail' AND p.currency = 'USD'),
 answered AS (SELECT s.spec, c.id, CASE WHEN kind = 4 THEN CASE WHEN c.reference_key = 'la0001' THEN 0 ELSE 1 END ELSE 3 END AS tier, c.price, kind >= 3 AS scored
 FROM specs s JOIN priced c ON CASE kind WHEN 0 THEN c.brand = s.brand AND c.collection = s.type AND c.diameter < s.mm
  WHEN 1 THEN c.brand = s.brand AND list_contains(string_split(c.model, ' '), 'gear') AND c.diameter > 20 WHEN 2 THEN c.price < 2000
  WHEN 3 THEN c.brand = s.brand AND list_contains(string_split(c.model, ' '), 'red') ELSE c.reference_key LIKE 'la0001%' END)"""


def _answered(t, operator):
    fields = {"identity": F.concat_ws(" ", "brand", "collection", "model"), "reference_key": F.col("reference_key")}
    index = tx.build_postings(t.catalog, "id", fields), tx.build_doc_stats(t.catalog, "id", fields)
    return operator(t.catalog, t.facets, t.prices, _asked(t), {"diameter": F.col("diameter")}, index)


@query("search_specs", f"{_SPECS} SELECT spec, id, tier, price, scored FROM answered")
def _(t):
    return _answered(t, sm.search_specs).select("spec", "id", "tier", "price", F.col("score").isNotNull().alias("scored"))


@query("search_specs_pages", f"""{_SPECS} SELECT spec, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY tier, id) AS rank FROM answered
 WHERE spec % 5 < 3) WHERE rank <= 24""")
def _(t):
    # Requests without a text: their order is known to the oracle as well.
    pages = _answered(t, sm.search_pages).where(F.col("spec") % 5 < 3)
    return pages.select("spec", F.col("rank").cast("long").alias("rank"), "id")


@query("search_specs_scores", f"""WITH {CATALOG}, {_bm25_sql('catalog', _ID_FIELDS, [('large', False), ('gea', True)])}
 SELECT n.n_nationkey AS spec, id, round(score, 6) AS score FROM scored, nation n""")
def _(t):
    fields = {"identity": F.concat_ws(" ", "brand", "collection", "model"), "reference_key": F.col("reference_key")}
    specs = t.nation.select(F.col("n_nationkey").alias("spec"), F.lit(None).cast("map<string,array<string>>").alias("facets"),
                            F.lit(None).cast("map<string,double>").alias("bounds"), F.lit(None).cast("string").alias("currency"), F.lit(" Large gea").alias("rest"))
    index = tx.build_postings(t.catalog, "id", fields), tx.build_doc_stats(t.catalog, "id", fields)
    found = sm.search_specs(t.catalog, t.facets, t.prices, specs, {"diameter": F.col("diameter")}, index)
    return found.select("spec", "id", F.round("score", 6).alias("score"))
