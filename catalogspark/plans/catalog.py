"""Catalog projection, summaries and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions.records import coverage_pct, present
from catalogspark.functions.terms import classify_segment
from catalogspark.operators import evidence as ev
from catalogspark.operators import merge as mg
from catalogspark.operators import quality as ql
from catalogspark.operators import summary as sm
from catalogspark.operators.normalise import diameter_eligible, watch_kind
from catalogspark.operators.ordered import upper_median
from catalogspark.plans.registry import CATALOG, FACETS, PRICES, query
from catalogspark.sources import index as ix
from catalogspark.sources.writers import compare_csv, compare_table

_CORE = ["reference", "model", "diameter", "collection", "brand"]


@query("category_filter", f"""WITH {CATALOG} SELECT brand, count(*) FILTER (WHERE collection <> 'PROMO') AS products,
 count(*) FILTER (WHERE collection = 'PROMO') AS excluded FROM catalog GROUP BY 1""")
def _(t):
    is_product = F.col("collection") != "PROMO"
    return t.catalog.groupBy("brand").agg(F.count_if(is_product).alias("products"), F.count_if(~is_product).alias("excluded"))


@query("index_counts", f"""WITH {CATALOG}, {FACETS}, {PRICES} SELECT 'products' AS relation, count(*) AS n FROM catalog
 UNION ALL SELECT 'facets', count(*) FROM facets UNION ALL SELECT 'prices', count(*) FROM prices
 UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(model || ' ' || collection), '[a-z0-9]+')) FROM catalog)
 UNION ALL SELECT 'doc_stats', count(*) FROM catalog""")
def _(t):
    index = ix.build_index(
        t.catalog.drop("reference_key", "model_key"),
        {"brand": F.array("brand"), "collection": F.array("collection"), "complication": F.split("model", " ")},
        ix.build_prices(t.prices, "id", F.col("source"), F.col("currency"), F.col("amount"), F.col("captured")),
        {"identity": F.concat_ws(" ", "model", "collection")})
    parts = {"products": index.products, "facets": index.facets, "prices": index.prices, "postings": index.postings,
             "doc_stats": index.doc_stats}
    counts = [df.agg(F.lit(name).alias("relation"), F.count("*").alias("n")) for name, df in parts.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query("card_projection", f"""WITH {CATALOG} SELECT id, brand, collection, model, reference, diameter FROM catalog""")
def _(t):
    rows = t.catalog.withColumns({"description": F.concat("brand", "model"), "image_urls": F.array("model")})
    return ix.card(rows).select("id", "brand", "collection", "model", "reference", "diameter")


@query("featured_per_brand", f"""WITH {CATALOG} SELECT brand, min(id) AS id FROM catalog WHERE reference IS NOT NULL
 AND brand IN ('Brand#3','Brand#1','Brand#2') GROUP BY 1""")
def _(t):
    return ix.bootstrap(t.catalog, ["Brand#3", "Brand#1", "Brand#2"], image="reference").select("brand", "id")


@query("eligible_identities", f"""WITH {CATALOG} SELECT id, brand, reference, model FROM catalog WHERE length(reference) >= 3
 AND id NOT IN (SELECT s_suppkey FROM supplier)""")
def _(t):
    priced = t.supplier.select(F.col("s_suppkey").alias("id"))
    return ev.eligible_identities(t.catalog, priced).select("id", "brand", "reference", "model")


@query("price_source_label", """SELECT p_partkey AS id, CASE WHEN p_type = 'LARGE' THEN 'official_retail' ELSE 'recorded_catalog' END AS source FROM part""")
def _(t):
    kind = F.when(F.col("p_type") == "LARGE", "Official catalog").otherwise("Archive")
    return t.part.select(F.col("p_partkey").alias("id"), ix.price_source(kind).alias("source"))


@query("currencies", f"WITH {PRICES} SELECT DISTINCT currency FROM prices")
def _(t):
    return sm.distinct_values(t.prices, "currency")


@query("extra_labels", """SELECT DISTINCT unnest(['type ' || p_type, 'brand ' || p_brand]) AS label FROM part""")
def _(t):
    specs = F.array(*[F.struct(F.concat(F.lit(f"{k} "), F.col(c)).alias("label"), F.lit("x").alias("value"))
                      for k, c in (("type", "p_type"), ("brand", "p_brand"))])
    return sm.extra_labels(t.part.select(specs.alias("extra_specs")))


@query("extra_spec_rule", """SELECT p_partkey AS id, CASE WHEN p_type = 'LARGE' THEN p_name || '; ' || p_brand ELSE p_name END AS warranty FROM part""")
def _(t):
    from catalogspark.operators.rules import extra_spec
    spec = F.struct(F.lit("Warranty").alias("label"), F.col("p_name").alias("value"))
    second = F.struct(F.when(F.col("p_type") == "LARGE", "Warranty").otherwise("Other").alias("label"), F.col("p_brand").alias("value"))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.array(spec, second).alias("extra_specs"))
    return rows.select("id", extra_spec("Warranty").alias("warranty"))


@query("top_collections", f"""WITH {CATALOG} SELECT model, count(*) AS n FROM catalog GROUP BY 1 ORDER BY n DESC, model LIMIT 8""")
def _(t):
    return sm.top_counts(t.catalog, ["model"], 8)


_PCT = "CAST(round(((reference IS NOT NULL)::INT + 1 + (diameter IS NOT NULL)::INT + 2) * 100 / 5.0) AS INT)"


@query("coverage_pct", f"WITH {CATALOG} SELECT id, {_PCT} AS coverage FROM catalog")
def _(t):
    return t.catalog.select("id", coverage_pct(_CORE).alias("coverage"))


@query("brand_summary", f"""WITH {CATALOG} SELECT brand, count(*) AS records, CAST(round(avg({_PCT})) AS INT) AS coverage,
 count(DISTINCT collection) AS families, count(reference) AS has_reference, count(diameter) AS has_diameter FROM catalog GROUP BY 1""")
def _(t):
    return sm.brand_summary(t.catalog, "brand", "collection", coverage_pct(_CORE), ["reference", "diameter"])


_SEGMENTS = (("Chronograph", r"\bgear\b"), ("Diving", r"\bbolt\b|\bring\b"), ("Travel", r"\bhot\b"))
_SEGMENT_SQL = """CASE WHEN regexp_matches(model, '\\bgear\\b') THEN 'Chronograph' WHEN regexp_matches(model, '\\bbolt\\b|\\bring\\b') THEN 'Diving'
 WHEN regexp_matches(model, '\\bhot\\b') THEN 'Travel' ELSE 'Time & date' END"""


@query("segment_class", f"WITH {CATALOG} SELECT id, {_SEGMENT_SQL} AS segment FROM catalog")
def _(t):
    return t.catalog.select("id", classify_segment("model", _SEGMENTS).alias("segment"))


@query("insights_gs", f"""WITH {CATALOG}, rows AS (SELECT brand, {_SEGMENT_SQL} AS segment, CASE WHEN collection NOT IN ('SMALL', 'PROMO') THEN diameter END AS m,
 contains(model, 'red')::INT AS g, model FROM catalog)
 SELECT CASE WHEN grouping_id(brand, segment) = 3 THEN 'overall' WHEN grouping_id(brand, segment) = 1 THEN 'brand' ELSE 'segment' END AS scope,
 coalesce(brand, segment, 'all') AS name, count(*) AS n, count(m) AS measured, round(avg(m), 6) AS mean_measure, count(*) - count(m) AS excluded,
 CAST(sum(g) AS BIGINT) AS mentions, count(DISTINCT model) AS calibers FROM rows GROUP BY GROUPING SETS ((), (brand), (segment))""")
def _(t):
    rows = t.catalog.withColumn("segment", classify_segment("model", _SEGMENTS))
    kind = watch_kind(F.when(F.col("collection") == "SMALL", "Pocket watch").otherwise("Watch"))
    display = F.when(F.col("collection") == "PROMO", F.lit("Diagonal 30 mm"))
    return sm.insights(rows, "brand", "segment", "diameter", diameter_eligible(kind, display), F.col("model").contains("red"), "model")


@query("catalog_stats", f"""WITH {CATALOG} SELECT count(*) AS records, count(DISTINCT brand || '|' || collection) AS families,
 CAST(round(sum((reference IS NOT NULL)::INT + (diameter IS NOT NULL)::INT + 3) * 100.0 / (count(*) * 5)) AS INT) AS coverage FROM catalog""")
def _(t):
    return sm.catalog_stats(t.catalog, "brand", "collection", _CORE)


@query("missing_fields", f"""WITH {CATALOG} SELECT field, n AS documented, total - n AS missing FROM (
 SELECT 'reference' AS field, count(reference) AS n, count(*) AS total FROM catalog UNION ALL
 SELECT 'model', count(model), count(*) FROM catalog UNION ALL SELECT 'diameter', count(diameter), count(*) FROM catalog UNION ALL
 SELECT 'collection', count(collection), count(*) FROM catalog UNION ALL SELECT 'brand', count(brand), count(*) FROM catalog)""")
def _(t):
    return sm.missing_report(t.catalog, _CORE)


_RULES = {"no reference": lambda: ~present("reference"), "too large": lambda: F.col("diameter") > 40,
          "promotion": lambda: F.col("collection") == "PROMO"}


@query("quarantine_split", f"""WITH {CATALOG} SELECT id, concat_ws('; ', CASE WHEN reference IS NULL THEN 'no reference' END,
 CASE WHEN diameter > 40 THEN 'too large' END, CASE WHEN collection = 'PROMO' THEN 'promotion' END) AS reasons FROM catalog
 WHERE reference IS NULL OR coalesce(diameter > 40, false) OR collection = 'PROMO'""")
def _(t):
    checked = ql.with_errors(t.catalog, {k: r() for k, r in _RULES.items()})
    rejected = ql.split_quarantine(checked)[1]
    return rejected.select("id", F.array_join("errors", "; ").alias("reasons"))


@query("quality_report", f"""WITH {CATALOG}, ok AS (SELECT *, reference IS NULL OR coalesce(diameter > 40, false) OR collection = 'PROMO' AS bad FROM catalog)
 SELECT 'accepted' AS metric, count(*) FILTER (WHERE NOT bad) AS n FROM ok UNION ALL SELECT 'quarantined', count(*) FILTER (WHERE bad) FROM ok
 UNION ALL SELECT 'missing_reference', count(*) FILTER (WHERE NOT bad AND reference IS NULL) FROM ok
 UNION ALL SELECT 'missing_diameter', count(*) FILTER (WHERE NOT bad AND diameter IS NULL) FROM ok""")
def _(t):
    checked = ql.with_errors(t.catalog, {k: r() for k, r in _RULES.items()})
    return ql.quality_report(checked, ["reference", "diameter"])


@query("event_counts", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.log.groupBy("kind").agg(F.count("*").alias("n"))


@query("listagg_values", """SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def _(t):
    return sm.concat_values(t.lineitem, ["l_orderkey"], "l_returnflag", "flags")


@query("capture_range", """SELECT o_orderpriority, min(d) AS first_date, max(d) AS last_date, count(DISTINCT d) AS n_dates,
 CASE WHEN min(d) = max(d) THEN min(d) ELSE min(d) || ' to ' || max(d) END AS label
 FROM (SELECT o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders) GROUP BY 1""")
def _(t):
    return sm.date_range(t.orders, ["o_orderpriority"], F.to_date("o_orderdate"))


@query("code_coverage", "SELECT code, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS code FROM events) GROUP BY 1")
def _(t):
    return sm.code_coverage(t.events, F.from_json("props", "map<string,string>"))


@query("sole_value", """SELECT l_partkey, l_suppkey, CASE WHEN count(DISTINCT l_quantity) = 1 THEN min(l_quantity) END AS quantity
 FROM lineitem GROUP BY 1, 2""")
def _(t):
    return sm.sole_value(t.lineitem, ["l_partkey", "l_suppkey"], "l_quantity", "quantity")


@query("key_conflicts", """SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY 1, 2
 HAVING count(DISTINCT l_partkey) > 1""")
def _(t):
    return sm.key_conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], "l_partkey")


@query("invariants", f"""WITH {CATALOG} SELECT 'unique ids' AS name, count(DISTINCT id) = count(*) AS ok, count(DISTINCT id) AS observed, count(*) AS expected FROM catalog
 UNION ALL SELECT 'kinds add up', count(*) FILTER (WHERE collection = 'SMALL') + count(*) FILTER (WHERE collection <> 'SMALL') = count(*),
  count(*) FILTER (WHERE collection = 'SMALL') + count(*) FILTER (WHERE collection <> 'SMALL'), count(*) FROM catalog
 UNION ALL SELECT 'every row has a reference', count(reference) = count(*), count(reference), count(*) FROM catalog""")
def _(t):
    small = F.col("collection") == "SMALL"
    return sm.invariants(t.catalog, {
        "unique ids": (F.countDistinct("id"), F.count("*")),
        "kinds add up": (F.count_if(small) + F.count_if(~small), F.count("*")),
        "every row has a reference": (F.count("reference"), F.count("*")),
    })


@query("event_percentiles", """SELECT event_type AS kind, count(*) AS n, list_sort(list(value))[1 + count(*) // 2] AS median_value, max(value) AS max_value
 FROM events GROUP BY 1""")
def _(t):
    return upper_median(t.log, ["kind"], "value", F.floor("value"))


@query("compare_pivot", f"""WITH {CATALOG}, best AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY collection ORDER BY retail DESC, id DESC) = 1),
 cells AS (SELECT collection, 'brand' AS field, brand AS v FROM best UNION ALL SELECT collection, 'reference', reference FROM best
  UNION ALL SELECT collection, 'price', printf('USD %d', CAST(floor(retail) AS BIGINT)) FROM best)
 SELECT field, max(v) FILTER (WHERE collection = 'ECONOMY') AS "ECONOMY", max(v) FILTER (WHERE collection = 'LARGE') AS "LARGE",
  max(v) FILTER (WHERE collection = 'PROMO') AS "PROMO" FROM cells GROUP BY field""")
def _(t):
    names = ["ECONOMY", "LARGE", "PROMO"]
    best = t.catalog.groupBy("collection").agg(F.max_by(F.struct("brand", "reference", "retail"), F.struct("retail", "id")).alias("b"))
    rows = best.where(F.col("collection").isin(*names)).select("collection", "b.*")
    price = F.concat(F.lit("USD "), F.floor("retail").cast("string"))
    return compare_table(rows, F.col("collection"), {"brand": F.col("brand"), "reference": F.col("reference"), "price": price}, names)


@query("compare_csv", f"""WITH {CATALOG}, best AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY collection ORDER BY retail DESC, id DESC) = 1),
 c AS (SELECT max(model) FILTER (WHERE collection = 'ECONOMY') AS a, max(model) FILTER (WHERE collection = 'LARGE') AS b FROM best)
 SELECT '"=model","''=' || a || '","''=' || b || '"' AS line FROM c""")
def _(t):
    best = t.catalog.groupBy("collection").agg(F.max_by("model", F.struct("retail", "id")).alias("model"))
    formula = F.concat(F.lit("="), F.col("model"))
    table = compare_table(best.where(F.col("collection").isin("ECONOMY", "LARGE")), F.col("collection"), {"model": formula},
                          ["ECONOMY", "LARGE"])
    return compare_csv(table).select(F.replace("line", F.lit('"model"'), F.lit('"=model"')).alias("line"))


@query("curated_order", f"""WITH {CATALOG} SELECT id, row_number() OVER (PARTITION BY brand ORDER BY (collection = 'PROMO')::INT, id) AS round,
 CASE brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END AS brand_rank FROM catalog""")
def _(t):
    position = F.array_position(F.array(F.lit("Brand#3"), F.lit("Brand#1")), F.col("brand"))
    rank = F.when(position > 0, position).otherwise(3).cast("int")
    rows = mg.curated_order(t.catalog, "brand", rank, F.col("collection") != "PROMO", "id", F.floor(F.col("id") / 100_000))
    return rows.select("id", "round", "brand_rank")


@query("first_values", """WITH v AS (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS m FROM lineitem) SELECT l_suppkey, string_agg(m, '; ' ORDER BY m) FILTER (WHERE k <= 3) AS days, count(*) AS n_values
 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m) AS k FROM v) GROUP BY 1""")
def _(t):
    return sm.first_values(t.lineitem.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), ["l_suppkey"], "day", 3, "days")
