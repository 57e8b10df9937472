"""Catalog integration, reconciliation, precedence and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions.dates import is_active
from catalogspark.functions.records import validation_errors
from catalogspark.operators import crawl as cr
from catalogspark.operators import evidence as ev
from catalogspark.operators import extraction as ex
from catalogspark.operators import merge as mg
from catalogspark.operators import ordered as od
from catalogspark.operators import quality as ql
from catalogspark.operators import reconcile as rc
from catalogspark.plans.registry import CATALOG, query

_TARGETS = ("Brand#1", "Brand#2")


def _current(t):
    reference = F.concat(F.lit("R"), F.format_string("%06d", "p_partkey"), F.lit("/A"))
    return t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"), reference.alias("reference"),
                         F.col("p_name").alias("model"), F.col("p_retailprice").alias("price"), F.lit("archive").alias("status"))


def _captures(t):
    bought = t.orders.select(F.col("o_custkey").alias("p_partkey"))
    seen = t.part.join(bought, "p_partkey", "left_semi").where(F.col("p_brand").isin(*_TARGETS)).select(
        F.concat(F.lit("new-"), "p_partkey").alias("id"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("r"), F.format_string("%06d", "p_partkey"), F.lit(" a")).alias("reference"),
        F.upper("p_name").alias("model"), (F.col("p_retailprice") + 100).alias("price"))
    added = t.supplier.select(F.concat(F.lit("new-s"), "s_suppkey").alias("id"), F.lit("Brand#1").alias("brand"),
                              F.concat(F.lit("S"), F.col("s_suppkey")).alias("reference"), F.col("s_name").alias("model"),
                              F.col("s_acctbal").alias("price"))
    return seen.unionByName(added)


def _merge(t, current):
    return mg.merge_refresh(current, _captures(t), F.col("brand").isin(*_TARGETS), ["model", "price"],
                            {"price": F.lit(None).cast("double")})


_MERGED = """current AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, printf('R%06d/A', p_partkey) AS reference, p_name AS model,
  p_retailprice AS price, 'archive' AS status FROM part),
 captures AS (SELECT 'new-' || p_partkey AS id, p_brand AS brand, printf('r%06d a', p_partkey) AS reference, upper(p_name) AS model, p_retailprice + 100 AS price
  FROM part WHERE p_brand IN ('Brand#1','Brand#2') AND p_partkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'new-s' || s_suppkey, 'Brand#1', 'S' || s_suppkey, s_name, s_acctbal FROM supplier),
 o AS (SELECT *, brand || '|' || regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') AS k FROM current WHERE brand IN ('Brand#1','Brand#2')),
 n AS (SELECT *, brand || '|' || regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') AS k FROM captures),
 merged AS (SELECT * FROM current WHERE brand NOT IN ('Brand#1','Brand#2') UNION ALL
  SELECT coalesce(o.id, n.id), coalesce(n.brand, o.brand), coalesce(n.reference, o.reference), CASE WHEN n.id IS NOT NULL THEN n.model ELSE o.model END,
  CASE WHEN n.id IS NOT NULL THEN n.price END, CASE WHEN n.id IS NOT NULL THEN 'verified' ELSE 'unverified' END FROM o FULL JOIN n ON o.k = n.k)"""


@query("merge_refresh", f"WITH {_MERGED} SELECT id, brand, reference, model, price, status FROM merged")
def _(t):
    return _merge(t, _current(t)).select("id", "brand", "reference", "model", "price", "status")


@query("merge_idempotent", "SELECT 0 AS only_left, 0 AS only_right")
def _(t):
    once = _merge(t, _current(t))
    return rc.set_equality(once, _merge(t, once))


@query("unchanged_rest", "SELECT 0 AS only_left, 0 AS only_right")
def _(t):
    outside = ~F.col("brand").isin(*_TARGETS)
    before = _current(t)
    return rc.set_equality(before.where(outside), _merge(t, before).where(outside).select(*before.columns))


@query("ambiguous_keys", """SELECT l_shipmode AS match_key, n FROM (SELECT p_brand || '|' || upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS l_shipmode, count(*) AS n
 FROM part GROUP BY 1) WHERE n > 1""")
def _(t):
    return mg.ambiguous_keys(t.part.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("reference")))


@query("historical_mask", """SELECT p_partkey AS id, CASE WHEN number <> '' AND number <> shown THEN 'mismatched' ELSE 'not_currently_verified' END AS identity_status,
 CASE WHEN NOT (number <> '' AND number <> shown) THEN p_name END AS material, CAST(NULL AS VARCHAR) AS image, 'unverified' AS status,
 CASE WHEN NOT (number <> '' AND number <> shown) THEN p_size END AS size
 FROM (SELECT *, CASE WHEN p_size < 30 THEN CAST(1000 + p_size AS VARCHAR) ELSE '' END AS number, CAST(1000 + p_size % 20 AS VARCHAR) AS shown FROM part)""")
def _(t):
    model = F.when(F.col("p_size") < 30, F.concat(F.lit("Tradition "), 1000 + F.col("p_size"))).otherwise("Tradition")
    rows = t.part.select(F.col("p_partkey").alias("id"), model.alias("model"),
                         F.concat(1000 + F.col("p_size") % 20, F.lit("BR/G9")).alias("reference"), F.col("p_name").alias("material"),
                         F.col("p_size").alias("size"), F.lit("https://img").alias("image"))
    out = mg.historical_mask(rows, "model", "reference", {"image": F.lit(None).cast("string")}, ["material", "size"])
    return out.select("id", "identity_status", "material", "image", "status", "size")


@query("replace_dataset", """WITH imported AS (SELECT o_orderkey AS id, o_orderpriority AS dataset, o_totalprice + 1 AS price FROM orders WHERE o_orderpriority IN ('2-HIGH','5-LOW') AND o_orderstatus = 'F')
 SELECT o_orderkey AS id, o_orderpriority AS dataset, o_totalprice AS price FROM orders WHERE o_orderpriority NOT IN (SELECT dataset FROM imported)
 UNION ALL SELECT * FROM imported""")
def _(t):
    catalog = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("price"))
    imported = t.orders.where(F.col("o_orderpriority").isin("2-HIGH", "5-LOW") & (F.col("o_orderstatus") == "F")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dataset"), (F.col("o_totalprice") + 1).alias("price"))
    return mg.replace_dataset(catalog, imported).select("id", "dataset", "price")


@query("inventory_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT o_custkey FROM orders)")
def _(t):
    inventory = t.orders.select(F.col("o_custkey").alias("l_partkey"))
    return rc.in_inventory(t.lineitem, inventory, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("remaining_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    done = t.orders.select(F.col("o_custkey").alias("p_partkey"))
    return rc.remaining(t.part.select("p_partkey"), done, "p_partkey")


@query("listing_detail_agree", """SELECT l.l_partkey, l.l_orderkey, l.l_linenumber, concat_ws('; ', CASE WHEN l.l_quantity IS DISTINCT FROM p.p_size THEN 'size differs' END,
 CASE WHEN floor(l.l_extendedprice / l.l_quantity) IS DISTINCT FROM floor(p.p_retailprice) THEN 'price differs' END) AS errors
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    checked = rc.agreement_errors(joined, {
        "size differs": (F.col("l_quantity"), F.col("p_size").cast("double")),
        "price differs": (F.floor(F.col("l_extendedprice") / F.col("l_quantity")), F.floor("p_retailprice"))})
    return checked.select("l_partkey", "l_orderkey", "l_linenumber", F.array_join("errors", "; ").alias("errors"))


@query("reconcile_sets", """WITH a AS (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unexpected'
  WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' END AS status FROM a FULL JOIN b ON a.k = b.k) WHERE status IS NOT NULL""")
def _(t):
    return rc.reconcile_sets(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@query("row_diff", """SELECT p_partkey AS id, 'price' AS field, CAST(p_retailprice AS VARCHAR) AS left_value, CAST(p_retailprice + 1 AS VARCHAR) AS right_value
 FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'name', p_name, NULL FROM part WHERE p_type = 'SMALL'""")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("name"),
                      F.when(F.col("p_size") > 40, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"))
    return rc.diff_rows(a, b, "id", ["name", "price"])


@query("proof_join", """SELECT p.p_partkey AS id, CASE WHEN p_size > 10 THEN 'Unverified image' ELSE 'Unexplained missing image' END AS violation FROM part p
 WHERE (p_size > 10 AND p_partkey NOT IN (SELECT o_custkey FROM orders)) OR (p_size <= 10 AND p_type <> 'SMALL')""")
def _(t):
    url = F.concat(F.lit("https://img.example/"), F.col("o_custkey"))
    proofs = t.orders.select(url.alias("url"), F.lit("working").alias("proof_status")).distinct()
    records = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.concat(F.lit("https://img.example/"), "p_partkey")).alias("image_url"),
        F.when(F.col("p_type") == "SMALL", "not_published_by_source").alias("image_status"))
    return mg.require_proof(records, proofs).select("id", "violation")


@query("coalesce_lists", """SELECT l_partkey AS reference, arg_min(l_quantity, l_orderkey * 10000000000 + l_suppkey * 100 + l_linenumber * 10) AS first_quantity, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS lists
 FROM (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(t):
    items = t.lineitem.groupBy("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag").agg(F.min("l_quantity").alias("first_quantity"))
    ord_ = F.col("l_orderkey") * 10000000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber") * 10
    items = items.select(F.col("l_partkey").alias("reference"), "first_quantity", F.col("l_returnflag").alias("listing"), ord_.alias("ord"))
    out = mg.coalesce_lists(items, "reference", "listing", "ord", ["first_quantity"])
    return out.select("reference", "first_quantity", F.array_join("lists", ",").alias("lists"))


@query("enrich_sources", """WITH s AS (SELECT p_brand AS brand, p_name AS ref, p_partkey AS ord, CASE WHEN p_size > 20 THEN p_type END AS kind, CASE WHEN p_size < 30 THEN p_size END AS size FROM part)
 SELECT brand, ref, arg_min(kind, ord) FILTER (WHERE kind IS NOT NULL) AS kind, arg_min(size, ord) FILTER (WHERE size IS NOT NULL) AS size, count(*) AS n_sources FROM s GROUP BY 1, 2""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("ref"), F.col("p_partkey").alias("ord"),
                         F.when(F.col("p_size") > 20, F.col("p_type")).alias("kind"), F.when(F.col("p_size") < 30, F.col("p_size")).alias("size"))
    return mg.enrich(rows, ["brand", "ref"], ["kind", "size"], "ord")


@query("link_targets", """SELECT DISTINCT 'https://shop.example/' || p_type AS url, p_partkey AS id, 'page' AS kind FROM part
 UNION SELECT DISTINCT 'https://img.example/' || p_brand, p_partkey, 'image' FROM part WHERE p_size > 10""")
def _(t):
    image = F.when(F.col("p_size") > 10, F.concat(F.lit("https://img.example/"), "p_brand"))
    return mg.link_targets(t.part, "p_partkey", {"page": F.concat(F.lit("https://shop.example/"), "p_type"), "image": image})


@query("frontier", """WITH RECURSIVE links AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
 reach AS (SELECT max(p_partkey) AS node FROM part UNION SELECT 0 UNION SELECT l.dst FROM reach r JOIN links l ON l.src = r.node)
 SELECT node, CASE WHEN node = 0 OR node = (SELECT max(p_partkey) FROM part) THEN 'seed' ELSE 'link' END AS origin FROM reach""")
def _(t):
    links = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    seeds = t.part.agg(F.max("p_partkey").alias("hi"), F.min("p_partkey").alias("lo")).select(F.explode(F.array("hi", "lo")).alias("node"))
    return cr.expand_frontier(seeds, links).select("node", "origin")


@query("reuse_proofs", """SELECT DISTINCT 'u' || p_partkey AS url, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0) THEN 'reused' ELSE 'pending' END AS status FROM part""")
def _(t):
    url = F.concat(F.lit("u"), F.col("l_partkey"))
    status = F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0), "working").otherwise("unavailable")
    return rc.reuse_proofs(t.lineitem.select(url.alias("url"), status.alias("proof_status")),
                           t.part.select(F.concat(F.lit("u"), "p_partkey").alias("url")))


@query("union_distinct", """SELECT k, arg_min(src, src) AS src FROM (SELECT p_partkey AS k, 'catalog' AS src FROM part UNION ALL
 SELECT o_custkey, 'offers' FROM orders) GROUP BY 1""")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("k"), F.lit("catalog").alias("src"), F.col("p_partkey").alias("ord"))
    b = t.orders.select(F.col("o_custkey").alias("k"), F.lit("offers").alias("src"), F.col("o_orderkey").alias("ord"))
    return mg.union_distinct(a, b, "k", "ord").select("k", "src")


@query("set_equality", """SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT ALL SELECT o_custkey FROM orders)) AS only_left,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT p_partkey FROM part)) AS only_right""")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("k"))
    return rc.set_equality(a, t.orders.select(F.col("o_custkey").alias("k")))


@query("intersect_keys", "SELECT p_partkey AS k FROM part INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k")).intersect(t.orders.select(F.col("o_custkey").alias("k")))


@query("as_of_active", """SELECT o_orderkey AS id, o_orderdate <= TIMESTAMP '1999-06-01' AND (CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 400 DAY END IS NULL
 OR o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1999-06-01') AS active FROM orders""")
def _(t):
    run_out = F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + interval 400 days"))
    active = is_active(F.col("o_orderdate"), run_out, F.lit("1999-06-01").cast("timestamp_ntz"))
    return t.orders.select(F.col("o_orderkey").alias("id"), active.alias("active"))


@query("validate_errors", """SELECT p_partkey AS id, concat_ws('; ', CASE WHEN p_size > 48 THEN 'Missing identity field: reference_number' END,
 CASE WHEN p_type = 'SMALL' THEN 'Source URL must use HTTPS' END, CASE WHEN p_size < 5 THEN 'Case diameter outside wristwatch review range' END,
 CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 'Currency must be an ISO code' END) AS errors FROM part""")
def _(t):
    rows = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("specific_model"),
        F.when(F.col("p_size") <= 48, F.concat(F.lit("R"), "p_partkey")).alias("reference_number"),
        F.when(F.col("p_type") == "SMALL", "http://x/y").otherwise("https://x/y").alias("watch_URL"),
        F.concat("p_size", F.lit(",0 mm")).alias("diameter"), F.when(F.col("p_brand").isin(*_TARGETS), "usd").otherwise("USD").alias("currency"))
    return rows.select("id", F.array_join(validation_errors(), "; ").alias("errors"))


@query("dedupe_last", """SELECT l_partkey, l_suppkey, min(pos) AS first_pos, arg_max(q, pos) AS q FROM (SELECT l_partkey, l_suppkey, l_orderkey * 8 + l_linenumber AS pos, max(l_quantity) AS q
 FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = t.lineitem.groupBy("l_partkey", "l_suppkey", pos.alias("pos")).agg(F.max("l_quantity").alias("q"))
    return mg.dedupe_last(rows, ["l_partkey", "l_suppkey"], "pos", ["q"])


@query("first_by_priority", """SELECT p_brand AS page, p_type AS field, arg_min(v, prio) AS value, arg_min(loc, prio) AS locator FROM (
 SELECT p_brand, p_type, CASE WHEN p_size > 25 THEN p_name END AS v, 'size ' || p_size AS loc, p_retailprice * 100000 + p_partkey AS prio FROM part) WHERE v IS NOT NULL GROUP BY 1, 2""")
def _(t):
    facts = t.part.select(F.col("p_brand").alias("page"), F.col("p_type").alias("field"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" ").alias("value"),
                          F.concat(F.lit("size "), "p_size").alias("locator"), (F.col("p_retailprice") * 100000 + F.col("p_partkey")).alias("prio"))
    return mg.first_by_priority(facts, ["page", "field"], "value", "locator", ["prio"])


@query("first_capture", "SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def _(t):
    return mg.first_capture(t.lineitem, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_suppkey"])


@query("latest_state", "SELECT user_id AS key, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) AS props FROM events GROUP BY 1")
def _(t):
    return mg.latest_state(t.log, ["key"], ["ts", "event_id"], ["kind", "props"])


@query("top_sources", """SELECT l_partkey, l_suppkey, rank FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY d DESC NULLS LAST, l_suppkey) AS rank
 FROM (SELECT l_partkey, l_suppkey, max(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END) AS d FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3""")
def _(t):
    dated = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))).alias("d"))
    top = od.top_per_key(dated, ["l_partkey"], [F.col("d").desc_nulls_last(), F.col("l_suppkey").asc()], ev.REPORTS_PER_PRODUCT)
    return top.select("l_partkey", "l_suppkey", F.col("rank").cast("long").alias("rank"))


# Listing runs: an order is a run, its line number the page, its part the item.

@query("page_gaps", """WITH p AS (SELECT l_orderkey AS run, l_linenumber - 1 AS page, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT run, count(*) AS n_pages, min(page) = 0 AND count(*) = max(page) + 1 AS consecutive,
 count(*) FILTER (WHERE n = 2) - (arg_max(n, page) = 2)::INT = count(*) - 1 AS pages_full FROM p GROUP BY 1""")
def _(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("page"))
    return rc.page_gaps(items, "run", "page", 2)


@query("cumulative_pages", """WITH r AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS page, l_suppkey % 5 AS item FROM lineitem),
 s AS (SELECT run, page, lead(page) OVER (PARTITION BY run ORDER BY page) AS nxt FROM (SELECT DISTINCT run, page FROM r))
 SELECT r.run, max(r.page) AS last_page, count(*) FILTER (WHERE s.nxt IS NOT NULL AND h.item IS NULL) AS dropped
 FROM r JOIN s ON r.run = s.run AND r.page = s.page LEFT JOIN r h ON h.run = r.run AND h.page = s.nxt AND h.item = r.item GROUP BY 1""")
def _(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 5).alias("item"))
    return rc.cumulative_gaps(items, "run", "page", "item")


@query("page_sizes", """SELECT run, page, n_items, least(total, page * 24) AS expected, n_items = least(total, page * 24) AS ok FROM (
 SELECT l_suppkey AS run, l_linenumber AS page, count(*) AS n_items, max(l_suppkey * 3) AS total FROM lineitem GROUP BY 1, 2)""")
def _(t):
    items = t.lineitem.select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("page"))
    return rc.page_sizes(items, "run", "page", F.col("run") * 3)


@query("total_drift", """WITH p AS (SELECT o_custkey AS run, o_orderkey AS page, o_orderpriority AS total FROM orders),
 f AS (SELECT run, arg_min(total, page) AS first_total FROM p GROUP BY 1)
 SELECT p.run, f.first_total, count(*) FILTER (WHERE p.total <> f.first_total) AS n_drifted FROM p JOIN f ON p.run = f.run GROUP BY 1, 2 HAVING n_drifted > 0""")
def _(t):
    pages = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("total"))
    return rc.total_drift(pages, "run", "page", "total")


@query("totals_reconcile", """WITH d AS (SELECT s_suppkey AS k, CAST(round(s_acctbal / 15) AS BIGINT) AS declared FROM supplier), o AS (SELECT l_suppkey AS k, count(*) AS observed FROM lineitem GROUP BY 1)
 SELECT coalesce(d.k, o.k) AS k, coalesce(declared, 0) AS declared, coalesce(observed, 0) AS observed, coalesce(declared, 0) = coalesce(observed, 0) AS ok FROM d FULL JOIN o ON d.k = o.k""")
def _(t):
    declared = t.supplier.select(F.col("s_suppkey").alias("k"), F.round(F.col("s_acctbal") / 15).cast("long").alias("declared"))
    return rc.totals_reconcile(declared, t.lineitem.select(F.col("l_suppkey").alias("k")), "k")


@query("work_order", """SELECT event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS kind_rank FROM events""")
def _(t):
    kind = F.when(F.col("event_type") == "signup", "sitemap").when(F.col("event_type") == "view", "listing").otherwise("product")
    return cr.work_order(t.events.withColumn("kind", kind)).select("event_id", "kind_rank")


# Extraction steps over facts derived from the catalog.

@query("eav_pivot", f"""WITH {CATALOG} SELECT CAST(id AS VARCHAR) AS page_id, CASE WHEN diameter IS NOT NULL THEN CAST(CAST(diameter AS INT) AS VARCHAR) || ' mm' END AS diameter,
 brand || ' steel' AS case_material, CASE WHEN collection = 'LARGE' THEN model ELSE collection END AS features FROM catalog""")
def _(t):
    text = F.concat(F.col("diameter").cast("int"), F.lit("  mm"))
    pairs = F.array(
        F.struct(F.lit("Case-Diameter:").alias("label"), text.alias("value"), F.lit(1).alias("ord")),
        F.struct(F.lit("CASE MATERIAL").alias("label"), F.concat("brand", F.lit(" steel")).alias("value"), F.lit(2).alias("ord")),
        F.struct(F.lit("Features").alias("label"), F.col("collection").alias("value"), F.lit(4).alias("ord")),
        F.struct(F.when(F.col("collection") == "LARGE", "Functions").otherwise("Unmapped").alias("label"), F.col("model").alias("value"), F.lit(3).alias("ord")))
    facts = t.catalog.select(F.col("id").cast("string").alias("page_id"), F.inline(pairs)).withColumns(
        {"section": F.lit("Case"), "locator": F.lit("dl")})
    fields = ex.map_fields(facts, ex.mapping_table(t.spark))
    return ex.pivot_records(fields).select("page_id", "diameter", "case_material", "features")


@query("single_offer", "SELECT l_partkey, l_suppkey, count(*) AS n_offers, CASE WHEN count(*) = 1 THEN min(l_extendedprice) END AS price FROM lineitem GROUP BY 1, 2")
def _(t):
    return ex.single_offer(t.lineitem, ["l_partkey", "l_suppkey"], "l_extendedprice")


@query("identity_gate", """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('; ', CASE WHEN l_suppkey IS DISTINCT FROM l_partkey % 100 THEN 'sku differs' END,
 CASE WHEN l_orderkey % 7 IS DISTINCT FROM l_partkey % 7 THEN 'canonical differs' END) AS errors FROM lineitem""")
def _(t):
    rows = t.lineitem.withColumns({"sku": F.col("l_suppkey") == F.col("l_partkey") % 100, "canonical": F.col("l_orderkey") % 7 == F.col("l_partkey") % 7})
    gated = ql.identity_gate(rows, {"sku": F.col("sku"), "canonical": F.col("canonical")}, F.lit(True))
    return gated.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("errors", "; ").alias("errors"))


@query("discrepancies", """SELECT * FROM (SELECT l_partkey AS page, l_linenumber AS field, min(l_quantity) FILTER (WHERE l_returnflag = 'A') AS selected,
 min(l_quantity) FILTER (WHERE l_returnflag <> 'A') AS other FROM lineitem GROUP BY 1, 2) WHERE selected <> other""")
def _(t):
    facts = t.lineitem.select(F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("field"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("value"))
    return ql.discrepancies(facts, ["page", "field"], "source", "value", "A")
