"""Pages to records on small hand-written pages."""

import json

from pyspark.sql import functions as F

from catalogspark.operators import extraction as ex
from catalogspark.operators.json_graph import json_walk, own_products

URL, OTHER = "https://www.shop.example/watches/m1-0001", "https://www.shop.example/watches/m1-0002"


def facts(spark, html):
    return ex.extract_facts(spark.createDataFrame([("p", html)], "id string, html string"), "id", "html")


def found(spark, html, kind):
    return [(r["label"], r["value"]) for r in facts(spark, html).where(F.col("kind") == kind).orderBy("ord").collect()]


def test_fact_kinds(spark):
    html = """<html><head><title>T</title><meta name="description" content="short"><link rel="canonical" href="https://x/y"></head>
      <body><main><h1>Name <b>Two</b></h1><dl><dt>Case size</dt><dd>40 mm</dd><dt>Jewels<dd>25</dl>
      <table><tr><th>Glass</th><td>Sapphire</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>
      <h3>Movement</h3><p>Self-winding<br>movement</p><h3>Skipped</h3><ul><li>x</ul><p>not a value</p>
      <div data-specification-name="Weight" data-specification-value="90 g"></div><a href="/a">l</a><img src="i.png" alt="A"></main></body></html>"""
    assert found(spark, html, "spec") == [("Case size", "40 mm"), ("Jewels", "25"), ("Glass", "Sapphire"), ("Weight", "90 g")]
    assert found(spark, html, "pair") == [("Movement", "Self-winding movement")]
    assert found(spark, html, "h1") == [("h1", "Name Two")]
    assert found(spark, html, "canonical") == [("canonical", "https://x/y")]
    assert found(spark, html, "meta") == [("description", "short")]
    assert found(spark, html, "link") == [("href", "/a")] and found(spark, html, "image") == [("A", "i.png")]


def test_long_labels_are_kept(spark):
    page = f'<html><body><img alt="{"a" * 200}" src="/i.png"></body></html>'
    facts = ex.extract_facts(spark.createDataFrame([("p", page)], "id string, html string"), "id", "html").collect()
    assert [(f["kind"], len(f["label"]), f["value"]) for f in facts] == [("image", 200, "/i.png")]


def test_unclosed_and_broken_markup(spark):
    html = "<p>" * 3000 + "<h1>ok</h1><script type='application/json'>{bad</script><p></div></x>"
    assert found(spark, html, "h1") == [("h1", "ok")]
    assert found(spark, html, "warning") == [("application/json", "Invalid embedded JSON")]


def test_mapping_and_pivot(spark):
    html = "<dl><dt>Case-Diameter:</dt><dd>39 mm</dd><dt>Diameter</dt><dd>40 mm</dd><dt>Rare measurement</dt><dd>42</dd></dl>"
    fields = ex.map_fields(facts(spark, html), ex.mapping_table(spark))
    row = ex.pivot_records(fields).first()
    assert row["diameter"] == "39 mm" and row["provenance"]["diameter"]["locator"] == "dl/dt+dd" and row["made_in"] is None


def test_site_mapping_overrides(spark):
    mapping = [*ex.DEFAULT_MAPPING, ex.FieldMap("detailed dial", "dial_color", site="omega", priority=1)]
    html = "<dl><dt>Dial</dt><dd>Blue</dd><dt>Detailed dial</dt><dd>Sun-brushed blue</dd></dl>"
    table = ex.mapping_table(spark, mapping)
    assert ex.pivot_records(ex.map_fields(facts(spark, html), table, F.lit("omega"))).first()["dial_color"] == "Sun-brushed blue"
    assert ex.pivot_records(ex.map_fields(facts(spark, html), table, F.lit("iwc"))).first()["dial_color"] == "Blue"


def products(spark, data):
    df = spark.createDataFrame([(1, URL, "m1-0001", json.dumps(data))], "page_id int, url string, reference string, body string")
    out = own_products(df, "body")
    return sorted(r[0] for r in out.select(F.try_variant_get("product", "$.name", "string")).collect())


def test_related_products_never_supply_values(spark):
    own, related = {"@type": "Product", "url": URL + "/", "name": "own"}, {"@type": "Product", "url": OTHER, "name": "related"}
    assert products(spark, [related, own]) == ["own"]
    assert products(spark, {"@graph": [related, {"@type": "Product", "sku": "M1 0001", "name": "by sku"}]}) == ["by sku"]
    assert products(spark, related) == []
    assert products(spark, {"@type": ["Thing", "Product"], "url": URL, "name": "typed list"}) == ["typed list"]


def test_products_of_a_graph(spark):
    assert products(spark, {"@type": "ProductGroup", "url": URL, "name": "group", "hasVariant": [{"@type": "https://schema.org/Product", "url": URL, "name": "variant"}]}) == ["variant"]
    assert products(spark, {"@type": "WebPage", "mainEntity": {"@type": "Product", "url": "m1-0001?ref=a", "name": "nested, relative"}}) == ["nested, relative"]
    graph = [{"@type": "WebPage", "mainEntity": {"@id": "#p"}}, {"@id": "#p", "@type": "Product", "name": "by id", "offers": {"@id": "#o"}}, {"@id": "#o", "@type": "Offer", "price": 5}]
    assert products(spark, {"@graph": graph}) == ["by id"]
    df = spark.createDataFrame([(1, URL, "x", json.dumps({"@graph": graph}))], "page_id int, url string, reference string, body string")
    assert own_products(df, "body").select(F.try_variant_get("offers", "$.price", "int")).first()[0] == 5
    moved = spark.createDataFrame([(1, URL, "x", json.dumps({"@type": "Product", "url": "/c", "name": "n"}), "https://www.shop.example/c")],
                                  "page_id int, url string, reference string, body string, canonical string")
    assert own_products(moved, "body", canonical="canonical").count() == 1 and own_products(moved, "body").count() == 0


def test_walk_of_deep_json(spark):
    deep = {"@type": "T", "n": 0}
    for i in range(12):
        deep = {"k": [deep]} if i % 2 else {"k": deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "[1, [{}]]"), (3, "no"), (4, None)], "id int, body string")
    out = json_walk(rows, ["id"], "body").collect()
    assert sum(r["id"] == 1 for r in out) == 13 and [(r["path"], r["depth"]) for r in out if r["id"] == 2] == [("$[1][0]", 2)]
    last = max((r for r in out if r["id"] == 1), key=lambda r: r["depth"])
    assert last["path"] == "$" + ".k[0].k" * 6 and last["key"] == "k" and json_walk(rows.limit(0), ["id"], "body").count() == 0


def test_single_offer_and_images(spark):
    offers = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("b", 6.0)], "page string, price double")
    got = {r["page"]: (r["n_offers"], r["price"]) for r in ex.single_offer(offers, ["page"], "price").collect()}
    assert got == {"a": (1, 5.0), "b": (2, None)}
    df = spark.createDataFrame([(["https://x/9999g-001.png", "https://x/8888.png"], "9999G-001")], "images array<string>, ref string")
    assert df.select(ex.own_images(F.col("images"), F.col("ref"))).first()[0] == ["https://x/9999g-001.png"]


def test_offline_reparse_matches(spark):
    """Records rebuilt from the same snapshots are identical, field by field."""
    from catalogspark.operators.reconcile import diff_rows

    html = "<dl><dt>Diameter</dt><dd>40 mm</dd></dl>"
    build = lambda: ex.pivot_records(ex.map_fields(facts(spark, html), ex.mapping_table(spark)), ["diameter", "crystal"])
    assert diff_rows(build(), build(), "page_id", ["diameter", "crystal"]).count() == 0
    changed = build().withColumn("crystal", F.lit("Sapphire"))
    assert diff_rows(build(), changed, "page_id", ["diameter", "crystal"]).first().asDict() == {
        "page_id": "p", "field": "crystal", "left_value": None, "right_value": "Sapphire"}


def test_udtf(spark):
    ex.register_udtf(spark)
    out = spark.sql("SELECT kind, value FROM VALUES ('<h1>A</h1>') AS t(html), LATERAL page_facts('k', t.html)").collect()
    assert [(r["kind"], r["value"]) for r in out] == [("h1", "A")]


def test_pages_to_records(spark):
    from catalogspark import jobs

    own = {"@type": "Product", "url": URL, "sku": "m1-0001", "name": "Own", "offers": {"price": 0, "priceCurrency": "CHF"},
           "additionalProperty": [{"name": "Diameter", "value": "39 mm"}]}
    related = {"@type": "Product", "url": OTHER, "sku": "m1-0002", "name": "Other", "offers": [{"price": 99, "priceCurrency": "USD"}]}
    own |= {"description": "Long words"}
    html = ('<meta name="description" content="Short"><meta property="og:image" content="/i.png">'
            "<main><h1>Heading</h1><dl><dt>Diameter</dt><dd>99 mm</dd><dt>Crystal</dt><dd>Sapphire</dd></dl></main>"
            f'<script type="application/ld+json">{json.dumps([related, own])}</script>')
    pages = spark.createDataFrame([("1", URL, "M1-0001", html, "2026-10-01", "h"), ("2", OTHER, "M1-0002", "<h1>Bare</h1>", "2026-10-01", "h2")],
                                  "page_id string, url string, reference string, html string, captured_at string, source_hash string")
    records = jobs.extract_records(pages, ex.mapping_table(spark), F.lit("Maker"), F.lit("CH"), F.lit("en")).cache()
    one, two = records.orderBy("page_id").collect()
    assert (one["reference_number"], one["specific_model"], one["price"], one["currency"], one["diameter"], one["crystal"]) == (
        "m1-0001", "Own", "0", "CHF", "39 mm", "Sapphire")
    assert (one["description"], one["short_description"], one["image_URL"]) == ("Long words", "Short", "https://www.shop.example/i.png")
    assert (two["reference_number"], two["specific_model"], two["price"]) == ("M1-0002", "Bare", None)
    assert one["validation_errors"] == [] and "power_reserve" in one["missing_core_fields"] and len(one["id"]) == 24
    assert jobs.reparse_check(records, records).count() == 0
    accepted, rejected = jobs.accept(records)
    assert accepted.count() == 2 and rejected.count() == 0


def test_links_are_resolved_and_scoped(spark):
    from catalogspark.functions.urls import SitePattern, resolve
    from catalogspark.operators.crawl import discover_links

    site = SitePattern("s", r"www\.shop\.example", r"/watches/m\d-\d{4}", (r"/watches",))
    html = ('<a href="m1-0002">x</a><a class="n" href="/watches">y</a><a href="https://evil.example/watches/m1-0003">z</a><a href="mailto:a@b.c">m</a>'
            '<script type="application/json">{"productUrl": "/watches/m1-0004", "other": "/watches/m1-0005"}</script>')
    out = discover_links(spark.createDataFrame([("p", URL, html)], "id string, url string, html string"), "id", "url", "html", [site])
    assert sorted((r["target"].split("example")[1], r["kind"]) for r in out.collect()) == [
        ("/watches", "listing"), ("/watches/m1-0002", "product"), ("/watches/m1-0004", "product")]
    df = spark.createDataFrame([("//cdn.x/a",), ("?p=2",), ("https://h/z",)], "href string")
    assert [r[0] for r in df.select(resolve(F.lit("https://h/a/b?x=1"), "href")).collect()] == ["https://cdn.x/a", "https://h/a/b?p=2", "https://h/z"]
