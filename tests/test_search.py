"""Search semantics on seven hand-written products."""

import re

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import annotate, normalise, rules, search
from catalogspark.operators.text_search import search_postings, search_text
from catalogspark.sources import index as ix

BASE = dict(is_watch=True, brand="Test", collection_label="Explorer", specific_model="Automatic GMT", diameter="40 mm",
            case_thickness="9 mm", case_material="Titanium", movement="Automatic", movement_family="Automatic",
            water_resistance="10 ATM", features="Date, GMT", power_reserve="72 hours", price_value=12000.0, currency="USD",
            source_kind="Official catalog")
CHANGES = {
    "one": {}, "two": dict(case_material="Ceramic", diameter="39 mm", price_value=10000.0),
    "unknown": dict(diameter="39 × 41 mm", water_resistance="", price_value=None, case_material=""),
    "currency": dict(currency="INR"), "archive": dict(source_kind="Archive"),
    "blank": dict(reference_number="", specific_model="No reference", case_material="", price_value=None, water_resistance=""),
    "boundary": dict(diameter="41 mm", price_value=20000.0),
}
SCHEMA = ("id string, reference_number string, is_watch boolean, brand string, collection_label string, specific_model string, "
          "diameter string, case_thickness string, case_material string, movement string, movement_family string, "
          "water_resistance string, features string, power_reserve string, price_value double, currency string, source_kind string")


@pytest.fixture(scope="module")
def index(spark):
    rows = [{**BASE, "id": k, "reference_number": f"R{k}", **c} for k, c in CHANGES.items()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    products = normalise.searchable(raw)
    prices = ix.build_prices(raw, "id", ix.price_source("source_kind"), F.col("currency"), F.col("price_value"), F.lit(None).cast("string"))
    built = ix.build_index(products, normalise.facet_columns(), prices, normalise.text_columns(ix.with_keys(products)), F.col("is_watch"))
    return ix.SearchIndex(*[df.cache() for df in (built.products, built.facets, built.prices, built.postings, built.doc_stats)])


def ids(index, **spec):
    s = search.SearchSpec(**spec)
    scores = search_postings(index.postings, index.doc_stats, s.q) if s.q else None
    return [r["id"] for r in search.search(index.products, index.facets, index.prices, s, scores).orderBy("rank").collect()]


def test_or_inside_and_across(index):
    got = ids(index, facets={"material": ["Titanium", "Ceramic"], "movement": ["Automatic"], "complication": ["GMT"]},
              bounds={("diameter", "lt"): 41, ("water", "min"): 100, ("price", "lt"): 20000})
    assert sorted(got) == ["one", "two"]


def test_price_basis(index):
    assert ids(index, source="recorded_catalog", bounds={("price", "max"): 20000}) == ["archive"]
    assert ids(index, currency="INR", bounds={("price", "max"): 20000}) == ["currency"]
    assert len(ids(index, facets={"material": ["Titanium"]}, bounds={("price", "max"): 20000})) == 2


def test_unknown_never_matches(index):
    assert "unknown" not in ids(index, bounds={("water", "min"): 0})
    assert "unknown" not in ids(index, facets={"material": ["Titanium"]})


def test_reversed_range_is_refused(index):
    with pytest.raises(ValueError, match="diameter minimum exceeds maximum"):
        ids(index, bounds={("diameter", "min"): 42, ("diameter", "max"): 38})


def test_nulls_sort_last(index):
    assert ids(index, sort="diameter-asc")[-1] == "unknown"
    assert ids(index, sort="diameter-desc")[-1] == "unknown"


def test_text_and_reference(index):
    assert ids(index, q="unlikely-unmatched-term") == []
    assert set(ids(index, q="explorer gm")) >= {"one", "two"}
    assert ids(index, q="Rone") == ["one"]


def test_blank_reference_is_unmatchable(index):
    assert index.products.where(F.col("id") == "blank").first()["reference_key"] is None


def test_index_and_direct_scores_agree(index, spark):
    fields = {"identity": F.concat_ws(" ", "brand", "collection", "model")}
    weights = {"identity": 8.0}
    from catalogspark.operators.text_search import build_doc_stats, build_postings

    a = search_postings(build_postings(index.products, "id", fields), build_doc_stats(index.products, "id", fields), "test auto", weights)
    b = search_text(index.products, "id", {"identity": (fields["identity"], 8.0)}, "test auto")
    assert {r["id"]: round(r["score"], 9) for r in a.collect()} == {r["id"]: round(r["score"], 9) for r in b.collect()}


def test_relaxations(index):
    rows = index.products.withColumn("titanium", F.array_contains("material_facet", "Titanium"))
    out = search.relaxations(rows, {"material": F.col("titanium"), "diameter.max": F.col("diameter") <= 10}).collect()
    assert [(r["key"], r["n"]) for r in out] == [("diameter.max", 4)]
    assert search.relaxations(rows, {"material": F.col("titanium")}).count() == 0


def test_hydration_by_any_number_of_ids(index):
    assert [r["id"] for r in search.by_ids(index.products, ["one", "one", *"abcdefgh"]).collect()] == ["one"]
    with pytest.raises(ValueError):
        search.by_ids(index.products, [])


def test_new_price_source(index, spark):
    extra = spark.createDataFrame([("one", "market_offer", "EUR", 9000.0, "2026-10-05")], index.prices.schema)
    spec = search.SearchSpec(source="market_offer", currency="EUR", bounds={("price", "max"): 10000})
    rows = search.search(index.products, index.facets, index.prices.unionByName(extra), spec).collect()
    assert [(r["id"], r["price"]) for r in rows] == [("one", 9000.0)]


def test_effective_spec_prefers_explicit():
    parsed = search.SearchSpec(facets={"brand": ["A"], "dial": ["Blue"]}, bounds={("diameter", "lt"): 41}, q="x", currency="CHF")
    explicit = search.SearchSpec(facets={"brand": ["B"]}, bounds={("diameter", "lt"): 39})
    got = search.effective_spec(explicit, parsed)
    assert got.facets == {"brand": ["B"], "dial": ["Blue"]} and got.bounds == {("diameter", "lt"): 39} and got.currency == "CHF"
    unstated = search.SearchSpec(q="x")
    assert search.effective_spec(search.SearchSpec(currency="INR"), unstated).currency == "INR"
    assert search.effective_spec(search.SearchSpec(currency="INR"), parsed).currency == "CHF"


def test_text_query_needs_scores(index):
    with pytest.raises(ValueError):
        search.search(index.products, index.facets, index.prices, search.SearchSpec(q="x"))


def test_all_constraints_are_counted(spark):
    rows = spark.createDataFrame([(i,) for i in range(20)], "n long")
    constraints = {f"c{i}": F.lit(True) for i in range(14)} | {"none": F.col("n") < 0}
    assert [(r["key"], r["ord"], r["n"]) for r in search.relaxations(rows, constraints).collect()] == [("none", 14, 20)]


def test_suggestions_keep_blanks(spark):
    brands = spark.createDataFrame([("Tag Heuer",), ("Tagliatelle",)], "brand string")
    found = spark.createDataFrame([], "id string, brand string, collection string, reference string, tier int, score double")
    got = [(r["grp"], r["label"]) for r in search.suggest(brands, found, "tag h", {}).collect()]
    assert got == [("Brands", "Tag Heuer"), ("Suggested searches", "tag h"), ("Suggested searches", "Tag Heuer watches under 40mm")]


def test_amounts_in_two_currencies_differ(spark):
    rows = spark.createDataFrame([("s", 100.0, "USD"), ("s", 100.0, "INR"), ("t", 5.0, "USD"), ("t", 5.0, "USD")], "list string, value double, currency string")
    got = {r["list"]: r["differs"] for r in rules.difference_rows(rows, "list", {"price": (F.col("value"), F.col("currency"))}).collect()}
    assert got == {"s": True, "t": False}


def test_index_round_trip(index, spark, tmp_path):
    index.write(str(tmp_path / "ix"))
    back = ix.SearchIndex.read(spark, str(tmp_path / "ix"))
    assert back.facets.count() == index.facets.count() and back.products.count() == 7
    facet = back.facets.where((F.col("facet") == "material") & (F.col("value") == "Titanium"))
    assert "PartitionFilters: [isnotnull(facet" in facet._jdf.queryExecution().toString()


VOCABULARY = {"material": ["Titanium", "Ceramic"], "movement": ["Automatic", "Manual winding"], "complication": ["GMT", "Tourbillon", "Chronograph"],
              "brand": ["Audemars Piguet", "Jaeger-LeCoultre", "Vacheron Constantin"], "dial": ["Green", "Blue"]}


@pytest.mark.parametrize("q, facets, bounds, currency, rest", [
    ("Show me automatic titanium GMT watches under 41mm at least 100m and below $20,000.",
     {"material": ["Titanium"], "movement": ["Automatic"], "complication": ["GMT"]},
     {"diameter.lt": 41, "price.lt": 20000, "water.min": 100}, "USD", ""),
    ("AP 15500 blue", {"brand": ["Audemars Piguet"], "dial": ["Blue"]}, {}, None, "15500"),
    ("JLC Reverso green", {"brand": ["Jaeger-LeCoultre"], "dial": ["Green"]}, {}, None, "reverso"),
    ("36–40mm manual winding", {"movement": ["Manual winding"]}, {"diameter.min": 36, "diameter.max": 40}, None, ""),
    ("chronograph with 70 hour power reserve", {"complication": ["Chronograph"]}, {"reserve.min": 70}, None, ""),
    ("dress watch under 10mm thick", {}, {"thickness.lt": 10}, None, "dress"),
    ("100m+", {}, {"water.min": 100}, None, ""),
    ("tourbillon under CHF 20k", {"complication": ["Tourbillon"]}, {"price.lt": 20000}, "CHF", ""),
    ("watches without water resistance", {}, {}, None, "watches without water resistance"),
])
def test_annotation(spark, q, facets, bounds, currency, rest):
    row = annotate.annotate_queries(spark.createDataFrame([(q,)], "q string"), "q", VOCABULARY).first()
    assert (row["facets"], row["bounds"], row["currency"], row["rest"]) == (facets, bounds, currency, rest)


def test_normalisation_rejects_ambiguity(spark, one):
    assert one(normalise.dial_facet, "Appliqued hour-markers, Green, sunray-brushed") == ["Green"]
    assert one(normalise.dial_facet, "Blue dial, pink gold hands, white counters") == ["Blue"]
    assert one(normalise.dial_facet, "White gold hands") == []
    schema = ("product_detail_parsed boolean, captured_at string, diameter string, movement string, specific_model string, subtype string, "
              "case_dimensions_display string, gem_setting string, price string")
    rows = spark.createDataFrame([
        (True, "2026-10-01T22:00:00Z", "40 mm", "Self-winding", "Chronomat Automatic", None, None, None, "6,900"),
        (True, "2026-10-01T22:00:00Z", "30 x 40 mm", "Quartz", "X", "Pocketwatch", "Diagonal: 40 mm", "Bezel set with 40 diamonds", "6,90")], schema)
    a, b = normalise.normalise_records(rows.withColumn("captured_at", F.col("captured_at").cast("timestamp"))).collect()
    assert (str(a["captured_date"]), a["movement_family"], a["segment"], a["gem_set"], a["diameter_mm"]) == (
        "2026-10-02", "Automatic", "Time & date", False, 40.0)
    assert float(a["price_value"]) == 6900 and b["price_value"] is None
    assert (b["watch_kind"], b["gemstones"], b["diameter_metric_eligible"], b["diameter_mm"]) == ("Pocket watch", ["Diamond"], False, None)


def test_rules(spark):
    df = spark.createDataFrame([(40.0, 6500.0, "USD", "GMT, date", None), (None, None, "INR", "Date", "Diamond")],
                               "d double, p double, cur string, features string, stones string")
    fields = {"diameter": rules.Field("diameter", "number", F.col("d")), "price": rules.Field("price", "price", F.col("p"), F.col("cur")),
              "features": rules.Field("features", "text", F.col("features")), "stones": rules.Field("stones", "text", F.col("stones"))}
    wanted = [rules.Rule("diameter", "lte", "40"), rules.Rule("price", "lte", "7000", currency="USD"), rules.Rule("features", "contains", "gmt")]
    got = rules.evaluate_rules(df, wanted, fields).collect()
    assert [(r["passes"], r["unknown_count"]) for r in got] == [(True, 0), (False, 2)]
    assert df.where(rules.rule_predicate(rules.Rule("stones", "excludes", "Diamond"), fields)).count() == 0
    assert df.where(rules.rule_predicate(rules.Rule("stones", "known"), fields, True)).count() == 1
    assert df.where(rules.rule_predicate(wanted[1], fields, True)).count() == 2


@pytest.mark.parametrize("rule", [
    rules.Rule("diameter", "between", "42", "38"), rules.Rule("diameter", "lte", ""), rules.Rule("diameter", "lte", "abc"),
    rules.Rule("features", "contains", ""), rules.Rule("nothing", "known"), rules.Rule("features", "lte", "1"), rules.Rule("features", "lte", "x" * 201),
])
def test_rule_validation(spark, rule):
    fields = {"diameter": rules.Field("diameter", "number", F.lit(1)), "features": rules.Field("features", "text", F.lit("x"))}
    assert rules.validate_rule(rule, fields)


def test_pages_of_a_ranking(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v")).repartition(5)
    order = [F.col("v").desc(), F.col("id").asc()]
    want = [(r["id"], i + 1) for i, r in enumerate(df.orderBy(*order).collect())]
    ranking = search.Ranking.build(df, order, str(tmp_path / "r"))
    assert ranking.total == 1000
    for page, size in ((1, 24), (2, 24), (17, 24), (42, 24), (43, 24), (3, 400), (1, 5000)):
        got = sorted(((r["id"], r["rank"]) for r in ranking.page(page, size).collect()), key=lambda x: x[1])
        assert got == want[(page - 1) * size:page * size]
        if page < 43:
            got = sorted(((r["id"], r["rank"]) for r in search.page_of(df, order, page, size).collect()), key=lambda x: x[1])
            assert got == want[(page - 1) * size:page * size]
    # A deep page reads one or two ranges of eight.
    assert len(ranking.page(40, 24).inputFiles()) <= 2 if len(ranking.counts) > 4 else True
    assert search.Ranking.build(df.limit(0), order, str(tmp_path / "e")).page(1).count() == 0


def test_specs_in_bulk_answer_like_single_searches(spark):
    from catalogspark.operators import search_many
    from catalogspark.operators.facets import build_facets
    from catalogspark.operators.text_search import build_doc_stats, build_postings, search_postings
    from catalogspark.sources.index import with_keys

    import random

    rng = random.Random(8)
    makers, lines, metals, extras = ["Omega", "Rolex", "IWC"], ["Speed", "Dive 1", "Pilot"], ["Steel", "Gold", None], ["GMT", "Moon", "Date"]
    rows = [(i, rng.choice(makers), rng.choice(lines), f"Model {rng.choice('abc')}{i % 4}", rng.choice([None, f"R{i % 15}-{i}"]), rng.choice([None, 36.0, 39.0, 40.0, 42.0]),
             rng.choice(metals), [e for e in extras if rng.random() < 0.5]) for i in range(120)]
    products = with_keys(spark.createDataFrame(rows, "id int, brand string, collection string, model string, reference string, diameter double, metal string, extra array<string>"))
    facets = build_facets(products, "id", {"brand": F.array("brand"), "material": F.array("metal"), "complication": F.col("extra")})
    prices = spark.createDataFrame([(i, "official_retail", c, float(rng.randint(1, 9) * 1000)) for i in range(120) for c in ("USD", "EUR") if rng.random() < 0.6],
                                   "id int, source string, currency string, amount double")
    fields = {"identity": F.concat_ws(" ", "brand", "collection", "model"), "reference_key": F.coalesce("reference_key", F.lit(""))}
    postings, stats = build_postings(products, "id", fields), build_doc_stats(products, "id", fields)
    specs, texts = [], ["", "", "", "speed", "omega mod", "model a", "R7", "r1-1", "dive 1 b", "zzz"]
    for n in range(60):
        f = {k: v for k, v in {"brand": rng.sample(makers, rng.randint(0, 2)), "material": rng.sample(["Steel", "Gold", "Tin"], rng.randint(0, 2)), "complication": rng.sample(extras, rng.randint(0, 2))}.items() if v}
        b = {k: v for k, v in {"diameter.min": 37.0, "diameter.lt": 42.0, "price.max": 5000.0, "price.gt": 2000.0}.items() if rng.random() < 0.3}
        specs.append((n, f, b, rng.choice([None, "EUR"]), rng.choice(texts)))
    specs += [(100, {}, {"diameter.min": 50.0, "diameter.max": 40.0}, None, ""), (101, {}, {}, None, ""), (102, specs[0][1], specs[0][2], specs[0][3], specs[0][4]), (103, None, None, None, "omega")]
    table = spark.createDataFrame(specs, "spec int, facets map<string,array<string>>, bounds map<string,double>, currency string, rest string")
    out = search_many.search_specs(products, facets, prices, table, {"diameter": F.col("diameter")}, (postings, stats)).collect()
    got = {}
    for r in out:
        got.setdefault(r["spec"], []).append((r["id"], r["tier"], None if r["score"] is None else round(r["score"], 9), r["price"]))
    assert 100 not in got and 101 not in got
    for n, f, b, currency, rest in specs:
        if n in (100, 101) or not (f or b or rest):
            continue
        spec = search.SearchSpec(facets=f or {}, bounds={tuple(k.split(".")): v for k, v in (b or {}).items()}, q=rest, currency=currency)
        single = search.matches(products, facets, prices, spec, search_postings(postings, stats, rest) if rest else None)
        want = sorted((r["id"], r["tier"], None if r["score"] is None else round(r["score"], 9), r["price"]) for r in single.collect())
        assert sorted(got.get(n, [])) == want, (n, f, b, currency, rest)
    assert sum(map(len, got.values())) > 200


def test_bulk_search_broadcasts_nothing_by_product(spark, monkeypatch):
    """The small files of these tables say nothing of their size in memory: no join by product id plans a broadcast."""
    import __spark_entry__ as entry
    from catalogspark.operators import search_many

    plans, store = [], search_many.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(search_many, "stored", seen)
    entry.queries()["search_specs"](spark, "/root/testdata/sf0.001")
    assert len(plans) > 3 and not [line for text in plans for line in text.splitlines() if "BroadcastExchange" in line and re.search(r"List\(input\[\d+, bigint", line)]


def test_pages_in_bulk_are_cut_per_request(spark, monkeypatch):
    from catalogspark.operators import search_many
    from catalogspark.operators.facets import build_facets
    from catalogspark.sources.index import with_keys

    monkeypatch.setattr(search_many, "TILE", 8)
    products = with_keys(spark.range(60).selectExpr("id", "'Omega' brand", "'Speed' collection", "concat('m', id) model", "concat('R', id) reference", "40.0D diameter"))
    facets = build_facets(products, "id", {"brand": F.array("brand")})
    prices = products.selectExpr("id", "'official_retail' source", "'USD' currency", "id * 1.0D amount")
    specs = spark.range(60).select(F.col("id").alias("spec"), F.expr("if(id < 50, map('brand', array('Omega')), null) facets"),
                                   F.expr("if(id < 50, null, map('price.lt', id - 49.0D)) bounds"), F.lit(None).cast("string").alias("currency"), F.lit("").alias("rest"))
    got = search_many.search_pages(products, facets, prices, specs, {"diameter": F.col("diameter")}).select("spec", "rank", "id").collect()
    assert sorted(map(tuple, got)) == [(s, i + 1, i) for s in range(60) for i in range(24 if s < 50 else s - 49)]


def _one_request(spark, n_specs, n_products):
    from catalogspark.sources.index import with_keys

    products = with_keys(spark.range(n_products).selectExpr("id", "'Omega' brand", "'Speed' collection", "concat('m', id) model", "concat('R', id) reference", "40.0D diameter"))
    prices = products.selectExpr("id", "'official_retail' source", "'USD' currency", "(id * 37) % 1000003 * 0.01D amount")
    facets = spark.createDataFrame([], "id bigint, facet string, value string")
    specs = spark.range(n_specs).select(F.expr("if(id = 0, null, id) spec"), F.lit(None).cast("map<string,array<string>>").alias("facets"), F.expr("map('price.min', 0.0D) bounds"),
                                        F.lit(None).cast("string").alias("currency"), F.lit("").alias("rest"))
    return products, facets, prices, specs, {"diameter": F.col("diameter")}


def test_whole_results_in_bulk_come_in_runs(spark):
    """The rows grow with both tables; in runs of one product, column files keep them in a fraction of a byte each."""
    from catalogspark.operators import search_many

    got = search_many.search_specs(*_one_request(spark, 600, 500)).toPandas()
    assert len(got) == 300_000 and (got["id"] != got["id"].shift()).sum() < 3000
    got["spec"] = got["spec"].fillna(0)
    assert not got.duplicated(["spec", "id"]).any() and got["spec"].nunique() == 600 and got["id"].nunique() == 500
    assert (got["price"] * 100).round().astype(int).equals(got["id"] * 37 % 1000003)


def test_whole_results_in_bulk_meet_in_packed_tiles(spark, monkeypatch):
    from catalogspark.operators import search_many

    monkeypatch.setattr(search_many, "TILE", 8)
    monkeypatch.setattr(search_many, "RUN", 3, raising=False)
    out = search_many.search_specs(*_one_request(spark, 50, 60))
    assert sorted((r["spec"] or 0, r["id"]) for r in out.collect()) == [(s, i) for s in range(50) for i in range(60)]
    plan = out._jdf.queryExecution().toString()
    assert "BuildLeft" not in plan and [line for line in plan.splitlines() if "SortMergeJoin [ask" in line and "__a" in line]
    # What is sent to the tiles are packed parts, not their rows.
    assert all("rows" in plan[at.end():].split("\n", 2)[1] for at in re.finditer("REPARTITION_BY_NUM", plan)) and "REPARTITION_BY_NUM" in plan
    none = search_many.search_specs(*_one_request(spark, 5, 0))
    assert none.count() == 0 and none.columns == out.columns
