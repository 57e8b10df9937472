"""Scalar functions on the published accept and reject cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import dates, measures, money, records, terms, text, urls, variants


@pytest.mark.parametrize("stated, amount, currency", [
    ("Retail USD 6,500", 6500, "USD"), ("INR 1,50,000", 150000, "INR"), ("CHF 8,500", 8500, "CHF"), ("$6,500", 6500, None),
    ("6,500 EUR", 6500, "EUR"), ("USD 6,500. Again USD 6,500", 6500, "USD"),
])
def test_price_accepted(one, stated, amount, currency):
    got = one(money.sole_price, stated)
    assert (got["amount"], got["currency"]) == (amount, currency)


@pytest.mark.parametrize("stated", [
    "USD 5,000 - 6,000", "USD 5,000 to 6,000", "USD 200 per month", "Save USD 500", "From USD 5,000", "USD 6,500 or USD 7,500",
    "USD 6,500. EUR 6,000", "USD 6,90", "no price", "USD 50",
])
def test_price_rejected(one, stated):
    assert one(money.sole_price, stated) is None


def test_price_context_is_local(one):
    padding = "x" * 40
    assert one(money.sole_price, f"Save now {padding} USD 6,500 {padding} per month")["amount"] == 6500


@pytest.mark.parametrize("stated, unit, value", [
    ("Approximately 72 hours", "h", 72), ("6-12 months", "h", None), ("35 x 42 mm", "mm", None), ("48–72 hours", "h", None),
    ("120 g", "g", 120), ("39 x 41 mm", "mm", None), ("Diagonal: 40 mm", "mm", None), ("40", "mm", None), ("", "mm", None),
    ("40,5 mm", "mm", 40.5), ("battery life 3 years", "h", None),
])
def test_measure(one, stated, unit, value):
    assert one(lambda c: measures.measure(c, unit), stated) == value


@pytest.mark.parametrize("stated, metres", [
    ("Waterproof to 1,220 metres / 4,000 feet", 1220), ("5 ATM", 50), ("10 bar", 100), ("not water-resistant", 0),
    ("Not specified", None), ("Unknown", None),
])
def test_water(one, stated, metres):
    assert one(measures.water_metres, stated) == metres


@pytest.mark.parametrize("stated, hertz", [("4 Hz", 4), ("28,800 vph", 4), ("3 Hz (28,800 vph)", None), ("fast", None)])
def test_frequency(one, stated, hertz):
    assert one(measures.frequency_hz, stated) == hertz


@pytest.mark.parametrize("stated, value", [("6,900", 6900), ("6,90", None), ("6900.50", 6900.5), ("12,345,678", 12345678)])
def test_grouped_price(one, stated, value):
    got = one(money.grouped_price, stated)
    assert got == value or float(got) == value


@pytest.mark.parametrize("raw, day", [
    ("2 days ago", "2026-10-02"), ("Oct 5, 2026", None), ("2026", None), ("Oct 3, 2026", "2026-10-03"), ("1 month ago", "2026-09-04"),
    ("3 October 2026", "2026-10-03"), ("2026-10-01", "2026-10-01"), ("yesterday", None), ("September 1, 2026", "2026-09-01"),
])
def test_reported_date(one, raw, day):
    got = one(lambda c: dates.reported_date(c, F.lit("2026-10-04 12:00:00").cast("timestamp_ntz")), raw)
    assert (None if got is None else got.isoformat()) == day


def test_capture_date_is_local(one):
    assert one(lambda c: dates.local_date(c.cast("timestamp")), "2026-10-01T22:00:00Z") == dt.date(2026, 10, 2)


def test_csv_cells(one):
    assert one(text.csv_cell, 'a,"b"') == '"a,""b"""'
    assert one(text.csv_cell, '=IMPORTXML("url")') == '"\'=IMPORTXML(""url"")"'
    assert one(text.csv_cell, "  @SUM(A1)") == '"\'  @SUM(A1)"'


def test_references(one):
    assert one(text.format_reference, "12345678901234") == "123.45.67.89.01.234"
    assert one(text.format_reference, "12345678") == "1234.56.78"
    assert one(text.format_reference, "123") is None
    assert one(text.norm_ref, "7038BR/CT/3V6 D00D") == one(text.norm_ref, "7038br/ct/3v6/d00d")
    assert one(urls.has_reference, "IWC iw 659803 watch", "IW659803") is False
    assert one(urls.has_reference, "IWC IW-659803 watch", "IW 659803") is True
    assert one(urls.has_reference, "IW6598030", "IW659803") is False
    assert one(urls.has_other_reference, "IWC IW659804 price", "IW659803") is True
    assert one(urls.has_other_reference, "IWC IW659803 price", "IW659803") is False
    assert one(urls.has_other_reference, "price 6500", "5711") is False


def test_text(one):
    assert one(text.fold, "Répétition Ñandú") == "repetition nandu"
    assert one(text.label_key, "Case-Material: *") == "case material"
    assert one(text.html_text, "<p>a<br>b</p><script>x</script>&amp;c") == "a b &c"
    assert one(text.decode_octets, "01001111 01001011") == "OK"
    assert one(text.decode_octets, "plain text") is None
    assert one(lambda c: text.clean_list(F.split(c, ",")), " a  b ,c") == "a b; c"


def test_urls(one):
    assert one(urls.url_key, "https://x.y/a/?q=1#f") == "https://x.y/a"
    assert one(urls.is_safe_link, "https://user:pass@x.y/a") is False
    assert one(urls.is_safe_link, "javascript:alert(1)") is False
    assert one(urls.host, "https://WWW.X.com:443/a") == "www.x.com"
    assert one(urls.normalise_octets, "/%77atches/%2f/é") == "/watches/%2F/%C3%A9"
    assert one(lambda c: urls.search_link(F.lit("IWC"), c), "IW1") == \
        "https://www.google.com/search?q=IWC+%22IW1%22+watch+price+-replica&gl=us&hl=en"


def test_terms(one):
    assert one(terms.term_extract, "18 ct yellow gold, grade 2 titanium and steel") == [
        "18 ct yellow gold", "Grade 2 titanium", "Stainless steel"]
    assert one(terms.clause_colours, "alligator, shiny black, white gold clasp") == ["shiny black"]
    assert one(terms.phrase_extract, "A chronograph with perpetual calendar, Chronograph, date") == [
        "chronograph", "perpetual calendar", "Chronograph", "date"]
    stated = [("Date", r"\bdate\b"), ("Chronograph", r"\bchronograph\b"), ("Flyback", r"\bflyback\b")]
    assert one(lambda c: terms.stated_terms(c, stated), "No date") == []
    assert one(lambda c: terms.stated_terms(c, stated), "Chronograph without flyback; date: none") == ["Chronograph"]


@pytest.mark.parametrize("wording, segment", [
    ("Black Bay Chrono", "Chronograph"), ("Aquatimer Automatic", "Diving"), ("Pelagos FXD", "Diving"), ("Chronomat Automatic", "Time & date"),
    ("Classique Phase de Lune 7787", "Complications"), ("Classique Répétition Minutes 7637", "Complications"),
    ("Tradition Seconde Rétrograde 7097", "Complications"),
])
def test_segments(one, wording, segment):
    assert one(lambda c: terms.classify_segment(text.fold(c)), wording) == segment


def test_variants(one):
    assert one(lambda c: variants.cms_value(variants.parse(c)), '{"jsonValue":{"value":"A"}}') == "A"
    assert one(lambda c: variants.cms_value(variants.parse(c)), '{"fields":{"Name":{"value":"B"}}}') == "B"
    assert one(lambda c: variants.first_boolean(variants.parse(c)), '{"values":[{"x":1},{"boolean":false}]}') is False
    assert one(lambda c: variants.first_boolean(variants.parse(c)), "{}") is None


def test_record_id_and_validation(spark):
    rows = spark.createDataFrame(
        [("Tudor", "1-1", "https://x/1", "US", "en"), ("Tudor", "1-2", "https://x/2", "US", "en"), ("Tudor", "1-1", "https://x/1", "IN", "en")],
        "brand string, reference string, url string, market string, language string")
    ids = [r[0] for r in rows.select(records.record_id("brand", "reference", "url", "market", "language")).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 24 for i in ids)
    bad = spark.createDataFrame([("B", None, "M", "http://x", "3 mm", "usd")],
                                "brand string, reference_number string, specific_model string, watch_URL string, diameter string, currency string")
    assert bad.select(records.validation_errors()).first()[0] == [
        "Missing identity field: reference_number", "Source URL must use HTTPS", "Case diameter outside wristwatch review range",
        "Currency must be an ISO code"]


def test_references_against_patterns(spark):
    """Token runs against one pattern per reference, built and run here."""
    import random
    import re
    import unicodedata

    rng = random.Random(6)
    sep = r"[ \t\n\x0b\f\r._/–-]*"

    def plain(s):
        return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()

    def named(text, ref):
        parts = re.findall("[a-z0-9]+", plain(ref))
        return bool(parts) and re.search("(?<![a-z0-9])" + sep.join(parts) + "(?![a-z0-9])", plain(text)) is not None

    def other(text, ref):
        parts = re.findall("[A-Za-z0-9]+", ref)
        if re.fullmatch(r"\d+", ref) or not parts:
            return False
        form = sep.join(re.sub("[0-9]", r"\\d", re.sub("[A-Za-z]", "[a-z]", p)) for p in parts)
        key = "".join(re.findall("[a-z0-9]+", plain(ref)))
        return any(re.sub("[^a-z0-9]", "", m.lower()) != key for m in re.findall("(?a)(?i:(?<![a-z0-9])" + form + "(?![a-z0-9]))", text.lower()))

    refs = ["A1", "1-2", "a1-b", "12.3/4", "A-1-B-2", "5711", "A", "12-3", "é1", "", "--"]
    rows = []
    for _ in range(3000):
        ref = rng.choice(refs)
        noise = [rng.choice(["A", "a", "1", "2", "12", "3", "4", "b", "B", "x", "5711", "é"]) for _ in range(rng.randint(0, 5))]
        text = "".join(w + rng.choice(["", " ", "-", ".", "/", ", ", " - ", ";", "|", "<", "> <"]) for w in noise)
        at = rng.randint(0, len(text))
        said = rng.choice(["", ref, re.sub("[-./]", rng.choice(["", " ", ", "]), ref), ref.lower(), ref.replace("1", "2")])
        rows.append((text[:at] + rng.choice(["", " "]) + said + rng.choice(["", " "]) + text[at:], ref))
    df = spark.createDataFrame(rows, "text string, ref string").select("*", urls.has_reference("text", "ref").alias("own"), urls.has_other_reference("text", "ref").alias("other"))
    seen = set()
    for r in df.collect():
        assert r["own"] == named(r["text"], r["ref"]), (r["text"], r["ref"])
        assert r["other"] == other(r["text"], r["ref"]), (r["text"], r["ref"])
        seen.add((r["own"], r["other"]))
    assert len(seen) == 4


def _offers_of(spark, tmp_path, keys):
    """Tables with one offer of each wording by suppliers 0 to 9 for every product."""
    part = spark.createDataFrame([(k,) for k in keys], "p_partkey long").selectExpr("p_partkey", "'large ring' p_name", "'Brand#7' p_brand", "'LARGE' p_type", "1 p_size", "900.0D p_retailprice")
    line = spark.range(len(keys) * 10).selectExpr(
        "id l_orderkey", f"array({','.join(f'{k}L' for k in keys)})[cast(id div 10 as int)] l_partkey", "id % 10 l_suppkey", "1 l_linenumber", "1.0D l_quantity",
        "5000.0D + id l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'A' l_returnflag", "'O' l_linestatus", "timestamp_ntz'2001-01-01' - make_dt_interval(cast(id as int)) l_shipdate")
    part.write.parquet(f"{tmp_path}/part.parquet")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _differs_from_sql(spark, folder, name):
    import duckdb
    from oracle_check import compare

    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])


def test_exact_reference_of_numbers_of_all_lengths(spark, tmp_path):
    assert _differs_from_sql(spark, _offers_of(spark, tmp_path, [7, 99999, 999998, 999999, 1000000, 1234567, 9999999]), "exact_reference") is None


def test_hits_of_the_product_999999(spark, tmp_path):
    assert _differs_from_sql(spark, _offers_of(spark, tmp_path, [5, 999998, 999999, 1000000]), "match_hits") is None


def test_page_h1_reads_as_its_oracle(spark, tmp_path):
    import duckdb
    from oracle_check import compare

    import __spark_entry__ as entry

    texts = ["a &quot;b&quot;", "a&nbsp;b &copy;", "&#39;x&#39; &middot;", "a &amp;lt; b", "\u00a0 a\u00a0b \u3000", "a\n\t b\u000bc", "", "x > y", "  \u2003"]
    rows = [(i, f"<html><h1>{t}</h1><p>x</p>") for i, t in enumerate(texts)] + [(90, None), (91, "no heading"), (92, "<h1>a<b>c</b></h1>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(entry.queries()["page_h1"](spark, str(tmp_path)), con, entry.oracle_sql()["page_h1"]) is None


def test_rate_limit_minute_has_no_shared_budget(spark, tmp_path):
    import duckdb
    from oracle_check import compare

    import __spark_entry__ as entry

    # One minute with 60 users of up to nine events each, and a user whose events have no time.
    rows = spark.range(300).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 50) ts", "if(id < 9, 0L, id % 60) user_id",
                                       "'view' event_type", "1.0D value", "'{}' props")
    lost = spark.range(300, 309).selectExpr("id event_id", "cast(null as timestamp_ntz) ts", "7L user_id", "'view' event_type", "1.0D value", "'{}' props")
    rows.unionByName(lost).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(entry.queries()["rate_limit_minute"](spark, str(tmp_path)), con, entry.oracle_sql()["rate_limit_minute"]) is None


def test_reports_of_the_product_999999(spark, tmp_path):
    assert _differs_from_sql(spark, _offers_of(spark, tmp_path, [5, 999998, 999999, 1000000]), "price_reports") is None


def test_of_hits_at_one_position_the_dearer_is_reported(spark):
    from catalogspark.operators import evidence

    hits = [("p", "Brand watch iw000007 a", f"iw000007 a price USD {n},000. Available", "https://a.example/w", None, 4) for n in (5, 9, 7)]
    df = spark.createDataFrame(hits, "id string, title string, snippet string, link string, date string, position long").repartition(3, "snippet")
    products = spark.createDataFrame([("p", "Brand#1", "IW000007-A")], "id string, brand string, reference string")
    out = evidence.price_reports(products, df, F.lit("2026-10-04 12:00:00").cast("timestamp_ntz")).collect()
    assert [r["amount"] for r in out] == [9000.0]
