"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import dates as dt
from catalogspark.functions import measures as ms
from catalogspark.functions import money as mn
from catalogspark.functions import records as rd
from catalogspark.functions import terms as tm
from catalogspark.functions import text as tx
from catalogspark.functions import urls as ur
from catalogspark.functions import variants as vr
from catalogspark.plans.registry import CATALOG, query


@query("clean_text", r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents""")
def _(t):
    return t.texts.select("doc_id", F.md5(tx.clean("text")).alias("cleaned"))


@query("fold_text", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def _(t):
    return t.texts.select("doc_id", F.md5(tx.fold("text")).alias("folded"))


@query("norm_ref", "SELECT c_custkey, regexp_replace(upper(c_name || '/' || c_mktsegment || '-x'), '[^A-Z0-9]', '', 'g') AS ref FROM customer")
def _(t):
    return t.customer.select("c_custkey", tx.norm_ref(F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("-x"))).alias("ref"))


@query("compact_key", "SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS key FROM documents")
def _(t):
    return t.texts.select("doc_id", F.md5(tx.compact("text")).alias("key"))


@query("label_key", r"""SELECT o_orderkey, trim(regexp_replace(replace(lower(o_orderpriority), '-', ' '), '[^a-z0-9 ]', '', 'g')) AS label FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", tx.label_key("o_orderpriority").alias("label"))


@query("url_key", r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS key FROM pages""")
def _(t):
    return t.pages.select("page_id", ur.url_key("url").alias("key"))


@query("html_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))) AS body FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(tx.html_text("html")).alias("body"))


@query("format_reference", """SELECT l_orderkey, l_linenumber, l_partkey, substr(d,1,3)||'.'||substr(d,4,2)||'.'||substr(d,6,2)||'.'||substr(d,8,2)||'.'||substr(d,10,2)||'.'||substr(d,12,3) AS long_ref,
 substr(e,1,4)||'.'||substr(e,5,2)||'.'||substr(e,7,2) AS short_ref, CAST(NULL AS VARCHAR) AS no_ref
 FROM (SELECT *, printf('%07d%07d', l_partkey, l_suppkey) AS d, printf('%08d', l_partkey) AS e FROM lineitem)""")
def _(t):
    long_ref = F.format_string("%07d%07d", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", tx.format_reference(long_ref).alias("long_ref"),
                             tx.format_reference(F.format_string("%08d", "l_partkey")).alias("short_ref"),
                             tx.format_reference(F.format_string("%09d", "l_partkey")).alias("no_ref"))


@query("slug_title", """SELECT p_partkey, upper(substr(a,1,1)) || substr(a,2) || ' ' || upper(substr(b,1,1)) || substr(b,2) AS title
 FROM (SELECT p_partkey, split_part(p_name,' ',1) AS a, split_part(p_name,' ',2) AS b FROM part)""")
def _(t):
    return t.part.select("p_partkey", tx.slug_title(F.translate("p_name", " ", "-")).alias("title"))


@query("query_text", """SELECT p_partkey, p_brand || ' "' || p_partkey || '" watch price -replica' AS q,
 'https://www.google.com/search?q=' || replace(p_brand, '#', '%23') || '+%22' || p_partkey || '%22+watch+price+-replica&gl=us&hl=en' AS link FROM part""")
def _(t):
    ref = F.col("p_partkey").cast("string")
    return t.part.select("p_partkey", ur.search_query("p_brand", ref).alias("q"), ur.search_link("p_brand", ref).alias("link"))


@query("ordered_distinct", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS l FROM documents),
 e AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM w), f AS (SELECT doc_id, term, min(pos) AS pos FROM e GROUP BY 1, 2)
 SELECT doc_id, md5(string_agg(term, ' ' ORDER BY pos)) AS terms, count(*) AS n FROM f GROUP BY 1""")
def _(t):
    terms = tx.ordered_distinct(tx.tokens("text"))
    return t.texts.select("doc_id", F.md5(F.array_join(terms, " ")).alias("terms"), F.size(terms).cast("long").alias("n")).where("n > 0")


_TERMS = tuple((n, tm.whole_words(p)) for n, p in (
    ("very fine", "the and"), ("fine", "the"), ("german", "der"), ("french", "les?"), ("spanish", "los")))
_W = r"(^|[^\p{L}\p{N}_])(%s)([^\p{L}\p{N}_]|$)"


@query("term_extract", rf"""SELECT doc_id, concat_ws('; ', CASE WHEN a THEN 'very fine' END, CASE WHEN b AND NOT a THEN 'fine' END, CASE WHEN c THEN 'german' END,
 CASE WHEN d THEN 'french' END, CASE WHEN e THEN 'spanish' END) AS terms FROM (SELECT doc_id, regexp_matches(text, '(?i){_W % 'the and'}') AS a,
 regexp_matches(text, '(?i){_W % 'the'}') AS b, regexp_matches(text, '(?i){_W % 'der'}') AS c, regexp_matches(text, '(?i){_W % 'les?'}') AS d,
 regexp_matches(text, '(?i){_W % 'los'}') AS e FROM documents)""")
def _(t):
    return t.texts.select("doc_id", F.array_join(tm.term_extract("text", _TERMS, {"fine": "very fine"}), "; ").alias("terms"))


@query("clause_colors", """SELECT p_partkey, concat_ws('|', CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN p_name END, CASE WHEN p_type = 'LARGE' THEN 'green strap' END) AS colours FROM part""")
def _(t):
    clauses = F.concat(F.lit("black dial, "), "p_name", F.lit(", white gold buckle, "), F.when(F.col("p_type") == "LARGE", "green strap").otherwise("plain"))
    return t.part.select("p_partkey", F.array_join(tm.clause_colours(clauses), "|").alias("colours"))


_PHRASES = (r"the and", r"of the", r"the", r"and", r"les? [a-z]+")


@query("phrase_extract", r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), '(?i)\b(?:the and|of the|the|and|les? [a-z]+)\b'), lambda x: x) AS l FROM documents),
 e AS (SELECT doc_id, unnest(l) AS phrase, generate_subscripts(l, 1) AS pos FROM w), f AS (SELECT doc_id, phrase, min(pos) AS pos FROM e GROUP BY 1, 2)
 SELECT doc_id, string_agg(phrase, '|' ORDER BY pos) AS phrases FROM f GROUP BY 1""")
def _(t):
    # Plain ASCII words, where word boundaries mean the same in every pattern dialect.
    found = tm.phrase_extract(F.regexp_replace(tx.fold("text"), "[^a-z0-9]+", " "), _PHRASES)
    return t.texts.select("doc_id", F.array_join(found, "|").alias("phrases")).where("phrases <> ''")


@query("binary_decode", "SELECT p_partkey, p_name AS decoded, CAST(NULL AS VARCHAR) AS undecoded FROM part")
def _(t):
    # Encode each name as spaced octets with Spark itself, then read it back.
    byte = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.lpad(F.bin(F.ascii(F.substring("p_name", i, F.lit(1)))), 8, "0"))
    return t.part.select("p_partkey", tx.decode_octets(F.array_join(byte, " ")).alias("decoded"), tx.decode_octets("p_name").alias("undecoded"))


def _size_text(t):
    size, kind = F.col("p_size"), F.col("p_type")
    text = (F.when(kind == "SMALL", F.concat(size, F.lit(" x 42 mm"))).when(kind == "LARGE", F.concat(size, F.lit("–"), size + 2, F.lit(" mm")))
            .when(kind == "MEDIUM", F.concat(F.lit("Diagonal: "), size, F.lit(" mm"))).when(kind == "PROMO", size.cast("string"))
            .when(kind == "ECONOMY", F.concat(F.lit("Approximately "), size, F.lit(".5 mm"))).otherwise(F.concat(size, F.lit(" mm"))))
    return t.part.select("p_partkey", text.alias("stated"))


@query("measure_parse", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN CAST(p_size AS DOUBLE) WHEN 'ECONOMY' THEN p_size + 0.5::DOUBLE END AS mm FROM part")
def _(t):
    return _size_text(t).select("p_partkey", ms.measure("stated", "mm").alias("mm"))


@query("water_parse", """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size * 10.0::DOUBLE WHEN 'LARGE' THEN 1000.0::DOUBLE + p_size WHEN 'PROMO' THEN 0.0::DOUBLE
 WHEN 'MEDIUM' THEN p_size * 10.0::DOUBLE WHEN 'ECONOMY' THEN CAST(p_size AS DOUBLE) END AS metres FROM part""")
def _(t):
    size, kind = F.col("p_size"), F.col("p_type")
    text = (F.when(kind == "SMALL", F.concat(size, F.lit(" ATM"))).when(kind == "MEDIUM", F.concat(size, F.lit(" bar (100 metres)")))
            .when(kind == "LARGE", F.concat(F.lit("Waterproof to 1,"), F.format_string("%03d", "p_size"), F.lit(" metres / 4,000 feet")))
            .when(kind == "PROMO", "not water-resistant").when(kind == "ECONOMY", F.concat(size, F.lit(" m"))).otherwise("Unknown"))
    return t.part.select("p_partkey", ms.water_metres(text).alias("metres"))


@query("frequency_parse", """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN CAST(p_size AS DOUBLE) WHEN 'LARGE' THEN CAST(p_size AS DOUBLE) WHEN 'MEDIUM' THEN CASE WHEN p_size = 4 THEN 4.0::DOUBLE END END AS hz FROM part""")
def _(t):
    size, kind = F.col("p_size"), F.col("p_type")
    text = (F.when(kind == "SMALL", F.concat(size, F.lit(" Hz"))).when(kind == "LARGE", F.concat(F.format_number(size * 7200, 0), F.lit(" vph")))
            .when(kind == "MEDIUM", F.concat(size, F.lit(" Hz (28,800 vibrations per hour)"))).otherwise("fast"))
    return t.part.select("p_partkey", ms.frequency_hz(text).alias("hz"))


@query("grouped_price", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS DOUBLE) WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS DOUBLE) END AS price FROM orders""")
def _(t):
    whole = F.floor("o_totalprice")
    text = (F.when(F.col("o_orderstatus") == "F", F.format_number(whole, 0)).when(F.col("o_orderstatus") == "O", whole.cast("string"))
            .otherwise(F.concat(whole, F.lit(",90"))))
    return t.orders.select("o_orderkey", mn.grouped_price(text).cast("double").alias("price"))


@query("currency_map", """SELECT p_partkey, mark, CASE mark WHEN '€' THEN 'EUR' WHEN 'US$' THEN 'USD' WHEN 'Rs.' THEN 'INR' WHEN 'chf' THEN 'CHF' WHEN 'HK$' THEN 'HKD' END AS currency
 FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '€' WHEN 'LARGE' THEN 'US$' WHEN 'MEDIUM' THEN 'Rs.' WHEN 'PROMO' THEN 'chf' WHEN 'ECONOMY' THEN 'HK$' ELSE '$' END AS mark FROM part)""")
def _(t):
    k = F.col("p_type")
    mark = (F.when(k == "SMALL", "€").when(k == "LARGE", "US$").when(k == "MEDIUM", "Rs.").when(k == "PROMO", "chf").when(k == "ECONOMY", "HK$").otherwise("$"))
    return t.part.select("p_partkey", mark.alias("mark"), mn.currency_code(mark).alias("currency"))


@query("condition_label", r"""SELECT doc_id, CASE WHEN used AND NOT retail THEN 'Pre-owned listing' WHEN retail AND NOT used THEN 'Reported retail price' ELSE 'Condition / price basis unspecified' END AS label
 FROM (SELECT doc_id, regexp_matches(e, '(?i)pre[- ]?owned|used|second[- ]hand') AS used, regexp_matches(e, '(?i)retail|msrp|rrp') AS retail
 FROM (SELECT doc_id, text || CASE lang WHEN 'de' THEN ' Pre-owned' WHEN 'fr' THEN ' MSRP' WHEN 'es' THEN ' retail, used' ELSE '' END AS e FROM documents))""")
def _(t):
    extra = F.when(F.col("lang") == "de", " Pre-owned").when(F.col("lang") == "fr", " MSRP").when(F.col("lang") == "es", " retail, used").otherwise("")
    return t.texts.select("doc_id", mn.condition_label(F.concat("text", extra)).alias("label"))


@query("reported_date", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderdate <= now THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END
 WHEN '2-HIGH' THEN CASE WHEN o_orderdate <= now THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END
 WHEN '3-MEDIUM' THEN CAST(CAST(now - to_days(CAST(7 * (o_custkey % 5) AS INT)) AS DATE) AS VARCHAR)
 WHEN '5-LOW' THEN CASE WHEN o_orderdate <= now THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END END AS reported
 FROM orders, (SELECT TIMESTAMP '2000-01-01 12:00:00' AS now)""")
def _(t):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    raw = (F.when(p == "1-URGENT", F.date_format(d, "MMM d, yyyy")).when(p == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
           .when(p == "3-MEDIUM", F.concat(F.col("o_custkey") % 5, F.lit(" weeks ago"))).when(p == "5-LOW", F.date_format(d, "d MMMM yyyy"))
           .otherwise(F.date_format(d, "yyyy")))
    now = F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", dt.reported_date(raw, now).cast("string").alias("reported"))


@query("local_date", "SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day FROM events")
def _(t):
    return t.events.select("event_id", dt.local_date("ts").cast("string").alias("day"))


@query("launch_year", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F','O','P') THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders")
def _(t):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", F.date_format("o_orderdate", "dd.MM.yyyy")).when(s == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", dt.launch_year(raw).alias("year"))


@query("positive_amount", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' THEN round(c_acctbal, 2) END AS amount FROM customer")
def _(t):
    text = F.when(F.col("c_mktsegment") == "MACHINERY", "n/a").otherwise(F.format_string("%.2f", "c_acctbal"))
    return t.customer.select("c_custkey", mn.positive_amount(text).cast("double").alias("amount"))


@query("display_price", "SELECT o_orderkey, 'USD ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown FROM orders")
def _(t):
    return t.orders.select("o_orderkey", mn.display_price(F.lit("USD"), F.floor("o_totalprice")).alias("shown"))


@query("csv_cell", r"""SELECT doc_id, md5('"' || CASE WHEN regexp_matches(v, '^\s*[=+@-]') THEN '''' ELSE '' END || replace(v, '"', '""') || '"') AS cell
 FROM (SELECT doc_id, CASE lang WHEN 'de' THEN '  @' WHEN 'fr' THEN '=' ELSE '' END || text || '"' AS v FROM documents)""")
def _(t):
    lead = F.when(F.col("lang") == "de", "  @").when(F.col("lang") == "fr", "=").otherwise("")
    return t.texts.select("doc_id", F.md5(tx.csv_cell(F.concat(lead, "text", F.lit('"')))).alias("cell"))


@query("record_id", """SELECT c_custkey, substr(sha256(c_name || '|' || CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'https://x/' || c_custkey END || '|' || c_mktsegment || '|'), 1, 24) AS id FROM customer""")
def _(t):
    ref = F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", rd.record_id("c_name", ref, F.concat(F.lit("https://x/"), "c_custkey"), "c_mktsegment", F.lit(None)).alias("id"))


@query("missing_list", f"""WITH {CATALOG} SELECT id, concat_ws(',', CASE WHEN reference IS NULL THEN 'reference' END, CASE WHEN diameter IS NULL THEN 'diameter' END) AS missing FROM catalog""")
def _(t):
    return t.catalog.select("id", F.array_join(rd.missing_fields(["reference", "model", "diameter"]), ",").alias("missing"))


@query("provenance_check", "SELECT p_partkey AS id, p_type <> 'SMALL' AS ok FROM part")
def _(t):
    located = F.struct(F.lit("https://x").alias("url"), F.lit("h1").alias("locator"),
                       F.when(F.col("p_type") == "SMALL", "other").otherwise(F.col("p_name")).alias("value"))
    rows = t.part.withColumn("provenance", F.map_from_entries(F.array(F.struct(F.lit("p_name").alias("key"), located.alias("value")))))
    return rows.select(F.col("p_partkey").alias("id"), rd.provenance_matches("provenance", ["p_name"], F.lit("https://x")).alias("ok"))


@query("json_paths", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(t):
    doc = vr.parse("props")
    return t.events.select("event_id", vr.first_path(doc, ["$.none", "$.k"], "bigint").alias("k"), vr.first_path(doc, ["$.missing"]).alias("missing"))


@query("cms_values", "SELECT p_partkey, p_name AS label, CASE p_type WHEN 'SMALL' THEN true WHEN 'LARGE' THEN false END AS limited FROM part")
def _(t):
    k = F.col("p_type")
    name = F.to_json(F.struct(F.col("p_name").alias("value")))
    wrapped = F.when(k == "SMALL", F.concat(F.lit('{"jsonValue":'), name, F.lit("}"))).when(
        k == "LARGE", F.concat(F.lit('{"fields":{"Name":'), name, F.lit("}}"))).otherwise(name)
    flags = F.when(k == "SMALL", '{"values":[{"x":1},{"boolean":true}]}').when(k == "LARGE", '{"values":[{"boolean":false}]}').otherwise('{"values":[]}')
    return t.part.select("p_partkey", vr.cms_value(vr.parse(wrapped)).alias("label"), vr.first_boolean(vr.parse(flags)).alias("limited"))


@query("negated_terms", """SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'red') OR p_type = 'LARGE' THEN 'red' END, CASE WHEN contains(p_name, 'gear') THEN 'gear' END) AS terms FROM part""")
def _(t):
    text = F.concat("p_name", F.when(F.col("p_type") == "LARGE", "; red case").otherwise("; No red"), F.lit(" without gear; gear: none"))
    terms = tm.stated_terms(text, [("red", r"\bred\b"), ("gear", r"\bgear\b")])
    return t.part.select("p_partkey", F.array_join(terms, ",").alias("terms"))
