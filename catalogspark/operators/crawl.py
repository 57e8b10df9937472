"""Crawl permissions and page checks over URL tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions.text import _col
from catalogspark.functions.urls import (
    SitePattern, classify_url, host, normalise_octets, path, query, resolve, scheme, url_key, url_reference,
)
from catalogspark.session import scratch_folder
from catalogspark.shaping import once

# Markers of a bot-challenge page and the statuses that close a host.
CHALLENGE_MARKERS = ("<title>access denied", "<title>just a moment", "cf-chl-", "<title>attention required",
                     "verify you are human", "<title>robot or human")
BLOCKING_STATUSES = (401, 403, 429, 451)


def is_complete_html(c: Column | str) -> Column:
    """Not cut off: no truncation mark and a closing html tag at the end."""
    c = _col(c)
    return ~c.contains("[Truncated]") & F.rtrim(F.regexp_replace(c, r"\s+$", "")).endswith("</html>")


def is_blocked(body: Column | str, status: Column | None = None) -> Column:
    """Challenge page or refusing status."""
    text = F.lower(_col(body))
    hit = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        hit = hit | text.contains(marker)
    return hit if status is None else hit | F.coalesce(status.isin(*BLOCKING_STATUSES), F.lit(False))


def robots_specificity(pattern: Column | str) -> Column:
    return F.octet_length(F.regexp_replace(_col(pattern), r"\*|\$$", ""))


def select_agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Rules that bind one product token: its own groups when the host has any, else the '*' groups. An empty value
    states no rule; it only counts for the choice of the group."""
    mine = rules.where(F.lower("agent").isin(agent.lower(), "*"))
    own = F.bool_or(F.lower("agent") == agent.lower()).alias("__own")
    hosts = mine.groupBy("host").agg(own)
    joined = mine.join(hosts, "host")
    chosen = joined.where((F.lower("agent") == agent.lower()) == F.col("__own")).drop("__own", "agent")
    return chosen.where(F.trim("pattern") != "")


def robots_rules(files: DataFrame, host_col: str, body: str, captured: str | None = None) -> DataFrame:
    """(host, agent, allow, pattern, delay, signals, sitemap) of robots texts: one row per agent and rule line.

    A host has one robots file. Of several captures the one with the largest ``captured`` binds, of equally new ones
    the last text in order; lines of different files never meet.

    A group is a run of user-agent lines and all other lines up to the next user-agent line. ``delay`` and
    ``signals`` are null but on their own lines, ``sitemap`` rows bind no agent. The running group number is taken
    over the lines of one file. A group without a rule has one row with an empty pattern, so that it can be chosen.
    """
    age = F.struct(F.lit(0) if captured is None else F.col(captured), F.col(body))
    newest = files.groupBy(F.col(host_col).alias("host")).agg(F.max_by(body, age).alias("body"))
    split = newest.select("host", F.posexplode(F.split("body", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("at", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*", ""))
    split = split.select("host", "at", line.alias("line")).where(F.col("line").contains(":"))
    keyed = split.select("host", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    sitemaps = keyed.where("key = 'sitemap'").select("host", F.col("value").alias("sitemap"))
    by_line = Window.partitionBy("host").orderBy("at")
    names = F.col("key") == "user-agent"
    opens = names & ~F.coalesce(F.lag("key").over(by_line) == "user-agent", F.lit(False))
    grouped = keyed.where("key <> 'sitemap'").withColumn("group", F.sum(opens.cast("int")).over(by_line))
    agents = grouped.where(names).select("host", "group", F.lower("value").alias("agent"))
    known = F.col("key").isin("allow", "disallow", "crawl-delay", "content-signal")
    rules = grouped.where(known & (F.col("group") > 0)).select(
        "host", "group", F.when(F.col("key").isin("allow", "disallow"), F.col("key") == "allow").alias("allow"),
        F.when(F.col("key").isin("allow", "disallow"), F.col("value")).alias("pattern"),
        F.when(F.col("key") == "crawl-delay", F.greatest(F.col("value").try_cast("double"), F.lit(0.0))).alias("delay"),
        F.when(F.col("key") == "content-signal", F.col("value")).alias("signals"))
    bound = agents.join(rules, ["host", "group"], "left").drop("group")
    bound = bound.withColumn("pattern", F.coalesce("pattern", F.lit(""))).withColumn("allow", F.coalesce("allow", F.lit(False)))
    return bound.distinct().unionByName(sitemaps.distinct(), allowMissingColumns=True)


def robots_head(pattern: Column | str) -> Column:
    """Literal beginning of a pattern: what stands before its first '*' or its closing '$'."""
    c = _col(pattern)
    return F.when(c.contains("*"), F.substring_index(c, "*", 1)).otherwise(F.regexp_replace(c, r"\$$", ""))


def robots_tail_matches(url_path: Column, head: Column, tail: Column) -> Column:
    """The rest of a pattern, from its first '*' or its closing '$', fits the rest of a path that begins with ``head``.
    Pieces between stars are looked for one after another, each as early as possible; no pattern is compiled."""
    anchored = tail.endswith("$")
    pieces = F.split(F.regexp_replace(tail, r"\$$", ""), r"\*")
    last = F.when(anchored & (F.size(pieces) > 1), F.element_at(pieces, -1)).otherwise("")
    middle = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - F.when(anchored, 2).otherwise(1), F.lit(0))), lambda p: p != "")

    def on(at: Column, piece: Column) -> Column:
        found = F.position(piece, url_path, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(piece))

    at = F.aggregate(middle, F.length(head) + 1, on)
    ends = url_path.endswith(last) & (F.length(url_path) - F.length(last) + 1 >= at)
    whole = F.length(url_path) == F.length(head)
    return F.when(tail == "", F.lit(True)).when(tail == "$", whole).otherwise((at > 0) & (~anchored | ends))


def robots_decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed``: the longest matching rule wins, allow wins ties, no rule means allowed.

    Longest-prefix match by equi joins. A distinct (host, path) is cut at the lengths that the literal heads of its host's
    rules have, and each cut meets the rules with that very head, so rules that cannot match are never looked at,
    whatever their number. Wildcard rules are tested on what follows their head. One aggregation keeps the best rule.
    """
    pattern = normalise_octets("pattern")
    heads = rules.select(F.col("host").alias("__host"), F.col("allow").alias("__allow"), pattern.alias("__pattern"))
    heads = heads.select("__host", robots_head("__pattern").alias("__head"), "__pattern", F.struct(
        robots_specificity("__pattern").alias("len"), F.col("__allow").alias("allow")).alias("__rule"))
    tail = F.substring("__pattern", F.length("__head") + 1, F.length("__pattern"))
    # Plain rules of one head are one rule.
    heads = heads.groupBy("__host", "__head", tail.alias("__tail")).agg(F.max("__rule").alias("__rule"))
    lengths = heads.select("__host", F.length("__head").alias("__n")).distinct()
    raw = F.concat(F.when(path("url") == "", "/").otherwise(path("url")), query("url"))
    keyed = urls.withColumns({"__host": host("url"), "__path": normalise_octets(raw)})
    asked = keyed.select("__host", "__path").distinct()
    cuts = asked.join(lengths, "__host").where(F.col("__n") <= F.length("__path")).withColumn("__head", F.left("__path", F.col("__n")))
    hits = cuts.join(heads, ["__host", "__head"]).where(robots_tail_matches(F.col("__path"), F.col("__head"), F.col("__tail")))
    best = hits.groupBy("__host", "__path").agg(F.max("__rule").alias("__rule"))
    joined = keyed.join(best, ["__host", "__path"], "left")
    return joined.select(*urls.columns, F.coalesce(F.col("__rule.allow"), F.lit(True)).alias("allowed"))


def grant_decide(urls: DataFrame, grants: DataFrame, purpose: str, today: Column) -> DataFrame:
    """Add ``granted``: a written grant for the purpose, in date, whose https prefix covers the url at a path
    boundary. ``grants`` has one row per (prefix, purpose flag). A distinct path is cut before each of its slashes and the
    cuts are looked up among the prefixes of its host by an equi join, whatever their number."""
    scope = grants.where(F.col(purpose) & (F.col("evidence") != "") & (F.col("valid_until") >= today))
    scope = scope.where((scheme("url_prefix") == "https") & (query("url_prefix") == ""))
    prefix = path("url_prefix")
    keys = F.array(F.struct(F.lit("whole").alias("how"), prefix.alias("key")), F.struct(F.lit("below").alias("how"), F.regexp_replace(prefix, "/+$", "").alias("key")))
    scopes = scope.select(host("url_prefix").alias("__host"), F.inline(keys)).distinct()
    keyed = urls.withColumns({"__host": host("url"), "__path": path("url")})
    parts = F.split("__path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.lit("below").alias("how"), F.array_join(F.slice(parts, 1, i), "/").alias("key"))))
    whole = F.array(F.struct(F.lit("whole").alias("how"), F.col("__path").alias("key")))
    cuts = keyed.select("__host", "__path").distinct().select("__host", "__path", F.inline(F.concat(whole, F.coalesce(above, F.slice(whole, 1, 0)))))
    covered = cuts.join(scopes, ["__host", "how", "key"], "left_semi").select("__host", "__path").distinct().withColumn("granted", F.lit(True))
    joined = keyed.join(covered, ["__host", "__path"], "left")
    return joined.select(*urls.columns, F.coalesce(joined["granted"], F.lit(False)).alias("granted"))


def page_links(pages: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, ord, href) of every anchor, in document order."""
    hrefs = F.regexp_extract_all(F.col(body), F.lit('<a\\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(id_col), F.posexplode(hrefs).alias("ord", "href"))


def discover_links(pages: DataFrame, id_col: str, url: str, body: str, sites: Sequence[SitePattern],
                   require_https: bool = True) -> DataFrame:
    """(id, target, kind) of the official product and listing links of each page, distinct.

    Anchors and addresses stated in inert JSON (``url``, ``href``, ``productUrl``) count; nothing is evaluated.
    """
    anchors = F.regexp_extract_all(F.col(body), F.lit('<a\\s[^>]*?href="([^"]*)"'), F.lit(1))
    scripts = F.regexp_extract_all(
        F.col(body), F.lit(r'(?is)<script[^>]*type="application/(?:ld\+)?json"[^>]*>(.*?)</script>'), F.lit(1))
    stated = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(
        s, F.lit(r'"(?:url|href|productUrl)"\s*:\s*"([^"]+)"'), F.lit(1))))
    rows = pages.select(F.col(id_col), F.col(url).alias("__base"), F.explode(F.array_distinct(F.concat(anchors, stated))).alias("__href"))
    rows = once(rows, target=resolve("__base", "__href"))
    found = once(rows, kind=classify_url("target", sites, require_https)).where(F.col("kind").isNotNull())
    return found.select(id_col, "target", "kind").distinct()


def listing_items(links: DataFrame, id_col: str, sites: Sequence[SitePattern]) -> DataFrame:
    """(listing page, url, reference) of the products a listing page shows, one row per product."""
    products = links.where(F.col("kind") == "product")
    keyed = products.select(id_col, url_key("target").alias("url"), url_reference("target", sites).alias("reference"))
    return keyed.distinct()


def chain_order(links: DataFrame) -> DataFrame:
    """(node, head, place, looped) of the pages of chains ``links(node, next)``; ``next`` is null on a last page.

    List ranking by pointer doubling: each round every page takes its pointer's pointer, so a chain of n pages needs log n
    rounds of one equi join. ``place`` counts from 0 at the chain's head. Where several pages name one next page, the
    smallest counts. Pages on a loop, or behind one, never meet a head: they are ``looped`` and have no place. Pages
    that are only named, and never seen, are gaps: they end their chain and are not part of the result.
    """
    spark, folder = links.sparkSession, scratch_folder(links.sparkSession, "chain")
    nodes = links.where("node is not null").select("node").distinct()
    before = links.where("node is not null and next is not null").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("jump"))
    state = nodes.join(before, "node", "left").select("node", "jump", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("place"), F.coalesce("jump", "node").alias("head"))
    n = nodes.count()
    for step in range(n.bit_length() + 1):
        state.write.parquet(f"{folder}/{step}")
        state = spark.read.schema(state.schema).parquet(f"{folder}/{step}")
        if state.where("jump is not null").isEmpty():
            break
        on = state.select(F.col("node").alias("jump"), F.col("jump").alias("__jump"), F.col("place").alias("__place"), F.col("head").alias("__head"))
        state = state.join(on, "jump", "left").select(
            "node", F.col("__jump").alias("jump"), (F.col("place") + F.coalesce("__place", F.lit(0))).alias("place"), F.coalesce("__head", "head").alias("head"))
    looped = F.col("jump").isNotNull()
    return state.select("node", F.when(~looped, F.col("head")).alias("head"), F.when(~looped, F.col("place")).alias("place"), looped.alias("looped"))


def work_order(queue: DataFrame, kind: str = "kind", url: str = "url") -> DataFrame:
    """Add the processing rank of a queue entry: sitemaps, then listings, then products; order by (rank, url)."""
    rank = F.when(F.col(kind) == "sitemap", 0).when(F.col(kind) == "listing", 1).otherwise(2)
    return queue.withColumn("kind_rank", rank)


def expand_frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, buckets: int = 64) -> DataFrame:
    """(node, origin, round) reachable from the seeds over ``links(src, dst)``.

    Breadth first and semi-naive. Links and what was reached lie in tables cut into buckets by a hash of the node. A round
    reads the links in the newest nodes' buckets and, of all earlier rounds, the buckets of their targets; it appends
    the new nodes and rewrites nothing, so over all rounds every reached node is written once and every link is
    followed once. The driver sees the numbers of touched buckets. It ends when nothing new is reached;
    ``max_depth`` is the caller's own limit, not one of the operator. Unknown nodes are no nodes.
    """
    spark = links.sparkSession
    folder = scratch_folder(spark, "frontier")
    node_type = links.schema["dst"].dataType.simpleString()

    def bucket(node: str) -> Column:
        return F.pmod(F.xxhash64(F.col(node).cast(node_type)), F.lit(buckets)).cast("int")

    def keep(df: DataFrame, name: str) -> None:
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")

    def stored(name: str, columns: str) -> DataFrame:
        return spark.read.schema(f"{columns}, bucket int").parquet(f"{folder}/{name}")

    def touched(df: DataFrame) -> list[int]:
        return [r["bucket"] for r in df.select("bucket").distinct().collect()]  # at most ``buckets`` numbers

    def reached() -> DataFrame:
        return spark.read.schema(f"node {node_type}, origin string, round int, bucket int").parquet(f"{folder}/seen")

    keep(links.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("bucket", bucket("src")), "links")
    start = seeds.select(F.col("node").cast(node_type).alias("node")).where("node is not null").distinct()
    keep(start.select("node", F.lit("seed").alias("origin"), bucket("node").alias("bucket")), "seen/round=0")
    for step in count(1):
        newest = stored(f"seen/round={step - 1}", f"node {node_type}, origin string")
        here = touched(newest)
        if not here or (max_depth is not None and step > max_depth):
            return reached().drop("bucket")
        edges = stored("links", f"src {node_type}, dst {node_type}").where(F.col("bucket").isin(here))
        out = edges.join(newest.select("bucket", F.col("node").alias("src")), ["bucket", "src"], "left_semi")
        keep(out.select(F.col("dst").alias("node")).distinct().withColumn("bucket", bucket("node")), f"targets/round={step}")
        targets = stored(f"targets/round={step}", f"node {node_type}")
        known = reached().where(F.col("bucket").isin(touched(targets))).select("bucket", "node")
        keep(targets.join(known, ["bucket", "node"], "left_anti").select("node", F.lit("link").alias("origin"), "bucket"), f"seen/round={step}")
