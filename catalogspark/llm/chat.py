"""Chat formatting by quotation linking.

A message's lines carry a quote level, the number of leading ``>``. Neighbouring lines of one level are a passage. Passages
and their lines are normalised and hashed, and joined on (conversation, hash) to the first earlier message that has them
as its own words: its whole text or one of its lines. A message replies to the original of its least quoted linked passage
(of several originals the one with most quoted characters, then the earliest). What follows without a quote goes on in the
same branch. Branches are ordered as a reply tree is read: a message, then what goes on from it, then the replies to it.

Every step is a grouped aggregation or a join on (conversation, hash), with one original per key, so neither a common line
nor a long conversation multiplies rows; running state goes through chunks of a conversation. Paths of nested branches are
found by pointer doubling. Rows come out one per message, in conversation and reply order over range partitions.

Defined cases: null and empty texts have an empty body; repeated rows are one row with their number in ``copies``; ties in
turn go by a hash of role and text; a null conv_id is one conversation; a null turn comes first; a quote without an
original is removed and counted, and replies to nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm.quality import let
from catalogspark.llm.staging import written
from catalogspark.operators.ordered import chunked_last_known

_MARKS = r"^[ \t]*>(?:[ \t]*>)*[ \t]?"
#: A line that introduces a quote in the languages of the tables.
_INTRODUCES = r"(?i)\b(wrote|schrieb|escribi[oó]|a [eé]crit)\b.{0,80}:\s*$"
CHUNK = 1024


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def content(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def own_words(text: Column) -> Column:
    """A message without its quotes and the lines that introduce them."""
    def body(lines: Column) -> Column:
        def own(line: Column, i: Column) -> Column:
            quoted_next = F.coalesce(level(F.get(lines, i + 1)) > 0, F.lit(False))
            return (level(line) == 0) & ~(line.rlike(_INTRODUCES) & quoted_next)
        return F.btrim(F.array_join(F.filter(lines, own), "\n"), F.lit(" \t\r\n"))

    return F.when(text.rlike(r"(?m)^[ \t]*>"), let(F.split(text, "\n"), body)).otherwise(F.coalesce(text, F.lit("")))


def messages(rows: DataFrame) -> DataFrame:
    """One row per distinct message: conv_id, turn, tie, role, text, body, copies."""
    found = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return found.withColumn("tie", F.xxhash64("role", "text")).withColumn("body", own_words(F.col("text")))


def passages(said: DataFrame) -> DataFrame:
    """Quoted passages of messages: conv_id, turn, tie, level, passage number, lines (array)."""
    quoting = said.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = quoting.select("conv_id", "turn", "tie", "pos", level(F.col("line")).alias("level"), content(F.col("line")).alias("line"))
    # Lines of one message only: position minus rank within the level is the same for neighbours.
    of_level = Window.partitionBy("conv_id", "turn", "tie", "level").orderBy("pos")
    runs = lines.withColumn("run", F.col("pos") - F.row_number().over(of_level)).where("level > 0")
    joined = runs.groupBy("conv_id", "turn", "tie", "level", "run").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return joined.select("conv_id", "turn", "tie", "level", "pos", F.transform("lines", lambda x: x["line"]).alias("lines"))


def _units(whole: Column, lines: Column) -> Column:
    """Distinct normalised texts by which a passage can be found: all of it, and its lines."""
    return F.filter(F.array_distinct(F.concat(F.array(normal(whole)), F.transform(lines, normal))), lambda u: u != "")


def links(said: DataFrame) -> DataFrame:
    """Replies: conv_id, turn, tie and the message replied to (to_turn, to_tie)."""
    quoted = passages(said).withColumn("unit", F.explode(_units(F.array_join("lines", " "), F.col("lines"))))
    quoted = quoted.select("conv_id", "turn", "tie", "level", F.length("unit").alias("size"), F.md5("unit").alias("hash"))
    own = said.select("conv_id", "turn", "tie", F.explode(_units(F.col("body"), F.split("body", "\n"))).alias("unit"))
    first = own.groupBy("conv_id", F.md5("unit").alias("hash")).agg(F.min(F.struct("turn", "tie")).alias("original"))
    # The conversation's key is packed with the hash, so that an unknown conversation joins like any other.
    met = _packed(quoted).join(_packed(first).select("__key", "original"), "__key").where(F.struct("turn", "tie") > F.col("original"))
    per_original = met.groupBy("conv_id", "turn", "tie", "level", "original").agg(F.sum("size").alias("size"))
    best = F.min_by("original", F.struct("level", (-F.col("size")).alias("size"), "original"))
    return per_original.groupBy("conv_id", "turn", "tie").agg(best.alias("original")).select(
        "conv_id", "turn", "tie", F.col("original.turn").alias("to_turn"), F.col("original.tie").alias("to_tie"))


def _packed(df: DataFrame) -> DataFrame:
    return df.withColumn("__key", F.struct("conv_id", "hash"))


def _message(*names: str) -> Column:
    return F.struct("conv_id", *[F.col(n).alias(("turn", "tie")[i]) for i, n in enumerate(names)])


def branch_paths(placed: DataFrame) -> DataFrame:
    """Path of every branch: (branch, path). A step is (attached later first, then begun earlier first)."""
    starts = placed.where("to_turn is not null or to_tie is not null")
    of = placed.select(_message("turn", "tie").alias("__to"), F.col("branch").alias("parent"))
    step = F.struct((-F.col("to_turn")).alias("a"), (-F.col("to_tie")).alias("b"), F.col("turn").alias("c"), F.col("tie").alias("d"))
    table = starts.withColumn("__to", _message("to_turn", "to_tie")).join(of, "__to").select(
        _message("turn", "tie").alias("branch"), "parent", F.array(step).alias("path"))
    table = written(table, "branches")
    while not table.where("parent is not null").isEmpty():
        above = table.select(F.col("branch").alias("parent"), F.col("parent").alias("__next"), F.col("path").alias("__path"))
        table = written(table.join(above, "parent", "left").select(
            "branch", F.col("__next").alias("parent"), F.when(F.col("__path").isNull(), F.col("path")).otherwise(F.concat("__path", "path")).alias("path")), "branches")
    return table.select("branch", "path")


def reply_ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, reply_to (turn of the message replied to), depth of the branch, copies and
    ``reply_path``; rows of a conversation in the order (reply_path, turn)."""
    said = written(messages(rows.select("conv_id", "turn", "role", "text")), "messages")
    replies = written(links(said), "links").select(_message("turn", "tie").alias("__m"), "to_turn", "to_tie")
    counts = passages(said).groupBy(_message("turn", "tie").alias("__m")).agg(F.count("*").alias("n_quotes"))
    with_links = said.withColumn("__m", _message("turn", "tie")).join(replies, "__m", "left").join(counts, "__m", "left")
    starts = F.col("to_tie").isNotNull()
    # The branch of a message is begun by itself or by the last message before it that begins one.
    carried = chunked_last_known(with_links, ["conv_id"], ["turn", "tie"], F.floor(F.col("turn") / CHUNK), {"before": F.col("__m")}, starts)
    placed = written(carried.withColumn("branch", F.when(starts, F.col("__m")).otherwise(F.col("before"))).drop("before"), "placed")
    paths = branch_paths(placed)
    out = placed.join(paths, "branch", "left").select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), F.col("to_turn").alias("reply_to"),
        F.coalesce(F.size("path"), F.lit(0)).alias("depth"), "copies", "tie",
        F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>")).alias("reply_path"))
    ordered = out.repartitionByRange("conv_id", "reply_path", "turn", "tie").sortWithinPartitions("conv_id", "reply_path", "turn", "tie")
    return ordered.drop("tie")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
