"""Chat formatting by quotation linking.

Lines that begin with > marks are quotes, as deep as they have marks. Runs of lines of one depth,
parted by blank lines, are passages; passages and their single lines are normalised (white space
collapsed, lower case) and hashed. A quote is joined to the first message of its conversation that
has the same passage or line as its own text, unquoted. The message of the latest of a message's least deep
linked quotes is the one it replies to, and conversations are put into reply order: by the
message replied to, then by turn, so that every reply follows its message and the replies to one message
stand together. A message without a linked quote counts as a reply to the turn before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import Workspace, hot_join, ranked, with_row_id

NAME = "op5_quotation_links"

#: Code points of the shortest single line of a passage that is linked (whole passages are at any length); turns of a cell.
LEAST, CELL = 16, 256
# The marks of a quoted line, and white space.
MARKS, SPACE = r"^(?:[\x20\x09]*>)+[\x20\x09]?", r"[\x20\x09-\x0D]+"


def lines_of(messages: DataFrame) -> DataFrame:
    """A row for each line: _rid, conv, turn, pos, depth, body (without marks), plain (normalised)."""
    line = F.col("line")
    marks = F.regexp_extract(line, MARKS, 0)
    each = messages.select("_rid", "conv", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select("_rid", "conv", "turn", "pos", F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"))
    return each.withColumn("plain", F.trim(F.regexp_replace(F.lower("body"), SPACE, " ")))


def passages(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """Distinct units to link: _rid, conv, turn, depth, unit (hash of a whole passage or of one of its lines of `least` code points)."""
    by_line = Window.partitionBy("_rid").orderBy("pos")
    gap = (F.col("plain") == "") | (F.lag("plain").over(by_line) == "") | (F.lag("depth").over(by_line) != F.col("depth"))
    runs = lines.withColumn("starts", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("starts").over(by_line)).where("plain <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "plain")))  # no more than a message's lines
    whole = runs.groupBy("_rid", "conv", "turn", "depth", "run").agg(F.array_join(ordered["plain"], " ").alias("plain"))
    single = runs.where(F.length("plain") >= least)
    units = whole.select("_rid", "conv", "turn", "depth", "plain").unionAll(single.select("_rid", "conv", "turn", "depth", "plain"))
    hashed = F.concat_ws(":", F.length("plain"), F.xxhash64("plain"), F.xxhash64(F.lit(1), "plain")).alias("unit")
    return units.select("_rid", "conv", "turn", "depth", hashed).distinct()


def link(conversations: DataFrame, least: int = LEAST, ws: Workspace | None = None) -> DataFrame:
    """conv_id, position, turn, role, text (own lines), reply_to, n_quoted, n_linked of every message.

    conversations needs conv_id, turn, role and text; other columns are not looked at, whatever their
    names. Quoted passages are linked at any length, single lines from `least` code points on. position is
    gapless from 0 within a conversation; reply_to is the turn a linked quote comes from, else null.
    Null ids make one conversation, a null turn comes first and is never linked, a null text stays null, a
    text of quotes alone becomes empty. Repeated rows are messages each. An empty table gives no rows.
    """
    ws = ws or Workspace(conversations.sparkSession, "quotes")
    c = conversations
    conv = F.struct(c["conv_id"].isNull().alias("none"), F.coalesce(c["conv_id"], F.lit(0)).alias("id"))
    messages = ws.save(with_row_id(c.select(conv.alias("conv"), c["turn"].cast("long").alias("turn"), c["role"].alias("role"), c["text"].alias("text"))), "messages")
    lines = lines_of(messages.where("text is not null"))
    units = ws.save(passages(lines, least), "units")
    source = F.min(F.when(F.col("depth") == 0, F.col("turn"))).alias("source")
    first = units.groupBy("conv", "unit").agg(source, F.count_if(F.col("depth") > 0).alias("n")).where("n > 0 and source is not null")
    quoted = units.where("depth > 0")
    quotes = hot_join(quoted, ws.save(first, "first"), ["conv", "unit"], "n", quoted.count()).where("source < turn")
    linked = quotes.groupBy("_rid").agg(F.min(F.struct("depth", (-F.col("source")).alias("source"))).alias("best"), F.count(F.lit(1)).alias("n_linked"))
    own = F.array_sort(F.collect_list(F.when(F.col("depth") == 0, F.struct("pos", "body"))))
    texts = lines.groupBy("_rid").agg(F.array_join(own["body"], "\n").alias("own"), F.count_if(F.col("depth") > 0).alias("n_quoted"))
    joined = messages.drop("text").join(texts, "_rid", "left").join(linked, "_rid", "left")
    placed = joined.select("_rid", "conv", "turn", "role", F.col("own").alias("text"), (-F.col("best.source")).alias("reply_to"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    after = F.coalesce(F.col("reply_to"), F.col("turn") - 1)
    none = F.lit(-(2**62)).cast("long")
    placed = placed.withColumn("after", F.coalesce(after, none)).withColumn("at", F.coalesce("turn", none)).withColumn("tie", F.xxhash64("role", "text", "_rid"))
    # cells that follow the order: replies to few turns, to one turn, by few turns, by one turn, and by hash, so that neither a long thread nor many replies to one turn meet in a task
    cells = {"c0": F.floor(F.col("after") / CELL), "c1": F.col("after"), "c2": F.floor(F.col("at") / CELL), "c3": F.col("at"), "c4": F.shiftright("tie", 58)}
    placed = ws.save(placed.withColumns({k: c.cast("long") for k, c in cells.items()}), "placed")
    numbered = ranked(placed, ["conv"], list(cells), ["after", "at", "tie"], "position")
    return numbered.select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), "position", "turn", "role", "text", "reply_to", "n_quoted", "n_linked")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = rf"""
WITH messages AS (
  SELECT conv_id, turn, role, text, row_number() OVER () AS rid FROM conversations
), split AS (
  SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM messages WHERE text IS NOT NULL
), lines AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS depth, substr(line, length(regexp_extract(line, '{MARKS}')) + 1) AS body FROM split
), plain AS (
  SELECT *, trim(regexp_replace(lower(body), '{SPACE}', ' ', 'g'), ' ') AS p FROM lines
), marked AS (
  SELECT *, CASE WHEN p = '' OR lag(p) OVER w IS NULL OR lag(p) OVER w = '' OR lag(depth) OVER w <> depth THEN 1 ELSE 0 END AS starts FROM plain WINDOW w AS (PARTITION BY rid ORDER BY pos)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY pos) AS run FROM marked
), units AS (
  SELECT DISTINCT * FROM (
    SELECT rid, conv_id, turn, depth, p FROM runs WHERE p <> '' AND length(p) >= {LEAST}
    UNION ALL SELECT rid, conv_id, turn, depth, string_agg(p, ' ' ORDER BY pos) FROM runs WHERE p <> '' GROUP BY rid, conv_id, turn, depth, run
  )
), firsts AS (
  SELECT conv_id, p, min(turn) AS source FROM units WHERE depth = 0 GROUP BY conv_id, p
), quotes AS (
  SELECT u.rid, u.depth, f.source FROM units u JOIN firsts f ON u.p = f.p AND u.conv_id IS NOT DISTINCT FROM f.conv_id WHERE u.depth > 0 AND f.source < u.turn
), linked AS (
  SELECT rid, count(*) AS n_linked, arg_min(source, depth * 1000000000000 - source) AS reply_to FROM quotes GROUP BY rid
), texts AS (
  SELECT rid, coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE depth = 0), '') AS own, count(*) FILTER (WHERE depth > 0) AS n_quoted FROM lines GROUP BY rid
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(reply_to, turn - 1) NULLS FIRST, turn NULLS FIRST) - 1 AS position,
  turn, role, own AS text, reply_to, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
FROM messages LEFT JOIN texts USING (rid) LEFT JOIN linked USING (rid)
"""
