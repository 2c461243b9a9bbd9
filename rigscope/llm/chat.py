"""Chat formatting with quotation linking: conversations in reply order, without what their messages quote.

Lines that begin with ``>`` quote; as many marks as there are (blanks between them allowed) are their level. Neighbouring
quoted lines of a level are one passage. Passages, and their single lines of ``MIN_LINE`` characters or more, are
compared by a hash of their normal form: lower case, runs of anything but letters and digits as one blank. The original
of a quotation is the first message of its conversation whose own text holds it, as a whole, as a paragraph or as a
line, if that message stands before the quoting one.

A message replies to the original of its least deeply quoted passage; of several the longest, then the latest. Messages
that follow no link begin a thread. A conversation's order is by the thread's first turn, then by turn, so every reply
comes after what it replies to. Spark's functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize

MIN_LINE = 12        # normalised characters of a line that counts beside its whole passage
BLOCK = 64           # messages of a conversation that are written as one text
QUOTED = r"^[ \t]*(>[ \t]*)+"
_KEY = ["conv", "turn", "code"]


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """A message without its quoted lines, and without blank lines at its ends."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTED))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                       whole.alias("text")).withColumn("code", F.xxhash64("role", "text"))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, code, level, passage): the normal forms of each quoted run of lines and of its lines."""
    quoting = messages.where(F.col("text").rlike(f"(?m){QUOTED}")).dropDuplicates(_KEY)
    lines = quoting.select(*_KEY, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_replace(F.regexp_extract("line", f"({QUOTED})", 1), "[^>]", "")
    lines = lines.withColumn("level", F.length(marks)).withColumn("line", normal(F.regexp_replace("line", QUOTED, "")))
    order = Window.partitionBy(*_KEY).orderBy("pos")       # the lines of one message
    begins = F.col("level") != F.lag("level", 1, -1).over(order)
    lines = lines.withColumn("run", F.sum(begins.cast("int")).over(order)).where("level > 0")
    runs = lines.groupBy(*_KEY, "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), " "), " +", " "))
    runs = runs.select(*_KEY, "level", joined.alias("passage"))
    singles = lines.where(F.length("line") >= MIN_LINE).select(*_KEY, "level", F.col("line").alias("passage"))
    return runs.unionByName(singles).where("passage <> ''").distinct()


def _held(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, passage code, first): the first turn that holds each passage in its own text. Only conversations with
    quotations are looked at; the first turn is a minimum, so no list of holders is gathered."""
    asking = wanted.select("conv").distinct()
    own = messages.join(asking, "conv", "left_semi").select("conv", "turn", own_text(F.col("text")).alias("own"))
    parts = F.array_union(F.array(F.col("own")), F.array_union(F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))
    held = own.select("conv", "turn", F.explode(parts).alias("part")).select("conv", "turn", normal(F.col("part")).alias("part"))
    return (held.where("part <> ''").groupBy("conv", F.xxhash64("part").alias("hash")).agg(F.min("turn").alias("first")))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, code, n_quotes, n_linked, reply_to): a row for each message that quotes."""
    passages = _passages(messages).withColumn("hash", F.xxhash64("passage")).withColumn("size", F.length("passage"))
    passages = materialize(passages.drop("passage"), "chat-passages")
    held = materialize(_held(messages, passages), "chat-held")
    met = passages.join(held, ["conv", "hash"], "left")
    met = met.withColumn("first", F.when(F.col("first") < F.col("turn"), F.col("first")))
    best = F.min(F.when(F.col("first").isNotNull(), F.struct("level", -F.col("size"), -F.col("first"))))
    links = met.groupBy(*_KEY).agg(F.count("*").alias("n_quotes"), F.count("first").alias("n_linked"), best.alias("best"))
    return materialize(links.select(*_KEY, "n_quotes", "n_linked", (-F.col("best").getField("col3")).alias("reply_to")),
                       "chat-links")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv, turn, root) of every turn that replies, by pointer jumping: rounds grow with the logarithm of the longest
    chain. Replies go to earlier turns, so there are no cycles. Of several messages of a turn the earliest link counts."""
    up = links.where("reply_to IS NOT NULL").groupBy("conv", "turn").agg(F.min("reply_to").alias("root"))
    up = materialize(up, "chat-roots")
    while not up.isEmpty():
        above = up.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        jumped = up.join(above, ["conv", "root"], "left")
        jumped = materialize(jumped.select("conv", "turn", F.coalesce("above", "root").alias("root"),
                                           F.col("above").isNotNull().alias("moved")), "chat-roots")
        moved = not jumped.where("moved").isEmpty()
        up = jumped.drop("moved")
        if not moved:
            break
    return up


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their position in the conversation. Rows are dealt by ranges of (conversation, thread, turn), so a
    conversation of any length spreads over many tasks; a row's position is the number of its conversation's rows in the
    ranges before, and its rank in its own."""
    order = ["root", "turn", "code"]
    dealt = rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "chat-ranges")
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("size"))      # a row for each conversation and range
    before = F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("conv").alias("conv_"), F.col("part").alias("part_"),
                          F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    return (dealt.withColumn("inside", inside)
            .join(starts, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")))
            .withColumn("position", F.col("start") + F.col("inside")).drop("conv_", "part_", "part", "start", "inside"))


def linked_messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """(conv, turn, role, own, n_quotes, n_linked, reply_to, root, position): a row for each message, in its place.

    Null texts are empty messages; null roles stay null. Messages without a conversation form one, messages without a
    turn come first in theirs; neither are linked. Several messages of a turn stand in a fixed order; repeated rows are
    repeated messages. An empty table gives no rows; other columns are not read.
    """
    messages = _messages(rows, conv, turn, role, text)
    links = reply_links(messages)
    roots = thread_roots(links)
    said = messages.join(links, _KEY, "left").join(roots, ["conv", "turn"], "left")
    said = said.select("conv", "turn", "code", "role", own_text(F.col("text")).alias("own"),
                       F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                       "reply_to", F.coalesce("root", "turn").alias("root"))
    return _numbered(said).drop("code")


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              block: int = BLOCK) -> DataFrame:
    """(conv_id, block, n_messages, n_quotes, n_replies, turns, chat): conversations as chat text in reply order.

    Each message is ``<|role|>``, a line feed, its own text and ``<|end|>``; a null role is ``unknown``. Conversations of
    more than ``block`` messages go on in further blocks, so that no task gathers more than that.
    """
    said = linked_messages(rows, conv, turn, role, text)
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("<|end|>\n"))
    parts = said.select("conv", F.floor(F.col("position") / block).cast("int").alias("block"),
                        F.struct("position", F.coalesce(F.col("turn").cast("string"), F.lit("-")).alias("turn"),
                                 chat.alias("chat")).alias("part"), "n_quotes", F.col("reply_to").isNotNull().alias("replies"))
    whole = parts.groupBy("conv", "block").agg(
        F.count("*").cast("int").alias("n_messages"), F.sum("n_quotes").cast("int").alias("n_quotes"),
        F.sum(F.col("replies").cast("int")).cast("int").alias("n_replies"), F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(F.col("conv").alias("conv_id"), "block", "n_messages", "n_quotes", "n_replies",
                        F.array_join(F.transform("parts", lambda p: p["turn"]), ",").alias("turns"),
                        F.array_join(F.transform("parts", lambda p: p["chat"]), "").alias("chat"))


def op7_sql(block: int = BLOCK, min_line: int = MIN_LINE) -> str:
    """DuckDB SQL for ``queries.op7_chat_formatting`` (a turn of a conversation is one message there)."""
    quoted = r"^[ \t]*(>[ \t]*)+"
    norm = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))".format
    return rf"""
WITH RECURSIVE msg AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
line AS (
  SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM msg),
lvl AS (
  SELECT conv_id, turn, pos, raw, length(regexp_replace(regexp_extract(raw, '{quoted}'), '[^>]', '', 'g')) AS level
  FROM line),
own AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''),
         '^\s+|\s+$', '', 'g') AS own
  FROM lvl GROUP BY ALL),
step AS (
  SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER w THEN 1 ELSE 0 END AS begins FROM lvl
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
runs AS (
  SELECT conv_id, turn, level, {norm("regexp_replace(raw, '" + quoted + "', '')")} AS line, pos,
         sum(begins) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM step),
passage AS (
  SELECT DISTINCT conv_id, turn, level, passage FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), ' +', ' ', 'g')) AS passage
    FROM runs WHERE level > 0 GROUP BY conv_id, turn, level, run
    UNION ALL SELECT conv_id, turn, level, line FROM runs WHERE level > 0 AND length(line) >= {min_line})
  WHERE passage <> ''),
part AS (
  SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS part
  FROM own),
held AS (SELECT conv_id, {norm("part")} AS passage, min(turn) AS first FROM part GROUP BY ALL),
met AS (
  SELECT p.*, CASE WHEN h.first < p.turn THEN h.first END AS first
  FROM passage p LEFT JOIN held h ON p.conv_id = h.conv_id AND p.passage = h.passage),
link AS (
  SELECT conv_id, turn, count(*) AS n_quotes,
         (list(first ORDER BY level, length(passage) DESC, first DESC) FILTER (WHERE first IS NOT NULL))[1] AS reply_to
  FROM met GROUP BY ALL),
up AS (
  SELECT m.conv_id, m.turn, m.turn AS root FROM msg m LEFT JOIN link l ON m.conv_id = l.conv_id AND m.turn = l.turn
  WHERE l.reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, u.root FROM link l JOIN up u ON l.conv_id = u.conv_id AND l.reply_to = u.turn),
placed AS (
  SELECT m.conv_id, m.turn, m.role, o.own, coalesce(l.n_quotes, 0) AS n_quotes, l.reply_to,
         row_number() OVER (PARTITION BY m.conv_id ORDER BY u.root, m.turn) - 1 AS position
  FROM msg m JOIN own o ON m.conv_id = o.conv_id AND m.turn = o.turn JOIN up u ON m.conv_id = u.conv_id AND m.turn = u.turn
  LEFT JOIN link l ON m.conv_id = l.conv_id AND m.turn = l.turn),
chat AS (
  SELECT conv_id, CAST(position // {block} AS INTEGER) AS block, CAST(count(*) AS INTEGER) AS n_messages,
         CAST(sum(n_quotes) AS INTEGER) AS n_quotes, CAST(count(reply_to) AS INTEGER) AS n_replies,
         string_agg(turn::VARCHAR, ',' ORDER BY position) AS turns,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || own || '<|end|>' || chr(10), '' ORDER BY position) AS chat
  FROM placed GROUP BY ALL)
SELECT conv_id, block, n_messages, n_quotes, n_replies, turns, CAST(length(chat) AS INTEGER) AS chat_chars,
       md5(chat) AS chat_md5
FROM chat
"""
