"""Chat formatting by quotation linking, in DataFrame functions only.

Lines of a message open with any number of '>' marks, its quote level. A run of lines with words of one level is a
passage: its lines are normalised (marks and outer white space off, inner white space to one space, lower case) and
joined, so that a quote may be wrapped anew. Hashed are the passage as a whole, its sentences and its lines; of a quote,
parts of three words or more. A quoted passage is joined to the latest earlier messages of its conversation that have it, whole or in parts,
one level further out: level 1 to a message that says it, level 2 to one that quotes it at level 1, and so on; if none
does, to one that says it. A message replies to the message that most words of its quotes of the lowest linked level come
from, the latest if several; without a link it opens a thread of its own. Conversations are returned thread by thread, in
the order of the threads' first turns, with quotes and their attribution lines removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, partitions, table

MARKS = r"^[\\t\\x0B\\f\\r ]*((?:>[\\t\\x0B\\f\\r ]?)+)"
ATTRIBUTION = r"(?i)\\b(wrote|writes|schrieb|escribió|a écrit)[\\t\\x0B\\f\\r ]*:[\\t\\x0B\\f\\r ]*$"
BLANKS = r"[\\t\\n\\x0B\\f\\r ]+"
SENTENCE = r"[^.!?]*[^.!? ][^.!?]*[.!?]*"
#: Words of a part of a quoted passage that is looked up by itself.
PART_WORDS = 3
UNIT = ["conv_id", "depth", "h", "m"]


def _lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own: the lines as (level, said)."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.split(text, "\n").alias("raw"))
    line = f"struct(length(regexp_replace(regexp_extract(l, '{MARKS}', 1), '[^>]', '')) as level, regexp_replace(l, '{MARKS}', '') as said)"
    return rows.withColumn("own", F.expr(f"transform(raw, l -> {line})")).drop("raw")


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (without quotes), n_quoted, max_level."""
    body = f"array_join(transform(filter(own, (o, i) -> o.level = 0 and not (o.said rlike '{ATTRIBUTION}' and i + 1 < size(own) and own[i + 1].level > 0)), o -> o.said), '\\n')"
    return _lines(messages).select(
        "conv_id", "turn", "role",
        F.regexp_replace(F.expr(body), r"^\n+|\n+$", "").alias("body"),
        F.expr("size(filter(own, o -> o.level > 0))").cast("long").alias("n_quoted"),
        F.expr("array_max(transform(own, o -> o.level))").cast("long").alias("max_level"),
    )


def units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (digest), n (its words), h, m, whole, words: the passages of the conversations that quote at all, whole and in parts."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[\t\x0B\f ]*>")).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    norm = f"lower(trim(regexp_replace(o.said, '{BLANKS}', ' ')))"
    rows = _lines(messages).join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.expr(f"transform(own, o -> struct(o.level as level, {norm} as norm))").alias("own"))
    edge = lambda at: f"filter(sequence(0, size(own) - 1), i -> own[i].norm <> '' and ({at}))"
    rows = rows.withColumn("starts", F.expr(edge("i = 0 or own[i - 1].norm = '' or own[i - 1].level <> own[i].level")))
    rows = rows.withColumn("ends", F.expr(edge("i = size(own) - 1 or own[i + 1].norm = '' or own[i + 1].level <> own[i].level")))
    rows = rows.select("conv_id", "turn", F.explode_outer(F.expr("zip_with(starts, ends, (s, e) -> struct(own[s].level as level, transform(slice(own, s + 1, e - s + 1), o -> o.norm) as lines))")).alias("p")).where("p is not null")
    rows = rows.select("conv_id", "turn", "p.level", "p.lines", F.array_join("p.lines", " ").alias("text"))
    parts = f"array_distinct(filter(concat(transform(regexp_extract_all(text, '{SENTENCE}', 0), x -> trim(x)), lines), x -> x <> text))"
    # what goes over the whole passage is computed before its parts become rows
    rows = rows.select("conv_id", "turn", "level", F.md5("text").alias("passage"), F.size(F.split("text", " ")).alias("n"), F.expr(f"concat(array(struct(text as u, true as whole)), transform({parts}, x -> struct(x as u, false as whole)))").alias("us"))
    # outer: else a filter on the array's size is inferred, which computes the array twice, and the text for each part
    rows = rows.select("conv_id", "turn", "level", "passage", "n", F.explode_outer("us").alias("x"))
    return rows.select("conv_id", "turn", "level", "passage", "n", F.xxhash64("x.u").alias("h"), F.md5("x.u").alias("m"), "x.whole", F.size(F.split("x.u", " ")).alias("words")).distinct()


def _latest_before(rows: DataFrame) -> DataFrame:
    """rows (UNIT, turn, said) with source: the last earlier turn that says the unit. A unit of any number of rows is dealt to many tasks by ranges of turns; what each range says last is carried on to the next."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *UNIT, "turn", "said").withColumn("_task", F.spark_partition_id())
    dealt = materialize(dealt, "quote-units")
    saying = F.when(F.col("said"), F.col("turn"))
    # of one turn, what it quotes comes before what it says, so a message never quotes itself
    near = Window.partitionBy(*UNIT, "_task").orderBy("turn", "said").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*UNIT, "_task").agg(F.max(saying).alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*UNIT).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    return dealt.withColumn("_near", F.max(saying).over(near)).join(tops, [*UNIT, "_task"]).withColumn("source", F.greatest("_near", "_before")).drop("_near", "_before", "_task")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message that each quoting message replies to; and n_linked, its passages that were found."""
    every = materialize(units(messages), "quote-passages")
    asked = every.where(f"level > 0 and (whole or words >= {PART_WORDS})")
    direct = asked.withColumn("depth", F.col("level")).withColumn("direct", F.lit(True))
    asked = direct.unionByName(asked.where("level > 1").withColumn("depth", F.lit(1)).withColumn("direct", F.lit(False)))
    said = every.withColumn("depth", F.col("level") + 1).join(asked.select(*UNIT).distinct(), UNIT, "left_semi").select(*UNIT, "turn").distinct()
    both = said.withColumn("said", F.lit(True)).unionByName(asked.select(*UNIT, "turn").distinct().withColumn("said", F.lit(False)))
    found = _latest_before(both).where("not said and source < turn").select(*UNIT, "turn", "source")
    hits = asked.join(found, [*UNIT, "turn"]).groupBy("conv_id", "turn", "level", "passage", "n", "direct", "source").agg(F.max("whole").alias("whole"), F.sum("words").alias("words"))
    best = hits.groupBy("conv_id", "turn", "level", "passage", "n").agg(F.max(F.struct("direct", "whole", "words", "source")).alias("b"))
    votes = best.groupBy("conv_id", "turn", "level", F.col("b.source").alias("source")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "source")).alias("best"), F.sum("held").alias("n_linked")).select("conv_id", "turn", F.col("best.source").alias("parent"), "n_linked")


def threads(linked: DataFrame) -> DataFrame:
    """conv_id, turn, root of every linked message: parents of parents by doubling, as many rounds as the logarithm of the longest chain."""
    now = materialize(linked.select("conv_id", "turn", F.col("parent").alias("root")), "quote-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        step = materialize(now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "quote-roots")
        moved = step.where("moved").limit(1).count()
        now = step.drop("moved")
        if not moved:
            return now


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with position: the 1-based place of a row in its conversation by (root_turn, turn). A conversation of any length is dealt to many tasks by ranges, not to one."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), "conv_id", "root_turn", "turn", "role", "body_sha256").sortWithinPartitions("conv_id", "root_turn", "turn", "role", "body_sha256")
    dealt = materialize(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "quote-order")
    parts = dealt.groupBy("conv_id", "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).withColumnRenamed("conv_id", "_conv").withColumnRenamed("_task", "_part")
    out = dealt.join(parts.drop("_held"), dealt.conv_id.eqNullSafe(parts._conv) & (dealt._task == parts._part))
    return out.withColumn("position", F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_conv", "_part", "_task", "_row", "_first", "_before")


def reply_order(messages: DataFrame) -> DataFrame:
    """Per row of messages (conv_id, turn, role, text): conv_id, turn, role, body, position, parent_turn, root_turn, n_quoted, n_linked, max_level.

    n_quoted counts quoted lines, n_linked quoted passages that were found. Null text counts as empty; a message with a
    null conv_id or turn is linked with nothing and its root_turn is its turn. Rows that repeat (conv_id, turn) each have
    their body and share links found for the turn; ties in position go by role and the body's digest. Ids are taken as
    longs. Other columns are not read, so names can't clash.
    """
    parsed = parse(messages)
    linked = materialize(links(messages), "quote-links")
    roots = threads(linked).withColumnRenamed("root", "root_turn")
    found = linked.join(roots, ["conv_id", "turn"])
    rows = parsed.join(found, ["conv_id", "turn"], "left")
    rows = rows.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("n_linked", F.coalesce("n_linked", F.lit(0))).withColumn("body_sha256", F.sha2("body", 256)).withColumnRenamed("parent", "parent_turn")
    return _numbered(rows)


OUT = ["conv_id", "turn", "role", "position", "parent_turn", "root_turn", "n_quoted", "n_linked", "max_level", "body_sha256"]


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations")).select(OUT)


def quoting_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations made from those of the table so that they quote: earlier turns whole, wrapped anew, nested, at level 2 alone, and their first words only. The table itself has no quotes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("p1", F.lag("text", 1, "nothing before").over(order)).withColumn("p2", F.lag("text", 2, "nothing at all before").over(order))
    quote = lambda c, mark: F.concat(F.lit(mark + " "), F.regexp_replace(c, "\n", "\n" + mark + " "))
    wrapped = F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace("p1", "\n", " "), r"([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ", "$1\n> "))
    made = F.element_at(F.array(
        F.col("text"), F.concat(F.lit("On Monday you wrote:\n"), quote("p1", ">"), F.lit("\n"), "text"), F.concat(wrapped, F.lit("\n\n"), "text"),
        F.concat(quote("p1", ">"), F.lit("\n"), quote("p2", ">>"), F.lit("\n"), "text"), F.concat(quote("p2", ">>"), F.lit("\n"), "text"),
        F.concat(F.lit("> "), F.regexp_extract("p2", "^[^ ]* [^ ]* [^ ]*", 0), F.lit("\n"), "text"),
    ), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    return reply_order(rows.select("conv_id", "turn", "role", made.alias("text"))).select(OUT)


#: The quoting rules in SQL; units are looked up by their text.
RULES = r"""raw AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM talk
), ln AS (
  SELECT rid, conv_id, turn, role, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS l FROM raw
), lv AS (
  SELECT rid, conv_id, turn, role, i, length(regexp_replace(regexp_extract(l, '^[\t\x0B\f\r ]*((?:>[\t\x0B\f\r ]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(l, '^[\t\x0B\f\r ]*((?:>[\t\x0B\f\r ]?)+)', '') AS said FROM ln
), nx AS (
  SELECT *, lower(trim(regexp_replace(said, '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS norm, lead(level) OVER (PARTITION BY rid ORDER BY i) AS after FROM lv
), msg AS (
  SELECT rid, conv_id, turn, role,
    regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (regexp_matches(said, '(?i)\b(wrote|writes|schrieb|escribió|a écrit)[\t\x0B\f\r ]*:[\t\x0B\f\r ]*$') AND coalesce(after, 0) > 0)), ''), '^\n+|\n+$', '', 'g') AS body,
    count(*) FILTER (WHERE level > 0) AS n_quoted, max(level)::BIGINT AS max_level
  FROM nx GROUP BY rid, conv_id, turn, role
), st AS (
  SELECT *, CASE WHEN lag(norm) OVER r = '' OR lag(level) OVER r <> level OR lag(level) OVER r IS NULL THEN 1 ELSE 0 END AS opens FROM nx WINDOW r AS (PARTITION BY rid ORDER BY i)
), pn AS (
  SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS pid FROM st
), pa AS (
  SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) AS p, list(norm ORDER BY i) AS lines FROM pn WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, level, pid
), un AS (
  SELECT DISTINCT conv_id, turn, level, p, u, u = p AS whole, len(string_split(u, ' ')) AS words FROM (
    SELECT conv_id, turn, level, p, unnest(list_concat([p], list_filter(list_concat(list_transform(regexp_extract_all(p, '[^.!?]*[^.!? ][^.!?]*[.!?]*'), lambda x: trim(x)), lines), lambda x: x <> p))) AS u FROM pa)
), look AS (
  SELECT *, level AS depth, 1 AS direct FROM un WHERE level > 0 AND (whole OR words >= 3) UNION ALL SELECT *, 1, 0 FROM un WHERE level > 1 AND (whole OR words >= 3)
), hit AS (
  SELECT q.conv_id, q.turn, q.level, q.p, q.u, q.whole, q.words, q.direct, max(s.turn) AS source FROM look q JOIN un s ON s.conv_id = q.conv_id AND s.u = q.u AND s.level + 1 = q.depth AND s.turn < q.turn GROUP BY ALL
), ph AS (
  SELECT conv_id, turn, level, p, direct, source, bool_or(whole) AS whole, sum(words) AS words FROM hit GROUP BY ALL
), be AS (
  SELECT *, len(string_split(p, ' ')) AS n FROM ph QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level, p ORDER BY direct DESC, whole DESC, words DESC, source DESC) = 1
), votes AS (
  SELECT conv_id, turn, level, source, sum(n) AS n, count(*) AS held FROM be GROUP BY ALL
), lk AS (
  SELECT conv_id, turn, source AS parent, n_linked FROM (SELECT *, sum(held) OVER (PARTITION BY conv_id, turn)::BIGINT AS n_linked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) AS k FROM votes) WHERE k = 1
), up(conv_id, turn, root) AS (
  SELECT conv_id, turn, parent FROM lk UNION ALL SELECT up.conv_id, up.turn, lk.parent FROM up JOIN lk ON lk.conv_id = up.conv_id AND lk.turn = up.root
), rt AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(rt.root, m.turn), m.turn, m.role, sha256(m.body)) AS position,
  lk.parent AS parent_turn, coalesce(rt.root, m.turn) AS root_turn, m.n_quoted, coalesce(lk.n_linked, 0) AS n_linked, m.max_level, sha256(m.body) AS body_sha256
FROM msg m LEFT JOIN lk ON lk.conv_id = m.conv_id AND lk.turn = m.turn LEFT JOIN rt ON rt.conv_id = m.conv_id AND rt.turn = m.turn
"""
SQL = "WITH RECURSIVE talk AS (SELECT conv_id, turn, role, text FROM conversations), " + RULES
QUOTING_SQL = r"""WITH RECURSIVE before AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, ''), 1, 'nothing before') OVER o AS p1, lag(coalesce(text, ''), 2, 'nothing at all before') OVER o AS p2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), talk AS (
  SELECT conv_id, turn, role, CASE (conv_id + turn) % 6 WHEN 0 THEN text
    WHEN 1 THEN 'On Monday you wrote:' || chr(10) || '> ' || replace(p1, chr(10), chr(10) || '> ') || chr(10) || text
    WHEN 2 THEN '> ' || regexp_replace(replace(p1, chr(10), ' '), '([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ', '\1' || chr(10) || '> ', 'g') || chr(10) || chr(10) || text
    WHEN 3 THEN '> ' || replace(p1, chr(10), chr(10) || '> ') || chr(10) || '>> ' || replace(p2, chr(10), chr(10) || '>> ') || chr(10) || text
    WHEN 4 THEN '>> ' || replace(p2, chr(10), chr(10) || '>> ') || chr(10) || text
    ELSE '> ' || regexp_extract(p2, '^[^ ]* [^ ]* [^ ]*') || chr(10) || text END AS text FROM before
), """ + RULES
