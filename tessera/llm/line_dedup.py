"""Line dedup by content-defined line chunks, in DataFrame functions only.

A hash is rolled over the hashes of the lines that have words, WINDOW (two) of them and the blank lines between at a
time. A window is repeated if its hash occurs elsewhere, and a chunk is a run of overlapping repeated windows: its
boundaries are the places where the rolling hash turns from unknown to known, so they depend on the content near them
alone and shift with the text. Windows meet by a 128-bit hash and their bytes are then compared. Of each repeated window
the first occurrence (smallest doc_id, then text digest, then place) stays; the lines of the others go.

Boundaries where the rolling hash is 0 modulo a divisor miss the ends of a passage and most passages of a few lines,
since the chunks there run into the neighbours: with a divisor of 2 they found 15 % of the lines of repeated passages of
three lines and 57 % of those of twenty. Here every repeated passage of two lines with words or more goes whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skewed_left_join, table

#: A line with words as (place, two hashes of 64 bits); the second goes over an MD5, so that they fail together in one of 2^128 cases.
INKED = "filter(transform(lines, (l, i) -> if(l rlike '\\\\S', struct(i, xxhash64(l) as k1, xxhash64(md5(l), length(l)) as k2), null)), x -> x is not null)"
#: The window of two neighbouring lines with words: places a and b, and the rolling hashes p1 and p2 over the lines and the blank ones between.
BLANK = "array_join(slice(lines, x.i + 2, y.i - x.i - 1), '\\n')"
ROLLED = f"zip_with(slice(inked, 1, greatest(size(inked) - 1, 0)), slice(inked, 2, size(inked)), (x, y) -> struct(x.i as a, y.i as b, xxhash64(x.k1, y.i - x.i, {BLANK}, y.k1) as p1, xxhash64(y.k2, {BLANK}, x.k2) as p2))"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (the text's digest: with the id it names a row, so rows that repeat an id don't share places), lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.unhex(F.md5("text")).alias("row"), F.split("text", "\n").alias("lines"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, row, a, b, p1, p2, first: the windows that occur more than once, first where it is the occurrence that stays."""
    rows = _rows(docs).withColumn("inked", F.expr(INKED))
    windows = rows.select("doc_id", "row", F.explode_outer(F.expr(ROLLED)).alias("w")).where("w is not null").select("doc_id", "row", "w.*")  # outer: a filter inferred from explode would roll the hashes twice
    often = windows.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("doc_id", "row", "a")).alias("top")).where("held > 1")
    found = skewed_left_join(windows, materialize(often, "line-windows"), ["p1", "p2"], "held").where("held is not null")
    return found.select("doc_id", "row", "a", "b", "p1", "p2", F.struct("doc_id", "row", "a").eqNullSafe(F.col("top")).alias("first"))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, removed_lines, text without the repeated passages.

    Null text counts as empty: one empty line. A line goes if a window that holds it occurred before; the lines of a
    repeated window's first occurrence stay, so every window is left whole once (a line that fills a text is kept
    twice). A null doc_id sorts first. Rows that repeat both id and text are one occurrence: they keep or lose the same
    lines. Only doc_id and text are read, so other columns can't clash; ids are taken as longs.
    """
    spans = repeated_windows(docs).groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b", "p1", "p2", "first")).alias("spans"))
    spans = materialize(spans, "line-spans").withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    rows = _rows(docs)
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "lines", "spans")
    rows = materialize(rows, "line-texts")
    texts = rows.where("spans is not null").select(F.explode_outer(F.expr("transform(spans, s -> struct(s.p1, s.p2, array_join(slice(lines, s.a + 1, s.b - s.a + 1), '\n') as text))")).alias("w")).select("w.*")
    if texts.groupBy("p1", "p2", "text").agg(F.count(F.lit(1)).alias("held")).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").limit(1).count():
        raise ValueError("two windows have one 128-bit hash")
    places = lambda first: f"flatten(transform(filter(spans, s -> {first}), s -> sequence(s.a, s.b)))"
    rows = rows.withColumn("gone", F.expr(f"array_except({places('not s.first')}, {places('s.first')})"))
    rows = rows.withColumn("left", F.expr("if(gone is null, sequence(0, size(lines) - 1), array_except(sequence(0, size(lines) - 1), gone))"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("removed_lines"), F.expr("array_join(transform(left, i -> lines[i]), '\n')").alias("text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


#: The same rules over the texts of windows themselves, and places as (doc_id, MD5, line).
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, row, unnest(generate_series(0, len(lines) - 1)) AS i, unnest(lines) AS l FROM d
), k AS (
  SELECT rid, doc_id, row, i AS a, lead(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM l WHERE regexp_matches(l, '[^\t\n\x0B\f\r ]')
), w AS (
  SELECT k.rid, a, b, sha256(array_to_string(lines[a + 1:b + 1], chr(10))) AS t, k.doc_id, k.row FROM k JOIN d USING (rid) WHERE b IS NOT NULL
), f AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS held, rank() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, row, a) AS n FROM w
), g AS (
  SELECT rid, unnest(generate_series(a, b)) AS i, n > 1 AS later FROM f WHERE held > 1
), gone AS (
  SELECT rid, i FROM g GROUP BY rid, i HAVING bool_and(later)
), left_ AS (
  SELECT l.rid, count(*) AS n, string_agg(l.l, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON gone.rid = l.rid AND gone.i = l.i GROUP BY l.rid
)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, (len(d.lines) - coalesce(left_.n, 0))::BIGINT AS removed_lines, sha256(coalesce(left_.text, '')) AS text_sha256
FROM d LEFT JOIN left_ USING (rid)
"""
