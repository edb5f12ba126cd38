"""Quality rules with the cross-document frequency of lines. DataFrame functions only.

Lines are normalised (lower case, digits as one 0, white space as one space) and hashed; each host's lines are counted by
the distinct documents that have them. Lines in more than ``MANY`` documents of the host are removed, and a document is
rejected if fewer than ``REMAIN`` of its words remain. Base rules on single documents come first. ``judged`` has the numbers of the
removed lines of each document, ``cleaned`` the documents that are kept, without these lines.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, fresh, met, read

#: A line is one too many if more documents of its host have it than this number, however large the host is.
MANY, REMAIN = 30, 0.5
#: The most frequent lines that are broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000
_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _metrics(docs: DataFrame, host: str, row: Column) -> DataFrame:
    """One row for each of ``docs`` with its base metrics and the hash, words and number (from 0) of each line with a word."""
    rows = docs.select("doc_id", row.alias("row"), F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"w": F.array_remove(F.split("text", _GAP), ""), "lines": F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(_WORD)))})
    numbers = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.rlike(x, F.lit(_WORD)), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "grams": F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")),
        "lines": F.zip_with("lines", numbers, _line),
    })
    rows = rows.drop("w", "text").withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:long,i:int>>")))
    same = F.expr("filter(placed, (x, i) -> (i > 0 and placed[i - 1].g = x.g) or (i < size(placed) - 1 and placed[i + 1].g = x.g))")
    rows = rows.drop("grams").withColumn("again", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.expr("aggregate(transform(again, (p, i) -> if(i < size(again) - 1, least(3, again[i + 1] - p), 3)), 0, (a, x) -> a + x)")
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("placed", "again")


def _line(line: Column, number: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _GAP, " ")
    return F.struct(F.xxhash64(F.trim(plain)).alias("h"), F.regexp_count(line, F.lit(_WORD)).alias("n"), number.alias("at"))


def quality_rules(docs: DataFrame, host: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words for each row of ``docs`` (doc_id, text, host).

    Null texts have no words and fail. A null host is a host of its own. Rows that repeat a doc_id count as one document of
    their host, rows with a null doc_id as one each, and each row gets its result. Other columns are not looked at, whatever
    their names. An empty table gives an empty result.
    """
    return judged(docs, host, broadcast_rows).drop("removed_lines")


def judged(docs: DataFrame, host: str = "source", broadcast_rows: int = BROADCAST_ROWS, row: str | None = None) -> DataFrame:
    """The rows of ``quality_rules`` with removed_lines, the rising numbers (from 0) of a text's \\n-split lines that are removed; and the column ``row``,
    which numbers ``docs``, if there is one."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = cut(_metrics(docs, host, number).withColumn("host", F.coalesce(F.col("host").cast("string"), F.lit("\0"))))
    held = rows.select("host", F.col("doc_id").alias("d"), F.when(F.col("doc_id").isNull(), F.col("row")).alias("r"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    count = held.distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    often = cut(count.where(F.col("n") > MANY).select("host", "h"))
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n", "x.at")
    gone = met(lines, often, ["host", "h"], "row", broadcast_rows, "left_semi")
    gone = gone.groupBy("row").agg(F.sum("n").cast("long").alias("gone"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    out = rows.drop("lines").join(gone, "row", "left").withColumns({"gone": F.coalesce("gone", F.lit(0)).cast("long"), "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>"))})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("gone") >= REMAIN * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.col("gone").alias("n_removed_words"), "removed_lines", *([] if row is None else [F.col("row").alias(row)]))


def cleaned(docs: DataFrame, host: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; the removed lines are gone from the text, all others stay as they are."""
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = judged(rows, host, broadcast_rows, row).where("kept").select(row, F.col("removed_lines").alias(f"{row}_lines"))
    lines, gone = F.split("text", "\n"), F.col(f"{row}_lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    return rows.join(found, row).withColumn("text", F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col("text"))).select(docs.columns)


def query(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
  FROM (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
repeats AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM grams WHERE n > 1) GROUP BY r),
line AS (
  SELECT r, doc_id, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT r, doc_id, host, unnest(lines) AS x FROM d)),
often AS (SELECT host, h FROM line GROUP BY host, h HAVING count(DISTINCT doc_id) > 30),
gone AS (SELECT r, sum(n) AS n FROM line JOIN often USING (host, h) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
SELECT *, base_failed = false AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""
