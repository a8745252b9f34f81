"""Quality rules on DataFrame functions: statistics of a text, and lines that many documents of a host share.

Lines are normalised (A-Z lower-cased, white space to one blank, trimmed) and hashed; every
document counts a line once; a line is boilerplate if more than ``MIN_DOCUMENTS`` documents
and more than ``MAX_SHARE`` of its host's documents hold it. Such lines are removed: ``cleaned``
gives the texts without them, ``judge`` what that does to each document. A
document is depleted if less than ``MIN_LEFT`` of its words are left. ``documents`` has no
host, so ``source`` stands for it in the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.3

SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def normal(line: Column) -> Column:
    """A line as it is compared with others."""
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), SPACE, " "))


def with_repeated_words(own: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the words in a 3-word window that occurs twice or more.

    Windows are hashed with their place. After a sort, a window is repeated if a neighbour has
    its hash; the places that repeated windows cover are counted once each. A set of hashes
    shows first, without a sort, whether there is any. Each step is a column of its own, as a
    lambda would compute an expression anew for every element.
    """
    n = F.col("n")
    own = own.withColumn(
        "windows",
        F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        )),
    )
    own = own.withColumn(
        "places",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    own = own.withColumn(
        "repeated",
        F.transform(
            F.filter(
                "places",
                lambda p, k: F.get("places", k - 1)["h"].eqNullSafe(p["h"]) | F.get("places", k + 1)["h"].eqNullSafe(p["h"]),
            ),
            lambda p: p["i"],
        ),
    )
    covered = F.array_distinct(F.flatten(F.transform("repeated", lambda i: F.array(i, i + 1, i + 2))))
    return own.withColumn("n_repeat_words", F.coalesce(F.size(covered).cast("long"), F.lit(0).cast("long")))


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, base statistics, and the lines as ``lines: array<struct<h, words>>``, and ``text``.

    A null text has no words. A null host is a host of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"), F.col("text").cast("string").alias("own_text"))
    own = own.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    own = with_repeated_words(own.withColumns({"n": F.size("words"), "lines": lines}))

    hashed = F.transform(
        "lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.size(words_of(x)).cast("long").alias("words"))
    )
    return own.select(
        "doc_id", "host",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        hashed.alias("lines"),
        F.col("own_text").alias("text"),
    )


def _judged(docs: DataFrame, host: str, min_documents: int, max_share: float, min_left: float, texts: bool) -> DataFrame:
    """Statistics, verdict and, with ``texts``, the text without boilerplate lines, of every row."""
    own = statistics(docs, host)
    own = stored((own if texts else own.drop("text")).withColumn("row", F.expr("uuid()")), "lines")
    per_line = (
        own.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") > min_documents)
    )
    per_host = own.groupBy("host").agg(F.count("*").alias("all"))
    # at most 1 / max_share lines' worth of documents each: few rows, spread for hot hosts and lines
    common = (
        per_line.join(per_host.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("documents") > max_share * F.col("all"))
        .select(F.xxhash64(F.coalesce("host", F.lit("\0")), "h").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    )
    removed = (
        own.select("row", "host", F.explode("lines").alias("line"))
        .select(
            "row",
            F.xxhash64(F.coalesce("host", F.lit("\0")), "line.h").alias("key"),
            F.pmod(F.hash("row"), F.lit(32)).alias("salt"),
            F.col("line.words").alias("words"),
            F.col("line.h").alias("h"),
        )
        .join(common, ["key", "salt"])
        .groupBy("row")
        .agg(F.sum("words").alias("n_line_words"), *[F.collect_set("h").alias("common")] * texts)
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    judged = (
        own.drop("lines")
        .join(removed, "row", "left")
        .withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    )
    rest = []
    if texts:
        kept_lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("common", F.xxhash64(normal(x))))
        rest = [F.when(F.col("common").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")).alias("text")]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (left >= min_left * F.col("n_words"))).alias("kept"),
        "n_line_words",
        *rest,
    )


def judge(
    docs: DataFrame,
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Statistics and verdict of every document.

    ``n_line_words`` counts the words in lines that are boilerplate on the document's host, which
    ``cleaned`` removes. A document without words is base_failed. Rows with the same or a null
    ``doc_id`` are judged each on its own. An empty table gives an empty one.
    """
    return _judged(docs, host, min_documents, max_share, min_left, False)


def cleaned(
    docs: DataFrame,
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The columns of ``judge`` and ``text`` without the lines that are boilerplate on the document's host.

    Every row is given, kept or not. All other lines stay as they are, blank ones too; a text
    without boilerplate lines is unchanged, and a null text stays null.
    """
    return _judged(docs, host, min_documents, max_share, min_left, True)


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT i, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS g
  FROM (SELECT i, words, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) >= 3)),
r AS (SELECT i, count(DISTINCT p) AS n_repeat_words FROM
  (SELECT i, unnest([k, k + 1, k + 2]) AS p FROM t JOIN (SELECT i, g FROM t GROUP BY ALL HAVING count(*) > 1) USING (i, g)) GROUP BY i),
l AS (SELECT i, host, unnest(lines) AS line FROM w),
m AS (SELECT i, host, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '{space}', ' ', 'g'), ' ') AS line,
  len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
c AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT i) AS n FROM m GROUP BY ALL)
  JOIN (SELECT host, count(*) AS n_all FROM d GROUP BY ALL) USING (host) WHERE n > {MIN_DOCUMENTS} AND n > {MAX_SHARE} * n_all),
x AS (SELECT i, sum(words) AS n_line_words FROM m JOIN c USING (host, line) GROUP BY i),
s AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_line_words, 0) AS n_line_words FROM w LEFT JOIN r USING (i) LEFT JOIN x USING (i)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_line_words >= {MIN_LEFT} * n_words AS kept, n_line_words::BIGINT AS n_line_words FROM b"""
