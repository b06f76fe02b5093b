"""Operator 6: suffix-array dedup of passages.

A passage is 50 words in a row (words: runs of bytes above 0x20) that aren't all the same word. Wherever a passage occurs again, in another document or later in the
same one, all occurrences but the one with the least (doc_id, hash of the text, place) are covered; covered words go, each with the blanks after it. The
suffix order behind it is made in blocks with a difference cover (see repeats and cover_suffixes).

Nulls and texts of fewer than 50 words are never covered; a null text stays null. A null doc_id sorts before all others. Rows that agree in doc_id and text are one
document given twice, and are treated alike. Texts of any length are searched whole. A document whose words all go is dropped by ``dedup``. Empty
tables give empty results. Columns other than doc_id and text are carried by ``dedup`` (n_chars, where present, is counted anew) and ignored by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.repeats import repeats
from needlework.llm.scratch import load

WINDOW = 50
NULL_KEY = -(2**63)


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Covered stretches: doc_id, start_word, end_word (exclusive), and the text's hash as tid."""
    if window < 2:
        raise ValueError("a passage has two words at least")
    return repeats(keyed(docs).select("key", "tid", "text"), window)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))).withColumn("tid", F.xxhash64("text"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the covered words, and without the documents that had no others."""
    columns = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64("text").alias("tid"))
    cover = spans(docs, window).groupBy("key", "tid").agg(F.collect_list(F.struct("start", "stop")).alias("_cover"))
    joined = marked.join(cover, ["key", "tid"], "left").select("_row", "_cover")
    text = F.col("_row.text")
    units = F.regexp_extract_all(text, F.lit(r"([^\x00-\x20]+[\x00-\x20]*)"), F.lit(1))
    kept = F.filter(units, lambda _, i: ~F.exists("_cover", lambda c: (i >= c["start"]) & (i < c["stop"])))
    lead = F.regexp_extract(text, r"^([\x00-\x20]*)", 1)
    out = joined.withColumn("_kept", F.when(F.col("_cover").isNotNull(), F.concat(lead, F.array_join(kept, ""))))
    out = out.where("_cover IS NULL OR _kept RLIKE '[^\\\\x00-\\\\x20]'")
    new = F.when(F.col("_cover").isNull(), text).otherwise(F.col("_kept"))
    values = []
    for c in columns:
        old = F.col(f"_row.`{c}`")
        if c == "text":
            values.append(new.alias(c))
        elif c == "n_chars":
            values.append(F.when(F.col("_cover").isNull(), old).otherwise(F.length("_kept")).cast(docs.schema[c].dataType).alias(c))
        else:
            values.append(old.alias(c))
    return out.select(*values)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered stretches of all documents."""
    found = spans(load(spark, sf_dir, "documents"))
    return found.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"))


def windows_sql(table: str, window: int = WINDOW) -> str:
    """CTEs that end in ``cover`` (doc_id, start_word, end_word); table has doc_id and text."""
    return f"""
split AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x20]+'), lambda w: w <> '') AS w FROM {table}),
win AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + {window}], ' ')) AS h FROM
  (SELECT doc_id, w, unnest(range(0, len(w) - {window - 1})) AS p FROM split WHERE len(w) >= {window})
  WHERE len(list_distinct(w[p + 1:p + {window}])) > 1),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
fresh AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {window} THEN 0 ELSE 1 END AS f FROM later),
numbered AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM fresh),
cover AS (SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + {window} AS BIGINT) AS end_word FROM numbered GROUP BY doc_id, g)"""


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL = {"op6_suffix_dedup": f"WITH {windows_sql('documents')} SELECT * FROM cover"}
