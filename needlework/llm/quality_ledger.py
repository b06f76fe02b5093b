"""Operator 7: rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule, and is stored so, in the shared folder. Policies are versioned masks
that are applied to the stored bits (``applied``): a document is kept under a policy iff ``fail_bits & mask = 0``, so a new policy never touches the texts again. Ablations (what
each rule removes, what only it removes, what a policy without it would keep) come from bitwise aggregation over the stored bits, for any policy.

``op7_quality_ledger`` evaluates and stores; ``quality_ablation`` reads what it stored in this session for the same files, and evaluates only where there is nothing. The pipeline
stores a ledger of its own, which carries the rows.

Words are maximal runs of bytes above 0x20. The toxicity rule counts words that begin, in lower case, with an entry of a lexicon mined from the labels: beginnings of six
and of eight characters (and shorter words whole) that at least ``max(5, 0.5 %)`` of the different toxic labelled texts have, and of whose labelled texts at least 80 % are
toxic. Two such words fail. The lexicon is mined from a sample of at most ``LABELLED`` labelled documents, so its size is bounded by that support
(an average toxic document's distinct beginnings times 200), whatever the corpus. Up to ``EXPRESSION`` entries are one regular expression, more a set that each word is looked up
in; both count the same.

Nulls and empty texts have 0 words and fail ``empty`` only. A null doc_id is carried. Repeated rows each get their ledger row. Columns other than doc_id and
text are ignored. Empty tables give an empty ledger; without labels the lexicon is empty and the toxicity rule never fails.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.scratch import load, shared_path, written

#: name, measurement, failing condition; the bit of a rule is its place here
RULES = [
    ("empty", "n_words", "n_words = 0"),
    ("symbols", "symbol_ratio", "symbol_ratio > 0.02"),
    ("shouting", "upper_ratio", "upper_ratio > 0.6 AND n_words >= 8"),
    ("adjacent_repeats", "adjacent_ratio", "adjacent_ratio > 0.15 AND n_words >= 8"),
    ("few_distinct", "distinct_ratio", "distinct_ratio < 0.2 AND n_words >= 50"),
    ("tables", "pipe_ratio", "pipe_ratio > 0.1 AND n_words >= 5"),
    ("long_words", "mean_word", "mean_word > 40"),
    ("toxic", "toxic_words", "toxic_words >= 2"),
]
MEASURES = ["n_words", *dict.fromkeys(m for _, m, _ in RULES if m != "n_words")]
BIT = {name: 1 << i for i, (name, _, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[x] for x in names)


POLICIES = {
    "v1": mask("empty", "symbols", "shouting", "adjacent_repeats", "few_distinct", "tables", "long_words"),
    "v2": mask("empty", "symbols", "shouting", "adjacent_repeats", "few_distinct", "tables", "long_words", "toxic"),
}
CURRENT = "v2"
#: entries of the lexicon in one regular expression at most
EXPRESSION = 20_000
#: characters of the beginnings that are mined
STARTS = (6, 8)
#: labelled documents that the lexicon is mined from at most, the first by hash of their doc_id
LABELLED = 20_000


def lexicon(labels: DataFrame, documents: DataFrame, most: int = LABELLED) -> list[str]:
    """Beginnings of words that give away toxic documents, from at most ``most`` labelled documents; see the module."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    # at most ``most`` rows of two numbers
    labelled = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    labelled = labelled.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))
    starts = F.array_distinct(F.flatten(F.transform(words(F.lower("text")), lambda w: F.array(*[F.substring(w, 1, k) for k in STARTS]))))
    prefixes = labelled.select("toxic", F.explode(starts).alias("prefix")).where("length(prefix) >= 4")
    n = labelled.agg(F.sum("toxic")).first()[0] or 0
    found = prefixes.groupBy("prefix").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("t") >= max(5, 0.005 * n)) & (F.col("t") >= 0.8 * F.col("n")))
    # bounded by the sample: each entry takes five texts of it at least
    return sorted(r["prefix"] for r in found.select("prefix").toLocalIterator())


def words(text: Column) -> Column:
    """Words of the text; none for null and empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x20]+"), lambda w: w != "")


def kept(docs: DataFrame, toxic: list[str], policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, from a stored ledger that carries them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    book = written(measured(docs.select(row, "text"), toxic, "_row"), "ledger")
    return book.where(passes(POLICIES[policy])).select("_row.*")


def passes(policy: int) -> Column:
    """Whether a row of a ledger fails no rule of the mask."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy)) == 0


def applied(book: DataFrame, policies: dict[str, int] | None = None, current: str = CURRENT) -> DataFrame:
    """A stored ledger and, for each policy, keep_<version>; keep is the current policy. Reads the bits alone, so that policies may be newer than the ledger."""
    policies = POLICIES if policies is None else policies
    return book.select("*", *[passes(m).alias(f"keep_{version}") for version, m in policies.items()], passes(policies[current]).alias("keep"))


def ledger(docs: DataFrame, toxic: list[str]) -> DataFrame:
    """The measurements, fail_bits and verdicts of docs without storing them."""
    return applied(measured(docs, toxic))


def measured(docs: DataFrame, toxic: list[str], carried: str = "doc_id") -> DataFrame:
    """doc_id (or what else is carried), the measurements and fail_bits: what a ledger stores."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(carried), text.alias("_text")).withColumn("_w", words(F.col("_text")))
    n = F.size("_w")
    chars = F.length("_text")

    def dropped(pattern: str) -> Column:
        return chars - F.length(F.translate("_text", pattern, ""))

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    pairs = F.zip_with(F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    adjacent = F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(pairs, lambda x: x)))
    measures = base.select(
        carried,
        n.cast("long").alias("n_words"),
        F.round(dropped("#$%&*!|") / F.greatest(chars, F.lit(1)), 6).alias("symbol_ratio"),
        F.round(dropped(upper) / F.greatest(dropped(upper + lower), F.lit(1)), 6).alias("upper_ratio"),
        F.round(adjacent / F.greatest(n, F.lit(1)), 6).alias("adjacent_ratio"),
        F.round(F.size(F.array_distinct("_w")) / F.greatest(n, F.lit(1)), 6).alias("distinct_ratio"),
        F.round(dropped("|") / F.greatest(n, F.lit(1)), 6).alias("pipe_ratio"),
        F.round(chars / F.greatest(n, F.lit(1)), 6).alias("mean_word"),
        toxic_count(F.lower("_text"), toxic).cast("long").alias("toxic_words"),
    )
    bits = F.lit(0)
    for name, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measures.withColumn("fail_bits", bits.cast("long"))


def toxic_count(text: Column, toxic: list[str]) -> Column:
    """Words that begin with an entry of the lexicon; one of another length than STARTS is a whole word."""
    if not toxic:
        return F.lit(0)
    if len(toxic) > EXPRESSION:
        return looked_up(toxic)(text)
    tree: dict = {}
    for x in toxic:
        at = tree
        for c in x:
            at = at.setdefault(c, {})
        at[""] = "" if len(x) in STARTS else r"(?![^\x00-\x20])"
    first = "".join(re.escape(c) for c in sorted(tree))
    return F.regexp_count(text, F.lit(rf"(?<![^\x00-\x20])(?=[{first}]){branches(tree)}"))


def looked_up(toxic: list[str]):
    """The same count through a set."""
    entries, split = frozenset(toxic), re.compile(r"[\x00-\x20]+")

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(any(w[:k] in entries for k in STARTS) for w in split.split(t) if w)).astype("int64")

    return F.pandas_udf(count, "long")


def branches(tree: dict) -> str:
    """A regular expression for the entries below a node, common beginnings written once."""
    ways = [re.escape(c) + branches(below) for c, below in sorted(tree.items()) if c]
    if "" in tree:
        if not tree[""]:
            return ""
        ways.append(tree[""])
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def ablation(book: DataFrame, policy: str | int = CURRENT) -> DataFrame:
    """For each rule of the policy (a version or a mask): documents that fail it, documents that fail no other rule of it, and what is kept with and without the rule."""
    m = POLICIES[policy] if isinstance(policy, str) else policy
    by_bits = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame([(name, BIT[name]) for name, _, _ in RULES if BIT[name] & m], "rule string, bit long")
    failing = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        by_bits.crossJoin(F.broadcast(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(failing, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_only"),
            F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(F.col("bits").isin(0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


#: where this session stored the ledger of a folder, and of which files: {(application, folder): (files, path, schema)}
_STORED: dict = {}


def files_of(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells whether documents and labels are still the files that they were: how many, and their names, sizes and times in one number."""
    found = []
    for table in ("documents", "labels"):
        files = load(spark, sf_dir, table).select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
        found += files.agg(F.count("*"), F.bit_xor("h")).first()
    return tuple(found)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate every rule on every document, once, and store the ledger."""
    files, docs = files_of(spark, sf_dir), load(spark, sf_dir, "documents")
    book = measured(docs, lexicon(load(spark, sf_dir, "labels"), docs))
    path = shared_path(spark, "ledger")
    book.write.option("compression", "zstd").parquet(path)
    _STORED[spark.sparkContext.applicationId, sf_dir] = files, path, book.schema
    return spark.read.schema(book.schema).parquet(path)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger that this session stored for these very files; it is stored now where there is none."""
    files, path, schema = _STORED.get((spark.sparkContext.applicationId, sf_dir), (None, None, None))
    if path is None or files != files_of(spark, sf_dir):
        return store(spark, sf_dir)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        # the shared folder was cleared
        return store(spark, sf_dir)


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies applied to the ledger of all documents, as stored."""
    return applied(store(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy removes, from the stored ledger."""
    return ablation(stored(spark, sf_dir))


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ledger_ctes(table: str) -> str:
    """CTEs that end in ``ledger``; table has doc_id and text."""
    split = "list_filter(regexp_split_to_array({}, '[\\x00-\\x20]+'), lambda w: w <> '')"
    gone = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    bits = " | ".join(f"CASE WHEN {fails} THEN {BIT[name]} ELSE 0 END" for name, _, fails in RULES)
    keeps = ", ".join(f"(fail_bits & {m}) = 0 AS keep_{v}" for v, m in POLICIES.items())
    return f"""
lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(toxic) IS NOT NULL
  ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {LABELLED}),
labelled AS (SELECT max(toxic) AS toxic, coalesce(text, '') AS t FROM documents JOIN lab USING (doc_id) GROUP BY 2),
pre AS (SELECT toxic, unnest(list_distinct(flatten(list_transform({split.format("lower(t)")}, lambda w: [{", ".join(f"w[1:{k}]" for k in STARTS)}])))) AS prefix FROM labelled),
lex AS (SELECT prefix FROM pre WHERE length(prefix) >= 4 GROUP BY prefix
  HAVING sum(toxic) >= greatest(5, 0.005 * (SELECT sum(toxic) FROM labelled)) AND sum(toxic) >= 0.8 * count(*)),
lexlist AS (SELECT coalesce(list(prefix), []) AS bad FROM lex),
base AS (SELECT doc_id, coalesce(text, '') AS t, {split.format("coalesce(text, '')")} AS w, {split.format("lower(coalesce(text, ''))")} AS lw FROM {table}),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  round({gone("#$%&*!|")} / greatest(length(t), 1), 6) AS symbol_ratio,
  round({gone(_UP)} / greatest({gone(_UP + _UP.lower())}, 1), 6) AS upper_ratio,
  round(coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN w[i] = w[i - 1] THEN 1 ELSE 0 END)), 0) / greatest(len(w), 1), 6) AS adjacent_ratio,
  round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS distinct_ratio,
  round({gone("|")} / greatest(len(w), 1), 6) AS pipe_ratio,
  round(length(t) / greatest(len(w), 1), 6) AS mean_word,
  CAST(len(list_filter(lw, lambda x: {" OR ".join(f"list_contains(bad, x[1:{k}])" for k in STARTS)})) AS BIGINT) AS toxic_words
  FROM base, lexlist),
bitted AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM measured),
ledger AS (SELECT *, {keeps}, (fail_bits & {POLICIES[CURRENT]}) = 0 AS keep FROM bitted)"""


SQL = {
    "op7_quality_ledger": f"WITH {ledger_ctes('documents')} SELECT * FROM ledger",
    "quality_ablation": f"""WITH {ledger_ctes("documents")}, by_bits AS (SELECT fail_bits & {POLICIES[CURRENT]} AS bits, count(*) AS n FROM ledger GROUP BY 1),
rules(rule, bit) AS (VALUES {", ".join(f"('{n}', {BIT[n]})" for n, _, _ in RULES if BIT[n] & POLICIES[CURRENT])})
SELECT rule, CAST(sum(CASE WHEN bits & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS fails, CAST(sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS BIGINT) AS fails_only,
  CAST(sum(CASE WHEN bits = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bits = 0 OR bits = bit THEN n ELSE 0 END) AS BIGINT) AS kept_without
FROM by_bits, rules GROUP BY rule""",
}
QUERIES = {"op7_quality_ledger": op7_quality_ledger, "quality_ablation": quality_ablation}
