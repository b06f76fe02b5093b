"""Operator 2: URL filtering by association rules.

An url becomes a set of tokens: parts of its host's labels, path segments (numbers as one token), file extension, query parameters, fragment. Labelled pages (the number
that ends the url's path names the labelled document) are transactions; FP-growth finds the token sets that at least ``support`` of them carry, and those whose pages are
bad (quality 0 or toxic 1) with at least ``confidence`` and at least ``lift`` times as often as all labelled pages become rules. A rule that has a
subset with the same confidence or more among the rules is pruned. What such pruning would drop isn't mined at all, so that long urls don't make a set of each of their subsets: a
token of bad pages only is a rule by itself and in no other one, tokens too rare among bad pages are in none, and tokens of exactly the same labelled pages are mined as one and then
stand for each other in the rules. Every page is matched through an inverted index from a rule's rarest token to the rule.

Result: a row per distinct (page_id, url): n_rows, blocked, and the matching rule of most confidence (ties: more support, then its tokens).
Nulls and empty urls have no tokens and are never blocked. A page with two labels is bad if either says so. Empty tables and missing labels give no rules, and every page
is kept. Columns other than page_id and url (doc_id, quality, toxic of the labels) are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.scratch import load, written

SUPPORT = 20
CONFIDENCE = 0.5
LIFT = 1.5
BAD = "class:bad"
BROADCAST_RULES = 20_000


def url_tokens(url: Column) -> Column:
    """The distinct tokens of an url, sorted."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"#(.+)$", 1)
    some = lambda xs, prefix: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    segments = F.transform(F.split(F.regexp_replace(path, r"\.[a-z0-9]{1,5}$", ""), "/"), lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("#")).otherwise(s))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                some(F.split(host, r"[.\-]"), "host:"),
                some(segments, "path:"),
                some(F.array(F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)), "ext:"),
                some(F.split(query, "&"), "query:"),
                some(F.array(fragment), "fragment:"),
            )
        )
    )


def labelled_document(url: Column) -> Column:
    """The number that ends the url's path, which names the labelled document."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/(?:[^?#]*/)?([0-9]{1,18})(?:\.[a-zA-Z0-9]+)?/?(?:[?#].*)?$", 1).try_cast("long")


def mine(pages: DataFrame, labels: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule, tokens, key, support, confidence, lift): token sets of bad pages; key is the rarest token."""
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    schema = "rule string, tokens array<string>, key string, support long, confidence double, lift double"
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(bad.alias("_bad"))
    # keys are kept rather than urls: labels and pages are joined on two numbers and a short array
    seen = pages.select("page_id", "url").distinct().select(F.xxhash64("page_id", "url").alias("_id"), labelled_document(F.col("url")).alias("_doc"), url_tokens(F.col("url")).alias("tokens"))
    baskets = written(seen.join(known, "_doc").select("_id", "tokens", "_bad"), "baskets")
    total = baskets.agg(F.count("*").alias("n"), F.sum("_bad").alias("bad")).first()
    if not total["n"] or not total["bad"] or total["n"] / total["bad"] < lift:
        return spark.createDataFrame([], schema)
    base = total["bad"] / total["n"]
    each = baskets.select("_id", "_bad", F.explode("tokens").alias("token"))
    pages_of = [F.bit_xor("_id").alias("x"), F.bit_xor(F.xxhash64("_id", F.lit(1))).alias("y")]
    single = written(each.groupBy("token").agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"), *pages_of).where(F.col("bad") >= support), "tokens")
    sure = single.where("bad = n").select(F.array("token").alias("tokens"), F.col("bad").alias("support"), F.lit(1.0).alias("confidence"))
    mixed = single.where("bad < n").groupBy("n", "bad", "x", "y").agg(F.min("token").alias("token"), F.sort_array(F.collect_list("token")).alias("same")).select("token", "same")
    mixed = written(mixed, "classes")
    reduced = written(each.join(mixed.select("token"), "token").groupBy("_id", "_bad").agg(F.collect_list("token").alias("tokens")).select("tokens", "_bad"), "reduced")
    rest = reduced.count()
    rules = sure
    if rest:
        items = reduced.select(F.when(F.col("_bad") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
        # FPGrowth multiplies by the count and rounds up: half a basket less gives support itself, whatever the floating point does
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (support - 0.5) / rest)), minConfidence=confidence).fit(items)
        found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
        tokens = F.array_sort("antecedent")
        found = found.select(F.array_join(tokens, " ").alias("rule"), tokens.alias("tokens"), F.round(F.col("support") * rest).cast("long").alias("support"), "confidence")
        found = written(keyed(found.where(F.col("confidence") / base >= lift), single), "rules")
        # a rule goes if another one inside it is as sure
        inner = found.select(F.col("rule").alias("_r"), F.col("tokens").alias("_t"), "key", F.col("confidence").alias("_c"))
        outer = found.select("rule", "tokens", "confidence", F.explode("tokens").alias("key"))
        covered = outer.join(inner, "key").where((F.col("rule") != F.col("_r")) & (F.col("_c") >= F.col("confidence")) & (F.size(F.array_except("_t", "tokens")) == 0))
        left = found.join(covered.select("rule").distinct(), "rule", "left_anti")
        classes = left.select("rule", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("rule").agg(F.collect_list("same").alias("_s"))
        ways = F.aggregate("_s", F.array(F.array().cast("array<string>")), lambda done, same: F.flatten(F.transform(done, lambda x: F.transform(same, lambda t: F.array_append(x, t)))))
        rules = rules.union(left.join(classes, "rule").select(F.explode(ways).alias("tokens"), "support", "confidence"))
    rules = rules.select(F.array_join(F.array_sort("tokens"), " ").alias("rule"), F.array_sort("tokens").alias("tokens"), "support", "confidence", (F.col("confidence") / base).alias("lift"))
    return written(keyed(rules, single).select("rule", "tokens", "key", "support", "confidence", "lift"), "rules").where((F.col("lift") >= lift) & (F.col("confidence") >= confidence))


def keyed(rules: DataFrame, single: DataFrame) -> DataFrame:
    """rules with the rarest of each one's tokens as key."""
    rarest = rules.select("rule", F.explode("tokens").alias("token")).join(single.select("token", "n"), "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("k"))
    return rules.join(rarest.select("rule", F.col("k.token").alias("key")), "rule")


def apply(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per distinct (page_id, url); see the module."""
    distinct = pages.groupBy(F.col("page_id").cast("long").alias("page_id"), "url").agg(F.count("*").alias("n_rows"))
    index = rules.select("key", "rule", F.col("tokens").alias("_t"), "support", "confidence")
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    probes = distinct.withColumn("tokens", url_tokens(F.col("url"))).select("*", F.explode_outer("tokens").alias("key"))
    hit = F.size(F.array_except("_t", "tokens")) == 0
    best = F.max(F.when(hit & F.col("rule").isNotNull(), F.struct("confidence", "support", "rule")))
    matched = probes.join(index, "key", "left").groupBy("page_id", "url", "n_rows").agg(best.alias("b"))
    return matched.select("page_id", "url", "n_rows", F.col("b").isNotNull().alias("blocked"), "b.rule", "b.support", "b.confidence")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the rules of all labelled pages."""
    pages = load(spark, sf_dir, "pages")
    return apply(pages, mine(pages, load(spark, sf_dir, "labels")))


QUERIES = {"op2_url_rules": op2_url_rules}
SQL: dict[str, str] = {}
