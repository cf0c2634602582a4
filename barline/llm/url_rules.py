"""URL filters: association rules of URL tokens, mined by FP-growth, matched by inverted index.

All of it is DataFrame operations and Spark's own (JVM) FP-growth. Tokens of a
URL: its host, each label of it, path segments with numbers as one token, file
ending, and query keys. From labelled URLs, frequent token sets with the label
``!bad`` give rules ``tokens -> !bad``; rules below the confidence, the lift or
the support go, those whose hits chance explains given how many token sets were tried, and
so do rules that a shorter kept rule contains. Matching
explodes a URL's tokens, joins the rules' tokens and counts: a rule fits where
all its tokens were found.

Defined results: null URLs and those without ``://`` have empty host and path,
no tokens, and are allowed unless a fixed rule fits; without labels there are no
mined rules.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import ASCII_LOWER, ASCII_UPPER

BAD = "!bad"


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_column(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def token_column(url: Column) -> Column:
    """Distinct tokens of a URL (see module)."""
    host, path = host_column(url), path_column(url)
    low = F.translate(path, ASCII_UPPER, ASCII_LOWER)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(low, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    ending = F.transform(F.filter(F.array(F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("e:"), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    whole = F.transform(F.filter(F.array(host), lambda x: x != ""), lambda x: F.concat(F.lit("H:"), x))
    return F.array_distinct(F.concat(whole, labels, segments, ending, keys))


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.5, min_lift: float = 2.0, max_tokens: int = 3, min_rows: int = 5, error: float = 0.05) -> DataFrame:
    """Rules (rule_id, tokens, support, confidence, lift) from url and label (1 is bad).

    FP-growth is distributed, so all labelled rows may come. It counts token sets; the confidence of
    a set is the count with the label over the count without it. A rule's hits must lie so many
    deviations above those of its share of bad rows that none of all sets tried would by chance, but
    with probability ``error`` (a normal tail is below exp(-z*z/2)).
    """
    items = labelled.select(token_column(F.col("url")).alias("tokens"), (F.col("label") == 1).alias("bad")).where(F.size("tokens") > 0)
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    empty = "rule_id bigint, tokens array<string>, support double, confidence double, lift double"
    if not total["n"] or not total["bad"]:
        return labelled.sparkSession.createDataFrame([], empty)
    n, share = total["n"], total["bad"] / total["n"]
    baskets = items.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    support = max(min_support, min_rows / n)
    frequent = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = frequent.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq")
    tried = sets.where(F.size("tokens").between(1, max_tokens)).groupBy("tokens").agg(F.max(F.when(F.col("bad"), F.col("freq"))).alias("hits"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("rows"))
    chance = math.sqrt(2 * math.log(max(1, tried.count()) / error))
    above = F.col("hits") - F.col("rows") * share
    rules = (
        tried.where(F.col("hits").isNotNull() & (above >= chance * F.sqrt(F.col("rows") * share * (1 - share))))
        .select("tokens", (F.col("hits") / n).alias("support"), (F.col("hits") / F.col("rows")).alias("confidence"))
        .withColumn("lift", F.col("confidence") / share)
        .where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
        .withColumn("rule_id", F.xxhash64("tokens"))
    )
    # A rule that holds all tokens of a shorter one adds nothing to a verdict: found by the same inverted index.
    longer = rules.select(F.col("rule_id").alias("long_id"), F.size("tokens").alias("long_size"), F.explode("tokens").alias("token"))
    shorter = rules.select(F.col("rule_id").alias("short_id"), F.size("tokens").alias("short_size"), F.explode("tokens").alias("token"))
    implied = longer.join(shorter, "token").where("short_size < long_size").groupBy("long_id", "short_id", "short_size").count().where("count = short_size").select(F.col("long_id").alias("rule_id")).distinct()
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "tokens", "support", "confidence", "lift")


def match_rules(urls: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """key, rule_id: each rule that fits the URL of a row; ``key`` values must be distinct rows' ids."""
    index = rules.select("rule_id", F.size("tokens").alias("needs"), F.explode("tokens").alias("token"))
    found = urls.select(key, F.explode(token_column(F.col(url))).alias("token")).join(index, "token")
    return found.groupBy(key, "rule_id").agg(F.count("*").alias("found"), F.first("needs").alias("needs")).where("found = needs").select(key, "rule_id")


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule of (``host/path``, verdict); null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, mined_rules (number of mined rules that fit) for every row.

    Distinct URLs are matched once, so copies of a page cost nothing more.
    """
    rows = pages.select(id_column, F.col("url").cast("string").alias("url"))
    distinct = rows.select("url").where(F.col("url").isNotNull()).distinct()
    hits = match_rules(distinct, mined, "url").groupBy("url").agg(F.count("*").alias("mined_rules"))
    host, path = host_column(F.col("url")), path_column(F.col("url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.join(hits, "url", "left")
        .withColumn("host", host)
        .withColumn("path", path)
        .select(id_column, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("mined_rules", F.lit(0)).alias("mined_rules"))
    )
