"""URL filters: rule lookup by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each distinct URL is expanded into (host suffix, path prefix) expressions, an equi-join on a short hash prefix finds the
rules that may fit, the full digest confirms them, and the longest confirmed rule gives the verdict.

Only expressions that a rule could equal are made: host suffixes with as many labels, and path prefixes with as many
characters, as some rule has. So a very long URL makes no more expressions than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.plans.staging import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: host, path (starting with ``/``), verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains if the URL's path starts with the rule's. Of the fitting rules the longest (host and path together) wins;
    then the one with the longer host, then ``block``. Where none fits, ``rule`` is null and ``verdict`` is ``default``.

    Null and malformed URLs have an empty host and path and get the default. Each input row gives one output row, so
    repeated rows and rows with equal URLs all stay. Very long URLs are judged whole. Columns of ``urls`` named like an output are replaced by it.
    Rules with a null or empty host, or a null path, fit nothing. No rules: everything gets the default.
    """
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in urls.columns if c not in made]
    rules = (
        rules.where("coalesce(host, '') <> '' and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
        .groupBy("digest", "rule", F.length("host").alias("host_length"))
        .agg(F.max("verdict").alias("rule_verdict"), F.first(F.size(F.split("host", r"\."))).alias("labels"), F.first(F.length("path")).alias("path_length"))
        .withColumn("prefix", F.substring("digest", 1, prefix_hex))
    )
    # At most as many numbers as the longest rule has characters.
    shapes = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    parsed = urls.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    parsed = parsed.withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    if shapes["n"]:
        label_counts, lengths = F.array(*[F.lit(x) for x in sorted(shapes["labels"])]), F.array(*[F.lit(x) for x in sorted(shapes["lengths"])])
        names = F.split("_host", r"\.")
        suffixes = F.transform(F.filter(label_counts, lambda n: n <= F.size(names)), lambda n: F.array_join(F.slice(names, -n, n), "."))
        prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
        asked = (
            parsed.where("_host <> ''")
            .select("_url", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
            .select("_url", "_suffix", F.explode("_prefixes").alias("_start"))
            .select("_url", _digest(F.col("_suffix"), F.col("_start")).alias("_digest"))
            .withColumn("_short", F.substring("_digest", 1, prefix_hex))
        )
        side = F.broadcast(rules) if shapes["n"] <= BROADCAST_RULES else rules
        hits = asked.join(side, F.col("_short") == F.col("prefix")).where("_digest = digest")
        best = hits.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("l"), F.col("host_length"), F.col("rule_verdict"), F.col("rule"))).alias("_best"))
    else:
        best = parsed.select("_url").where(F.lit(False)).withColumn("_best", F.lit(None).cast("struct<rule_verdict:string,rule:string>"))
    # Written before the join, so that rows of a very common URL are split over tasks; the input's columns travel in one struct.
    hit = materialize(best.select("_url", F.col("_best.rule").alias("_rule"), F.col("_best.rule_verdict").alias("_verdict")))
    own = urls.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(url_col).alias("_own")) if kept else urls.select(F.col(url_col).alias("_own"))
    joined = own.join(hit, F.col("_own") == F.col("_url"), "left")
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        url_host(F.col("_own")).alias("host"),
        url_path(F.col("_own")).alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)
