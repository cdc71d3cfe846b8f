"""URL rules: a blocked Bloom filter of the listed URLs, then an exact join.

A rule is ``(host, path, verdict)``.  It fits its host and all subdomains when
the URL's path starts with the rule's path; the longest fitting rule (host and
path together, then host) wins.  For every (host suffix, path prefix) of a URL
whose shape (label count, path length) occurs in the list, the filter says
"not listed" or "perhaps"; only the latter reach the exact hash join, which
removes the filter's false positives.

Everything is DataFrame expressions; the filter itself is in ``bloom``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL.  Host: after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
    Both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def clean_rules(rules: DataFrame) -> DataFrame:
    """Distinct (host, path) with a verdict; rows with a null are no rules, and
    ``block`` wins if a pair is listed with several verdicts."""
    return (rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("verdict").alias("rule_verdict"))
            .where("rule_host is not null and rule_path is not null and rule_verdict is not null")
            .groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", bits_per_rule: int = 16, inline_bytes: int = 4 << 20,
               broadcast_rules: int = 50_000, salts: int = 16) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rule`` is host and path of the winning rule, null if none fits; then the verdict
    is ``default`` (an unlisted URL).  Every row is judged: repeated rows stay,
    a null URL has empty host and path and no rule, extra columns are ignored, no rules or no
    pages give no verdicts but the default or no rows.

    The rules are counted first.  Up to ``inline_bytes`` the filter is one
    value in the plan, beyond it is joined by block number; up to
    ``broadcast_rules`` rules are broadcast for the exact join, beyond they are dealt by
    key and salt, so that a rule that fits a third of all URLs spreads over ``salts`` tasks.
    """
    rules = clean_rules(rules)
    n_rules = rules.count()
    n = bloom.n_blocks(n_rules, bits_per_rule)
    keyed = rules.select(_key(F.col("rule_host"), F.col("rule_path")).alias("key"))
    # (label count, path length) pairs of the list: bounded by what fits in a URL, whatever the list's size
    shapes = (rules.select(F.struct(F.size(F.split("rule_host", "[.]")).alias("labels"),
                                    F.length("rule_path").alias("chars")).alias("s"))
              .agg(F.array_sort(F.collect_set("s")).alias("shapes")))

    host, path = canonical(F.col(url_col))
    listed = (pages.select(F.col(url_col).alias("u")).where("u is not null").distinct()
              .withColumn("h", canonical(F.col("u"))[0]).withColumn("p", canonical(F.col("u"))[1])
              .withColumn("labels", F.split("h", "[.]"))
              .withColumn("shapes", shapes.scalar()))
    probes = F.transform(
        F.filter("shapes", lambda s: (s["labels"] <= F.size("labels")) & (s["chars"] <= F.length("p"))),
        lambda s: F.struct(F.array_join(F.slice("labels", F.size("labels") - s["labels"] + 1, s["labels"]), ".").alias("host"),
                           F.substring(F.col("p"), F.lit(1), s["chars"]).alias("path")))
    key = lambda x: _key(x["host"], x["path"])
    if n * bloom.BLOCK_BYTES <= inline_bytes:
        hits = (listed.withColumn("bloom", bloom.inline(keyed, "key", n))
                .withColumn("probe", F.explode(F.filter(probes, lambda x: bloom.perhaps_in("bloom", key(x), n)))))
    else:
        hits = (listed.withColumn("probe", F.explode(probes))
                .withColumn("block", bloom.block(key(F.col("probe")), n)).join(bloom.blocks(keyed, "key", n), "block")
                .where(bloom.perhaps(F.col("words"), key(F.col("probe")))))
    hits = hits.select("u", F.col("probe.host").alias("rule_host"), F.col("probe.path").alias("rule_path"))
    if n_rules <= broadcast_rules:
        fits = hits.join(F.broadcast(rules), ["rule_host", "rule_path"])
    else:
        dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        fits = (hits.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
                .join(dealt, ["rule_host", "rule_path", "salt"]))
    won = (fits.groupBy("u").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("nh"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("w")))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"))
    return (judged.join(won, "u", "left")
            .select("page_id", canonical(F.col("u"))[0].alias("host"), canonical(F.col("u"))[1].alias("path"),
                    F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict")))

