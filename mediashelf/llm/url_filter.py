"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.llm.common import lower_ascii, small

PREFIX_HEX = 8  # hash prefix the join runs on: 4 bytes, as hexadecimal digits


def host_and_path(url):
    """``(host, path)``: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path from there up to ``?``, ``#`` or the end.  Both are empty if the URL is
    null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host, path):
    # the path starts with "/" or is empty, and a host holds none, so the two cannot be mixed up
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
) -> DataFrame:
    """Adds nothing to ``pages``' texts but ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` holds ``host, path, verdict``.  A rule fits its host and every subdomain, if the
    URL's path starts with the rule's path.  The longest rule wins: longest host, then longest
    path; of equal rules with different verdicts, ``block`` wins.  Where none fits, ``rule`` is
    null and ``verdict`` is ``default``.  Rules with a null host or path never fit.

    Each distinct ``(host, path)`` is expanded into its host suffixes of as many labels, and into
    its path prefixes of as many characters, as occur among the rules, so that a very long host
    costs no more than the longest rule.  Expressions meet rules on a short hash prefix; the full digest confirms them.
    Columns of ``pages`` named like the new ones are replaced.  An empty table gives an empty
    result; without rules every URL gets the default.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                     F.col("verdict").alias("r_verdict"))
        .where("r_host IS NOT NULL AND r_path IS NOT NULL")
        .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("key", F.substring("r_digest", 1, PREFIX_HEX))
    )
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    urls = pages.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    counts = sorted(r[0] for r in rules.select(F.size(F.split("r_host", r"\.")).alias("n")).distinct().collect())
    suffixes = F.filter(
        F.transform(F.array(*[F.lit(n) for n in counts or [1]]),
                    lambda n: F.when(F.size("labels") >= n, F.array_join(F.slice(
                        F.col("labels"), F.size("labels") - n + 1, n), "."))),
        lambda s: s.isNotNull(),
    )
    prefixes = F.filter(
        F.transform(F.array(*[F.lit(n) for n in lengths or [0]]),
                    lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))),
        lambda p: p.isNotNull(),
    )
    tried = (
        urls.withColumn("e_host", F.explode(suffixes))
        .withColumn("e_path", F.explode(prefixes))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("key", F.substring("e_digest", 1, PREFIX_HEX))
    )
    fits = tried.join(small(rules), "key").where("e_digest = r_digest")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("r_host"), F.length("r_path"), "r_verdict",
                       F.concat("r_host", "r_path").alias("rule"))).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"),
             F.col("best.r_verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
