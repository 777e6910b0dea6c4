"""URL filter: rules per host, and a tree of path templates per host, DataFrame functions only.

The tree grows from the root, one path segment a step. A segment that too few urls share becomes a
wildcard of its shape (a number, a word). Branches of one node whose labelled share of bad pages
does not differ from that of their siblings (two-proportion test) are merged into one wildcard.
A node stops where no test could tell its branches apart: all its labels are equal, or so few that
even a perfect split is within chance. What follows in its paths is one wildcard tail. So a tree
is as deep as its labels differ, and only rows of open nodes go on to the next segment.
A template is rejected by its share of bad pages, smoothed towards its host's, and that towards
the share of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_URLS = 20  # urls that share a segment, for it to stand by itself
DIFFERENT = 1.96  # standard errors by which a branch differs from its siblings
WEIGHT = 5.0  # labelled pages that the share above counts for
REJECT = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path in one string) that fits, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        below = (host == own) | F.endswith(host, F.lit("." + own))
        fits.append(F.when(below & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _shape(segment: Column) -> Column:
    return F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), "{n}").otherwise("{s}")


def path_templates(
    pages: DataFrame, min_urls: int = MIN_URLS, different: float = DIFFERENT
) -> DataFrame:
    """Add `template` to rows of (host, path, bad); bad is 1, 0 or null where there is no label.

    Rows are counted per host, node and segment before anything is shuffled. The tables joined
    back hold one row per node or branch, not per url.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("_segments", segments).withColumn("template", F.lit(""))
    rows = materialise(rows, "templates")
    closed, level = [], 0
    while True:
        # of n labels, k bad, a perfect split lies sqrt(n) standard errors apart
        node = rows.groupBy("host", "template").agg(
            F.count("bad").alias("_all_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_all_k")
        )
        mixed = (F.col("_all_k") > 0) & (F.col("_all_k") < F.col("_all_n"))
        node = materialise(node.where(mixed & (F.col("_all_n") >= different**2)), "nodes")
        left = F.when(F.size("_segments") > level, "/**").otherwise("")
        ended = rows.join(node, ["host", "template"], "left_anti")
        closed.append(ended.withColumn("template", F.concat("template", left)))
        if node.isEmpty():
            return reduce(DataFrame.unionByName, closed).drop("_segments")
        rows = rows.join(node.select("host", "template"), ["host", "template"], "left_semi")
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        often = (
            rows.where("_segment IS NOT NULL")
            .groupBy("host", "template", "_segment")
            .agg(F.count("*").alias("_urls"))
            .where(F.col("_urls") >= min_urls)
            .drop("_urls")
            .withColumn("_literal", F.lit(True))
        )
        rows = rows.join(often, ["host", "template", "_segment"], "left").withColumn(
            "_branch",
            F.when(F.col("_segment").isNull(), "$")
            .when(F.col("_literal"), F.col("_segment"))
            .otherwise(_shape(F.col("_segment"))),
        )
        branch = rows.groupBy("host", "template", "_branch").agg(
            F.count("bad").alias("_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_k")
        )
        rest_n, rest_k = F.col("_all_n") - F.col("_n"), F.col("_all_k") - F.col("_k")
        pooled = F.try_divide(F.col("_all_k"), F.col("_all_n"))
        spread = pooled * (1 - pooled) * (1 / F.nullif("_n", F.lit(0)) + 1 / F.nullif(rest_n, F.lit(0)))
        apart = F.abs(F.try_divide(F.col("_k"), F.col("_n")) - F.try_divide(rest_k, rest_n))
        alike = F.coalesce((spread <= 0) | (apart < different * F.sqrt(spread)), F.lit(True))
        merged = branch.join(node, ["host", "template"]).select(
            "host", "template", "_branch",
            F.when(F.col("_branch") == "$", "$").when(alike, "*").otherwise(F.col("_branch")).alias("_name"),
        )
        moved = (
            rows.join(merged, ["host", "template", "_branch"])
            .withColumn("template", F.concat("template", F.lit("/"), "_name"))
            .withColumn("_ended", F.col("_name") == "$")
            .drop("_segment", "_literal", "_branch", "_name")
        )
        moved = materialise(moved, "templates")
        closed.append(moved.where("_ended").drop("_ended"))
        rows, level = moved.where("NOT _ended").drop("_ended"), level + 1


def template_purity(rows: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(host, template, purity): smoothed share of bad pages per template."""
    template = rows.groupBy("host", "template").agg(
        F.count("bad").alias("_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_k")
    )
    host = template.groupBy("host").agg(F.sum("_n").alias("_hn"), F.sum("_k").alias("_hk"))
    every = host.agg(F.coalesce(F.try_divide(F.sum("_hk"), F.sum("_hn")), F.lit(0.0)).alias("_share"))
    share = every.first()["_share"]  # one number
    prior = (F.col("_hk") + weight * share) / (F.col("_hn") + weight)
    purity = (F.col("_k") + weight * prior) / (F.col("_n") + weight)
    return template.join(host, "host").select("host", "template", purity.alias("purity"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: dict[str, str],
    reject: float = REJECT,
    **options,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of `pages`.

    `pages` has page_id and url, `labels` page_id and bad (0 or 1; of several the largest counts).
    `rules` maps host/path prefixes to verdicts; the longest that fits decides, otherwise the
    template's purity. A null url, or one without `://`, has an empty host and path and belongs to
    the template of the empty path. Repeated rows are judged one by one; a page_id without label
    counts for the shape of the tree only; without any label everything is allowed. Further
    columns are ignored. An empty table gives no rows. Paths of any depth are told apart as far
    as their labels differ.
    """
    marked = labels.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = path_templates(rows.join(marked, "page_id", "left"), **options)
    rows = rows.join(template_purity(rows), ["host", "template"])
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    of_rule = reduce(
        lambda c, r: c.when(F.col("rule") == r, rules[r]), sorted(rules), F.when(F.lit(False), "")
    )
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(of_rule, own).alias("verdict"), "template", "purity"
    )
