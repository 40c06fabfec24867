"""Operator 4: verdicts on web addresses by rules and by a tree of path templates.

Paths are cut into segments and counted in a tree for each host. From the top down,
each node decides how its children generalise:

* a child value becomes a branch of its own if it has enough pages and its labelled share of bad pages differs more than
  chance from the rest of the node, otherwise it becomes a wildcard (``*``);
* branches that lie on the same side of the rest are put in order of their shares, ties by value, and
  neighbours that do not differ more than chance are merged. A merged branch goes on as one node and is written as
  ``//`` and its smallest value, which no single segment can look like;
* chance is a two-proportion test with continuity correction, its bound raised for the number of children tested.

The levels go on until every path has ended. Below a node with too few pages for a branch, or with labels
all alike, no test can pass, so its paths end there with a wildcard for each further segment.

A template is the host and the generalised segments. Its purity is the share of bad pages among
its labelled ones, smoothed towards the share of all labelled pages (the base). A template is rejected if
its purity is ``LIFT`` times the base or more, or above one half, and above the base by more than chance: the excess is at
least ``CERTAIN`` standard errors, raised for the number of templates with labels. If labels were dealt
to pages at random, some template would be rejected wrongly with a chance below one in 700 (normal tail), so labels that do not go with
addresses reject nothing. Rules come first: a rule fits its host and all subdomains if the path starts with
the rule's path; the longest rule wins.

Only DataFrame operations are used. Counts are aggregates with a map-side combine, so a host
with a third of all pages costs one row for each distinct segment and task.

Null addresses and those without ``://`` have an empty host and path, fit no rule and form one template.
Repeated rows count as often as they occur. Labels may be
missing or null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navette.llm.common import null_safe_join, written

#: A literal child has so many pages.
LEAST_COUNT = 8
#: Standard errors by which a branch differs from its siblings, if it is the only one tested.
DIFFERENT = 2.0
#: Labelled pages the overall share counts for.
PRIOR = 8.0
#: A rejected template is so many times worse than the base, or mostly bad.
LIFT = 2.0
MOSTLY = 0.5
#: Standard errors above the base, if there were one template only.
CERTAIN = 3.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of an address; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Rules: host/path to block or allow."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=len):
        at = name.index("/")
        fits = ((host == name[:at]) | host.endswith("." + name[:at])) & path.startswith(name[at:])
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, rules[name]).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame) -> DataFrame:
    """Pages (page_id, host, path, bad) with their template, level by level of the tree."""
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    # one row for each host and path: pages that share it go the same way
    paths = pages.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    paths = written(paths.withColumn("steps", steps).withColumn("template", F.col("host")), "url-paths")
    ended, level = [], 0
    while True:
        ends = F.size("steps") <= level
        ended.append(paths.where(ends))
        paths = paths.where(~ends)
        if paths.isEmpty():
            break
        paths = written(_generalised(paths, level), f"url-level-{level}")
        level += 1
    return reduce(DataFrame.unionAll, ended).select("host", "path", "template", "n", "labelled", "bad")


def _generalised(paths: DataFrame, level: int) -> DataFrame:
    """Templates longer by one segment, or by all segments where no test can pass any more."""
    going = paths.withColumn("step", F.get("steps", F.lit(level)))
    children = going.groupBy("template", "step").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    tested = (F.col("n") >= LEAST_COUNT) & (F.col("labelled") > 0)
    nodes = children.groupBy("template").agg(
        F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
        F.count_if(tested).alias("tests"),
    )
    nodes = nodes.where((F.col("all_n") >= LEAST_COUNT) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled")))
    both = children.where(tested).join(nodes, "template")
    others, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    apart = _differ(F.col("bad"), F.col("labelled"), other_bad, others)
    above = F.col("bad") * others > other_bad * F.col("labelled")
    kept = both.where((others > 0) & apart).withColumn("above", above)
    branches = _merged(kept).withColumnRenamed("step", "__step")
    named = going.join(nodes.select("template", F.lit(True).alias("open")), "template", "left")
    named = named.join(branches.withColumnRenamed("template", "__node"), F.expr("template = __node AND step = __step"), "left")
    further = F.when(F.col("open"), F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
    grown = F.concat("template", further.otherwise(F.repeat(F.lit("/*"), F.size("steps") - level)))
    left = F.when(F.col("open"), F.col("steps")).otherwise(F.slice("steps", 1, level))
    return named.select("host", "path", "n", "labelled", "bad", left.alias("steps"), grown.alias("template"))


def _differ(bad: Column, labelled: Column, other_bad: Column, others: Column) -> Column:
    """Whether two labelled shares differ by more than chance, for ``tests`` tests in the node."""
    share = (bad + other_bad + 1) / (labelled + others + 2)
    inverse = 1 / labelled + 1 / F.greatest(others, F.lit(1))
    error = F.sqrt(share * (1 - share) * inverse)
    difference = F.abs(bad / labelled - other_bad / F.greatest(others, F.lit(1))) - inverse / 2
    # a normal tail shrinks by 1 / tests or more when the squared bound grows by 2 log(tests)
    return difference >= F.sqrt(DIFFERENT**2 + 2 * F.log(F.col("tests").cast("double"))) * error


def _merged(kept: DataFrame) -> DataFrame:
    """(template, step, branch): branches of a node that are alike get one name.

    Only children that passed a test come here, a small part of a node's; the window spills.
    """
    side = Window.partitionBy("template", "above").orderBy(F.col("bad") / F.col("labelled"), "step")
    new = F.coalesce(_differ(F.col("bad"), F.col("labelled"), F.lag("bad").over(side), F.lag("labelled").over(side)), F.lit(True))
    numbered = kept.withColumn("new", new.cast("int")).withColumn("place", F.sum("new").over(side))
    branch = Window.partitionBy("template", "above", "place")
    name = F.when(F.count("*").over(branch) > 1, F.concat(F.lit("/"), F.min("step").over(branch))).otherwise(F.col("step"))
    return numbered.select("template", "step", name.alias("branch"))


def verdicts(pages: DataFrame, labelled: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, host, path, rule, verdict, template and purity.

    ``labelled`` has page_id and label (1: bad) of some pages.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    labels = labelled.where("label is not null").groupBy(F.col("page_id").alias("__page")).agg(F.max("label").alias("bad"))
    pages = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    known = pages.join(labels, F.col("page_id") == F.col("__page"), "left").select("page_id", "host", "path", "bad")
    known = written(known, "url-pages")
    paths = written(templates(known), "url-templates")
    labelled_all, bad_all = paths.agg(F.sum("labelled"), F.sum("bad")).first()
    base = (bad_all or 0) / labelled_all if labelled_all else 0.0
    rated = paths.groupBy("template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    rated = written(rated, "url-rated")
    tests = max(rated.where("labelled > 0").count(), 1)
    purity = (F.col("bad") + PRIOR * base) / (F.col("labelled") + PRIOR)
    error = math.sqrt(base * (1 - base)) / F.sqrt(F.col("labelled").cast("double"))
    # half a page for the step of a count
    excess = (F.col("bad") - 0.5) / F.col("labelled") - base
    certain = (F.col("labelled") > 0) & (excess >= math.sqrt(CERTAIN**2 + 2 * math.log(tests)) * error)
    rejected = certain & ((purity >= LIFT * base) | (purity > MOSTLY)) & (purity > base)
    rated = rated.select("template", purity.alias("purity"), F.coalesce(rejected, F.lit(False)).alias("rejected"))
    rated = paths.select("host", "path", "template").join(rated, "template")
    judged = null_safe_join(known.drop("bad"), rated, ["host", "path"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select(
        F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        "template", "purity",
    )
