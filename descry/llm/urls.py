"""URL filters: rules, and a tree of path templates per host for what no rule decides.

Paths become templates level by level. Segments with digits are variable by their form. Of the others, a branch is merged
into the wildcard of its parent if it is statistically like the rest of its siblings: by the share of labelled urls, the
share of blocked ones among these, and the share of urls that end there (Hoeffding bounds, each branch against the pool of
its siblings, so the work is linear in the branches). The verdicts of the rules are the labels. A template is rejected if
the share of blocked urls among its labelled ones, smoothed towards the share over all hosts, reaches a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    """Applies to a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    """``risk`` of taking like branches for different, ``purity`` for rejection, ``prior`` labels' worth of smoothing.

    Templates are as deep as the paths.
    """

    risk: float = 0.05
    purity: float = 0.8
    prior: float = 4.0


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url column; both empty for null and where there is no ``://``."""
    text, mark = F.coalesce(F.col(url), F.lit("")), F.locate("://", F.coalesce(F.col(url), F.lit("")))
    after = F.when(mark > 0, F.substring(text, mark + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the columns host and path; null where none does."""
    def first(value):
        whens = None
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
            whens = F.when(fits, value(rule)) if whens is None else whens.when(fits, value(rule))
        return whens if whens is not None else F.lit(None).cast("string")

    return first(lambda r: F.lit(r.text)), first(lambda r: F.lit(r.verdict))


def _unlike(settings: TreeSettings, k: str, n: str) -> Column:
    """Whether the share k/n of a branch differs from that of the pool of its siblings."""
    other_k, other_n = F.col(f"all_{k}") - F.col(k), F.col(f"all_{n}") - F.col(n)
    scale = F.sqrt(F.lit(0.5) * F.log(F.lit(2.0 / settings.risk)))
    bound = scale * (1 / F.sqrt(F.col(n)) + 1 / F.sqrt(other_n))
    return F.coalesce((F.col(n) > 0) & (other_n > 0) & (F.abs(F.col(k) / F.nullif(F.col(n), F.lit(0)) - other_k / F.nullif(other_n, F.lit(0))) > bound), F.lit(False))


def template_tree(shapes: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, segments, template, p): the template of every path shape and its smoothed share of blocked urls.

    Templates grow from the host down, all shapes of a template at a time, until every shape has ended. Each round takes what
    they share and one segment in which they differ, so the rounds are as many as the branchings on the way to a shape.

    ``shapes`` has host, segments, n, labelled and blocked, one row per host and segments.
    """
    share = float(shapes.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).first()[0])
    counts, names = ["n", "labelled", "blocked", "ends"], ["host", "segments", "n", "labelled", "blocked", "template"]
    tree, done = shapes.withColumn("template", F.lit("")).withColumn("at", F.lit(0)), []
    rest = lambda: F.slice("segments", F.col("at") + 1, F.size("segments"))
    while True:
        done.append(tree.where(F.size("segments") == F.col("at")).select(names))
        tree = tree.where(F.size("segments") > F.col("at"))
        if tree.isEmpty():
            break
        # What all shapes of a template share is taken in one step: the common start of the least and the greatest rest.
        ends = tree.groupBy("host", "template").agg(F.min(rest()).alias("least"), F.max(rest()).alias("greatest"))
        differ = F.array_position(F.zip_with("least", "greatest", lambda a, b: F.coalesce(a == b, F.lit(False))), False).cast("int")
        shared = F.when(differ == 0, F.col("least")).otherwise(F.slice("least", F.lit(1), differ - 1))
        tree = tree.join(ends.select("host", "template", shared.alias("shared")), ["host", "template"])
        tree = tree.withColumn("at", F.col("at") + F.size("shared")).withColumn("template", F.concat("template", F.array_join(F.transform("shared", lambda s: F.concat(F.lit("/"), s)), "")))
        tree = tree.withColumn("branch", F.get("segments", F.col("at"))).withColumn("ends", F.when(F.size("segments") == F.col("at") + 1, F.col("n")).otherwise(0))
        branches = tree.where("branch IS NOT NULL").groupBy("host", "template", "branch").agg(*[F.sum(c).alias(c) for c in counts])
        pools = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in counts], F.count("*").alias("siblings"))
        own = reduce(lambda a, b: a | b, [_unlike(settings, "labelled", "n"), _unlike(settings, "blocked", "labelled"), _unlike(settings, "ends", "n")])
        variable = F.col("branch").contains(WILDCARD)
        named = branches.join(pools, ["host", "template"]).withColumn(
            "name", F.when(variable, F.col("branch")).when((F.col("siblings") == 1) | own, F.col("branch")).otherwise(WILDCARD))
        tree = tree.join(named.select("host", "template", "branch", "name"), ["host", "template", "branch"], "left")
        tree = tree.withColumn("at", F.when(F.col("name").isNull(), F.col("at")).otherwise(F.col("at") + 1))
        tree = tree.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
        tree = written(tree.select(*names, "at"), "tree")
    tree = reduce(DataFrame.unionByName, done)
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    purity = sums.withColumn("p", F.when(F.col("l") > 0, (F.col("b") + settings.prior * share) / (F.col("l") + settings.prior))).drop("l", "b")
    return tree.join(purity, ["host", "template"]).select("host", "segments", "template", "p")


def judge_urls(pages: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, p): one row per page, in no order.

    ``verdict`` is that of the longest fitting rule, else ``block`` for a rejected template and ``allow`` otherwise. A template
    without a labelled url has no purity (``p`` is null) and is not rejected.
    Null urls and urls without ``://`` have empty host and path; they form a template of their own. Without any label
    nothing is rejected. Repeated rows and null page_ids are judged like any other; other columns are ignored.
    """
    host, path = host_and_path()
    rule, verdict = matching_rule(rules)
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(F.replace(s, F.lit(WILDCARD), F.lit("%2A")), "[0-9]+", WILDCARD))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"), segments.alias("segments"))
    shapes = judged.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = template_tree(written(shapes, "shapes"), settings)
    by_method = F.when(F.col("p") >= settings.purity, "block").otherwise("allow")
    return judged.join(tree, ["host", "segments"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "p")
