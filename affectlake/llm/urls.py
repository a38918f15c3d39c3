"""URL filters: seed rules, and a path-template tree per host for the URLs they leave open.

A template is a host and its path segments, where variable segments are wildcards: runs
of digits and long hexadecimal runs by their form, and every segment at a depth where
the host has many distinct values.  The tree's nodes are the templates' prefixes, with
the counts of labelled URLs below them (URLs that a seed rule decides).  A branch whose
labels are statistically like its parent's is merged into the parent; a template belongs
to its deepest branch that is not.  A branch's purity is its share of allowed labels,
smoothed towards the share of all labels, and templates below THRESHOLD are rejected.

Everything is an aggregate or an equi-join over distinct templates; hosts and templates
that many URLs share are joined by broadcast, as bounded by ``join_hot``.

Defined results: a url that is null or lacks ``://`` has an empty host and path, fits no
rule and is judged as the template of that empty host; rows that repeat are judged each
and counted each; without labels the overall purity is 1/2 and open URLs are allowed; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from affectlake.llm.common import join_hot, lower_ascii
from affectlake.session import saved

# The seed rules, as host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
MANY_VALUES = 20
VALUE_SHARE = 0.2
CHI_SQUARE = 3.84
PRIOR = 4.0
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(
            chosen)
    return chosen


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, one row per row of ``pages``."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    formed = F.transform(
        F.slice(F.split("path", "/"), 2, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))),
        lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}"),
    )
    urls = saved(urls.select(
        "page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("seed"), formed.alias("formed")
    ))
    total = urls.count()

    # Distinct shapes first: all later work is on them, however many URLs share one.
    shapes = saved(urls.groupBy("host", "formed").agg(
        F.count("*").alias("n"), F.count_if(F.col("seed.verdict") == "allow").alias("allowed"),
        F.count("seed.verdict").alias("labelled"),
    ).withColumn("shape", F.xxhash64("host", "formed")))
    wild = (
        shapes.select("host", "n", F.posexplode("formed").alias("depth", "value"))
        .groupBy("host", "depth", "value").agg(F.sum("n").alias("n"))
        .groupBy("host", "depth").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"))
        .filter((F.col("n_values") > MANY_VALUES) & (F.col("n_values") > VALUE_SHARE * F.col("n")))
        .groupBy("host").agg(F.collect_set("depth").alias("wild"))
        .withColumn("host_key", F.xxhash64("host")).drop("host")
    )
    per_host = shapes.groupBy("host").agg(F.count("*").alias("k")).select(F.xxhash64("host").alias("host_key"), "k")
    keyed = shapes.withColumn("host_key", F.xxhash64("host"))
    n_shapes = shapes.count()
    known = join_hot(keyed, saved(per_host.join(wild, "host_key", "left")), "host_key", "k", n_shapes)
    general = F.transform(
        "formed", lambda s, i: F.when(F.array_contains(F.coalesce("wild", F.array().cast("array<int>")), i), "{*}")
        .otherwise(s))
    known = saved(known.select("shape", "host", "n", "allowed", "labelled", general.alias("segments")))

    # Nodes: every prefix of a template, the host itself at depth 0.
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda d: F.struct(
        d.alias("depth"), F.xxhash64("host", d, F.slice("segments", F.lit(1), d)).alias("node"),
        F.when(d > 0, F.xxhash64("host", d - 1, F.slice("segments", F.lit(1), F.greatest(d - 1, F.lit(0)))))
        .alias("parent"),
    ))
    paths = saved(known.select("shape", "allowed", "labelled", F.inline(prefixes)))
    nodes = saved(paths.groupBy("node").agg(
        F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.count("*").alias("k"),
        F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"),
    ))
    all_allowed, all_labelled = shapes.agg(F.sum("allowed"), F.sum("labelled")).first()
    overall = all_allowed / all_labelled if all_labelled else 0.5
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"))
    parents = saved(nodes.join(children, "node").select(
        F.col("node").alias("parent"), "c", F.col("allowed").alias("a0"), F.col("labelled").alias("n0")))
    inner = join_hot(nodes.filter("parent is not null"), parents, "parent", "c", nodes.count())
    tops = nodes.filter("parent is null").withColumn("a0", F.lit(int(all_allowed or 0))).withColumn(
        "n0", F.lit(int(all_labelled or 0)))
    rate = F.col("a0") / F.nullif(F.col("n0"), F.lit(0))
    gap = F.col("allowed") - F.col("labelled") * rate
    unlike = F.coalesce(gap * gap > CHI_SQUARE * F.col("labelled") * rate * (1 - rate), F.lit(False))
    purity = (F.col("allowed") + PRIOR * F.lit(overall)) / (F.col("labelled") + PRIOR)
    branches = saved(inner.unionByName(tops).select(
        "node", "k", F.when(unlike, F.struct("depth", purity.alias("purity"))).alias("own")))
    decided = (
        join_hot(paths.select("shape", "node"), branches, "node", "k", paths.count())
        .groupBy("shape").agg(F.max("own").alias("own"))
        .select("shape", F.coalesce("own.purity", F.lit(overall)).alias("purity"))
    )
    verdicts = saved(known.join(decided, "shape").select(
        "shape", "n", F.concat_ws("/", F.col("host"), F.array_join("segments", "/")).alias("template"), "purity"))
    judged = join_hot(urls.withColumn("shape", F.xxhash64("host", "formed")), verdicts, "shape", "n", total)
    learned = F.when(F.col("purity") < THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("seed.rule").alias("rule"),
        F.coalesce("seed.verdict", learned).alias("verdict"), "template", "purity",
    )
