"""URL filter by rules and, where no rule fits, by a tree of path templates per host.

1. Runs of digits in a path become wildcards, and equal paths are counted per host, with the labels of the labelled
   pages, before anything is shuffled further.
2. Level by level, segment by segment, the rare children of a node turn into one wildcard if most of them do not
   repeat; a child seen ``MIN_SEEN`` times keeps its name, however many there are.
3. Level by level, branches whose share of good labels does not differ significantly from that of all children of
   their node are merged.  A node goes on to the next level while it has good and bad labels and deeper paths, so paths
   are looked at as deep as labels differ.
4. The share of good labels of a template, smoothed towards its host's and that towards the share of all labels,
   decides: below ``REJECT_BELOW`` the template is blocked.

Labels come from the caller; the registered query labels pages by the verdict of the rules.

Defined results: NULL urls and urls without ``://`` have an empty host and path and form one template; repeated
rows are judged each; without labels everything is allowed; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import shared_dir, written

MIN_SEEN = 20  # a child of so many pages keeps its name
MAX_NOVELTY = 0.5  # other children, of so many pages in all, become a wildcard if there are more than this share of them
SIMILAR_Z = 1.96
SMOOTHING = 10.0
REJECT_BELOW = 0.3

# (verdict, host and path) in no special order; fixed values of the contract
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), r"(?s)^[^?#]*", 0)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else NULL; the rules are a small literal list."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def pattern_of(path: Column) -> Column:
    """A path without its leading slash, every run of digits a wildcard."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*")


def _share_of(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))


def _split(nodes: DataFrame, level: int) -> DataFrame:
    """Rows of ``nodes`` (t and others) with ``t`` led one level down."""
    own = nodes.withColumn("own", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
    children = own.groupBy("t", "own").agg(F.sum("n").alias("seen"))
    rare = (F.col("seen") < MIN_SEEN) & (F.col("own") != "")
    rest = children.where(rare).groupBy("t").agg(F.count(F.lit(1)).alias("names"), F.sum("seen").alias("pages"))
    novel = rest.where((F.col("pages") >= MIN_SEEN) & (F.col("names") > F.col("pages") * MAX_NOVELTY)).select("t")
    wild = children.where(rare).join(novel.hint("rebalance"), "t", "left_semi").select("t", "own", F.lit("*").alias("wild"))
    named = own.join(wild.hint("rebalance"), ["t", "own"], "left").withColumn("branch", F.coalesce("wild", "own"))
    # merge: compare each branch with all branches of its node
    branches = named.groupBy("t", "branch").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    pooled = branches.groupBy("t").agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
    rate = F.col("all_g") / (F.col("all_g") + F.col("all_b"))
    labelled = F.col("g") + F.col("b")
    differs = (labelled > 0) & (F.abs(F.col("g") - rate * labelled) > SIMILAR_Z * F.sqrt(rate * (1 - rate) * labelled))
    judged = branches.join(pooled.hint("rebalance"), "t").where(differs).select("t", "branch", F.lit(True).alias("differs"))
    apart = named.join(judged.hint("rebalance"), ["t", "branch"], "left")
    down = F.concat("t", F.lit("/"), F.when(F.col("differs"), F.col("branch")).otherwise("~"))
    return apart.select(*[c for c in nodes.columns if c != "t"], down.alias("t"))


def templates(paths: DataFrame, folder: str) -> DataFrame:
    """host, pattern, template, purity of each counted path (columns n, good, bad); levels are written tables."""
    segments = F.when(F.col("pattern") == "", F.array().cast("array<string>")).otherwise(F.split("pattern", "/"))
    tree = paths.withColumns({"segments": segments, "t": F.col("host")})
    level = 0
    while True:
        mixed = tree.groupBy("t").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max(F.size("segments")).alias("deep"))
        going = written(mixed.where((F.col("g") > 0) & (F.col("b") > 0) & (F.col("deep") > level)).select("t"), folder, f"going-{level}")
        if going.isEmpty():
            break
        settled = tree.join(going.hint("rebalance"), "t", "left_anti")
        moved = _split(tree.join(going.hint("rebalance"), "t", "left_semi"), level)
        tree = written(settled.unionByName(moved), folder, f"level-{level}")
        level += 1
    total = paths.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("base"))
    hosts = _share_of(tree, "host").select("host", F.col("g").alias("host_g"), F.col("b").alias("host_b"))
    leaves = _share_of(tree, "t")
    base = F.coalesce(total.scalar(), F.lit(1.0))
    of_host = (F.col("host_g") + SMOOTHING * base) / (F.col("host_g") + F.col("host_b") + SMOOTHING)
    purity = (F.col("g") + SMOOTHING * of_host) / (F.col("g") + F.col("b") + SMOOTHING)
    return (
        tree.join(leaves.hint("rebalance"), "t")
        .join(hosts.hint("rebalance"), "host")
        .select("host", "pattern", F.col("t").alias("template"), purity.alias("purity"))
    )


def judged_urls(pages: DataFrame, folder: str | None = None, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of ``pages`` (page_id, url).

    ``labels`` (page_id, label 1 or 0) are the labelled pages; without it the pages that a rule fits are.
    """
    folder = folder or shared_dir(pages.sparkSession)
    host, path = host_and_path(F.col("url").cast("string"))
    cut = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    cut = cut.select("*", rule.alias("rule"), verdict.alias("by_rule"), pattern_of(F.col("path")).alias("pattern"))
    known = cut
    if labels is None:
        known = cut.withColumn("label", F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0))
    else:
        one = labels.where("page_id is not null").groupBy("page_id").agg(F.min("label").alias("label"))
        known = cut.join(one, "page_id", "left")
    counted = known.groupBy("host", "pattern").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"),
    )
    found = templates(written(counted, folder, "paths"), folder)
    by_template = F.when(F.col("purity") < REJECT_BELOW, F.lit("block")).otherwise(F.lit("allow"))
    return cut.join(found.hint("rebalance"), ["host", "pattern"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "purity"
    )
