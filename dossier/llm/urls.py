"""URL filter by rules and a path-template tree (operator 4), DataFrame functions only.

Rules decide first. The urls that rules decide are the labelled ones: from them a tree of path templates is learned per
host, level by level. At a node, segments that are all digits, or that fewer urls have than ``support`` or a ``share`` of
the node's, are variable and generalised into the wildcard `*`; the others are at most 1 / share branches. Branches are
put in order of their shares of blocked and allowed urls, and neighbours are merged unless a test of homogeneity (the
G statistic of their blocked, allowed and unlabelled urls) says that they differ: ``differ`` is its critical value. A
merged branch is named for its least segment and how many more it has, `<en+2>`. A node of fewer than ``support``
different paths is not opened further: what follows is `**`.

A template's purity is its share of blocked among labelled urls, smoothed towards ``prior`` with the weight of
``strength`` labels; templates of ``reject`` or more are rejected. A template without labelled urls has the prior's
purity and is allowed.

Urls are first summed by host and path, and every level sums again before it shuffles: a hot host costs one row per
distinct path or branch and task. Nodes and branches that more rows have than an even share of a partition are broadcast,
of which there are at most as many as partitions.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed (its template
is that of the empty host); rules of one length are taken in alphabetical order; repeated rows count as often as they
occur; branches of equal shares are in alphabetical order; a path of any length is taken apart as far as ``support``
paths share it; an empty table gives an empty result; other columns are passed through unless named like a result.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import beside, stored

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: (verdict, host and path prefix)
Rules = list[tuple[str, str]]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(*counts: Column) -> Column:
    """Sum of n ln n over the counts."""
    return functools.reduce(lambda x, y: x + y, [F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0) for n in counts])


def merged(branches: DataFrame, differ: float) -> DataFrame:
    """branches (host, template, part, n, b, a: urls in all, blocked, allowed) with token: neighbours that don't differ share one."""
    node = Window.partitionBy("host", "template")
    by = node.orderBy(F.col("b") / F.col("n"), F.col("a") / F.col("n"), "part")
    mine = [F.col("b"), F.col("a"), F.col("n") - F.col("a") - F.col("b")]
    last = [F.lag(c).over(by) for c in mine]
    both = [x + y for x, y in zip(mine, last, strict=True)]
    n, m = F.col("n"), F.lag("n").over(by)
    g = 2 * (_entropy(*mine) + _entropy(*last) - _entropy(*both) - _entropy(n, m) + _entropy(n + m))
    apart = branches.withColumn("apart", F.coalesce((g > differ).cast("int"), F.lit(0))).withColumn("kind", F.sum("apart").over(by))
    kin = Window.partitionBy("host", "template", "kind")
    more = F.count(F.lit(1)).over(kin) - 1
    return apart.withColumn("token", F.when(more == 0, F.col("part")).otherwise(F.concat(F.lit("<"), F.min("part").over(kin), F.lit("+"), more, F.lit(">")))).drop("apart", "kind")


def templates(paths: DataFrame, support: int = 5, share: float = 0.02, differ: float = 9.21) -> DataFrame:
    """paths (host, path, n, blocked, allowed) with template."""
    node = ["host", "template"]
    variable = lambda x: F.when(x.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), "*").otherwise(x)
    state = stored(paths.withColumn("template", F.lit("")).withColumn("parts", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("at", F.lit(0)))
    done = None
    while True:
        # The segments that all paths of a node share are what its least and its greatest path share: the node is opened
        # where its paths part, so that rounds follow branchings, not segments.
        rest = F.slice("parts", F.col("at") + 1, F.size("parts"))
        nodes = state.groupBy(*node).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("_n"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        differ_at = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        shared = F.when(differ_at == 0, F.size("low")).otherwise(differ_at - 1).cast("int")
        chain = F.array_join(F.transform(F.slice("low", F.lit(1), shared), lambda x: F.concat(F.lit("/"), variable(x))), "")
        nodes = stored(nodes.select(*node, "all_n", "_n", F.col("_n").alias("paths"), shared.alias("shared"), chain.alias("chain")))
        # Paths that end here, and those of nodes that too few paths share, are finished.
        sized, thin = beside(state, nodes, node), F.col("paths") < support
        moved = sized.withColumn("closed", F.when(F.size("parts") <= F.col("at"), F.col("template")).when(thin, F.concat("template", F.lit("/**"))))
        moved = moved.withColumn("at", F.col("at") + F.col("shared")).withColumn("template", F.concat("template", "chain"))
        moved = moved.withColumn("closed", F.coalesce("closed", F.when(F.size("parts") <= F.col("at"), F.col("template"))))
        closed = moved.where("closed IS NOT NULL").select("host", "path", "n", "blocked", "allowed", F.col("closed").alias("template"))
        done = closed if done is None else done.unionAll(closed)
        going = stored(moved.where("closed IS NULL").withColumn("part", variable(F.get("parts", "at"))).drop("paths", "shared", "chain", "closed"))
        if going.isEmpty():
            return done
        branches = going.where("part <> '*'").groupBy(*node, "part").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.max("all_n").alias("all_n"), F.count(F.lit(1)).alias("_n"))
        branches = stored(branches.withColumn("names", F.col("n") >= F.greatest(F.lit(support), F.col("all_n") * share)))
        kept = merged(branches.where("names"), differ)  # at most 1 / share branches of a node
        tokens = stored(kept.select(*node, "part", "token", "_n").unionAll(branches.where("NOT names").select(*node, "part", F.lit("*").alias("token"), "_n")))
        grown = F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*")))
        state = stored(beside(going.drop("all_n"), tokens, [*node, "part"], "left").withColumn("template", grown).withColumn("at", F.col("at") + 1).drop("part", "token"))


def judge(pages: DataFrame, rules: Rules, url: str = "url", prior: float = 0.2, strength: float = 5.0, reject: float = 0.5, support: int = 5, share: float = 0.02, differ: float = 9.21) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict (allow or block)."""
    results = ("host", "path", "rule", "template", "purity", "verdict")
    names = [c for c in pages.columns if c not in results]
    rows = pages.select(F.struct(*names).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    summed = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled.verdict") == "block").alias("blocked"), F.count_if(F.col("ruled.verdict") == "allow").alias("allowed"))
    tree_rows = stored(templates(summed, support, share, differ))
    purity = tree_rows.groupBy("host", "template").agg(((F.sum("blocked") + strength * prior) / (F.sum("blocked") + F.sum("allowed") + strength)).alias("purity"))
    sizes = tree_rows.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_n"))
    learned = beside(tree_rows.select("host", "path", "template", "n"), stored(purity.join(sizes, ["host", "template"])), ["host", "template"])
    out = beside(rows, stored(learned.withColumnRenamed("n", "_n")), ["host", "path"], "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("row.*", "host", "path", F.col("ruled.rule").alias("rule"), "template", "purity", verdict.alias("verdict"))
