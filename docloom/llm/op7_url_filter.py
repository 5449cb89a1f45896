"""URL filter: explicit host and path rules, then a path-template tree with labelled purity.

All of it is DataFrame work: no Python runs on the executors.

Method. Each host has a tree of templates over its distinct paths, grown from the root in rounds, one for each level at which paths part
(what all paths of a node share is passed over at once, so a url of 100 000 segments costs one round).

 - Wildcards come from the fan-out: a child that has fewer of its parent's pages than their square root is variable. Variable
   children are one branch, but for those whose labelled share departs from it beyond chance: the ones below are a branch of their own, and so are the
   ones above.
 - The literal children and the wildcard branches are ordered by their share, and neighbours that a test of two proportions does not tell
   apart are merged; a member that departs from its merged branch stands alone again. What hangs on merged children is one subtree.
 - A branch that departs from its parent's share beyond chance has a share of its own, smoothed towards it; others have their parent's.
   A url is rejected if the share of good pages that its branch ends up with is under the threshold.

A path that ends at a node is a branch of its own, so that the others may go on by all that they share. A round ends a node with fewer
than two labelled pages, and one with a single path, since nothing below could change its share.

Bounds: a node has at most as many literal children as the square root of its pages, which is what a window orders. Everything else is sums
before a shuffle, and joins of written tables, whose hot keys adaptive execution splits. The tree grows with distinct (host, path) pairs,
not pages. Rounds are as many as the levels at which labelled paths of a node part, each a few jobs.

Defined results: a null url, or one without "://", has empty host and path, no rule, and the verdict
"allow". Rows that repeat are judged each on its own. Without labels every template is allowed. Of rules of equal
length that fit, the later one in the list wins; a purity of just the threshold is allowed. An empty table gives no
rows; very long urls are read whole. Slashes at either end of a path make no segment, those within do; a control character 1 in a path counts as a
slash. Extra columns of the pages and the labels are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: The rules of the contract: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits; the longest rule first."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


#: Between segments while the tree is grown: it sorts before all that a segment may hold, so that the least and the greatest path of a
#: node share what all of its paths share.
SEP = "\x01"
NODE = ["k1", "k2"]


def bare(path: Column) -> Column:
    """The path's segments, each with SEP before it; empty for a path without any."""
    inner = F.translate(F.regexp_replace(path, "^/+|/+$", ""), "/", SEP)
    return F.when(inner == "", "").otherwise(F.concat(F.lit(SEP), inner))


def keys(*parts: Column) -> dict[str, Column]:
    """A 128-bit key."""
    return {"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit(7), *parts)}


def shared(least: Column, greatest: Column) -> Column:
    """What two paths share from their beginnings, in whole segments."""
    segments = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(x, F.lit(2), F.length(x)), SEP, -1))
    same = F.zip_with(segments(least), segments(greatest), lambda x, y: x.eqNullSafe(y))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)), F.size(same) + 1) - 1
    return F.when(n == 0, "").otherwise(F.concat(F.lit(SEP), F.array_join(F.slice(segments(least), F.lit(1), n.cast("int")), SEP)))


def departs(g: Column, n: Column, share: Column, z: float) -> Column:
    """Whether g good pages of n are beyond chance at a share."""
    return F.coalesce(F.abs(g / n - share) > z * F.sqrt(share * (1 - share) / n), F.lit(False))


def branches(kids: DataFrame, prior: float, z: float) -> DataFrame:
    """kids (node, seg, pages, n, g, of: the node's pages, share) with label, own and the share of the branch that each goes to."""
    variable = (F.col("pages") * F.col("pages") < F.col("of")) & (F.col("seg") != SEP)
    k = kids.withColumn("variable", variable)
    rate = k.where("variable and n > 0").groupBy(*NODE).agg((F.sum("g") / F.sum("n")).alias("rate"))
    k = k.join(rate, NODE, "left")
    odd = F.col("variable") & (F.col("n") > 0) & departs(F.col("g"), F.col("n"), F.col("rate"), z)
    side = F.when(~odd, "*").when(F.col("g") / F.col("n") < F.col("rate"), "*<").otherwise("*>")
    k = k.withColumn("sibling", F.when(F.col("variable"), side).otherwise(F.concat(F.lit("="), "seg"))).drop("rate")
    k = cut(k)
    s = k.groupBy(*NODE, "sibling").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.first("share").alias("share")).where("n > 0")
    # neighbours by share; the first of each run that the test tells from the one before starts a branch
    s = s.withColumn("ends", F.col("sibling") == "=" + SEP)
    w = W.partitionBy(*NODE, "ends").orderBy(F.col("g") / F.col("n"), "sibling")
    s = s.withColumns({"__n": F.lag("n").over(w), "__g": F.lag("g").over(w)})
    both = (F.col("g") + F.col("__g")) / (F.col("n") + F.col("__n"))
    apart = F.abs(F.col("g") / F.col("n") - F.col("__g") / F.col("__n")) > z * F.sqrt(both * (1 - both) * (1 / F.col("n") + 1 / F.col("__n")))
    s = s.withColumn("__new", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0))
    s = s.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = W.partitionBy(*NODE, "ends", "run")
    s = s.withColumn("alone", departs(F.col("g"), F.col("n"), F.sum("g").over(run) / F.sum("n").over(run), z))
    kept = lambda c: F.sum(F.when(~F.col("alone"), F.col(c))).over(run)
    members = F.count_if(~F.col("alone")).over(run)
    first = F.min(F.when(~F.col("alone"), F.col("sibling"))).over(run)
    s = s.withColumns({
        "bn": F.when(F.col("alone"), F.col("n")).otherwise(kept("n")), "bg": F.when(F.col("alone"), F.col("g")).otherwise(kept("g")),
        "label": F.when(F.col("alone") | (members == 1), F.col("sibling")).otherwise(F.concat(first, F.lit("|…"))),
    })
    # a branch of all that its node has says nothing new
    own = departs(F.col("bg"), F.col("bn"), F.col("share"), z) & (F.col("bn") < F.sum("n").over(W.partitionBy(*NODE)))
    smooth = (F.col("bg") + prior * F.col("share")) / (F.col("bn") + prior)
    s = s.select(*NODE, "sibling", "label", own.alias("own"), F.when(own, smooth).otherwise(F.col("share")).alias("__share"))
    out = k.select(*NODE, "seg", "sibling", "share").join(s, [*NODE, "sibling"], "left")
    return out.select(*NODE, "seg", F.coalesce("label", "sibling").alias("label"), F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("__share", "share").alias("share"))


def grown(leaf: DataFrame, prior: float, z: float) -> DataFrame:
    """leaf (host, p1, p2, rest, pages, n, g, share: one row for each path of a host) with the share and the template of the branch that each path
    ends in."""
    at = leaf.withColumns({**keys(F.col("host")), "text": F.lit(""), "template": F.lit("/**")})
    ended = []
    while True:
        at = cut(at)
        nodes = at.groupBy(*NODE).agg(F.sum("pages").alias("of"), F.sum("n").alias("__n"), F.min("rest").alias("__a"), F.max("rest").alias("__b"))
        nodes = nodes.where("__a <> __b and __n > 1").select(*NODE, "of", shared(F.col("__a"), F.col("__b")).alias("common"))
        after = F.substring(F.col("rest"), F.length("common") + 1, F.length("rest"))
        seg = F.when(F.col("after") == "", SEP).otherwise(F.substring_index(F.substring(F.col("after"), F.lit(2), F.length("after")), SEP, 1))
        left = F.when(F.col("seg") == SEP, "").otherwise(F.substring(F.col("after"), F.length("seg") + 2, F.length("after")))
        on = at.join(nodes, NODE, "left").withColumn("after", after).withColumn("seg", seg).withColumn("left", left)
        on = cut(on.withColumn("text", F.concat("text", F.translate(F.coalesce("common", F.lit("")), SEP, "/"))).drop("after", "common"))
        ended.append(on.where("of is null"))
        on = on.where("of is not null")
        if on.isEmpty():
            break
        kids = on.groupBy(*NODE, "seg").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("g").alias("g"), F.first("of").alias("of"), F.first("share").alias("share"))
        j = on.drop("share", "of", "rest").withColumnRenamed("left", "rest").join(branches(kids, prior, z), [*NODE, "seg"])
        part = F.when(F.col("label") == "=" + SEP, "/").when(F.col("label").startswith("="), F.concat(F.lit("/"), F.substring(F.col("label"), F.lit(2), F.length("label")))).otherwise(F.concat(F.lit("/"), "label"))
        text = F.concat("text", F.translate(part, SEP, ""))
        # a path that ends here, or a branch of nothing but this path, has no more below it
        shown = F.when(F.col("own"), F.when(F.col("seg") == SEP, text).otherwise(F.concat(text, F.lit("/**")))).otherwise(F.col("template"))
        fresh = keys(*NODE, F.col("label"))
        at = j.select("host", "p1", "p2", fresh["k1"].alias("k1"), fresh["k2"].alias("k2"), "rest", "pages", "n", "g", "share", text.alias("text"), shown.alias("template"))
    out = ended[0].select("host", "p1", "p2", "share", "template")
    for e in ended[1:]:
        out = out.unionAll(e.select("host", "p1", "p2", "share", "template"))
    return out


def judge(
    pages: DataFrame,
    labels: DataFrame | None,
    rules=RULES,
    prior: float = 4.0,
    threshold: float = 0.5,
    z: float = 1.64,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.

    labels: (page_id, good in 0..1); null or missing labels do not count. prior: pseudo-counts of the
    parent's share. threshold: least purity to allow. z: standard errors up to which a difference is chance.
    """
    if labels is not None:
        labels = labels.select("page_id", "good")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "said": said, "rest": bare(F.col("path"))})
    p = cut(p.withColumns({"p1": F.xxhash64("rest"), "p2": F.xxhash64(F.lit(7), "rest")}))
    if labels is None:
        known = p.sparkSession.createDataFrame([], "page_id bigint, good double")
    else:
        known = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.avg("good").alias("good"))
    # Partial sums before the shuffle keep a hot path cheap: one row a task for each path.
    paths = p.join(known, "page_id", "left").groupBy("host", "p1", "p2").agg(F.first("rest").alias("rest"), F.count("*").alias("pages"), F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    paths = cut(paths)
    # The share of all labelled pages: a scalar of one row.
    base = paths.agg(F.try_divide(F.sum("g"), F.sum("n"))).first()[0]
    base = 1.0 if base is None else base
    hosts = cut(paths.groupBy("host").agg(((F.sum("g") + prior * base) / (F.sum("n") + prior)).alias("share")))
    found = grown(paths.join(hosts, "host"), prior, z)
    out = p.join(found, ["host", "p1", "p2"])
    verdict = F.coalesce("said", F.when(F.col("share") < threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("share", 9).alias("purity"))
