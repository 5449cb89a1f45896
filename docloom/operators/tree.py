"""Inspection trees: documents with attachments, to a bounded depth, as tables of nodes.

nodes: root_id, node_id, parent_id (null: the root), pos (place among its siblings), pages, images and other counters.
A tree has MAX_DEPTH + 1 levels at most, so that paths come from as many joins and no recursion runs. One more level
is kept, which admission refuses; `unreached` reports every node that is in no path, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.durable import durable
from docloom.functions.text import utf16_length
from docloom.operators.state import MAX_DEPTH

#: Fixed value: what a page of an attachment begins with, once for each level.
ATTACHMENT = "[Załącznik]\n"


def paths(nodes: DataFrame) -> DataFrame:
    """nodes with depth and path, the places from the root down; in each root, path is the order of visits. The levels
    below MAX_DEPTH + 1 are left to `unreached`."""
    level = nodes.where("parent_id is null").withColumns({"depth": F.lit(0), "path": F.array().cast("array<bigint>")})
    out = level
    for depth in range(1, MAX_DEPTH + 2):
        above = level.select("root_id", F.col("node_id").alias("parent_id"), F.col("path").alias("__above"))
        level = nodes.join(above, ["root_id", "parent_id"])
        own = F.concat("__above", F.array(F.col("pos").cast("bigint")))
        level = level.withColumns({"depth": F.lit(depth), "path": own}).select(*out.columns)
        out = out.unionByName(level)
    return out


def unreached(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """root_id, node_id, why of the nodes that `paths` has not: deep (below its last level), orphan (the chain of parents ends at
    a node that is not there) or cycle (it never ends). Each round doubles how far up a node looks, so a chain of n parents
    takes log2(n) rounds; what looks at nothing new after as many rounds as there are nodes is a cycle."""
    key = ["root_id", "node_id"]
    lost = nodes.join(tree.select(*key), key, "left_anti").dropDuplicates(key)
    known = nodes.select("root_id", F.col("node_id").alias("up")).distinct()
    reached = tree.select("root_id", F.col("node_id").alias("up"), F.lit("deep").alias("__deep")).distinct()
    found = lost.select(*key, F.col("parent_id").alias("up"))
    found = found.join(known.withColumn("__known", F.lit(True)), ["root_id", "up"], "left").join(reached, ["root_id", "up"], "left")
    found = durable(found.select(*key, "up", F.coalesce("__deep", F.when(F.col("__known").isNull(), "orphan")).alias("why")))
    rounds = max(1, found.count()).bit_length() + 1
    for _ in range(rounds):
        if found.where("why is null").isEmpty():
            break
        above = found.select("root_id", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("why").alias("__why"))
        on = found.where("why is null").join(above, ["root_id", "up"])
        found = durable(found.where("why is not null").unionByName(on.select(*key, F.col("__up").alias("up"), F.col("__why").alias("why"))))
    return found.select(*key, F.coalesce("why", F.lit("cycle")).alias("why"))


def admission(tree: DataFrame) -> DataFrame:
    """paths with visit (from 1) and offset: the pages of all nodes visited before."""
    w = W.partitionBy("root_id").orderBy("path")
    before = F.sum("pages").over(w.rowsBetween(W.unboundedPreceding, -1))
    return tree.withColumns({"visit": F.row_number().over(w), "offset": F.coalesce(before, F.lit(0)).cast("bigint")})


def roll_up(tree: DataFrame, counters: list[str]) -> DataFrame:
    """root_id, path, attachments and the counters of each node with all that hang below it; attachments counts
    the nodes below. One row for each node and ancestor, summed before the shuffle."""
    ancestors = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))
    rows = tree.select("root_id", *counters, F.size("path").alias("depth"), F.explode(ancestors).alias("path"))
    below = F.sum(F.when(F.col("depth") > F.size("path"), 1).otherwise(0)).alias("attachments")
    return rows.groupBy("root_id", "path").agg(below, *[F.sum(c).alias(c) for c in counters])


def work_size(tree: DataFrame) -> DataFrame:
    """root_id, path, work: pages of a node and of all below it, and images of those that are PDFs."""
    own = F.col("pages") + F.when(F.col("kind") == "pdf", F.col("images")).otherwise(0)
    return roll_up(tree.withColumn("work", own), ["work"]).drop("attachments")


def merged_findings(tree: DataFrame, findings: DataFrame) -> DataFrame:
    """root_id, path, kind, count: redactions (root_id, node_id, kind, count) of each node and all below it."""
    f = findings.join(tree.select("root_id", "node_id", "path"), ["root_id", "node_id"])
    ancestors = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))
    rows = f.select("root_id", "kind", "count", F.explode(ancestors).alias("path"))
    return rows.groupBy("root_id", "path", "kind").agg(F.sum("count").alias("count"))


def numbered_pages(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """root_id, number, text, source: the pages (root_id, node_id, number, text, source) of whole trees, in the order of
    visits; those of attachments are marked once for each level."""
    p = pages.join(tree.select("root_id", "node_id", "path"), ["root_id", "node_id"])
    number = F.row_number().over(W.partitionBy("root_id").orderBy("path", "number"))
    text = F.concat(F.repeat(F.lit(ATTACHMENT), F.size("path")), F.col("text"))
    return p.select("root_id", number.alias("number"), text.alias("text"), "source")


def text_limits(pages: DataFrame) -> DataFrame:
    """root_id, code: INSPECTION_LIMIT where a page or all of them are too long, else null."""
    n = utf16_length(F.col("text"))
    over = (F.max(n) > S.MAX_PAGE_CHARS) | (F.sum(n) > S.MAX_TOTAL_CHARS)
    return pages.groupBy("root_id").agg(F.when(over, "INSPECTION_LIMIT").alias("code"))


def metadata_count(texts: Column) -> Column:
    """How many metadata texts say anything."""
    return F.size(F.filter(texts, lambda t: ~F.coalesce(t, F.lit("")).isin("null", "{}", "")))
