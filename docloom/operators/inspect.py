"""Inspection of whole trees: admission under one budget, then each distinct attachment read once.

nodes: root_id, node_id, parent_id (null: the root), pos, name, kind (pdf, image, text), size, decoded, images, barcodes, metadata (array<string>).
pages: root_id, node_id, number, text, source (attachment, ocr).

A node's digest stands for all that hangs on it. Digests come level by level from the leaves up; of the nodes of one depth with
equal digests only one is read: its pages are redacted, its findings counted and its children's results put behind its own. Its
result then goes to every node that is like it, in whatever tree. Trees have three levels at most, so this takes two joins
for digests and two for results, however many trees there are. Nodes and pages are shuffled once, by tree: what joins or counts within
trees reads tables in buckets of root_id.

Defined results: a tree that goes over the budget, or below the last level, is refused whole (INSPECTION_LIMIT), one with orphans
or cycles as well (INSPECTION_FAILED). A page without text fails its tree unless it is a text's; a page or a tree of
too many characters exceeds the limit. Null texts are empty, null counters 0. A tree without pages has an empty list. Empty tables
give no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.durable import clustered, dealt, durable, joins_by_part
from docloom.functions import security
from docloom.functions.text import trim_ws, utf16_length
from docloom.operators import state, tree

COUNTS = ("attachments", "images", "barcodes", "metadata")
NO_FINDINGS = "array<struct<kind:string,count:int>>"


def _count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)


def budget(t: DataFrame, pages: DataFrame) -> DataFrame:
    """root_id, code, failed_at of `state.budget_admission` for trees: what a visit reserves are its pages, its images, its decoded
    bytes, and the number and sizes of its attachments."""
    own = pages.groupBy("root_id", "node_id").agg(F.count("*").alias("pages"))
    below = t.where("parent_id is not null").groupBy("root_id", F.col("parent_id").alias("node_id"))
    below = below.agg(F.count("*").alias("attachments"), F.sum("size").alias("attachment_bytes"))
    visits = tree.admission(t.join(own, ["root_id", "node_id"], "left").withColumn("pages", _count("pages")))
    visits = visits.join(below, ["root_id", "node_id"], "left")
    return state.budget_admission(visits.select("root_id", "visit", "depth", "size", *map(_count, ("pages", "images", "decoded", "attachments", "attachment_bytes"))))


def refused(nodes: DataFrame, t: DataFrame, pages: DataFrame) -> DataFrame:
    """root_id, code of the trees that are not inspected."""
    limit = budget(t, pages).where("code is not null").select("root_id", "code")
    lost = tree.unreached(nodes, t).where("why <> 'deep'").select("root_id", F.lit("INSPECTION_FAILED").alias("code"))
    # a tree may have several reasons; the limit is met first
    return limit.unionByName(lost).groupBy("root_id").agg(F.max("code").alias("code"))


def digests(t: DataFrame, pages: DataFrame) -> DataFrame:
    """The nodes of a tree with digest: equal where depth, kind, counters, metadata, pages and all that hangs below are equal. Names and
    places among siblings of the node itself are no part of it; names of what is below are none either."""
    page = F.struct("number", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), "source")
    of_pages = pages.groupBy("root_id", "node_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("__pages"))
    own = F.struct("depth", "kind", *map(_count, ("images", "barcodes")), "metadata", "__pages")
    d = t.join(of_pages, ["root_id", "node_id"], "left").withColumn("__own", F.to_json(own)).drop("__pages")
    out, below = [], None
    for depth in range(state.MAX_DEPTH, -1, -1):
        level = d.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("__below", F.lit(None).cast("string"))
        else:
            order = F.array_sort(F.collect_list(F.struct("pos", "digest")))
            under = below.groupBy("root_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(order, lambda c: F.hex(c["digest"])), " ").alias("__below"))
            level = level.join(under, ["root_id", "node_id"], "left")
        below = level.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\n", "__own", "__below"), 256))).drop("__own", "__below")
        below = clustered(below, "root_id")
        out.append(below)
    return reduce(DataFrame.unionByName, out)


def shared(d: DataFrame) -> DataFrame:
    """root_id, node_id, cache_hit: whether an equal node of the same depth was visited before it in its tree."""
    w = W.partitionBy("root_id", "depth", "digest").orderBy("path")
    return d.select("root_id", "node_id", (F.row_number().over(w) > 1).alias("cache_hit"))


def merged(findings: DataFrame, key: str) -> DataFrame:
    """key, redactions: findings (key, kind, count) added up by kind, in the order of kinds."""
    total = findings.groupBy(key, "kind").agg(F.sum("count").cast("int").alias("count"))
    return total.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "count"))).alias("redactions"))


def read(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """digest, number, text, source, findings, code: the redacted pages of the chosen nodes."""
    p = pages.join(chosen.select("root_id", "node_id", "digest", "kind"), ["root_id", "node_id"])
    p = p.select("digest", "kind", "number", "source", security.scan(F.coalesce("text", F.lit(""))).alias("s"))
    p = p.select("digest", "kind", "number", "source", trim_ws(F.col("s.text")).alias("text"), F.col("s.findings").alias("findings"))
    code = F.when((F.col("text") == "") & (F.col("kind") != "text"), "INSPECTION_FAILED").when(utf16_length(F.col("text")) > S.MAX_PAGE_CHARS, "INSPECTION_LIMIT")
    return p.withColumn("code", code).drop("kind")


def execute(nodes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, pages). reports: root_id, code, page_count, ocr_pages, attachments, images, barcodes, metadata, redactions, reads (nodes
    that were not like one visited before), cache_hit (whether a tree of a smaller root_id is its equal). pages: root_id, number, text, source of
    the trees without a code."""
    with joins_by_part(nodes.sparkSession):
        return _execute(nodes, pages)


def _execute(nodes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = nodes.select("root_id", "node_id", "parent_id", "pos", "name", "kind", "size", "decoded", "images", "barcodes", "metadata")
    pages = pages.select("root_id", "node_id", "number", "text", "source")
    nodes, pages = clustered(nodes, "root_id"), clustered(pages, "root_id")
    t = clustered(tree.paths(nodes), "root_id")
    no = clustered(refused(nodes, t, pages), "root_id")
    admitted = t.join(no, "root_id", "left_anti")
    d = digests(admitted, pages.join(no, "root_id", "left_anti"))
    first = F.min(F.struct("root_id", "path", "node_id"))
    names = d.groupBy("digest", "depth").agg(first.alias("f")).select("digest", F.col("f.root_id").alias("root_id"), F.col("f.node_id").alias("node_id"))
    chosen = clustered(d.join(dealt(names, "root_id"), ["root_id", "node_id", "digest"]), "root_id")
    texts = durable(read(chosen, pages))

    said = F.filter("metadata", lambda m: ~F.coalesce(m, F.lit("")).isin("null", "{}", ""))
    facts = chosen.select("digest", "depth", "kind", *map(_count, ("images", "barcodes")), F.coalesce(F.size(said), F.lit(0)).cast("bigint").alias("metadata"))
    own_pages = texts.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("code").isNotNull(), F.struct("number", "code")))["code"].alias("own_code"), F.sum(utf16_length(F.col("text"))).alias("chars"),
    )
    found = texts.select("digest", F.explode("findings").alias("f")).unionAll(chosen.select("digest", F.explode(said).alias("m")).select("digest", F.explode(security.findings(F.col("m")))))
    found = found.select("digest", "f.kind", "f.count")
    facts = facts.join(own_pages, "digest", "left")

    below = None  # results of the level below: facts, pages, findings, each by digest
    for depth in range(state.MAX_DEPTH, -1, -1):
        own = facts.where(F.col("depth") == depth).drop("depth")
        here = texts.join(own.select("digest"), "digest", "left_semi").select("digest", "number", "text", "source")
        counts = found.join(own.select("digest"), "digest", "left_semi")
        if below is None:
            level = own.select("digest", F.coalesce("n", F.lit(0)).alias("n"), F.col("own_code").alias("code"), F.coalesce("chars", F.lit(0)).alias("chars"), F.lit(0).cast("bigint").alias("attachments"), "images", "barcodes", "metadata")
        else:
            b_facts, b_pages, b_counts = below
            up = chosen.where(F.col("depth") == depth).select("root_id", F.col("node_id").alias("parent_id"), F.col("digest").alias("above"))
            edges = d.where(F.col("depth") == depth + 1).join(up, ["root_id", "parent_id"]).select("above", "pos", "digest")
            edges = durable(edges.join(b_facts, "digest"))
            w = W.partitionBy("above").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
            size = facts.select(F.col("digest").alias("above"), F.col("n").alias("__n"))
            placed = edges.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(size, "above")
            placed = placed.select("above", "digest", (F.col("__before") + F.coalesce("__n", F.lit(0))).alias("offset"))
            moved = b_pages.join(placed, "digest").select(F.col("above").alias("digest"), (F.col("number") + F.col("offset")).cast("int").alias("number"), F.concat(F.lit(tree.ATTACHMENT), "text").alias("text"), "source")
            here = here.unionByName(moved)
            counts = counts.unionByName(edges.select("above", "digest").join(b_counts, "digest").select(F.col("above").alias("digest"), "kind", "count"))
            sums = edges.groupBy(F.col("above").alias("digest")).agg(
                F.sum("n").alias("b_n"), F.sum(F.col("chars") + F.col("n") * len(tree.ATTACHMENT)).alias("b_chars"), F.min(F.when(F.col("code").isNotNull(), F.struct("pos", "code")))["code"].alias("b_code"),
                (F.sum("attachments") + F.count("*")).alias("b_attachments"), *[F.sum(c).alias(f"b_{c}") for c in COUNTS[1:]],
            )
            j = own.join(sums, "digest", "left")
            add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            level = j.select(
                "digest", add("n", "b_n").alias("n"), F.coalesce("own_code", "b_code").alias("code"), add("chars", "b_chars").alias("chars"),
                F.coalesce("b_attachments", F.lit(0)).alias("attachments"), *[add(c, f"b_{c}").alias(c) for c in COUNTS[1:]],
            )
        level = level.withColumn("code", F.coalesce("code", F.when(F.col("chars") > S.MAX_TOTAL_CHARS, "INSPECTION_LIMIT")))
        below = tuple(map(durable, (level, here, counts)))

    r_facts, r_pages, r_counts = below
    roots = d.where("depth = 0").select("root_id", "digest", "name")
    before = F.row_number().over(W.partitionBy("digest").orderBy("root_id")) > 1
    reads = d.groupBy("root_id").agg(F.count_distinct("depth", "digest").alias("reads"))
    ocr = r_pages.groupBy("digest").agg(F.array_sort(F.collect_list(F.when(F.col("source") == "ocr", F.col("number")))).alias("ocr_pages"))
    name = F.explode(security.findings(F.coalesce("name", F.lit("")))).alias("f")
    # these joins are planned by the caller: by the size of their files they might be broadcast
    r_facts, r_pages, r_counts, ocr, reads = (x.hint("merge") for x in (r_facts, r_pages, r_counts, ocr, reads))
    of_tree = roots.select("root_id", "digest").join(r_counts, "digest").select("root_id", "kind", "count").unionAll(roots.select("root_id", name).select("root_id", "f.kind", "f.count"))
    good = roots.withColumn("cache_hit", before).join(r_facts, "digest").join(ocr, "digest", "left").join(reads, "root_id").join(merged(of_tree, "root_id").hint("merge"), "root_id", "left")
    named = F.when(F.coalesce("name", F.lit("")).isin("null", "{}", ""), 0).otherwise(1)
    ok = lambda c: F.when(F.col("code").isNull(), c)
    reports = good.select(
        "root_id", "code", ok(F.col("n")).alias("page_count"), ok(F.coalesce("ocr_pages", F.array().cast("array<int>"))).alias("ocr_pages"),
        *[ok(F.col(c) + named if c == "metadata" else F.col(c)).alias(c) for c in COUNTS], ok(F.coalesce("redactions", F.array().cast(NO_FINDINGS))).alias("redactions"), "reads", "cache_hit",
    )
    reports = reports.unionByName(no, allowMissingColumns=True).withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    out = r_pages.join(roots.join(r_facts.where("code is null").select("digest"), "digest").select("root_id", "digest").hint("merge"), "digest")
    return reports, out.select("root_id", "number", "text", "source")
