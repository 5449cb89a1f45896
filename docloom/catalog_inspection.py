"""Registered queries of inspection: trees of attachments, PDF objects and their files. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.catalog import query, sql_redact
from docloom.durable import clustered, dealt
from docloom.operators import inspect, objects
from docloom.session import table

# ------------------------------------------------------------------ trees

AWS = "AKIA" + "Z" * 16


def order_trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and pages of trees: an order holds its lines, a line holds what was sold at a discount. Lines with the same flags
    are equal attachments."""
    orders, items = dealt(table(spark, d, "orders"), "o_orderkey"), dealt(table(spark, d, "lineitem"), "l_orderkey")
    text = lambda c: F.col(c).cast("string")
    no = F.array().cast("array<string>")

    def node(df, root, name, parent, pos, file, kind, images, metadata, page):
        return df.select(
            root.alias("root_id"), name.alias("node_id"), parent.cast("string").alias("parent_id"), pos.cast("bigint").alias("pos"), file.alias("name"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
            F.lit(1000).alias("size"), F.lit(1000).alias("decoded"), F.lit(images).alias("images"), F.lit(0).alias("barcodes"), metadata.alias("metadata"), page.alias("page"),
        )

    secret = F.when(F.col("o_orderkey") % 11 == 0, f" {AWS}").otherwise("")
    key = F.col("o_orderkey")
    root = node(orders, key, F.lit("o"), F.lit(None), F.lit(0), F.concat(text("o_orderkey"), F.when(key % 13 == 0, secret).otherwise(".pdf")), "pdf", 1, F.array("o_orderstatus", F.lit("null"), F.lit("{}")), F.concat(F.lit(" order "), "o_orderpriority", secret))
    flags = F.min(F.concat("l_returnflag", F.lit("/"), "l_linestatus", F.when(F.col("l_linenumber") == 4, f" {AWS}").otherwise("")))
    line = items.groupBy("l_orderkey", "l_linenumber").agg(flags.alias("flags"), F.max("l_quantity").alias("q"))
    number = F.concat(F.lit("l"), text("l_linenumber"))
    empty = (F.col("q") == 50) & (F.col("l_linenumber") > 2)
    lines = node(line, F.col("l_orderkey"), number, F.lit("o"), F.col("l_linenumber"), number, F.when(F.col("l_linenumber") == 5, "text").otherwise("pdf"), 0, no, F.when(empty, "").otherwise(F.col("flags")))
    sold = items.where("l_discount >= 0.07").groupBy("l_orderkey", "l_linenumber", "l_discount").count()
    below = node(sold, F.col("l_orderkey"), F.concat(number, F.lit("d"), (F.col("l_discount") * 100).cast("int").cast("string")), number, (F.col("l_discount") * 100).cast("int"), F.lit("d"), "text", 2, F.array(F.lit(""), F.lit("m")), F.concat(F.lit("discount "), (F.col("l_discount") * 100).cast("int").cast("string")))
    nodes = clustered(root.unionByName(lines).unionByName(below), "root_id")
    pages = nodes.select("root_id", "node_id", F.lit(1).alias("number"), F.col("page").alias("text"), F.when(F.col("kind") == "pdf", "ocr").otherwise("attachment").alias("source"))
    return nodes.drop("page"), pages


SQL_ORDER_TREES = f"""n AS (
 SELECT o_orderkey AS root_id, 'o' AS node_id, NULL AS parent_id, 0 AS pos, CASE WHEN o_orderkey % 143 = 0 THEN 1 ELSE 0 END AS name_secrets, 'pdf' AS kind, 1 AS images, 1 AS said, o_orderstatus AS meta, ' order ' || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN ' {AWS}' ELSE '' END AS page FROM orders
 UNION ALL SELECT l_orderkey, 'l' || l_linenumber, 'o', l_linenumber, 0, CASE WHEN l_linenumber = 5 THEN 'text' ELSE 'pdf' END, 0, 0, '',
  CASE WHEN max(l_quantity) = 50 AND l_linenumber > 2 THEN '' ELSE min(l_returnflag || '/' || l_linestatus) || CASE WHEN l_linenumber = 4 THEN ' {AWS}' ELSE '' END END FROM lineitem GROUP BY l_orderkey, l_linenumber
 UNION ALL SELECT DISTINCT l_orderkey, 'l' || l_linenumber || 'd' || trunc(l_discount * 100)::INT, 'l' || l_linenumber, trunc(l_discount * 100)::INT, 0, 'text', 2, 1, 'm', 'discount ' || trunc(l_discount * 100)::INT FROM lineitem WHERE l_discount >= 0.07),
t AS (SELECT n.*, 0 AS depth, []::BIGINT[] AS path FROM n WHERE parent_id IS NULL
 UNION ALL SELECT n.*, t.depth + 1, list_append(t.path, n.pos) FROM n JOIN t ON t.root_id = n.root_id AND t.node_id = n.parent_id),
v AS (SELECT *, count(*) OVER w AS visit, sum(images) OVER w AS i FROM t WINDOW w AS (PARTITION BY root_id ORDER BY path)),
k AS (SELECT root_id, parent_id AS node_id, count(*) AS kids FROM n WHERE parent_id IS NOT NULL GROUP BY ALL),
a AS (SELECT v.*, sum(coalesce(kids, 0)) OVER (PARTITION BY root_id ORDER BY path) AS attachments FROM v LEFT JOIN k USING (root_id, node_id)),
c AS (SELECT root_id, CASE WHEN max(attachments) > 10 OR max(i) > 30 THEN 'INSPECTION_LIMIT' WHEN bool_or(page = '' AND kind <> 'text') THEN 'INSPECTION_FAILED' END AS code FROM a GROUP BY root_id),
o AS (SELECT a.*, trim({sql_redact('page')}) AS text, CASE WHEN page LIKE '%{AWS}%' THEN 1 ELSE 0 END AS secrets FROM a)"""


@query(f"""WITH RECURSIVE {SQL_ORDER_TREES},
sub AS (SELECT root_id, node_id, depth, path, kind || '|' || images || '|' || meta || '|' || page AS own FROM a),
d AS (SELECT x.root_id, x.node_id, x.depth, x.path, string_agg(y.own, '#' ORDER BY y.path) AS digest FROM sub x JOIN sub y ON y.root_id = x.root_id AND y.path[1:x.depth] = x.path GROUP BY ALL),
r AS (SELECT root_id, count(*) FILTER (k = 1) AS reads FROM (SELECT root_id, row_number() OVER (PARTITION BY root_id, depth, digest ORDER BY path) AS k FROM d) GROUP BY root_id),
e AS (SELECT root_id, row_number() OVER (PARTITION BY digest ORDER BY root_id) > 1 AS cache_hit FROM d JOIN c USING (root_id) WHERE depth = 0 AND code IS DISTINCT FROM 'INSPECTION_LIMIT'),
s AS (SELECT root_id, count(*) AS page_count, count(*) - 1 AS attachments, sum(images)::BIGINT AS images, sum(said)::BIGINT + 1 AS metadata, (sum(secrets) + sum(name_secrets))::INT AS secrets, count(*) FILTER (kind = 'pdf') AS ocr FROM o GROUP BY root_id)
SELECT root_id, code, CASE WHEN code IS NULL THEN page_count END AS page_count, CASE WHEN code IS NULL THEN ocr END AS ocr, CASE WHEN code IS NULL THEN attachments END AS attachments, CASE WHEN code IS NULL THEN images END AS images,
 CASE WHEN code IS NULL THEN metadata END AS metadata, CASE WHEN code IS NULL THEN secrets END AS secrets, CASE WHEN code IS DISTINCT FROM 'INSPECTION_LIMIT' THEN reads END AS reads, coalesce(cache_hit, false) AS cache_hit
FROM c JOIN s USING (root_id) JOIN r USING (root_id) LEFT JOIN e USING (root_id)""")
def inspect_trees(spark: SparkSession, d: str) -> DataFrame:
    """A report of each tree; equal attachments are read once."""
    reports, _ = inspect.execute(*order_trees(spark, d))
    secrets = F.aggregate("redactions", F.lit(0), lambda n, r: n + r["count"])
    return reports.select("root_id", "code", "page_count", F.when(F.col("code").isNull(), F.size("ocr_pages").cast("bigint")).alias("ocr"), "attachments", "images", "metadata", secrets.alias("secrets"), "reads", "cache_hit")


@query(f"""WITH RECURSIVE {SQL_ORDER_TREES}
SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY path)::INT AS number, repeat('[Załącznik]' || chr(10), depth) || text AS text, CASE WHEN kind = 'pdf' THEN 'ocr' ELSE 'attachment' END AS source
FROM o JOIN c USING (root_id) WHERE code IS NULL""")
def inspect_tree_pages(spark: SparkSession, d: str) -> DataFrame:
    """The redacted pages of each tree, attachments behind what holds them."""
    _, pages = inspect.execute(*order_trees(spark, d))
    return pages


# ------------------------------------------------------------------ objects of PDFs


def order_objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Objects and entries of one document for each customer: an order is an object that leads to two others of its customer."""
    by = W.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("k"), F.count("*").over(by).alias("n"))
    turn = F.col("o_orderkey") % 8
    kind = F.when(F.col("o_orderkey") % 101 == 0, "invalid").when(turn == 0, "stream").when(turn == 1, "string").when(turn == 2, "name").when(turn == 3, "array").otherwise("dict")
    secret = F.when(F.col("o_orderkey") % 17 == 0, f" {AWS}").otherwise("")
    text = F.when(turn == 0, F.concat(F.lit("BT ("), "o_orderpriority", F.lit(") Tj"), secret)).when(turn <= 2, F.concat("o_orderpriority", secret))
    o = o.withColumns({"kind": kind, "text": text})
    found = o.select(F.col("o_custkey").alias("doc_id"), F.col("k").alias("object_id"), (F.col("k") % 5 == 0).alias("indirect"), "kind", F.lit(None).cast("string").alias("type"), "text", F.length("text").cast("bigint").alias("size"))
    entry = lambda key, child: o.select(F.col("o_custkey").alias("doc_id"), F.col("k").alias("parent_id"), key.alias("key"), child.cast("int").alias("child_id"))
    first = entry(F.when(F.col("o_orderkey") % 61 == 0, "JS").otherwise("A"), (F.col("k") * 2 + 1) % F.col("n"))
    return found, first.unionAll(entry(F.lit("B"), (F.col("k") * 3 + 2) % F.col("n")))


NESTING, OBJECTS = 3, 14


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey AS ok,
  CASE WHEN o_orderkey % 101 = 0 THEN 'invalid' ELSE ['stream', 'string', 'name', 'array', 'dict', 'dict', 'dict', 'dict'][o_orderkey % 8 + 1] END AS kind,
  CASE o_orderkey % 8 WHEN 0 THEN 'BT (' || o_orderpriority || ') Tj' WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderpriority END || CASE WHEN o_orderkey % 17 = 0 THEN ' {AWS}' ELSE '' END AS text, length(o_orderpriority) AS inner_size FROM orders),
e AS (SELECT doc_id, k AS p, CASE WHEN ok % 61 = 0 THEN 'JS' ELSE 'A' END AS key, (2 * k + 1) % n AS c FROM o UNION ALL SELECT doc_id, k, 'B', (3 * k + 2) % n FROM o),
r AS (SELECT doc_id, k, 0 AS depth FROM o WHERE k % 5 = 0 UNION SELECT e.doc_id, e.c, r.depth + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.p = r.k WHERE r.depth <= {NESTING}),
m AS (SELECT doc_id, k, min(depth) AS depth FROM r GROUP BY ALL), j AS (SELECT * FROM m JOIN o USING (doc_id, k)),
bad AS (SELECT doc_id, 'INSPECTION_LIMIT' AS code, -1 AS depth, 0 AS rank FROM m GROUP BY doc_id HAVING count(*) > {OBJECTS} OR max(depth) > {NESTING}
 UNION ALL SELECT doc_id, 'INSPECTION_FAILED', depth, 1 FROM j WHERE kind = 'invalid'
 UNION ALL SELECT doc_id, 'ATTACHMENT_UNSUPPORTED', depth, 2 FROM j JOIN e USING (doc_id) WHERE e.p = j.k AND e.key = 'JS' AND kind IN ('dict', 'stream')),
b AS (SELECT doc_id, arg_min(code, (depth, rank)) AS code FROM bad GROUP BY doc_id)
SELECT doc_id, code, CASE WHEN code IS NULL THEN count(*) END AS objects, CASE WHEN code IS NULL THEN count(*) FILTER (kind IN ('string', 'name', 'stream')) + count(*) FILTER (kind = 'stream') END AS strings,
 CASE WHEN code IS NULL THEN coalesce(sum(length(text) + CASE WHEN kind = 'stream' THEN inner_size ELSE 0 END) FILTER (kind IN ('string', 'name', 'stream')), 0)::BIGINT END AS decoded,
 CASE WHEN code IS NULL THEN count(*) FILTER (kind IN ('string', 'name', 'stream') AND ok % 17 = 0)::INT END AS secrets
FROM j LEFT JOIN b USING (doc_id) GROUP BY doc_id, code""")
def pdf_object_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every object that a document's indirect objects hold, over references with cycles."""
    r = objects.scan(*order_objects(spark, d), max_depth=NESTING, max_objects=OBJECTS)
    secrets = F.aggregate("redactions", F.lit(0), lambda n, f: n + f["count"])
    return r.select("doc_id", "code", "objects", "strings", "decoded", secrets.alias("secrets"))


def order_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """File specifications of one document for each customer: an order specifies one of seven streams; some names are
    dangling or no strings, some specifications have no file."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ok"), F.concat(F.lit("file "), "o_orderpriority", F.lit(".pdf")).alias("name"))
    null = F.lit(None).cast("string")

    def thing(df, id_, kind, type_=null, text=null, size=None):
        return df.select("doc_id", id_.cast("bigint").alias("object_id"), kind.alias("kind"), type_.alias("type"), text.alias("text"), (F.lit(None) if size is None else size).cast("bigint").alias("size"))

    spec, ok = F.col("ok") * 4, F.col("ok")
    streams = o.select("doc_id", (ok % 7).alias("s")).distinct()
    found = thing(o, spec, F.lit("dict"), F.lit("Filespec")).unionAll(thing(o.where("ok % 211 <> 0"), spec + 1, F.lit("dict")))
    found = found.unionAll(thing(o, spec + 2, F.when(ok % 223 == 0, "array").otherwise("string"), null, F.col("name"))).unionAll(thing(streams, -F.col("s") - 1, F.lit("stream"), F.lit("EmbeddedFile"), null, F.col("s") * 100))

    def entry(df, parent, key, child):
        return df.select("doc_id", parent.cast("bigint").alias("parent_id"), F.lit(key).alias("key"), child.cast("bigint").alias("child_id"))

    entries = entry(o, spec, "EF", spec + 1).unionAll(entry(o, spec + 1, "F", -(ok % 7) - 1)).unionAll(entry(o.where("ok % 3 <> 0"), spec, "F", spec + 2))
    return found, entries.unionAll(entry(o.where("ok % 5 = 0"), spec, "UF", spec + 3))


SQL_FILES = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'embedded.bin' WHEN o_orderkey % 223 <> 0 THEN 'file ' || o_orderpriority || '.pdf' END AS name FROM orders),
c AS (SELECT doc_id, CASE WHEN bool_or(name IS NULL AND ok % 211 <> 0) THEN 'INSPECTION_FAILED' WHEN bool_or(ok % 211 = 0) THEN 'ATTACHMENT_UNSUPPORTED' END AS code,
 count(DISTINCT ok % 7) AS n, count(*) FILTER (ok % 5 = 0) + count(*) FILTER (ok % 211 = 0) AS dangling FROM o GROUP BY doc_id)"""


@query(f"WITH {SQL_FILES} SELECT doc_id, -(ok % 7) - 1 AS stream_id, arg_max(name, ok) AS name, (ok % 7) * 100 AS size FROM o JOIN c USING (doc_id) WHERE code IS NULL GROUP BY doc_id, ok % 7")
def embedded_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that specifications name, each stream once."""
    return objects.embedded_files(*order_files(spark, d))[0]


@query(f"WITH {SQL_FILES} SELECT doc_id, code, CASE WHEN code IS NULL THEN n END AS files, dangling FROM c")
def embedded_file_documents(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each document with embedded files, and its dangling references."""
    return objects.embedded_files(*order_files(spark, d))[1]
