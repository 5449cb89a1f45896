"""Registered queries of JSON texts: strict reading, flattening, the keyword filter. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import query
from docloom.session import table
from docloom.sources import json_tree

#: Requests made of events, good and bad, as an expression that both engines read.
REQUEST_TEXT = """CASE event_id % 8
 WHEN 0 THEN props WHEN 3 THEN substr(props, 1, 5) WHEN 4 THEN concat('[', props, ']')
 WHEN 1 THEN concat('{"fileName":"e', event_id, '.pdf","pageCount":1,"pages":[{"number":1,"text":"', event_type, '"}]}')
 WHEN 2 THEN concat('{"fileName":"e', event_id, '.pdf","pageCount":1,"pages":[{"number":"1","text":"x","meta":', props, '},{"number":2}],"n":', props, '}')
 WHEN 5 THEN concat('{"fileName":"e', event_id, '.pdf","pageCount":1,"pages":[],"inspection":{"profile":"p","images":', event_id, ',"own":', props, '}}')
 WHEN 6 THEN concat('{"fileName":null,"pageCount":2.0,"pages":[{"number":1,"text":"', event_type, '","source":null},', event_id, ']}')
 WHEN 7 THEN concat('{"fileName":"x","pageCount":1.5,"pages":', props, '}') END"""

SQL_WANT = """(SELECT * FROM (VALUES ('', 'fileName', 'string', true), ('', 'pageCount', 'integer', true), ('', 'pages', 'array', true), ('', 'inspection', 'object', false),
 ('pages', 'number', 'integer', true), ('pages', 'text', 'string', true), ('pages', 'source', 'string', false),
 ('inspection', 'profile', 'string', true), ('inspection', 'attachments', 'integer', true), ('inspection', 'images', 'integer', true), ('inspection', 'barcodes', 'integer', true), ('inspection', 'metadata', 'integer', true),
 ('inspection', 'cacheHit', 'boolean', true), ('inspection', 'redactions', 'array', true)) AS t(owner, name, want, required))"""
SQL_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN CASE WHEN {0}::DOUBLE = floor({0}::DOUBLE) THEN 'integer' ELSE 'number' END ELSE 'integer' END"


@query(f"""WITH t AS (SELECT event_id, {REQUEST_TEXT} AS text FROM events), j AS (SELECT event_id, text::JSON AS x FROM t WHERE json_valid(text)),
o AS (SELECT event_id, '' AS owner, '' AS loc, x FROM j
 UNION ALL SELECT event_id, 'inspection', 'inspection', json_extract(x, '$.inspection') FROM j WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.inspection') = 'OBJECT'
 UNION ALL SELECT event_id, 'pages', 'pages.' || i, json_extract(x, '$.pages[' || i || ']') FROM (SELECT *, unnest(range(json_array_length(x, '$.pages')::BIGINT)) AS i FROM j WHERE json_type(x, '$.pages') = 'ARRAY')),
k AS (SELECT event_id, owner, loc, x, unnest(json_keys(x)) AS name FROM o WHERE json_type(x) = 'OBJECT'),
f AS (SELECT k.*, w.want, {SQL_KIND.format("json_extract(k.x, '$.' || k.name)")} AS got FROM k LEFT JOIN {SQL_WANT} w USING (owner, name))
SELECT event_id, '(root)' AS path, 'Invalid JSON.' AS message FROM t WHERE NOT json_valid(text)
UNION ALL SELECT event_id, CASE loc WHEN '' THEN '(root)' ELSE loc END, 'Expected object, received ' || replace({SQL_KIND.format('x')}, 'integer', 'number') || '.' FROM o WHERE json_type(x) <> 'OBJECT'
UNION ALL SELECT event_id, CASE loc WHEN '' THEN '(root)' ELSE loc END, 'Unrecognized key: "' || name || '".' FROM f WHERE want IS NULL
UNION ALL SELECT event_id, ltrim(loc || '.' || name, '.'), 'Expected ' || want || ', received ' || replace(got, 'integer', 'number') || '.' FROM f WHERE want <> got
UNION ALL SELECT o.event_id, ltrim(loc || '.' || w.name, '.'), 'Expected ' || want || ', received nothing.' FROM o JOIN {SQL_WANT} w USING (owner) WHERE json_type(x) = 'OBJECT' AND required AND NOT list_contains(json_keys(x), w.name)""")
def strict_requests(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with requests as JSON, at every depth."""
    found = json_tree.issues(table(spark, d, "events"), F.col("event_id"), F.expr(REQUEST_TEXT), json_tree.REQUEST_JSON)
    return found.select(F.col("id").alias("event_id"), F.explode("issues").alias("i")).select("event_id", "i.path", "i.message")


@query(f"SELECT event_id AS doc_id, 'e' || event_id || '.pdf' AS file_name, 1 AS page_count, 1 AS pages, length(event_type) AS chars FROM (SELECT *, {REQUEST_TEXT} AS text FROM events) WHERE json_valid(text) AND event_id % 8 = 1")
def read_requests(spark: SparkSession, d: str) -> DataFrame:
    """The requests that are as the schema has them."""
    good, _ = json_tree.read_strictly(table(spark, d, "events"), F.col("event_id"), F.expr(REQUEST_TEXT))
    return good.select("doc_id", "file_name", "page_count", F.size("pages").alias("pages"), F.length(F.col("pages")[0]["text"]).alias("chars"))


METADATA_TEXT = """CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 4) ELSE concat('{"p":', props, ',"t":["', event_type, '",null,', event_id, ',{},[],{"a b":[true,"', event_type, '"]}]}') END"""


@query(f"""SELECT event_id, regexp_replace(regexp_replace(fullkey, '\\[(\\d+)\\]', '.\\1', 'g'), '^\\$\\.|"', '', 'g') AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
 CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN value->>'$' END AS value
FROM (SELECT event_id, {METADATA_TEXT} AS text FROM events WHERE event_id % 50 <> 0) e, json_tree(e.text) j WHERE type NOT IN ('OBJECT', 'ARRAY') OR value::VARCHAR IN ('{{}}', '[]')""")
def metadata_values(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as paths and values."""
    values, _ = json_tree.flattened(table(spark, d, "events"), F.col("event_id"), F.expr(METADATA_TEXT))
    return values.withColumnRenamed("id", "event_id")


@query(f"""SELECT code, count(*) AS texts, sum(nodes)::BIGINT AS nodes FROM (SELECT CASE WHEN json_valid(text) THEN NULL ELSE 'INSPECTION_FAILED' END AS code, CASE WHEN json_valid(text) THEN (SELECT count(*) FROM json_tree(CASE WHEN json_valid(e.text) THEN e.text ELSE '0' END)) ELSE 1 END AS nodes
 FROM (SELECT {METADATA_TEXT} AS text FROM events) e) GROUP BY code""")
def metadata_reports(spark: SparkSession, d: str) -> DataFrame:
    """How many metadata texts can be used, with their nodes."""
    reports = json_tree.measured(table(spark, d, "events"), F.col("event_id"), F.expr(METADATA_TEXT))
    return reports.groupBy("code").agg(F.count("*").alias("texts"), F.sum("nodes").alias("nodes"))


SCHEMA_TEXT = """concat('{"$schema":"s","type":"object","properties":{"', p_brand, '":{"type":"array","pattern":"', p_type, '","maxItems":', p_size, ',"items":{"type":"string","const":1}},"pattern":{"title":"x","enum":["', p_name, '",null]}},"required":["', p_brand, '"],"additionalProperties":false}')"""


@query("""SELECT p_partkey, md5('{"properties":{"' || p_brand || '":{"items":{"type":"string"},' || CASE WHEN p_size > 20 THEN '' ELSE '"maxItems":' || p_size || ',' END || '"type":"array"},"pattern":{"enum":["' || p_name || '",null]}},"required":["' || p_brand || '"],"type":"object"}') AS digest FROM part""")
def schema_keywords(spark: SparkSession, d: str) -> DataFrame:
    """JSON schemas with nothing but what a model's service takes."""
    schemas, _ = json_tree.schema_for_model(table(spark, d, "part"), F.col("p_partkey"), F.expr(SCHEMA_TEXT))
    return schemas.select(F.col("id").alias("p_partkey"), F.md5(F.col("json").cast("binary")).alias("digest"))
