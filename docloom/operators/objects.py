"""Objects of PDFs as tables: what can be reached, what is forbidden, what is said, and which files are embedded.

objects: doc_id, object_id, indirect, kind (dict, array, stream, string, name, invalid, other), type (the name under Type), text (a string's, name's or
stream's decoded text), size (decoded bytes).
entries: doc_id, parent_id, key (null in arrays), child_id; a child that is no object is a dangling reference, which says nothing.

Documents are visited side by side, level by level: each round joins the objects met last with their entries and keeps what
was not met before, so that cycles end and a document costs one row for each of its objects. A document that passes a limit is
not followed any further.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas as S
from docloom.durable import durable
from docloom.functions import security
from docloom.operators import state
from docloom.sources import files

#: Limits of a document's objects, entries that may not be there.
MAX_OBJECTS, MAX_NESTING = 50_000, 50
FORBIDDEN = ["JS", "JavaScript", "AA", "XFA", "RichMedia", "OCProperties", "Launch"]
#: Fixed value: the name of a file that has none.
UNNAMED = "embedded.bin"


def reach(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_NESTING, max_objects: int = MAX_OBJECTS) -> DataFrame:
    """doc_id, object_id, depth: what roots (doc_id, object_id) reach over edges (doc_id, parent_id, child_id), with the least number of
    steps. A document is followed to max_depth + 1 steps and until it has more than max_objects: `limits` tells which have
    passed either. The number of rounds is that of steps; each writes what is new in it."""
    edges = edges.select("doc_id", F.col("parent_id").alias("object_id"), "child_id").where("object_id is not null and child_id is not null")
    levels = [durable(roots.select("doc_id", "object_id", F.lit(0).alias("depth")).distinct())]
    front = levels[0]
    for depth in range(1, max_depth + 2):
        seen = reduce(DataFrame.unionAll, levels)
        full = seen.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max_objects)
        step = front.join(full, "doc_id", "left_anti").join(edges, ["doc_id", "object_id"]).select("doc_id", F.col("child_id").alias("object_id")).distinct()
        front = durable(step.join(seen, ["doc_id", "object_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.unionAll, levels)


def limits(reached: DataFrame, max_depth: int = MAX_NESTING, max_objects: int = MAX_OBJECTS) -> DataFrame:
    """doc_id, code of the documents that went too deep or have too many objects."""
    n = reached.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))
    return n.where((F.col("n") > max_objects) | (F.col("deepest") > max_depth)).select("doc_id", F.lit("INSPECTION_LIMIT").alias("code"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def literals(content: pd.Series) -> pd.Series:
    """The literal and hexadecimal strings of a content stream."""
    return content.map(lambda b: files.stream_strings(bytes(b or b"")))


def scan(objects: DataFrame, entries: DataFrame, max_depth: int = MAX_NESTING, max_objects: int = MAX_OBJECTS, max_decoded: int = state.LIMITS["decoded"]) -> DataFrame:
    """doc_id, code, objects, strings, decoded, redactions: every object that the indirect ones hold, in a row for each document.

    Strings, names and streams count as said, and so do the strings within a stream. The code is what is met first, by
    depth: a limit, an invalid object (INSPECTION_FAILED), a forbidden entry (ATTACHMENT_UNSUPPORTED). A document with a code
    says no more. Rows that repeat an object count once; nulls are no text; empty tables give no rows."""
    objects = objects.select("doc_id", "object_id", "indirect", "kind", "text", "size").dropDuplicates(["doc_id", "object_id"])
    known = entries.select("doc_id", "parent_id", "key", "child_id")
    held = known.join(objects.select("doc_id", F.col("object_id").alias("child_id")), ["doc_id", "child_id"], "left_semi")
    met = durable(reach(objects.where("indirect"), held, max_depth, max_objects))
    limit = limits(met, max_depth, max_objects).withColumn("rank", F.lit(0)).withColumn("depth", F.lit(-1))
    own = durable(met.join(objects, ["doc_id", "object_id"]))
    invalid = own.where("kind = 'invalid'").select("doc_id", F.lit("INSPECTION_FAILED").alias("code"), F.lit(1).alias("rank"), "depth")
    dicts = own.where("kind in ('dict', 'stream')").select("doc_id", F.col("object_id").alias("parent_id"), "depth")
    forbidden = known.where(F.col("key").isin(FORBIDDEN)).join(dicts, ["doc_id", "parent_id"])
    forbidden = forbidden.select("doc_id", F.lit("ATTACHMENT_UNSUPPORTED").alias("code"), F.lit(2).alias("rank"), "depth")
    refused = limit.unionByName(invalid).unionByName(forbidden).groupBy("doc_id").agg(F.min_by("code", F.struct("depth", "rank")).alias("code"))

    said = own.where("kind in ('string', 'name', 'stream')").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("size", F.length("text"), F.lit(0)).alias("size"))
    # strings within streams: only a text with a bracket goes to Python
    streams = own.where("kind = 'stream'").where(F.col("text").rlike(r"[(<]"))
    within = streams.select("doc_id", F.explode(literals(F.encode("text", "ISO-8859-1"))).alias("b")).select("doc_id", files.decode_pdf_string(F.col("b")).alias("text"))
    said = said.unionByName(within.withColumn("size", F.length("text"))).withColumn("found", security.findings(F.col("text")))
    sums = said.groupBy("doc_id").agg(F.count("*").alias("strings"), F.sum("size").cast("bigint").alias("decoded"))
    counts = said.select("doc_id", F.explode("found").alias("f")).groupBy("doc_id", "f.kind").agg(F.sum("f.count").cast("int").alias("count"))
    counts = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "count"))).alias("redactions"))
    out = met.groupBy("doc_id").agg(F.count("*").alias("objects")).join(refused, "doc_id", "left").join(sums, "doc_id", "left").join(counts, "doc_id", "left")
    code = F.coalesce("code", F.when(F.col("decoded") > max_decoded, "INSPECTION_LIMIT"))
    out = out.withColumn("code", code)
    ok = lambda c: F.when(F.col("code").isNull(), c)
    none = F.array().cast("array<struct<kind:string,count:int>>")
    return out.select("doc_id", "code", ok(F.col("objects")).alias("objects"), ok(F.coalesce("strings", F.lit(0))).alias("strings"), ok(F.coalesce("decoded", F.lit(0))).alias("decoded"), ok(F.coalesce("redactions", none)).alias("redactions"))


def embedded_files(objects: DataFrame, entries: DataFrame, most: int = state.LIMITS["attachments"], most_bytes: int = state.LIMITS["attachment_bytes"]) -> tuple[DataFrame, DataFrame]:
    """(files, documents). files: doc_id, stream_id, name, size; documents: doc_id, code, files, dangling (references of file specifications to
    what is not there).

    A file specification is a dictionary with an entry EF, a dictionary of streams; its name is the string under UF, else under F. A stream
    in several specifications is one file with the name of the last (by object_id), and a stream of type EmbeddedFile in none is
    a file without a name. A document with a code has no files: a specification without EF or with something else than streams in it is
    ATTACHMENT_UNSUPPORTED; an EF that is no dictionary or empty, a name that is no string or not 1 to 255 long is INSPECTION_FAILED; too many
    or too large files are INSPECTION_LIMIT, which goes before the others. Rows that repeat an object count once."""
    o = objects.select("doc_id", "object_id", "kind", "type", "text", "size").dropDuplicates(["doc_id", "object_id"])
    e = entries.select("doc_id", "parent_id", "key", "child_id").where("key is not null").dropDuplicates(["doc_id", "parent_id", "key"])
    child = o.select("doc_id", F.col("object_id").alias("child_id"), F.col("kind").alias("c_kind"), F.col("type").alias("c_type"), F.col("text").alias("c_text"), F.col("size").alias("c_size"))
    # each dictionary's entries that matter, looked up; a dangling one is as if it were not there
    spec = durable(e.where(F.col("key").isin("EF", "UF", "F")).join(child, ["doc_id", "child_id"], "left"))
    there = F.col("c_kind").isNotNull()
    entry = lambda key: F.max(F.when((F.col("key") == key) & there, F.struct("child_id", F.col("c_kind").alias("kind"), F.col("c_text").alias("text"))))
    dicts = o.where("kind = 'dict'").select("doc_id", F.col("object_id").alias("parent_id"), "type")
    of = spec.groupBy("doc_id", "parent_id").agg(entry("EF").alias("ef"), entry("UF").alias("uf"), entry("F").alias("f"))
    specs = dicts.join(of, ["doc_id", "parent_id"], "left").where(F.col("ef").isNotNull() | (F.col("type") == "Filespec"))
    specs = durable(specs.withColumn("said", F.coalesce("uf", "f")))
    name = F.when(F.col("said").isNull(), UNNAMED).when(F.col("said.kind") == "string", F.coalesce("said.text", F.lit("")))
    # what EF holds
    held = specs.where("ef is not null").select("doc_id", F.col("parent_id").alias("spec_id"), F.col("ef.child_id").alias("parent_id"), F.col("ef.kind").alias("ef_kind"), name.alias("name"))
    held = durable(held.join(e, ["doc_id", "parent_id"], "left").join(child, ["doc_id", "child_id"], "left"))

    bad = lambda df, code, rank: df.select("doc_id", F.lit(code).alias("code"), F.lit(rank).alias("rank"))
    problems = [
        bad(specs.where("ef is null"), "ATTACHMENT_UNSUPPORTED", 2),
        bad(held.where("ef_kind <> 'dict' or key is null or name is null or length(name) not between 1 and 255"), "INSPECTION_FAILED", 1),
        bad(held.where("ef_kind = 'dict' and key is not null and (c_kind is null or c_kind <> 'stream')"), "ATTACHMENT_UNSUPPORTED", 2),
    ]
    named = held.where("c_kind = 'stream'").groupBy("doc_id", F.col("child_id").alias("stream_id")).agg(F.max_by("name", "spec_id").alias("name"), F.max("c_size").alias("size"))
    alone = o.where("kind = 'stream' and type = 'EmbeddedFile'").select("doc_id", F.col("object_id").alias("stream_id"), F.lit(UNNAMED).alias("name"), "size")
    found = durable(named.unionByName(alone.join(named, ["doc_id", "stream_id"], "left_anti")))
    total = found.groupBy("doc_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    problems.append(bad(total.where((F.col("files") > most) | (F.col("bytes") > most_bytes) | (F.col("largest") > S.MAX_FILE_BYTES)), "INSPECTION_LIMIT", 0))
    code = reduce(DataFrame.unionAll, problems).groupBy("doc_id").agg(F.min_by("code", "rank").alias("code"))
    lost = spec.where(~there).groupBy("doc_id").agg(F.count("*").alias("dangling"))
    documents = o.select("doc_id").distinct().join(code, "doc_id", "left").join(total, "doc_id", "left").join(lost, "doc_id", "left")
    files_found = found.join(code, "doc_id", "left_anti").select("doc_id", "stream_id", "name", "size")
    return files_found, documents.select("doc_id", "code", F.when(F.col("code").isNull(), F.coalesce("files", F.lit(0))).alias("files"), F.coalesce("dangling", F.lit(0)).alias("dangling"))
