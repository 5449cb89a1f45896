"""JSON texts as rows of their nodes: taken apart level by level, checked against a schema, filtered, put together again.

A node has id, steps (array<struct<key, pos>> from the root down; a null key is an array's element), depth, kind (object, array, string,
number, boolean, null; invalid: the text is no JSON), value (a scalar's text), literal (a scalar as JSON) and filled (a container that
holds something). Each level is one explode
of the variants of the level above, written once; a text costs a row for each of its nodes, and no Python.

A text that repeats a key within an object counts as no JSON. Null texts are no JSON either; ids may be null or repeat, but
`rebuilt` and `issues` need one id a text. Extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas as S
from docloom.durable import durable

STEPS = "array<struct<key:string,pos:int>>"
NODE = ("id", "steps", "depth", "kind", "value", "literal", "filled")


def _described(level: DataFrame) -> DataFrame:
    said = F.schema_of_variant("v")
    kind = (
        F.when(F.col("v").isNull(), "invalid").when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string")
        .when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").otherwise("number")
    )
    d = level.withColumn("kind", kind)
    scalar = F.col("kind").isin("string", "number", "boolean", "null")
    filled = ((F.col("kind") == "object") & (said != "OBJECT<>")) | ((F.col("kind") == "array") & F.try_variant_get("v", "$[0]", "variant").isNotNull())
    return d.withColumns({"filled": filled, "value": F.when(scalar, F.variant_get("v", "$", "string")), "literal": F.when(scalar, F.to_json("v"))})


def nodes(df: DataFrame, id_: Column, text: Column, max_depth: int = 32) -> DataFrame:
    """The nodes of each text down to max_depth; what lies deeper is told by containers at that depth (`too_deep`)."""
    level = df.select(id_.alias("id"), F.try_parse_json(text).alias("v"), F.array().cast(STEPS).alias("steps"), F.lit(0).alias("depth"))
    level = durable(_described(level))
    out = [level.select(*NODE)]
    for depth in range(1, max_depth + 1):
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        held = inner.select("id", "steps", "v")
        below = held.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "child"))
        steps = F.concat("steps", F.array(F.struct(F.col("key").alias("key"), F.col("pos").cast("int").alias("pos"))))
        level = durable(_described(below.select("id", F.col("child").alias("v"), steps.cast(STEPS).alias("steps"), F.lit(depth).alias("depth"))))
        out.append(level.select(*NODE))
    return reduce(DataFrame.unionAll, out)


def path(steps: Column) -> Column:
    """A path as validation reports it: keys and places joined by points, (root) for none."""
    parts = F.transform(steps, lambda s: F.coalesce(s["key"], s["pos"].cast("string")))
    return F.when(F.size(steps) == 0, "(root)").otherwise(F.array_join(parts, "."))


def above(steps: Column) -> Column:
    return F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))


# ------------------------------------------------------------------ strict reading

KINDS = {T.StringType: "string", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object"}
ANY = "*"


def declared(schema: T.DataType) -> list[tuple[str, str, str, str, bool, bool]]:
    """(pattern, above, key, kind, required, nullable) of each node that a schema knows; fields that are not nullable are required, and a
    field's metadata {"null": True} lets it be null."""
    out = []

    def walk(pattern, parent, key, t, required, nullable):
        out.append((pattern, parent, key, KINDS[type(t)], required, nullable))
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{pattern}.{f.name}", pattern, f.name, f.dataType, not f.nullable, bool((f.metadata or {}).get("null")))
        elif isinstance(t, T.ArrayType):
            walk(f"{pattern}.{ANY}", pattern, ANY, t.elementType, False, False)

    walk("", "", "", schema, True, False)
    return out


def issues(df: DataFrame, id_: Column, text: Column, schema: T.StructType, most: int = 20) -> DataFrame:
    """id, issues (array<struct<path, message>>, by path, the first `most`) of every text that a schema does not take as it is: no JSON,
    a wrong type, a key that is not known, a field that is missing, at every depth that the schema has. Texts without an issue have no
    row. The schema's rows are constants of its size and broadcast."""
    spark = df.sparkSession
    rows = declared(schema)
    deepest = max(p.count(".") for p, *_ in rows) + 1
    names = "pattern string, above string, name string, want string, required boolean, nullable boolean"
    known = F.broadcast(spark.createDataFrame(rows, names))
    n = durable(nodes(df, id_, text, deepest))
    pattern = F.array_join(F.concat(F.array(F.lit("")), F.transform("steps", lambda s: F.when(s["key"].isNull(), ANY).otherwise(s["key"]))), ".")
    up = F.array_join(F.concat(F.array(F.lit("")), F.transform(above(F.col("steps")), lambda s: F.when(s["key"].isNull(), ANY).otherwise(s["key"]))), ".")
    last = F.get("steps", F.size("steps") - 1)["key"]
    n = n.withColumns({"pattern": pattern, "up": up, "last": last})
    d = n.join(known.drop("above", "name"), "pattern", "left")
    whole = F.col("value").try_cast("double")
    fits = (F.col("kind") == F.col("want")) | ((F.col("want") == "integer") & (F.col("kind") == "number") & (whole == F.floor(whole))) | ((F.col("kind") == "null") & F.col("nullable"))
    d = durable(d.withColumn("fits", F.coalesce(fits, F.lit(False))))
    broken = d.where("kind = 'invalid'").select("id", F.lit("(root)").alias("path"), F.lit("Invalid JSON.").alias("message"))
    got = F.when((F.col("want") == "integer") & (F.col("kind") == "number"), "number").otherwise(F.col("kind"))
    wrong = d.where("want is not null and not fits and kind <> 'invalid'").select("id", path(F.col("steps")).alias("path"), F.concat(F.lit("Expected "), "want", F.lit(", received "), got, F.lit(".")).alias("message"))
    objects = d.where("fits and kind = 'object'").select("id", "steps", "pattern")
    loose = d.where("want is null and depth > 0 and last is not null")
    owner = objects.select("id", F.col("steps").alias("__up"), F.col("pattern").alias("up"))
    unknown = loose.withColumn("__up", above(F.col("steps"))).join(owner, ["id", "__up", "up"], "left_semi")
    unknown = unknown.select("id", path(F.col("__up")).alias("path"), F.concat(F.lit('Unrecognized key: "'), "last", F.lit('".')).alias("message"))
    asked = objects.join(known.where("required and pattern <> ''").select(F.col("above").alias("pattern"), "name", "want"), "pattern")
    there = d.where("depth > 0").select("id", above(F.col("steps")).alias("steps"), F.col("last").alias("name"))
    missing = asked.join(there, ["id", "steps", "name"], "left_anti")
    child = F.when(F.size("steps") == 0, F.col("name")).otherwise(F.concat(path(F.col("steps")), F.lit("."), "name"))
    missing = missing.select("id", child.alias("path"), F.concat(F.lit("Expected "), "want", F.lit(", received nothing.")).alias("message"))
    found = broken.unionAll(wrong).unionAll(unknown).unionAll(missing)
    first = F.row_number().over(W.partitionBy("id").orderBy("path", "message"))
    few = found.withColumn("__k", first).where(F.col("__k") <= most)
    return few.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "message"))).alias("issues"))


def _field(name, kind, required=True):
    return T.StructField(name, kind, not required)


#: Requests as JSON: the same fields as schemas.REQUEST, by the contract's names.
INSPECTION_JSON = T.StructType([
    _field("profile", T.StringType()), *[_field(c, T.IntegerType()) for c in ("attachments", "images", "barcodes", "metadata")], _field("cacheHit", T.BooleanType()),
    _field("redactions", T.ArrayType(T.StructType([_field("kind", T.StringType()), _field("count", T.IntegerType())]))),
])
REQUEST_JSON = T.StructType([
    _field("fileName", T.StringType()), _field("pageCount", T.IntegerType()),
    _field("pages", T.ArrayType(T.StructType([_field("number", T.IntegerType()), _field("text", T.StringType()), _field("source", T.StringType(), False)]))),
    _field("inspection", INSPECTION_JSON, False),
])


def _loose(t: T.DataType) -> T.DataType:
    """A type whose whole numbers may be written with a fraction of nothing, as JSON takes them."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_loose(t.elementType))
    return T.DoubleType() if isinstance(t, T.IntegerType) else t


def read_strictly(df: DataFrame, id_: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, errors): the texts as rows of schemas.REQUEST (doc_id is the id), and those that can't be one as doc_id, code, issues. No text
    vanishes; what the types allow is for `validate.request_issues` to judge."""
    bad = durable(issues(df, id_, text, REQUEST_JSON))
    rows = df.select(id_.alias("doc_id"), F.from_json(text, _loose(REQUEST_JSON)).alias("r")).join(bad.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    good = rows.select("doc_id", F.col("r.fileName").alias("file_name"), F.col("r.pageCount").cast("int").alias("page_count"), F.col("r.pages").cast(f"array<{S.PAGE}>").alias("pages"), F.col("r.inspection").cast(S.INSPECTION).alias("inspection"))
    code = F.when(F.col("issues")[0]["message"] == "Invalid JSON.", "BAD_REQUEST").otherwise("VALIDATION_FAILED")
    return good, bad.select(F.col("id").alias("doc_id"), code.alias("code"), "issues")


# ------------------------------------------------------------------ flattening and filtering


def measures(text: Column, max_depth: int) -> Column:
    """struct<at, nodes, depth, deep> of a text that is JSON: how many nodes it has down to max_depth, how deep they go, and whether a container lies
    at max_depth. A fold over brackets and scalars, so that no text is taken apart to be counted and no rows are grouped. at is the
    depth that is left open, 0 at the end."""
    bare = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    # without escapes a string ends at its next quote: keys go, strings become one character
    bare = F.regexp_replace(F.regexp_replace(bare, r'"[^"]*"\s*:', ""), '"[^"]*"', "s")
    tokens = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]|[^\s,\[\]{}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nodes"), F.lit(-1).alias("depth"), F.lit(False).alias("deep"))

    def step(s, t):
        opens, closes = t.isin("[", "{"), t.isin("]", "}")
        seen = ~closes & (s["at"] <= max_depth)
        at = s["at"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        after = F.struct(
            at.alias("at"), (s["nodes"] + F.when(seen, 1).otherwise(0)).alias("nodes"), F.when(seen, F.greatest(s["depth"], s["at"])).otherwise(s["depth"]).alias("depth"),
            (s["deep"] | (opens & (s["at"] == max_depth))).alias("deep"),
        )
        # what follows the first value is not looked at
        return F.when((s["at"] == 0) & (s["nodes"] > 0), s).otherwise(after)

    return F.aggregate(tokens, start, step)


def measured(df: DataFrame, id_: Column, text: Column, max_depth: int = 32, max_nodes: int = S.MAX_PAGE_CHARS, max_chars: int = S.MAX_PAGE_CHARS) -> DataFrame:
    """id, text, code, nodes, depth, chars of every text: INSPECTION_FAILED for no JSON, INSPECTION_LIMIT for one that is too long, too deep or
    has too many nodes. A projection."""
    d = df.select(id_.alias("id"), text.alias("text"))
    f = measures(F.col("text"), max_depth)
    facts = d.select("id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.when(F.try_parse_json("text").isNotNull(), f).alias("f"))
    # a column that several others use, computed once
    facts = facts.select("id", "text", "chars", F.explode(F.array("f")).alias("f"))
    nodes_, depth = F.coalesce("f.nodes", F.lit(1)).cast("bigint"), F.coalesce("f.depth", F.lit(0))
    over = F.col("f.deep") | (nodes_ > max_nodes) | (F.col("chars") > max_chars)
    code = F.when(F.col("f").isNull(), "INSPECTION_FAILED").when(over, "INSPECTION_LIMIT")
    return facts.select("id", "text", code.alias("code"), nodes_.alias("nodes"), depth.alias("depth"), "chars")


def flattened(df: DataFrame, id_: Column, text: Column, max_depth: int = 32, max_nodes: int = S.MAX_PAGE_CHARS, max_chars: int = S.MAX_PAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(values, reports). values: id, path, kind, value of every scalar and empty container of texts within the limits; reports: id, code, nodes,
    depth, chars of every text: INSPECTION_FAILED for no JSON, INSPECTION_LIMIT for one that is too long, too deep or has too many
    nodes. None is cut short: a text over a limit has a report and no values."""
    d = measured(df, id_, text, max_depth, max_nodes, max_chars)
    leaves = nodes(d.where("code is null"), F.col("id"), F.col("text"), max_depth).where("not filled and kind <> 'invalid'")
    return leaves.select("id", path(F.col("steps")).alias("path"), "kind", "value"), d.drop("text")


def rebuilt(n: DataFrame) -> DataFrame:
    """id, json: texts from their nodes, from the deepest level up; what has lost a node above it is gone with it. Elements stand in
    their order, members in that of their keys (variants sort them)."""
    deepest = n.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = n.where(F.col("depth") == depth).select("id", "steps", "kind", "literal")
        if below is None:
            level = level.withColumn("__in", F.lit(None).cast("array<string>"))
        else:
            last = F.get("steps", F.size("steps") - 1)
            # a key as JSON: an array of one string without its brackets
            key = F.regexp_replace(F.to_json(F.array(last["key"])), r"^\[|\]$", "")
            member = F.when(last["key"].isNull(), F.col("json")).otherwise(F.concat(key, F.lit(":"), F.col("json")))
            of = below.select("id", above(F.col("steps")).alias("steps"), F.struct(last["pos"].alias("pos"), member.alias("m")).alias("s"))
            of = of.groupBy("id", "steps").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["m"]).alias("__in"))
            level = level.join(of, ["id", "steps"], "left")
        inner = F.array_join(F.coalesce("__in", F.array().cast("array<string>")), ",")
        json = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("literal"))
        below = durable(level.select("id", "steps", json.alias("json")))
    if below is None:
        return n.select("id", F.lit(None).cast("string").alias("json")).limit(0)
    return below.select("id", "json")


#: The keywords that a model's service takes, and the most items that it is told of.
KEYWORDS = "type properties required items enum minItems maxItems minimum maximum anyOf description format nullable propertyOrdering".split()
MOST_ITEMS = 20


def allowed(steps: Column, value: Column) -> Column:
    """Whether every step to a node is an element, a property's own name, or a keyword; maxItems goes where it is too large."""

    def fine(s, i):
        field = (i > 0) & (F.get(steps, i - 1)["key"] == "properties")
        return s["key"].isNull() | F.coalesce(field, F.lit(False)) | s["key"].isin(KEYWORDS)

    n = F.size(steps)
    over = (F.get(steps, n - 1)["key"] == "maxItems") & ~F.coalesce(F.get(steps, n - 2)["key"] == "properties", F.lit(False)) & (value.try_cast("double") > MOST_ITEMS)
    return F.forall(F.transform(steps, fine), lambda x: x) & ~F.coalesce(over, F.lit(False))


def schema_for_model(df: DataFrame, id_: Column, text: Column, max_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """(schemas, errors): JSON schemas with nothing but the keywords above, as id, json; errors: id, message of those that are no JSON, no object or
    nested too deeply."""
    n = durable(nodes(df, id_, text, max_depth))
    deep = F.bool_or((F.col("depth") == max_depth) & F.col("kind").isin("object", "array"))
    top = n.groupBy("id").agg(F.max(F.when(F.col("depth") == 0, F.col("kind"))).alias("kind"), deep.alias("deep"))
    said = F.when(F.col("kind") != "object", "The root of a schema must be an object.").when(F.col("deep"), "The schema is nested too deeply.")
    errors = durable(top.select("id", said.alias("message")).where("message is not null"))
    kept = n.join(errors, "id", "left_anti").where(allowed(F.col("steps"), F.col("value")))
    return rebuilt(durable(kept)), errors
