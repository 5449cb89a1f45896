"""Fill-in-the-middle transformation by SQL of DuckDB within Arrow batches.

Each batch of documents is registered as a table of an in-memory DuckDB of one thread; one statement cuts the
texts into units (regexp_extract_all), draws two cuts and a form from the sha256 of the seed and the document's id,
and joins the slices of the list of units with markers (list_slice, array_to_string). Rows go from Arrow to Arrow and
no Python runs for each of them. Batches are a few MB; a longer text is a batch of its own. Nothing is shuffled,
so a task that is lost is computed again from its part of the input.

 - plain: the text; psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle.
 - An empty text and one that holds a marker stay plain, so that `restore` needs the output and the form only.

Defined results: a null text is empty (n 0, plain); a null doc_id draws from the seed alone; rows that repeat a doc_id are
cut alike, each on its own units; an empty table gives no rows; texts are read whole, however long. Extra columns come
back as they were; one named as a column that is added gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, small_batches

#: A unit of the cuts: a line with its end.
LINE = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")

ADDED = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string())]
RESTORED = [("restored", T.StringType(), pa.string())]


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def transform_sql(seed: int, rate: int, spm: int, unit: str, markers: tuple[str, str, str]) -> str:
    """The statement over a table `batch` (doc_id, text)."""
    p, s, m = map(literal, markers)
    draw = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::UBIGINT"
    return f"""
WITH cut AS (
  SELECT t AS text, regexp_extract_all(t, {literal(unit)}) AS u, sha256(concat('{int(seed)}:', doc_id)) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM batch)
), drawn AS (
  SELECT text, u, len(u)::BIGINT AS n, {draw(1)} % (len(u) + 1) AS c1, {draw(2)} % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(3)} % 100 >= {int(rate)} THEN 'plain'
      WHEN {draw(4)} % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(c1, c2)::BIGINT), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(c1, c2)::BIGINT + 1, greatest(c1, c2)::BIGINT), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(c1, c2)::BIGINT + 1, n), '') END AS suffix
  FROM drawn
)
SELECT n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat({p}, prefix, {s}, suffix, {m}, middle) ELSE concat({s}, suffix, {p}, prefix, {m}, middle) END AS output
FROM parts"""


def restore_sql(markers: tuple[str, str, str]) -> str:
    """The statement over a table `batch` (output, form): the first places of the markers after the leading one tell the parts."""
    p, s, m = map(literal, markers)
    between = lambda a, b: f"substr(output, {a}, {b} - ({a}))"
    after_p, after_s, after_m = (f"instr(output, {x}) + {len(y)}" for x, y in zip((p, s, m), markers, strict=True))
    at_p, at_s, at_m = (f"instr(output, {x})" for x in (p, s, m))
    return f"""
SELECT CASE form
  WHEN 'psm' THEN concat({between(after_p, at_s)}, substr(output, {after_m}), {between(after_s, at_m)})
  WHEN 'spm' THEN concat({between(after_p, at_m)}, substr(output, {after_m}), {between(after_s, at_p)})
  ELSE output END AS restored
FROM batch"""


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever parts of a text stand beside them."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"markers overlap: {a!r} and {b!r}")


def in_duckdb(df: DataFrame, statement: str, inputs: list[str], added: list) -> DataFrame:
    """df with the columns that a statement gives for each row of a table `batch` of its columns `inputs`."""
    names = {a.lower() for a, _, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name in inputs]
    schema = T.StructType([f for f in kept if f.name.lower() not in names] + [T.StructField(a, t) for a, t, _ in added])
    passed = [k for k, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    asked = [df.columns.index(c) for c in inputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}) as db:
            for b in batches:
                db.register("batch", pa.Table.from_arrays([b.column(k) for k in asked], names=inputs))
                found = db.sql(statement).to_arrow_table()
                db.unregister("batch")
                new = [found.column(a).cast(t).combine_chunks() for a, _, t in added]
                new = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in new]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in passed] + new, names=schema.names)

    small_batches(df.sparkSession)
    plain = df.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    return plain.mapInArrow(work, schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINE, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output.

    rate: percentage of documents that are transformed; spm: of those, the percentage in the form that starts with the
    suffix. unit: a regular expression whose matches, from left to right, make up every text."""
    check_markers(markers)
    return in_duckdb(docs, transform_sql(seed, rate, spm, unit, markers), ["doc_id", "text"], ADDED)


def restore(filled: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """filled (output, form, ...) with restored, the text as it was; a null output stays null."""
    check_markers(markers)
    return in_duckdb(filled, restore_sql(markers), ["output", "form"], RESTORED)
