"""Line deduplication by pairwise alignment.

Method. The first document (least doc_id) with a line owns it. A document is aligned with the owners of
all its lines, however many texts hold them. Each pair is aligned by patience diff over line hashes, and
the aligned blocks are deleted from the later document. With `rare`, a document that shares lines of at
most so many distinct texts is aligned with the owners of those only: cheaper, but not the whole job.

The number of pairs is at most the number of (line, document) rows: every line points to its owner only.
Exact copies don't take part: each later copy loses all its lines. Only line hashes are moved for pairs.

Defined results: a null text stays null; lines end at "\\n" only; lines of white space are never owned
and go only within an aligned block; lines of fewer than `least` characters don't make a pair but are
aligned. Judged on the input: a line deleted from a document still counts as that document's. Rows with
the same doc_id are not earlier than each other. A null doc_id is never earlier nor later than another.
Extra columns are kept, whatever their names; columns named n_lines or n_removed (in any case) give way to
the operator's. An empty table gives no rows; very long texts are aligned whole. There are no ties between owners: a line
belongs to the least doc_id that has it, and rows of one doc_id own it together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted

KEY = "__line_key"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (i, j): common heads and tails, and between them lines that are unique in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        chain = longest_increasing(unique_pairs(a, i, m, b, j, n))
        for x, y in chain:
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        if chain:
            todo.append((i, m, j, n))
    return sorted(out)


def unique_pairs(a, i, m, b, j, n) -> list[tuple[int, int]]:
    """Places of lines that occur once in a[i:m] and once in b[j:n], in the order of a."""
    seen: dict[int, int] = {}
    for k in range(j, n):
        seen[b[k]] = -1 if b[k] in seen else k
    once: dict[int, int] = {}
    for k in range(i, m):
        once[a[k]] = -1 if a[k] in once else k
    return [(k, seen[x]) for x, k in once.items() if k >= 0 and seen.get(x, -1) >= 0]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[p], piles[p] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def removals(docs: DataFrame, rare: int | None = None, least: int = 8) -> DataFrame:
    """doc_id, KEY, whole, gone: the later documents' aligned lines (indexes), or whole for a copy."""
    text = F.col("text")
    lines = F.split(text, "\n")
    # bit 0 of a line's value tells whether the line may be owned
    value = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.length(F.trim(x)) >= least, 1).otherwise(0).cast("bigint"))
    d = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64(text).alias(KEY), F.xxhash64(F.lit(7), text).alias("k2"), F.transform(lines, value).alias("lines"))
    d = cut(d.dropDuplicates(["doc_id", KEY, "k2"]))
    first = d.groupBy(KEY, "k2").agg(F.min("doc_id").alias("rep"), F.min_by("lines", "doc_id").alias("lines"))
    copies = d.join(first.select(KEY, "k2", "rep"), [KEY, "k2"]).where("doc_id > rep").select("doc_id", KEY, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("gone"))
    reps = cut(first.select(F.col("rep").alias("doc_id"), KEY, "lines"))
    held = reps.select("doc_id", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line").bitwiseAND(F.lit(1)) == 1)
    owned = held.groupBy("line").agg(F.min("doc_id").alias("owner"), F.count("*").alias("df")).where("df > 1")
    shared = held.join(owned, "line").where("doc_id > owner")
    if rare is None:
        pairs = shared.select("owner", "doc_id").distinct()
    else:
        pairs = shared.groupBy("owner", "doc_id").agg(F.max(F.col("df") <= rare).alias("is_rare"))
        best = pairs.groupBy("doc_id").agg(F.max("is_rare").alias("any_rare"))
        pairs = pairs.join(best, "doc_id").where("is_rare or not any_rare").select("owner", "doc_id")
    both = pairs.join(reps.select("doc_id", KEY, "lines"), "doc_id").join(reps.select(F.col("doc_id").alias("owner"), F.col("lines").alias("earlier")), "owner")

    def work(batches):
        for b in batches:
            gone = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone.append([j for _, j in patience(y, x)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", KEY, "gone"])

    aligned = both.select("doc_id", KEY, "lines", "earlier").mapInArrow(work, f"doc_id bigint, {KEY} bigint, gone array<int>")
    aligned = aligned.where(F.size("gone") > 0).groupBy("doc_id", KEY).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return copies.unionByName(aligned.withColumn("whole", F.lit(False)))


def dedup_lines(docs: DataFrame, rare: int | None = None, least: int = 8, drop_empty: bool = False) -> DataFrame:
    """docs with the aligned lines deleted from text (n_chars follows, if there is such a column), and
    n_lines, n_removed. drop_empty: documents that lose all their lines go."""
    mine = {"n_lines", "n_removed"}
    fields = [f for f in docs.schema.fields if f.name.lower() not in mine]
    # Columns travel under names of their own, so that theirs may be anything.
    source = docs.select(*[F.col(quoted(f.name)).alias(_own(f.name, k)) for k, f in enumerate(fields)])
    gone = removals(source, rare, least).withColumnsRenamed({"whole": "__whole", "gone": "__gone"})
    d = source.withColumn(KEY, F.xxhash64("text")).join(gone, ["doc_id", KEY], "left")
    lines = F.split("text", "\n")
    marked = F.map_from_arrays(F.col("__gone"), F.col("__gone"))
    few = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i))
    many = F.filter(lines, lambda x, i: ~F.map_contains_key(marked, i))
    left = F.when(F.col("__whole"), F.lit("")).when(F.col("__gone").isNull(), F.col("text"))
    left = left.otherwise(F.array_join(F.when(F.size("__gone") <= 32, few).otherwise(many), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col("__whole"), n).when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    d = d.withColumns({"n_lines": n.cast("bigint"), "n_removed": removed.cast("bigint"), "__left": left})
    if drop_empty:
        d = d.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("__left", r"\s+", "")) != ""))
    out = []
    for k, f in enumerate(fields):
        value = F.col(_own(f.name, k))
        if f.name == "text":
            value = F.col("__left")
        elif f.name == "n_chars" and isinstance(f.dataType, (T.LongType, T.IntegerType)):
            value = F.when(F.col("n_removed") > 0, F.length("__left").cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return d.select(*out, "n_lines", "n_removed")


def _own(name: str, k: int) -> str:
    return name if name in ("doc_id", "text") else f"__column_{k}"
