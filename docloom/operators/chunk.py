"""Ordered packing of page text into chunks, with budgets that grow until the chunks are few enough."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, GROWTH, UNBOUNDED = 20, 1.25, 2**53 - 1


def last_index(t: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(t), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(t) - back - (len(part) - 1))


def split_oversized(t: Column, budget: Column) -> Column:
    """Pieces of at most budget characters, cut after the last paragraph, line or sentence beyond half."""
    steps = F.sequence(F.lit(0), F.ceil(F.length(t) * 2 / budget).cast("int"))
    state = F.struct(t.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(s, _):
        window = F.substring(s["rest"], F.lit(1), budget.cast("int"))
        cut = F.greatest(last_index(window, "\n\n"), last_index(window, "\n"), last_index(window, ". "))
        at = F.when(cut > budget / 2, cut + 1).otherwise(budget).cast("int")
        more = F.length(s["rest"]) > budget
        rest = F.when(more, F.substring(s["rest"], at + 1, F.length(s["rest"]))).otherwise(s["rest"])
        out = F.when(more, F.array_append(s["out"], F.substring(s["rest"], F.lit(1), at))).otherwise(s["out"])
        return F.struct(rest.alias("rest"), out.alias("out"))

    done = F.aggregate(steps, state, step, lambda s: F.when(s["rest"] != "", F.array_append(s["out"], s["rest"])).otherwise(s["out"]))
    return F.when(F.length(t) <= budget, F.array(t)).otherwise(done)


def pieces(pages: Column, budget: Column) -> Column:
    """array<struct<number, text>> of pages as pieces within the budget."""
    return F.flatten(F.transform(pages, lambda p: F.transform(split_oversized(p["text"], budget), lambda x: F.struct(p["number"].alias("number"), x.alias("text")))))


def chunk_ids(sizes: Column, budget: Column) -> Column:
    """The chunk number of each piece: a piece that would exceed the budget begins the next chunk."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("id"), F.lit(0).cast("bigint").alias("chars"), none.alias("out"))

    def step(s, n):
        flush = (s["chars"] + n > budget) & (F.size(s["out"]) > 0)
        k = F.when(flush, s["id"] + 1).otherwise(s["id"])
        return F.struct(k.alias("id"), (F.when(flush, 0).otherwise(s["chars"]) + n).cast("bigint").alias("chars"), F.array_append(s["out"], k).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def count_chunks(sizes: Column, budget: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("chars"))

    def step(s, n):
        new = (s["n"] == 0) | (s["chars"] + n > budget)
        return F.struct(F.when(new, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(new, n).otherwise(s["chars"] + n).cast("bigint").alias("chars"))

    return F.aggregate(sizes, start, step, lambda s: s["n"])


def budgets(budget: int) -> list[int]:
    out = [budget]
    for _ in range(ROUNDS - 1):
        out.append(math.ceil(out[-1] * GROWTH))
    return [*out, UNBOUNDED]


def sizes_of(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p["text"]).cast("bigint"))


def chosen_budget(pages: Column, budget: int, max_chunks: int) -> Column:
    """The first budget of the series that gives at most max_chunks chunks; later ones are not tried."""
    series = F.array(*[F.lit(b).cast("bigint") for b in budgets(budget)])

    def step(found, b):
        fits = (b == UNBOUNDED) | (count_chunks(sizes_of(pieces(pages, b)), b) <= max_chunks)
        return F.when(found.isNotNull(), found).when(fits, b)

    return F.aggregate(series, F.lit(None).cast("bigint"), step)


def chunk_pages(docs: DataFrame, budget: int = 120_000, max_chunks: int = 4) -> DataFrame:
    """doc_id, pages array<struct<number, text>> to chunks: doc_id, chunk_id, piece_pos, number, text."""
    d = docs.withColumn("budget", chosen_budget(F.col("pages"), budget, max_chunks))
    d = d.withColumn("parts", pieces(F.col("pages"), F.col("budget")))
    d = d.withColumn("ids", chunk_ids(sizes_of(F.col("parts")), F.col("budget")))
    d = d.select("doc_id", F.posexplode(F.arrays_zip("ids", "parts")).alias("piece_pos", "p"))
    return d.select("doc_id", F.col("p.ids").alias("chunk_id"), "piece_pos", F.col("p.parts.number").alias("number"), F.col("p.parts.text").alias("text"))
