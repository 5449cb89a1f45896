"""Shared parts: vectorised text hashing, Arrow helpers, durable cuts, components.

Everything that runs in a task works on bounded blocks of numpy arrays; nothing here collects rows of
unbounded tables to the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BLOCK = (1 << 17) - 8  # with what is added to it, under a power of two
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_WORD = U(0xD1342543DE82EF95)
_WORD_INV = U(pow(int(_WORD), -1, 1 << 64))

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(31))
        x = x * U(0x7FB5D329728EA185)
        x ^= x >> U(27)
        x *= U(0x81DADEF4BC2DD44D)
        x ^= x >> U(33)
    return x


def byte_table(fold_case: bool = False, seed: int = 11) -> np.ndarray:
    """A random 64-bit value per byte; with fold_case A-Z share the values of a-z."""
    t = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D) + U(seed))
    if fold_case:
        t[65:91] = t[97:123]
    return t


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. One array for each base is kept, as long as any has asked for."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(1 << max(12, int(n - 1).bit_length()), base, U)
        held[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(held, dtype=U, out=held)
        _powers[int(base)] = held
    return held[:n]


def prefix_sums(values: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial prefix hashes, one longer than values."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values)) if len(values) else values, out=out[1:], dtype=U)
    return out


def spans_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray, inverse: np.uint64 = _BASE_INV) -> np.ndarray:
    """Hashes of [s, e) that depend on the content only."""
    with np.errstate(over="ignore"):
        return mix((prefix[e] - prefix[s]) * powers(inverse, len(prefix))[s] + (e - s).astype(U) * U(0xA0761D6478BD642F))


def windows_hash(h: np.ndarray, w: int) -> np.ndarray:
    """A hash for each run of w neighbouring items of h."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        p = prefix_sums(h, _WORD)
        return mix((p[w:] - p[:n]) * powers(_WORD_INV, n) + U(w))


def word_spans(buf: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None):
    """Starts, ends and hashes of the words in buf (uint8). cuts: sorted positions no word spans.

    Works block by block, so that temporaries stay small however long buf is.
    """
    S, E, H = [], [], []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n:  # not within a word
            tail = np.flatnonzero(SPACE[buf[at:end]][::-1])
            if len(tail) and tail[0] < end - at:
                end = end - int(tail[0])
                break
            end = min(n, end + BLOCK)
        part = buf[at:end]
        word = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[0], edge[-1] = word[:1].any(), word[-1:].any()
        if cuts is not None:
            c = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, end, "left")] - at
            double = c[(c > 0) & (c < len(part)) & np.append(True, c[1:] != c[:-1])[: len(c)]]  # empty texts repeat a cut
            double = double[word[double - 1] & word[double]]
        else:
            double = np.zeros(0, np.int64)
        pos = np.flatnonzero(edge)
        if len(double):
            pos = np.sort(np.concatenate([pos, double, double]))
        s, e = pos[0::2], pos[1::2]
        p = prefix_sums(table[part])
        S.append(s + at)
        E.append(e + at)
        H.append(spans_hash(p, s, e))
        at = end
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(S, np.int64), cat(E, np.int64), cat(H, U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(table, column: str = "text", size: int = 1 << 20):
    """Row ranges of about size bytes of the column each; a longer text is alone."""
    if table.num_rows == 0:
        return
    _, off = utf8(table.column(column))
    at = 0
    while at < table.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield table.slice(at, end - at)
        at = end


def shingles(h: np.ndarray, first: np.ndarray, count: np.ndarray, w: int):
    """Hashes of w-word windows per document; a document with fewer words has its whole sequence as one.

    h: word hashes of all documents in order, first/count: each document's words in h. Returns hashes
    and offsets per document, in the order of the text, repeats included.
    """
    all_windows = windows_hash(h, w)
    n = np.where(count >= w, count - w + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(off[-1], U)
    doc = np.repeat(np.arange(len(n)), n)
    at = first[doc] + np.arange(off[-1]) - off[doc]
    full = count[doc] >= w
    out[full] = all_windows[at[full]]
    with np.errstate(over="ignore"):
        for d in np.flatnonzero((count > 0) & (count < w)):
            out[off[d]] = mix(prefix_sums(h[first[d] : first[d] + count[d]], _WORD)[-1:] + U(int(count[d])))[0]
    return out, off


def doc_words(raw: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Words of many documents: starts, ends, hashes, and each document's first word and count."""
    s, e, h = word_spans(raw, table, off)
    first = np.searchsorted(s, off[:-1], "left")
    count = np.searchsorted(s, off[1:], "left") - first
    return s, e, h, first, count


def quoted(name: str) -> str:
    """A column's name as select takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none and one machine
    is all there is (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        import tempfile

        set_dir = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return f"{set_dir}/docloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, executors may go."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a cut that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB and are read a few hundred rows at a time, unless the session says otherwise."""
    own = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
        "spark.sql.parquet.columnarReaderBatchSize": "512",
    }
    for key, value in own.items():
        if spark.conf.get(key, None) is None:  # not set: a default is not told with one given
            spark.conf.set(key, value)


def grown(least: int, most: int, size: float, at: float) -> int:
    """A block's size for an input of this size: least up to the size `at`, then with its square root, at most
    `most`. Between blocks and buckets that both follow the input, rows then stay in proportion to it."""
    return int(min(most, least * max(1.0, (size / at) ** 0.5)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach. Large-star and small-star rounds.

    The number of rounds grows with the logarithm of a component's size, and each round's links are cut to
    the shared folder. Minima are combined before their shuffle and cut, so that the join of a node with very
    many links is one of two plain tables, which adaptive execution can split. The rounds end when a round
    leaves the links as they are: their number and two sums of their hashes.
    """

    def state(e: DataFrame):
        hashes = (F.sum(F.xxhash64("u", "v", F.lit(k)) % (1 << 40)) for k in (1, 2))
        return tuple(e.agg(F.count("*"), *hashes).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    was = state(e)
    while was[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = small.select(end.alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = state(e)
        if now == was:
            break
        was = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
