"""N-gram Jaccard join with a token-group matrix.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is 0.75 or more. Links are
exact: what is ruled out is ruled out by bounds, what is kept is verified on the whole sets.

Method, step by step:
 1. A pass over the texts gives each set's size and an order-free 128-bit key; documents with equal sets
    are one class, whose least doc_id stands for it. Another counts tokens; those that HEAVY
    classes or more have (the FREQUENT most frequent of them) come last in the global order, so that prefixes hold rare ones.
 2. Each class sends its prefix: its first n - ceil(3n/4) + l(n) tokens in that order, l(n) = max(1, n // 20). Tokens that
    one class only has go nowhere; the rest are the postings.
 3. Classes are partitioned into groups of similar ones: of the classes that share a token and are near
    in size, each is verified against one leader (if it leads under a quarter of the class's prefix), and verified links make the groups.
 4. The token-group matrix has a row for each token and the groups whose union of prefixes has it. A
    class's overlap c with another group's union bounds its overlap with every member S: of the tokens
    up to the end of the prefix that ends first, all are in both prefixes, so |Q & S| is at most c plus
    the longer rest. Only groups where that can reach 3/7 (|Q| + |S|) for a size of theirs qualify; these
    open: Q is compared with the leader L.
 5. If L itself does not link, |Q & S| is at most min(|Q & L|, |S & L|) plus what Q and S share outside
    of L. Only members that this allows are verified: they meet by tokens outside of L, or by sizes
    so small that L's part is enough. Within a component nothing more is verified.
 6. A class without a link that shares half of its tokens or more with a leader is a satellite of its group: the two are compared
    already, so it meets the group's members and other satellites by step 5 alone, and other classes find it through the group.
    Outliers of a family thus do not ask each other by the family's frequent tokens.

So a family of m near copies costs m verifications against its leaders, and an outlier of it only those
members that share its own edits. No frequent token is collected: those known as frequent are rows that
Spark aggregates, others have a bounded frequency.

Defined results: a null or empty text has no shingle (n_shingles 0) and is its own component; a row with
a null doc_id links with nothing and has a null component_id; rows with one doc_id are one document (its
component holds what any of its texts link to). Texts with fewer than five words are one shingle. Very long
texts are read whole. Of ties between leaders, or between documents of a component, the least doc_id is taken. An empty table gives no rows. Extra columns are not read by jaccard_components, and
keep_one returns them as they are.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, byte_table, components, cut, discard, doc_words, grown, mix, quoted, shingles, slices, small_batches, utf8

WORDS, NUM, DEN = 5, 3, 4
HEAVY, FREQUENT, LEAD = 16, 500_000, 0.25
#: Tokens that a task holds before it sends them: from the first number, grown with the input, to the second.
FLUSH, MOST_FLUSH = 1 << 18, 1 << 22
BITS, SALTS = 1 << 23, 16
_TABLE = byte_table(fold_case=True, seed=3)


def sets(part: pa.Table) -> list[np.ndarray]:
    """Each text's sorted distinct tokens (63-bit shingle hashes)."""
    raw, off = utf8(part.column("text"))
    _, _, h, first, count = doc_words(raw, off, _TABLE)
    tokens, at = shingles(h, first, count, WORDS)
    tokens >>= U(1)
    out = []
    for a, b in zip(at, at[1:], strict=False):
        t = np.sort(tokens[a:b])
        out.append(t[np.concatenate([[True], t[1:] != t[:-1]])] if len(t) > 1 else t)
    return out


def keys(tokens: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit key of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        two = np.array([mix(tokens).sum(dtype=U), mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U)
    return tuple(mix(two + U(len(tokens))).view(np.int64).tolist())


def need(n):
    """ceil(3n/4)."""
    return -(-NUM * n // DEN)


def slack(n):
    return np.maximum(1, n // 20)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 of each row."""

    def work(batches):
        for b in batches:
            for part in slices(pa.Table.from_batches([b])):
                found = sets(part)
                k = [keys(s) if len(s) else (0, 0) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in k], pa.int64()), pa.array([y for _, y in k], pa.int64())],
                    ["doc_id", "n", "k1", "k2"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n bigint, k1 bigint, k2 bigint")


def short(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 31 further bits of tokens, as one number."""
    return ((tokens & U(0xFFFFFFFF)) % U(buckets)) << U(31) | tokens >> U(32)


def heavy_tokens(docs: DataFrame, buckets: int, hold: int) -> np.ndarray:
    """Short forms of tokens that about HEAVY classes or more have, the FREQUENT most frequent. They only order
    tokens; every result is the same with any others."""

    def work(batches):
        held, seen, size = [], set(), 0

        def flush():
            t = np.sort(short(np.concatenate(held), buckets))
            cuts = np.searchsorted(t, np.arange(buckets + 1, dtype=U) << U(31))
            low = (t & U(0x7FFFFFFF)).astype(np.uint32)
            full = [(q, low[a:b].tobytes()) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([q for q, _ in full], pa.int32()), pa.array([x for _, x in full], pa.binary())], ["bucket", "body"])

        for b in batches:
            for part in slices(pa.Table.from_batches([b])):
                for s in sets(part):
                    k = keys(s)[0] if len(s) else None
                    if k is not None and k not in seen:
                        seen.add(k)
                        held.append(s)
                        size += len(s)
                if size >= hold:
                    yield flush()
                    held, seen, size = [], set(), 0
        if size:
            yield flush()

    def count(key, table):
        t = np.sort(np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint32))
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.diff(np.append(head, len(t)))
        often = n >= HEAVY
        token = t[head[often]].astype(np.int64) | key[0].as_py() << 31
        return pa.Table.from_arrays([pa.array(token), pa.array(n[often].astype(np.int64))], names=["token", "c"])

    found = docs.select("doc_id", "text").mapInArrow(work, "bucket int, body binary").groupBy("bucket").applyInArrow(count, "token bigint, c bigint")
    top = found.orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").collect()
    return np.sort(np.array([r["token"] for r in top], np.int64).astype(U))


def prefixes(docs: DataFrame, frequent: np.ndarray, buckets: int, hold: int) -> DataFrame:
    """bucket, body: blocks of (short token, class, size) entries; and rows of frequent tokens: token, k, n."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT numbers

    def work(batches):
        often = shared.value
        quick = np.zeros(1 << 20, bool)
        quick[(often & U((1 << 20) - 1)).astype(np.int64)] = True
        T, K, N, seen, size = [], [], [], set(), 0

        def flush():
            t = np.concatenate(T)
            c = np.array([len(x) for x in T])
            k, n = np.repeat(np.array(K, np.int64), c), np.repeat(np.array(N, np.uint32), c)
            hot = t >> U(63) == 1
            bucket = ((t & U(0xFFFFFFFF)) % U(buckets)).astype(np.int32)
            cold = np.flatnonzero(~hot)
            cold = cold[np.argsort(bucket[cold], kind="stable")]
            cuts = np.searchsorted(bucket[cold], np.arange(buckets + 1))
            short = (t >> U(32)).astype(np.uint32)
            full = [(q, cold[a:b]) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            bodies = [np.uint32(len(x)).tobytes() + short[x].tobytes() + k[x].tobytes() + n[x].tobytes() for _, x in full]
            m, e = int(hot.sum()), len(full)
            i64 = lambda x: pa.array(x, pa.int64())
            token = (t[hot] & U((1 << 63) - 1)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, _ in full] + [None] * m, pa.int32()),
                    pa.array(bodies + [None] * m, pa.binary()),
                    i64([None] * e + token.tolist()),
                    i64([None] * e + k[hot].tolist()),
                    i64([None] * e + n[hot].tolist()),
                ],
                ["bucket", "body", "token", "k", "n"],
            )

        for b in batches:
            for part in slices(pa.Table.from_batches([b])):
                for s, doc in zip(sets(part), part.column("doc_id").is_valid().to_pylist(), strict=True):
                    if not len(s) or not doc:
                        continue
                    k = keys(s)[0]
                    if k in seen:  # copies in one block are one class already
                        continue
                    seen.add(k)
                    n = len(s)
                    t = short(s, buckets)
                    maybe = np.flatnonzero(quick[(t & U((1 << 20) - 1)).astype(np.int64)])
                    if len(maybe):
                        at = np.searchsorted(often, t[maybe])
                        maybe = maybe[often[np.minimum(at, len(often) - 1)] == t[maybe]]
                        s[maybe] |= U(1 << 63)
                        s = np.sort(s)
                    T.append(s[: n - need(n) + int(slack(n))])
                    K.append(k)
                    N.append(n)
                    size += len(T[-1])
                if size >= hold:
                    yield flush()
                    T, K, N, seen, size = [], [], [], set(), 0
        if size:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, "bucket int, body binary, token bigint, k bigint, n bigint")


def segment(n):
    """Sizes of one segment are within 3/4 of each other."""
    return np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


POSTINGS = "pair boolean, x bigint, y bigint, n bigint, c bigint"


def postings(blocks: DataFrame) -> DataFrame:
    """Entries of tokens that several classes have (pair false: token, class, size), and leader pairs
    (pair true: leader, class, the class's size, tokens under which the one leads the other)."""

    def work(key, table):
        bucket = key[0].as_py()
        T, K, N = [], [], []
        for x in table.column("body").to_pylist():
            m = int(np.frombuffer(x, np.uint32, 1)[0])
            T.append(np.frombuffer(x, np.uint32, m, 4))
            K.append(np.frombuffer(x, np.int64, m, 4 + 4 * m))
            N.append(np.frombuffer(x, np.uint32, m, 4 + 12 * m))
        t, k, n = np.concatenate(T), np.concatenate(K), np.concatenate(N).astype(np.int64)
        order = np.sort(t.astype(U) << U(32) | np.arange(len(t), dtype=U))
        s, place = order >> U(32), (order & U(0xFFFFFFFF)).astype(np.int64)
        same = s[1:] == s[:-1]
        place = place[np.append(same, False) | np.concatenate([[False], same])]
        t, k, n = t[place], k[place], n[place]
        seg = segment(n) if len(n) else n
        order = np.lexsort((k, n, seg, t))
        t, k, n, seg = t[order], k[order], n[order], seg[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.zeros(0, bool)
        t, k, n, seg = t[new], k[new], n[new], seg[new]
        if len(t):
            head = np.concatenate([[True], t[1:] != t[:-1]])
            run = np.cumsum(head) - 1
            several = np.bincount(run)[run] > 1
            t, k, n, seg = t[several], k[several], n[several], seg[several]
        lead = k
        if len(t):
            head = np.concatenate([[True], (t[1:] != t[:-1]) | (seg[1:] != seg[:-1])])
            lead = k[head][np.cumsum(head) - 1]
        far = lead != k
        a, b, m, c = lead[far], k[far], n[far], np.zeros(0, np.int64)
        if len(a):
            order = np.lexsort((b, a))
            a, b, m = a[order], b[order], m[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            c = np.diff(np.append(new, len(a)))
            a, b, m = a[new], b[new], m[new]
        token = t.astype(np.int64) << 31 | bucket
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(t), bool), np.ones(len(a), bool)])),
                pa.array(np.concatenate([token, a])),
                pa.array(np.concatenate([k, b])),
                pa.array(np.concatenate([n, m])),
                pa.array(np.concatenate([np.zeros(len(t), np.int64), c])),
            ],
            names=["pair", "x", "y", "n", "c"],
        )

    return blocks.where("bucket is not null").select("bucket", "body").groupBy("bucket").applyInArrow(work, POSTINGS)


def some_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text (and ids' other columns) of the documents with these ids. A fixed bitmap of BITS bits (its size doesn't grow
    with the input; full, it only stops helping) keeps most other texts out of the shuffle. It is broadcast as BITS / 64 rows
    at most, so that a pass over all texts to find a few of them stays in the JVM."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.floor(slot / 64).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit")
    words = ids.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    asked = docs.where("doc_id is not null").select("doc_id", "text", word, bit).join(F.broadcast(words), "word")
    return asked.where("(shiftright(bits, bit) & 1L) = 1").select("doc_id", "text").join(ids, "doc_id")


COMPARED = "a bigint, x bigint, b bigint, y bigint, n_a bigint, n bigint, common bigint, rest array<bigint>"


def compared(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rest: bool = False) -> DataFrame:
    """Pairs (x, y: class keys) with what their whole sets share: a, x, b, y, n_a, n, common, and y's tokens
    that x doesn't have (if rest; else null).

    Leaders are x: their text is joined first, salted by the other side (a leader may have a third of
    all classes), and the rows are then dealt by the other side.
    """
    reps = classes.select("k1", "rep")
    left = reps.select(F.col("k1").alias("x"), F.col("rep").alias("a"))
    right = reps.select(F.col("k1").alias("y"), F.col("rep").alias("b"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
    p = cut(pairs.join(left, "x").join(right, "y").select("a", "x", "b", "y", salt))
    asked = p.select(F.col("a").alias("doc_id"), "salt").unionAll(p.select(F.col("b").alias("doc_id"), F.lit(-1))).distinct()
    texts = some_texts(docs, asked)
    of_a = texts.where("salt >= 0").select(F.col("doc_id").alias("a"), "salt", F.col("text").alias("ta"))
    of_b = texts.where("salt < 0").select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = p.join(of_a, ["a", "salt"]).join(of_b, "b")

    def work(batches):
        known: OrderedDict[tuple[int, int], np.ndarray | None] = OrderedDict()

        def tokens(part: pa.Table, key: str, text: str) -> list[np.ndarray | None]:
            """Each row's tokens; None if the text is another one of a repeated doc_id."""
            which = list(zip(part.column(key).to_pylist(), part.column(f"h{text}").to_pylist(), strict=True))
            fresh = {w: i for i, w in enumerate(which) if w not in known}
            got = {}
            if fresh:
                column = part.column(f"t{text}").take(pa.array(list(fresh.values())))
                for w, s in zip(fresh, sets(pa.table({"text": column})), strict=True):
                    got[w] = s if len(s) and keys(s)[0] == w[0] else None
            out = [got[w] if w in got else known[w] for w in which]
            known.update((w, s) for w, s in got.items() if s is None or len(s) < 4096)
            while len(known) > 256:
                known.popitem(last=False)
            return out

        for b in batches:
            for part in slices(pa.Table.from_batches([b]), "tb"):
                part = part.combine_chunks()
                A, B = tokens(part, "x", "a"), tokens(part, "y", "b")
                found = []
                for i, (s, t) in enumerate(zip(A, B, strict=True)):
                    if s is not None and t is not None:
                        own = s[np.minimum(np.searchsorted(s, t), len(s) - 1)] != t
                        found.append((i, len(s), len(t), len(t) - int(own.sum()), t[own].view(np.int64) if rest else None))
                row, *numbers, more = zip(*found, strict=True) if found else ([], [], [], [], [])
                same = part.select(["a", "x", "b", "y"]).take(pa.array(row, pa.int64()))
                columns = [c.combine_chunks() for c in same.columns] + [pa.array(x, pa.int64()) for x in numbers]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(more, pa.list_(pa.int64()))], names=_COMPARED)

    hashes = (F.xxhash64(t).alias(h) for t, h in (("ta", "ha"), ("tb", "hb")))
    return both.select("a", "x", "b", "y", "ta", "tb", *hashes).mapInArrow(work, COMPARED)


_COMPARED = [c.split()[0] for c in COMPARED.split(", ")]
#: Whether a compared pair links.
LINKED = f"{DEN} * common >= {NUM} * (n_a + n - common)"


def seg_of(n: Column) -> Column:
    """segment() as a column."""
    return F.floor(F.log(n) / F.log(F.lit(DEN / NUM)) + 1e-9).alias("seg")


def prefix_of(n: Column) -> Column:
    """How many tokens a class of n sends."""
    return n - F.ceil(n * NUM / DEN) + F.greatest(F.lit(1), F.floor(n / 20))


def least_overlap(n: Column, m: Column) -> Column:
    """ceil(3/7 (n + m)): what sets of these sizes must share to link."""
    return F.ceil((n + m) * NUM / (NUM + DEN))


def leader_pairs(posted: DataFrame, often: DataFrame) -> DataFrame:
    """(x, y): a class y and a leader x that holds LEAD of y's prefix.

    The leader of frequent tokens is a family's hub: the class whose prefix tokens are frequent on average, as
    an edited copy has rare tokens of its own. All of a family's tokens then name the same leader.
    """
    df = often.groupBy("token").agg(F.count("*").alias("df"))  # at most FREQUENT rows
    weight = often.join(F.broadcast(df), "token").groupBy("k", "n").agg(F.sum("df").alias("w"))
    hub = weight.select("k", (F.col("w") / prefix_of(F.col("n"))).alias("w"))
    lead = often.join(hub, "k").groupBy("token", seg_of(F.col("n"))).agg(F.max(F.struct("w", "k")).alias("lead"))
    starred = often.withColumn("seg", seg_of(F.col("n"))).join(cut(lead), ["token", "seg"])
    starred = starred.select(F.col("lead.k").alias("x"), F.col("k").alias("y"), "n", F.lit(1).alias("c")).where("x <> y")
    pairs = posted.where("pair").select("x", "y", "n", "c").unionAll(starred)
    pairs = pairs.groupBy("x", "y", "n").agg(F.sum("c").alias("c"))
    return pairs.where(F.col("c") >= LEAD * prefix_of(F.col("n"))).select("x", "y")


def stars(links: DataFrame) -> DataFrame:
    """(x, y, n, common, rest): each linked class y in the group of one leader x, the one with most links
    of those it has. A leader that keeps a group is not in another's."""
    degree = cut(links.groupBy("x").agg(F.count("*").alias("d")))
    chosen = cut(links.select("x", "y").join(degree, "x").groupBy("y").agg(F.max(F.struct("d", "x"))["x"].alias("x")))
    leaders = chosen.select(F.col("x").alias("y")).distinct()
    return links.join(chosen.join(leaders, "y", "left_anti"), ["x", "y"]).select("x", "y", "n", "common", "rest")


def satellites(near: DataFrame, linked: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y, n, n_a, common, rest): each class y without a link under one leader x, the one with most such classes of those
    it was compared with. linked: node, component of classes with links."""
    free = classes.join(linked, classes["rep"] == linked["node"], "left_anti").select(F.col("k1").alias("y"))
    near = near.join(free, "y")
    degree = cut(near.groupBy("x").agg(F.count("*").alias("d")))
    chosen = near.select("x", "y").join(degree, "x").groupBy("y").agg(F.max(F.struct("d", "x"))["x"].alias("x"))
    return near.join(cut(chosen), ["x", "y"]).select("x", "y", "n", "n_a", "common", "rest")


def named_classes(classes: DataFrame, linked: DataFrame, members: DataFrame, outer: DataFrame) -> DataFrame:
    """k, g (its component), h (its group's leader), s (the leader's component), outer (whether it is a satellite there)."""
    own = classes.join(linked, classes["rep"] == linked["node"], "left")
    own = cut(own.select(F.col("k1").alias("k"), F.coalesce("component", "rep").alias("g")))
    led = outer.select(F.col("y").alias("k"), F.col("x").alias("around"))
    led = led.join(own.select(F.col("k").alias("around"), F.col("g").alias("s")), "around")
    named = own.join(members.select(F.col("y").alias("k"), "x"), "k", "left").join(led, "k", "left")
    return named.select("k", "g", F.coalesce("x", "around", "k").alias("h"), F.coalesce("s", "g").alias("s"), F.col("around").isNotNull().alias("outer"))


def shared_tokens(sized: DataFrame) -> DataFrame:
    """k, n, x, olo, ohi for each token that a class k shares with a group x that it asks.

    sized: token, k, n, most, outer of a class; h (its group), s (the leader's component) and m, lo, hi of these.
    """
    other = {"h": "x", "s": "other", "m": "om", "lo": "olo", "hi": "ohi"}
    matrix = sized.select("token", *[F.col(c).alias(o) for c, o in other.items()]).distinct()
    # The smaller component asks the larger one, so that a large family does not ask each of its outliers; a satellite asks the
    # other groups of its leader's component.
    asks = (F.col("m") < F.col("om")) | ((F.col("m") == F.col("om")) & (F.col("s") < F.col("other")))
    asks = F.when(F.col("s") == F.col("other"), F.col("outer") & (F.col("h") != F.col("x"))).otherwise(asks)
    n = F.col("n")
    lo, hi = F.greatest("olo", F.ceil(n * NUM / DEN)), F.least("ohi", F.floor(n * DEN / NUM))
    # A larger set's prefix may end first and hide tokens that it has. What links with it has all others of that prefix.
    hidden = n - prefix_of(n) + prefix_of(hi) - (hi - least_overlap(n, hi))
    able = (lo <= hi) & (F.col("most") >= F.least(least_overlap(n, lo), F.when(hi > n, hidden)))
    return sized.join(matrix, "token").where(asks & able).select("k", "n", "x", "olo", "ohi")


def opened_groups(rare: DataFrame, often: DataFrame, named: DataFrame) -> DataFrame:
    """(x, y): the leaders of the groups that the token-group matrix opens for a class y of another component.

    named: see named_classes. Tokens that no other class has are counted for each
    class: at most `most` = n - (those) of its tokens can be in another set whose prefix does not end before its own.
    """
    every = rare.unionAll(often).join(named.select("k", "g"), "k")
    spread = every.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
    known = often.select("token").distinct().withColumn("hot", F.lit(True))
    spread = cut(spread.join(known, "token", "left"))
    hot = F.broadcast(spread.where("hot").select("token"))  # at most FREQUENT rows
    met = rare.join(spread.where("hot is null").select("token"), "token")
    met = met.unionAll(often.join(hot, "token").select("token", "k", "n"))
    # Two are allowed for tokens of one class with one short form.
    counts = rare.unionAll(often).groupBy("k", "n").agg(F.count("*").alias("c"))
    most = counts.select("k", (F.col("n") - prefix_of(F.col("n")) + F.col("c") + 2).alias("most"))
    most = most.where(F.col("most") >= F.ceil(F.col("n") * NUM / DEN))  # else it links with none
    mixed = cut(met.join(named.drop("g"), "k").join(most, "k"))
    members = mixed.select("s", "h", "k", "n").distinct()
    groups = cut(members.groupBy("s", "h").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m")))
    size = cut(groups.groupBy("s").agg(F.sum("m").alias("m")))
    groups = cut(groups.drop("m").join(size, "s"))
    sized = cut(mixed.drop("s").join(groups, "h"))
    overlap = shared_tokens(sized).groupBy("k", "n", "x", "olo", "ohi").agg(F.count("*").alias("c"))
    n = F.col("n")
    # The bound is within one of its least at an end of the sizes that can link; one more for short forms.
    rest = lambda n: F.ceil(n * NUM / DEN) - F.greatest(F.lit(1), F.floor(n / 20))
    lo, hi = F.greatest("olo", F.ceil(n * NUM / DEN)), F.least("ohi", F.floor(n * DEN / NUM))
    least = lambda m: least_overlap(n, m) - F.greatest(rest(n), rest(m)) - 2
    return overlap.where(F.col("c") >= F.least(least(lo), least(hi))).select("x", F.col("k").alias("y"))


def opened_members(asked: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y): members x of the groups that opened for a class y, but did not link with the leader L.

    With what both share with L known, |Q & S| is at most min(|Q & L|, |S & L|) plus what the two have in
    common outside of L. So a pair must share tokens outside of L - a join over those tokens alone - or be
    so much smaller than L that what L gives is enough - a join over ranges of sizes.
    """
    q = asked.select("x", F.col("y").alias("q"), F.col("n").alias("nq"), F.col("common").alias("iq"), "n_a", "rest")
    s = members.select("x", F.col("y").alias("s"), F.col("n").alias("ns"), F.col("common").alias("is"), F.col("rest").alias("more"))
    fits = (DEN * F.col("nq") >= NUM * F.col("ns")) & (DEN * F.col("ns") >= NUM * F.col("nq"))
    short = least_overlap(F.col("nq"), F.col("ns")) - F.least("iq", "is")
    by = ["x", "q", "s", "nq", "ns", "iq", "is"]
    outside = q.select("x", "q", "nq", "iq", F.explode("rest").alias("token"))
    outside = outside.join(s.select("x", "s", "ns", "is", F.explode("more").alias("token")), ["x", "token"]).where(fits)
    outside = outside.groupBy(*by).agg(F.count("*").alias("r")).where(F.col("r") >= short)
    # need(nq, ns) <= iq means ns <= 7/3 iq - nq; sizes meet in steps of a 32nd of the leader's.
    step = lambda n: F.floor(n * 32 / F.col("n_a"))
    low, high = F.ceil(F.col("nq") * NUM / DEN), F.floor(F.col("iq") * (NUM + DEN) / NUM) - F.col("nq")
    within = q.where(low <= high).select("x", "q", "nq", "iq", F.explode(F.sequence(step(low), step(high))).alias("step"))
    size = asked.groupBy("x").agg(F.max("n_a").alias("n_a"))
    sized = s.drop("more").join(cut(size), "x").withColumn("step", step(F.col("ns")))
    within = within.join(sized, ["x", "step"]).where(fits & (short <= 0))
    return outside.select("q", "s").unionAll(within.select("q", "s")).where("q <> s").select(F.col("s").alias("x"), F.col("q").alias("y"))


def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): the profile's rows, classes (k1, k2, rep, n), and (node, component) of linked ones."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = cut(profile(docs))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = cut(classes)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    hold = grown(FLUSH, MOST_FLUSH, total, 1 << 27)
    buckets = int(max(1, -(-3 * total // (10 * hold))))
    blocks = cut(prefixes(docs, heavy_tokens(docs, buckets, hold), buckets, hold))
    posted = cut(postings(blocks))
    often = cut(blocks.where("bucket is null").select("token", "k", "n").distinct())
    discard(blocks)
    rare = posted.where("not pair").select(F.col("x").alias("token"), F.col("y").alias("k"), "n")
    near = cut(compared(docs, leader_pairs(posted, often), classes, rest=True).where(f"{LINKED} or 2 * common >= n"))
    links = near.where(LINKED)
    first = cut(components(links))
    members = cut(stars(links))
    outer = cut(satellites(near.where(f"not ({LINKED})"), first, classes))
    # The token-group matrix: a class without a verified link is a group of its own.
    named = cut(named_classes(classes, first, members, outer))
    asked = cut(compared(docs, opened_groups(rare, often, named), classes, rest=True))
    by = ["x", "y", "n", "n_a", "common", "rest"]
    apart = asked.where(f"not ({LINKED})").select(*by).unionAll(outer)
    pairs = opened_members(apart, members).unionAll(opened_members(asked.select(*by).unionAll(outer), outer.drop("n_a")))
    pairs = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    more = cut(compared(docs, pairs, classes).where(LINKED))
    found = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for links in (asked.where(LINKED), more):
        found = found.unionAll(links.select("a", "b"))
    return rows, classes, components(found)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows, classes, linked = link_components(docs)
    own = classes.join(linked, classes["rep"] == linked["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(own, ["k1", "k2"], "left")
    alone = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents of a component but its first; documents without words stay."""
    gone = jaccard_components(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
