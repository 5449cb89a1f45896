"""Operator 1: outliers of a large family, and prefixes that end early."""

import random

import numpy as np
import pyarrow as pa

from docloom.llm import op1_ngram_join
from test_dedup import brute_components

DOC = "doc_id bigint, text string"


def test_outliers_do_not_ask_each_other(spark, monkeypatch):
    """What classes share with groups grows with the family, not with its square; links are those of brute force."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    asked = []
    was = op1_ngram_join.shared_tokens

    def counted(sized):
        out = was(sized)
        asked.append(out.count())
        return out

    monkeypatch.setattr(op1_ngram_join, "shared_tokens", counted)
    for size in (60, 240):
        rows = []
        for k in range(size):
            d = r.randint(21, 24) if k % 3 else r.randint(0, 6)
            at = r.choice([0, 150 - d, r.randint(40, 60)])
            rows.append((k * 2 + 1, " ".join([*base[:at], *(f"v{k}x{j}" for j in range(d)), *base[at + d :]])))
        got = op1_ngram_join.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
        assert sorted(map(tuple, got)) == brute_components(rows)
    assert asked[1] <= 6 * asked[0] + 4 * 240


def test_prefix_that_ends_early(spark):
    """A larger set's own tokens come first in the order and hide most of what it shares; the link at the very bound stays."""
    r = random.Random(3)
    words = [f"a{k}" for k in range(104)]
    for _ in range(33):
        tries = [f"b{r.randrange(1 << 30)}" for _ in range(2000)]
        tokens = op1_ngram_join.sets(pa.table({"text": [" ".join([*words[-4:], w]) for w in tries]}))
        words.append(tries[int(np.argmin([s[0] for s in tokens]))])
    rows = [(1, " ".join(words[:104])), (2, " ".join(words))]
    got = op1_ngram_join.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows) == [(1, 100, 1), (2, 133, 1)]
