import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega the of and to in".split()


def corpus(seed=5, n=60):
    """Documents with copies, near copies, shared passages, shared lines, and all odd cases."""
    r = random.Random(seed)
    word = lambda: r.choice(WORDS) + str(r.randint(0, 40))
    passage = " ".join(word() for _ in range(30))
    line = "License: " + " ".join(word() for _ in range(8))
    texts = []
    for k in range(n):
        t = [[word() for _ in range(r.randint(3, 15))] for _ in range(r.randint(1, 8))]
        t = [" ".join(x) for x in t]
        if k % 4 == 0:
            t.insert(r.randint(0, len(t)), passage)
        if k % 3 == 0:
            t.append(line)
        texts.append("\n".join(t))
    texts += texts[:5] + [texts[0]] * 3
    for t in texts[5:12]:  # near copies
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    base = " ".join(word() for _ in range(120))
    texts += [base.replace(" ", "  ", k) + f" tail{k}" for k in range(6)]
    texts += [None, "", " \n\t ", "one", "Two Words", "żółw ŁÓDŹ " * 12, "żółw łódź " * 12, "x" * 60, "y" + "x" * 60, passage.upper(), "a b c d e", "A B C D E", "\x0b\x0c  ", "<|endoftext|> a", "1 2 3"]
    texts.append(" ".join(word() for _ in range(30000)))  # a very long one
    r.shuffle(texts)
    rows = [(k * 3 + 1, t, "en", f"src{k % 3}", None) for k, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((rows[7][0], "another text of the same id " + passage, "en", "s", None))
    rows.append((None, passage, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
