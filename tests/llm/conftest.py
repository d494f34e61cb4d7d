import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "über", "ciudad", "naïve", "x"]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, short and long texts."""
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    rows = list(base)
    passage = prose(rng, 70)
    for k, t in enumerate(base[:20]):
        w = t.split()
        rows.append(t)
        near = list(w)
        near[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(near))
        rows.append(" ".join(w[:30]) + "\n" + passage + "\t" + " ".join(w[30:k + 31]))
    for _ in range(30):  # one group of near copies of one text
        w = base[0].split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append(" ".join(w))
    rows += [None, "", "   \n\t", "one", "one two", "One TWO", "a b c", prose(rng, 6000), "w " * 300, base[3].upper()]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, f"n{i}", 1) for i, t in texts], "doc_id long, text string, node string, n int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
