import random

import pytest

WORDS = "the of and to in is that for on with as was at by an be this from or are we she he it not but they have had".split()

#: Names that operators use inside.
CLASHING = ("digest", "cluster", "size", "place", "target", "bucket", "first", "run1", "n_words", "prefix", "rank", "shard", "print")


def text(rng, n, vocabulary=2000):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, content, language, source): copies, near copies, nulls, repeated rows, a very long text."""
    rng = random.Random(1)
    a, b = text(rng, 80), text(rng, 120)
    near = b.split()
    near[60] = "changed"
    apart = b.split()
    for k in range(5, 120, 9):
        apart[k] = f"other{k}"
    long = text(rng, 40_000)
    return [
        (10, a, "en", "s1"), (3, a, "en", "s2"), (7, a.replace(" ", "\n ", 5), None, "s1"), (20, b, "en", None), (21, " ".join(near), "en", "s1"),
        (22, " ".join(apart), "en", "s1"), (30, None, "en", "s1"), (31, "", "en", "s2"), (32, " \n\t ", None, None), (33, "one", "en", "s1"),
        (34, "one", "en", "s3"), (35, "short text of six words here", "en", "s3"), (40, long, "en", "s1"),
        (41, text(rng, 30) + " " + " ".join(long.split()[700:790]) + " " + text(rng, 20), "en", "s1"), (41, "repeated id", "en", "s1"),
        (50, text(rng, 200), "en", "s2"), (50, None, None, None), (None, a, "en", "s1"), (None, "null id", None, "s9"), (33, "one", "en", "s1"),
    ]


@pytest.fixture(scope="session")
def block(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, content string, language string, source string").repartition(3)
    for i, name in enumerate(CLASHING):
        frame = frame.selectExpr("*", f"{i} AS {name}")
    return frame.cache()


@pytest.fixture(scope="session")
def nothing(block):
    return block.limit(0)
