import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def table(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text), in a few partitions."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)


def mixed_texts(seed=1):
    """Copies, near copies, shared passages, hot lines, odd and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage, line = make(120), make(26), make(9)
    out = [None, "", "   \n\t ", "one", "One two", "one two three", base, base, base.upper(), base + " end"]
    for i in range(14):
        changed = base.split()
        changed[r.randrange(len(changed))] = f"edit{i}"
        out.append(" ".join(changed))
    for _ in range(10):
        out.append(make(30) + "\n" + line + "\n" + passage + " " + make(12))
    out += [make(15) + " " + make(15) for _ in range(6)]
    out += ["same " * 60, "same " * 45, "é ß 日本 " * 30, " ".join(["nb"] * 30), "x" * 3000, make(4000)]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, mixed_texts())


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, []).limit(0)
