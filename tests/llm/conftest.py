import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def _texts():
    r = random.Random(3)
    pool = [f"w{k}" for k in range(400)] + ["ünï", "#tag", "A-Z", "don't", "数字"]
    line = lambda n: " ".join(r.choice(pool) for _ in range(n))
    shared = line(70)
    out = [None, "", "   \n\t ", "one", "a b c", "a b c", "A B C", "x" * 49, "x" * 300, "z " * 400, "a\x0bb\x0cc d e f g", "...", "123 456", "<|endoftext|> in text", "tab\there  two spaces   three\n\n\nlines \n"]
    base = line(200)
    out += [base, base, base + " end", " ".join(base.split()[:-6] + line(6).split()), base.upper(), base + "\n" + base]
    out += [line(r.randint(1, 60)) + " " + shared + " " + line(r.randint(1, 60)) for _ in range(25)]
    out += [shared] * 6 + [line(9000), line(30) + " " + shared * 40]
    for k in range(40):  # a chain of near copies
        words = base.split()
        for j in range(k):
            words[5 * j % 200] = f"n{j}"
        out.append(" ".join(words))
    out += ["\n".join([line(6), line(6), line(6)] * 4), "same line here\n" * 30, "é" * 120 + "é" * 7, "     x  "]
    return out


TEXTS = _texts()


@pytest.fixture(scope="session")
def odd_rows():
    """Edge cases under distinct ids, in no order of content."""
    order = list(range(len(TEXTS)))
    random.Random(8).shuffle(order)
    return [(3 * i - 20, TEXTS[k]) for i, k in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], [None, "b", "a", "Z", "ä"][k % 5], len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
