import random

import pytest
from pyspark.sql import types as T

WORDS = "the of anin whhe lynt her ent thsh Éaux pas été ONE two, three. four % ### ñra".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="session")
def small_docs():
    """Rows of documents with copies, near copies, shared passages and every odd case."""
    rng = random.Random(11)
    rows = []
    passage = prose(rng, 70)
    for i in range(60):
        text = prose(rng, rng.randrange(1, 260))
        if i % 5 == 0:
            words = text.split(" ")
            words[len(words) // 2 : len(words) // 2] = passage.split(" ")[i % 15 :]
            text = " ".join(words)
        if i % 7 == 3 and rows:
            text = rows[-3][1]
        if i % 7 == 5 and rows:
            words = (rows[-2][1] or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 4 == 1:
            text = text.replace(" ", "\n", 3) + "\nAll rights reserved.\n\n"
        rows.append((i * 3, text, f"src{i % 12}"))
    rows += [(500, None, "src1"), (501, "", "src2"), (502, " \n\t ", None), (503, "one", "src3"), (504, "one two three", "src3"), (505, "x" * 5000, "src4"), (None, rows[2][1], "src5"), (506, "a  b\x0bc\r\nd é　f", "src6"), (507, "<|endoftext|>it's <|endoftext|>\n\n  we'll", "src7"), (508, prose(rng, 9000), "src8")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, small_docs):
    """The rows with further columns whose names clash with those of the operators."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("id", "n_words", "n_removed", "quality", "shard", "rep", "component", "n_lines", "keys", "v")]])
    return spark.createDataFrame([(*r, *["x"] * 10) for r in small_docs], schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
