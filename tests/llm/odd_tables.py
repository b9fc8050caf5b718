import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use inside, as columns of the input.
CLASHES = ("uid", "fp", "chunk", "digest", "part", "idx", "bin", "node", "root", "word", "begin", "k1", "n", "old")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in CLASHES],
])


def table(spark, rows):
    """Documents from (doc_id, text[, lang]) with columns of clashing names."""
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * len(CLASHES)) for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, missing ids, white space and control strings."""
    rng = random.Random(7)
    words = ["".join(rng.choices("aeiounrst", k=rng.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(30)]
    shared = " ".join(rng.choices(words, k=150))
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [
        (100, None), (101, ""), (102, "   "), (103, "One two"), (104, "ONE TWO"), (105, "one two"), (105, "one two"),
        (None, "one two"), (None, "a lone text"), (106, prose[0].upper()), (106, prose[1]), (-5, prose[1]),
        (107, " ".join(rng.choices(words, k=20_000))), (108, "Ünïcode  tabs\tand\n\nlines é \x1c \x85 end "),
        (109, "<|endoftext|> </s>[INST] x [/INST]"), (110, "x" * 900), (111, "abcdefgh" * 200), (112, "ÀÉ" * 300),
        (113, prose[2] + " " + shared + " " + prose[3]), (114, prose[4] + shared + prose[5]), (115, "12345 !!! ..."),
        (116, "don't it's we'll 3.14 ...hm,,, 'tis"), (117, "Σίσυφος ΟΔΟΣ ΣΑΣ ABC Cafe\u0301"), (118, "日本語 テキスト 中文 "),
    ]
    return rows
