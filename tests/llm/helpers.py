"""Texts and tables that the tests of the training-text operators share."""

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORDS = "amber birch cedar dune ember fjord grove heron iris jade knoll larch maple north ocean pearl quartz river stone tulip".split()
ODD = [None, "", " ", "\n\t ", "x", "Über  zwei   Blanks ", " vorn", "hinten ", "日本語 テキスト 123", "a b  c", "!!! ???", "it's  don't <|endoftext|>\r\n", "A b c d e F g", "lone\x1cgroup \x85 sign"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, blank and odd texts, a very long one, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    rows += [(100, prose(1, 30_000), "en", None, None), (101, "word" * 3000, None, "s", 1), (None, prose(2, 60), "fr", "s", 1), (None, None, None, None, None)]
    rows += [(102, prose(3, 80), "de", "s", 1)] * 3 + [(103, prose(3, 80), "de", "s", 1)]
    rows = [(*r, "kept", 7, "score", 5, "x") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, score string, block int, ids string").repartition(3)


def empty(df: DataFrame) -> DataFrame:
    return df.where("1 = 0")
