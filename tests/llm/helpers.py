"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeats, other columns."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n_words int, size int, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def awkward(spark, rows=None):
    """Documents whose further columns have names that operators use inside."""
    texts = rows if rows is not None else [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five six seven eight nine ten eleven"),
        (6, "one two three four five six seven eight nine ten eleven"), (6, "one two three four five six seven eight nine ten eleven"),
        (7, "word " * 30_000), (8, "x" * 200_000), (None, "no id at all"), (9, "É à ß 日本 " * 5), (10, "a\nb\na\nb\n\na"),
        (11, "mail a.b@c.de_x@y.zz and 1.2.3.4.5 or +1 (017) 555-7713, 4111 1111 1111 1111; 555-7713 again"),
    ]
    data = [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, "d", 1, 2, 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def empty(df):
    return df.where(F.lit(False))
