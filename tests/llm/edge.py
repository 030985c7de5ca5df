"""Rows that every operator on documents has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("blob", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_lines", T.StringType()), T.StructField("node", T.StringType()),
])
PROSE = "the quiet river runs past old stone houses while children count small boats and their fathers mend nets under a pale morning sky near the bridge"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))


def rows():
    texts = [None, "", " \n\t", PROSE, PROSE, PROSE.replace("quiet", "silent"), LONG, "x" * 50_000, "one two three", "▁ space ▁ mark", "tab\tand\x0bfeed\r\nend", "naïve 漢字 😀 " * 30]
    made = [(i, t, "en" if i % 2 else None, "abc"[i % 3] if i % 4 else None) for i, t in enumerate(texts)]
    made += [made[3], made[3], (None, PROSE, "en", "a"), (None, None, None, None)]
    return [(i, t, lang, source, None if t is None else len(t), "s", "h", "k", "b", "i", "n", "d") for i, t, lang, source in made]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
