"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("size", "digest", "place", "key", "d", "h", "batch", "held", "kept", "__size", "score")]
)
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))


def base_rows():
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e f g h", "Émile ça và\x0bbien\x0cnon\rfin", LONG, "  x", "same text here now please", "same text here now please"]
    rows = [(i, t, "en", ("b", "a", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(20, "repeated row of some words to take", "en", "a", 5)] * 3
    rows += [(None, "a text without an id but with words", "fr", "b", 1), (30, None, None, None, None)]
    rows += [(100 + i, " ".join(f"w{(i * 7 + j * j) % 53}" for j in range(20 + 13 * i % 90)), "en", "abc"[i % 3], 0) for i in range(40)]
    return rows


def frame(spark, rows=None):
    rows = base_rows() if rows is None else rows
    return spark.createDataFrame([(*r, *[7] * 11) for r in rows], DOCS).repartition(3)


def words(text):
    return WORD.findall(text or "")
