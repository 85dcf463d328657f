import pytest
from pyspark.sql import functions as F

from foliate.functions import dates, fulltext, parsing, trigrams

DATES = """not a date|failed|
2025-02-30|failed|
2006|partial|
04/05|partial|
Q1 2000|partial|
2000-02-13|success|2000-02-13
02/13/2000|success|2000-02-13
February 13th, 2000|success|2000-02-13
13 Feb 2000|success|2000-02-13
04-05-00|success|2000-04-05
4/5/00|success|2000-04-05
4,5,00|success|2000-04-05
4 5 2000|success|2000-04-05
040500|success|2000-04-05
04052000|success|2000-04-05
20000405|success|2000-04-05
2000/04/05|success|2000-04-05
06-04-'09|success|2009-06-04
12/31/99|success|1999-12-31
02/29/00|success|2000-02-29
13/02/2000|failed|
02/29/01|failed|
00/05/2000|failed|
April 5-9|failed|
August 10-31, 2013|failed|
September 20 and 21|failed|
September/October 2015|failed|
Apr 01 2015-Apr 30 2015|failed|
1992-1993|partial|
9/1/10 to 9/30/10|partial|
letter to Bob|partial|
Feb 4|partial|
MAR 99|partial|
1998-09|partial|
Sat May 5|partial|
Tue May 8 20:05 PM|partial|
Thursday, 12:49:51 PM|partial|
13/08/19|failed|
31121999|failed|
990108|failed|
1/3/1968|success|1968-01-03
1/3/68|success|2068-01-03
1/3/69|success|1969-01-03
2017-3-1|success|2017-03-01
Sept 9th 2001|success|2001-09-09
Jan. 28, 2018|success|2018-01-28
05JUL18|success|2018-07-05
Jan-18, 2011|success|2011-01-18
1999.008|success|1999-01-08
99-Jan-08|success|1999-01-08
Tue 26/Oct/2010|success|2010-10-26
Sat. Dec. 16, 2017|success|2017-12-16
Sun, 2 Mar 2014|success|2014-03-02
Sunday, July 9, 2017 4:45 PM|success|2017-07-09
11/26/21, 6:53 PM|success|2021-11-26
Dec 18, 2012 2:45 pm|failed|
Wed Nov 30 07:40:22 EST 2022|failed|
13. März 2015|failed|
Mai 3, 2015|failed|
2013-00-00|failed|
Thu, 31 Feb 2010|failed|"""


def test_dates(spark):
    rows = [tuple(x.split("|")) for x in DATES.split("\n")] + [(None, "null", ""), ("", "empty", ""), ("  ", "empty", "")]
    df = dates.with_parsed(spark.createDataFrame(rows, "raw string, want string, day string"), "raw")
    value, status, _ = dates.as_kind(F.col("__parsed"), F.col("raw"), "date")
    for r in df.select("raw", "want", "day", status.alias("status"), value.cast("string").alias("got")).collect():
        assert (r.status, r.got or "") == (r.want, r.day), r


def test_timestamps(spark):
    rows = [("2000-02-13",), ("2000-02-13T15:01:02",), ("2000-02-13T15:01:02.123456+02:00",), ("20120606T120702Z",), ("Wed Nov 30 18:23:54 +0000 2022",)]
    df = dates.with_parsed(spark.createDataFrame(rows, "raw string"), "raw")
    stamp, zoned = (dates.as_kind(F.col("__parsed"), F.col("raw"), k) for k in ("timestamp", "timestamptz"))
    got = {r.raw: tuple(map(str, r[1:])) for r in df.select("raw", stamp[0].alias("a"), stamp[1].alias("b"), zoned[0].cast("timestamp_ntz").alias("c"), zoned[1].alias("d"), zoned[2].alias("e")).collect()}
    assert got["2000-02-13"] == ("None", "partial", "None", "partial", "None")
    assert got["2000-02-13T15:01:02"] == ("2000-02-13 15:01:02", "success", "None", "partial", "2000-02-13 15:01:02")
    assert got["2000-02-13T15:01:02.123456+02:00"] == ("None", "partial", "2000-02-13 13:01:02.123456", "success", "None")
    assert got["20120606T120702Z"][2:] == ("None", "partial", "2012-06-06 12:07:02")
    assert got["Wed Nov 30 18:23:54 +0000 2022"][2:4] == ("2022-11-30 18:23:54", "success")


JSON = [(None, None, "null"), ("", None, "empty"), ("{", None, "failed"), ("{}", "array", "failed"), ("NaN", None, "failed"), ('"\\u0000"', None, "failed"), ('"\\ud800"', None, "failed"), ('{"number":0.12345678901234567890123456789,"value":null}', "object", "success"), ("null", None, "success"), ("[1,2] x", None, "failed"), ('{"\\u0000":1}', None, "failed"), ('{"a":1,"a":2}', "object", "success"), ("[" * 100_000, None, "failed")]


@pytest.mark.parametrize("shape", [None, "array", "object"])
def test_json(spark, shape):
    rows = [(raw, want) for raw, s, want in JSON if s == shape]
    got = spark.createDataFrame(rows, "raw string, want string").select("want", parsing.json_status(F.col("raw"), shape).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_json_kinds():
    assert [parsing.json_kind(x) for x in ("{}", "[]", "true", "null", '"s"', " 1.5", "-0", "x", None)] == ["object", "array", "boolean", "null", "string", "number", "number", "invalid", None]


def test_hashes_models_amounts_labels(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(*parsing.hash_bytes(F.lit("AB" * 32))) == (bytearray(b"\xab" * 32), "success")
    assert one(*parsing.hash_bytes(F.lit("ab"))) == (None, "failed") and one(*parsing.hash_bytes(F.lit(None).cast("string"))) == (None, "null")
    known, status, unknown = one(*parsing.model_list(F.lit(" gpt-5-nano,deepseek-chat,gpt-5-nano,unlisted ")))
    assert (known, status, unknown) == (["gpt-5-nano", "deepseek-chat", "gpt-5-nano"], "partial", ["unlisted"])
    assert one(*parsing.model_list(F.lit("unlisted"))) == ([], "failed", ["unlisted"])
    assert one(*parsing.model_list(F.lit(None).cast("string"))) == ([], "null", [])
    assert [str(one(*parsing.amount(F.lit(x).cast("double")))) for x in (-0.123456789, None)] == ["(Decimal('-0.1234567890'), False)", "(None, False)"]
    assert all(one(*parsing.amount(F.lit(float(x)))) == (None, True) for x in ("nan", "inf", "-inf"))
    assert one(parsing.capitalize(F.lit("eMAIL")), parsing.ocr_source(F.lit(None).cast("string")), parsing.ocr_source(F.lit(""))) == ("Email", "gemini-2.5-flash-lite", "")
    assert one(parsing.has_nul(F.lit("a\x00b")), parsing.has_nul(F.lit("ab")), parsing.has_nul(F.lit(None).cast("string"))) == (True, False, False)


STEMS = "cats:cat running:run existing:exist consignment:consign relational:relat happy:happi hopping:hop hoping:hope aires:air flying:fli skies:sky dying:die national:nation communication:communic agreed:agre university:univers electricity:electr goodness:good adjustment:adjust adoption:adopt rate:rate ties:tie cries:cri gas:gas kiwis:kiwi say:say cry:cri replacement:replac formative:format psychology:psycholog bed:bed"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split(":")
    assert fulltext.stem(word) == want


def test_vectors(spark):
    limit = fulltext.MAX_BYTES
    texts = ["The cats are running.", "", None, "cat" + " " * (limit - 3), "cat" + " " * (limit - 2), "cat" + "é" * (limit // 2)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fulltext.text_vector(F.col("t"), limit).alias("v"), fulltext.text_vector(F.substring("t", 1, 4)).alias("chunk")).orderBy("i").collect()
    v = [None if r.v is None else [(x.lexeme, x.positions) for x in r.v] for r in got]
    assert v[0] == [("cat", [2]), ("run", [4])] and v[1] == [] and v[2] is None and v[3] == [("cat", [1])] and v[4] == [] and v[5] == []


def test_matching(spark):
    texts = ["the air was thin", "airs and graces", "fairly", None, "the", "a dying fire", "die"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ids = lambda c: [r.i for r in df.where(c).orderBy("i").collect()]
    assert ids(fulltext.matches_text(F.col("t"), "air")) == ids(fulltext.matches_vector(fulltext.text_vector(F.col("t")), "air")) == [0, 1]
    assert ids(fulltext.matches_text(F.col("t"), "die")) == [5, 6]
    assert ids(fulltext.matches_text(F.col("t"), "the")) == [] and ids(fulltext.matches_text(F.col("t"), "thin air")) == [0]


def test_trigrams(spark):
    assert trigrams.best_extent("word", "two words") == pytest.approx(0.8)
    assert trigrams.best_extent("word", "two words", True) == pytest.approx(4 / 7)
    assert trigrams.best_extent("fliht", "a flight to") == pytest.approx(0.5)
    assert trigrams.best_extent("fliht", "a flight to", True) == pytest.approx(4 / 9)
    one = spark.range(1).select(trigrams.trigrams(F.lit("Cat, dog")).alias("g"), trigrams.similarity(trigrams.trigrams(F.lit("word")), trigrams.trigrams(F.lit("two words"))).alias("s")).first()
    assert sorted(one.g) == sorted(["  c", " ca", "cat", "at ", "  d", " do", "dog", "og "]) and one.s == pytest.approx(4 / 11)


def brute_extent(query, text):
    wanted, grams = set(trigrams._grams(query)[0]), trigrams._grams(text)[0]
    return max((len(wanted & set(grams[i:j])) / len(wanted | set(grams[i:j])) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)), default=0.0)


@pytest.mark.parametrize("text", ["abc abd", "xyz", "", "bcab cabc abcabc", "ab ab ab ab", "zab cab"])
def test_extents_against_all_runs(text):
    assert trigrams.best_extent("abcab", text) == pytest.approx(brute_extent("abcab", text))
