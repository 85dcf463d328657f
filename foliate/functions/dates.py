"""Dates and timestamps in many notations, with an outcome for each value.

ISO forms, American numeric forms and undelimited digits, which make up nearly all of a column, are parsed by built-in
functions. What remains is parsed once for each distinct value by an Arrow UDF and joined back.
"""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The notations that give one calendar date. Those that the earlier rules of the cascade always decide are
# left out here (numeric dates with the year last, digits only; but those with blanks stay, as more than one may stand there).
COMPLETE = (
    "%Y-%m-%d", "%B %d, %Y", "%Y-%b-%d", "%b-%d-%Y", "%d-%b-%Y", "%y-%b-%d", "%d-%b-%y", "%b-%d-%y", "%Y.%j",
    "%a %m/%d/%Y", "%a %m-%d-%Y", "%a %m.%d.%Y", "%a %b %d, %Y", "%b, %d %a %Y", "%a %m/%d/%Y %I:%M:%S %p",
    "%B %d %Y", "%Y/%m/%d", "%Y.%m.%d", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%b %d %Y", "%a, %d %b %Y",
    "%a, %b %d, %Y", "%a %b %d %Y", "%a %d %b %Y", "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S",
    "%a %b %d %H:%M:%S %Y", "%d%b%y", "%b. %d, %Y", "%d %b %y", "%a, %b %d %Y %I:%M %p", "%a, %b %d, %Y %I:%M %p",
    "%a, %b. %d, %Y", "%a. %b. %d, %Y", "%a, %m/%d/%Y", "%a, %m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M:%S %p",
    "%m/%d/%y, %I:%M %p", "%Y-%m-%dT%H:%M:%S%z", "%Y%m%dT%H%M%SZ", "%Y/%m/%d %H:%M", "%a %b %d %H:%M:%S %Z %Y",
    "%a %b %d %H:%M:%S %z %Y", "%Y-%m-%dT%H:%M:%S", "%a %b %d %I:%M:%S %p %Y", "%a %b %d %Y %I:%M:%S %p",
    "%a, %b %d %Y", "%a %d %b, %Y", "%a %b %d/%Y", "%a %d/%b/%Y", "%a %d/%m/%Y", "%d/%b/%Y", "%B-%d-%Y", "%b-%d, %Y",
    "%m %d %Y", "%m %d %y", "%d %m %Y",
)
# The notations that fix no one date. Ranges with a separator of SEPARATORS need no entry.
INCOMPLETE = ("%b %d", "%b %Y", "%B %Y", "%b %y", "%m/%d", "%a %b %d", "%a %b %d %I:%M:%S %p", "%a %b %d %H:%M %p", "%a %b %d %I:%M %p", "%a, %I:%M:%S %p", "%Y-%m", "%Y")
SEPARATORS = (" - ", " to ", " TO ", " through ")
# Spellings that become the short English ones, in this order, in these letters and all lower or upper.
WEEKDAYS = {"Mon": ("Monday", "Mon"), "Tue": ("Tuesday", "Tues", "Tue"), "Wed": ("Wednesday", "Wed"), "Thu": ("Thursday", "Thurs", "Thur", "Thu"), "Fri": ("Friday", "Fri"), "Sat": ("Saturday", "Sat"), "Sun": ("Sunday", "Sun")}
MONTHS = {
    "Jan": ("January", "Jan", "Januar"), "Feb": ("February", "Feb", "Februar"), "Mar": ("March", "Mar", "März"), "Apr": ("April", "Apr"),
    "May": ("May",), "Jun": ("June", "Jun", "Juni"), "Jul": ("July", "Jul", "Juli"), "Aug": ("August", "Aug"), "Sep": ("September", "Sep", "Sept"),
    "Oct": ("October", "Oct", "Oktober"), "Nov": ("November", "Nov"), "Dec": ("December", "Dec", "Dezember"),
}

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
AMERICAN = r"^(\d{1,2})[./,\- ](\d{1,2})[./,\- ]'?(\d{2}|\d{4})$"
DIGITS = r"^(\d{6}|\d{8})$"
CLOCK = r"\d{1,2}:\d{2}|\d{8}T\d{6}"

#: value: wall-clock time, of UTC if zoned; zoned: whether the notation has an offset; status: the outcome.
PARSED = T.StructType([T.StructField("value", T.TimestampNTZType()), T.StructField("zoned", T.BooleanType()), T.StructField("status", T.StringType())])
_SPELLINGS = [(form, short) for names in (WEEKDAYS, MONTHS) for short, long in names.items() for word in long for form in (word, word.lower(), word.upper())]
_ORDINAL = re.compile(r"(?<=\d)(?:st|nd|rd|th)\b", re.I)


def _read(text: str, formats: tuple[str, ...], suffix: str = "") -> datetime | None:
    for f in formats:
        try:
            return datetime.strptime(text + suffix, f + suffix.replace("2000", "%Y"))
        except ValueError:
            continue
    return None


def _by_names(raw: str) -> tuple[datetime | None, bool, str]:
    """The rules for values with names of days and months, or with parts missing."""
    text = raw
    for form, short in _SPELLINGS:
        text = text.replace(form, short)
    text = _ORDINAL.sub("", text)
    partial = any(s in text for s in SEPARATORS) or re.fullmatch(r"Q[1-4] \d{4}|\d{4}\s*[-–/]\s*\d{4}", text)
    if not partial:
        with_year = tuple(f for f in INCOMPLETE if "%Y" in f or "%y" in f)
        without = tuple(f for f in INCOMPLETE if f not in with_year)
        partial = _read(text, with_year) or _read(text, without, " 2000")  # a leap year, so that February 29 counts
    if partial:
        return None, False, "partial"
    # Renaming may have made one of the plain forms out of the value.
    if m := re.fullmatch(AMERICAN, text):
        month, day, year = m.groups()
        found = _read(f"{month}/{day}/{year}", ("%m/%d/%y" if len(year) == 2 else "%m/%d/%Y",))
    elif re.fullmatch(DIGITS, text):
        found = _read(text, ("%m%d%y",) if len(text) == 6 else ("%m%d%Y", "%Y%m%d"))
    else:
        found = _read(text, COMPLETE)
    if found is None:
        return None, False, "failed"
    zoned = found.utcoffset() is not None
    return (found - found.utcoffset() if zoned else found).replace(tzinfo=None), zoned, "success"


@F.pandas_udf(PARSED)
def parse_by_names(raw: pd.Series) -> pd.DataFrame:
    rows = [_by_names(x) if x is not None else (None, False, "null") for x in raw]
    return pd.DataFrame(rows, columns=["value", "zoned", "status"]).astype({"value": "datetime64[us]"})


def strip(text: Column) -> Column:
    """Without leading and trailing white space, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def with_plain(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with a struct of PARSED for the notations that built-in functions read, and null for the others.

    The form of a value is found first, then one date in year-month-day order from the parts of every form, so that each value
    is parsed once; separate steps keep the generated code small.
    """
    text = F.col("__text")
    form = (
        F.when(F.col(column).isNull(), "null").when(text == "", "empty").when(text.rlike(ISO), F.when(F.length(text) > 10, "moment").otherwise("iso")).when(text.rlike(AMERICAN), "american").when(text.rlike(DIGITS), "digits")
    )
    # Two-digit years below 69 are of this century.
    century = lambda two: F.concat(F.when(two < "69", "20").otherwise("19"), two)
    month, day, year = (F.regexp_extract(text, AMERICAN, i) for i in (1, 2, 3))
    american = F.concat_ws("-", F.when(F.length(year) == 2, century(year)).otherwise(year), month, day)
    cut = lambda y, n, m, d: F.concat_ws("-", F.substring(text, y, n), F.substring(text, m, 2), F.substring(text, d, 2))
    six = F.concat_ws("-", century(F.substring(text, 5, 2)), F.substring(text, 1, 2), F.substring(text, 3, 2))
    digits = F.when(F.length(text) == 6, six).otherwise(cut(5, 4, 1, 3))
    is_ = lambda *names: F.col("__form").isin(*names)
    steps = df.withColumn("__text", strip(F.col(column))).withColumn("__form", form)
    steps = steps.withColumn("__day", F.when(is_("iso"), text).when(is_("american"), american).when(is_("digits"), digits))
    # Eight digits that are no American date may begin with the year. A fraction is cut after microseconds.
    steps = steps.withColumn("__other", F.when(is_("digits") & (F.length(text) == 8), cut(1, 4, 5, 7)))
    steps = steps.withColumn("__moment", F.when(is_("moment"), F.regexp_replace(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    parsed = F.coalesce(F.try_to_timestamp("__day", F.lit("yyyy-M-d")), F.try_to_timestamp("__other", F.lit("yyyy-M-d")), F.try_to_timestamp("__moment"))
    steps = steps.withColumn("__value", parsed.cast("timestamp_ntz"))
    status = F.when(is_("null", "empty"), F.col("__form")).when(F.col("__value").isNotNull(), "success").otherwise("failed")
    zoned = is_("moment") & text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    result = F.struct(F.col("__value").alias("value"), zoned.alias("zoned"), status.alias("status"))
    return steps.withColumn(out, F.when(F.col("__form").isNotNull(), result)).drop("__text", "__form", "__day", "__other", "__moment", "__value")


def with_parsed(df: DataFrame, column: str, out: str = "__parsed") -> DataFrame:
    """df with a struct of PARSED for a text column. Values that need the slow path go through it once each."""
    plain = with_plain(df, column, out)
    slow = plain.where(F.col(out).isNull()).select(F.col(column).alias("__raw")).distinct()
    slow = slow.withColumn("__slow", parse_by_names(strip(F.col("__raw"))))
    joined = plain.join(slow, F.col(column) == F.col("__raw"), "left")
    return joined.withColumn(out, F.coalesce(out, "__slow")).drop("__raw", "__slow")


def as_kind(parsed: Column, raw: Column, kind: str) -> tuple[Column, Column, Column]:
    """(value, status, local) of a parsed struct for a date, timestamp or timestamptz column.

    A timestamp needs a time of day and no offset, a timestamptz an offset; what lacks it is partial. For a timestamptz
    the wall-clock time without an offset is returned as local.
    """
    value, status, zoned = parsed["value"], parsed["status"], parsed["zoned"]
    done = value.isNotNull()
    if kind == "date":
        return value.cast("date"), status, F.lit(None).cast("timestamp_ntz")
    timed = done & raw.rlike(CLOCK)
    wanted = timed & (zoned if kind == "timestamptz" else ~zoned)
    outcome = F.when(~done, status).when(wanted, status).otherwise(F.lit("partial"))
    local = F.when(timed & ~zoned, value) if kind == "timestamptz" else F.lit(None).cast("timestamp_ntz")
    held = F.when(wanted, value.cast("timestamp") if kind == "timestamptz" else value)
    return held, outcome, local


def date_shape(raw: Column) -> Column:
    """valid_iso_date, invalid_iso_date or other_notation; null for null."""
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(raw.isNull(), F.lit(None)).when(iso & F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).isNotNull(), "valid_iso_date").when(iso, "invalid_iso_date").otherwise("other_notation")
