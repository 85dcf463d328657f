"""Single values: JSON, hashes, model lists, amounts, labels. Every parser keeps the raw notation and says its outcome."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import DEFAULT_OCR_SOURCE, MODELS

_UNFIT = re.compile("[\x00\ud800-\udfff]")


def missing(raw: Column) -> Column:
    """`null` or `empty`, else null."""
    return F.when(raw.isNull(), "null").when(raw == "", "empty")


def _strict(text: str):
    def constant(name: str):
        raise ValueError(name)

    def fit(value):
        if isinstance(value, str) and _UNFIT.search(value):
            raise ValueError("a string that no database text can hold")
        return value

    value = json.loads(text, parse_constant=constant, parse_float=str, parse_int=str, object_pairs_hook=lambda pairs: {fit(k): fit(v) for k, v in pairs})
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, (list, dict)):
            stack.extend(v.values() if isinstance(v, dict) else v)
        # numbers were read as text without unfit characters, so the check holds for them too
        fit(v)
    return value


_NAMES = {dict: "object", list: "array", bool: "boolean", type(None): "null"}


def json_kind(text: str | None) -> str | None:
    """object, array, string, number, boolean or null for strict JSON text; invalid for other text; None for None."""
    if text is None:
        return None
    try:
        value = _strict(text)
    except (ValueError, RecursionError):
        return "invalid"
    if type(value) in _NAMES:
        return _NAMES[type(value)]
    return "string" if text.lstrip(" \t\n\r")[0] == '"' else "number"


@F.pandas_udf(T.StringType())
def json_type(raw: pd.Series) -> pd.Series:
    return raw.map(json_kind, na_action="ignore")


def json_status(raw: Column, shape: str | None = None) -> Column:
    """The outcome of reading strict JSON, of a top-level type if one is given. The text itself is the value."""
    kind = json_type(raw)
    good = (kind != "invalid") & (F.lit(True) if shape is None else kind == shape)
    return F.coalesce(missing(raw), F.when(good, "success").otherwise("failed"))


def hash_bytes(raw: Column) -> tuple[Column, Column]:
    """(32 bytes, outcome) of 64 hexadecimal digits."""
    good = raw.rlike("^[0-9a-fA-F]{64}$")
    return F.when(good, F.unhex(raw)), F.coalesce(missing(raw), F.when(good, "success").otherwise("failed"))


def model_list(raw: Column) -> tuple[Column, Column, Column]:
    """(known, outcome, unknown) of a comma-separated list of models, in order and with repeats."""
    tokens = F.transform(F.split(raw, ","), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    vocabulary = F.array(*[F.lit(m) for m in MODELS])
    known = F.filter(tokens, lambda t: F.array_contains(vocabulary, t))
    unknown = F.filter(tokens, lambda t: ~F.array_contains(vocabulary, t))
    outcome = F.when(F.size(unknown) == 0, "success").when(F.size(known) > 0, "partial").otherwise("failed")
    none = F.array().cast("array<string>")
    gone = missing(raw)
    return F.when(gone.isNull(), known).otherwise(none), F.coalesce(gone, outcome), F.when(gone.isNull(), unknown).otherwise(none)


def model_ids(known: Column) -> Column:
    """Different ids of known models, ascending."""
    lookup = F.create_map(*[F.lit(x) for m, i in MODELS.items() for x in (m, i)])
    return F.array_sort(F.array_distinct(F.transform(known, lambda m: F.element_at(lookup, m).cast("smallint"))))


def amount(value: Column) -> tuple[Column, Column]:
    """(exact decimal, whether it must be rejected): NaN and infinities are no amounts."""
    bad = value.isNotNull() & (F.isnan(value) | (F.abs(value) == float("inf")))
    return F.when(~bad, value.cast("string").cast("double").cast("decimal(28,10)")), F.coalesce(bad, F.lit(False))


def capitalize(label: Column) -> Column:
    """First character upper, the others lower."""
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1 << 30)))


def ocr_source(label: Column) -> Column:
    return F.coalesce(label, F.lit(DEFAULT_OCR_SOURCE))


def has_nul(column: Column) -> Column:
    """Whether a text holds the character that database text can't."""
    return F.coalesce(F.contains(column, F.lit("\x00")), F.lit(False))
