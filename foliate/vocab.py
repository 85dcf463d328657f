"""Closed vocabularies, as label to id."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids and labels of the target schema.
PARSE_STATUS = {"success": 1, "partial": 2, "null": 3, "failed": 4, "empty": 5}
MATCH_STATUS = {"matched": 1, "unresolved": 2}
RUN_STATUS = {"completed": 1, "crashed": 2, "interrupted": 3}
FILE_STATUS = {"success": 1, "failed": 2}
CURATED_STATUS = {"gold": 1}
CURATED_TIER = {"nuclear": 1, "critical": 2, "high": 3, "medium": 4, "supporting": 5}
MODELS = {
    "gemini-2.5-flash": 1,
    "gemini-2.5-flash-lite": 2,
    "gemini-3-flash-preview": 3,
    "deepseek-chat": 4,
    "gpt-4o-mini": 5,
    "gpt-5-nano": 6,
    "grok-2-vision-latest": 7,
    "tesseract-community": 8,
}
#: The tables that hold them.
VOCABULARIES = {"parse_statuses": PARSE_STATUS, "match_statuses": MATCH_STATUS, "run_statuses": RUN_STATUS, "file_statuses": FILE_STATUS, "curated_statuses": CURATED_STATUS, "curated_tiers": CURATED_TIER, "models": MODELS}
DEFAULT_OCR_SOURCE = "gemini-2.5-flash-lite"


def id_of(label: Column, vocabulary: dict[str, int]) -> Column:
    """The id of a label; null for a label that the vocabulary doesn't have."""
    out = F.lit(None).cast("smallint")
    for name, number in vocabulary.items():
        out = F.when(label == name, F.lit(number).cast("smallint")).otherwise(out)
    return out
