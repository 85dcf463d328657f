"""English full-text vectors and queries: words, stop words, stems, positions.

The stems follow the published English Snowball algorithm. Words are runs of letters and digits; the URL, e-mail and hyphen
tokens that a database's own parser makes are not imitated.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))
#: Texts of documents with more bytes have an empty vector.
MAX_BYTES = 1_048_575
MAX_POSITION = 16383

# The English stop words.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
# Words with stems of their own, and words that stop the algorithm early.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
INVARIANT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_WORD = re.compile(r"[^\W_]+")
_VOWEL = "aeiouy"


def _region(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel, from start on."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@functools.lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in INVARIANT:
        return word
    # A y at the beginning or after a vowel is a consonant, written Y meanwhile.
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word.lstrip("'"))
    special = re.match(r"gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)

    # Plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in INVARIANT_1A:
        return w.lower()

    # Past and progressive forms
    m = re.search(r"(eed|eedly|ed|edly|ing|ingly)$", w)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(f"[{_VOWEL}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    def longest(endings) -> str:
        return max((e for e in endings if w.endswith(e)), key=len, default="")

    # Derivational endings
    e = longest([*STEP2, "ogi", "li"])
    if e and len(w) - len(e) >= r1:
        base = w[: -len(e)]
        if e in STEP2:
            w = base + STEP2[e]
        elif (e == "ogi" and base.endswith("l")) or (e == "li" and base[-1:] in tuple("cdeghkmnrt")):
            w = base + ("og" if e == "ogi" else "")
    e = longest([*STEP3, "ative"])
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + STEP3[e]
    e = longest([*STEP4, "ion"])
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]

    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _short_syllable_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str) -> list[tuple[str, list[int]]]:
    """(lexeme, positions), by lexeme; stop words have positions but aren't kept."""
    found: dict[str, list[int]] = {}
    for i, word in enumerate(_WORD.findall(text.lower()), 1):
        if word not in STOP:
            found.setdefault(stem(word), []).append(min(i, MAX_POSITION))
    return sorted(found.items())


@F.pandas_udf(VECTOR)
def _vector(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"lexeme": w, "positions": p} for w, p in lexemes(t)], na_action="ignore")


def text_vector(text: Column, max_bytes: int | None = None) -> Column:
    """The vector of a text; null for null, empty for a text of more than max_bytes bytes."""
    if max_bytes is None:
        return _vector(text)
    large = F.octet_length(text) > max_bytes
    return F.when(large, F.array().cast(VECTOR)).otherwise(_vector(F.when(~large, text)))


def query_lexemes(query: str) -> list[str]:
    """The lexemes that a plain query asks for, all of them."""
    return [w for w, _ in lexemes(query)]


def matches_vector(vector: Column, query: str) -> Column:
    """Whether a vector has all lexemes of a plain query; a query of stop words matches nothing."""
    wanted = query_lexemes(query)
    if not wanted:
        return F.lit(False)
    have = F.transform(vector, lambda x: x["lexeme"])
    return F.coalesce(F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in wanted]))) == len(wanted), F.lit(False))


def matches_text(text: Column, query: str) -> Column:
    """The same for a text without a vector: a built-in search for the lexemes' first letters spares most texts the UDF.

    A word and its stem share all but the last letters, so a text that matches has a word that begins like each lexeme.
    """
    wanted = query_lexemes(query)
    if not wanted:
        return F.lit(False)
    lower = F.lower(text)
    maybe = F.lit(True)
    for w in wanted:
        head = w[:1] if w in IRREGULAR.values() else w if len(w) < 3 else w[:-1] if len(w) < 5 else w[:-2]
        maybe = maybe & lower.rlike(r"(?U)(?<![\p{L}\p{N}])" + re.escape(head))

    @F.pandas_udf(T.BooleanType())
    def exact(texts: pd.Series) -> pd.Series:
        def all_in(t: str | None) -> bool:
            if t is None:
                return False
            have = {stem(w) for w in _WORD.findall(t.lower()) if w not in STOP}
            return all(w in have for w in wanted)

        return texts.map(all_in).astype(bool)

    return F.coalesce(maybe & exact(F.when(maybe, text)), F.lit(False))
