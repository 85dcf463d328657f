"""Surrogates for personal data and credentials.

Detected entities are replaced by others of their kind: keyed, so that nobody without the key can undo it, the same for every
mention of an entity in the corpus, and in the mention's own notation. Numbers, keys and letters go through keyed
permutations of all strings of their format, which keep different entities different by construction; card numbers keep a
valid check digit, addresses stay addresses, given names keep gender and script. What a permutation can't promise (a value
that maps to itself, two given names that share one of a list) a check over all entities of the corpus finds and re-keys:
the first of a list's name keeps it, other given names get letters of their script.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, stash
from .words import slices, tidy

#: Bytes that a key must have at least.
LEAST_KEY = 16
MAX_ATTEMPTS = 16
#: Re-keyed entities up to which every task is sent all of them; beyond, tasks read the parts of a table that they need.
MAX_SENT, PARTS = 10_000, 256
#: Bytes of texts that are rewritten at a time.
SLICE_BYTES = 4 << 20

# Given names by script and gender, titles by gender, endings that hold no name.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Greta Helen Ida Jana Julia Laura Lena Lucia Maria Marta Nina Olga Paula Rosa Sara Sofia Vera".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Leon Lukas Marco Martin Oscar Paul Peter Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Максим Олег Павел Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|госпожа|κυρία",
    "m": "Mr|Herr|Monsieur|Señor|господин|κύριος",
}
KEPT_DOMAINS = ("example.com", "example.net", "example.org")
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзклмнпрстфхцчш", "greek": "βγδζθκλμνξπρστφχψ"}


# Keyed permutations


# A tag begins with the secret key, which keys BLAKE2 as well as its own key argument does.


def _prf(tag: str, half: int, bits: int) -> int:
    digest = hashlib.blake2b(f"{tag}/{half}".encode(), digest_size=32).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def permute(x: int, size: int, tag: str) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked until it falls inside."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for i in range(8):
            left, right = right, left ^ _prf(f"{tag}/{i}", right, half)
        x = left << half | right
        if x < size:
            return x


def permute_letters(text: str, alphabets: list[str], tag: str) -> str:
    """text with every character that its alphabet holds replaced; the alphabets are the format."""
    if not any(alphabets):
        return text
    number, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
    shape = ",".join(f"{i}{a[0]}{len(a)}" for i, a in enumerate(alphabets) if a)
    number, out = permute(number, size, f"{tag}:{shape}"), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        out.append(a[number % len(a)] if a else c)
        number = number // len(a) if a else number
    return "".join(reversed(out))


DIGITS, HEX, BASE32 = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else ""


# Kinds: how an entity is found, its canonical form, and the surrogate of that form


def luhn_digit(digits: str) -> str:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(x: str, tag: str) -> str:
    body = x[0] + permute_letters(x[1:-1], [DIGITS] * (len(x) - 2), tag)
    return body + luhn_digit(body)


def _iban_digits(x: str) -> str:
    number = int("".join(str(int(c, 36)) for c in x[4:] + x[:2] + "00"))
    return f"{98 - number % 97:02d}"


def _iban(x: str, tag: str) -> str:
    rest = permute_letters(x[4:], [_alphabet(c) for c in x[4:]], tag)
    return x[:2] + _iban_digits(x[:2] + "00" + rest) + rest


def _phone(x: str, tag: str) -> str:
    # A number in international notation keeps its country code: +1 and +7 have one digit, others are taken to have two.
    keep = 0 if x[0] != "+" else 2 if x[1] in "17" else 3
    return x[:keep] + permute_letters(x[keep:], [DIGITS] * (len(x) - keep), tag)


def _ip(x: str, tag: str) -> str:
    number, size, out = 0, 1, []
    spans = [(0, 10) if len(o) == 1 else (10, 90) if len(o) == 2 else (100, 156) for o in x.split(".")]
    for o, (low, n) in zip(x.split("."), spans, strict=True):
        number, size = number * n + int(o) - low, size * n
    number = permute(number, size, f"{tag}:{spans}")
    for low, n in reversed(spans):
        out.append(str(low + number % n))
        number //= n
    return ".".join(reversed(out))


def _email(x: str, tag: str) -> str:
    local, _, domain = x.rpartition("@")
    kept = next((d for d in KEPT_DOMAINS if domain == d or domain.endswith("." + d)), domain.rpartition(".")[2])
    head = domain[: len(domain) - len(kept)]
    hide = lambda s, t: permute_letters(s, [_alphabet(c) for c in s], t)
    return f"{hide(local, tag)}@{hide(head, tag.partition('/')[0] + ':domain')}{kept}"


def _script(x: str) -> str:
    c = next((c for c in x if c.isalpha()), "a")
    if c < "\u0250" or "\u1e00" <= c < "\u1f00":
        return "latin"
    return "cyrillic" if "\u0400" <= c <= "\u052f" else "greek" if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" else "other"


#: First and last character of scripts whose letters are one alphabet here.
WIDE = (("\u4e00", "\u9fff"), ("\uac00", "\ud7a3"))


@functools.lru_cache(1024)
def _page(first: int, last: int, category: str, sound: str) -> str:
    """The letters from first to last of a category that have one capital of their own, or none, and a vowel or consonant as base."""
    out = [c for c in map(chr, range(first, last + 1)) if unicodedata.category(c) == category and c.upper().lower() == c and len(c.upper()) == 1]
    return "".join(c for c in out if _sound(c) == sound)


def _sound(c: str) -> str:
    base = unicodedata.normalize("NFD", c)[0]
    return next((f"{kind}{script}" for kind, table in (("v", VOWELS), ("c", CONSONANTS)) for script, letters in table.items() if base in letters), "")


def _letters(c: str) -> str:
    """The letters that c, a small letter or one without case, is exchanged with: those of its script and kind; itself if there are none."""
    for table in (VOWELS, CONSONANTS):
        for letters in table.values():
            if c in letters:
                return letters
    if not c.isalpha():
        return ""
    first, last = next(((ord(a), ord(b)) for a, b in WIDE if a <= c <= b), (ord(c) & ~127, ord(c) | 127))
    found = _page(max(first, 128), last, unicodedata.category(c), _sound(c))
    return found if c in found else ""


def _draw(x: str, tag: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}\0{x}".encode(), digest_size=32).digest(), "big")


def _drawn_name(x: str, tag: str) -> str:
    """Letters of the name's script, drawn by a keyed hash: for names of other letters, or of a format that is full."""
    script, number, out = _script(x), _draw(x, tag), []
    wide = next((a for c in x if (a := _letters(c))), LOWER)
    for i in range(12 if script != "other" else 6):
        letters = (CONSONANTS, VOWELS)[i % 2].get(script, wide)
        out.append(letters[number % len(letters)])
        number //= len(letters)
    return "".join(out)


def _drawn_ip(x: str, tag: str) -> str:
    number = _draw(x, tag)
    return ".".join(str(100 + (number >> 32 * i) % 156) for i in range(4))


def _surname(x: str, tag: str) -> str:
    alphabets = [_letters(c) for c in x]
    return permute_letters(x, alphabets, tag) if any(len(a) > 1 for a in alphabets) else _drawn_name(x, tag)


def _given(x: str, tag: str) -> str:
    gender, _, name = x.partition(":")
    names = GIVEN.get((_script(name), gender))
    if "/" in tag or not names:  # another has the list's name, or the script has no list
        return f"{gender}:{_surname(name, tag)}"
    return f"{gender}:{names[_prf(tag, int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), 'big'), 32) % len(names)].lower()}"


def _hidden(alphabet: str, keep: int = 0) -> Callable[[str, str], str]:
    return lambda x, tag: x[:keep] + permute_letters(x[keep:], [alphabet if c in alphabet else "" for c in x[keep:]], tag)


SURROGATES: dict[str, Callable[[str, str], str]] = {
    "email": _email,
    "card": _card,
    "iban": _iban,
    "phone": _phone,
    "ip": _ip,
    "national_id": _hidden(DIGITS),
    "access_key": _hidden(BASE32 + "0189", 4),
    "secret": lambda x, tag: _hidden(HEX if set(x) <= set(HEX) else LOWER + DIGITS)(x, tag),
    "surname": _surname,
    "given_name": _given,
}
#: Surrogates in another format, where the entity's own leaves none after MAX_ATTEMPTS: formats that can be short.
SPARE: dict[str, Callable[[str, str], str]] = {
    "email": lambda x, tag: f"{_drawn_name('a', tag + x)}@{_email(x, tag).rpartition('@')[2]}",
    "ip": _drawn_ip,
    "surname": _drawn_name,
    "given_name": lambda x, tag: f"{x[:2]}{_drawn_name(x[2:], tag)}",
}

_PERSON = "|".join(f"(?P<{g}>{t})" for g, t in TITLES.items())
#: What follows isn't a blank and an address: numbers in groups would take in its first octets.
_NO_IP = r"(?! (?:\d{1,3}\.){3}\d)"
_FIND = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    r"|(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    rf"|(?P<phone>(?<![\w+])(?:\+1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\w|-\d)|\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:{_NO_IP}[ .-]?\d{{2,4}}){{2,4}}"
    r"|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|-\d))"
    r"|(?<![\w-])(?P<national_id>\d{3}-\d{2}-\d{4})(?![\w-])"
    rf"|(?<!\w)(?P<card>\d(?:{_NO_IP}[ -]?\d){{12,18}})(?!\w)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?!\w)"
    r"|(?<!\w)(?P<access_key>A(?:KIA|SIA)[A-Z0-9]{16})(?!\w)"
    r"|(?i:(?<![A-Za-z0-9])(?:token|password|passwd|secret|api[_-]?key)\b[\"']?\s?[=:]\s?[\"']?(?P<secret>[A-Za-z0-9_/+-]{8,}))"
    rf"|\b(?:{_PERSON})\.? (?P<names>[^\W\d_a-zа-яα-ω][^\W\d_]+(?: [^\W\d_a-zа-яα-ω][^\W\d_]+)?)"
)
#: Cheap: a text without any of these has nothing that _FIND finds.
_MAYBE = re.compile(rf"\d[ .-]?\d|@|AKIA|ASIA|\b(?:{'|'.join(TITLES.values())})\b|(?i:token|password|passwd|secret|api[_-]?key)")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    original: str


def _valid(kind: str, value: str) -> str | None:
    """The canonical form of a card or an IBAN, None if its length or check digits are wrong."""
    original = re.sub(r"[^0-9a-z]", "", value.lower())
    if kind == "card":
        return original if 13 <= len(original) <= 19 and luhn_digit(original[:-1]) == original[-1] else None
    if not 15 <= len(original) <= 34 or int("".join(str(int(c, 36)) for c in original[4:] + original[:4])) % 97 != 1:
        return None
    return original[:4].upper() + original[4:]


def _longest_valid(kind: str, value: str) -> tuple[str, str | None]:
    """The longest start of a card's or IBAN's match that ends at a separator or with the match and is valid, and its
    canonical form: the patterns take in an expiry date or a word that follows."""
    for end in (len(value), *(m.start() for m in reversed(list(re.finditer("[ -]", value))))):
        if original := _valid(kind, value[:end]):
            return value[:end], original
    return value, None


def find(text: str) -> list[Mention]:
    """The mentions in a text, in order."""
    if not _MAYBE.search(text):
        return []
    out, after = [], 0
    while m := _FIND.search(text, after):
        after, kind = m.end(), m.lastgroup
        if m["names"]:
            gender = "f" if m["f"] else "m"
            parts = list(re.finditer(r"\S+", m["names"]))
            for i, p in enumerate(parts):
                first = i == 0 and len(parts) == 2
                at = m.start("names") + p.start()
                out.append(Mention(at, at + len(p[0]), "given_name" if first else "surname", (f"{gender}:" if first else "") + p[0].lower()))
            continue
        value, original = m[kind], m[kind].lower()
        if kind in ("card", "iban"):
            value, original = _longest_valid(kind, value)
            # What isn't one, or follows it in the match, may hold others.
            after = m.start() + (len(value) if original else 1)
            if not original:
                continue
        if kind == "phone":
            original = re.sub(r"[^0-9a-z+]", "", original)
        if kind == "ip" and any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in original.split(".")):
            continue
        out.append(Mention(m.start(kind), m.start(kind) + len(value), kind, original))
    return out


@functools.lru_cache(10_000)
def surrogate(kind: str, original: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a canonical form under a secret key; attempts past 0 are other keys."""
    how = SPARE.get(kind, SURROGATES[kind]) if attempt >= MAX_ATTEMPTS else SURROGATES[kind]
    tag = f"{key.hex()}:{kind}"
    return how(original, f"{tag}/{attempt}" if attempt else tag)


def _notation(mention: str, kind: str, new: str) -> str:
    """The surrogate's canonical form in the mention's notation: its separators, and its case letter by letter."""
    if kind == "given_name":
        new = new.partition(":")[2]
        return new.upper() if mention.isupper() else new.capitalize()
    letters, out = iter(new), []
    for c in mention:
        if kind in ("card", "iban", "phone") and not (c.isalnum() or c == "+"):
            out.append(c)
            continue
        n = next(letters, "")
        out.append(n.upper() if c.isupper() or (c.isdigit() and n.isalpha() and mention.isupper()) else n)
    return "".join(out) + "".join(letters)


def replace(text: str, key: bytes, attempt: Callable[[str, str], int] = lambda kind, original: 0) -> tuple[str, list[Mention]]:
    """The text with surrogates, and the mentions that were found."""
    out, at, mentions = [], 0, find(text)
    for m in mentions:
        out += [text[at : m.start], _notation(text[m.start : m.end], m.kind, surrogate(m.kind, m.original, key, attempt(m.kind, m.original)))]
        at = m.end
    return ("".join([*out, text[at:]]) if mentions else text), mentions


# The operator


def entities(docs: DataFrame) -> DataFrame:
    """The different (kind, original) of all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            found = {(m.kind, m.original) for text in batch.column(0) if text.is_valid for m in find(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else ([], []))], names=["kind", "original"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, original string").distinct()


def rekeyed(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, original, attempt) of the entities whose first surrogate won't do: it is the entity itself or another one of
    the corpus, or another entity has it too. Of those that share one, the first keeps it. Given names may be those of
    others in the corpus, as people's are; no two get the same one. What is left after the last attempt, in another format,
    is an error.
    """

    @tidy
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, o, key, a) for k, o, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "original", "attempt", "surrogate"])

    schema = "kind string, original string, attempt int, surrogate string"
    now = stash(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "pii-surrogates")
    originals = found.select("kind", F.col("original").alias("surrogate"))
    for done in range(MAX_ATTEMPTS + 1):
        shared = now.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min_by("original", F.struct("attempt", "original")).alias("first")).where("n > 1")
        clash = now.join(shared, ["kind", "surrogate"]).where("original <> first").select("kind", "original")
        leaks = now.where("kind <> 'given_name' or original = surrogate").join(originals, ["kind", "surrogate"], "left_semi").select("kind", "original")
        again = stash(clash.unionByName(leaks).distinct(), "pii-clashes")
        if again.isEmpty():
            break
        if done == MAX_ATTEMPTS:
            left = ", ".join(f"{r[0]}: {r[1]}" for r in again.groupBy("kind").count().orderBy("kind").collect())
            raise ValueError(f"entities without a surrogate of their own: {left}")
        better = now.join(again, ["kind", "original"]).withColumn("attempt", F.col("attempt") + 1).select("kind", "original", "attempt").mapInArrow(draw, schema)
        now = stash(now.join(again, ["kind", "original"], "left_anti").unionByName(better), "pii-surrogates")
    return now.where("attempt > 0").select("kind", "original", "attempt")


class Attempts:
    """Looks attempts up: in a dict that was sent, or in the part of a table that holds the entity."""

    def __init__(self, sent: dict[tuple[str, str], int] | None, path: str | None):
        self.sent, self.path, self.parts = sent, path, {}

    def __call__(self, kind: str, original: str) -> int:
        if self.sent is not None:
            return self.sent.get((kind, original), 0)
        part = _part(original)
        if part not in self.parts:
            fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
            where = f"{path}/part={part}"
            known = fs.get_file_info(where).type != pyarrow.fs.FileType.NotFound
            rows = pq.read_table(where, columns=["kind", "original", "attempt"], filesystem=fs).to_pylist() if known else []
            self.parts[part] = {(r["kind"], r["original"]): r["attempt"] for r in rows}
        return self.parts[part].get((kind, original), 0)


def _part(original: str) -> int:
    return int(hashlib.md5(original.encode()).hexdigest()[:4], 16) % PARTS


def _attempts(docs: DataFrame, key: bytes, max_sent: int) -> Attempts:
    changed = stash(rekeyed(stash(entities(docs), "pii-entities"), key), "pii-rekeyed")
    if changed.count() <= max_sent:
        return Attempts({(r[0], r[1]): r[2] for r in changed.collect()}, None)
    path = fresh_path(docs.sparkSession, "pii-parts")
    part = (F.conv(F.substring(F.md5("original"), 1, 4), 16, 10).cast("long") % PARTS).cast("int")
    changed.withColumn("part", part).write.partitionBy("part").parquet(path)
    return Attempts(None, path)


def pseudonymise(docs: DataFrame, key: bytes, max_sent: int = MAX_SENT) -> DataFrame:
    """docs with `text` rewritten, all other columns as they are, and two columns added: __entities, the number of mentions
    replaced, and __kinds, their kinds, sorted, with commas between.

    Null texts stay null and empty ones empty, with 0 mentions. Texts are searched whole. Equal texts, and so repeated rows,
    get equal results. Numbers that fail their check digit and addresses that can't exist are left alone. An empty table
    gives no rows. Columns of the input with the names of the two are replaced. The key, of at least LEAST_KEY bytes, is to be
    kept secret: who has it can undo most surrogates; the same key gives the same surrogates, but for clashes, in every run.
    """
    if len(key) < LEAST_KEY:
        raise ValueError(f"the key has {len(key)} bytes, fewer than {LEAST_KEY}")
    docs = docs.drop("__entities", "__kinds")
    attempts = docs.sparkSession.sparkContext.broadcast(_attempts(docs, key, max_sent))
    place = docs.columns.index("text")
    text_type = docs.schema["text"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place, SLICE_BYTES)):
            texts, counts, kinds = [], [], []
            for text in batch.column(place):
                new, mentions = replace(text.as_py(), key, attempts.value) if text.is_valid else (None, [])
                texts.append(new)
                counts.append(len(mentions))
                kinds.append(",".join(sorted({m.kind for m in mentions})))
            columns = [pa.array(texts, batch.column(i).type) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=[*batch.schema.names, "__entities", "__kinds"])
        surrogate.cache_clear()

    if text_type != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__entities", T.LongType()), T.StructField("__kinds", T.StringType())])
    return docs.mapInArrow(run, schema)
