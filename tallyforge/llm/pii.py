"""PII: entities get keyed surrogates of the same type and format.

Entities: e-mail addresses, phone numbers, IPv4 and MAC addresses, payment
cards (issuer prefix, length and check digit must hold), social security
numbers, IBANs (check digits must hold), secrets that are assigned to a name
such as token or password, and person names (a known first name, a title or a
phrase such as "my name is" before capitalised words). Where a text names a
person, the parts of that name are entities wherever else the text has them as
words of their own, before or after.

A surrogate is the entity's image under a keyed one-to-one map of all strings
of its format: digits stay digits, hexadecimal stays hexadecimal, letters keep
case, script and vowel or consonant class, check digits are made to hold, and
first names move within their list of one gender and script. So

* coreference: the same entity gets the same surrogate in every document;
* distinctness: different entities get different surrogates, as the map is
  one to one on each format and formats of different types don't overlap;
* no entity maps to itself: the map is a cycle through all its strings (a keyed
  permutation p, its inverse after adding one).

``collisions`` checks distinctness over the corpus: it aggregates the distinct
entities and gives the surrogates that two of them share. ``checked_key`` takes
the next derived key until there is none.

Names that neither a known first name, nor a title, nor a phrase announces
anywhere in the text are not found.

Defined cases: null text stays null; a text without entities is unchanged byte
for byte; formats with a single string stay as they are, and so do letters of
scripts that ``LETTERS`` and ``SCRIPTS`` don't have; repeated rows get
equal results; an empty table gives an empty result; other columns are passed
on by ``replace_pii``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

KEY = b"tallyforge surrogate key"
KINDS = ("email", "phone", "ip", "mac", "card", "ssn", "iban", "secret", "person")

# First names by gender and script.
NAMES = {
    "female latin": "Alice Amelia Andrea Angela Anita Barbara Beatrice Carmen Caroline Catherine Charlotte Christine Claudia Deborah Diana Eleanor Elizabeth Emily Emma Helen Ingrid Isabella Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Margaret Maria Martha Michelle Monika Nancy Nicole Olivia Patricia Rachel Rebecca Sabine Sandra Sarah Sofia Stephanie Susan Teresa Ursula Victoria Aisha Amina Ayşe Chiara Elif Fatima Giulia Hana Ioana Ingeborg Keiko Layla Leila Mei Miriam Nadia Naomi Priya Sakura Soo-jin Svetlana Xin Yasmin Yuki Zeynep".split(),
    "male latin": "Albert Alexander Andrew Anthony Antonio Benjamin Bernard Carlos Charles Christopher Daniel David Dominic Edward Fernando Francis Frederick George Gregory Hans Henry Jacob James Javier Jeffrey Johann John Jonathan Joseph Jürgen Kenneth Kevin Klaus Lawrence Matthew Michael Miguel Nicholas Oliver Patrick Paul Peter Philippe Richard Robert Stephen Thomas Timothy Walter William Abdul Ahmed Ali Chen Diego Emre Enrique Giovanni Hassan Hiroshi Ibrahim Ivan Jin Kenji Khalid Luca Mario Mehmet Mohammed Mustafa Omar Pablo Raj Sanjay Takashi Vladimir Wei Yusuf".split(),
    "female cyrillic": "Анастасия Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Марина Мария Наталья Ольга Светлана София Татьяна Юлия".split(),
    "male cyrillic": "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Константин Максим Михаил Николай Олег Павел Роман Сергей Степан Фёдор".split(),
}
TITLES = {"Mr": "male", "Mrs": "female", "Ms": "female", "Miss": "female", "Sir": "male", "Dr": "", "Prof": "", "Herr": "male", "Frau": "female", "Señor": "male", "Señora": "female", "Madame": "female", "Monsieur": "male"}
PHRASES = ("my name is", "name is", "named", "called", "signed", "sincerely,", "regards,", "contact person:", "contact:", "full name:", "name:", "attn:", "dear")
# Letter classes that surrogates keep.
LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "äöüáéíóúàèìòùâêîôûãõåøæœëïÿýąęőűūāēīō", "çñßćčďłńňřśšťźžżğşțđð",
    "аеиоуыэюяёіїє", "бвгджзклмнпрстфхцчшщйґ", "ьъ", "αεηιουω", "άέήίόύώϊϋ", "βγδζθκλμνξπρστφχψς",
)
#: First and last letters of scripts without case, and of Armenian in both cases.
SCRIPTS = (("ա", "ֆ"), ("Ա", "Ֆ"), ("א", "ת"), ("ؠ", "غ"), ("ف", "ي"), ("अ", "ह"), ("ก", "ฮ"), ("ა", "ჰ"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "龥"), ("가", "힣"))
ENDINGS = ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский")  # of surnames, by gender
_FIRST = {name: kind for kind, names in NAMES.items() for name in names}

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-]))
    |(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![\w:-]))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{1,4}[ .-])(?:[0-9]{2,4}[ .-]?){1,3}[0-9]{2,4}(?![0-9])
        |(?<![\w+])\+[0-9]{8,15}(?![0-9])
        |(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9])(?!\.[0-9]))
    |(?P<card>(?<![\w.-])[2-6][0-9]{3}(?:[ -]?[0-9]){9,15}(?![0-9])(?!-[0-9]))
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    """,
    re.X,
)
SECRET = re.compile(r"(?i:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key)[ \t]*[=:][ \t]*([\"']?)(?P<secret>[\w+/=.~-]{12,}+)\1")
SECRET_WORDS = ("token", "secret", "passw", "passphrase", "key")  # one of them is in what ``SECRET`` finds
_WORD = r"[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?"
_TITLE, _FIRST_NAME = ("|".join(sorted(x, key=len, reverse=True)) for x in (TITLES, _FIRST))
PERSON = re.compile(rf"(?:(?P<title>{_TITLE})\.? )?(?:(?P<first>{_FIRST_NAME})(?![\w-]) ?)?(?P<one>{_WORD})?(?: (?P<two>{_WORD}))?")
LEAD = re.compile(rf"(?<![\w'-])(?:(?P<phrase>(?i:{'|'.join(map(re.escape, PHRASES))})\s+)|(?:{_TITLE})\.? |(?:{_FIRST_NAME}) )")
DIGIT = re.compile("[0-9]")
BLOCK = 512  # characters that are mapped as one number
#: The same classes as capitals: the distinct capitals of one letter that belong to their small letters.
CAPITALS = tuple("".join(dict.fromkeys(c.upper() for c in a if len(c.upper()) == 1 and c.upper() != c)) for a in LETTERS)
_ALPHABETS = {c: a for a in ("0123456789", *LETTERS, *CAPITALS) for c in a}
MAPPABLE = "[%s%s]" % ("".join(_ALPHABETS), "".join(f"{a}-{z}" for a, z in SCRIPTS))  # strings without such a character stay as they are
_LEADS = (*_FIRST, *TITLES, *(f"{t}." for t in TITLES))
_LEAD_SET = frozenset(_LEADS)


def _number(data: bytes, key: bytes, tweak: str, width: int) -> int:
    """At least ``width`` keyed bytes as a number."""
    salt = hashlib.blake2b(tweak.encode(), digest_size=16).digest()
    return int.from_bytes(b"".join(hashlib.blake2b(data, key=key[:64], digest_size=64, salt=salt, person=k.to_bytes(16, "big")).digest() for k in range((width + 63) // 64)), "big")


def _permute(n: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until it is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = n >> half, n & low
        for k in (range(7, -1, -1) if back else range(8)):
            if back:
                left, right = right ^ (_number(bytes([k]) + left.to_bytes(width, "big"), key, tweak, width) & low), left
            else:
                left, right = right, left ^ (_number(bytes([k]) + right.to_bytes(width, "big"), key, tweak, width) & low)
        n = left << half | right
        if n < size:
            return n


def _cycle(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed one-to-one map of range(size) onto itself without fixed points."""
    if size < 2:
        return n
    return _permute((_permute(n, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def _shift(text: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """Another string with the same alphabet at each place; None: the character stays."""
    if len(text) > BLOCK:  # block by block; each hangs on all before it
        seen, out = hashlib.blake2b(digest_size=16), []
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            out.append(_shift(part, alphabets[at : at + BLOCK], key, f"{tweak}|{at}|{seen.hexdigest()}"))
            seen.update(part.encode())
        return "".join(out)
    n, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            n, size = n * len(a) + a.index(c), size * len(a)
    tweak += "|" + "".join(c if a is None else f"<{a[0]}{len(a)}>" for c, a in zip(text, alphabets, strict=True))
    n, out = _cycle(n, size, key, tweak), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            n, k = divmod(n, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


@lru_cache(maxsize=1000)
def _script(c: str) -> str | None:
    """The letters of a character's script, where ``SCRIPTS`` has it."""
    for a, z in SCRIPTS:
        if a <= c <= z:
            return "".join(x for x in map(chr, range(ord(a), ord(z) + 1)) if x.isalpha())
    return None


def _classes(text: str) -> list[str | None]:
    """The alphabet of each character: digits, or letters of its script, case and class; a character without one stays."""
    return [_ALPHABETS.get(c) or _script(c) for c in text]


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def is_card(text: str) -> bool:
    d = re.sub("[ -]", "", text)
    n, p = len(d), int(d[:4])
    known = (d[0] == "4" and n in (13, 16, 19)) or (n == 16 and (5100 <= p <= 5599 or 2221 <= p <= 2720 or p == 6011 or 6440 <= p <= 6599 or 3528 <= p <= 3589)) or (n == 15 and p // 100 in (34, 37))
    return known and not _luhn(d)


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def is_iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and 98 - _iban_rest(t[:2], t[4:]) == int(t[2:4])


def _refill(text: str, plain: str) -> str:
    """``plain`` with the separators of ``text``."""
    left = iter(plain)
    return "".join(next(left) if c.isalnum() else c for c in text)


@lru_cache(maxsize=50_000)
def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    """The replacement of an entity."""
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, _cycle(n, 1 << 32, key, "ip").to_bytes(4, "big")))
    if kind == "card":
        d = re.sub("[ -]", "", text)
        body = _shift(d[:-1], [None] * 4 + ["0123456789"] * (len(d) - 5), key, "card")
        return _refill(text, body + str(-_luhn(body + "0") % 10))
    if kind == "iban":
        t = text.replace(" ", "")
        body = _shift(t[4:], ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t[4:]], key, f"iban{t[:2]}")
        return _refill(text, f"{t[:2]}{98 - _iban_rest(t[:2], body):02d}{body}")
    if kind == "email":
        local, _, domain = text.partition("@")
        name, _, top = domain.rpartition(".")
        low = name.lower()
        new = _shift(low, _classes(low), key, f"domain.{top.lower()}")
        new = "".join(c.upper() if o.isupper() else c for c, o in zip(new, name, strict=True))  # case variants stay apart
        return _shift(local, _classes(local), key, f"local@{domain.lower()}") + "@" + new + "." + top
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}", text)
        keep = code.end() if code else 0
        return _shift(text, [None] * keep + _classes(text[keep:]), key, "phone")
    if kind in ("mac", "secret") and re.fullmatch("[0-9a-f:]+|[0-9A-F:]+", text):
        digits = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        return _shift(text, [digits if c != ":" else None for c in text], key, kind)
    if kind == "first":
        names = NAMES[_FIRST[text]]
        return names[_cycle(names.index(text), len(names), key, _FIRST[text])]
    if kind == "last":
        end = next((e for e in ENDINGS if text.endswith(e) and len(text) > len(e) + 1), "")
        stem = text[: len(text) - len(end)]
        return _shift(stem, _classes(stem), key, f"last{end}") + end
    return _shift(text, _classes(text), key, kind)


def _is_name(word: str | None) -> bool:
    """Whether a word is written as a name: a capital and small letters, on both sides of a hyphen, or a script without case."""
    if not word or len(word) < (3 if word[0].upper() != word[0].lower() else 2):
        return False
    if all(c.upper() == c.lower() for c in word if c != "-"):
        return True
    return all(len(p) > 1 and p[0].isupper() and p[1:] == p[1:].lower() for p in word.split("-"))


def _folded(text: str) -> str:
    """For a look for small ASCII letters in any case, as regular expressions see it."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def _announced(text: str) -> bool:
    """Whether ``LEAD`` may find something: a part before a space that ends with a name or title, or a phrase in any case."""
    parts = set(text.split(" "))
    if not parts.isdisjoint(_LEAD_SET) or any(x.endswith(_LEADS) for x in parts if not x.isalpha()):
        return True
    folded = _folded(text)
    return any(x in folded for x in PHRASES)


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, "first" or "last", string) of the parts of names: where they are announced, and wherever else they stand."""
    found, parts = [], {}
    for lead in LEAD.finditer(text) if _announced(text) else ():
        m = PERSON.match(text, lead.end() if lead["phrase"] else lead.start())
        if not m or not (m["title"] or m["first"] or lead["phrase"]):
            continue
        one, two = (m[k] if _is_name(m[k]) else None for k in ("one", "two"))
        if m["first"] and m["one"] and text[m.end("first")] != " ":
            one = two = None
        if m["first"]:
            if one is None and not m["title"] and not lead["phrase"]:
                continue
            two = None  # the surname follows the first name
        elif not m["title"] and (one is None or two is None):
            continue  # a phrase announces whole names only
        if m["first"]:
            found.append((*m.span("first"), "first", m["first"]))
        for name, own in (("one", one), ("two", two if one else None)):
            if own:
                found.append((*m.span(name), "last", own))
    parts = {s: kind for _, _, kind, s in found}
    if parts:
        again = re.compile(r"(?<![\w'-])(?:%s)(?![\w-])" % "|".join(map(re.escape, sorted(parts, key=len, reverse=True))))
        found += [(*m.span(), parts[m.group()], m.group()) for m in again.finditer(text)]
    return found


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, string) of the entities of a text, in order, without overlaps.

    A person gives one entry per part of the name, "first" and "last"; a given name that isn't known is a "last".
    """
    found, folded = [], _folded(text)
    if ("=" in text or ":" in text) and any(x in folded for x in SECRET_WORDS):
        found += [(*m.span("secret"), "secret", m["secret"]) for m in SECRET.finditer(text)]
    if "@" in text or DIGIT.search(text):
        for m in PATTERN.finditer(text):
            kind, s = m.lastgroup, m.group()
            if kind == "card" and not is_card(s) or kind == "iban" and not is_iban(s):
                continue
            found.append((*m.span(), kind, s))
    found += persons(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def redact(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) in order."""
    parts, at, used = [], 0, []
    for a, z, kind, s in entities(text):
        new = surrogate(kind, s, key)
        used.append((kind, s, new))
        parts += [text[at:a], new]
        at = z
    return ("".join([*parts, text[at:]]) if used else text), used


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = {(kind, s) for t in b.column("text").to_pylist() if t for _, _, kind, s in entities(t)}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in range(2)], names=["kind", "entity"])


def entity_list(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of the corpus."""
    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(_listed, "kind string, entity string").distinct()


def with_surrogates(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, surrogate) for each (kind, entity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(kind, s, key) for kind, s in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

    return found.mapInArrow(run, "kind string, entity string, surrogate string")


def entity_table(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Distinct (kind, entity, surrogate) of the corpus."""
    return with_surrogates(entity_list(docs), key)


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that two different entities of a kind share, or that equal their entity though it has another string of its format."""
    shared = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("entity") == F.col("surrogate")) & F.col("entity").rlike(MAPPABLE)).alias("same"))
    return shared.where("n > 1 or same").select("kind", "surrogate", "n")


def checked_key(docs: DataFrame, key: bytes = KEY, tries: int = 8) -> bytes:
    """The key, or the first key derived from it, under which no surrogates collide.

    The corpus is read once, for its distinct entities; every key is tried on these.
    """
    found = stored(entity_list(docs), "entities")
    for k in range(tries):
        own = key if not k else hashlib.blake2b(bytes([k]), key=key[:64]).digest()
        if collisions(with_surrogates(found, own)).isEmpty():
            return own
    raise ValueError("surrogates collide under every key tried")


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            texts = [t if t is None else redact(t, key)[0] for t in b.column(k).to_pylist()]
            arrays = list(b.columns)
            arrays[k] = pa.array(texts, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return run


def replace_pii(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; other columns as they are."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_replaced(key), docs.schema)


def _reported(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, []) if t is None else redact(t, key) for t in b.column("text").to_pylist()]
            counts = {k: [sum(x[0] == k or k == "person" and x[0] == "last" for x in used) for _, used in got] for k in KINDS}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([t for t, _ in got], pa.string()), pa.array([sum(x[0] != "first" for x in u) for _, u in got], pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS)],
                names=["doc_id", "text", "n_entities", *(f"n_{k}" for k in KINDS)],
            )

    return run


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, and how many entities of each kind it had."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_reported(key), f"doc_id long, text string, n_entities long, {kinds}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, checked_key(docs))
