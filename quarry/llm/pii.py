"""PII replaced by keyed, type-consistent surrogates.

Each kind of entity has a canonical value (what makes two mentions the same entity) and a keyed map from values to
surrogates that keeps length, script, letter case, accents, punctuation and, for names, gender; valid card and IBAN
check digits stay valid, addresses stay in their kind of network. The maps are permutations of each format's domain,
so distinct entities of a format hardly ever meet; mentions in different notations share a canonical value and so stay
coreferent. A distributed check over all distinct entities looks for surrogates that several entities share (or that
are the value itself) and re-keys all but one of them, again and again until there are none.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .tokens import worker_cache

# Common given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Barbara", "Carol", "Clara", "Diana", "Elena", "Emma", "Helen", "Irene", "Julia", "Laura", "Linda", "Lucy", "Maria", "Martha", "Nancy", "Olivia", "Rachel", "Sarah", "Sophie", "Susan", "Aisha", "Fatima", "Ingrid", "Mei", "Priya", "Yuki", "Lucía", "Amélie"],
    ("latin", "m"): ["Adam", "Albert", "Arthur", "Brian", "Carlos", "Charles", "Daniel", "David", "Edward", "Frank", "George", "Henry", "James", "John", "Martin", "Michael", "Oliver", "Paul", "Peter", "Robert", "Thomas", "William", "Ahmed", "Hans", "Hiroshi", "José", "Kenji", "Omar", "Raj", "Wei", "Jürgen", "François"],
    ("cyrillic", "f"): ["Алина", "Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Алексей", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"], "m": ["Mr", "Herr", "Monsieur", "Señor"], "any": ["Dr", "Prof", "Sir"]}
GENDER = {name: key for key, names in GIVEN.items() for name in names}

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAP = r"(?:(?=[^\W\d_])[A-ZÀ-ÖØ-ÞА-ЯЁ])" + _WORD.replace("+", "*", 1)
_GIVEN = "|".join(sorted((re.escape(x) for x in GENDER), key=len, reverse=True))
_TITLE = "|".join(x for v in TITLES.values() for x in v)
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<secret>(?<![A-Za-z0-9_-])(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9_-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<card>(?<![\d-])\d{4}(?P<cs>[ -]?)\d{4}(?P=cs)\d{4}(?P=cs)\d{4}(?![\d-]*\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4})(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d))"
    rf"|(?P<name>\b(?:(?:{_TITLE})\.? {_CAP}(?: {_CAP})?|(?:{_GIVEN}) (?:[A-Z]\. )?{_CAP}))"
)
#: Texts without any of these hold no entity.
_MAYBE = re.compile(rf"[\d@]|\b(?:{_TITLE}|{_GIVEN})\b|[0-9a-fA-F]{{32}}")
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
CYR_VOWELS, CYR_CONSONANTS = "аеиоуыэюя", "бвгджзклмнпрстфхцчш"
CLASSES = ["0123456789", VOWELS, CONSONANTS, CYR_VOWELS, CYR_CONSONANTS]
OF = {c: (k, i) for k, s in enumerate(CLASSES) for i, c in enumerate(s)}


def _prf(key: bytes, tweak: str, n: int, width: int) -> int:
    out, block = b"", 0
    while len(out) * 8 < width + 64:
        out += hmac.new(key, f"{tweak}|{n}|{block}".encode(), hashlib.sha256).digest()
        block += 1
    return int.from_bytes(out, "big")


def permute(key: bytes, tweak: str, x: int, size: int, back: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network over a * b >= size, walked until it falls inside."""
    if size < 2:
        return x
    a = max(2, int(size**0.5))
    while a * a < size:
        a += 1
    b, width = -(-size // a), size.bit_length()
    while True:
        left, right = divmod(x, b)
        for r in range(rounds - 1, -1, -1) if back else range(rounds):
            sign = -1 if back else 1
            if r % 2 == 0:
                left = (left + sign * _prf(key, f"{tweak}|{r}", right, width)) % a
            else:
                right = (right + sign * _prf(key, f"{tweak}|{r}", left, width)) % b
        x = left * b + right
        if x < size:
            return x


def derange(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation without fixed points: a cyclic step between permute and its inverse."""
    return permute(key, tweak, (permute(key, tweak, x, size) + 1) % size, size, back=True) if size > 1 else x


def letters(key: bytes, kind: str, text: str) -> str:
    """Same length, same class (digit, vowel, consonant, script) and case at each place; other characters stay."""
    shape = [OF.get(c.lower()) for c in text]
    size, x = 1, 0
    for s in shape:
        if s:
            size, x = size * len(CLASSES[s[0]]), x * len(CLASSES[s[0]]) + s[1]
    pattern = "".join("-" if s is None else str(s[0]) for s in shape)
    y, out = derange(key, f"{kind}|{pattern}", x, size), []
    for s, c in zip(reversed(shape), reversed(text)):
        if s:
            y, i = divmod(y, len(CLASSES[s[0]]))
            c = CLASSES[s[0]][i].upper() if c.isupper() else CLASSES[s[0]][i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The Luhn sum modulo 10: 0 for valid numbers."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(key: bytes, kind: str, digits: str) -> str:
    """The last digit makes the Luhn sum what it was."""
    head = letters(key, kind, digits[:-1])
    return head + str((int(digits[-1]) + _luhn(digits) - _luhn(head + digits[-1])) % 10)


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}"


def iban(key: bytes, kind: str, bare: str) -> str:
    """Valid check digits stay valid, others stay."""
    country, check, rest = bare[:2], bare[2:4], bare[4:]
    new = letters(key, kind, rest)
    return country + (_iban_check(country, new) if check == _iban_check(country, rest) else check) + new


def _network(n: int) -> tuple[int, int] | None:
    """(first address, size) of the special network that holds n: private, loopback, link-local, shared, this, multicast and above."""
    for first, bits in ((0x0A000000, 24), (0x7F000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0xA9FE0000, 16), (0x64400000, 22), (0, 24), (0xE0000000, 29)):
        if first <= n < first + (1 << bits):
            return first, 1 << bits
    return None


def address(key: bytes, kind: str, n: int) -> int:
    """Special addresses stay in their network, public ones public."""
    if special := _network(n):
        return special[0] + derange(key, f"{kind}|{special[0]}", n - special[0], special[1])
    while True:
        n = derange(key, kind, n, 1 << 32)
        if not _network(n):
            return n


def _fill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", text)
        return digits[-10:] if kind == "phone" and len(digits) in (10, 11) and digits[-11:-10] in ("", "1") else digits
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind == "email" else unicodedata.normalize("NFC", text)


def surrogate(key: bytes, kind: str, text: str, attempt: int = 0) -> str:
    """The replacement of one mention. attempt: how often its canonical value was re-keyed after a collision."""
    kind_key = f"{kind}#{attempt}" if attempt else kind
    if kind == "phone":
        digits, local = re.sub(r"\D", "", text), canonical(kind, text)
        kept = digits[: len(digits) - len(local)]
        return _fill(text, kept + letters(key, kind_key, local))
    if kind == "card":
        return _fill(text, card(key, kind_key, canonical(kind, text)))
    if kind == "ssn":
        return _fill(text, letters(key, kind_key, canonical(kind, text)))
    if kind == "ip":
        n = 0
        for part in text.split("."):
            n = n * 256 + int(part)
        n = address(key, kind_key, n)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "email":
        local, _, host = text.rpartition("@")
        top = host.rsplit(".", 1)[1]
        # Name and host are mapped together, so that distinct addresses stay distinct; the top-level domain stays.
        new = letters(key, kind_key, f"{local}@{host[: -len(top) - 1]}".lower())
        cased = "".join(b.upper() if a.isupper() else b for a, b in zip(text, new))
        return f"{cased}.{top}"
    if kind == "iban":
        bare = iter(iban(key, kind_key, text.replace(" ", "")))
        return "".join(" " if c == " " else next(bare) for c in text)
    if kind == "secret":
        return _secret(key, kind_key, text)
    return re.sub(r"\S+", lambda m: _name_part(key, kind_key, m[0], text), text)


def _secret(key: bytes, kind: str, text: str) -> str:
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
    if hexa:
        new = f"{derange(key, f'{kind}|{len(text)}', int(text, 16), 16 ** len(text)):0{len(text)}x}"
        return new.upper() if text.isupper() else new
    stem = re.match(r"(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|AKIA|", text)[0]
    return stem + letters(key, kind, text[len(stem) :])


def _name_part(key: bytes, kind: str, part: str, whole: str) -> str:
    if part.rstrip(".") in sum(TITLES.values(), []):
        return part
    part = unicodedata.normalize("NFC", part)
    if part in GENDER:
        group = GIVEN[GENDER[part]]
        return group[derange(key, f"{kind}|{GENDER[part]}", group.index(part), len(group))]
    # Accents stay where they are, on the new letters: spellings that differ in accents only stay distinct.
    return unicodedata.normalize("NFC", letters(key, f"{kind}|family", unicodedata.normalize("NFD", part)))


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of the whole text, left to right."""
    if not text or not _MAYBE.search(text):
        return []
    return [(m.start(), m.end(), m.lastgroup if m.lastgroup != "cs" else "card") for m in PATTERN.finditer(text)]


def replace(key: bytes, text: str | None, again: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[str, str]]]:
    """The text with its entities replaced, and (kind, surrogate) of each; again: attempts of re-keyed entities."""
    found = entities(text)
    out, at, pairs = [], 0, []
    for s, e, kind in found:
        mention = text[s:e]
        new = surrogate(key, kind, mention, again.get((kind, canonical(kind, mention)), 0) if again else 0)
        out += [text[at:s], new]
        at = e
        pairs.append((kind, new))
    return (text if not found else "".join(out) + text[at:]), pairs


def entity_table(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate) of all distinct entities; the surrogate is that of the canonical notation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {(kind, canonical(kind, t[s:e])) for t in b["t"] for s, e, kind in entities(t)}
            yield pd.DataFrame([(k, v, canonical(k, surrogate(key, k, v))) for k, v in seen], columns=["kind", "value", "surrogate"])

    return docs.select(F.col(text_col).alias("t")).mapInPandas(run, "kind string, value string, surrogate string").distinct()


def rekeyed(table: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities that need another surrogate for all surrogates to differ.

    Of entities that share a surrogate the one with the smallest value keeps it, unless it is that value. Each other
    one gets an attempt of its own, and the whole table is checked anew until no surrogate is shared.
    """

    @F.pandas_udf("string")
    def another(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, surrogate(key, k, v, int(n))) for k, v, n in zip(kind, value, attempt)], dtype=object)

    table = table.withColumn("attempt", F.lit(0))
    while True:
        shared = table.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).filter("n > 1 or first = surrogate")
        wrong = table.join(shared, ["kind", "surrogate"]).filter("value > first or value = surrogate")
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))
        wrong = common.stored(wrong.select("kind", "value", (F.col("attempt") + rank).alias("next")), "pii-collisions")
        if wrong.isEmpty():
            return table.filter("attempt > 0").select("kind", "value", "attempt")
        moved = table.join(wrong, ["kind", "value"]).select("kind", "value", another("kind", "value", "next").alias("surrogate"), F.col("next").alias("attempt"))
        table = common.stored(table.join(wrong, ["kind", "value"], "left_anti").select("kind", "value", "surrogate", "attempt").unionByName(moved), "pii-entities")


#: Re-keyed entities up to which their attempts travel to every task; more are joined to the rows that mention them.
TRAVEL = 10_000


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", info_col: str | None = None, travel: int = TRAVEL) -> DataFrame:
    """docs with the entities of text_col replaced; info_col, if named, gets the array of (kind, surrogate).

    Null and empty texts stay as they are. Other columns and repeated rows are untouched; equal texts get equal
    replacements. An empty table stays empty. An input column named as info_col is replaced.
    """
    clash = common.stored(rekeyed(common.stored(entity_table(docs, key, text_col=text_col), "pii-entities"), key), "pii-rekeyed")
    few = common.at_most(clash, travel)
    again = {(r["kind"], r["value"]): r["attempt"] for r in clash.limit(travel).collect()} if few else {}
    schema = "text string, found array<struct<kind: string, surrogate: string>>"

    def frame(done: list) -> pd.DataFrame:
        return pd.DataFrame({"text": [t for t, _ in done], "found": [[{"kind": k, "surrogate": s} for k, s in p] for _, p in done]})

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return frame([replace(key, t, again) for t in texts])

    @F.pandas_udf(schema)
    def run_with(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        return frame([replace(key, t, {(x["kind"], x["value"]): x["attempt"] for x in o} if o is not None else {}) for t, o in zip(texts, own)])

    done, row = common.fresh(docs, "done"), common.fresh(docs, "row")
    if few:
        out = docs.withColumn(done, run(F.col(f"`{text_col}`")))
    else:

        def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen = {(r, kind, canonical(kind, t[s:e])) for r, t in zip(b["r"], b["t"]) for s, e, kind in entities(t)}
                yield pd.DataFrame(list(seen), columns=["r", "kind", "value"])

        held = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
        said = held.select(F.col(row).alias("r"), F.col(f"`{text_col}`").alias("t")).mapInPandas(mentions, "r long, kind string, value string")
        own = common.fresh(held, "own")
        said = said.join(clash, ["kind", "value"]).groupBy(F.col("r").alias(row)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own))
        out = held.join(said, row, "left").withColumn(done, run_with(F.col(f"`{text_col}`"), F.col(own)))
    columns = [F.col(f"{done}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != info_col]
    return out.select(*columns, *([F.col(f"{done}.found").alias(info_col)] if info_col else []))


def configured_key(spark: SparkSession) -> bytes:
    """The key in spark.quarry.pii.key; where that is unset, a random one that lasts as long as the application."""
    if said := spark.conf.get("spark.quarry.pii.key", None):
        return said.encode()
    return worker_cache().setdefault(("pii", spark.sparkContext.applicationId), secrets.token_bytes(32))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their personal data replaced, and what replaced it; nulls and repeats as in `pseudonymise`."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, configured_key(spark), info_col="entities")
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")
