"""Text columns: normalisation, keys, hashes, tokens and n-grams. Native expressions throughout.

Each rule is written once here and once as DuckDB SQL next to it, so that queries and their oracles cannot drift.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Everything that Unicode-aware languages call white space, information separators included.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
SEPARATOR = "\x1f"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def norm_text(c: Column | str) -> Column:
    """Null to empty, lower case, ё to е, white space collapsed and stripped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "ё", "е"), SPACE, " "))


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce(CAST({c} AS VARCHAR), '')), 'ё', 'е'), '{SPACE_SQL}', ' ', 'g'))"


def boolean_text(c: Column) -> Column:
    """Booleans as True and False; null as None."""
    return F.when(c.isNull(), F.lit("None")).otherwise(F.initcap(c.cast("string")))


def query_key(query: Column, location: Column, filters: Column, category: Column, delivery: Column) -> Column:
    """The normalised five-part key of a query; no part can hold the separator."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws(SEPARATOR, norm_text(query), plain(location), norm_text(filters), plain(category), boolean_text(delivery))


def short_md5(c: Column) -> Column:
    """The first 16 hex digits of the MD5."""
    return F.substring(F.md5(c), 1, 16)


def content_hash(title: Column, description: Column, params: Column, location: Column, price: Column) -> Column:
    """Identity of an item's content; a null price is empty."""
    return short_md5(F.concat_ws(SEPARATOR, norm_text(title), norm_text(description), norm_text(params), F.coalesce(location.cast("string"), F.lit("None")), F.coalesce(price.cast("double").cast("string"), F.lit(""))))


def query_text(query: Column, filters: Column) -> Column:
    return F.trim(F.concat(norm_text(query), F.lit(" "), norm_text(filters)))


def item_text(title: Column, params: Column, description: Column, params_chars: int = 200, description_chars: int = 300) -> Column:
    """Text of an item for an encoder, not lower-cased: title | params | description, the latter two cut."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(e(title), F.lit(" | "), F.substring(e(params), 1, params_chars), F.lit(" | "), F.substring(e(description), 1, description_chars))


def with_city(text: Column, city: Column, unknown: str = "неизвестно") -> Column:
    return F.concat(text, F.lit(" | город: "), F.coalesce(city, F.lit(unknown)))


def word_count(c: Column) -> Column:
    """Words between white space; none in a null or blank text."""
    n = norm_text(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " "))).cast("long")


def tokens(c: Column) -> Column:
    """Runs of two or more letters, digits or underscores of the normalised text.

    White space only parts tokens, so it is not normalised first; what lies between them is cut out in one pass.
    """
    plain = F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1)


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({norm_sql(c)}, '{TOKEN}')"


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each padded by a space on both sides; for every n up to the padded length."""
    words = F.filter(F.split(norm_text(c), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length(w))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, n))))

    return F.flatten(F.transform(padded, grams))


def starts_with_id(c: Column) -> Column:
    """Whether an id is 16 lower-case hex digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{16}$"), F.lit(False))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


# Prefixes that published encoders expect before queries and items.
ENCODER_PREFIXES = {
    "intfloat/multilingual-e5-small": ("query: ", "passage: "),
    "intfloat/multilingual-e5-base": ("query: ", "passage: "),
    "BAAI/bge-m3": ("", ""),
    "deepvk/USER-bge-m3": ("", ""),
}


def prefixes(model: str, known: dict[str, tuple[str, str]] | None = None) -> tuple[str, str]:
    """(query prefix, item prefix); KeyError for an unknown encoder."""
    return (known or ENCODER_PREFIXES)[model]


def filter_values(c: Column, key: str, keys: list[str]) -> Column:
    """Values of one key in a text of 'key value' runs, in order. Keys that begin with `key` are told from it.

    A value ends where another of the keys follows a space. Null text: no values.
    """
    esc = lambda k: r"\Q" + k + r"\E"
    longer = [k[len(key) :] for k in keys if k.startswith(key) and k != key]
    own = esc(key) + (f"(?!{'|'.join(map(esc, longer))})" if longer else "")
    other = "|".join(esc(k) for k in sorted(keys, key=len, reverse=True))
    values = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?:^| ){own} (.+?)(?= (?:{other})(?: |$)|$)"), 1)
    return F.transform(values, lambda v: F.trim(v))


def filter_match(params: Column, key: str, values: Column) -> Column:
    """1 if the params hold 'key value' for any value, 0 if for none, null without values."""
    hit = F.exists(values, lambda v: F.contains(F.coalesce(params, F.lit("")), F.concat(F.lit(key + " "), v)))
    return F.when(F.size(values) > 0, hit.cast("int"))


# Stems of region words, street words and settlement words in Russian addresses.
REGION_WORDS = r"(?iu)(област|обл\.|край|республик|автономн|район|р-н)"
STREET_WORDS = r"(?iu)^(ул\.|улица|пр\.|пр-т|проспект|пл\.|площадь|пер\.|переулок|ш\.|шоссе|наб\.|бул\.|б-р|мкр|д\.|\d)"
PLACE_WORDS = r"(?iu)^(городской округ|муниципальное образование|город|г\.|посёлок|поселок|пгт|село|деревня)[\s\p{Z}]+"
ADDRESS = r"Место оказания услуг (.+?)(?= [А-ЯЁ][а-яё]+ [а-яё]+ |$)"


def address_of(params: Column) -> Column:
    a = F.regexp_extract(F.coalesce(params, F.lit("")), ADDRESS, 1)
    return F.when(a != "", a)


def city_of(address: Column) -> Column:
    """First part of an address that is neither region nor street, else the first region; null without either."""
    parts = F.transform(F.split(address, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), PLACE_WORDS, "")))
    parts = F.filter(parts, lambda x: x != "")
    cities = F.filter(parts, lambda x: ~x.rlike(REGION_WORDS) & ~x.rlike(STREET_WORDS))
    return F.coalesce(F.get(cities, F.lit(0)), F.get(F.filter(parts, lambda x: x.rlike(REGION_WORDS)), F.lit(0)))
