"""Text and number functions, Column to Column, inside whole-stage code generation.

Null stays null unless a function says otherwise. Patterns that meet letters outside ASCII carry the
Unicode flags, since Java's classes are ASCII by default.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: Column | str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(_c(x) != "", F.lit(False))


def normalize_whitespace(x: Column | str) -> Column:
    """Words parted by hyphen and line break are joined, blanks collapse, ends are trimmed."""
    joined = F.regexp_replace(_c(x), r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def normalize_notice(x: Column | str) -> Column:
    """`normalize_whitespace`, without hyphens inside words and with blanks around '(1)'."""
    s = F.regexp_replace(normalize_whitespace(x), r"(?U)(\w)-\s*(\w)", "$1$2")
    s = F.regexp_replace(s, r"(?U)\((\d+)\)(\w)", "($1) $2")
    return F.regexp_replace(s, r"(\S)(\(\d+\))", "$1 $2")


#: A blank of any script, as a class that Java and RE2 read alike.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def wide(pattern: str) -> str:
    """A pattern whose blanks are those of every script."""
    return pattern.replace(r"\s", BLANK)


def first_number(x: Column | str, pattern: str) -> Column:
    """Group 1 of the first match as a double, null without one."""
    return F.nullif(F.regexp_extract(_c(x), pattern, 1), F.lit("")).try_cast("double")


#: Decimal digits of all scripts, and the digits they stand for.
_DIGITS = "".join(ch for ch in map(chr, range(0x80, 0x110000)) if unicodedata.category(ch) == "Nd")
_ASCII_DIGITS = "".join(str(unicodedata.digit(ch)) for ch in _DIGITS)


def plain_blanks(x: Column | str) -> Column:
    """Blanks of every kind as single ordinary blanks each."""
    return F.regexp_replace(_c(x), r"(?U)[\s\x1c-\x1f\ufeff]", " ")


def plain_numbers(x: Column | str) -> Column:
    """Blanks and decimal digits of every script as ASCII, for the functions that read numbers."""
    return F.translate(plain_blanks(x), _DIGITS, _ASCII_DIGITS)


def extract_abv(x: Column | str) -> Column:
    """The number before the first percent sign, or the whole text if it is a number."""
    return F.coalesce(first_number(x, wide(r"(\d+\.?\d*)\s*%")), first_number(_c(x), wide(r"^\s*(\d+\.?\d*)\s*$")))


def extract_proof(x: Column | str) -> Column:
    return first_number(x, wide(r"(\d+\.?\d*)\s*[Pp]roof"))


# Unit patterns in the order they are tried, factor to millilitres, resulting unit.
VOLUME_UNITS = [
    (r"(?i)(\d+\.?\d*)\s*fl\.?\s*oz", 1.0, "fl oz"),
    (r"(\d+\.?\d*)\s*[Mm][Ll]\b", 1.0, "mL"),
    (r"(?i)(\d+\.?\d*)\s*cL", 10.0, "mL"),
    (r"(?i)(\d+\.?\d*)\s*(?:Liters?|Litres?|L)\b", 1000.0, "mL"),
    (r"(?i)(\d+\.?\d*)\s*MILLILITERS?\b", 1.0, "mL"),
    (r"(?i)(\d+\.?\d*)\s*(?:U\.?S\.?\s*)?(?:Gallons?|GAL\.?)\b", 3785.41, "mL"),
]
VOLUME_UNITS = [(wide(p), f, u) for p, f, u in VOLUME_UNITS]
FL_OZ = 29.5735


def net_contents(x: Column | str) -> Column:
    """struct<value, unit> of the first unit pattern that matches, nulls without one."""
    tries = [F.when(first_number(x, p).isNotNull(), F.struct((first_number(x, p) * f).alias("value"), F.lit(u).alias("unit"))) for p, f, u in VOLUME_UNITS]
    return F.coalesce(*tries)


def to_ml(value: Column, unit: Column) -> Column:
    return F.when(unit == "fl oz", value * FL_OZ).otherwise(value)


#: Letters that lose their marks natively; what is beyond needs `fold_udf`.
_MARKED = "".join(ch for ch in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", ch)) > 1 and unicodedata.normalize("NFKD", ch)[0].isascii() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", ch)[1:]))
_PLAIN = "".join(unicodedata.normalize("NFKD", ch)[0] for ch in _MARKED)


@F.pandas_udf(T.StringType())
def fold_udf(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return x.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


def fold_marks(x: Column | str) -> Column:
    """Latin letters without their marks; native, so for Latin text only."""
    return F.translate(F.regexp_replace(_c(x), r"\p{M}", ""), _MARKED, _PLAIN)


def normalize_fuzzy(x: Column | str, exact: bool = False) -> Column:
    """Lower case, marks folded, punctuation to blanks, blanks collapsed; null gives ''.

    `exact` folds every script by Arrow UDF; without it Latin letters fold natively.
    """
    lower = F.lower(F.coalesce(_c(x), F.lit("")))
    folded = fold_udf(lower) if exact else fold_marks(lower)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


# Suffixes that say nothing about a company.
COMPANY_SUFFIXES = "inc|llc|ltd|co|corp|company|corporation|incorporated|importing"


def normalize_company(x: Column | str) -> Column:
    """'&' written out, legal suffixes dropped; null gives ''."""
    s = normalize_fuzzy(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(F.regexp_replace(s, rf"(?U)\b({COMPANY_SUFFIXES})\b", ""), r"\s+", " "))


def tokens(x: Column | str) -> Column:
    """Distinct words of a text; an empty text has none."""
    return F.array_distinct(F.filter(F.split(_c(x), r"\s+"), lambda t: t != ""))


def contains_all(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


# States and their short forms, in the order in which names collapse.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
ADDRESS_NOISE = ["st", "rd", "ave", "blvd", "dr", "ln", "ct", "ste", "suite", "apt"]


def address_tokens(x: Column | str) -> Column:
    """Distinct words of an address: dotted initials joined, ZIP code, leading number and street kinds dropped, states short.

    States collapse one after the other in the order of `STATES`, as a fold over the words.
    """
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\b([A-Za-z])\.([A-Za-z])\.", "$1$2")
    s = F.regexp_replace(normalize_fuzzy(s), r"\b\d{5}(?:-\d{4})?\b", "")
    words = F.array_except(tokens(F.regexp_replace(s, r"^\d+\s+", "")), F.array(*map(F.lit, ADDRESS_NOISE)))
    states = F.array(*(F.struct(F.array(*map(F.lit, name.split())).alias("name"), F.lit(short).alias("short")) for name, short in STATES.items()))
    return F.aggregate(
        states, words, lambda acc, s: F.when(contains_all(s["name"], acc), F.array_union(F.array_except(acc, s["name"]), F.array(s["short"]))).otherwise(acc)
    )


def slug(x: Column | str) -> Column:
    """'&' written out, apostrophes dropped, everything but letters and digits to single hyphens."""
    s = F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("&"), F.lit("and")), "'", "")
    return F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def eval_text(x: Column | str) -> Column:
    """Trimmed, lower case, blanks collapsed; null gives ''."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+|\s+$", ""))), r"(?U)\s+", " ")


def band(confidence: Column | str) -> Column:
    return F.when(_c(confidence) >= 90, "high").when(_c(confidence) >= 70, "medium").when(_c(confidence).isNotNull(), "low")


def cache_key(content: Column | str, prompt: str) -> Column:
    return F.sha2(F.concat(F.encode(_c(content), "utf-8"), F.encode(F.lit(prompt), "utf-8")), 256)


# Media types of image files by their ending; the first is that of all others.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}


def media_type(name: Column | str) -> Column:
    ending = F.lower(F.element_at(F.split(_c(name), r"\."), -1))
    types = F.create_map(*(F.lit(s) for pair in MEDIA_TYPES.items() for s in pair))
    return F.when(_c(name).isNotNull(), F.coalesce(types[ending], F.lit("image/jpeg")))


def word_diff(canonical: Column, found: Column) -> Column:
    """array<struct<want, got, same>> of two texts word by word; missing words are '___', surplus ones follow."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    return F.zip_with(
        split(canonical),
        split(found),
        lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("want"), F.coalesce(b, F.lit("___")).alias("got"), F.coalesce(F.lower(a) == F.lower(b), F.lit(False)).alias("same")),
    )


# Words that tell the kind of drink, tried in this order; the last kind is the rest.
WINE_WORDS = ["wine", "champagne", "sparkling", "table red", "table white", "dessert", "vermouth", "sherry", "port", "madeira", "marsala", "sake", "mead"]
BEER_WORDS = ["beer", "ale", "lager", "stout", "malt beverage", "malt liquor", "porter", "pilsner"]


def infer_beverage(x: Column | str, strict: bool = True) -> Column:
    """wine, beer or distilled_spirits by contained words; `strict` keeps bare substrings ('imported' holds 'port')."""
    edge = "" if strict else r"\b"
    has = lambda words: F.coalesce(F.lower(_c(x)).rlike(edge + "(" + "|".join(words) + ")" + edge), F.lit(False))
    return F.when(has(WINE_WORDS), "wine").when(has(BEER_WORDS), "beer").otherwise("distilled_spirits")


def classify_panel(x: Column | str) -> Column:
    s = F.lower(_c(x))
    return F.when(s.rlike("front|brand|collar"), "front").when(s.contains("back"), "back").otherwise("other")


def panel_of_file(x: Column | str) -> Column:
    s = F.lower(_c(x))
    return F.when(s.contains("back"), "back").when(s.rlike("other|side|neck"), "other").otherwise("front")


def infer_origin(permit: Column | str) -> Column:
    """imported or domestic by the form of a permit number, null if it says neither."""
    p = F.upper(_c(permit))
    return F.when(p.contains("-I-"), "imported").when(p.rlike("^(BW|DSP|BR)-"), "domestic")
