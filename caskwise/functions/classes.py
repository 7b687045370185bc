"""Class designations: qualifiers stripped by ordered patterns, then looked up in a table of variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caskwise.functions.text import BLANK, fold_marks, wide

# Qualifiers in the order in which they are stripped; each works on what the one before left.
QUALIFIERS = [
    r"\s+finished\s+in\s+.+", r"\s+aged\s+in\s+.+", r"\s+rested\s+in\s+.+", r"\s+barrel\s+rested\b", r"\s+cask\s+finished\b", r"\s+infused\s+with\s+.+", r"\s+with\s+.+",
    r"^locally\s+crafted\s+", r"^small\s+batch\s+", r"^handcrafted\s+", r"^hand\s+crafted\s+", r"^craft\s+", r"^premium\s+", r"^reserve\s+", r"^single\s+barrel\s+",
    r"\s+from\s+.+", r"^table\s+", r"^other\s+", r"\s*\([^)]*\)\s*$", r"\s+USB$",
]
# Names of countries in other languages.
COUNTRIES = {
    "italia": "italy", "deutschland": "germany", "españa": "spain", "espana": "spain", "france": "france", "méxico": "mexico", "mexique": "mexico", "brasil": "brazil", "россия": "russia", "日本": "japan",
    "中国": "china", "écosse": "scotland", "ecosse": "scotland", "irlande": "ireland", "pays-bas": "netherlands", "holland": "netherlands", "the netherlands": "netherlands", "angleterre": "england",
    "royaume-uni": "united kingdom", "états-unis": "united states", "etats-unis": "united states", "kanada": "canada", "australie": "australia", "nouvelle-zélande": "new zealand", "argentine": "argentina",
    "chili": "chile", "afrique du sud": "south africa", "suède": "sweden", "norvège": "norway", "danemark": "denmark", "finlande": "finland", "pologne": "poland", "hongrie": "hungary", "autriche": "austria",
    "suisse": "switzerland", "portugal": "portugal", "grèce": "greece", "grece": "greece", "turquie": "turkey",
}


# Designations of filing categories with the spirit they stand for, spirits, and patterns of further categories in the order
# in which they are tried; a pattern's group has to be one of the spirits.
ADMINISTRATIVE = {
    "specialties & proprietaries": None, "whisky specialties": "whisky", "gin specialties": "gin", "vodka specialties": "vodka", "rum specialties": "rum",
    "other specialties & proprietaries": None, "whisky proprietary": "whisky", "malt beverages specialities - flavored": None, "malt beverages specialities": None,
}
SPIRITS = ["whisky", "whiskey", "gin", "vodka", "rum", "brandy", "tequila", "mezcal", "cognac", "armagnac"]
CATEGORIES = [
    r"^(\w+)\s+specialt?ies$", r"^(\w+)\s+proprietary$", r"^other\s+.*specialt?ies\b",
    r"^other\s+\w+.*(?:cordials|liqueurs|brandy|whisky|whiskey|gin|rum|vodka|tequila)\b", r"^malt\s+beverages?\s+specialt?ies\b",
]


def administrative(x: Column) -> Column:
    """struct<is_administrative, spirit>: whether a class is a filing category, which no label shows, and the spirit it stands for.

    Null and blank texts are none.
    """
    s = F.lower(_trimmed(F.regexp_replace(x, f"{BLANK}+", " ")))
    yes = lambda spirit: F.struct(F.lit(True).alias("is_administrative"), spirit.cast("string").alias("spirit"))
    found = F.when(F.coalesce(s, F.lit("")) == "", F.struct(F.lit(False).alias("is_administrative"), F.lit(None).cast("string").alias("spirit")))
    for name, spirit in ADMINISTRATIVE.items():
        found = found.when(s == name, yes(F.lit(spirit)))
    for p in CATEGORIES:
        if "(\\w+)" in p:
            spirit = F.regexp_extract(s, f"(?U){p}", 1)
            found = found.when(spirit.isin(*SPIRITS), yes(spirit))
        else:
            found = found.when(s.rlike(f"(?U){p}"), yes(F.lit(None)))
    return found.otherwise(F.struct(F.lit(False).alias("is_administrative"), F.lit(None).cast("string").alias("spirit")))


def administrative_sql(x: str) -> str:
    """`administrative` as SQL: a struct of the same fields."""
    row = lambda yes, spirit: f"{{'is_administrative': {yes}, 'spirit': {spirit}}}"
    s = f"lower(trim(regexp_replace({x}, '{BLANK}+', ' ', 'g')))"
    cases = [f"when coalesce({s}, '') = '' then {row('false', 'null::varchar')}"]
    cases += [f"when {s} = '{n}' then {row('true', f"'{v}'" if v else 'null')}" for n, v in ADMINISTRATIVE.items()]
    for p in CATEGORIES:
        got = f"regexp_extract({s}, '{p}', 1)"
        cases.append(f"when {got} in ({', '.join(f"'{w}'" for w in SPIRITS)}) then {row('true', got)}" if "(\\w+)" in p else f"when regexp_matches({s}, '{p}') then {row('true', 'null')}")
    return f"case {' '.join(cases)} else {row('false', 'null')} end"


def country(x: Column) -> Column:
    """The English name where the text is a known name in another language, else the text as it is."""
    names = F.create_map(*(F.lit(s) for pair in COUNTRIES.items() for s in pair))
    return F.coalesce(names[F.lower(F.trim(x))], x)


#: Blanks beyond ASCII, and the ordinary one.
_BLANKS = BLANK


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_BLANKS}+|{_BLANKS}+$", "")


def strip_qualifiers(x: Column) -> Column:
    """struct<base, qualifiers>: what is left, and what each pattern took, in order."""
    base, taken = x, []
    for p in QUALIFIERS:
        taken.append(_trimmed(F.regexp_extract(base, f"(?iU){p}", 0)))
        base = _trimmed(F.regexp_replace(base, f"(?iU){p}", ""))
    return F.struct(base.alias("base"), F.filter(F.array(*taken), lambda q: q != "").alias("qualifiers"))


def class_keys(x: Column) -> Column:
    """Texts under which a class is looked up, the best first: as typed, as a flavored base, stripped, stripped as a flavored base."""
    plain = lambda c: F.replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit("whisky"), F.lit("whiskey"))
    flavored = lambda c: F.when(c.rlike(r"^.+?\s+flavored\s+\w+$"), F.regexp_replace(c, r"^.+?\s+(flavored)\s+(\w+)$", "$1 $2"))
    direct, stripped = plain(x), plain(strip_qualifiers(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))["base"])
    return F.array(direct, fold_marks(direct), flavored(direct), stripped, fold_marks(stripped), flavored(stripped))


def normalize_classes(df: DataFrame, column: str, variants: DataFrame, out: str = "canonical") -> DataFrame:
    """Add `out`, the canonical class of `column` by `variants` (variant, canonical), null where none fits.

    Distinct values are looked up, then joined back: null and unknown values give null, repeated rows stay, an empty
    table stays empty. Of several canonical names of one variant the smallest counts.
    """
    known = variants.where("variant is not null").groupBy(F.replace(F.lower("variant"), F.lit("whisky"), F.lit("whiskey")).alias("__key")).agg(F.min("canonical").alias("__canonical"))
    keys = df.select(F.col(column).alias("__value")).where("__value is not null").distinct().select("__value", F.posexplode(class_keys(F.col("__value"))).alias("__pos", "__key"))
    best = keys.join(known, "__key").groupBy("__value").agg(F.min_by("__canonical", "__pos").alias(out))
    return df.join(best, df[column] == best["__value"], "left").drop("__value")


def strip_sql(column: str) -> str:
    """The base of `strip_qualifiers` as DuckDB SQL."""
    quote = lambda p: wide(p).replace("'", "''")
    trimmed = lambda s: f"regexp_replace({s}, '^{BLANK}+|{BLANK}+$', '', 'g')"
    return reduce(lambda s, p: trimmed(f"regexp_replace({s}, '(?i){quote(p)}', '', 'g')"), QUALIFIERS, column)
