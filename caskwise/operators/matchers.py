"""Matchers of a declared value against text: rule ladders as Catalyst expressions.

Every matcher gives struct<status, confidence>; status is match, content_mismatch, field_missing or
extraction_uncertain. The rungs that need a similarity kernel run as Arrow UDF on the
rows that the native rungs leave open, never on all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caskwise.functions import kernels
from caskwise.functions.text import FL_OZ, address_tokens, contains_all, eval_text, extract_abv, extract_proof, net_contents, normalize_company, normalize_fuzzy, normalize_notice, present, to_ml, tokens, wide

#: Similarity from which a fuzzy rung matches.
THRESHOLD = 85.0
#: Passage that texts are searched for where none is given.
NOTICE = "CAUTION: STRONG DRINK. NOT FOR MINORS, DRIVERS OR EXPECTANT MOTHERS."


def verdict(status: str, confidence: Column | float) -> Column:
    return F.struct(F.lit(status).alias("status"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).cast("double").alias("confidence"))


def percentages(text: Column) -> Column:
    """All numbers of a text that stand for a strength: with a percent sign, or beside ALC and VOL."""
    groups = [
        (r"(\d+\.?\d*)\s*%", 1),
        (r"(?i)ALC(?:OHOL)?\.?\s*/?\s*VOL(?:UME)?\.?\s*(\d+\.?\d*)", 1),
        (r"(?i)(\d+\.?\d*)\s*ALC(?:OHOL)?\.?\s*/?\s*VOL(?:UME)?\.?", 1),
        (r"(?i)ALC\.?\s+(\d+\.?\d*)\s*(?:BY\s+VOL)?", 1),
    ]
    found = F.concat(*(F.regexp_extract_all(text, F.lit(wide(p)), F.lit(g)) for p, g in groups))
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("double")))


def match_abv(declared: Column, text: Column) -> Column:
    """Nearest stated strength: within 0.1 it matches, within 5 it is uncertain."""
    want = extract_abv(declared)
    nearest = F.array_min(F.transform(percentages(text), lambda p: F.abs(p - want)))
    return (
        F.when(want.isNull() | nearest.isNull(), verdict("field_missing", 0))
        .when(nearest <= 0.1, verdict("match", 100))
        .when(nearest <= 5.0, verdict("extraction_uncertain", 50))
        .otherwise(verdict("content_mismatch", 0))
    )


# Unit patterns in a text with their millilitres.
_VOLUMES = [
    (r"(?i)(\d+\.?\d*)\s*ml\b", 1.0),
    (r"(?i)(\d+\.?\d*)\s*fl\.?\s*oz", FL_OZ),
    (r"(?i)(\d+\.?\d*)\s*cL\b", 10.0),
    (r"(?i)(\d+\.?\d*)\s*(?:Liters?|Litres?|L)\b", 1000.0),
    (r"(?i)(\d+\.?\d*)\s*MILLILITERS?\b", 1.0),
    (r"(?i)(\d+\.?\d*)\s*(?:U\.?S\.?\s*)?(?:Gallons?|GAL\.?)\b", 3785.41),
]


_VOLUMES = [(wide(p), f) for p, f in _VOLUMES]


def volumes(text: Column) -> Column:
    """Millilitres of all volumes in a text."""

    def scaled(pattern: str, factor: float) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("double") * factor)

    return F.concat(*(scaled(p, f) for p, f in _VOLUMES))


def declared_volumes(declared: Column) -> Column:
    """Millilitres of the sizes that a declared value lists on its lines."""
    lines = F.filter(F.transform(F.split(declared, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    sizes = F.transform(lines, net_contents)
    return F.transform(F.filter(sizes, lambda s: s["value"].isNotNull()), lambda s: to_ml(s["value"], s["unit"]))


def match_net_contents(declared: Column, text: Column) -> Column:
    """Any stated volume within 5 ml of any declared size."""
    want, have = declared_volumes(declared), volumes(text)
    return (
        F.when((F.size(want) <= 0) | (F.size(have) <= 0), verdict("field_missing", 0))
        .when(F.exists(have, lambda h: F.exists(want, lambda w: F.abs(h - w) < 5.0)), verdict("match", 100))
        .otherwise(verdict("content_mismatch", 0))
    )


def words_found(declared: Column, text: Column) -> Column:
    """Native rungs of `match_text`: all words in the text, or some as beginnings of longer words; null where undecided."""
    want, have = tokens(normalize_fuzzy(declared)), tokens(normalize_fuzzy(text))
    longer = F.filter(F.array_except(want, have), lambda w: (F.char_length(w) >= 4) & F.exists(have, lambda t: F.startswith(t, w)))
    return (
        F.when(~present(declared) | ~present(text) | (F.size(want) == 0), verdict("field_missing", 0))
        .when(contains_all(want, have), verdict("match", 100))
        .when(F.size(longer) == F.size(F.array_except(want, have)), verdict("match", 100 - 5.0 * F.size(longer)))
    )


def company_found(declared: Column, text: Column) -> Column:
    """Native rungs for companies: all words, or at least 60 of 100; null where undecided."""
    want, have = tokens(normalize_company(declared)), tokens(normalize_company(text))
    share = 100.0 * F.size(F.array_intersect(want, have)) / F.size(want)
    return (
        F.when(~present(declared) | ~present(text) | (F.size(want) == 0), verdict("field_missing", 0))
        .when(contains_all(want, have), verdict("match", 100))
        .when(share >= 60, verdict("match", F.least(share, F.lit(95.0))))
    )


def address_found(declared: Column, text: Column) -> Column:
    """Native rungs for addresses: two words and 30 of 100 at least; null where undecided."""
    want, have = address_tokens(declared), address_tokens(text)
    both = F.size(F.array_intersect(want, have))
    return F.when(~present(declared) | ~present(text) | (F.size(want) == 0), verdict("field_missing", 0)).when(
        (both >= F.greatest(F.lit(2.0), F.size(want) * 0.3)), verdict("match", 100.0 * both / F.size(want))
    )


def presence(keyword: str, text: Column) -> Column:
    return F.when(F.coalesce(F.lower(text).contains(keyword.lower()), F.lit(False)), verdict("match", 100)).otherwise(verdict("field_missing", 0))


def passage_found(text: Column, passage: str = NOTICE, anchor: str | None = None) -> Column:
    """Native rungs of `match_passage`: held word for word, or without the anchor; null where undecided."""
    s = F.lower(normalize_notice(F.coalesce(text, F.lit(""))))
    held = s.contains(F.lower(normalize_notice(F.lit(passage))))
    begin = (anchor or passage.split(":")[0]).lower()
    return F.when(held, verdict("match", 100)).when(~s.contains(begin), verdict("field_missing", 0))


Open = Callable[[Column], Column]


def survivors(df: DataFrame, out: str, native: Column, score: Callable[[Open], Column | tuple[Column, Column]], threshold: float = THRESHOLD, full: bool = False) -> DataFrame:
    """Add `out`: the native verdict where there is one, else by `score`, which gives a similarity (a match from `threshold` on) or one with whether it is a match.

    `score` gets a function that blanks out what the native rungs decided, so in one pass over the rows kernels work on the others only.
    """
    marked = df.withColumn("__native", native)
    found = score(lambda c: F.when(F.col("__native").isNull(), c))
    value, match = found if isinstance(found, tuple) else (found, F.col("__score") >= threshold)
    scored = marked.withColumn("__score", value)
    top = F.lit(100.0) if full else F.col("__score")
    decided = F.when(match, verdict("match", top)).otherwise(verdict("content_mismatch", F.col("__score")))
    return scored.withColumn(out, F.coalesce("__native", decided)).drop("__score", "__native")


def match_text(df: DataFrame, declared: str, text: str, out: str, partial: float = 90.0) -> DataFrame:
    """Full ladder for names and countries: words, beginnings, word sets, then partial similarity from `partial` on.

    A brand or country is as a rule decided natively; null or empty sides are missing; repeated
    rows and other columns pass through.
    """

    def score(left: Open) -> tuple[Column, Column]:
        a, b = left(normalize_fuzzy(declared)), left(normalize_fuzzy(text))
        by_set, part = kernels.token_set_udf(a, b), kernels.partial_ratio_udf(a, b)
        return F.when(by_set >= THRESHOLD, by_set).when(part >= partial, part).otherwise(F.greatest(by_set, part)), (by_set >= THRESHOLD) | (part >= partial)

    return survivors(df, out, words_found(F.col(declared), F.col(text)), score)


def match_brand(df: DataFrame, declared: str, text: str, out: str) -> DataFrame:
    """`match_text` for brands, which partial similarity matches from 85 on."""
    return match_text(df, declared, text, out, THRESHOLD)


def match_company(df: DataFrame, declared: str, text: str, out: str) -> DataFrame:
    return survivors(df, out, company_found(F.col(declared), F.col(text)), lambda left: kernels.token_set_udf(left(normalize_company(declared)), left(normalize_company(text))))


def match_address(df: DataFrame, declared: str, text: str, out: str) -> DataFrame:
    return survivors(df, out, address_found(F.col(declared), F.col(text)), lambda left: kernels.partial_ratio_udf(left(normalize_fuzzy(declared)), left(normalize_fuzzy(text))))


def match_passage(df: DataFrame, text: str, out: str, passage: str = NOTICE) -> DataFrame:
    """A passage held word for word, or a stretch from its beginning that is similar from 85 on."""
    begin = passage.split(":")[0].lower()

    def score(left: Open) -> Column:
        s, whole = F.lower(normalize_notice(text)), F.lower(normalize_notice(F.lit(passage)))
        section = left(F.substring(s, F.instr(s, begin), 500))
        return F.greatest(kernels.ratio_udf(section, whole), kernels.token_set_udf(section, whole))

    return survivors(df, out, passage_found(F.col(text), passage), score, full=True)


def abv_agrees(found: Column, declared: Column) -> Column:
    """Field against field: struct<status, proof_differs>."""
    a, b, proof = extract_abv(found), extract_abv(declared), extract_proof(found)
    status = F.when(~present(found) | a.isNull(), "field_missing").when(b.isNull(), "content_mismatch").when(F.abs(a - b) <= 0.1, "match").otherwise("content_mismatch")
    return F.struct(status.alias("status"), F.coalesce(F.abs(proof - a * 2) > 0.5, F.lit(False)).alias("proof_differs"))


def contents_agree(found: Column, declared: Column) -> Column:
    """Field against field, any declared line: 0.5 ml in the same unit, 5 ml across units; over five times off is uncertain.

    The nearest declared value is taken from its distance alone, as if it lay below the found one.
    """
    have = net_contents(found)
    ml = to_ml(have["value"], have["unit"])
    lines = F.filter(F.transform(F.split(declared, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    sizes = F.filter(F.transform(lines, net_contents), lambda s: s["value"].isNotNull())
    off = F.transform(sizes, lambda s: F.abs(ml - to_ml(s["value"], s["unit"])))
    near = F.exists(sizes, lambda s: F.abs(ml - to_ml(s["value"], s["unit"])) < F.when(s["unit"] != have["unit"], 5.0).otherwise(0.5))
    least = F.array_min(off)
    other = F.when(ml > least, ml - least).otherwise(ml + least)
    times = F.try_divide(F.greatest(ml, other), F.least(ml, other))
    return (
        F.when(~present(found) | have["value"].isNull(), verdict("field_missing", 0))
        .when(near, verdict("match", 100))
        .when(F.size(sizes) <= 0, verdict("content_mismatch", 0))
        .when(times > 5, verdict("extraction_uncertain", 30))
        .otherwise(verdict("content_mismatch", 0))
    )


def score_values(df: DataFrame, expected: str, actual: str, out: str) -> DataFrame:
    """Add `out`, 0 to 100: how an actual value meets the expected one; kernels run only where the texts differ."""
    a, b = eval_text(expected), eval_text(actual)
    native = F.when(a == b, 100.0).when((a == "") | (b == ""), 0.0)
    marked = df.withColumn(out, native)
    left = marked.where(F.col(out).isNull())
    best = F.greatest(kernels.ratio_udf(a, b), kernels.token_sort_udf(a, b), kernels.token_set_udf(a, b))
    return marked.where(F.col(out).isNotNull()).unionByName(left.withColumn(out, best))


def exact_value(df: DataFrame, found: str, canonical: str, out: str) -> DataFrame:
    """Equal after blanks collapse, or after hyphens within words are dropped as well; else partial credit by similarity."""
    from caskwise.functions.text import normalize_whitespace

    a, b = F.coalesce(F.col(found), F.lit("")), F.coalesce(F.col(canonical), F.lit(""))
    same = (F.lower(normalize_whitespace(a)) == F.lower(normalize_whitespace(b))) | (F.lower(normalize_notice(a)) == F.lower(normalize_notice(b)))
    native = F.when(same, verdict("match", 100))
    return survivors(df, out, native, lambda left: kernels.ratio_udf(left(F.lower(normalize_notice(a))), left(F.lower(normalize_notice(b)))), threshold=100.1)


def address_value(df: DataFrame, found: str, declared: str, out: str) -> DataFrame:
    """An address found on its own: all its words declared, so a town and state are enough; else by similarity."""
    have, want = address_tokens(found), address_tokens(declared)
    native = F.when(~present(found) | (F.size(have) == 0), verdict("field_missing", 0)).when(contains_all(have, want), verdict("match", 100))
    return survivors(df, out, native, lambda left: kernels.fuzzy_udf(left(normalize_fuzzy(found)), left(normalize_fuzzy(declared))))


def fuzzy_value(df: DataFrame, found: str, declared: str, out: str) -> DataFrame:
    """Brand, producer or country found on its own, by the blended similarity."""
    native = F.when(~present(found) | (normalize_fuzzy(found) == ""), verdict("field_missing", 0))
    return survivors(df, out, native, lambda left: kernels.fuzzy_udf(left(normalize_fuzzy(found)), left(normalize_fuzzy(declared))))


def present_value(found: Column, required: Column | bool = True) -> Column:
    """Whether a field was found at all; one that isn't required matches."""
    needed = required if isinstance(required, Column) else F.lit(required)
    return F.when(present(found) | ~F.coalesce(needed, F.lit(False)), verdict("match", 100)).otherwise(verdict("field_missing", 0))


def class_value(df: DataFrame, found: str, declared: str, variants: DataFrame, out: str) -> DataFrame:
    """A class found on its own: by the canonical names of both sides, 100 or 0; where one has none, all declared words found give 95, else by similarity.

    Texts without a canonical name are compared without their qualifiers. Blank found values are missing.
    """
    from caskwise.functions.classes import normalize_classes, strip_qualifiers

    named = normalize_classes(normalize_classes(df, found, variants, "__f"), declared, variants, "__d")
    a, b = (F.coalesce(c, strip_qualifiers(F.trim(F.col(v)))["base"], F.lit("")) for c, v in (("__f", found), ("__d", declared)))
    words = tokens(normalize_fuzzy(b))
    native = (
        F.when(~F.coalesce(F.trim(F.col(found)) != "", F.lit(False)), verdict("field_missing", 0))
        .when(F.col("__f") == F.col("__d"), verdict("match", 100))
        .when(F.col("__f").isNotNull() & F.col("__d").isNotNull(), verdict("content_mismatch", 0))
        .when((F.size(words) > 0) & contains_all(words, tokens(normalize_fuzzy(a))), verdict("match", 95))
    )
    return survivors(named, out, native, lambda left: kernels.fuzzy_udf(left(normalize_fuzzy(a)), left(normalize_fuzzy(b)))).drop("__f", "__d")


def match_class(df: DataFrame, declared: str, text: str, variants: DataFrame, out: str) -> DataFrame:
    """A filing category is uncertain, as no label shows it. Else class words in the text: all of the canonical (else stripped) name, or a variant of the same class, else by similarity."""
    from caskwise.functions.classes import administrative, normalize_classes, strip_qualifiers

    named = normalize_classes(df, declared, variants, "__canonical").withColumn("__term", F.coalesce("__canonical", F.nullif(strip_qualifiers(F.col(declared))["base"], F.lit("")), F.col(declared)))
    classes = variants.where("variant is not null").groupBy("canonical").agg(F.collect_set(normalize_fuzzy("variant")).alias("__variants")).withColumnRenamed("canonical", "__of")
    joined = named.join(classes, F.col("__canonical") == F.col("__of"), "left")
    s = normalize_fuzzy(text)
    held = F.exists(F.coalesce("__variants", F.array().cast("array<string>")), lambda v: F.concat(F.lit(" "), s, F.lit(" ")).contains(F.concat(F.lit(" "), v, F.lit(" "))))
    native = (
        F.when(~present(declared), verdict("field_missing", 0))
        .when(administrative(F.col(declared))["is_administrative"], verdict("extraction_uncertain", 50))
        .when(contains_all(tokens(normalize_fuzzy("__term")), tokens(s)), verdict("match", 100))
        .when(held, verdict("match", 90))
    )
    score = lambda left: F.greatest(kernels.partial_ratio_udf(left(normalize_fuzzy("__term")), left(s)), kernels.token_set_udf(left(normalize_fuzzy("__term")), left(s)))
    return survivors(joined, out, native, score).drop("__canonical", "__term", "__of", "__variants")
