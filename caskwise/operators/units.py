"""Quantities written in many units, brought to common units.

A small grammar reads numbers and unit expressions out of text:

    statement := number blank? unit-expression        (also: unit ':' number)
    number    := digits [mark digits] | fraction | number words
    unit-expression := unit [('/' | 'per') unit]

Every unit is a scale, an offset and a vector of exponents over the base dimensions. A statement
counts only where its exponents equal those of the wanted kind, so ages, temperatures and the like
are read as what they are and fall away. Scales of volume and strength come from the reference table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caskwise.functions.chars import consistent

#: Base dimensions of the exponent vectors.
BASES = ("length", "mass", "time", "temperature", "alcohol")
#: The reference table is read to the driver; more rows than this are refused.
REFERENCE_LIMIT = 10_000


@dataclass(frozen=True)
class Unit:
    """amount in canonical units = (written + offset) * scale"""

    name: str
    scale: Decimal
    dims: tuple[int, ...]
    offset: Decimal = Decimal(0)
    metric: bool = False

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(f"{self.name}/{other.name}", self.scale / other.scale, tuple(a - b for a, b in zip(self.dims, other.dims, strict=True)))

    def convert(self, value: Decimal) -> Decimal:
        return (value + self.offset) * self.scale


def dims(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(b, 0) for b in BASES)


VOLUME, STRENGTH = dims(length=3), dims(alcohol=1)
KINDS = {"volume": VOLUME, "strength": STRENGTH}

# How each unit of the reference table is written (text in lower case).
SPELLINGS = {
    "millilitre": r"m\.?\s?l\.?s?|mils?|millilit(?:er|re)s?",
    "centilitre": r"c\.?\s?l\.?|centilit(?:er|re)s?",
    "decilitre": r"d\.?\s?l\.?|decilit(?:er|re)s?",
    "litre": r"lit(?:er|re)s?|ltrs?\.?|lts?\.?|l\.?",
    "us fluid ounce": r"(?:u\.?\s?s\.?\s*)?(?:fl(?:uid)?\.?\s*(?:oz|ounces?)|oz\.?\s*fl|oz|ounces?)\.?",
    "us pint": r"(?:u\.?\s?s\.?\s*)?(?:pints?|pts?\.?)",
    "us quart": r"(?:u\.?\s?s\.?\s*)?(?:quarts?|qts?\.?)",
    "us gallon": r"(?:u\.?\s?s\.?\s*)?gal(?:lon)?s?\.?",
    "proof": r"°?\s*(?:proof|prf)\b\.?(?!\s*[:=])",
    "degree gay-lussac": r"°\s*g\.?\s?l\.?|g\.?l\.?(?![a-z])|deg(?:rees?|\.)?\s*gay[\s-]*lussac|°?\s*gay[\s-]*lussac",
    "percent by weight": r"(?:%|per\s?cent|pct\.?)?\s*(?:\(?\s*abw\b|w\s*/\s*w|(?:alc(?:ohol)?\.?\s*)?(?:by\s*|/\s*)(?:weight|wt\.?)|mass\b)",
    "percent by volume": r"%|per\s?cent|pct\.?|(?:by\s*)?vol(?:ume)?\b\.?",
}

#: Ends of the names of metric volumes.
METRIC_END = ("litre", "liter")


def as_named(name: str) -> str:
    """A unit's name as a pattern: singular or plural, '-re' or '-er' at its end, blanks of any width."""
    words = [re.escape(w) for w in name.lower().split()]
    last = re.sub(r"(?:tre|ter)$", "t(?:re|er)", words[-1])
    return r"\s*".join([*words[:-1], last]) + "s?"


#: Units that are read to be told apart, never counted.
OTHERS = (
    (Unit("year", Decimal(12), dims(time=1)), r"(?:year|yr|month|day|hour)s?\b\.?"),
    (Unit("celsius", Decimal(1), dims(temperature=1)), r"(?:°\s*c\b|degrees?\s*c(?:elsius)?\b|°(?!\s*(?:g|p))|degrees?\b(?!\s*(?:gay|proof)))"),
    (Unit("fahrenheit", Decimal(5) / 9, dims(temperature=1), Decimal(-32)), r"(?:°\s*f|degrees?\s*f(?:ahrenheit)?)\b"),
    (Unit("gram", Decimal(1), dims(mass=1)), r"(?:grams?|g|kg|lbs?)\b\.?"),
    (Unit("metre", Decimal(1), dims(length=1)), r"(?:mm|cm|metres?|meters?|inch(?:es)?)\b\.?"),
)

ONES = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | {"fourty": 40, "half": Decimal("0.5"), "quarter": Decimal("0.25")}
_WORD = "(?:" + "|".join(sorted([*WORDS, "hundred", "thousand"], key=len, reverse=True)) + ")"
_NUMBER = rf"(?P<n>(?:\d+\s+)?[1-7]/(?:2|3|4|5|8)(?![\d.,/])|\d*[.,]\d+|\d+|(?<![a-z]){_WORD}(?:(?:[\s-]+|\s+and\s+|\s+and\s+a\s+){_WORD})*(?:\s+point\s+{_WORD}(?:\s+{_WORD})*)?(?![a-z]))"


def number(text: str) -> Decimal:
    """A written number: '0,75', '.5', '1/2', 'forty-three', 'seven hundred fifty'."""
    text = text.strip().lower()
    if text[0].isdigit() or text[0] in ".,":
        if "/" in text:
            *ones, part = text.split()
            a, b = map(Decimal, part.split("/"))
            return sum(map(Decimal, ones), a / b)
        return Decimal(text.replace(",", "."))
    whole, _, after = text.partition(" point ")
    total = Decimal(0)
    part = Decimal(0)
    for w in re.split(r"[\s-]+", whole):
        if w == "hundred":
            part = (part or 1) * 100
        elif w == "thousand":
            total, part = total + (part or 1) * 1000, Decimal(0)
        elif w in WORDS:
            part += WORDS[w]
    digits = "".join(str(WORDS[w]) for w in after.split() if w in WORDS)
    return total + part + (Decimal(f"0.{digits}") if digits else 0)


@dataclass(frozen=True)
class Statement:
    amount: Decimal
    unit: Unit
    start: int
    end: int


class Grammar:
    """Reads statements of quantities for one table of unit factors."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        metric = {"millilitre", "centilitre", "decilitre", "litre"}
        self.units: list[tuple[Unit, str]] = []
        for name, kind, factor in rows:
            if kind not in KINDS:
                raise ValueError(f"unit {name} is of an unknown kind: {kind}")
            self.units.append((Unit(name, Decimal(str(factor)), KINDS[kind], metric=name in metric or name.endswith(METRIC_END)), SPELLINGS.get(name) or as_named(name)))
        order = list(SPELLINGS)
        # units that have no spellings of their own are read by their name, before the short forms of others
        self.units.sort(key=lambda u: order.index(u[0].name) if u[0].name in SPELLINGS else -1)
        self.units += OTHERS
        self.by_group = {f"u{i}": u for i, (u, _) in enumerate(self.units)}
        # longest reading first: weight before plain percent, degrees of strength before bare degrees
        alternatives = "|".join(f"(?P<u{i}>(?:{p})(?![a-z]))" for i, (_, p) in enumerate(self.units))
        self.pattern = re.compile(rf"(?<![\d.,]){_NUMBER}\s*-?\s*(?:{alternatives})", re.I)
        self.prefixed = re.compile(rf"(?<![a-z])(?P<unit>proof|abv|a\.b\.v\.)\s*[:=]\s*{_NUMBER}(?!\s*(?:%|\d|[.,]\d))", re.I)
        self.proof = next((u for u, _ in self.units if u.name == "proof"), None)
        self.percent = next((u for u, _ in self.units if u.name == "percent by volume"), None)

    def statements(self, text: str) -> list[Statement]:
        out = []
        for m in self.pattern.finditer(text):
            unit = self.by_group[m.lastgroup] if m.lastgroup in self.by_group else None
            unit = unit or next(u for g, u in self.by_group.items() if m.group(g) is not None)
            value = number(m.group("n"))
            if unit.dims == STRENGTH and unit.name == "percent by volume" and re.match(r"\s*\(?\s*(?:abw\b|(?:alc(?:ohol)?\.?\s*)?(?:by|/)\s*(?:weight|wt)|w\s*/\s*w)", text[m.end():], re.I):
                unit = next((u for u, _ in self.units if u.name == "percent by weight"), unit)
            out.append(Statement(unit.convert(value), unit, m.start(), m.end()))
        if not any(s.unit.dims == STRENGTH for s in out):
            for m in self.prefixed.finditer(text):
                unit = self.proof if m.group("unit").lower() == "proof" else self.percent
                if unit:
                    out.append(Statement(unit.convert(number(m.group("n"))), unit, m.start(), m.end()))
        return out

    def volumes(self, text: str | None) -> list[Decimal]:
        """Millilitres of each size, as written from left to right."""
        sizes = []
        for part in re.split(r"[\n\r;]+", consistent(text) or ""):
            part = part.lower()
            found = [s for s in self.statements(part) if s.unit.dims == VOLUME]
            metric = [s for s in found if s.unit.metric]
            if metric:
                sizes.append(metric[0].amount)
            elif found:
                total, last = found[0].amount, found[0]
                for s in found[1:]:  # larger and smaller units of one size stand side by side
                    if s.unit.scale >= last.unit.scale or not re.fullmatch(r"\s*(?:,|&|and|\+)?\s*", part[last.end : s.start]):
                        break
                    total, last = total + s.amount, s
                sizes.append(total)
        return sizes

    def strength(self, text: str | None) -> Decimal | None:
        """Percent by volume; stated by volume before proof before weight."""
        text = re.sub(r"\s+", " ", consistent(text) or "").lower()
        found = [s for s in self.statements(text) if s.unit.dims == STRENGTH]
        rank = {"percent by volume": 0, "degree gay-lussac": 0, "proof": 1, "percent by weight": 2}
        plain = re.compile(r"^\s*(?:alc|abv|vol|by\s*vol|v\s*/\s*v|\(?proof)")

        def key(s: Statement) -> tuple[int, int, int]:
            named = bool(plain.match(text[s.end :])) or bool(re.search(r"(?:alc\w*|abv|strength)[.,:]?\s*$", text[: s.start]))
            return rank.get(s.unit.name, 3), 0 if named or s.unit.name != "percent by volume" else 1, s.start

        return min(found, key=key).amount if found else None


def half_up(x: Decimal) -> int:
    return int((x + Decimal("0.5")).to_integral_value(ROUND_FLOOR))


def reference_rows(units: DataFrame) -> list[tuple[str, str, float]]:
    """The unit table on the driver; it doesn't grow, and more than REFERENCE_LIMIT rows are refused."""
    rows = units.select("unit_name", "quantity_kind", "factor").where("unit_name is not null and factor is not null").limit(REFERENCE_LIMIT + 1).collect()
    if len(rows) > REFERENCE_LIMIT:
        raise ValueError(f"the unit reference has more than {REFERENCE_LIMIT} rows")
    return [(r[0], r[1], r[2]) for r in rows]


def with_amounts(df: DataFrame, value: str, field: str, units: DataFrame, out: str = "amounts") -> DataFrame:
    """Add `out`, an array<bigint>: the amounts that column `value` states, read as `field` says.

    `field` holds 'net_contents' (whole millilitres, one entry a size) or 'alcohol_content' (hundredths
    of a percent by volume, at most one entry). Null, empty or unreadable values and other fields give
    an empty array. Rows are neither dropped nor shuffled, so repeated rows stay repeated; an
    empty table gives an empty table; other columns pass through.
    """
    rows = reference_rows(units)

    @F.pandas_udf("array<bigint>")
    def amounts(values: pd.Series, fields: pd.Series) -> pd.Series:
        read = _reader(tuple(rows))
        return pd.Series([read(v, f) if v else [] for v, f in zip(values, fields, strict=True)], dtype=object)

    return df.withColumn(out, amounts(F.col(value), F.col(field)))


@lru_cache(maxsize=4)
def _reader(rows: tuple[tuple[str, str, float], ...]):  # noqa: ANN202
    grammar = Grammar(rows)

    @lru_cache(maxsize=100_000)
    def read(value: str, field: str) -> list[int]:
        if field == "net_contents":
            return [half_up(x) for x in grammar.volumes(value)]
        if field == "alcohol_content":
            x = grammar.strength(value)
            return [] if x is None else [half_up(x * 100)]
        return []

    return read


def stated_quantities(applications: DataFrame, results: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each stated quantity: src, row_id, field_name, item_no, amount.

    Sources are `net_contents` and `alcohol_content` of the applications and the `extracted_value` of
    comparison results for these two fields. Null and empty values state nothing; a repeated row states
    its quantities again under its own id; sizes in one value that are equal are separate items.
    """
    declared = applications.select(
        F.lit("applications").alias("src"),
        F.col("row_id").cast("bigint").alias("row_id"),
        F.expr("stack(2, 'net_contents', net_contents, 'alcohol_content', alcohol_content) as (field_name, value)"),
    )
    extracted = results.where(F.col("field_name").isin("net_contents", "alcohol_content")).select(
        F.lit("comparison_results").alias("src"), F.col("result_id").cast("bigint").alias("row_id"), "field_name", F.col("extracted_value").alias("value")
    )
    long = declared.unionByName(extracted).where("value is not null and value <> ''")
    items = with_amounts(long, "value", "field_name", units).select("src", "row_id", "field_name", F.posexplode("amounts").alias("pos", "amount"))
    return items.select("src", "row_id", "field_name", (F.col("pos") + 1).cast("bigint").alias("item_no"), "amount")
