"""Fields out of form text and HTML, by native expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links of HTML and Markdown, and bare addresses.
LINK = r"https?://[^\s\"'<>)\]|]+"


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s))


def after_anchor(text: Column, anchor: str, pattern: str) -> Column:
    """What `pattern` finds on the line behind one that has `anchor`; null without it."""
    return F.nullif(F.regexp_extract(text, rf"(?im){anchor}[^\n]*\n\s*({pattern})", 1), F.lit(""))


def next_line(text: Column, label: str, labels: list[str] | None = None) -> Column:
    """The line after the first one that contains `label`, if it isn't empty and holds no label itself."""
    at = lines(text)
    follows = F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    banned = [label, *(labels or [])]
    ok = lambda b: (b != "") & ~F.lower(b).rlike("|".join(x.lower() for x in banned))
    return F.get(F.filter(follows, lambda p: F.lower(p["a"]).contains(label.lower()) & ok(p["b"])), F.lit(0))["b"]


def permit(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b([A-Z]{1,4}-(?:[A-Z]{1,2}-)?\d+)\b", 1), F.lit(""))


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1))


def host(link: Column) -> Column:
    return F.lower(F.regexp_extract(link, r"^https?://([^/:?#]+)", 1))


def is_new_form(text: Column) -> Column:
    return F.coalesce(text.contains("SOURCE OF") & text.contains("PRODUCT"), F.lit(False))


def assemble(text: Column) -> Column:
    """struct of the fields a form text yields: class, brand, permit, origin by the permit's form, form version."""
    from caskwise.functions.text import infer_beverage, infer_origin

    kind = next_line(text, "class/type")
    return F.struct(
        next_line(text, "brand name").alias("brand_name"), next_line(text, "fanciful name").alias("fanciful_name"), kind.alias("class_type"), permit(text).alias("permit"),
        infer_origin(permit(text)).alias("source_of_product"), infer_beverage(kind).alias("beverage_type"), is_new_form(text).alias("new_form"),
    )


#: Images smaller than this in bytes, or with a shorter side than this, carry no label.
LEAST_BYTES, LEAST_SIDE = 5000, 80


def is_label_image(size: Column, width: Column, height: Column) -> Column:
    """Whether an image can be a label by its metadata: not tiny, and not the long low strip of a signature."""
    short, long = F.least(width, height), F.greatest(width, height)
    strip = (short < 200) & (long > 3 * short)
    return F.coalesce((size >= LEAST_BYTES) & (short >= LEAST_SIDE) & ~strip, F.lit(False))


def is_signature(pixels: Column, white: float = 0.80, grey: float = 0.95) -> Column:
    """Whether an array<struct<r, g, b>> is mostly white and grey, as a signature on paper is; an empty one is not."""
    n = F.size(pixels)
    part = lambda test: F.try_divide(F.size(F.filter(pixels, test)), n)
    is_white = lambda p: (p["r"] > 240) & (p["g"] > 240) & (p["b"] > 240)
    is_grey = lambda p: (F.abs(p["r"].cast("int") - p["g"].cast("int")) < 15) & (F.abs(p["g"].cast("int") - p["b"].cast("int")) < 15)
    return F.coalesce((part(is_white) >= white) & (part(is_grey) >= grey), F.lit(False))


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box in percent of an image as whole pixels from its upper left corner."""
    at = lambda p, side: F.floor(box[p] / 100 * side)
    return F.struct(at("x", width).alias("x"), at("y", height).alias("y"), at("width", width).alias("width"), at("height", height).alias("height"))


def fitted(width: Column, height: Column, most: int = 1568, least: int = 800, to: int = 1400) -> Column:
    """Size at which an image is read: long side at most `most`; one under `least` grows to `to` at most."""
    long = F.greatest(width, height)
    scale = F.when(long > most, most / long).when(long < least, F.least(F.lit(to) / long, F.lit(2.0))).otherwise(1.0)
    return F.struct(F.floor(width * scale).alias("width"), F.floor(height * scale).alias("height"))


def applicant(text: Column, begin: str, end: str) -> Column:
    """struct<name, address> of the block between two anchors: a name marked as trade name wins over the first line, a permit
    number before the name is cut off, the other lines are the address, joined with ', '."""
    block = F.regexp_extract(text, rf"(?is){begin}[^\n]*\n(.*?)(?:{end}|\z)", 1)
    rows = F.filter(lines(block), lambda s: s != "")
    trade = F.filter(rows, lambda s: s.rlike(r"(?i)\(?trade\s*name\)?|\bdba\b"))
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[A-Z]{1,4}(?:-[A-Z]{1,3}){1,3}-\d+\s*", ""), r"(?i)\s*\(?(?:used on label|trade\s*name|dba)\)?:?\s*", " "))
    rest = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda s: ~s.rlike(r"(?i)\(?trade\s*name\)?|\bdba\b"))
    name = clean(F.coalesce(F.get(trade, F.lit(0)), F.get(rows, F.lit(0))))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(F.array_join(rest, ", "), F.lit("")).alias("address"))


def sizes_and_strength(text: Column, anchor: str = "net contents") -> Column:
    """struct<sizes array<string>, strength string> of the lines behind an anchor, in which sizes and a strength stand side by side.

    The strength is the number behind the first size, or before the first percent sign; of a range the low end.
    """
    tail = F.regexp_extract(text, rf"(?is){anchor}[^\n]*\n(.*)", 1)
    bare = F.regexp_replace(tail, r"\([^)]*\)", " ")
    size = r"\d+(?:\.\d+)?\s*(?:milliliters?|ml|liters?|litres?|l|fl\.?\s*oz\.?|gallons?|gal)\b\.?"
    found = F.regexp_extract_all(bare, F.lit(rf"(?i)({size})"), F.lit(1))
    beside = F.regexp_extract(F.regexp_replace(bare, rf"(?i){size}", "\u0001"), r"\x01\s*(?:\x01\s*)*(\d+(?:\.\d+)?)", 1)
    percent = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)\s*(?:-\s*\d+(?:\.\d+)?\s*)?%", 1)
    return F.struct(found.alias("sizes"), F.coalesce(F.nullif(beside, F.lit("")), F.nullif(percent, F.lit(""))).alias("strength"))
