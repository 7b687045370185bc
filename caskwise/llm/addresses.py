"""Postal addresses of one place written differently (problem 1).

Every distinct address is read into typed components. Addresses are then joined by set
containment: each address is indexed by the rarest of its tokens (a word or post code taken together
with the house number, a word under all forms with one letter left out, so that a typo still meets),
fuller addresses probe with all of theirs, and a pair is verified by weighted containment of its
words and by the absence of contradictory components. Addresses alike in all components form
locations; one with parts left out joins the one location that fits, and none if several do.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.functions.chars import consistent
from caskwise.functions.graph import components
from caskwise.llm.lexicon import distance
from caskwise.session import cut

#: Tokens of an address that are put into the index, rarest first.
INDEXED = 3
#: Share of an address's word weight that a fuller one has to hold.
CONTAINMENT = 0.99

# Street kinds, directions, town prefixes, states and countries as written.
KINDS = {
    "street": "street st str strasse strase", "road": "road rd", "avenue": "avenue ave av", "boulevard": "boulevard blvd boul bvd", "lane": "lane ln",
    "drive": "drive dr drv", "court": "court ct crt", "place": "place pl plc", "highway": "highway hwy hiway", "parkway": "parkway pkwy pky pkway",
    "terrace": "terrace ter terr", "square": "square sq", "way": "way wy", "trail": "trail trl", "circle": "circle cir", "row": "row",
    "calle": "calle", "via": "via", "rue": "rue", "alley": "alley aly", "pike": "pike tpke turnpike",
}
DIRECTIONS = {"north": "north n no nth", "south": "south s so sth", "east": "east e", "west": "west w"}
PREFIXES = {"saint": "saint st ste", "fort": "fort ft", "mount": "mount mt", "lake": "lake lk", "port": "port pt", "new": "new"}
STATES = {
    "al": "alabama ala", "ak": "alaska", "az": "arizona ariz", "ar": "arkansas ark", "ca": "california calif cal", "co": "colorado colo", "ct": "connecticut conn",
    "de": "delaware del", "fl": "florida fla", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois ill", "in": "indiana ind", "ia": "iowa",
    "ks": "kansas kans", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts mass", "mi": "michigan mich",
    "mn": "minnesota minn", "ms": "mississippi miss", "mo": "missouri", "mt": "montana mont", "ne": "nebraska nebr", "nv": "nevada nev", "nh": "",
    "nj": "", "nm": "", "ny": "", "nc": "", "nd": "", "oh": "ohio", "ok": "oklahoma okla", "or": "oregon ore oreg", "pa": "pennsylvania penna penn",
    "ri": "", "sc": "", "sd": "", "tn": "tennessee tenn", "tx": "texas tex", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington wash",
    "wv": "", "wi": "wisconsin wis wisc", "wy": "wyoming wyo",
}
TWO_WORD_STATES = {
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "west virginia": "wv", "n carolina": "nc", "s carolina": "sc", "no carolina": "nc", "so carolina": "sc",
    "n dakota": "nd", "s dakota": "sd", "w virginia": "wv", "n y": "ny", "n j": "nj", "n c": "nc", "s c": "sc", "n h": "nh", "n m": "nm", "r i": "ri", "w va": "wv",
}
COUNTRIES = ["united states of america", "united states", "united kingdom", "great britain", "u s a", "u s", "u k", "usa", "us", "uk", "gb", "france", "fr", "spain", "espana", "es", "mexico", "mx", "italy", "italia", "it", "germany", "deutschland", "scotland", "england", "wales"]
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
JOINING = {"de", "la", "du", "des", "del", "le", "della", "di", "of", "the", "d"}

_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
_DIRECTION = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}
_PREFIX = {w: k for k, ws in PREFIXES.items() for w in ws.split()}
_STATE = {w: k for k, ws in STATES.items() for w in ws.split()}
_LONG = {k: "kind" for k in KINDS} | {k: "direction" for k in DIRECTIONS} | {k: "prefix" for k in PREFIXES} | {w: "state" for w in _STATE} | {w: "country" for c in COUNTRIES for w in c.split()}
_COUNTRY = re.compile(r"(?:(?<=^)|(?<=[ |]))(?:" + "|".join(sorted(COUNTRIES, key=len, reverse=True)) + r")(?= *(?:\||$))")
_TWO_STATE = re.compile(r"(?<![a-z])(?:" + "|".join(sorted(TWO_WORD_STATES, key=len, reverse=True)) + r")(?= *(?:\||$|\d))")
_BOX = re.compile(r"(?<![a-z])(?:p\.? ?o\.? ?box|p\.? ?o\.? ?b\.?|post office box|postal box|box|postfach|apartado)\.? *#? *(\d+)")
_UNIT = re.compile(r"(?<![a-z])(?:suite|ste|unit|bldg|building|apt|apartment|floor|fl|room|rm)\.? *#? *(\d+[a-z]?|[a-z])(?![a-z0-9])")
_UK_CODE = re.compile(r"(?<![a-z0-9])([a-z]{1,2}\d{1,3}[a-z]?) ?(\d[a-z]{2})(?![a-z0-9])")
_ZIP = re.compile(r"(?<![\d#])(\d{5})(?:-\d{4})?(?!\d)")


def parse(text: str) -> dict | None:
    """Typed components of an address; None for one without house number or post-office box."""
    s = (consistent(text) or "").casefold()
    s = s.translate(str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"))
    s = re.sub(r"\s+-\s+|[\n\r;,/]+", " | ", s.replace("c/", "calle "))
    code = box = None
    if m := _BOX.search(s):
        box, s = m.group(1).lstrip("0"), s[: m.start()] + " | " + s[m.end() :]
    s = _UNIT.sub(" | ", s)
    if m := _UK_CODE.search(s):
        code, s = m.group(1) + m.group(2), s[: m.start()] + " | " + s[m.end() :]
    s = re.sub(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)\b", lambda m: ORDINALS[int(m.group(1)) - 1] if 0 < int(m.group(1)) <= len(ORDINALS) else m.group(), s)
    s = re.sub(r"(?<![a-z])(?:no|nr|num|nro|n|numero|number)\.?\s*#?\s*(?=\d)", " #", s)
    zips = list(_ZIP.finditer(s))
    numbers = [m for m in re.finditer(r"#?\s*(?<!\d)(\d{1,6}[a-z]?)(?![\d])", s)]
    house = None
    if zips and not code:
        others = [m for m in numbers if not any(z.start(1) <= m.start(1) < z.end() for z in zips)]
        pick = zips[-1]
        if not others and box is None:
            if len(zips) > 1:
                first = zips[0].start() <= len(s) - len(s.lstrip(" |#"))
                pick = zips[-1] if first else zips[0]
            elif not s[: pick.start()].strip(" |#") and any(w in _KIND for w in re.findall("[a-z]+", s)):
                pick = None
        if pick is not None:
            code, s = pick.group(1), s[: pick.start()] + " | " + s[pick.end() :]
    numbers = list(re.finditer(r"#?\s*(?<!\d)(\d{1,6})[a-z]?(?![\d])", s))
    if box is None and numbers:
        plain = [m for m in numbers if not m.group().startswith("#")]
        pick = (plain or numbers)[0]
        house = pick.group(1).lstrip("0")
        for m in reversed(numbers):
            s = s[: m.start()] + (" # " if m is pick else " | ") + s[m.end() :]
    if not house and not box:
        return None
    s = re.sub(r"[^a-z0-9#| ]+", lambda m: "" if m.group() in ("'", "’") else " ", s)
    s = re.sub(r" +", " ", re.sub(r"(?: *\| *)+", " | ", s)).strip(" |")
    s = _COUNTRY.sub(" ", s)
    s = re.sub(r"(?: *\| *)+", " | ", s).strip(" |")
    s = _COUNTRY.sub(" ", s)
    states = []

    def state(m: re.Match) -> str:
        states.append(TWO_WORD_STATES[m.group()])
        return " "

    s = _TWO_STATE.sub(state, re.sub(r" +", " ", s))
    kinds, directions, prefixes, words = [], [], [], []
    for part in s.split("|"):
        tokens = part.split()
        bare = [t for t in tokens if t != "#"]
        for i, t in enumerate(bare):
            last, first = i == len(bare) - 1, i == 0
            after = bare[i + 1] if not last else ""
            if t in ("c", "v", "r") and after and not kinds and len(t) == 1 and "#" not in tokens[: tokens.index(t)] or t in ("r",) and after and first:
                kinds.append({"c": "calle", "v": "via", "r": "rue"}[t])
            elif t in STATES and last and (t not in ("ct", "de", "la") or (i > 0 and bare[i - 1] not in JOINING and len(part.split()) > 1 and kinds)) and not (t == "mt" and after):
                states.append(t)
            elif t in _STATE and (last or after in ("#",)) and t not in STATES:
                states.append(_STATE[t])
            elif t == "st":
                other = any(w in _KIND and w != "st" for w in re.findall("[a-z]+", s)) or "street" in kinds
                (prefixes.append("saint") if after and (tokens[0] == "st" and first or other) else kinds.append("street"))
            elif t in _KIND and not (t in ("way", "row", "park") and first):
                kinds.append(_KIND[t])
            elif t in _DIRECTION:
                directions.append(_DIRECTION[t])
            elif t in _PREFIX:
                prefixes.append(_PREFIX[t])
            elif t in JOINING:
                continue
            elif t.endswith(("strasse", "strase")) or (t.endswith("str") and len(t) > 5):
                kinds.append("street")
                words.append(re.sub(r"stra?s?s?e?$", "", t))
            else:
                words.append(t)
    if len(words) > 1 and not states:
        for i, w in enumerate(words):
            if w in _STATE or w in STATES and i:
                states.append(_STATE.get(w, w))
                words = words[:i] + words[i + 1 :]
                break
    place = {"calle", "via", "rue"} & set(kinds)
    return {
        "number": ("box" if box else "") + (box or house),
        "code": code,
        "state": states[0] if states else None,
        "kind": None if box else (sorted(place)[0] if place else kinds[-1] if kinds else None),
        "directions": sorted(directions),
        "prefixes": sorted(set(prefixes)),
        "words": sorted(words),
    }


def _word_pairs(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Words of each side without a partner on the other; equal words pair before similar ones."""
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    for w in list(left):
        near = next((x for x in right if _close(w, x)), None)
        if near is not None:
            left.remove(w)
            right.remove(near)
    return left, right


@lru_cache(maxsize=200_000)
def _close(a: str, b: str) -> bool:
    n = max(len(a), len(b))
    if n < 4 or abs(len(a) - len(b)) > 2:
        return False
    return distance(a, b) <= (1 if n < 7 else 2)


def _explained(word: str, full: dict) -> bool:
    """A word left over is a mistyped kind, direction, prefix, state or country of the fuller address."""
    for known, what in _LONG.items():
        if len(known) > 3 and _close(word, known):
            if what == "country":
                return True
            if what == "kind" and full["kind"] in (None, known) or what == "direction" and known in full["directions"] or what == "prefix" and known in full["prefixes"]:
                return True
            if what == "state" and full["state"] in (None, _STATE.get(known)):
                return True
    return False


def _subset(a: list[str], b: list[str]) -> bool:
    rest = list(b)
    for x in a:
        if x not in rest:
            return False
        rest.remove(x)
    return True


def relation(x: dict, y: dict, weight: dict[str, float] | None = None) -> str:
    """How x and y relate: 'same' components, x 'in' y, y contained in x ('has'), or '' for another place."""
    if x["number"] != y["number"]:
        return ""
    for part in ("code", "state", "kind"):
        if x[part] and y[part] and x[part] != y[part]:
            return ""
    if x["prefixes"] and y["prefixes"] and not set(x["prefixes"]) & set(y["prefixes"]):
        return ""
    left, right = _word_pairs(x["words"], y["words"])
    odd_left, odd_right = [w for w in left if not _explained(w, y)], [w for w in right if not _explained(w, x)]

    def held(words: list[str], odd: list[str]) -> bool:
        if not words:  # street and town left out: the post code has to speak
            return bool(x["code"] and y["code"])
        total = sum((weight or {}).get(w, 1.0) for w in words)
        return len(odd) < len(words) and 1 - sum((weight or {}).get(w, 1.0) for w in odd) / total >= CONTAINMENT

    in_y = held(x["words"], odd_left) and _subset(x["directions"], y["directions"]) and (not x["kind"] or bool(y["kind"]) or len(right) > len(left))
    in_x = held(y["words"], odd_right) and _subset(y["directions"], x["directions"]) and (not y["kind"] or bool(x["kind"]) or len(left) > len(right))
    if in_y and in_x:
        placed_x, placed_y = bool(x["code"] or x["state"]), bool(y["code"] or y["state"])
        if placed_x != placed_y and x["kind"] == y["kind"] and x["directions"] == y["directions"]:
            return "in" if placed_y else "has"  # without state and code a town's name may fit several
        return "same" if bool(x["kind"]) == bool(y["kind"]) and x["directions"] == y["directions"] else ("in" if len(x["directions"]) + bool(x["kind"]) < len(y["directions"]) + bool(y["kind"]) else "has")
    return "in" if in_y else "has" if in_x else ""


COMPONENTS = T.StructType([
    T.StructField("number", T.StringType()), T.StructField("code", T.StringType()), T.StructField("state", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("form", T.StringType()),
])


@F.pandas_udf(COMPONENTS)
def components_udf(values: pd.Series) -> pd.DataFrame:
    rows = []
    for v in values:
        p = parse(v) if v else None
        rows.append((p["number"], p["code"], p["state"], p["kind"], p["words"], json.dumps(p, sort_keys=True)) if p else (None,) * 6)
    return pd.DataFrame(rows, columns=COMPONENTS.names)


def parsed(addresses: DataFrame, column: str = "address") -> DataFrame:
    """(address, number, code, state, kind, words, form) of each distinct address that names a house or a box."""
    distinct = addresses.select(F.col(column).alias("address")).where("address is not null and address <> ''").distinct()
    return distinct.select("address", components_udf("address").alias("c")).select("address", "c.*").where("form is not null")


def one_left_out(word: str) -> F.Column:
    """The word and all its forms with one letter left out."""
    left_out = f"transform(sequence(1, char_length({word})), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1)))"
    return F.expr(f"array_distinct(array_append({left_out}, {word}))")


def containment_pairs(forms: DataFrame) -> DataFrame:
    """(a, b, relation) of distinct forms, a < b, that are alike or contained in each other."""
    word = F.transform("words", lambda w: F.struct(F.concat_ws("|", F.lit("w"), "number").alias("tag"), w.alias("text")))
    code = F.when(F.col("code").isNotNull(), F.array(F.struct(F.concat_ws("|", F.lit("c"), "number").alias("tag"), F.col("code").alias("text")))).otherwise(F.slice(word, 1, 0))
    tokens = forms.select("form", F.explode(F.array_distinct(F.concat(word, code))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token").groupBy("form").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, INDEXED).alias("rarest"))

    def keys(df: DataFrame) -> DataFrame:
        texts = F.when(F.startswith("token.tag", F.lit("w")), one_left_out("token.text")).otherwise(F.array("token.text"))
        return df.select("form", "token", F.explode(texts).alias("text")).select("form", F.xxhash64("token.tag", "text").alias("key"))

    index = keys(ranked.select("form", F.explode("rarest.token").alias("token"))).withColumnRenamed("form", "indexed")
    pairs = index.join(keys(tokens), "key").where("indexed <> form").select(F.least("indexed", "form").alias("a"), F.greatest("indexed", "form").alias("b")).distinct()

    # a word weighs the more, the fewer addresses have it
    words = forms.select("form", F.explode(F.array_distinct("words")).alias("word"))
    total = forms.count()
    weight = words.groupBy("word").agg(F.count("*").alias("n")).select("word", F.log(1 + total / F.col("n")).alias("w"))
    weights = words.join(weight, "word").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("weights"))

    @F.pandas_udf(T.StringType())
    def related(a: pd.Series, b: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.Series:
        load = lru_cache(maxsize=20_000)(json.loads)
        return pd.Series([relation(load(x), load(y), dict(u or ()) | dict(v or ())) for x, y, u, v in zip(a, b, wa, wb, strict=True)], dtype=object)

    agree = " and ".join(f"coalesce(get_json_object(a, '$.{p}') = get_json_object(b, '$.{p}'), true)" for p in ("number", "code", "state", "kind"))
    weighed = (
        pairs.where(agree)
        .join(weights.select(F.col("form").alias("a"), F.col("weights").alias("wa")), "a", "left")
        .join(weights.select(F.col("form").alias("b"), F.col("weights").alias("wb")), "b", "left")
    )
    return weighed.select("a", "b", related("a", "b", "wa", "wb").alias("relation")).where("relation <> ''")


def locations(addresses: DataFrame, column: str = "address") -> DataFrame:
    """(address, location): each distinct address string with the location it denotes.

    Null and empty addresses and those without a house number or post-office box (a town alone) denote no
    location and are left out. Repeated rows count once. An address whose left-out parts fit several locations
    stays one of its own. An empty table gives an empty table.
    """
    known = cut(parsed(addresses, column))
    forms = known.select("form", "number", "code", "words").distinct()
    pairs = cut(containment_pairs(forms))
    alike = components(pairs.where("relation = 'same'"))
    core = forms.select("form").join(alike, F.col("form") == F.col("node"), "left").select("form", F.coalesce("component", "form").alias("core"))
    core = cut(core)
    inside = pairs.where("relation <> 'same'").select(F.expr("if(relation = 'in', a, b)").alias("small"), F.expr("if(relation = 'in', b, a)").alias("big"))
    inside = (
        inside.join(core.withColumnsRenamed({"form": "small", "core": "part"}), "small")
        .join(core.withColumnsRenamed({"form": "big", "core": "whole"}), "big")
        .where("part <> whole")
        .select("part", "whole")
        .distinct()
    )
    inside = cut(inside)
    full = inside.join(inside.select(F.col("part").alias("whole")).distinct(), "whole", "left_anti")
    fits = full.groupBy("part").agg(F.count("*").alias("n"), F.min("whole").alias("whole")).where("n = 1").select("part", "whole")
    place = core.join(fits, core["core"] == fits["part"], "left").select("form", F.coalesce("whole", "core").alias("place"))
    return known.join(place, "form").select("address", F.sha2("place", 256).alias("location"))


def same_location(applications: DataFrame) -> DataFrame:
    """(address_a, address_b): all pairs of different strings, a < b, that denote the same location."""
    both = applications.select(F.explode(F.array("producer_address", "importer_address")).alias("address"))
    known = cut(locations(both))
    a, b = known.withColumnRenamed("address", "address_a"), known.withColumnRenamed("address", "address_b")
    return a.join(b, "location").where("address_a < address_b").select("address_a", "address_b")
