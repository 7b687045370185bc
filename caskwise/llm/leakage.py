"""Evaluation texts leaking into training text (problem 6).

Items and documents become shingles of words. The shingles of the items are counted over the whole
corpus and ordered by rarity; of every window of an item only the necessary prefix, its rarest
shingles, is joined with the documents, since a passage that misses all of them has lost more words
than allowed. Pairs within the length bound are verified exactly on the words of windows of the item's size.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.session import cut

#: Words in a shingle, least words in a passage, and words for each that may be changed.
SHINGLE, PASSAGE, PER_EDIT = 4, 15, 10
#: Item shingles up to this number are broadcast (32 bytes each); more are joined by shuffle.
BROADCAST_SHINGLES = 500_000
#: Ids of candidate documents up to this number are broadcast (8 bytes each).
BROADCAST_DOCUMENTS = 2_000_000

# Invisible characters, tags and entities, in Java and Python alike.
_GONE = r"[­​-‏⁠﻿]"
_MARKUP = r"<[/!?a-zA-Z][^<>]*+>|&(?:[a-zA-Z]{2,8}|#[0-9]{2,5});"


def clean(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, _GONE, ""), _MARKUP, " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(tokens: str) -> str:
    """SQL: hashes of all word shingles of an array of words."""
    return f"if(size({tokens}) < {SHINGLE}, array(), transform(sequence(0, size({tokens}) - {SHINGLE}), i -> xxhash64(array_join(slice({tokens}, i + 1, {SHINGLE}), ' '))))"


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, pos, h) of every shingle of the items."""
    tokens = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), words(clean(F.col("text"))).alias("tokens"))
    return tokens.select("item_id", F.posexplode(F.expr(shingles("tokens"))).alias("pos", "h"))


def necessary_prefixes(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, h): for every window of an item the rarest shingles of which a passage there keeps at least one."""
    ranked = wanted.join(counts, "h", "left").select("item_id", "pos", "h", F.coalesce("n", F.lit(0)).alias("n"))

    def prefix(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values(["n", "h"]).reset_index(drop=True)
        rank = dict(zip(order["pos"], order.index, strict=True))
        size, keep = len(part), set()
        # a passage of twice the length has a half that is a passage itself, so longer windows need no prefix of their own
        for length in range(min(PASSAGE, size + SHINGLE - 1), min(size + SHINGLE, 2 * PASSAGE)):
            inside = length - SHINGLE + 1
            take = min(inside, SHINGLE * (length // PER_EDIT) + 1)
            for start in range(size - inside + 1):
                keep.update(sorted(range(start, start + inside), key=rank.__getitem__)[:take])
        return part[part["pos"].isin(keep)][["item_id", "h"]].drop_duplicates()

    return ranked.groupBy("item_id").applyInPandas(prefix, "item_id bigint, h bigint")


#: A line break within a word: with or without a hyphen, marks of quoting may open the next line.
_PY_BREAK = re.compile(r"[-‐]?[ \t]*\r?\n[>| \t]*")
_PY_GONE, _PY_MARKUP = re.compile(_GONE), re.compile(_MARKUP)
_PY_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=64)
def _tokens(text: str) -> tuple[list[str], set[int]]:
    """Words of a text; positions of words that only a line break parts from the next."""
    text = _PY_MARKUP.sub(" ", _PY_GONE.sub("", text)).lower()
    found = list(_PY_WORD.finditer(text))
    broken = {k for k, (a, b) in enumerate(zip(found, found[1:], strict=False)) if _PY_BREAK.fullmatch(text, a.end(), b.start())}
    return [m.group() for m in found], broken


@lru_cache(maxsize=5_000)
def _item_words(item: str) -> list[str]:
    return _tokens.__wrapped__(item)[0]


def joined_shingles(text: str) -> list[str]:
    """Shingles in which at least one line break joins two words, each break of a shingle read both ways, as `holds_passage` reads them."""
    raw, broken = _tokens(text)
    found = set()
    for start in {i for k in broken for i in range(max(0, k - 2 * SHINGLE + 1), k + 1)}:
        open_ends: list[tuple[int, tuple[str, ...], bool]] = [(start, (), False)]
        while open_ends:
            at, read, joined = open_ends.pop()
            if len(read) == SHINGLE:
                if joined:
                    found.add(" ".join(read))
                continue
            if at < len(raw):
                open_ends.append((at + 1, (*read, raw[at]), joined))
            if at in broken:
                open_ends.append((at + 2, (*read, raw[at] + raw[at + 1]), True))
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def joined_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([joined_shingles(t) if t else [] for t in texts], dtype=object)


def document_hits(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, h): distinct shingles of each document that occur in an item, every line break read both as a blank and as nothing."""
    tokens = documents.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), words(clean(F.col("text"))).alias("a"), joined_udf(F.when(F.col("text").contains("\n"), F.col("text"))).alias("b")
    )
    found = tokens.select("doc_id", F.explode(F.array_union(F.expr(shingles("a")), F.expr("transform(b, x -> xxhash64(x))"))).alias("h"))
    hashes = wanted.select("h").distinct()
    return found.join(F.broadcast(hashes) if hashes.count() <= BROADCAST_SHINGLES else hashes, "h", "left_semi")


def holds_passage(text: str, item: str) -> bool:
    """Whether `text` holds PASSAGE or more words of `item` in their order, at most one in PER_EDIT changed, added or missing."""
    (raw, broken), wanted = _tokens(text), _item_words(item)
    known = set(wanted)
    doc, k = [], 0
    while k < len(raw):
        if k in broken and raw[k] + raw[k + 1] in known and not (raw[k] in known and raw[k + 1] in known):
            doc.append(raw[k] + raw[k + 1])
            k += 2
        else:
            doc.append(raw[k])
            k += 1
    at: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        if w in known:
            at.setdefault(w, []).append(j)
    # maximal runs of equal words
    runs = []
    for i, w in enumerate(wanted):
        for j in at.get(w, ()):
            if i and j and wanted[i - 1] == doc[j - 1]:
                continue
            n = 1
            while i + n < len(wanted) and j + n < len(doc) and wanted[i + n] == doc[j + n]:
                n += 1
            runs.append((i, j, n))
    runs.sort(key=lambda r: (r[1], r[0]))
    gap = max(2, len(wanted) // PER_EDIT + 1)
    # chains (start in item, start in document, edits), the best of each start, for every run
    chains: list[list[tuple[int, int, int]]] = []
    for r, (i, j, n) in enumerate(runs):
        best = {i: (i, j, 0)}
        for q in range(r - 1, -1, -1):
            pi, pj, pn = runs[q]
            if j - pj > len(wanted) + gap:
                break
            over = max(0, pi + pn - i, pj + pn - j)  # runs may overlap by a repeated word
            if pi >= i or pj >= j or over >= min(n, pn):
                continue
            cost = max(i - (pi + pn - over), j - (pj + pn - over))
            if cost > gap:
                continue
            for s, sj, e in chains[q]:
                if e + cost <= len(wanted) // PER_EDIT and (s not in best or best[s][2] > e + cost):
                    best[s] = (s, sj, e + cost)
        chains.append(list(best.values()))
        for s, sj, e in best.values():
            length = i + n - s
            room = min(s, sj) + min(len(wanted) - i - n, len(doc) - j - n)  # words before and behind may be changed ones
            for extra in range(room + 1):
                if e + extra > (length + extra) // PER_EDIT:
                    break
                if length + extra >= PASSAGE:
                    return True
    return False


@F.pandas_udf(T.BooleanType())
def holds_udf(texts: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([holds_passage(t, i) for t, i in zip(texts, items, strict=True)], dtype=bool)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an evaluation item.

    Null texts and ids and items shorter than a passage match nothing. Every copy of a document is
    reported under its own id, repeated rows of one id once. Whole texts are read, whatever their
    length; an empty table on either side gives an empty table.
    """
    wanted = cut(item_shingles(items))
    hits = cut(document_hits(documents, wanted))
    prefixes = necessary_prefixes(wanted, hits.groupBy("h").agg(F.count("*").alias("n")))
    pairs = hits.join(prefixes, "h").select("doc_id", "item_id").distinct()
    # length bound: of the shortest passage's shingles so many stay whatever words are changed; only shingles of pairs that met are counted
    least = PASSAGE - SHINGLE + 1 - SHINGLE * (PASSAGE // PER_EDIT)
    met = cut(pairs)
    of_pair = met.join(wanted, "item_id").join(hits, ["doc_id", "h"], "left_semi")
    enough = of_pair.groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("n")).where(F.col("n") >= least)
    candidates = cut(enough.select("doc_id", "item_id"))
    texts = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item"))
    # only texts of candidates are shuffled: their ids are sent to the scan up to BROADCAST_DOCUMENTS of them
    return near(texts, candidates).join(candidates, "doc_id").join(pieces, "item_id").where(holds_udf("text", "item")).select("doc_id", "item_id").distinct()


def near(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of `texts` whose doc_id is among `candidates`; beyond the bound of a broadcast the engine chooses the join."""
    ids = candidates.select("doc_id").distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_DOCUMENTS else ids, "doc_id", "left_semi")
