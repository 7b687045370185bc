"""Mixing sources to target weights (problem 7).

The largest mix is made in which every source has its share and no document is used more often than its
source allows: whole passes over a source, and one partial pass over its first documents in hashed order, as
running sums over hash buckets tell. The copies of a source in that order are cut into blocks of equal
numbers; a splitting tree divides each source's exact number of blocks among the shards by multivariate
hypergeometric draws, every shard draws its own range of permuted blocks and is shuffled locally.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Sources in the weights table; more are refused, as their totals are held on the driver.
MOST_SOURCES = 10_000
#: Documents that one bucket of the running sums holds, about, and copies in a block of the output.
BUCKET, BLOCK = 50_000, 16
#: Numbers up to which the library draws exactly; beyond them a draw is normal, clipped to what is possible.
EXACT = 500_000_000
#: Quotas (sources x shards) up to which they are broadcast.
BROADCAST_QUOTAS = 1_000_000

# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def with_tokens(spark: SparkSession, df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """Add `out`, the number of tokens of column `text`; null texts have 0. The vocabulary file is read on the driver and broadcast."""
    ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def plan(totals: dict[str, int], weights: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int]]:
    """{source: (whole passes, tokens of the partial pass)} of the largest mix that the caps allow.

    Sources without documents, share or permitted use take no part; the shares of the others keep
    their proportions.
    """
    usable = {s: w for s, w in weights.items() if w[0] and w[0] > 0 and w[1] and w[1] > 0 and totals.get(s, 0) > 0}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    size = min(totals[s] * cap * whole / share for s, (share, cap) in usable.items())
    out = {}
    for s, (share, cap) in usable.items():
        quota = min(round(size * share / whole), totals[s] * cap)
        out[s] = divmod(quota, totals[s])
    return out


def mixed(spark: SparkSession, documents: DataFrame, weights: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, target_share, reached_share, rank, in_pass) of every chosen document.

    `rank` is its place from 0 in the hashed order of its source and `in_pass` the documents of one pass over the source.
    Documents whose source is null or not listed, and texts without tokens, take no part. A repeated row
    of a document is a document of its own. Empty tables give an
    empty result. A source whose share exceeds what its documents may be repeated bounds the size of the mix.
    """
    rows = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = {r["source"]: (r["share"], r["cap"]) for r in rows}
    listed = spark.createDataFrame([(s,) for s in wanted], "source string")
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where("doc_id is not null").join(F.broadcast(listed), "source", "left_semi")
    order = F.xxhash64(F.lit(seed), "doc_id")
    counted = cut(with_tokens(spark, base, tokenizer=tokenizer).where("n_tokens > 0").select("doc_id", "source", "n_tokens", order.alias("h")))
    sums = {r["source"]: (r["n"], r["docs"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    passes = plan({s: n for s, (n, _) in sums.items()}, wanted)
    placed = running(counted, max((d for _, d in sums.values()), default=0))
    quotas = spark.createDataFrame([(s, n, rest, sums[s][1]) for s, (n, rest) in passes.items()], "source string, passes bigint, rest bigint, in_pass bigint")
    # of the partial pass the last document is in if more than half of it fits
    once_more = F.when(2 * F.col("before") + F.col("n_tokens") <= 2 * F.col("rest"), 1).otherwise(0)
    chosen = placed.join(F.broadcast(quotas), "source").withColumn("repeats", F.col("passes") + once_more).where("repeats > 0")
    chosen = cut(chosen.select("doc_id", "source", "n_tokens", "repeats", "rank", "in_pass"))
    reached = {r["source"]: r["n"] for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    size = sum(reached.values()) or 1
    report = spark.createDataFrame([(s, float(w[0] or 0), reached.get(s, 0) / size) for s, w in wanted.items()], "source string, target_share double, reached_share double")
    return chosen.join(F.broadcast(report), "source").select("doc_id", "source", "n_tokens", "repeats", "target_share", "reached_share", "rank", "in_pass")


def running(counted: DataFrame, most: int, bucket: int = BUCKET) -> DataFrame:
    """Add `rank` and `before` to (doc_id, source, n_tokens, h): documents and tokens of the same source that come before in the order of h.

    The sums of hash buckets are added up first, then the documents within each bucket, so a source of any size
    is spread over as many tasks as it has buckets of about `bucket` documents; `most` is the size of the largest source.
    """
    bits = min(24, max(0, -(-most // bucket) - 1).bit_length())
    slot = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    rows = counted.withColumn("bucket", slot)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = sums.select("source", "bucket", zero("docs", earlier).alias("docs"), zero("tokens", earlier).alias("tokens"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("d", zero(F.lit(1), within)).withColumn("t", zero("n_tokens", within))
    return inside.join(starts, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("docs") + F.col("d")).alias("rank"), (F.col("tokens") + F.col("t")).alias("before"))


def shares(spark: SparkSession, mix: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, reached_share) of every listed source, 0 for those without documents."""
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("reached_share").alias("reached_share"))
    listed = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    return listed.join(used, "source", "left").select("source", "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "reached_share")))


def _draw(rng: np.random.Generator, colours: np.ndarray, take: int) -> np.ndarray:
    """How many of each colour are among `take` balls drawn from all."""
    if int(colours.sum()) <= EXACT:
        return rng.multivariate_hypergeometric(colours, take, method="marginals")
    out, left, need = np.zeros_like(colours), int(colours.sum()), take
    for k, n in enumerate(map(int, colours)):
        if left <= EXACT:
            x = int(rng.hypergeometric(n, left - n, need)) if need else 0
        else:
            mean, spread = need * n / left, need * (n / left) * (1 - n / left) * ((left - need) / (left - 1))
            x = round(rng.normal(mean, max(0.0, spread) ** 0.5))
        out[k] = x = min(max(x, need - (left - n), 0), n, need)
        left, need = left - n, need - x
    return out


def split_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact, disjoint, each shard of equal size up to one block."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)

    def split(first: int, last: int, colours: np.ndarray) -> None:
        if last - first == 1:
            out[first] = colours
            return
        middle = (first + last) // 2
        take = int(colours.sum()) * (middle - first) // (last - first)
        draw = _draw(np.random.default_rng([seed, first, last]), colours, take)
        split(first, middle, draw)
        split(middle, last, colours - draw)

    if shards > 0:
        split(0, shards, np.asarray(blocks, dtype=np.int64))
    return out


def drawn(spark: SparkSession, mix: DataFrame, shards: int = 16, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Add `shards`, an array with the shard of each copy of a document of the mix.

    Copy k of a document is number k * in_pass + rank of its source; `block` numbers in a row are a block, so a source has exactly
    ceil(copies / block) blocks. The splitting tree says how many of them each shard gets, and the shards draw them in turn in the order of an affine permutation.
    """
    copies = {r["source"]: r["n"] for r in mix.groupBy("source").agg(F.sum("repeats").alias("n")).collect()}
    names = sorted(copies)
    sizes = [-(-copies[s] // block) for s in names]
    counts = split_tree(sizes, shards, seed)
    rows = []
    for k, (s, n) in enumerate(zip(names, sizes, strict=True)):
        stride = next(x for x in range(max(1, int(n * 0.618)), 2 * n + 2) if np.gcd(x, n) == 1)
        rows.append((s, n, int(stride), [int(x) for x in np.cumsum(counts[:, k])]))
    quotas = spark.createDataFrame(rows, "source string, blocks bigint, stride bigint, ends array<bigint>")
    quotas = F.broadcast(quotas) if len(rows) * shards <= BROADCAST_QUOTAS else quotas
    # the product may pass 64 bits, so it is taken as a decimal
    place = f"cast(pmod(cast((k * in_pass + rank) div {block} as decimal(19,0)) * stride, cast(blocks as decimal(19,0))) as bigint)"
    shard = f"transform(sequence(0L, repeats - 1), k -> size(filter(ends, e -> e <= {place})))"
    return mix.join(quotas, "source").withColumn("shards", F.expr(shard)).drop("blocks", "stride", "ends")


def sharded(spark: SparkSession, mix: DataFrame, shards: int = 16, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(shard, slot, doc_id, copy, source): every copy of the mix in the shard that draws it, in shuffled order within it."""
    copies = drawn(spark, mix, shards, seed, block).select("doc_id", "source", "rank", F.posexplode("shards").alias("copy", "shard"))
    placed = copies.select("shard", F.xxhash64(F.lit(seed), F.lit("slot"), "doc_id", "rank", "copy").alias("slot"), "doc_id", (F.col("copy") + 1).alias("copy"), "source")
    return placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
