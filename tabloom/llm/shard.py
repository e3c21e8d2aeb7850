"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, checksum, size).  A Feistel
network over pairs (l, r) of an a x b grid, a*b just above N, permutes the
numbers; values of N and above are sent through it again (cycle walking) until
they fall below N.  ``shard = p % shards`` and ``slot = p div shards``: counts
differ by one at most, slots are gapless, and both are computable from the row
number, N and the seed alone.

Only (doc_id, size, checksum) is shuffled, once, by a range sort; the numbers
come from each row's place in its sorted partition plus the sizes of the
partitions before it (a table with one row per partition).  Expressions only.

Null texts have size 8 and the checksum of no bytes; null doc_ids come first;
rows equal in all three columns are interchangeable, so the result is the same
in every run.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written

SHARDS = 24
SEED = 20240601
ROUNDS = 6
MAX_WALK = 64


def feistel(x: Column, a: int, b: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..a*b-1: x = l * b + r; halves take turns to be shifted by a hash of the other."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(h, k):
        even = F.pmod(h["l"] + F.pmod(_mixed(h["r"], k, seed), F.lit(a)), F.lit(a))
        odd = F.pmod(h["r"] + F.pmod(_mixed(h["l"], k, seed), F.lit(b)), F.lit(b))
        return F.struct(F.when(k % 2 == 0, even).otherwise(h["l"]).cast("long").alias("l"),
                        F.when(k % 2 == 1, odd).otherwise(h["r"]).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda h: h["l"] * F.lit(b) + h["r"])


def _mixed(half: Column, k: Column, seed: int) -> Column:
    """Round function: 60 bits of the MD5 of seed, round and half."""
    text = F.concat_ws(":", F.lit(str(seed)), k.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """Place of row number x in the shuffled order of n rows.

    The grid has fewer than a = ceil(sqrt n) surplus cells, so a walk ends within
    surplus + 1 steps.  Above MAX_WALK steps (n > 4096, one cell in 64 or fewer
    is surplus) the chance of a longer walk is below 64^-64; it would raise, not drop.
    """
    a, b = grid(n)
    walk = min(a * b - n + 1, MAX_WALK)
    first = feistel(x, a, b, seed)
    if walk == 1:
        return first
    place = F.aggregate(F.sequence(F.lit(2), F.lit(walk)), first,
                        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)))
    return F.transform(F.array(place), lambda p: F.when(p < n, p).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long")))[0]


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a gapless global ``row`` number in the order of ``order``, and their count.

    ``rows`` should be narrow: it is written, sorted and written again.
    """
    place = written(written(rows, "rows").orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    # the id holds the sorted partition above bit 33 and the place in it below
    part = F.shiftrightunsigned("__at", 33)
    sizes = place.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = written(sizes.select("__part", "__n", F.expr(
        "coalesce(sum(__n) over (order by __part rows between unbounded preceding and 1 preceding), 0)")
        .alias("__before")), "offsets")
    n = offsets.agg(F.sum("__n")).first()[0] or 0
    # one row per sorted partition: bounded by spark.sql.shuffle.partitions
    out = place.withColumn("__part", part).join(F.broadcast(offsets.drop("__n")), "__part") \
        .withColumn("row", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("__part", "__before", "__at"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])
    return rows.withColumn("__p", permuted(F.col("row"), n, seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("__p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
