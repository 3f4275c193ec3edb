"""Sharding: a Feistel permutation with cycle walking over global row numbers. Native.

Rows get their rank in (order columns) order: one range exchange, sorted inside its partitions, and
the partitions' counts summed up. The rank r of n rows is permuted inside [0, n) by a Feistel network over
pairs (r div b, r mod b) with b about sqrt(n); values that fall on n or above walk the cycle again. Shard and slot
are then p mod k and p div k, so that anyone who knows n, the seed and a rank can compute both.

Null order values come first; rows equal in every order column are interchangeable; an empty table gives an empty result;
other columns pass through, own columns named like results as <name>_input.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import make_room, materialize

ROUNDS = 6
PRIME = (1 << 31) - 1
#: A cycle leaves [0, n) at most a*b - n < sqrt(n) + 1 times in a row: below 4,000 rows WALK is a proven
#: bound, above it the chance of a longer walk is under n**-32, and then the query raises an error.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [tuple(rng.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, a: int, b: int, keys) -> Column:
    """One pass through the rounds; each round is a struct step so that no expression is repeated."""
    state = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    rounds = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), *[F.lit(k).cast("long").alias(c) for k, c in zip(key, "uvw")]) for i, key in enumerate(keys)])

    def step(s, k):
        y = F.when(k["left"], s["r"]).otherwise(s["l"]) % F.lit(PRIME)
        f = (((y * k["u"] + k["v"]) % F.lit(PRIME)) * ((y + k["w"]) % F.lit(PRIME))) % F.lit(PRIME)
        return F.struct(F.when(k["left"], (s["l"] + f) % F.lit(a)).otherwise(s["l"]).alias("l"), F.when(k["left"], s["r"]).otherwise((s["r"] + f) % F.lit(b)).alias("r"))

    return F.aggregate(rounds, state, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(rank: Column, n: int, seed: int) -> Column:
    """The rank's place after the shuffle, as a native expression."""
    a, b = sides(n)
    keys = round_keys(seed)
    first = _network(rank, a, b, keys)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda p, _: F.when(p >= F.lit(n), _network(p, a, b, keys)).otherwise(p))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk too long; choose another seed")).cast("long"))


def ranked(df: DataFrame, order: list[str], rank: str = "row_no") -> tuple[DataFrame, int]:
    """Dense 0-based row numbers in the order given, without a window over all rows; and the number of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each partition
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    out = out.withColumn(rank, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")
    return out, placed.count()


def shard(df: DataFrame, shards: int, order: list[str], seed: int = 20) -> DataFrame:
    """Adds row_no, position, shard and slot. Shard sizes differ by one row at most; slots have no gap."""
    df, named = make_room(df, "row_no", "position", "shard", "slot", "__at", "__part", "__start")
    out, n = ranked(df, [named(c) for c in order])
    position = permuted(F.col("row_no"), n, seed) if n else F.col("row_no")
    out = out.withColumn("position", position)
    return out.withColumn("shard", (F.col("position") % F.lit(shards)).cast("int")).withColumn("slot", ((F.col("position") - F.col("position") % F.lit(shards)) / F.lit(shards)).cast("long"))


def locate(rank: int, n: int, shards: int, seed: int = 20) -> tuple[int, int]:
    """Shard and slot of one row number, computed without data."""
    a, b = sides(n)
    keys = round_keys(seed)
    p = rank
    while True:
        left, right = divmod(p, b)
        for i, (u, v, w) in enumerate(keys):
            y = (right if i % 2 == 0 else left) % PRIME
            f = ((y * u + v) % PRIME) * ((y + w) % PRIME) % PRIME
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        p = left * b + right
        if p < n:
            return p % shards, p // shards
