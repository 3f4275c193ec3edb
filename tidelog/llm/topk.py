"""Exact top-k search by inner product over a pivot-distance index.

Largest inner product becomes nearest neighbour by one more coordinate: with M the largest squared norm, a vector x gets
sqrt(M - |x|^2) and a query 0, so that the squared distance is |q|^2 + M - 2<q, x>. Vectors are keyed by their
nearest pivot and their distance from it, sorted by that key and cut into annulus blocks of at most BLOCK vectors: a hot
pivot or many equal vectors only make more blocks.

A query searches outwards in rounds, and every round's k-th score bounds its distance for the next: first the block that it lies in, then
for its NEAREST pivots the annulus at its own distance, then the rest, of which the triangle inequality rules out pivots by their range of
distances, annuli by theirs, and the vectors of an annulus by their own.

Pivots are fitted on a bounded sample (SAMPLE vectors); every vector is indexed. Scores are exact integers: sums that doubles
cannot hold are made in Python's integers, and those beyond a long count as its ends. So the only rounding is in the bounds, which are widened by SLACK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS, SAMPLE, ROUNDS, BLOCK = 32, 4_096, 5, 1_024
NEAREST, QUERIES_AT_ONCE = 3, 4_096
#: Share of the vectors' length by which distances are taken to be uncertain.
SLACK = 1e-6
_LONG = (1 << 63) - 1
INDEX = "block string, pivot int, dist double, vec_id long, extra double, v array<double>, asks boolean"
HITS = "query_id long, vec_id long, score long"


def _floor(x):
    """As a double; from 2**52 on doubles have no fractions."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def quantized(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """Rows (vec_id, v): floor(scale * x) as doubles. Null vectors and those with null or non-finite parts are left out."""
    whole = F.col(column)
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col(key).isNotNull() & whole.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    asks = F.col("__asks") if "__asks" in vectors.columns else F.lit(False)
    return kept.select(F.col(key).cast("long").alias("vec_id"), asks.alias("asks"), F.transform(whole, lambda x: _floor(x.cast("double") * F.lit(float(scale)))).alias("v")).where(
        F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))
    )


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """A few rounds of k-means over the sample; deterministic."""
    rng = np.random.default_rng(5)
    centres = sample[np.sort(rng.choice(len(sample), size=min(pivots, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        near = np.argmin(distances(sample, centres), axis=1)
        centres = np.stack([sample[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as exact integers, in doubles where these hold them."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if most < 1 << 53:
        return queries @ vectors.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries) @ whole(vectors).T


def best(query_ids, queries, ids, vectors, k: int) -> tuple[list, list, list]:
    """Each query's k best rows of this block, ties to the smaller id; the query's own id is no candidate."""
    scores = products(queries, vectors)
    out = ([], [], [])
    for r in range(len(query_ids)):
        other = np.flatnonzero(ids != query_ids[r])
        own = scores[r, other]
        if len(own) > k and own.dtype != object:
            least = np.partition(own, -k)[-k]
            other, own = other[own >= least], own[own >= least]
        longs = [min(max(int(x), -_LONG - 1), _LONG) for x in own]
        top = sorted(zip(longs, ids[other].tolist()), key=lambda x: (-x[0], x[1]))[:k]
        out[0].extend([query_ids[r]] * len(top))
        out[1].extend(i for _, i in top)
        out[2].extend(x for x, _ in top)
    return out


def build(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, float]:
    """The index table, the pivots (with the added coordinate) and M. rows: (vec_id, asks, v) of one dimension."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = rows.agg(F.max(norm).alias("m")).first()["m"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in sample])
    x = np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]
    centres = fit_pivots(x, pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list())
                pdf["extra"] = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
                d = distances(np.c_[x, pdf["extra"]], centres)
                pdf["pivot"] = d.argmin(axis=1).astype(np.int32)
                pdf["dist"] = d.min(axis=1)
                yield pdf[["pivot", "dist", "vec_id", "extra", "v", "asks"]]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInPandas(place, "pivot int, dist double, vec_id long, extra double, v array<double>, asks boolean")
    placed = placed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    at = F.monotonically_increasing_id()
    block = F.concat_ws("/", F.shiftright(at, 33), F.shiftright(at.bitwiseAND(F.lit((1 << 33) - 1)), BLOCK.bit_length() - 1), F.col("pivot"))
    return materialize(placed.select(block.alias("block"), "pivot", "dist", "vec_id", "extra", "v", "asks"), "annuli"), centres, float(most)


def search(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of each row for which the Column `queries` holds.

    Vectors that are null or hold null or non-finite parts take no part, nor do those whose scaled parts are beyond a double. A query meets the
    vectors of its own dimension; each dimension is searched by itself. Fewer candidates give fewer rows; no vectors or no queries, none. Rows
    that repeat an id are candidates each, but never for a query of that id, and the query is asked once. The id must be a number; other
    columns are only read by `queries`.
    """
    asked = vectors.withColumn("__asks", F.coalesce(queries, F.lit(False)))
    rows = quantized(asked, key, column, scale)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for size in [r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.bool_or("asks").alias("any")).where("any and d > 0").orderBy("d").collect()]:  # a row for each dimension
        out = out.union(_search(rows.where(F.size("v") == size), k))
    return out


def _search(rows: DataFrame, k: int) -> DataFrame:
    index, centres, most = build(rows)

    def ranked(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # 1. the block that holds the query gives its first bound
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["v"].to_list()), pdf["vec_id"].to_numpy()
        ask = np.flatnonzero(pdf["asks"].to_numpy(bool))
        out = []
        for a in range(0, len(ask), QUERIES_AT_ONCE):
            part = ask[a : a + QUERIES_AT_ONCE]
            out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best(ids[part], x[part], ids, x, k)))))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    holding = index.where("asks").select("block").distinct()
    hits = materialize(index.join(holding, "block", "left_semi").groupBy("block").applyInPandas(own, HITS), "home")
    asked = materialize(index.where("asks").select(F.col("vec_id").alias("query_id"), "v", F.col("block").alias("own")).dropDuplicates(["query_id"]), "asked")

    annuli = index.groupBy("pivot", "block").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"))
    annuli = materialize(annuli, "rings")
    ranges = annuli.groupBy("pivot").agg(F.min("inner").alias("nearest"), F.max("outer").alias("farthest"))  # a row for each pivot

    def reach(batches: Iterator[pd.DataFrame], nearest: int) -> Iterator[pd.DataFrame]:
        """Each query with its nearest pivots, its distance from them and how far from it its k best can lie."""
        for pdf in batches:
            if len(pdf):
                q = np.stack(pdf["v"].to_list())
                squared = (q * q).sum(1) + most
                d = distances(np.c_[q, np.zeros(len(q))], centres)
                far = np.sqrt(np.maximum(squared - 2 * pdf["floor"].to_numpy(dtype=float), 0)) + SLACK * np.sqrt(squared) + SLACK
                far = np.where(np.isnan(far), np.inf, far)
                order = np.argsort(d, axis=1, kind="stable")[:, :nearest]
                for c in range(order.shape[1]):
                    away = d[np.arange(len(q)), order[:, c]]
                    yield pdf[["query_id", "own"]].assign(pivot=order[:, c].astype(np.int32), away=away, far=far)

    def pairs(hits: DataFrame, nearest: int) -> DataFrame:
        """Rows (query_id, own, pivot, block, away, far): the annuli that the bound admits."""
        bound = ranked(hits).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        bound = bound.select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
        known = asked.join(bound, "query_id", "left").select("query_id", "own", "v", "floor")
        spread = known.mapInPandas(lambda batches: reach(batches, nearest), "query_id long, own string, pivot int, away double, far double")
        near = spread.join(F.broadcast(ranges), "pivot").where("away + far >= nearest and away - far <= farthest")
        return near.join(annuli, "pivot").where("away + far >= inner and away - far <= outer and block != own")

    # 2. and 3. queries meet annuli; a block that many ask is met in parts of QUERIES_AT_ONCE queries
    def meet(found: DataFrame, name: str) -> DataFrame:
        found = materialize(found.select("query_id", "block", "away", "far"), f"{name}-pairs")
        parts = found.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERIES_AT_ONCE)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
        left = found.join(parts, "block").withColumn("part", part).join(asked.select("query_id", "v"), "query_id").drop("parts")
        right = index.select("block", "vec_id", "v", "dist").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            if not len(qs) or not len(xs):
                return none
            dist = xs["dist"].to_numpy()
            xs = xs[(dist >= (qs["away"] - qs["far"]).min()) & (dist <= (qs["away"] + qs["far"]).max())]
            if not len(xs):
                return none
            ids, x, out = xs["vec_id"].to_numpy(), np.stack(xs["v"].to_list()), []
            for a in range(0, len(qs), QUERIES_AT_ONCE):
                some = qs.iloc[a : a + QUERIES_AT_ONCE]
                out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best(some["query_id"].to_numpy(), np.stack(some["v"].to_list()), ids, x, k)))))
            return pd.concat(out).astype("int64")

        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, HITS)

    gap = F.greatest(F.col("inner") - F.col("away"), F.col("away") - F.col("outer"), F.lit(0.0))
    columns = F.struct("own", "away", "far")
    at = pairs(hits, NEAREST).groupBy("query_id", "pivot").agg(F.min_by(F.struct("block", columns.alias("x")), F.struct(gap, F.col("block"))).alias("b"))
    at = materialize(at.select("query_id", "b.block", "b.x.away", "b.x.far"), "start")
    hits = materialize(hits.union(meet(at, "near")), "nearer")
    rest = pairs(hits, len(centres)).join(at.select("query_id", "block"), ["query_id", "block"], "left_anti")
    return ranked(hits.union(meet(rest, "rest"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
