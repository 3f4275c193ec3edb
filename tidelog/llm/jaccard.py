"""N-gram Jaccard join with multiple-global-order filtering.

A document is the set of its word n-grams (64-bit hashes). Documents of one set (by two hashes of it) form a class, and classes are
joined. If two sets reach the similarity, then under any global order of the tokens their prefixes share a token. Three orders
are used: A puts rare tokens first (counted over the whole corpus; ties by hash), B and C are independent hash
orders. Candidates come from a join on A's prefix tokens with the sizes' bound; A's prefixes are lengthened so that partners must share
several of their tokens, and the prefixes under B and C must also meet before a pair is verified on the whole sets.

Large groups of near copies stay linear, for a candidate needs not only a common token:

1. Each class first meets the class of a token and size window that has the fewest tokens of its own, its leader, and what is verified is merged.
2. Two followers of one leader differ from it by known tokens, their deltas. If neither the leader nor a chain of links joins them,
   they can only be similar if their deltas overlap by a known number of tokens; so they meet on prefixes of the deltas.
3. Classes of different leaders and components meet on A's prefix tokens. Groups of equal leader and component are
   joined as one row each, and their members follow only where two groups meet.

Every link between different texts is thus verified or lies inside a component already proven.

Results for odd input: null or empty texts have no set and link with nothing; texts shorter than an n-gram are one
whole sequence; rows with a null id are classed but not linked; repeated rows share a class, and so do rows of one id with equal sets.
The id must be a number. No other column is read, so that names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, only_passing, passing, small, powers, prefix_hashes, span_hashes, text_bytes, text_chunks
from .sketch import bucket_bits, passes, repeated_filter

#: Tokens are counted COUNTED_AT_ONCE at a time; those of COMMON documents or more there are summed up, and the commonest HEAVY
#: of them stand last in order A (the table that is broadcast, 1.6 MB at most). Which tokens these are decides about speed alone.
COMMON, COUNTED_AT_ONCE, HEAVY = 3, 2_000_000, 100_000
#: Order A's prefixes are so long that partners share several tokens in them (or all that they must share, if those are fewer): one, and one
#: more for each EACH of a set's tokens, up to SHARED. What two of different sizes share is what the smaller number says.
SHARED, EACH = 8, 80
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes that are no white space; a text's edge ends a word."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    return np.flatnonzero(solid & (~before | edge[:n])), np.flatnonzero(solid & (~after | edge[1:])) + 1


class Sets:
    """The n-gram sets of a batch: `of` (row) and `token`, sorted by both, without repeats; `size` and two set hashes by row."""

    def __init__(self, array: pa.Array, width: int):
        data, offsets = text_bytes(array)
        rows = len(array)
        start, end = word_spans(data, offsets)
        word = span_hashes(prefix_hashes(_LOWER[data]), start, end)
        doc = np.searchsorted(offsets, start, side="right") - 1
        counts = np.bincount(doc, minlength=rows)
        ups, downs = powers(len(word) + 1)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(mix(word) * ups[: len(word)], out=sums[1:])
        begin = np.cumsum(counts) - counts
        # an n-gram starts at every word that has width - 1 more in its text, or at the only start of a short text
        last = (begin + np.maximum(counts - width, 0))[doc]
        at = np.flatnonzero(np.arange(len(word)) <= last)
        of = doc[at]
        length = np.minimum(counts[of], width)
        token = mix((sums[at + length] - sums[at]) * downs[at] + length.astype(np.uint64))
        order = np.lexsort((token, of))
        of, token = of[order], token[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (token[1:] != token[:-1])
        self.of, self.token = of[new], token[new]
        self.size = np.bincount(self.of, minlength=rows)
        self.first = np.cumsum(self.size) - self.size
        self.hashes = [self._sum(salt) for salt in (0x1F83D9AB, 0x5BE0CD19)]

    def _sum(self, salt: int) -> np.ndarray:
        sums = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(mix(self.token + np.uint64(salt)), out=sums[1:])
        return mix(sums[self.first + self.size] - sums[self.first] + self.size.astype(np.uint64)).view(np.int64)


class Threshold:
    """Similarity of num/den or more, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.least = -(-num // (den - num)) if den > num else 1 << 62  # smaller sets only link with equal ones

    def overlap(self, size):
        """Tokens that a set of this size must share with any partner, at least."""
        return -((-self.num * size) // self.den)

    def prefix(self, size: np.ndarray, shared: int | np.ndarray = 1) -> np.ndarray:
        """Length of the prefix in which it shares `shared` of them under any order (or all it must, if those are fewer)."""
        least = self.overlap(size)
        return size - least + np.minimum(shared, least)


def prefix_mask(sets: Sets, keys: tuple, length: np.ndarray) -> np.ndarray:
    """Indices of each row's first `length` tokens in the order of the keys (last key first)."""
    order = np.lexsort((*keys, sets.of))
    rank = np.arange(len(order)) - sets.first[sets.of]
    return order[rank < length[sets.of]]


def _names(sets: Sets) -> tuple[np.ndarray, pa.Array]:
    """Both set hashes of each row as 16 bytes: the class."""
    raw = np.ascontiguousarray(np.stack(sets.hashes, axis=1))
    ends = pa.py_buffer((np.arange(len(raw) + 1) * 16).astype(np.int32).tobytes())
    return raw, pa.Array.from_buffers(pa.binary(), len(raw), [None, ends, pa.py_buffer(raw.tobytes())])


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: a document's (id, class, size); kind 1: a token common in part of the text, with its number of documents there."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("s", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            often = count >= COMMON
            token, count = token[often].view(np.int64), count[often]
            return pa.record_batch([pa.array(np.ones(len(token), np.int8)), pa.array(token), pa.nulls(len(token), pa.binary()), pa.array(count.astype(np.int64))], schema=schema)

        for piece in text_chunks(batches):
            sets = Sets(piece.column("text"), width)
            rows = piece.num_rows
            yield pa.record_batch([pa.array(np.zeros(rows, np.int8)), piece.column("id"), _names(sets)[1], pa.array(sets.size.astype(np.int64))], schema=schema)
            held.append(sets.token)
            if sum(map(len, held)) >= COUNTED_AT_ONCE:
                yield common()
        yield common()

    return docs.mapInArrow(run, "kind byte, a long, s binary, n long")


def _prefixes(piece: pa.RecordBatch, seen: set, width: int, limit: Threshold, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[Sets, pa.Array, np.ndarray]:
    """The sets of a piece, their classes, and the indices of order A's prefix tokens of those that this task has not had yet."""
    common, often = heavy
    sets = Sets(piece.column("text"), width)
    fresh = np.zeros(piece.num_rows, bool)
    raw, names = _names(sets)
    for k in np.flatnonzero(sets.size >= limit.least).tolist():
        s = raw[k].tobytes()
        fresh[k] = s not in seen
        seen.add(s)
    if len(common):
        spot = np.minimum(np.searchsorted(common, sets.token), len(common) - 1)
        count = np.where(common[spot] == sets.token, often[spot], 0)
    else:
        count = np.zeros(len(sets.token), np.int64)
    return sets, names, prefix_mask(sets, (mix(sets.token), count), np.where(fresh, limit.prefix(sets.size, np.minimum(1 + sets.size // EACH, SHARED)), 0))


def _postings(docs: DataFrame, width: int, limit: Threshold, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (token, s, n): prefix tokens under order A that may come more than once, once for each task that holds one of the class's documents."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = docs.sparkSession.sparkContext.broadcast(heavy)

    def tokens(piece: pa.RecordBatch, seen: set) -> np.ndarray:
        sets, _, at = _prefixes(piece, seen, width, limit, table.value)
        return sets.token[at]

    words = repeated_filter(docs.select("text"), tokens, parts, 1 << 62)[0]
    bits, shared = bucket_bits(parts), docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("token", pa.int64()), ("s", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for piece in text_chunks(batches):
            sets, names, at = _prefixes(piece, seen, width, limit, table.value)
            at = at[passes(shared.value, sets.token[at], bits)]
            of = sets.of[at]
            yield pa.record_batch([pa.array(sets.token[at].view(np.int64)), names.take(pa.array(of)), pa.array(sets.size[of].astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "token long, s binary, n int").distinct()


def _linked(sizes: Column, apart: Column, limit: Threshold) -> Column:
    """Whether two sets of these sizes together, and so many tokens in one of them alone, reach the similarity."""
    same = (sizes - apart) / 2  # exact: halves of integers
    return same * limit.den >= F.lit(limit.num) * (sizes - same)


def _apart(a: str, b: str) -> Column:
    """Tokens of one of two sorted arrays alone: first a's, then b's, both in their order."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _both(of: np.ndarray, token: np.ndarray, other_of: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and tokens of two sides in order, without repeats; where each stands on the left (True) and whether it is on both sides."""
    row, all_ = np.concatenate([of, other_of]), np.concatenate([token, other])
    left = np.arange(len(row)) < len(of)
    order = np.lexsort((~left, all_, row))
    row, all_, left = row[order], all_[order], left[order]
    twice = np.zeros(len(row), bool)
    twice[:-1] = (row[1:] == row[:-1]) & (all_[1:] == all_[:-1])
    again = np.r_[False, twice[:-1]] if len(row) else twice
    return row[~again], all_[~again], left[~again], twice[~again]


def _verify(pairs: DataFrame, docs: DataFrame, of_class: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """Of distinct pairs (u, v), those that meet under orders B and C: with their sizes, `linked`, and `delta`, the tokens in one of the two sets alone.

    The texts travel, which are smaller than their sets. delta has first the tokens of u, then those of v, both in order.
    """
    named = pairs.join(of_class.select(F.col("s").alias("u"), F.col("id").alias("x")), "u").join(of_class.select(F.col("s").alias("v"), F.col("id").alias("y")), "v")
    named = materialize(named, "asked")
    known = docs.where("id is not null")
    left = passing(known, named.select(F.col("x").alias("id")), ["id"], "asked").where("asked").select(F.col("id").alias("x"), F.col("text").alias("ut"))
    right = passing(known, named.select(F.col("y").alias("id")), ["id"], "asked").where("asked").select(F.col("id").alias("y"), F.col("text").alias("vt"))
    met = left.join(small(named), "x").join(right, "y")
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("un", pa.int32()), ("vn", pa.int32()), ("delta", pa.list_(pa.int64())), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches, column="ut"):
            a, b = Sets(piece.column("ut"), width), Sets(piece.column("vt"), width)
            rows = piece.num_rows
            good = np.array([x == y and z == w for x, y, z, w in zip(piece.column("u").to_pylist(), _names(a)[1].to_pylist(), piece.column("v").to_pylist(), _names(b)[1].to_pylist())], bool)  # an id may come with other texts
            for salt in (0x6A09E667, 0xBB67AE85):  # orders B and C
                i, j = (prefix_mask(x, (mix(x.token + np.uint64(salt)),), np.minimum(limit.prefix(x.size), x.size)) for x in (a, b))
                row, _, _, twice = _both(a.of[i], a.token[i], b.of[j], b.token[j])
                good &= np.bincount(row[twice], minlength=rows) > 0
            row, token, left, twice = _both(a.of, a.token, b.of, b.token)
            same = np.bincount(row[twice], minlength=rows)
            alone = ~twice & good[row]
            row, token, left = row[alone], token[alone], left[alone]
            order = np.lexsort((token, ~left, row))
            keep = np.flatnonzero(good)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=rows)[keep])].astype(np.int32)
            linked = same * limit.den >= limit.num * (a.size + b.size - same)
            yield pa.record_batch([piece.column("u").take(pa.array(keep)), piece.column("v").take(pa.array(keep)), pa.array(a.size[keep].astype(np.int32)), pa.array(b.size[keep].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(token[order].view(np.int64))), pa.array(linked[keep])], schema=schema)

    found = met.select("u", "v", "ut", "vt").mapInArrow(run, "u binary, v binary, un int, vn int, delta array<long>, linked boolean")
    return found.dropDuplicates(["u", "v"])  # of repeated rows


def forest(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for edges (u, v), one for each u and without circles: pointers are doubled until nothing moves."""
    edges, before = materialize(edges.select("u", "v"), "forest"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        up = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        further = materialize(edges.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "forest")
        discard(edges)
        edges = further
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node that each node of the edges (u, v) reaches. Alternating large and small stars; each round is written out."""
    edges = edges.where("u != v")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        stars = materialize(small.distinct(), "stars")
        if before is not None:
            discard(edges)
        edges = stars
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "u") -> DataFrame:
    """rows with `root`, the node itself where it has none."""
    return rows.join(small(roots).withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def _across(rows: DataFrame, at: list[str], label: list[str], apart, fits) -> DataFrame:
    """Pairs (u, v, un, vn, shared, uo, vo) of rows that agree in the columns `at`, with labels of which `apart` holds.

    Labels meet first, one row for each; the rows of a label are only fetched for labels that meet another.
    """
    one = rows.select(*at, *label).distinct()
    x, y = one.select(*at, *[F.col(c).alias(f"x_{c}") for c in label]), one.select(*at, *[F.col(c).alias(f"y_{c}") for c in label])
    meeting = x.join(y, at).where(apart)
    u = rows.select(*at, *[F.col(c).alias(f"x_{c}") for c in label], "u", F.col("n").alias("un"), F.col("o").alias("uo"))
    v = rows.select(*at, *[F.col(c).alias(f"y_{c}") for c in label], F.col("u").alias("v"), F.col("n").alias("vn"), F.col("o").alias("vo"))
    met = meeting.join(u, [*at, *[f"x_{c}" for c in label]]).join(v, [*at, *[f"y_{c}" for c in label]]).where(fits)
    shared = met.groupBy("u", "v", "uo", "vo").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= F.least("uo", "vo")).select("u", "v")


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, class_id, component_id): a row for each of docs.

    class_id is shared by documents of equal sets, component_id the smallest id that links reach. For documents
    without a set class_id is null.
    """
    limit = Threshold(num, den)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    scanned = materialize(_scan(docs, width), "sets")
    classes = scanned.where("kind = 0").select(F.col("a").alias("id"), "s", "n")
    top = scanned.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HEAVY).toArrow()  # rows of Python objects would be many times as large
    heavy = top.column("a").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(heavy[0])

    # one document stands for its class. A row is left out if it passes the filter of the other documents and not that of the rows that pass it by mistake
    of_class = classes.where(F.col("n") >= limit.least).groupBy("s").agg(F.min("id").alias("id")).where("id is not null")
    of_class = materialize(of_class, "classes")
    others = classes.where("id is not null").join(of_class, ["s", "id"], "left_anti").select("id")
    mistaken = passing(of_class, others, ["id"], "maybe").where("maybe")
    flagged = passing(passing(docs, others, ["id"], "maybe"), mistaken, ["id"], "mistaken")
    postings = _postings(flagged.where("id is not null and (not maybe or mistaken)").select("id", "text"), width, limit, (heavy[0][order], heavy[1][order]))

    # every token in two windows of sizes: sets that differ by less than the threshold have one in common, and count it where it is the larger's band
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    least = F.expr(f"least(cast(ceil({num} * n / {den}) as int), 1 + n div {EACH}, {SHARED})").cast("int")  # what a set's prefix shares with any partner's
    windows = postings.select("token", F.col("s").alias("u"), "n", least.alias("o"), band.alias("band"))
    meeting = materialize(windows, "postings")
    # how little of a set stands alone: copies of one text have tokens of their own, but the text itself has none
    known = meeting.groupBy("u").agg((-F.count("*") / F.first("n")).alias("alone"))
    meeting = materialize(meeting.join(known, "u"), "meeting")
    windows = meeting.withColumn("window", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    fits = F.least("un", "vn") * den >= F.greatest("un", "vn") * num

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return materialize(_verify(pairs, docs, of_class, width, limit), f"{name}-links")

    # 1. leaders: the class of a token and window that stands least alone; of a class's offers, the best that shares half as much as the closest
    head = windows.groupBy("token", "window").agg(F.min(F.struct("alone", "u", "n", "o", "band")).alias("h"), F.count("*").alias("of")).where("of > 1")
    head = materialize(head.select("token", "window", F.struct("h.alone", "h.u").alias("rank"), F.col("h.u").alias("v"), F.col("h.n").alias("vn"), F.col("h.o").alias("vo"), F.col("h.band").alias("vband")), "heads")  # leaves Spark free to split hot tokens
    met = windows.withColumnsRenamed({"n": "un", "o": "uo"}).join(head, ["token", "window"]).where((F.col("u") != F.col("v")) & (F.col("window") == F.greatest("band", "vband")) & fits)
    met = met.groupBy("u", "rank", "uo", "vo").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.least("uo", "vo"))
    offers = met.groupBy("u").agg(F.collect_list(F.struct("shared", "rank")).alias("offers"))  # two heads for each of a set's prefix tokens at most
    most = F.array_max(F.transform("offers", lambda x: x["shared"]))
    first = offers.select("u", F.array_min(F.transform(F.filter("offers", lambda x: x["shared"] * 2 >= most), lambda x: x["rank"]))["u"].alias("v"))
    star = verified(first, "star")
    roots = materialize(forest(star.where("linked")), "roots")

    # 2. followers of one leader, by their deltas: twice their overlap is at least what their distances from the leader exceed together. A delta's
    # order is common to the leader's followers: tokens that the leader lacks, which few share, come first. Partners are told apart by bands
    # of their excess, and each band gets the prefix that its least excess asks for.
    far, wide = den + num, den - num
    followers = _rooted(star.select("u", F.col("v").alias("leader"), F.col("un").alias("n"), "delta"), roots)
    followers = followers.withColumn("excess", (F.size("delta") * far - F.col("n") * wide).cast("long"))
    open_ = followers.groupBy("leader").agg(F.min("excess").alias("least"), (F.min("root") != F.max("root")).alias("open")).where("open").drop("open")
    followers = followers.join(open_, "leader").withColumn("band", F.expr(f"cast(log2((excess - least) div {2 * far} + 1) as int)"))
    bands = followers.groupBy("leader").agg(F.collect_set("band").alias("bands"))  # few: they double
    partner = F.explode("bands").alias("partner")
    asked = followers.join(bands, "leader").select("leader", "u", "n", "root", "band", "excess", "least", "delta", partner)
    overlap = F.greatest(F.lit(1), F.expr(f"cast(ceil((excess + least + (shiftleft(1L, partner) - 1) * {2 * far}) / {2 * far}) as int)"))
    asked = asked.withColumn("o", overlap).where(F.col("o") <= F.size("delta"))
    prefix = F.explode(F.expr("slice(delta, 1, size(delta) - o + 1)")).alias("token")
    deltas = asked.select("leader", F.least("band", "partner").alias("low"), F.greatest("band", "partner").alias("high"), "u", "n", F.lit(1).alias("o"), "root", "band", prefix)
    deltas = materialize(deltas, "deltas")
    apart = (F.col("x_root") < F.col("y_root")) & ((F.col("low") == F.col("high")) == (F.col("x_band") == F.col("y_band")))
    near = _across(deltas, ["leader", "token", "low", "high"], ["root", "band"], apart, fits)
    left = star.select("u", F.col("un").alias("n"), F.col("delta").alias("d"))
    right = star.select(F.col("u").alias("v"), F.col("un").alias("m"), F.col("delta").alias("e"))
    # what two followers do not share is what their deltas do not share
    near = near.join(left, "u").join(right, "v").where(_linked(F.col("n") + F.col("m"), F.size(_apart("d", "e")), limit)).select("u", "v")

    # 3. classes of different leaders and components, by the tokens of order A
    led = meeting.join(small(materialize(star.select("u", F.col("v").alias("leader")), "leaders")), "u", "left").withColumn("leader", F.coalesce("leader", "u"))
    named = materialize(_rooted(led, roots).drop("alone"), "named")
    differs = [F.min(c) != F.max(c) for c in ("leader", "root")]
    mixed = named.groupBy("token").agg((differs[0] & differs[1]).alias("mixed")).where("mixed").select("token")
    named = only_passing(named, mixed, ["token"])
    named = materialize(named.withColumn("window", F.explode(F.array(F.col("band"), F.col("band") + 1))), "mixed")
    apart = (F.col("x_leader") < F.col("y_leader")) & (F.col("x_root") != F.col("y_root")) & (F.col("window") == F.greatest("x_band", "y_band"))
    rest = _across(named, ["token", "window"], ["band", "leader", "root"], apart, fits)
    more = near.union(verified(rest, "rest").where("linked").select("u", "v"))

    # links between components, as edges between their roots
    half = _rooted(more, roots).select(F.col("v").alias("u"), F.col("root").alias("other"))
    pairs = _rooted(half, roots).select(F.col("other").alias("u"), F.col("root").alias("v")).distinct()
    joined = components(materialize(pairs, "joined")).select(F.col("root").alias("top"), F.col("node").alias("root"))
    roots = roots.join(joined, "root", "outer").select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root"))
    roots = materialize(roots.union(joined.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct(), "tops")
    discard(head, star, deltas, named)

    grouped = classes.join(roots, classes["s"] == roots["node"], "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "s"))).drop("node")
    least = grouped.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = grouped.join(least, "root", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.lower(F.hex("s"))).alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
