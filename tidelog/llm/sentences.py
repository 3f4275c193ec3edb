"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and at line ends); a sentence of more than LONG_SENTENCE words is cut further
after each word whose hash is the least in some window of CUT words of it (ties too), which two copies of a passage have in common
but for its first and last words. No piece is longer than CUT words, and every shared passage of 50 words holds a span. From every sentence on, the shortest run
of at least SENTENCES sentences and SPAN_WORDS words is a span, and so is the shortest such run up to every sentence: together they cover
all sentences of a repeated run that is long enough, its last ones too. Spans are hashed (two 64-bit hashes of their words), grouped
globally, and every sentence is removed that a span covers which is not its first occurrence, by document id and
position.

Words are runs of other than white space; case and spacing between words do not matter to a span. Null texts and texts
without words have no sentence; a text shorter than a span loses nothing. Rows that share an id but not the text count as documents of their
own, in the order of their texts' hashes; equal rows are one document and get equal results. The id must be a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, materialize, mix, powers, prefix_hashes, span_hashes, text_bytes, text_chunks
from .sketch import bucket_bits, passes, repeated_filter

SENTENCES, SPAN_WORDS, LONG_SENTENCE, CUT = 2, 20, 12, 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Split:
    """The words, sentences and spans of a batch of texts; all arrays, no loop over documents."""

    def __init__(self, array: pa.Array):
        self.data, self.offsets = text_bytes(array)
        lower = _LOWER[self.data]
        solid = ~_SPACE[self.data]
        n = len(solid)
        inner = np.zeros(n + 1, bool)
        inner[self.offsets] = True  # a text's edge also ends a word
        begin = solid & ~(np.r_[False, solid[:-1]] & ~inner[:n]) if n else solid
        finish = solid & ~(np.r_[solid[1:], False] & ~inner[1:]) if n else solid
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash = span_hashes(prefix_hashes(lower), self.start, self.end)
        self._sentences()

    def _sentences(self) -> None:
        w = len(self.start)
        if not w:
            self.first = self.last = self.of = np.zeros(0, np.int64)
            return
        lines = np.r_[0, np.cumsum(self.data == 10)]
        stop = _STOP[self.data[self.end - 1]]
        following = np.r_[self.start[1:], len(self.data)]
        stop |= lines[following] > lines[self.end]
        stop |= np.r_[self.doc[1:] != self.doc[:-1], True]
        ends = np.flatnonzero(stop)
        size = np.diff(np.r_[-1, ends])
        long_ = np.repeat(size > LONG_SENTENCE, size)
        stop |= self._least(np.where(long_, np.repeat(np.arange(len(ends)), size), -1))
        self.last = np.flatnonzero(stop)  # last word of each sentence
        self.first = np.r_[0, self.last[:-1] + 1]
        self.of = self.doc[self.first]  # document of each sentence

    def _least(self, sentence: np.ndarray) -> np.ndarray:
        """Words whose hash is the least in some window of CUT words of one sentence; no word of sentence -1."""
        h, w = mix(self.hash) | np.uint64(1), len(self.hash)
        out, n = np.zeros(w, bool), w - CUT + 1
        if n < 1:
            return out
        inside = (sentence[:n] == sentence[CUT - 1 :]) & (sentence[:n] >= 0)
        least = h[:n].copy()
        for k in range(1, CUT):
            np.minimum(least, h[k : k + n], out=least)
        least[~inside] = 0
        for k in range(CUT):
            out[k : k + n] |= least == h[k : k + n]
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last sentence of each span: the shortest run from each sentence on, then those up to a sentence where none of them ends."""
        s = len(self.first)
        if not s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the sentence that ends SPAN_WORDS words on, and at least SENTENCES sentences
        stop = np.maximum(np.searchsorted(self.last, self.first + SPAN_WORDS - 1), np.arange(s) + SENTENCES - 1)
        good = stop < s
        good[good] = self.of[stop[good]] == self.of[np.flatnonzero(good)]
        a = np.flatnonzero(good)
        begin = np.minimum(np.searchsorted(self.first, self.last - SPAN_WORDS + 1, side="right") - 1, np.arange(s) - SENTENCES + 1)
        good = begin >= 0
        good[good] = self.of[begin[good]] == self.of[np.flatnonzero(good)]
        good[stop[a]] = False  # the latest run that ends there is the shortest
        b = np.flatnonzero(good)
        return np.r_[a, begin[b]], np.r_[stop[a], b]

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (0x51ED270B, 0x2545F491):
            sums = np.zeros(len(self.hash) + 1, np.uint64)
            ups, downs = powers(len(self.hash) + 1)
            np.cumsum(mix(self.hash + np.uint64(salt)) * ups[: len(self.hash)], out=sums[1:])
            i, j = self.first[a], self.last[b] + 1
            out.append(mix((sums[j] - sums[i]) * downs[i] + (j - i).astype(np.uint64)).view(np.int64))
        return out[0], out[1]


def _fingerprints(piece: pa.RecordBatch, seen: set) -> np.ndarray:
    split = Split(piece.column("text"))
    return split.span_hash(*split.spans())[0].view(np.uint64)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (h1, h2, id, t, first, last): the spans that may come more than once, with their sentences' numbers in the document of this id and text hash."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = repeated_filter(rows.select("text"), _fingerprints, parts, 1 << 62)[0]
    bits, shared = bucket_bits(parts), docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_chunks(batches):
            split = Split(piece.column("text"))
            a, b = split.spans()
            h1, h2 = split.span_hash(a, b)
            hit = passes(shared.value, h1.view(np.uint64), bits)
            a, b, h1, h2 = a[hit], b[hit], h1[hit], h2[hit]
            if len(a):
                base = np.searchsorted(split.of, split.of[a])
                ids, ts = (piece.column(c).to_numpy(zero_copy_only=False)[split.of[a]] for c in ("id", "t"))
                yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array(ids.astype(np.int64)), pa.array(ts), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, "h1 long, h2 long, id long, t long, first int, last int")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, t, covered): for each document with spans that are not the first of their kind, those spans' sentences.

    Span hashes are counted with partial sums before they are shuffled; the join back to the spans is one that Spark can split where a
    span is hot. A document's own list is bounded by its length.
    """
    all_spans = spans(docs, key, text)
    place = F.struct("id", "t", "first")
    known = all_spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n")
    known = materialize(known, "known")  # read from a table, it leaves Spark free to split a hot span's rows
    found = all_spans.join(known, ["h1", "h2"]).where(place != F.col("origin"))
    return found.groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("covered"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `kept_text`, `n_sentences`, `n_removed` and `removed` (character ranges start, end of the removed runs).

    The text between a removed sentence and the next goes with it. Rows with a null id keep their text whole. Other columns pass through;
    own columns of these names as <name>_input.
    """
    docs, named = make_room(docs, "kept_text", "n_sentences", "n_removed", "removed", "__id", "__t", "__covered", "__cut")
    key, text = named(key), named(text)
    covered = repeated(docs, key, text).withColumnsRenamed({"id": "__id", "t": "__t", "covered": "__covered"})
    joined = docs.join(covered, (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__t")), "left").drop("__id", "__t")
    names = docs.columns

    @F.pandas_udf("kept_text string, n_sentences int, n_removed int, removed array<struct<start:int,end:int>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, covered in batches:
            rows = []
            batch = pa.record_batch({"text": pa.array(texts, pa.string(), from_pandas=True)})
            for piece in text_chunks([batch]):
                rows += _cut(piece.column("text"), covered.iloc[len(rows) : len(rows) + piece.num_rows])
            yield pd.DataFrame(rows, columns=["kept_text", "n_sentences", "n_removed", "removed"])

    spans_of = F.transform("__covered", lambda x: F.shiftleft(x["first"].cast("long"), 32) + x["last"])  # one number each: a worker holds flat arrays
    return joined.withColumn("__cut", cut(F.col(text), spans_of)).select(*[F.col(f"`{n}`") for n in names], "__cut.*")


def _cut(texts: pa.Array, covered) -> list[tuple]:
    split = Split(texts)
    edge = np.searchsorted(split.of, np.arange(len(texts) + 1)).tolist()
    rows = []
    for k, (text, spans_) in enumerate(zip(texts, covered)):
        text, lo, n = text.as_py(), edge[k], edge[k + 1] - edge[k]
        if text is None or spans_ is None or not len(spans_) or not n:
            rows.append((text, n, 0, []))
            continue
        gone = np.zeros(n + 1, np.int64)
        both = np.asarray(spans_, np.int64)
        a, b = both >> 32, both & 0xFFFFFFFF
        b, a = b[a < n], a[a < n]
        np.add.at(gone, a, 1)
        np.add.at(gone, np.minimum(b, n - 1) + 1, -1)
        gone = np.cumsum(gone[:n]) > 0
        raw = text.encode()
        begins = split.start[split.first[lo : lo + n]] - int(split.offsets[k])
        begins[0] = 0
        stops = np.r_[begins[1:], len(raw)]
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        runs = [(int(begins[a]), int(stops[b - 1])) for a, b in zip(edges[::2], edges[1::2])]
        kept, at = [], 0
        for a, b in runs:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        chars = [{"start": len(raw[:a].decode()), "end": len(raw[:b].decode())} for a, b in runs]
        rows.append((b"".join(kept).decode(), n, int(gone.sum()), chars))
    return rows
