"""Language ID by word-first backoff.

A text is a bag of lower-cased words, runs of letters with their marks. A word of the learned tables scores by its log frequency in
each language; an unseen word scores by its longest known character n-grams, from LONGEST letters down to one. Sums over the words,
with the languages' shares as prior, give each language's posterior.

Tables are fitted on a bounded sample of labelled rows: about DOCS_PER_LANGUAGE documents of each language, chosen by hash; all of
their words and n-grams are kept. Predictions read nothing but the text.

The tables are flat: sorted 64-bit hashes beside a row of 32-bit scores for each, so that a worker holds a few MB.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, mix, string_chunks

DOCS_PER_LANGUAGE = 2_000
LONGEST = 5
UNKNOWN = "und"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORDS = re.compile("[a-z]+")
#: Words whose scores a worker keeps.
WORDS_KEPT = 50_000
#: Words that a task of the fit counts before it sends their numbers on.
COUNTED_AT_ONCE = 200_000
#: Words whose n-grams the driver holds at once.
WORDS_AT_ONCE = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    return WORDS.findall(unicodedata.normalize("NFC", text).lower())


class Letters:
    """Words as one array of code points, each with a space on either side."""

    def __init__(self, listed: list[str]):
        self.codes = np.frombuffer("".join([f" {w} " for w in listed]).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = np.array([len(w) for w in listed], np.int64) + 2
        self.start = np.cumsum(self.size) - self.size

    def whole(self) -> np.ndarray:
        """A hash for each word."""
        if not len(self.size):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.codes)) - np.repeat(self.start, self.size)
        power = np.multiply.accumulate(np.full(int(self.size.max()), _BASE))
        return mix(np.add.reduceat(mix(self.codes) * power[at], self.start))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and hash of each n-gram; single letters without the spaces."""
        edge = 1 if n == 1 else 0
        many = np.maximum(self.size - 2 * edge - n + 1, 0)
        word = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + self.start[word] + edge
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _BASE + mix(self.codes[at + k] if len(at) else at.astype(np.uint64))
        return word, mix(h + np.uint64(n))


class Table:
    """Log frequencies by hash: a row for each key, a column for each language."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray]], languages: int):
        """parts: (language, hashes without repeats, counts)."""
        self.keys = np.unique(np.concatenate([h for _, h, _ in parts])) if parts else np.zeros(0, np.uint64)
        sums = np.zeros((len(self.keys), languages), np.float32)
        for language, h, count in parts:
            sums[np.searchsorted(self.keys, h), language] += count
        total = sums.sum(axis=0, dtype=float) + (sums > 0).sum(axis=0) + 1
        sums += 0.5
        sums /= total
        self.logs = np.log(sums, out=sums)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def _summed(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(at, weights=count, minlength=len(keys))


class Backoff:
    def __init__(self, counts: pa.Table, shares: dict[str, int]):
        """counts: rows (lang, word, n); shares: language to documents."""
        self.languages = sorted(set(pc.unique(counts["lang"]).to_pylist()) & set(shares))
        k = len(self.languages)
        total = sum(shares[x] for x in self.languages)
        self.prior = np.log(np.array([shares[x] / total for x in self.languages])) if k else np.zeros(0)
        parts: list[list] = [[] for _ in range(LONGEST + 1)]  # whole words, then n-grams
        for language, name in enumerate(self.languages):
            own = counts.filter(pc.equal(counts["lang"], name))
            for at in range(0, own.num_rows, WORDS_AT_ONCE):
                some = own.slice(at, WORDS_AT_ONCE)
                letters, n = Letters(some["word"].to_pylist()), some["n"].to_numpy().astype(float)
                parts[0].append((language, *_summed(letters.whole(), n)))
                for size in range(1, LONGEST + 1):
                    word, h = letters.grams(size)
                    parts[size].append((language, *_summed(h, n[word])))
        self.known = Table(parts[0], k)
        self.grams = {size: Table(parts[size], k) for size in range(1, LONGEST + 1)}
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, k))

    def score(self, listed: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        letters = Letters(listed)
        out = np.zeros((len(listed), len(self.languages)))
        at = self.known.find(letters.whole())
        out[at >= 0] = self.known.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            own = Letters([listed[i] for i in left])
            word, h = own.grams(n)
            at = self.grams[n].find(h)
            word, at = word[at >= 0], at[at >= 0]
            hits = np.bincount(word, minlength=len(left))
            for c in range(len(self.languages)):
                sums = np.bincount(word, weights=self.grams[n].logs[at, c], minlength=len(left))
                out[left[hits > 0], c] = sums[hits > 0] / hits[hits > 0]
            left = left[hits == 0]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior of one text."""
        names, scores = self.predict_all([text])
        return names[0], float(scores[0])

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        bags = [Counter(words(t)) if t else {} for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        if len(self.index) > WORDS_KEPT:
            self.index.clear()
            self.rows = self.rows[:0]
        new = list(dict.fromkeys(w for bag in bags for w in bag if w not in self.index))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.rows = np.concatenate([self.rows, self.score(new)])
        get = self.index.__getitem__
        for k, bag in enumerate(bags):
            if bag:
                logs = np.fromiter(bag.values(), float, len(bag)) @ self.rows[[*map(get, bag)]] + self.prior
                best = int(np.argmax(logs))
                names[k], scores[k] = self.languages[best], 1 / np.exp(logs - logs[best]).sum()
        return names, scores


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id") -> Backoff:
    """Learn the tables; rows without text or language teach nothing, repeated rows teach as often as they come. Only these three columns are read."""
    rows = labelled.select(F.col(text).alias("text"), F.col(language).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("h")).where("text is not null and lang is not null")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not shares:
        return Backoff(pa.table({"lang": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), {})
    span = 1 << 30
    limit = F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, min(span, span * DOCS_PER_LANGUAGE // n))])
    sample = rows.where(F.pmod("h", F.lit(span)) < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, c in tally.items() for w, n in c.items()]
            tally.clear()
            return pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                tally.setdefault(lang, Counter()).update(words(text.as_py()))
                if sum(map(len, tally.values())) > COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Backoff(counted.toArrow(), shares)  # the words of a bounded number of documents


def identify(df: DataFrame, model: Backoff, column: str = "text") -> DataFrame:
    """Adds the column `language`: struct of lang_pred and score (the posterior, 0 to 1).

    Null texts, empty ones and those without a letter get `und` and 0, as does every text if nothing was learned. Texts of any length are
    read whole. Ties go to the language first in order. Repeated rows get equal results; other columns pass through, an own column
    `language` as `language_input`.
    """
    df, named = make_room(df, "language")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for piece in string_chunks(texts):
                names, scores = shared.value.predict_all(piece.to_pylist())
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return df.withColumn("language", run(F.col(named(column))))
