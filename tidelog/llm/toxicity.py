"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, lexicons of words and stems mined from the labelled rows (cut into
several voters), writing patterns, and the annotation itself, which may be wrong. Each votes 1, 0 or abstains. A generative
label model with a hidden true label estimates every voter's accuracy and its correlations with other voters by expectation
maximisation; a voter that repeats another adds no evidence. A linear classifier over words and stems
learns the posterior labels, and alone scores the documents.

The fit reads at most about DOCS_PER_CLASS labelled rows of each class, chosen by hash, weighted to the classes' true shares. The
classifier has as many as FEATURES of the sample's words and stems; scores read all words of a text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, string_chunks

DOCS_PER_CLASS = 4_000
LEAST_ROWS = 3
FEATURES = 4_000
MINED_VOTERS = 6
#: Nats of information that correlated voters share at least, given the label.
LEAST_SHARED = 0.05
STEMS = range(4, 9)
RUNS = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 100_000
#: Common English insults, and phrases that threaten or dismiss.
INSULTS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "trash", "clown", "jerk", "imbecile", "pathetic", "worthless", "disgusting")
HOSTILE = ("shut up", "go to hell", "drop dead", "hate you", "kill you", "get lost", "you people", "piece of")


def features(text: str | None) -> set[str]:
    """Words and stems: `w:` a whole word, `s:` its first letters."""
    out: set[str] = set()
    for word in set(RUNS.findall((text or "").lower())):
        out.update(word_features(word))
    return out


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *[f"s:{word[:n]}" for n in STEMS if n < len(word)]]


def pattern_votes(text: str | None) -> list[int]:
    """Votes that need no labels: 1 toxic, 0 not, -1 abstains."""
    text = text or ""
    low = text.lower()
    found = set(RUNS.findall(low))
    hits = [w in found for w in INSULTS]
    half = len(INSULTS) // 2
    letters = sum(map(str.isalpha, text))
    capital = sum(map(str.isupper, text))
    return [
        1 if any(hits[:half]) else -1,
        1 if any(hits[half:]) else -1,
        1 if sum(hits) > 1 else (0 if not any(hits) else -1),
        1 if any(p in low for p in HOSTILE) else -1,
        1 if letters > 20 and capital > 0.7 * letters and "!" in text and any(hits) else -1,
        0 if letters < 5 else -1,
    ]


class LabelModel:
    """The generative model: a hidden label, and votes in {-1, 0, 1} that depend on it and on each other along a tree.

    Every voter has a table of how it votes given the label (its accuracy); a voter that is correlated with another has
    a table given the label and that voter's vote instead, so that what it repeats is no evidence. The tree is the
    one of most mutual information given the label, without edges of less than LEAST_SHARED. Tables, tree and labels are estimated by
    expectation maximisation.
    """

    def fit(self, votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
        m = votes.shape[1]
        seen = votes + 1
        hot = np.stack([(seen == v).astype(float) for v in range(3)])  # vote, row, voter
        q, self.parent = start.copy(), np.full(m, -1)
        for k in range(rounds):
            p = weight * (1 - q), weight * q
            self.share = (p[1].sum() + 1) / (weight.sum() + 2)
            self.given = [np.stack([(c.T @ x + 0.5) / (x.sum() + 1.5) for c in hot]) for x in p]
            if k % 4 == 0:
                self._tree(hot, p)
            logs = np.full(len(q), math.log(self.share / (1 - self.share)))
            self.tables = []
            for j in range(m):
                up = self.parent[j]
                table = [self._table(hot, x, y, j, up) for y, x in enumerate(p)]
                self.tables.append(table)
                ratio = np.log(table[1]) - np.log(table[0])
                logs += ratio[seen[:, j]] if up < 0 else ratio[seen[:, up], seen[:, j]]
            q = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        return q

    def _table(self, hot: np.ndarray, p: np.ndarray, y: int, j: int, up: int) -> np.ndarray:
        """How voter j votes, given the label and (in rows) the vote of the voter above it."""
        own = self.given[y][:, j]
        if up < 0:
            return own
        both = np.einsum("an,bn,n->ab", hot[:, :, up], hot[:, :, j], p, optimize=True)
        return (both + own) / (both.sum(axis=1, keepdims=True) + 1)

    def _tree(self, hot: np.ndarray, p: tuple[np.ndarray, np.ndarray]) -> None:
        """Voters' mutual information given the label, and the spanning forest of most of it."""
        m, total = hot.shape[2], sum(x.sum() for x in p)
        self.shared = np.zeros((m, m))
        for y, x in enumerate(p):
            both = np.einsum("ani,bnj->ijab", hot * x[None, :, None], hot, optimize=True) / max(x.sum(), 1e-9)
            alone = self.given[y].T  # voter, vote
            apart = alone[:, None, :, None] * alone[None, :, None, :]
            self.shared += x.sum() / total * np.where(both > 0, both * np.log(np.maximum(both, 1e-12) / apart), 0).sum(axis=(2, 3))
        np.fill_diagonal(self.shared, 0)
        self.parent = np.full(m, -1)
        inside = np.zeros(m, bool)
        for _ in range(m):
            reach = np.where(inside[:, None] & ~inside[None, :], self.shared, -1)
            i, j = np.unravel_index(int(reach.argmax()), reach.shape)
            if reach[i, j] >= LEAST_SHARED:
                self.parent[j] = i
            else:
                j = int(np.flatnonzero(~inside)[0])
            inside[j] = True


class Bags:
    """The sample's binary features as numbers; features of fewer than LEAST_ROWS rows are left out.

    Rows are counted by 22 bits of the features' hashes first, so that the sample's many rare words are never held.
    """

    def __init__(self, texts: list[str | None]):
        counts = np.zeros(1 << 22, np.int32)
        for t in texts:
            counts[list({zlib.crc32(f.encode()) & 0x3FFFFF for f in features(t)})] += 1
        self.ids: dict[str, int] = {}
        rows = [[self.ids.setdefault(f, len(self.ids)) for f in features(t) if counts[zlib.crc32(f.encode()) & 0x3FFFFF] >= LEAST_ROWS] for t in texts]
        self.n = len(texts)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in rows])
        self.flat = np.array([f for x in rows for f in x], dtype=np.int64)
        self.names = sorted(self.ids, key=self.ids.get)
        self.rows = self.sums(np.ones(self.n))

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Each feature's sum of a value of the rows that have it."""
        return np.bincount(self.flat, weights=value[self.row], minlength=len(self.ids))

    def log_odds(self, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How much likelier each feature is in a toxic row, smoothed."""
        toxic, clean = q * weight, (1 - q) * weight
        return np.log((self.sums(toxic) + 0.5) / (toxic.sum() + 1)) - np.log((self.sums(clean) + 0.5) / (clean.sum() + 1))

    def having(self, chosen: np.ndarray) -> np.ndarray:
        """Whether each row has one of the features."""
        return np.bincount(self.row, weights=chosen[self.flat], minlength=self.n) > 0


class Linear:
    """Logistic regression over chosen binary features."""

    def __init__(self, bags: Bags, chosen: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300):
        at = np.full(len(bags.ids), -1)
        at[chosen] = np.arange(len(chosen))
        keep = at[bags.flat] >= 0
        flat, row = at[bags.flat[keep]], bags.row[keep]
        k_features, n = len(chosen), max(bags.n, 1)
        w, b = np.zeros(k_features), 0.0
        m, v = np.zeros(k_features + 1), np.zeros(k_features + 1)
        weight = weight / weight.mean() if len(weight) else weight
        for k in range(1, rounds + 1 if bags.n else 1):
            z = np.bincount(row, weights=w[flat], minlength=n) + b
            err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            grad = np.r_[np.bincount(flat, weights=err[row], minlength=k_features) + 0.05 * w, err.sum()] / n
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.weights = {bags.names[i]: float(y) for i, y in zip(chosen.tolist(), w) if abs(y) > 1e-4}
        self.bias = float(b) if bags.n else -1e-9
        self.kept: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        on: set[str] = set()
        for word in set(RUNS.findall((text or "").lower())):
            found = self.kept.get(word)
            if found is None:
                found = self.kept[word] = tuple(f for f in word_features(word) if f in self.weights)
            if found:
                on.update(found)
        z = self.bias + sum(self.weights[f] for f in sorted(on))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> Linear:
    """The whole fit on the driver, over the bounded sample."""
    bags = Bags(texts)
    if not len(texts):
        return Linear(bags, np.zeros(0, np.int64), toxic, weight)
    odds = bags.log_odds(toxic.astype(float), weight)
    strong = np.flatnonzero((odds > 2.5) & (bags.rows >= 5))
    mined = sorted(strong.tolist(), key=lambda f: (-odds[f] * math.log(bags.rows[f]), bags.names[f]))[:600]
    found = []
    for k in range(MINED_VOTERS):
        chosen = np.zeros(len(bags.ids))
        chosen[mined[k::MINED_VOTERS]] = 1
        found.append(bags.having(chosen))
    votes = np.array([[int(y), *pattern_votes(t)] for t, y in zip(texts, toxic)])
    nothing = np.where(np.any(found, axis=0), -1, 0)
    votes = np.c_[votes, np.where(np.array(found).T, 1, -1), nothing]
    q = LabelModel().fit(votes, weight, np.where(toxic == 1, 0.9, 0.1))
    odds = bags.log_odds(q, weight)
    value = np.abs(odds) * np.sqrt(bags.rows)
    best = sorted(range(len(value)), key=lambda f: (-value[f], bags.names[f]))[:FEATURES]
    return Linear(bags, np.array(best, dtype=np.int64), q, weight)


def choose(labels: DataFrame, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """Rows (key, toxic, weight): about DOCS_PER_CLASS labels of each class at most, by the key's hash; so few that they can be broadcast.

    Labels other than 0 and 1 teach nothing.
    """
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    span = 1 << 30
    limit = {y: min(span, span * DOCS_PER_CLASS // n) for y, n in counts.items()} or {0: 0}
    table = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
    kept = rows.where(F.pmod(F.xxhash64(key), F.lit(span)) < table[F.col("toxic")])
    return kept.withColumn("weight", F.lit(float(span)) / table[F.col("toxic")])


def fit(labels: DataFrame, docs: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Linear:
    """Learn from labels (key, label) and the documents (key, text); labels without a document teach nothing."""
    chosen = choose(labels, label, key)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    sample = rows.select(F.xxhash64(key).alias("h"), "toxic", "weight", "text").toPandas().sort_values(["h", "toxic", "text"])  # bounded by DOCS_PER_CLASS
    return learn([t if isinstance(t, str) else None for t in sample["text"]], sample["toxic"].to_numpy(), sample["weight"].to_numpy(dtype=float))


def score(df: DataFrame, model: Linear, column: str = "text") -> DataFrame:
    """Adds the column `toxicity`, 0 to 1.

    Null and empty texts get the score of a text without words. Texts are read whole; repeated rows get equal scores;
    other columns pass through, an own column `toxicity` as `toxicity_input`. If there was nothing to learn from, every score is 0.5 or less.
    """
    df, named = make_room(df, "toxicity")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for piece in string_chunks(texts):
                yield pa.array([shared.value.score(t) for t in piece.to_pylist()], pa.float64())

    return df.withColumn("toxicity", run(F.col(named(column))))
