"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled one after the other, each as a gadget over the automaton of the merges before it. The
automaton's states are "the last arc was labelled t"; an arc labelled w leads to state w. Gadget k, for the merge of
u and v into w,

1. copies state v's arcs to the new state w,
2. takes the arc v away from state u (after u, v can no longer stand alone),
3. gives an arc w to every state that has an arc u;

or does nothing, if state u has no arc v: then the merge can never happen.

Each state then has at most one arc for a label, and the one path that spells a word is its encoding. The arcs are kept
factored: a gadget stores its number, its two parts and the arc that it took away, and `arc` unrolls copies (1) and (3)
back to an arc between base symbols. Looked-up arcs go into a transition table.

Encoding is determined from left to right. A path's beginning is the path of what it spells, so that every place in a word
has one state, the last label of the path up to there: of the labels that end at the place, the one that the state where it begins has an arc for.
Each place is settled once by the table; nothing is searched or taken back. Decoding writes out the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, string_chunks

END = "</w>"
#: Contractions of the vocabulary's own pre-split pattern (fixed values).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
UNICODE_WORDS = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
#: Entries that a worker keeps before it starts anew, and the longest word kept.
WORDS_KEPT, LONGEST_KEPT, ARCS_KEPT = 300_000, 64, 500_000


def byte_symbols() -> list[str]:
    """The symbol of each byte: printable Latin-1 as it is, the rest numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        self.size = max(vocab.values(), default=-1) + 1
        self.labels = [""] * self.size
        for label, i in vocab.items():
            self.labels[i] = label
        self.born, self.left, self.right = [0] * self.size, [-1] * self.size, [-1] * self.size
        self.taken: dict[int, int] = {}
        self.unused: set[int] = set()
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.inner: dict[str, int] = {}  # endings of labels that stand inside a word, and of those that end one; -1 where no label is so short
        self.final: dict[str, int] = {}
        for label, i in vocab.items():
            if i not in self.unused:
                ends = label.endswith(END) and len(label) > len(END)
                spelt, known = (label[: -len(END)], self.final) if ends else (label, self.inner)
                for k in range(1, len(spelt)):
                    known.setdefault(spelt[k:], -1)
                known[spelt] = i
        self.table: dict[int, bool] = {}

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.born[w], self.left[w], self.right[w] = k, u, v
        if u in self.unused or v in self.unused or not self._stands(u, v, 2 * k):
            self.unused.add(w)  # no path of the automaton so far has u before v, so that none gets w
        else:
            self.taken[u * self.size + v] = k

    def _stands(self, t: int, w: int, before: int) -> bool:
        """Whether state t has an arc w after the gadgets up to a time: 2k - 1 and 2k stand before and after step 2 of gadget k."""
        while True:
            k = self.taken.get(t * self.size + w)
            if k is not None and 2 * k < before:
                return False
            made_t, made_w = self.born[t], self.born[w]
            if not made_t and not made_w:
                return True
            if made_w >= made_t:  # step 3 of gadget made_w, after its step 2
                w, before = self.left[w], 2 * made_w + 1
            else:  # step 1 of gadget made_t, before its step 2
                t, before = self.right[t], 2 * made_t

    def arc(self, state: int, label: int) -> bool:
        """Whether the finished automaton has an arc with this label in this state."""
        key = state * self.size + label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= ARCS_KEPT:
                self.table.clear()
            known = self.table[key] = self._stands(state, label, 2 * self.size)
        return known

    def encode(self, word: str) -> list[int]:
        """The path that spells the word (symbols of bytes, without the end mark)."""
        n, size, table = len(word), self.size, self.table
        state, begin = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            endings = (self.final if end == n else self.inner).get
            found = []
            for start in range(end - 1, -1, -1):
                label = endings(word[start:end])
                if label is None:
                    break
                if label >= 0:
                    found.append((label, start))
            for label, start in reversed(found):  # one fits at most
                last = state[start]
                if start:
                    if last < 0:
                        continue
                    known = table.get(last * size + label)
                    if known is None:
                        known = self.arc(last, label)
                    if not known:
                        continue
                state[end], begin[end] = label, start
                break
        if n and state[n] < 0:
            raise ValueError(f"the vocabulary cannot spell {word[:50]!r}")
        path = []
        while n:
            path.append(state[n])
            n = begin[n]
        return path[::-1]


class WordBpe:
    """Pre-splitting around the automaton, for vocabularies with word ends, lower case and dropped white space."""

    def __init__(self, automaton: MergeAutomaton, added: dict[str, int]):
        self.automaton, self.added = automaton, added
        self.symbols = byte_symbols()
        self.names = list(automaton.labels)
        for s, i in added.items():
            self.names += [""] * (i + 1 - len(self.names))
            self.names[i] = s
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() looks at a word's end for this letter
        return UNICODE_WORDS.findall(text.lower())

    def word(self, word: str) -> bytes:
        path = self.automaton.encode("".join([self.symbols[b] for b in word.encode()]))
        out = np.array(path, dtype="<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            self.kept[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        found: list[bytes] = []
        get = self.kept.get
        for k, part in enumerate(self.marks.split(text) if self.marks and "<" in text else [text]):
            if k % 2:
                found.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                found += [get(w) or self.word(w) for w in self.words(part)]
        return b"".join(found)

    def run(self, text: str) -> tuple[bytes, str]:
        """The ids, and the text decoded from them."""
        ids = self.ids(text)
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def decode(self, ids) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


def load(path: str) -> WordBpe:
    """Read a vocabulary file of the public JSON format on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return WordBpe(MergeAutomaton(spec["model"]["vocab"], merges), added)


def encode(df: DataFrame, vocabulary: str, column: str = "text", digests_only: bool = False) -> DataFrame:
    """Adds the column `bpe`: struct of n_tokens, ids (little-endian 32-bit integers), decoded, ids_sha256, decoded_sha256.

    decoded is made from the ids. A null text counts as empty: no tokens, and the digests of nothing. Texts of any length are encoded
    whole; repeated rows give equal results; other columns pass through, an own column `bpe` as `bpe_input`. With digests_only, ids and
    decoded are null.
    """
    df, named = make_room(df, "bpe")
    model = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("struct<n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = model.value
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string())
        for texts in batches:
            for piece in string_chunks(texts):  # what a worker holds at once
                rows = []
                for text in piece:
                    ids, decoded = bpe.run(text.as_py() or "")
                    rows.append((len(ids) // 4, None if digests_only else ids, None if digests_only else decoded, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    return df.withColumn("bpe", run(F.col(named(column))))


def decode(df: DataFrame, vocabulary: str, column: str = "ids") -> DataFrame:
    """Adds the column `decoded`: the labels of the ids in a binary column of little-endian 32-bit integers; null stays null.

    Other columns pass through, an own column `decoded` as `decoded_input`.
    """
    df, named = make_room(df, "decoded")
    model = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array([None if x is None else model.value.decode(np.frombuffer(x, "<u4").tolist()) for x in ids.to_pylist()], pa.string())

    return df.withColumn("decoded", run(F.col(named(column))))
