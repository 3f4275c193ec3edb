"""Suffix-array dedup: bytes under a string of LENGTH bytes that also starts in a document of smaller id are removed.

Sorting every suffix would move many times the input. Only suffixes that can have an equal are sorted:

1. Every LENGTH-byte string has one anchor, the least-hashed K bytes in it; equal strings have equal anchors in the same
   place. Anchors' fingerprints (5 bytes) are exchanged and those that come once fall out through a Bloom filter,
   which grows with the text up to a bound; the filter only saves work.
2. An anchor that is left goes, with the text around it that its strings cover, to the task of its fingerprint.
3. There the texts are put in order by deep-shallow sorting: multikey sorting on the first SHALLOW bytes, then a
   blind trie for each group that is still tied. Equal texts meet in one leaf, whose smallest id keeps them. Where
   different texts share an anchor, their LENGTH-byte suffixes are sorted in the same way.

A task first meets its own equal texts, byte by byte, and sends the one of smallest id. What is left under fingerprints of many different texts
(hot ones) is sent as LENGTH-byte suffixes, each under its own hash, so that no task gets a hot group whole. Copies of a whole document are found by their hash; a task
scans one again only if its id is smaller than those it has had, and copies that a filter knows are not scanned at all; the copy of
smallest id, which keeps the text, is always scanned.

Null texts are empty; texts shorter than LENGTH lose nothing; a row with a null id neither loses bytes nor takes any; rows that share an
id are no smaller than each other, and are told apart by 32 bits of their texts' hashes (0 for ids that come once).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, materialize, mix, passing, powers, prefix_hashes, span_hashes, text_bytes, text_chunks
from .sketch import FILTER_BITS, bucket_bits, passes, repeated_filter, shortened

LENGTH, K, SHALLOW = 50, 20, 16
#: Bytes of the longest context: LENGTH - K on either side of an anchor.
WIDTH = 2 * LENGTH - K
HOT = 5_000
#: Blobs for each partition of the exchange and each merge(). They get smaller with every partition and compress worse, so that there are few; a
#: task holds one bucket at a time, and sorts it in SLICES slices of its keys.
PER_PART, SLICES = 2, 16
#: zstd's level for blobs of a few kB.
LEVEL = 6
#: The filter of repeated anchors has 2**FILTER_MOST bits at most (64 MB); beyond some 2 GB of text it lets more through than it need.
FILTER_MOST = 29
#: Suffixes of whole groups that are sorted at once.
SUFFIXES_AT_ONCE = 100_000
#: A task meets its own equal contexts in so many bytes of text, or so many contexts, at once.
TEXT_AT_ONCE, HELD_ROWS, SENT_AT_ONCE = 12 << 20, 300_000, 25_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- anchors --------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Arrays (fingerprint, row, first, last): each anchor, and the first and last start of the strings that it stands for."""
    n, width = len(data), LENGTH - K + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    sums = prefix_hashes(data)
    _, downs = powers(n + 1)
    h = mix((sums[K:] - sums[:-K]) * downs[: n - K + 1])
    place = np.uint64((1 << 26) - 1)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([v, np.full(-len(v) % width, _TOP)]).reshape(-1, width)
    starts = n - LENGTH + 1
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:starts]
    behind = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + starts]
    spot = (np.minimum(ahead, behind) & place).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    i = np.flatnonzero(np.arange(starts) + LENGTH <= offsets[row + 1])
    if not len(i):
        return none.astype(np.uint64), none, none, none
    spot = spot[i]
    new = np.ones(len(i), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (i[1:] != i[:-1] + 1)
    a = np.flatnonzero(new)
    # the least hashes crowd at the lower end of their range, and would fill few buckets and a small part of the filter
    return mix(h[spot[a]]), row[i[a]], i[a], i[np.r_[a[1:] - 1, len(i) - 1]]


def _segments(piece: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part, its place in the text): texts of more than CHUNK bytes come in parts of their own, which overlap so that each string lies in one."""
    data, offsets = text_bytes(piece.column("text"))
    size = np.diff(offsets)
    if size.max(initial=0) <= CHUNK:
        yield data, offsets, np.arange(len(size)), np.zeros(len(size), np.int64)
        return
    for k, (x, n) in enumerate(zip(offsets.tolist(), size.tolist())):
        for a in range(0, max(n - LENGTH + 1, 1), CHUNK):
            b = min(n, a + CHUNK + LENGTH - 1)
            yield data[x + a : x + b], np.array([0, b - a]), np.array([k]), np.array([a])


def _keys(piece: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Row and digest of each text of LENGTH bytes or more."""
    for k, text in enumerate(piece.column("text")):
        if text.is_valid and len(raw := text.as_buffer().to_pybytes()) >= LENGTH:
            yield k, hashlib.blake2b(raw, digest_size=16).digest()


def _unseen(piece: pa.RecordBatch, seen: dict[bytes, int]) -> pa.RecordBatch:
    """The rows whose text this task has not had yet, or under larger ids only; of a piece's equal texts, the one of smallest id."""
    ids, keep = piece.column("id").to_pylist(), {}
    for k, key in _keys(piece):
        if key not in seen or ids[k] < seen[key]:
            seen[key] = ids[k]
            keep[key] = k
    return piece.take(pa.array(sorted(keep.values()), pa.int64()))


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


class BlindTrie:
    """Strings by their branching bytes alone: an insertion goes down blindly, compares once with the leaf it meets and goes down again to the place where they part."""

    def __init__(self):
        self.root = None  # a leaf [string, members] or a node (depth, {byte: child})

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while type(node) is tuple:
            child = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(member)
            return
        part, known = 0, node[0]
        low, high = 0, min(len(s), len(known))
        while low < high:  # length of the common prefix
            part = (low + high + 1) // 2
            if s[:part] == known[:part]:
                low = part
            else:
                high = part - 1
        part, above, node = low, None, self.root
        while type(node) is tuple and node[0] < part:
            above, node = node, node[1][s[node[0]]]
        letter = s[part] if part < len(s) else -1
        if type(node) is tuple and node[0] == part:
            node[1][letter] = [s, [member]]
            return
        fork = (part, {known[part] if part < len(known) else -1: node, letter: [s, [member]]})
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        """Members of each leaf, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            elif node is not None:
                yield node[1]


def deep_shallow(group: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start : start + length] inside their groups, and a mark where a string differs from the one before."""
    n = len(start)
    padded = np.concatenate([data, np.zeros(SHALLOW, np.uint8)])
    take = np.minimum(length, SHALLOW)
    head = padded[start[:, None] + np.arange(SHALLOW)]
    head[np.arange(SHALLOW) >= take[:, None]] = 0
    words = np.ascontiguousarray(head).view(">u8").astype(np.uint64)
    order = np.lexsort((*[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], group))  # shallow
    g, w = group[order], words[order]
    new = np.ones(n, bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1]).any(axis=1)
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.r_[firsts, n])
    raw, at, size = data.tobytes(), start.tolist(), length.tolist()
    for a, m in zip(firsts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):  # deep
        members = order[a : a + m].tolist()
        one = raw[at[members[0]] : at[members[0]] + size[members[0]]]
        if all(raw[at[x] : at[x] + size[x]] == one for x in members[1:]):
            continue  # a trie of one leaf
        trie = BlindTrie()
        for x in members:
            trie.insert(raw[at[x] : at[x] + size[x]], x)
        b = a
        for leaf in trie.leaves():
            order[b : b + len(leaf)] = leaf
            new[b] = True
            b += len(leaf)
    return order, new


# --- passes over the documents --------------------------------------------------------------------------------------


def _fingerprints(piece: pa.RecordBatch, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' fingerprints, and the hashes of the texts around them."""
    keep = []
    for k, key in _keys(piece):  # any copy has its text's fingerprints
        if key not in seen:
            seen.add(key)
            keep.append(k)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for data, offsets, _, _ in _segments(piece.take(pa.array(keep, pa.int64()))):
        fp, row, first, last = anchors(data, offsets)
        order = np.lexsort((row, fp))
        once = np.ones(len(fp), bool)  # what comes twice in one document alone takes nothing from it
        once[1:] = (fp[order][1:] != fp[order][:-1]) | (row[order][1:] != row[order][:-1])
        i = order[once]
        found.append((fp[i], span_hashes(prefix_hashes(data), first[i], last[i] + LENGTH)))
    return tuple(map(np.concatenate, zip(*found)))


SENT = "bucket int, kind byte, rows int, size long, blob binary"
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("rows", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])
CONTEXT, WINDOW, DONE = 0, 1, 2
_HALF = np.uint64(32)


class Rows:
    """Strings by key and document: a text of `size` bytes (one after the other in `data`), and the `count` places `start` where the document has it."""

    #: Kinds of the columns in a blob; keys are shortened to 4 bytes, beside the bucket.
    KINDS = (("key", "<u4"), ("doc", "<i8"), ("t", "<i4"), ("size", "u1"), ("count", "<u4"))

    def __init__(self, key, doc, t, size, count, start, data):
        self.key, self.doc, self.t, self.size, self.count, self.start, self.data = key, doc, t, size, count, start, data

    def pack(self) -> tuple[int, bytes]:
        """Bytes of the numbers, and a blob: the numbers' bytes, first ones first, with sorted keys as differences; then the text, which compresses better alone."""
        columns = [np.diff(self.key.astype(np.uint32), prepend=np.uint32(0)), *(getattr(self, name).astype(kind) for name, kind in self.KINDS[1:]), self.start.astype("<i4")]
        planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
        codec, text = pa.Codec("zstd", LEVEL), self.data.tobytes()
        numbers = codec.compress(planes, asbytes=True)
        return len(planes), len(numbers).to_bytes(4, "little") + numbers + (codec.compress(text, asbytes=True) if text else b"")

    @classmethod
    def unpack(cls, n: int, size: int, blob: bytes) -> Rows:
        codec, cut = pa.Codec("zstd"), 4 + int.from_bytes(blob[:4], "little")
        raw, at, found = np.frombuffer(codec.decompress(blob[4:cut], size, asbytes=True), np.uint8), 0, []

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize
            at += width * n
            return np.ascontiguousarray(raw[at - width * n : at].reshape(width, n).T).view(kind).ravel()

        found = [column(kind, n) for _, kind in cls.KINDS]
        start = column("<i4", int(found[4].sum()))
        text = np.frombuffer(codec.decompress(blob[cut:], int(found[3].sum(dtype=np.int64)), asbytes=True), np.uint8) if len(blob) > cut else np.zeros(0, np.uint8)
        return cls(np.cumsum(found[0], dtype=np.uint32), *found[1:], start, text)

    def slices(self) -> list[Rows]:
        """SLICES parts by key; keys must be sorted."""
        edges = [0, *np.searchsorted(self.key, (np.arange(1, SLICES, dtype=np.uint64) << _HALF) // np.uint64(SLICES)).tolist(), len(self.key)]
        places, text = np.r_[0, np.cumsum(self.count, dtype=np.int64)], np.r_[0, np.cumsum(self.size, dtype=np.int64)]
        if not len(self.data):
            text[:] = 0
        return [Rows(*(c[x:y] for c in (self.key, self.doc, self.t, self.size, self.count)), self.start[places[x] : places[y]], self.data[text[x] : text[y]]) for x, y in zip(edges, edges[1:])]

    @classmethod
    def together(cls, parts: list[Rows]) -> Rows:
        key, doc, t, size, count, start, data = (np.concatenate([getattr(p, n) for p in parts]) for n in ("key", "doc", "t", "size", "count", "start", "data"))
        return cls(key, doc, t, size.astype(np.int64), count.astype(np.int64), start.astype(np.int64), data)


def _packed(buckets: int, kind: int, rows: Rows, at: np.ndarray | None, data: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key as one blob for each bucket; at: where a row's text begins in data."""
    many, low = np.uint64(buckets), np.uint64(0xFFFFFFFF)
    spread = (rows.key >> _HALF) * many + ((rows.key & low) * many >> _HALF)  # the bucket, and 32 bits of the key in it; in order, as keys are
    edges = np.searchsorted(spread >> _HALF, np.arange(buckets + 1, dtype=np.uint64))
    key = (spread & low).astype(np.uint32)
    places = np.r_[0, np.cumsum(rows.count)]
    out = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        x, y = int(edges[b]), int(edges[b + 1])
        size = rows.size[x:y].astype(np.int64)
        ends = np.cumsum(size)
        text = data[np.repeat(at[x:y] - (ends - size), size) + np.arange(int(ends[-1]))] if data is not None else np.zeros(0, np.uint8)
        part = Rows(key[x:y], rows.doc[x:y], rows.t[x:y], rows.size[x:y], rows.count[x:y], rows.start[places[x] : places[y]], text)
        out.append((b, kind, y - x, *part.pack()))
        if len(out) >= 64:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), ROWS)], schema=ROWS)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), ROWS)], schema=ROWS)


class Held:
    """Contexts of a task: equal ones under one key are met here already, so that one of each, of the smallest document, is sent with its bytes.

    What is left of the hot ones is cut into windows, and those are met in the same way.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.text: list[np.ndarray] = []
        self.size = self.rows = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> None:
        """columns: key, hash of the bytes, document, its text's hash, start in the document, start in the bytes that close() gets, length, whether the key is hot."""
        key, text, doc, t, start, at, size, hot = columns
        self.parts.append((key, text, doc, t, *(x.astype(np.int32) for x in (start, at + self.size, size)), hot))
        self.rows += len(key)

    def close(self, data: np.ndarray) -> None:
        """data holds what add() pointed to."""
        self.text.append(data)
        self.size += len(data)

    def merged(self) -> Iterator[pa.RecordBatch]:
        data, done = np.concatenate([*self.text, np.zeros(WIDTH, np.uint8)]), []
        self.text.clear()
        if self.parts:
            columns = tuple(map(np.concatenate, zip(*self.parts)))
            self.parts.clear()
            hot = columns[-1]
            for kind, pick in ((WINDOW, hot), (CONTEXT, ~hot)):
                rows, at = _met(data, *(x[pick] for x in columns[:-1]), done)
                if kind == CONTEXT:
                    yield from _packed(self.buckets, kind, rows, at, data)
                    continue
                places = np.r_[0, np.cumsum(rows.count)]
                part = places[:-1] // SENT_AT_ONCE
                for i in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
                    x, y = int(i[0]), int(i[-1]) + 1
                    some = Rows(rows.key[x:y], rows.doc[x:y], rows.t[x:y], rows.size[x:y], rows.count[x:y], rows.start[places[x] : places[y]], None)
                    yield from _packed(self.buckets, kind, *_met(data, *_windows(data, some, at[x:y]), done), data)
        if done:
            doc, t, start, stop = _joined(*map(np.concatenate, zip(*done)))
            key = mix(doc.astype(np.uint64))
            order = np.argsort(key)
            key, doc, t, start, stop = (x[order] for x in (key, doc, t, start, stop))
            both = np.stack([start, stop], axis=1).ravel()
            yield from _packed(self.buckets, DONE, Rows(key, doc, t, np.zeros(len(doc)), np.full(len(doc), 2), both, None), None, None)
        self.__init__(self.buckets)


def _met(data: np.ndarray, key, text, doc, t, start, at, size, done: list) -> tuple[Rows, np.ndarray]:
    """Of equal texts under one key, the smallest document's, sorted by key, and where they begin in data; done gets what the others lose."""
    order = np.lexsort((start, t, doc, text, key))
    key, text, doc, t, start, at, size = (x[order] for x in (key, text, doc, t, start, at, size))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    equal = np.zeros(len(key), bool)
    equal[~new] = _equal(data, at[~new], size[~new], at[first[~new]], size[first[~new]])
    late = equal & (doc > doc[first])
    done.append((doc[late], t[late], start[late], start[late] + size[late]))
    again = equal & (doc == doc[first]) & (t == t[first])  # the first's document has it here too
    row = ~late & ~again
    i, kept = np.flatnonzero(row), start[~late]
    count = np.diff(np.r_[np.flatnonzero(row[~late]), len(kept)])
    return Rows(key[i], doc[i], t[i], size[i], count, kept, None), at[i].astype(np.int64)


def _windows(data: np.ndarray, rows: Rows, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The LENGTH-byte strings of rows' texts, at all their places, under their own hashes: columns for _met()."""
    ups, downs = powers(WIDTH + 1)
    codes, found = mix(np.arange(256, dtype=np.uint64) + np.uint64(1)), []
    for k in range(0, len(at), SENT_AT_ONCE):
        sums = np.zeros((len(at[k : k + SENT_AT_ONCE]), WIDTH + 1), np.uint64)
        np.cumsum(codes[data[at[k : k + SENT_AT_ONCE, None] + np.arange(WIDTH)]] * ups[:WIDTH], axis=1, out=sums[:, 1:])
        found.append(mix((sums[:, LENGTH:] - sums[:, :-LENGTH]) * downs[: WIDTH - LENGTH + 1] + np.uint64(LENGTH)))
    hashes = np.concatenate(found)
    of = np.repeat(np.arange(len(at)), rows.count)  # places
    many = (rows.size - LENGTH + 1)[of].astype(np.int64)
    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row = np.repeat(of, many)
    text = hashes[row, shift]
    return text, text, rows.doc[row], rows.t[row], (np.repeat(rows.start, many) + shift).astype(np.int32), (at[row] + shift).astype(np.int32), np.full(len(row), LENGTH, np.int32)


def _equal(data: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the bytes data[a : a + n] and data[b : b + m] are equal."""
    out, views = n == m, np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    for k in range(0, len(a), SENT_AT_ONCE):
        s = slice(k, k + SENT_AT_ONCE)
        out[s] &= ((views[a[s]] == views[b[s]]) | (np.arange(WIDTH) >= n[s, None])).all(axis=1)
    return out


def _candidates(docs: DataFrame, words: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """Rows (bucket, kind, rows, size, blob): what the documents hold under repeated fingerprints, packed by bucket; there are PER_PART buckets for each partition, about."""
    bits = bucket_bits(parts)
    shared = docs.sparkSession.sparkContext.broadcast((words, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = shared.value
        seen: dict[bytes, int] = {}
        held = Held(parts * PER_PART)
        for piece in text_chunks(batches):
            piece = _unseen(piece, seen)
            ids, ts = piece.column("id").to_numpy(), piece.column("t").to_numpy()
            for data, offsets, rows, base in _segments(piece):
                fp, row, first, last = anchors(data, offsets)
                hit = passes(known, fp, bits)
                fp, row, first, last = fp[hit], row[hit], first[hit], last[hit]
                if not len(fp):
                    continue
                sums = prefix_hashes(data)
                named = shortened(fp, bits)
                is_hot = np.isin(named, hot) if len(hot) else np.zeros(len(fp), bool)
                a, b = first, last + LENGTH
                held.add(fp, span_hashes(sums, a, b), ids[rows[row]], ts[rows[row]], a - offsets[row] + base[row], a, b - a, is_hot)
                held.close(data)
                if held.size >= TEXT_AT_ONCE or held.rows >= HELD_ROWS:
                    yield from held.merged()
        yield from held.merged()

    return docs.where("id is not null").mapInArrow(run, SENT)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by bucket: documents (doc, t) and the ranges in them that a smaller document has too."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(f.name).to_pylist() for f in ROWS)):
            if held and row[0] != held[0][0]:
                yield _resolved(held)
                held = []
            held.append(row)
    if held:
        yield _resolved(held)


def _resolved(blobs: list[tuple]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none)]
    for kind in (CONTEXT, WINDOW, DONE):
        parts = [Rows.unpack(*x[2:]).slices() for x in blobs if x[1] == kind]
        for rows in map(Rows.together, zip(*parts)):
            out += [(rows.doc, rows.t, rows.start[::2], rows.start[1::2])] if kind == DONE else _taken(rows, kind)
    return _by_document(*(np.concatenate(x).astype(np.int64) for x in zip(*out)))


RANGES = "doc long, t int, ranges binary"


def _by_document(doc, t, start, stop) -> pa.RecordBatch:
    """A row (doc, t, ranges) for each document: starts and stops of its joined ranges by turns, as 4 bytes each."""
    doc, t, start, stop = _joined(doc, t, start, stop)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    ends = pa.py_buffer((8 * np.r_[first, len(doc)]).astype(np.int32).tobytes())
    raw = pa.py_buffer(np.stack([start, stop], axis=1).astype("<i4").tobytes())
    return pa.record_batch([pa.array(doc[first]), pa.array(t[first].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, ends, raw])], names=["doc", "t", "ranges"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, t, a list of ranges): the lists' ranges joined."""
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("ranges")
            lengths = [sum(map(len, x)) // 8 for x in lists.to_pylist()]
            both = np.frombuffer(b"".join(lists.flatten().to_pylist()), "<i4").astype(np.int64).reshape(-1, 2)
            yield _by_document(*(np.repeat(batch.column(c).to_numpy().astype(np.int64), lengths) for c in ("doc", "t")), both[:, 0], both[:, 1])


def _taken(rows: Rows, kind: int) -> list[tuple[np.ndarray, ...]]:
    """What smaller documents take of the rows' documents, by sorting the texts and then their suffixes."""
    out = []
    _, group, many = np.unique(rows.key, return_inverse=True, return_counts=True)
    live = np.flatnonzero(many[group] > 1)
    if not len(live):
        return out
    group, doc, size = group[live], rows.doc[live], rows.size[live]
    at = (np.cumsum(rows.size) - rows.size)[live]
    place = np.r_[0, np.cumsum(rows.count)]

    def ranges(row: np.ndarray, shift: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """A part of live rows' texts, at all places where their documents have them."""
        row = live[row]
        n = rows.count[row]
        start = rows.start[np.repeat(place[row], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] + np.repeat(shift, n)
        return np.repeat(rows.doc[row], n), np.repeat(rows.t[row], n), start, start + np.repeat(length, n)

    order, new = deep_shallow(group, rows.data, at, size)
    late = _late(doc, order, new)
    lost = order[late]
    out.append(ranges(lost, np.zeros(len(lost), np.int64), size[lost]))
    if kind == WINDOW:
        return out
    # where an anchor has several texts, those of each text's smallest id go on to the suffixes
    one, holder = order[new], order[~late]
    g, several = np.unique(group[one], return_counts=True)
    holder = holder[several[np.searchsorted(g, group[holder])] > 1]
    holder = holder[np.argsort(group[holder], kind="stable")]
    before = np.cumsum(size[holder] - LENGTH + 1) - (size[holder] - LENGTH + 1)
    opens = np.r_[True, np.diff(group[holder]) != 0][: len(holder)]
    piece = np.maximum.accumulate(np.where(opens, before, 0)) // SUFFIXES_AT_ONCE  # whole groups
    for part in np.split(holder, np.flatnonzero(np.diff(piece)) + 1):
        n = size[part] - LENGTH + 1
        own = np.repeat(part, n)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, new = deep_shallow(group[own], rows.data, at[own] + shift, np.full(len(own), LENGTH))
        lost = order[_late(doc[own], order, new)]
        out.append(ranges(own[lost], shift[lost], np.full(len(lost), LENGTH)))
    return out


def _late(doc: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Marks, in this order, of strings that a smaller document has too."""
    if not len(order):
        return np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc[order], firsts), np.diff(np.r_[firsts, len(order)]))
    return doc[order] > least


def _joined(doc, t, start, stop):
    """Overlapping and touching ranges of a document as one."""
    if not len(doc):
        return doc, t, start, stop
    order = np.lexsort((start, t, doc))
    doc, t, start, stop = doc[order], t[order], start[order], stop[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
    far = int(stop.max()) + 1
    part = np.cumsum(other)
    reach = np.maximum.accumulate(stop + part * far) - part * far  # furthest stop so far in the document
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    a = np.flatnonzero(new)
    return doc[a], t[a], start[a], np.maximum.reduceat(stop, a)


def filter_bits(n_bytes: int) -> int:
    """Bits of the filter for so much text, as a power of two: about one in 180 bytes starts a repeated anchor, so that one bit in 30 to 60 is set until FILTER_MOST is reached."""
    return min(max((n_bytes // 5).bit_length(), FILTER_BITS), FILTER_MOST)


def repeated(docs: DataFrame, hot_from: int = HOT, n_bytes: int = 0) -> DataFrame:
    """Rows (doc, t, ranges) for docs (id, t, text) of n_bytes together, t a hash of the text; copies of whole texts inside one task are left to dedup()."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words, hot = repeated_filter(docs.where("id is not null").select("text"), _fingerprints, parts, hot_from, filter_bits(n_bytes))
    sent = _candidates(docs, words, hot, parts).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    found = sent.mapInArrow(_resolve, RANGES)
    return found.groupBy("doc", "t").agg(F.collect_list("ranges").alias("ranges")).mapInArrow(_gathered, RANGES)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_from: int = HOT, digests_only: bool = False) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, removed, kept, kept_sha256), one for each of docs; other columns are not read.

    removed holds the byte ranges (start, stop); kept, the remaining bytes, is null where nothing was removed, and everywhere with
    digests_only. key must be a number.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = materialize(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id"), "again")
    # unique ids need no hash beside them
    docs = docs.withColumn("t", F.lit(0)) if again.isEmpty() else passing(docs, again, ["id"], "twice").select("id", "text", F.when(F.col("twice"), F.hash("text")).otherwise(0).alias("t"))
    about = docs.select("id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    origin = about.groupBy("sha").agg(F.min("id").alias("origin"), F.count("*").alias("n")).where("n > 1").select("sha", "origin")
    about = about.join(origin, "sha", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("origin"), F.lit(False)) & (F.col("n_bytes") >= LENGTH))
    about = materialize(about.drop("origin"), "about")

    # copies go whole, and need not be scanned: what they hold, their origin has. A row is left out if it passes the filter of the copies
    # and not that of the other rows that pass it, so that no other row is ever left out.
    copies, others = about.where("copy"), about.where("not copy")
    n_bytes = others.agg(F.sum("n_bytes")).first()[0] or 0
    mistaken = passing(others, copies, ["id", "t"], "maybe").where("maybe")
    flagged = passing(passing(docs, copies, ["id", "t"], "maybe"), mistaken, ["id", "t"], "mistaken")
    ranges = materialize(repeated(flagged.where("id is not null and (not maybe or mistaken)").select("id", "t", "text"), hot_from, n_bytes), "ranges")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw, ranges_ in zip(pdf["text"], pdf["ranges"]):
                raw = raw.encode()
                a, b = np.frombuffer(ranges_, "<i4").reshape(-1, 2).T
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw) - len(kept), [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())], None if digests_only else kept, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_removed", "removed", "kept", "kept_sha256"])
            yield pd.concat([pdf[["id", "t"]].reset_index(drop=True), out], axis=1)

    texts = passing(docs.where("id is not null"), ranges.select(F.col("doc").alias("id"), "t"), ["id", "t"], "asked").where("asked").select("id", "t", "text")
    wanted = texts.join(ranges, (texts["id"] == ranges["doc"]) & (texts["t"] == ranges["t"])).select(texts["id"], texts["t"], "text", "ranges").dropDuplicates(["id", "t"])
    done = wanted.mapInPandas(cut, "id long, t int, n_removed long, removed array<struct<start:int,stop:int>>, kept binary, kept_sha256 string")
    out = about.join(done, ["id", "t"], "left")
    copy = F.col("copy")
    removed = F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))).otherwise(F.coalesce("removed", F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        removed.alias("removed"),
        F.when(copy & F.lit(not digests_only), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
