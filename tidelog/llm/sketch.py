"""A filter of fingerprints that come more than once, of a size that the caller bounds.

Tasks send their fingerprints shortened to 5 bytes, sorted by buckets of the top bits. A bucket's task counts them and sets a bit for each
repeated one, in the bucket's own part of a Bloom filter of 2**FILTER_BITS bits (8 MB), or of as many as the caller asks for. The filter lets every repeated
fingerprint through; others that it lets through cost work, never results, so exact steps must follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

FILTER_BITS, LOW_BITS, HOT_MOST = 26, 40, 65_536
_LOW = np.uint64((1 << LOW_BITS) - 1)


def bucket_bits(parts: int) -> int:
    return max(1, min(12, (parts - 1).bit_length()))


def shortened(fp: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and low bits in one number."""
    return (fp >> np.uint64(64 - bits) << np.uint64(LOW_BITS)) | (fp & _LOW)


def passes(words: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    rest = len(words).bit_length() + 5 - bits  # there are 2**(rest + bits) bits
    spot = ((fp >> np.uint64(64 - bits) << np.uint64(rest)) | ((fp & _LOW) >> np.uint64(LOW_BITS - rest))).astype(np.int64)
    return (words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _twice(fp: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Sorted fp, of each pair (fp, beside) two at most."""
    order = np.lexsort((beside, fp))
    fp, beside = fp[order], beside[order]
    third = np.zeros(len(fp), bool)
    third[2:] = (fp[2:] == fp[:-2]) & (beside[2:] == beside[:-2])
    return fp[~third]


def repeated_filter(docs: DataFrame, fingerprints: Callable[[pa.RecordBatch, set], np.ndarray], parts: int, hot_from: int, filter_bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The filter's words, and the shortened fingerprints seen hot_from times or more (the commonest HOT_MOST, about).

    fingerprints gets a piece of docs and a set that lives as long as the task, and gives 64-bit numbers; or a pair of arrays, numbers and
    what stands with each: then equal pairs that stand together in a task are sent twice at most, which is enough to be repeated.
    """
    bits = bucket_bits(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[np.ndarray] = []
        beside: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            fp = shortened(np.concatenate(held), bits) if held else np.zeros(0, np.uint64)
            fp = _twice(fp, np.concatenate(beside)) if beside else np.sort(fp)
            held.clear()
            beside.clear()
            edges = np.searchsorted(fp >> np.uint64(LOW_BITS), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
            five = np.ascontiguousarray(fp.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            filled = [(b, five[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]
            return pa.record_batch([pa.array([b for b, _ in filled], pa.int32()), pa.array([x for _, x in filled], pa.binary())], names=["bucket", "blob"])

        for piece in text_chunks(batches):
            found = fingerprints(piece, seen)
            held.append(found[0] if isinstance(found, tuple) else found)
            if isinstance(found, tuple):
                beside.append(found[1])
            if sum(map(len, held)) > 500_000:
                yield packed()
        yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                blobs.setdefault(b, []).append(blob)
        for b, own in blobs.items():
            raw = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 5)
            whole = np.zeros((len(raw), 8), np.uint8)
            whole[:, :5] = raw
            low, count = np.unique(whole.view("<u8").ravel().astype(np.uint64), return_counts=True)
            rest = filter_bits - bits
            words = np.zeros(1 << (rest - 6), np.uint64)
            at = (low[count > 1] >> np.uint64(LOW_BITS - rest)).astype(np.int64)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            often = np.argsort(-count, kind="stable")[: HOT_MOST >> bits]
            hot = low[often][count[often] >= hot_from] | (np.uint64(b) << np.uint64(LOW_BITS))
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())], names=["bucket", "words", "hot"])

    sent = docs.mapInArrow(send, "bucket int, blob binary").repartition(max(parts, 2), "bucket")
    found = sent.mapInArrow(meet, "bucket int, words binary, hot binary").collect()  # 2**filter_bits bits and HOT_MOST numbers at most
    words = np.zeros(1 << (filter_bits - 6), np.uint64)
    span = len(words) >> bits
    for r in found:
        words[r["bucket"] * span : (r["bucket"] + 1) * span] = np.frombuffer(r["words"], np.uint64)
    return words, np.sort(np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in found] or [np.zeros(0, np.uint64)]))
