"""Datasets: a message table with a dense id, and the fields that index it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.positions import dense_ids
from tidelog.plans.compiler import MessageColumns, as_column, key_test
from tidelog.plans.rel import Ids, Key, KeyPred, KeyRange, Rel, Stream

#: Of a field's references, the share of the log up to which a lookup goes through the postings table.
SELECTIVE = 0.001


@dataclass(frozen=True)
class FieldSpec:
    """column: where the messages hold the keys (None: in the postings alone); multi: the column is an array of keys."""

    column: str | None
    multi: bool = False
    codec: str = "native"


class Dataset:
    """A readable log. Wrap any table with a unique, ordered id, or open() a stored one."""

    def __init__(self, messages: DataFrame, fields: dict[str, str | FieldSpec], msg_id: str = "msg_id", dense: bool = True, path: str | None = None, loader: Callable[[Column], Column] | None = None, length: int | None = None):
        self.messages, self.msg_id, self.dense, self.path, self.loader = messages, msg_id, dense, path, loader
        self.spark = messages.sparkSession
        arrays = {c for c, kind in messages.dtypes if kind.startswith("array")}
        self.fields = {n: s if isinstance(s, FieldSpec) else FieldSpec(s, s in arrays) for n, s in fields.items()}
        self._length = length
        self._access = "auto"
        self._n_refs: dict = {}  # what the dictionary said; a stored dataset does not change under a reader

    # --- whole log
    @property
    def stream(self) -> Rel:
        return Stream(self)

    @property
    def idx(self) -> Index:
        return Index(self)

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.messages.count()
        return self._length

    def __iter__(self) -> Iterator[Row]:
        return iter(self.stream)

    def __getitem__(self, item):
        return self.stream[item]

    def __call__(self, predicate=None, **fields) -> Rel:
        """ds(predicate), ds(field=key) or both."""
        out = self.stream if predicate is None else self.stream(predicate)
        return out & self.idx(**fields) if fields else out

    def ids_of(self, frame: DataFrame) -> Rel:
        """A set from a DataFrame that has the id column."""
        return Ids(self, frame)

    def number_range(self, first: int, last: int) -> Rel:
        """Messages by 1-based numbers, both ends included."""
        return self.stream[max(first - 1, 0) : max(last, 0)]

    def loaded(self, frame: DataFrame | None = None, name: str = "msg") -> DataFrame:
        """Messages with the loader's result as one more column."""
        frame = self.messages if frame is None else frame
        return frame.withColumn(name, self.loader(F.col("raw"))) if self.loader else frame

    def close(self) -> None:
        """Nothing is held open; here for symmetry."""

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- access paths
    def access(self, path: str) -> Dataset:
        """The same dataset with one access path for keys: 'scan', 'postings' or 'auto'."""
        if path not in ("scan", "postings", "auto"):
            raise ValueError(path)
        out = Dataset(self.messages, dict(self.fields), self.msg_id, self.dense, self.path, self.loader, self._length)
        out._access, out._n_refs = path, self._n_refs
        return out

    @staticmethod
    def decoded(spec: FieldSpec, key: Column) -> Column:
        """A stored key as its value."""
        if spec.codec == "native":
            return key
        from tidelog.functions.codecs import CODECS

        return CODECS[spec.codec].load(key)

    def postings(self, name: str) -> DataFrame:
        """Rows (key, msg_id) of a field without repeats; from the stored table, or from the messages."""
        spec = self.fields[name]
        if self.path:
            return self._keyed(spec, f"{self.path}/postings/field={name}")
        rows = self.messages.select(F.col(f"`{spec.column}`").alias("key"), self.msg_id)
        if spec.multi:
            rows = rows.select(F.explode(F.array_distinct("key")).alias("key"), self.msg_id)
        return rows.where("key is not null").withColumn("key", self.decoded(spec, F.col("key")))

    def _keyed(self, spec: FieldSpec, path: str) -> DataFrame:
        rows = self.spark.read.parquet(path)
        return rows if spec.codec == "native" else rows.withColumn("key", self.decoded(spec, F.col("key")))

    def key_stats(self, name: str) -> DataFrame:
        """Rows (key, n_refs, min_ref, max_ref): the field's dictionary."""
        if self.path:
            return self._keyed(self.fields[name], f"{self.path}/keystats/field={name}")
        return stats_of(self.postings(name), self.msg_id)

    @property
    def has_index(self) -> bool:
        return self.path is not None and self._access != "scan"

    def n_refs(self, rel: Rel) -> int | None:
        """References of a lookup's keys, from the stored dictionary; None if there is none."""
        if rel.name not in self.fields:
            raise KeyError(rel.name)
        if not self.path or (isinstance(rel, Key) and len(rel.keys) > 100):
            return None
        key = (rel.name, rel.keys) if isinstance(rel, Key) else (rel.name, rel.low, rel.high, "range")
        if key not in self._n_refs:
            found = self.key_stats(rel.name).where(key_test(rel)(F.col("key"))).agg(F.sum("n_refs")).first()[0]
            self._n_refs[key] = found or 0
        return self._n_refs[key]

    def selective(self, refs: int | None) -> bool:
        """Whether a set of so many messages at most is better found through postings."""
        return refs is not None and (self._access == "postings" or refs <= SELECTIVE * len(self))

    def use_postings(self, rel: Rel) -> bool:
        if rel.name not in self.fields:
            raise KeyError(rel.name)
        if self.fields[rel.name].column is None or self._access == "postings":
            return True
        return self.has_index and self.selective(self.n_refs(rel))


def stats_of(postings: DataFrame, msg_id: str = "msg_id") -> DataFrame:
    return postings.groupBy("key").agg(F.count("*").alias("n_refs"), F.min(msg_id).alias("min_ref"), F.max(msg_id).alias("max_ref"))


class Index:
    """The fields of a dataset: by name, by position, or by keyword conditions joined with AND."""

    def __init__(self, ds: Dataset):
        self._ds = ds

    def keys(self) -> list[str]:
        return sorted(self._ds.fields)

    fields = keys

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self._ds.fields)

    def __contains__(self, name: str) -> bool:
        return name in self._ds.fields

    def __getitem__(self, item):
        if isinstance(item, (int, slice)):
            return self[self.keys()[item]] if isinstance(item, int) else [self[n] for n in self.keys()[item]]
        if item not in self._ds.fields:
            raise KeyError(item)
        return FieldHandle(self._ds, item)

    def __getattr__(self, name: str) -> FieldHandle:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def dictionaries(self) -> DataFrame:
        """Rows (field, key, n_refs) of all fields, keys as text."""
        parts = [self[n].stats().select(F.lit(n).alias("field"), F.col("key").cast("string").alias("key"), "n_refs") for n in self.keys()]
        return reduce(DataFrame.union, parts)

    def __call__(self, **conditions) -> Rel:
        """Each keyword is a field; its value a key, a list of keys or a predicate on keys."""
        parts = []
        for name, value in conditions.items():
            handle = self[name]
            if callable(value):
                parts.append(handle(value))
            elif isinstance(value, (list, tuple, set, frozenset)):
                parts.append(Key(self._ds, name, tuple(value)))
            else:
                parts.append(handle[value])
        return reduce(lambda a, b: a & b, parts) if parts else self._ds.stream


class FieldHandle:
    """One field: its dictionary of keys, and lookups."""

    def __init__(self, ds: Dataset, name: str):
        self._ds, self._name = ds, name

    # --- sets of messages
    def __getitem__(self, key) -> Rel:
        """Messages with the key; a slice of keys is a range, both ends included."""
        if isinstance(key, slice):
            return KeyRange(self._ds, self._name, key.start, key.stop)
        return Key(self._ds, self._name, (key,))

    lookup = __getitem__

    def __call__(self, *args):
        """A predicate gives messages; two bounds give the keys between them, both included."""
        if len(args) == 2:
            return self.between(*args)
        return KeyPred(self._ds, self._name, args[0])

    def any(self) -> Rel:
        return KeyPred(self._ds, self._name, None)

    def missing(self) -> Rel:
        """Messages without the field."""
        return self._ds.stream - self.any()

    def eval(self, predicate) -> Rel:
        """The same as a call, but judged on every message, without the index."""
        column = self._ds.fields[self._name].column
        probe = as_column(predicate, F.col(column))
        if isinstance(probe, Column):
            return self._ds.stream(probe)

        def on_message(m):
            return m[column] is not None and predicate(m[column])

        on_message.plain_python = True
        return self._ds.stream(on_message)

    def __and__(self, other):
        return self.any() & other

    def __or__(self, other):
        return self.any() | other

    def __sub__(self, other):
        return self.any() - other

    def __xor__(self, other):
        return self.any() ^ other

    # --- the dictionary
    def stats(self) -> DataFrame:
        return self._ds.key_stats(self._name)

    def keys(self) -> list:
        """All keys in order, on the driver; use stats() for large dictionaries."""
        return [_plain(r["key"]) for r in self.stats().select("key").orderBy("key").toLocalIterator()]

    values = keys

    def __iter__(self):
        return iter(self.keys())

    def items(self) -> Iterator[tuple]:
        return ((_plain(r["key"]), r["n_refs"]) for r in self.stats().orderBy("key").toLocalIterator())

    def __len__(self) -> int:
        return self.stats().count()

    def approx_len(self) -> int:
        return self._ds.postings(self._name).agg(F.approx_count_distinct("key")).first()[0]

    def __contains__(self, key) -> bool:
        return not self.stats().where(F.col("key") == F.lit(key)).isEmpty()

    def n_refs(self, key) -> int:
        found = self.stats().where(F.col("key") == F.lit(key)).select("n_refs").take(1)
        return found[0][0] if found else 0

    def total_refs(self) -> int:
        return self.stats().agg(F.coalesce(F.sum("n_refs"), F.lit(0))).first()[0]

    def ranked(self) -> DataFrame:
        """(key, pos): the keys' places in key order."""
        return dense_ids(self.stats().select("key"), ["key"], "pos").select("key", F.col("pos").cast("long").alias("pos"))

    def key_at(self, i: int):
        order, skip = (F.asc("key"), i) if i >= 0 else (F.desc("key"), -i - 1)
        found = self.stats().select("key").orderBy(order).offset(skip).take(1)
        if not found:
            raise IndexError(i)
        return _plain(found[0][0])

    def every(self, k: int, start: int = 0) -> DataFrame:
        return self.ranked().where((F.col("pos") >= start) & ((F.col("pos") - start) % k == 0)).select("key")

    def sample(self, n: int, seed: int = 0) -> list:
        return [_plain(r["key"]) for r in self.stats().select("key").orderBy(F.xxhash64(F.lit(seed), "key"), "key").take(n)]

    def top(self, n: int) -> DataFrame:
        """The n commonest keys; of equals, the greater key first."""
        return self.stats().select("key", "n_refs").orderBy(F.desc("n_refs"), F.desc("key")).limit(n)

    def low(self):
        return _plain(self.stats().agg(F.min("key")).first()[0])

    def high(self):
        return _plain(self.stats().agg(F.max("key")).first()[0])

    def between(self, low, high) -> DataFrame:
        return self.stats().where(F.col("key").between(F.lit(low), F.lit(high)))

    def link_stats(self) -> DataFrame:
        """One row (nlinks, nmsgs, nvals, surjective): links, messages and keys; surjective if no message has two keys."""
        by_message = self._ds.postings(self._name).groupBy(self._ds.msg_id).agg(F.count("*").alias("n"))
        one = by_message.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nlinks"), F.count("*").alias("nmsgs"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("surjective"))
        return one.crossJoin(self.stats().agg(F.count("*").alias("nvals"))).select("nlinks", "nmsgs", "nvals", "surjective")  # two single rows

    def mapping(self) -> str:
        return "1:1" if self.link_stats().first()["surjective"] else "1:many"


def _plain(x: Any) -> Any:
    return bytes(x) if isinstance(x, bytearray) else x


def open_dataset(spark: SparkSession, path: str, loader: Callable[[Column], Column] | None = None) -> Dataset:
    """Open a stored dataset; its fields come from its own metadata."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").orderBy(F.desc("version")).first()["meta"])
    messages = spark.read.parquet(f"{path}/messages")
    fields = {n: FieldSpec(**s) for n, s in meta["fields"].items()}
    if loader is None and meta.get("codec"):
        from tidelog.functions.codecs import CODECS

        loader = CODECS[meta["codec"]].load
    return Dataset(messages.drop("segment"), fields, "msg_id", True, path, loader, meta["n"])


__all__ = ["Dataset", "FieldHandle", "FieldSpec", "Index", "MessageColumns", "open_dataset", "stats_of"]
