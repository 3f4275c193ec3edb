"""Query trees: immutable descriptions of ordered sets of message ids.

A node says which ids belong to a set; nothing runs before an action (iteration, len, an integer index, collect). Every set is
ordered by id. Nodes can be shared and iterated any number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tidelog.sources.dataset import Dataset


@dataclass(frozen=True, eq=False)
class Rel:
    """A lazy set of messages of one dataset."""

    ds: Dataset = field(repr=False)

    # set algebra
    def __and__(self, other) -> Rel:
        return SetOp(self.ds, "and", self, as_rel(other))

    def __or__(self, other) -> Rel:
        return SetOp(self.ds, "or", self, as_rel(other))

    def __sub__(self, other) -> Rel:
        return SetOp(self.ds, "sub", self, as_rel(other))

    def __xor__(self, other) -> Rel:
        return SetOp(self.ds, "xor", self, as_rel(other))

    def __invert__(self) -> Rel:
        """All messages that are not in this set."""
        return SetOp(self.ds, "sub", Stream(self.ds), self)

    # predicates and slices
    def __call__(self, predicate: Callable[[Any], Any] | Column) -> Rel:
        return Filter(self.ds, self, predicate)

    def __getitem__(self, item):
        if isinstance(item, slice):
            if item.step == 0:
                raise ValueError("slice step cannot be zero")
            return Slice(self.ds, self, item.start, item.stop, item.step)
        from .compiler import at_position

        return at_position(self, item)

    def head(self, n: int = 10) -> Rel:
        return self[:n]

    def tail(self, n: int = 10) -> Rel:
        return self[-n:] if n else self[:0]

    # results
    def ids(self) -> DataFrame:
        """The set as a DataFrame with the id column alone, in no particular order."""
        from .compiler import ids

        return ids(self)

    def df(self, *columns: str) -> DataFrame:
        """The set's messages, with the columns asked for (all by default); unordered, an ordinary DataFrame."""
        from .compiler import messages

        return messages(self, columns)

    def ordered(self, *columns: str, reverse: bool = False) -> DataFrame:
        out = self.df(*columns)
        return out.orderBy(F.desc(self.ds.msg_id) if reverse else F.asc(self.ds.msg_id))

    def positions(self, name: str = "pos") -> DataFrame:
        """Ids with their 0-based place in the set."""
        from tidelog.operators.positions import with_position

        return with_position(self.ids(), self.ds.msg_id, name)

    def count(self) -> int:
        return self.ids().count()

    __len__ = count

    def __bool__(self) -> bool:
        return not self.ids().isEmpty()

    def __iter__(self) -> Iterator[Row]:
        return self.ordered().toLocalIterator(prefetchPartitions=True)

    def __reversed__(self) -> Iterator[Row]:
        return self.ordered(reverse=True).toLocalIterator(prefetchPartitions=True)

    # navigation
    def ge(self, x: int) -> int | None:
        """The least id of the set at or after x."""
        return self.ids().where(F.col(self.ds.msg_id) >= x).agg(F.min(self.ds.msg_id)).first()[0]

    def le(self, x: int) -> int | None:
        """The greatest id of the set at or before x."""
        return self.ids().where(F.col(self.ds.msg_id) <= x).agg(F.max(self.ds.msg_id)).first()[0]

    def prevs(self, x: int) -> DataFrame:
        """Messages of the set strictly before x, nearest first."""
        return self.df().where(F.col(self.ds.msg_id) < x).orderBy(F.desc(self.ds.msg_id))

    def cursor(self, at: int | None = None):
        from tidelog.operators.cursor import Cursor

        return Cursor(self, at)

    find = cursor

    def __eq__(self, other) -> bool:
        return same(self, other)

    __hash__ = object.__hash__


@dataclass(frozen=True, eq=False)
class Stream(Rel):
    """The whole log."""


@dataclass(frozen=True, eq=False)
class Nothing(Rel):
    """The empty set."""


@dataclass(frozen=True, eq=False)
class Key(Rel):
    """Messages whose field has one of the keys."""

    name: str
    keys: tuple


@dataclass(frozen=True, eq=False)
class KeyRange(Rel):
    """Messages with a key of the field between low and high, both included; None leaves an end open."""

    name: str
    low: Any = None
    high: Any = None


@dataclass(frozen=True, eq=False)
class KeyPred(Rel):
    """Messages with a key of the field that the function accepts; None accepts any key."""

    name: str
    predicate: Callable[[Any], Any] | None = None


@dataclass(frozen=True, eq=False)
class Filter(Rel):
    """The messages of a set that the function (or Column) accepts."""

    base: Rel
    predicate: Callable[[Any], Any] | Column


@dataclass(frozen=True, eq=False)
class Slice(Rel):
    """A Python slice of a set's ids in order. A barrier: no predicate moves through it."""

    base: Rel
    start: int | None
    stop: int | None
    step: int | None


@dataclass(frozen=True, eq=False)
class SetOp(Rel):
    op: str
    left: Rel
    right: Rel


@dataclass(frozen=True, eq=False)
class Ids(Rel):
    """An id set given as a DataFrame."""

    frame: DataFrame = field(repr=False)


def as_rel(x) -> Rel:
    """A Rel, or a field handle, which stands for all messages that have the field."""
    if isinstance(x, Rel):
        return x
    if hasattr(x, "any"):
        return x.any()
    raise TypeError(f"not a set of messages: {x!r}")


def merged(*rels: Rel) -> DataFrame:
    """Ids of several sets together, an id once for each set that has it; order by the id to merge them."""
    out = rels[0].ids()
    for r in rels[1:]:
        out = out.union(r.ids())
    return out


def intersection(*rels: Rel) -> Rel:
    """All sets' common ids; the compiler orders native conditions before joins."""
    out = rels[0]
    for r in rels[1:]:
        out = out & r
    return out


def same(a: Any, b: Any) -> bool:
    """Whether two trees are the same by structure; functions, Columns and frames are the same if identical."""
    if a is b:
        return True
    if type(a) is not type(b) or not isinstance(a, Rel) or a.ds is not b.ds:
        return False
    for name in a.__dataclass_fields__:
        if name == "ds":
            continue
        x, y = getattr(a, name), getattr(b, name)
        if isinstance(x, Rel):
            if not same(x, y):
                return False
        elif isinstance(x, (int, str, tuple, bytes, float, type(None))):
            if type(x) is not type(y) or x != y:
                return False
        elif x is not y:
            return False
    return True
