"""From query trees to DataFrames.

A tree whose leaves are all facts about one row (keys, ranges, native predicates, slices of the whole log) becomes one
filter, which Catalyst pushes into the scan. Elsewhere sets meet in semi and anti joins on the id. Sorting happens only under a
slice and at the end.

On a stored dataset a tree that the index bounds to few messages starts from postings instead: an intersection from its rarest key, to
which the other rare keys are joined; what is left of it is tested on the messages found.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidelog.operators.positions import with_position

from .rel import Filter, Ids, Key, KeyPred, KeyRange, Nothing, Rel, SetOp, Slice, Stream
from .rules import base_range, operands, simplify

#: Accepted keys up to which a key predicate becomes an IN list; more of them are joined.
IN_LIST = 1_000


class MessageColumns:
    """What a native message predicate gets: attributes and items are Columns."""

    def __init__(self, frame: DataFrame):
        self._frame = frame

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._frame.columns:
            raise KeyError(name)
        return F.col(f"`{name}`")

    def has_fields(self, *names: str) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & (self[name].isNotNull() if name in self._frame.columns else F.lit(False))
        return out


def py(function):
    """Mark a predicate as plain Python: it gets values, not Columns."""
    function.plain_python = True
    return function


def as_column(function, argument) -> Column | bool | None:
    """The predicate as a Column or a constant, or None if it only works on Python values."""
    if isinstance(function, Column):
        return function
    if getattr(function, "plain_python", False):
        return None
    try:
        out = function(argument)
    except Exception:  # a function of plain values fails on Columns in ways of its own
        return None
    return out if isinstance(out, (Column, bool)) else None


def _true(c: Column) -> Column:
    """Null counts as false, so that negation keeps the row. Only negations need it; elsewhere it would keep filters from the scan."""
    return F.coalesce(c, F.lit(False))


def predicate(rel: Rel) -> Column | None:
    """The set as a condition on a message row, if it is one."""
    ds = rel.ds
    if isinstance(rel, Stream):
        return F.lit(True)
    if isinstance(rel, Nothing):
        return F.lit(False)
    if isinstance(rel, (Key, KeyRange, KeyPred)):
        spec = ds.fields[rel.name]
        if spec.column is None:
            return None
        column = F.col(f"`{spec.column}`")
        test = key_test(rel)
        if test is None:
            return None
        return F.exists(column, lambda k: test(ds.decoded(spec, k))) if spec.multi else test(ds.decoded(spec, column))
    if isinstance(rel, Filter):
        own = as_column(rel.predicate, MessageColumns(ds.messages))
        base = None if own is None else predicate(rel.base)
        if own is None or base is None:
            return None
        return base & (F.lit(own) if isinstance(own, bool) else own)
    if isinstance(rel, Slice):
        r = base_range(rel, ds.__len__) if _of_stream(rel) else None
        if r is None:
            return None
        i = F.col(ds.msg_id)
        inside = (i >= r.start) & (i < r.stop)
        return inside if r.step == 1 else inside & ((i - r.start) % r.step == 0)
    if isinstance(rel, SetOp):
        p = predicate(rel.left)
        q = None if p is None else predicate(rel.right)
        if p is None or q is None:
            return None
        if rel.op in ("and", "or"):
            return p & q if rel.op == "and" else p | q
        return p & ~_true(q) if rel.op == "sub" else _true(p) != _true(q)
    return None


def _of_stream(rel: Rel) -> bool:
    while isinstance(rel, Slice):
        rel = rel.base
    return isinstance(rel, Stream) and rel.ds.dense


def key_test(rel: Rel):
    """A function from a key's Column to a condition, or None if the predicate is plain Python."""
    if isinstance(rel, Key):
        keys = [k for k in rel.keys if k is not None]
        return lambda c: c.isin(keys) if len(keys) != 1 else c == F.lit(keys[0])
    if isinstance(rel, KeyRange):
        low, high = rel.low, rel.high
        both = [lambda c: c >= F.lit(low)] * (low is not None) + [lambda c: c <= F.lit(high)] * (high is not None)

        def inside(c: Column) -> Column:
            out = c.isNotNull()
            for f in both:
                out = out & f(c)
            return out

        return inside
    if rel.predicate is None:
        return lambda c: c.isNotNull()
    probe = as_column(rel.predicate, F.col("key"))
    if probe is None:
        return None
    if isinstance(probe, bool):
        return lambda c: c.isNotNull() & F.lit(probe)
    return lambda c: rel.predicate(c) & c.isNotNull()


def ids(rel: Rel) -> DataFrame:
    return _ids(simplify(rel))


def refs(rel: Rel) -> int | None:
    """A bound on the set's size from the index, None if it has none."""
    if isinstance(rel, (Key, KeyRange)):
        return rel.ds.n_refs(rel)
    if isinstance(rel, Nothing):
        return 0
    if isinstance(rel, (Filter, Slice)):
        return refs(rel.base)
    if isinstance(rel, SetOp):
        if rel.op == "sub":
            return refs(rel.left)
        both = [refs(rel.left), refs(rel.right)]
        known = [n for n in both if n is not None]
        if rel.op == "and":
            return min(known, default=None)
        return sum(known) if len(known) == 2 else None
    return None


def indexed(rel: Rel) -> bool:
    """Whether the set is found through postings."""
    return rel.ds.selective(refs(rel)) if rel.ds.has_index else False


def _ids(rel: Rel) -> DataFrame:
    ds = rel.ds
    if isinstance(rel, (Key, KeyRange)) and ds.use_postings(rel):
        return ds.postings(rel.name).where(key_test(rel)(F.col("key"))).select(ds.msg_id).distinct()
    if isinstance(rel, (SetOp, Filter)) and indexed(rel):
        return _filtered(rel) if isinstance(rel, Filter) else _by_index(rel)
    p = predicate(rel)
    if p is not None:
        return ds.messages.where(p).select(ds.msg_id)
    if isinstance(rel, Ids):
        return rel.frame.select(ds.msg_id).distinct()
    if isinstance(rel, (Key, KeyRange, KeyPred)):
        return _by_dictionary(rel)
    if isinstance(rel, Filter):
        return _filtered(rel)
    if isinstance(rel, Slice):
        return _sliced(rel)
    return _joined(rel)


def _by_index(rel: SetOp) -> DataFrame:
    """A set that the index bounds. Row-local conditions on the rest are tested on the messages found so far."""
    ds = rel.ds
    if rel.op == "and":
        parts = sorted(operands(rel, "and"), key=lambda x: (n := refs(x)) is None and float("inf") or n or 0)
        out, rest = _ids(parts[0]), None
        for x in parts[1:]:
            p = None if indexed(x) else predicate(x)
            if p is None:
                out = out.join(_ids(x), ds.msg_id, "left_semi")
            else:
                rest = p if rest is None else rest & p
        return out if rest is None else ds.messages.join(out, ds.msg_id, "left_semi").where(rest).select(ds.msg_id)
    if rel.op == "sub":
        out, p = _ids(rel.left), None if indexed(rel.right) else predicate(rel.right)
        if p is not None:
            return ds.messages.join(out, ds.msg_id, "left_semi").where(~_true(p)).select(ds.msg_id)
    return _joined(rel)


def _by_dictionary(rel: Rel) -> DataFrame:
    """Keys are judged once each, over the field's dictionary; what passes becomes an IN list, or a join if it is long."""
    ds = rel.ds
    keys = ds.key_stats(rel.name).select("key")
    test = key_test(rel)
    good = keys.where(test(F.col("key"))) if test else keys.where(_plain(rel.predicate, F.col("key")))
    some = [r["key"] for r in good.limit(IN_LIST + 1).collect()]
    if len(some) <= IN_LIST:
        some = [bytes(k) if isinstance(k, bytearray) else k for k in some]
        return _ids(Key(ds, rel.name, tuple(some))) if some and ds.fields[rel.name].column else ds.postings(rel.name).where(F.col("key").isin(some)).select(ds.msg_id).distinct()
    return ds.postings(rel.name).join(good, "key", "left_semi").select(ds.msg_id).distinct()


def _plain(function, argument: Column) -> Column:
    """A Python predicate in Arrow batches."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([bool(function(v)) for v in values], dtype=bool)

    return run(argument)


class Message:
    """What a plain Python message predicate gets: attributes and items are the message's values."""

    def __init__(self, values: dict[str, Any]):
        self.__dict__.update(values)

    def __getitem__(self, name: str) -> Any:
        return self.__dict__[name]

    def has_fields(self, *names: str) -> bool:
        return all(self.__dict__.get(n) is not None for n in names)


def _filtered(rel: Filter) -> DataFrame:
    ds = rel.ds
    base = messages(rel.base, ())
    own = as_column(rel.predicate, MessageColumns(ds.messages))
    if own is not None:
        return base.where(F.lit(own) if isinstance(own, bool) else own).select(ds.msg_id)
    function, names = rel.predicate, ds.messages.columns

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(function(Message(dict(zip(names, r))))) for r in rows.itertuples(index=False, name=None)], dtype=bool)

    return base.where(run(F.struct(*[F.col(f"`{n}`") for n in names]))).select(ds.msg_id)


def _sliced(rel: Slice) -> DataFrame:
    ds = rel.ds
    base, start, stop, step = _ids(rel.base), rel.start, rel.stop, rel.step or 1
    up, down = F.asc(ds.msg_id), F.desc(ds.msg_id)
    if step == 1 and start in (None, 0) and stop is not None and stop >= 0:
        return base.orderBy(up).limit(stop)
    if step == 1 and stop is None and start is not None and start < 0:
        return base.orderBy(down).limit(-start)
    placed = with_position(base, ds.msg_id, "__pos")
    pos = F.col("__pos")
    if step > 0 and (start or 0) >= 0 and (stop is None or stop >= 0):
        keep = pos >= (start or 0)
        if stop is not None:
            keep = keep & (pos < stop)
        if step != 1:
            keep = keep & ((pos - (start or 0)) % step == 0)
        return placed.where(keep).select(ds.msg_id)
    r = range(base.count())[start:stop:step]
    r = r if r.step > 0 else r[::-1]
    keep = (pos >= r.start) & (pos < r.stop) & ((pos - r.start) % r.step == 0)
    return placed.where(keep).select(ds.msg_id)


def _joined(rel: SetOp) -> DataFrame:
    ds = rel.ds
    a, b = _ids(rel.left), _ids(rel.right)
    if rel.op == "and":
        return a.join(b, ds.msg_id, "left_semi")
    if rel.op == "or":
        return a.union(b).distinct()
    if rel.op == "sub":
        return a.join(b, ds.msg_id, "left_anti")
    return a.join(b, ds.msg_id, "left_anti").union(b.join(a, ds.msg_id, "left_anti"))


def messages(rel: Rel, columns: tuple[str, ...]) -> DataFrame:
    """The set's messages. The id set is found first, on narrow rows; the asked columns are read for its members only."""
    ds, rel = rel.ds, simplify(rel)
    out = ds.messages.select(*dict.fromkeys([ds.msg_id, *columns])) if columns else ds.messages
    through = ds.use_postings(rel) if isinstance(rel, (Key, KeyRange)) else isinstance(rel, (SetOp, Filter)) and indexed(rel)
    p = None if through else predicate(rel)
    if p is not None:
        found = ds.messages.where(p)
        return found.select(*out.columns)
    return out.join(_ids(rel), ds.msg_id, "left_semi")


def at_position(rel: Rel, i: int) -> Row:
    """The i-th message in order; negative from the end; IndexError outside."""
    ds = rel.ds
    column = F.col(ds.msg_id)
    if isinstance(rel, Stream) and ds.dense:
        found = ds.messages.where(column == (i if i >= 0 else len(ds) + i)).take(1)
    else:
        order, skip = (F.asc(ds.msg_id), i) if i >= 0 else (F.desc(ds.msg_id), -i - 1)
        at = rel.ids().orderBy(order).limit(skip + 1).orderBy(F.desc(ds.msg_id) if i >= 0 else F.asc(ds.msg_id)).select(ds.msg_id).take(1)
        exists = at and (rel.ids().where(column <= at[0][0] if i >= 0 else column >= at[0][0]).count() == skip + 1)
        found = ds.messages.where(column == at[0][0]).take(1) if exists else []
    if not found:
        raise IndexError(i)
    return found[0]
