"""A client cursor over a set: it fetches ids in ordered batches, and never changes the set."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

BATCH = 256


class Cursor:
    """Stands on an id (or before the first). next() and prev() move and return the message, or raise StopIteration."""

    def __init__(self, rel, at: int | None = None):
        self._rel, self._key = rel, rel.ds.msg_id
        self.at = at
        self._ahead: list[int] = []
        self._direction = 0

    def _step(self, direction: int) -> Row:
        if self._direction != direction:
            self._ahead, self._direction = [], direction
        if not self._ahead:
            ids = self._rel.ids()
            column = F.col(self._key)
            if self.at is not None:
                ids = ids.where(column > self.at if direction > 0 else column < self.at)
            order = F.asc(self._key) if direction > 0 else F.desc(self._key)
            self._ahead = [r[0] for r in ids.orderBy(order).limit(BATCH).collect()]
            if not self._ahead:
                raise StopIteration
        self.at = self._ahead.pop(0)
        return self.message

    def next(self) -> Row:
        return self._step(1)

    __next__ = next

    def prev(self) -> Row:
        return self._step(-1)

    def __iter__(self):
        return self

    def jump(self, position: int) -> Row:
        """To the message at a place in the set."""
        row = self._rel[position]
        self.at, self._ahead = row[self._key], []
        return row

    def ge(self, x: int) -> int | None:
        return self._rel.ge(x)

    def le(self, x: int) -> int | None:
        return self._rel.le(x)

    @property
    def message(self) -> Row:
        return self._rel.ds.messages.where(F.col(self._key) == self.at).take(1)[0]


class StateCursor(Cursor):
    """A cursor that keeps the state of fields at its place: each field's latest value that is not null, at or before the message.

    goto() looks the state up in one aggregate over the set; next() carries it on; prev() looks it up again.
    """

    def __init__(self, rel, fields: list[str], at: int | None = None):
        super().__init__(rel, at)
        self.fields = list(fields)
        self.state = dict.fromkeys(self.fields)
        if at is not None:
            self.goto(at)

    def goto(self, at: int) -> dict:
        """To a place in the log, which need not be a member of the set."""
        self.at, self._ahead = at, []
        latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(self._key))).alias(f) for f in self.fields]
        self.state = self._rel.df(*self.fields).where(F.col(self._key) <= at).agg(*latest).first().asDict()
        return self.state

    def rewind(self) -> dict:
        """To before the first message."""
        self.at, self._ahead, self.state = None, [], dict.fromkeys(self.fields)
        return self.state

    def next(self) -> Row:
        row = self._step(1)
        self.state |= {f: row[f] for f in self.fields if row[f] is not None}
        return row

    __next__ = next

    def prev(self) -> Row:
        row = self._step(-1)
        self.goto(self.at)
        return row

    def jump(self, position: int) -> Row:
        row = super().jump(position)
        self.goto(self.at)
        return row
