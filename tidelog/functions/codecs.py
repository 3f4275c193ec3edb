"""Codecs between values and bytes as Column expressions, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import le_bytes, le_unsigned


@dataclass(frozen=True)
class Codec:
    dump: Callable[[Column], Column]
    load: Callable[[Column], Column]


CODECS: dict[str, Codec] = {
    "bytes": Codec(lambda c: c.cast("binary"), lambda c: c),
    "str": Codec(lambda c: F.encode(c, "UTF-8"), lambda c: F.decode(c, "UTF-8")),
    "uint16": Codec(lambda c: le_bytes(c, 2), lambda c: le_unsigned(c, 0, 2)),
    "uint32": Codec(lambda c: le_bytes(c, 4), lambda c: le_unsigned(c, 0, 4)),
    "uint64": Codec(lambda c: le_bytes(c, 8), lambda c: le_unsigned(c, 0, 8)),
    "json": Codec(lambda c: F.encode(F.to_json(c), "UTF-8"), lambda c: F.try_parse_json(F.decode(c, "UTF-8"))),
}


def register(name: str, dump: Callable[[Column], Column], load: Callable[[Column], Column]) -> None:
    """Add a codec; functions of Columns, or pandas UDFs where Columns cannot say it."""
    CODECS[name] = Codec(dump, load)


def json_codec(schema: str) -> Codec:
    """JSON with a known schema, read as a struct."""
    return Codec(CODECS["json"].dump, lambda c: F.from_json(F.decode(c, "UTF-8"), schema))
