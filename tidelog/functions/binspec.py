"""Fixed binary packets described by an INI text: one section for each message type, `name = code` lines in order.

Codes: B H I Q unsigned and b h i q signed numbers of 1, 2, 4, 8 bytes; Ns text of N bytes; NB, NH, NI and so on arrays.
A section may start with `_type = <number>`, and end in repeating groups: `@name = count_field section`.
"""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import le_signed, le_unsigned, piece

SIZES = {"B": 1, "b": 1, "H": 2, "h": 2, "I": 4, "i": 4, "Q": 8, "q": 8, "s": 1}


@dataclass(frozen=True)
class Item:
    name: str
    code: str
    times: int | None  # None: one value
    offset: int

    @property
    def size(self) -> int:
        return SIZES[self.code] * (1 if self.times is None else self.times)


@dataclass(frozen=True)
class Group:
    name: str
    count: str
    section: str


@dataclass
class Section:
    name: str
    items: list[Item] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    type: int | None = None

    @property
    def size(self) -> int:
        return sum(x.size for x in self.items)


def parse(text: str) -> dict[str, Section]:
    ini = configparser.ConfigParser(interpolation=None)
    ini.optionxform = str
    ini.read_string(text)
    out = {}
    for name in ini.sections():
        section, at = Section(name), 0
        for key, value in ini.items(name):
            if key == "_type":
                section.type = int(value)
            elif key.startswith("@"):
                count, of = value.split()
                section.groups.append(Group(key[1:], count, of))
            elif not key.startswith("_"):
                m = re.fullmatch(r"(\d*)([BbHhIiQqs])", value.strip())
                if not m:
                    raise ValueError(f"{name}.{key}: unknown code {value!r}")
                item = Item(key, m[2], int(m[1]) if m[1] else (1 if m[2] == "s" else None), at)
                section.items.append(item)
                at += item.size
        out[name] = section
    return out


def value(raw: Column, item: Item, base=0, first_only: bool = False) -> Column:
    """One item; arrays as arrays, or their first element alone with first_only. Text loses padding (spaces, NULs) at its end."""
    at = (base if isinstance(base, Column) else F.lit(base)) + item.offset
    if item.code == "s":
        return F.regexp_replace(F.decode(piece(raw, at, item.times), "ISO-8859-1"), "[ \\x00]+$", "")
    read = le_unsigned if item.code.isupper() else le_signed
    size = SIZES[item.code]
    if item.times is None or first_only:
        return read(raw, at, size)
    return F.array(*[read(raw, at + k * size, size) for k in range(item.times)])


def decode(raw: Column, spec: dict[str, Section], name: str, base=0, first_only: bool = False) -> Column:
    """The section as a struct, with its repeating groups as arrays of structs that follow one another."""
    section = spec[name]
    at = base if isinstance(base, Column) else F.lit(base)
    fields = [value(raw, x, at, first_only).alias(x.name) for x in section.items]
    counts = {x.name: value(raw, x, at) for x in section.items}
    behind = at + section.size
    for g in section.groups:
        n, size = F.coalesce(counts[g.count], F.lit(0)).cast("int"), spec[g.section].size
        spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        fields.append(F.transform(spots, _repeat(raw, spec, g.section, behind, size, first_only)).alias(g.name))
        behind = behind + n * size
    return F.struct(*fields)


def _repeat(raw: Column, spec: dict[str, Section], name: str, start: Column, size: int, first_only: bool):
    return lambda k: decode(raw, spec, name, start + k * size, first_only)


def packets(df: DataFrame, spec: dict[str, Section], header: str = "header", raw: str = "payload", count: str = "MsgCount") -> DataFrame:
    """Rows for every submessage: the columns of df, header (struct), seq (from 0), msg_type and body.

    A packet is a header section, then as many submessages as its count says; each begins with its own size and its type (both u16).
    Cut-off packets give the submessages that are whole.
    """
    source = F.col(raw)
    head = decode(source, spec, header)
    start = F.lit(spec[header].size).cast("bigint")
    n = F.coalesce(head[count], F.lit(0)).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def one(state, _):
        size = le_unsigned(source, state["at"], 2)
        body = piece(source, state["at"].cast("int"), size.cast("int"))
        whole = size.isNotNull() & (size >= 4) & (F.octet_length(body) == size)
        return F.struct(F.when(whole, state["at"] + size).alias("at"), F.when(whole, F.array_append(state["found"], body)).otherwise(state["found"]).alias("found"))

    state = F.struct(start.alias("at"), F.array().cast("array<binary>").alias("found"))
    bodies = F.aggregate(steps, state, one, lambda s: s["found"])
    out = df.withColumn("header", head).select(*df.columns, "header", F.posexplode(bodies).alias("seq", "body"))
    return out.withColumn("msg_type", le_unsigned(F.col("body"), 2, 2).cast("int"))


def by_type(rows: DataFrame, spec: dict[str, Section], first_only: bool = False) -> dict[int, DataFrame]:
    """The dispatch table: for each typed section, its submessages with their fields as columns."""
    keep = [c for c in rows.columns if c != "body"]
    return {s.type: rows.where(F.col("msg_type") == s.type).select(*keep, decode(F.col("body"), spec, s.name, 0, first_only).alias("m")).select(*keep, "m.*") for s in spec.values() if s.type is not None}


def message_types(rows: DataFrame, key: str) -> DataFrame:
    """(key, types): the types in each packet, an index field of many keys."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("msg_type")).alias("types"))
