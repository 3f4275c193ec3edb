"""Data-quality rules. Each gives the number of passes and failures, and the offenders as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof, carry


@dataclass(frozen=True)
class Rule:
    """A condition on a row; rows for which it is null fail."""

    name: str
    holds: Column

    @property
    def test(self) -> Column:
        return F.coalesce(self.holds, F.lit(False))


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (rule, n_pass, n_fail) in one pass over df."""
    counts = df.agg(*[c for i, r in enumerate(rules) for c in (F.count_if(r.test).alias(f"p{i}"), F.count_if(~r.test).alias(f"f{i}"))])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"p{i}").alias("n_pass"), F.col(f"f{i}").alias("n_fail")) for i, r in enumerate(rules)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def offenders(df: DataFrame, rule: Rule) -> DataFrame:
    return df.where(~rule.test)


# --- row rules


def is_sorted(column: str, descending: bool = False) -> Rule:
    """An array of levels is in order; levels of 0 and less do not count."""
    live = F.filter(column, lambda x: x > 0)
    return Rule(f"{column} sorted", live == F.sort_array(live, not descending))


def required(*columns: str) -> list[Rule]:
    return [Rule(f"{c} present", F.col(c).isNotNull()) for c in columns]


def bounded(column: str, low=None, high=None) -> Rule:
    test = F.col(column).isNotNull()
    if low is not None:
        test = test & (F.col(column) >= low)
    if high is not None:
        test = test & (F.col(column) <= high)
    return Rule(f"{column} in bounds", test)


def ratio(numerator: Column, denominator: Column, stored: Column, tolerance: float, name: str = "ratio") -> Rule:
    return Rule(name, (denominator == 0) | (F.abs(numerator / denominator - stored) <= tolerance))


def ordered(*columns: str) -> Rule:
    """a <= b <= c within the row."""
    test = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        test = test & (F.col(a) <= F.col(b))
    return Rule(" <= ".join(columns), test)


# --- rules on sets and keys


def disjoint(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row (n_pass, n_fail): members of a that are not, and that are, in b."""
    return _split(a.select(on).distinct(), b.select(on).distinct(), on, member=False)


def subset(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row (n_pass, n_fail): members of a that are, and that are not, in b."""
    return _split(a.select(on).distinct(), b.select(on).distinct(), on, member=True)


def _split(a: DataFrame, b: DataFrame, on: str, member: bool) -> DataFrame:
    inside = F.col("__in").isNotNull()
    joined = a.join(b.withColumn("__in", F.lit(1)), on, "left")
    return joined.agg(F.count_if(inside if member else ~inside).alias("n_pass"), F.count_if(~inside if member else inside).alias("n_fail"))


def key_bounds(df: DataFrame, column: str) -> DataFrame:
    """The least and the greatest key: (low, high)."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def constant_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, constant): whether the value never changes within the key."""
    return df.groupBy(key).agg((F.min(value).eqNullSafe(F.max(value))).alias("constant"))


def running_delta(df: DataFrame, by: Sequence[str], order: str, total: str, step: Column, tolerance: float = 1e-9) -> DataFrame:
    """Adds `holds`: a running total grows by the row's step; null at the first row of a key."""
    back = carry(df, {"__total": F.col(total)}, order, by, inclusive=False)
    return back.withColumn("holds", F.abs(F.col(total) - F.col("__total") - step) <= tolerance).drop("__total")


def tick_direction(df: DataFrame, by: Sequence[str], order: str, price: str, name: str = "tick") -> DataFrame:
    """+1 or -1 by the last different price before the row; 0 while there was none."""
    from .temporal import last_different

    out = last_different(df, price, order, by, "__other")
    return out.withColumn(name, F.coalesce(F.signum(F.col(price) - F.col("__other")).cast("int"), F.lit(0))).drop("__other")


def tick_by_index(df: DataFrame, key: str, order: str, price: str, name: str = "tick") -> DataFrame:
    """The same as tick_direction() for one key column, by places: the key's price changes are a set of their own, and each row seeks the latest at or before it."""
    stepped = carry(df.select(key, order, price), {"__before": F.col(price)}, order, [key], inclusive=False)
    changes = stepped.where(F.col("__before").isNotNull() & (F.col(price) != F.col("__before"))).select(key, order, "__before")
    out = asof(df, changes, order, [key])
    tick = F.coalesce(F.signum(F.col(price) - F.col("__before_asof")).cast("int"), F.lit(0))
    return out.withColumn(name, tick).select(*df.columns, name)


def latest_state(df: DataFrame, states: DataFrame, by: Sequence[str], order: str, holds: Callable[[dict[str, Column], dict[str, Column]], Column]) -> DataFrame:
    """One row (n_pass, n_fail): rows for which holds(own values, the values of the key's latest earlier state); rows without a state fail."""
    found = asof(df, states, order, by, strict=True)
    own = {c: F.col(c) for c in df.columns}
    state = {c: F.col(f"{c}_asof") for c in states.columns if c not in by}
    test = F.coalesce(holds(own, state), F.lit(False))
    return found.agg(F.count_if(test).alias("n_pass"), F.count_if(~test).alias("n_fail"))


def values_seen(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, values): the distinct values of each key, sorted; for values of few kinds."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def rolling(df: DataFrame, by: Sequence[str], order: str, what: Column, rows: int, name: str) -> DataFrame:
    return df.withColumn(name, what.over(Window.partitionBy(*by).orderBy(order).rowsBetween(-rows + 1, 0)))
