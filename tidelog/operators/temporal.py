"""Navigation in bulk: previous and next messages, as-of lookups, last different values and carried-forward state.

What looks back without limit goes in two steps, so that a hot key or the whole log is no single window: inside buckets of
neighbouring ids, then over one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def _bucket(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def carry(df: DataFrame, values: dict[str, Column], order: str, by: Sequence[str] = (), inclusive: bool = True, reverse: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Adds for each name the last non-null value of its Column at or before the row (strictly before, if not inclusive).

    reverse looks ahead instead. order must be an integer, unique within a key.
    """
    by = list(by)
    keyed = df.withColumns({f"__v{i}": c for i, c in enumerate(values.values())}).withColumn("__bucket", _bucket(order, bucket))
    direction = F.desc if reverse else F.asc
    local = Window.partitionBy(*by, "__bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = F.min_by if reverse else F.max_by
    sums = keyed.groupBy(*by, "__bucket").agg(*[ends(F.col(f"__v{i}"), F.when(F.col(f"__v{i}").isNotNull(), F.col(order))).alias(f"__s{i}") for i in range(len(values))])
    earlier = Window.partitionBy(*by).orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__bucket", *[F.last(f"__s{i}", ignorenulls=True).over(earlier).alias(f"__c{i}") for i in range(len(values))])
    found = keyed.withColumns({f"__l{i}": F.last(f"__v{i}", ignorenulls=True).over(local) for i in range(len(values))})
    same = [keyed_name for keyed_name in [*by, "__bucket"]]
    right = sums.withColumnsRenamed({c: f"__r_{c}" for c in same})
    on = [found[c].eqNullSafe(right[f"__r_{c}"]) for c in same]
    out = found.join(right, on, "left").withColumns({n: F.coalesce(f"__l{i}", f"__c{i}") for i, n in enumerate(values)})
    return out.select(*df.columns, *[n for n in values if n not in df.columns]) if not set(values) & set(df.columns) else out.select(*[c for c in df.columns if c not in values], *values)


def carry_forward(df: DataFrame, fields: Sequence[str], order: str, by: Sequence[str] = (), prefix: str = "last_") -> DataFrame:
    """The state at each message: for every field, its latest value so far."""
    return carry(df, {prefix + f: F.col(f) for f in fields}, order, by)


def seek(probes: DataFrame, targets: DataFrame, order: str, by: Sequence[str] = (), forward: bool = False, strict: bool = False, name: str = "ref", bucket: int = BUCKET) -> DataFrame:
    """For each probe the greatest target id at or before it (least at or after it, if forward); strict leaves out its own.

    Both sides hold the integer column `order` and the key columns; other columns of probes pass through.
    """
    by = list(by)
    others = [c for c in probes.columns if c not in by and c != order]
    asked = probes.select(*by, order, F.lit(True).alias("__probe"), F.lit(None).cast("long").alias("__target"), *([F.struct(*others).alias("__rest")] if others else []))
    rest = [F.lit(None).cast(asked.schema["__rest"].dataType).alias("__rest")] if others else []
    known = targets.select(*by, order, F.lit(False).alias("__probe"), F.col(order).cast("long").alias("__target"), *rest)
    both = asked.union(known)
    # targets of a probe's own id stand on its near side unless strict: twice the id, less or more one
    near = (F.when(F.col("__probe"), 0).otherwise(1 if forward else -1) * (-1 if strict else 1)).cast("long")
    both = both.withColumn("__order", F.col(order).cast("long") * 4 + near)
    out = carry(both, {name: F.col("__target")}, "__order", by, inclusive=False, reverse=forward, bucket=4 * bucket).where("__probe")
    return out.select(*by, order, *[F.col("__rest")[c].alias(c) for c in others], name)


def asof(left: DataFrame, right: DataFrame, order: str, by: Sequence[str] = (), forward: bool = False, strict: bool = False, suffix: str = "_asof") -> DataFrame:
    """Left rows with the right row of the same key that was last at their place; nulls where there is none."""
    by = list(by)
    found = seek(left, right.select(*by, order), order, by, forward, strict, "__ref")
    others = [c for c in right.columns if c not in by and c != order]
    state = right.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col(order).alias("__at"), *[F.col(c).alias(c + suffix) for c in others])
    on = [F.col("__ref") == F.col("__at"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]]
    return found.join(state, on, "left").withColumnRenamed("__ref", order + suffix).drop("__at", *[f"__k_{c}" for c in by])


def prev_next(df: DataFrame, order: str, by: Sequence[str], value: str | None = None, prev: str = "prev", next: str = "next") -> DataFrame:
    """The neighbours' values of a column (the id by default) within a key."""
    column = F.col(value or order)
    back = carry(df, {prev: column}, order, by, inclusive=False)
    return carry(back, {next: column}, order, by, inclusive=False, reverse=True)


def last_different(df: DataFrame, value: str, order: str, by: Sequence[str], name: str = "prev_different") -> DataFrame:
    """The value that the key had before its present run of equal values; null in the first run. Nulls do not break a run."""
    stepped = carry(df, {"__before": F.col(value)}, order, by, inclusive=False)
    changed = F.col(value).isNotNull() & F.col("__before").isNotNull() & (F.col(value) != F.col("__before"))
    return carry(stepped, {name: F.when(changed, F.col("__before"))}, order, by).drop("__before")


def every_previous(df: DataFrame, by: Sequence[str], order: str, what: Column, name: str) -> DataFrame:
    """An aggregate Column over all earlier messages of the key."""
    return df.withColumn(name, what.over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
