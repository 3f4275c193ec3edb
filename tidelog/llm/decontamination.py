"""Benchmark decontamination by template canonicalisation. Native.

A text becomes a list of tokens in which numbers, names and units give way to typed placeholders; every window
of WINDOW tokens is hashed, and the windows of documents meet those of the benchmark in a hash join. Hits on one diagonal
(document position minus item position) are one occurrence of the item. Its slots must be filled consistently: a changed value has one
counterpart in the whole occurrence, both ways; windows with a changed value that breaks this do not count. Then a changed number is a
re-parameterised question, and not an accident of placeholders. Windows of fewer than MIN_PLAIN plain words only count word for word.
A document is contaminated by an item if the windows that count cover MIN_SHARE of the item's.

Numbers are one token with their decimals and thousands. Names are capitalised words other than STARTERS, at the start of a sentence too. A
number or name between two others stays as it is, so that tables of numbers do not match one another.

The windows' slots are only looked up for documents that share a window with the benchmark.

Defined results: null and empty texts, and texts without letters and digits, match nothing; an item shorter than a window
is one window of its own length, and one of fewer than MIN_PLAIN tokens only matches a document of the same tokens; repeated rows of
documents, and rows that share an id, count as one document; empty tables give an empty result. Ids may be of any type, and columns
other than id and text are not read, so that names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, passing

WINDOW = 8
MIN_PLAIN = 4
MIN_SHARE = 0.2
#: Bytes of the benchmark's windows up to which they are broadcast; a larger table joins by shuffle.
BROADCAST_BYTES = 32 << 20
#: Units that stand after a number, and words that begin sentences and are no names.
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "l", "ml", "s", "sec", "seconds", "min", "minutes", "h", "hr", "hours", "days", "weeks", "years", "kmh", "mph", "usd", "eur", "dollars", "euros", "cents", "percent")
STARTERS = ("A", "After", "All", "An", "And", "Any", "Are", "Assume", "At", "Before", "But", "By", "Calculate", "Can", "Choose", "Compute", "Consider", "Could", "Describe", "Determine", "Did", "Do", "Does", "Each", "Every", "Explain", "Find", "For", "From", "Given", "Had", "Has", "Have", "He", "Here", "How", "I", "If", "In", "Is", "It", "Let", "List", "No", "Not", "Of", "On", "Or", "Prove", "Select", "She", "Should", "Show", "Solve", "Some", "State", "Suppose", "That", "The", "Then", "There", "These", "They", "This", "Those", "To", "Use", "Was", "We", "Were", "What", "When", "Where", "Which", "While", "Who", "Whose", "Why", "Will", "With", "Would", "Write", "You")
NAME, UNIT = "\u0002", "\u0003"
NUMBER_CODE, NAME_CODE, UNIT_CODE = 1, 2, 3


def raw_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a marked first character tells names and units from plain words."""
    marked = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}])(?!(?:" + "|".join(STARTERS) + r")(?!\p{L}))(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", NAME + "$1")
    marked = F.regexp_replace(marked, r"(?i)\b(\d[\d.,]*) ?(" + "|".join(UNITS) + r")\b", "$1 " + UNIT + "$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(r"([0-9]+(?:[.,][0-9]+)+|[\p{L}\p{N}\u0002\u0003]+)"))


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def _is_slot(x: Column) -> Column:
    return x < F.lit(":")  # digits and the two marks sort before every letter


def _crowded(x: Column) -> Column:
    """Whether a neighbour is a number or a name; there is none beyond the text's ends."""
    return F.coalesce(_is_number(x) | x.startswith(NAME), F.lit(False))


def canonical(tokens: Column) -> Column:
    """A 64-bit code for each token; placeholders share one for their type."""

    def code(x: Column, i: Column) -> Column:
        free = ~(_crowded(F.get(tokens, i - 1)) & _crowded(F.get(tokens, i + 1)))
        slot = F.when(x.startswith(UNIT), F.lit(UNIT_CODE)).when(free, F.when(_is_number(x), F.lit(NUMBER_CODE)).otherwise(F.lit(NAME_CODE)))
        return F.when(_is_slot(x), F.coalesce(slot.cast("long"), F.xxhash64(x))).otherwise(F.xxhash64(x))

    return F.transform(tokens, code)


def _fitting(df: DataFrame, width: int, exact: bool) -> DataFrame:
    size = F.size("__t")
    return df.withColumn("__t", raw_tokens(F.col("__text"))).where(size == width if exact else size >= width)


def windows(df: DataFrame, width: int, exact: bool = False) -> DataFrame:
    """Rows (key columns, pos, h) of df (key columns, __text): one for each window of a text; with exact, only texts of that length."""
    keys = [c for c in df.columns if c != "__text"]
    coded = _fitting(df, width, exact).select(*keys, canonical(F.col("__t")).alias("__c"))
    spot = F.sequence(F.lit(0), F.size("__c") - width)

    def window(i: Column) -> Column:
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*[F.get(F.col("__c"), i + k) for k in range(width)]).alias("h"))

    return coded.select(*keys, F.explode(F.transform(spot, window)).alias("w")).select(*keys, "w.pos", "w.h")


def slots(df: DataFrame, width: int) -> DataFrame:
    """Rows (key columns, pos, slots) of df (key columns, __text, __spots): the numbers, names and units of the windows at the spots."""
    keys = [c for c in df.columns if c not in ("__text", "__spots")]
    own = F.transform("__t", lambda x: F.when(_is_slot(x), x))
    found = _fitting(df, width, False).select(*keys, "__spots", own.alias("__o"))
    at = F.transform("__spots", lambda i: F.struct(i.alias("pos"), F.slice(F.col("__o"), i + 1, F.lit(width)).alias("slots")))
    return found.select(*keys, F.explode(at).alias("w")).select(*keys, "w.pos", "w.slots")


def hits(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document and item that share a template window: doc, item, n_windows, n_matched, share, reparameterised."""
    bench = benchmark.select(F.col(item).alias("__item"), F.col(text).alias("__text")).where("__item is not null and __text is not null")
    source = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).where("__doc is not null and __text is not null")
    source = source.select("__doc", F.xxhash64("__text").alias("__of"), "__text")
    lengths = [r[0] for r in bench.select(F.size(raw_tokens(F.col("__text"))).alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect()]  # WINDOW values at most
    found = None
    for width in [WINDOW, *sorted(lengths)]:
        matched = _matched(source, bench, width)
        found = matched if found is None else found.union(matched)
    share = F.col("n_matched") / F.col("n_windows")
    return found.select(F.col("__doc").alias(doc), F.col("__item").alias(item), "n_windows", "n_matched", share.alias("share"), "reparameterised")


def _matched(source: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """Rows (__doc, __item, n_windows, n_matched, reparameterised) for windows of one width; items shorter than WINDOW have one window."""
    asked = windows(bench, width, exact=width < WINDOW)
    spots = asked.groupBy("__item").agg(F.collect_set("pos").alias("__spots"))
    own = slots(bench.join(spots, "__item"), width)
    asked = materialize(asked.join(own, ["__item", "pos"]).select("__item", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots")), "asked")
    length = F.aggregate("item_slots", F.lit(48), lambda a, x: a + F.coalesce(F.length(x), F.lit(1)) + 16)
    size = asked.agg(F.sum(length)).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    total = asked.groupBy("__item").agg(F.count("*").alias("n_windows"))

    met = windows(source, width, exact=width < MIN_PLAIN).join(near(asked.select("h", "__item", "item_pos")), "h")
    met = materialize(met.select("__doc", "__of", "pos", "__item", "item_pos"), "met")
    spots = met.groupBy("__doc", "__of").agg(F.collect_set("pos").alias("__spots"))
    texts = passing(source, met, ["__doc", "__of"], "__asked").where("__asked").select("__doc", "__of", "__text").dropDuplicates(["__doc", "__of"])
    filled = slots(texts.join(spots, ["__doc", "__of"]), width)
    both = met.join(filled, ["__doc", "__of", "pos"]).join(near(asked.select("__item", "item_pos", "item_slots")), ["__item", "item_pos"])

    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    both = both.select("__doc", "__of", "__item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", pairs.alias("pairs"))
    few = F.lit(width) - F.size("pairs") < MIN_PLAIN
    both = both.where(~few | ~F.exists("pairs", lambda x: x["a"] != x["b"]))
    # an occurrence holds each of the item's windows once, so that these lists are bounded by the item
    occurrence = both.groupBy("__doc", "__of", "__item", "diagonal").agg(F.collect_set(F.struct("item_pos", "pairs")).alias("found"))
    known = F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"])))
    changed = F.filter(known, lambda x: x["a"] != x["b"])
    broken = F.filter(changed, lambda x: F.exists(known, lambda y: (x["a"] == y["a"]) != (x["b"] == y["b"])))
    occurrence = occurrence.withColumn("broken", F.when(F.size(changed) > 0, broken).otherwise(F.filter(known, lambda x: F.lit(False))))
    spot = occurrence.select("__doc", "__item", "broken", F.explode("found").alias("w"))
    spot = spot.where((F.size("broken") == 0) | ~F.arrays_overlap("broken", "w.pairs"))
    spot = spot.select("__doc", "__item", F.col("w.item_pos").alias("at"), F.exists("w.pairs", lambda x: x["a"] != x["b"]).alias("changed"))
    once = spot.groupBy("__doc", "__item", "at").agg(F.max("changed").alias("changed"))
    out = once.groupBy("__doc", "__item").agg(F.count("*").alias("n_matched"), F.max("changed").alias("reparameterised"))
    return out.join(near(total), "__item").select("__doc", "__item", "n_windows", "n_matched", "reparameterised")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """The hits that count: an item's consistent share reaches min_share."""
    return hits(docs, benchmark, **columns).where(F.col("share") >= min_share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, doc: str = "doc_id", **columns: str) -> DataFrame:
    """docs without the contaminated ones; rows with a null id or text stay, and all columns."""
    bad = contaminated(docs, benchmark, min_share, doc=doc, **columns).select(doc).distinct()
    return docs.join(bad, doc, "left_anti")
