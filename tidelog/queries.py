"""The engine's queries over the star-schema tables, each with the SQL that must give the same rows.

Names begin with the group of operators they show: src, snk, key, sel, set, slc, nav, agg, dq, dec, udf, str.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import binary, binspec, codecs, scalars
from tidelog.operators import quality, temporal
from tidelog.operators.cursor import StateCursor
from tidelog.plans.compiler import py
from tidelog.plans.rel import intersection, merged
from tidelog.sources.dataset import Dataset
from tidelog.sources.playback import header_columns, read_playback_files, record
from tidelog.sources.writer import adaptive_layout, ingest, runs
from tidelog.streaming import capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    """The events log: event_id is its id; payload props is JSON with the number k."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Dataset(rows, {"event_type": "event_type", "user_id": "user_id"}, msg_id="event_id")


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders with their parts and suppliers as fields of many keys."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.groupBy(F.col("l_orderkey").alias("msg_id")).agg(F.collect_set("l_partkey").alias("part"), F.collect_set("l_suppkey").alias("supplier"))
    return Dataset(rows, {"part": "part", "supplier": "supplier"}, dense=False)


def labelled(spark: SparkSession, sf_dir: str) -> Dataset:
    """Documents with a field that only some of them have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Dataset(docs.join(labels, "doc_id", "left"), {"lang": "lang", "quality": "quality", "toxic": "toxic"}, msg_id="doc_id", dense=False)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written datasets, in the shared folder of the cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


# --- sources -----------------------------------------------------------------------------------------------------


@query("select event_id, event_type, ts, value from events")
def src_scan(spark, d):
    return events(spark, d).stream.df("event_type", "ts", "value")


@query("select event_id, event_type from events where event_id = (select max(event_id) - 2 from events)")
def src_point_get(spark, d):
    ds = events(spark, d)
    return ds[-3:-2].df("event_type")


@query("select event_id, value from events where event_id in (7, (select max(event_id) - 1 from events))")
def src_item(spark, d):
    ds = events(spark, d)
    return spark.createDataFrame([(r["event_id"], r["value"]) for r in (ds[7], ds[-2])], "event_id long, value double")


@query("select event_id from events where event_id >= 10 and event_id < 200 and (event_id - 10) % 7 = 0")
def src_slice_step(spark, d):
    return events(spark, d)[10:200:7].ids()


@query("select event_id from events where event_id >= (select count(*) - 10 from events)")
def src_slice_tail(spark, d):
    return events(spark, d)[-10:].ids()


@query("select count(*) as n from events")
def src_len(spark, d):
    return events(spark, d).stream.ids().agg(F.count("*").alias("n"))


@query("select event_id, value from events where event_id between 99 and 149")
def src_number_range(spark, d):
    return events(spark, d).number_range(100, 150).df("value")


@query("""select event_id as id, 'A' as hint, '10.0.0.' || (user_id % 7) as ip, '9000' as port, event_type as payload,
          strlen(event_type)::int as payload_size from events""")
def src_playback(spark, d):
    rows = events(spark, d).stream.df()
    path = scratch(spark, "playback")
    # the payload carries the id in front; records are separated by the writer's line feeds
    payload = F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type"))
    one = record(payload, F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")), F.lit("9000"), F.date_format("ts", "HH:mm:ss.SSS"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    # captures of some 20 MB, however large the tasks: each is read whole
    rows.select(F.decode(one, "UTF-8").alias("value")).write.option("maxRecordsPerFile", 200_000).text(path)
    got = read_playback_files(spark, path)
    text = F.decode("payload", "UTF-8")
    kind = F.split_part(text, F.lit(":"), F.lit(2))
    return got.select(F.split_part(text, F.lit(":"), F.lit(1)).cast("bigint").alias("id"), "hint", "ip", "port", kind.alias("payload"), F.octet_length(kind).alias("payload_size"))


# --- sinks -------------------------------------------------------------------------------------------------------


def _stored(spark, d) -> Dataset:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type", "user_id", "value")
    return ingest(rows, scratch(spark, "dataset"), {"event_type": "event_type", "user_id": "user_id"}, ["ts", "event_id"])


@query("select row_number() over (order by ts, event_id) - 1 as msg_id, event_id, value from events")
def snk_ingest(spark, d):
    return _stored(spark, d).stream.df("event_id", "value")


@query("select event_id from events where user_id = 3")
def snk_reopen_lookup(spark, d):
    return _stored(spark, d).access("postings").idx["user_id"][3].df("event_id").select("event_id")


STORED = "select *, row_number() over (order by ts, event_id) - 1 as msg_id from events"


@query("select event_id, value from events where event_type = 'purchase' and user_id = 3")
def snk_index_and(spark, d):
    idx = _stored(spark, d).access("postings").idx
    return (idx["event_type"]["purchase"] & idx["user_id"][3]).df("event_id", "value").select("event_id", "value")


@query("select event_id from events where user_id = 3 and value > 50")
def snk_index_filter(spark, d):
    return _stored(spark, d).access("postings").idx["user_id"][3](lambda m: m.value > 50).df("event_id").select("event_id")


@query(f"select msg_id from ({STORED}) t where user_id in (3, 5) and event_type <> 'click'")
def snk_index_sub(spark, d):
    idx = _stored(spark, d).access("postings").idx
    return ((idx["user_id"][3] | idx["user_id"][5]) - idx["event_type"]["click"]).ids()


@query("select user_id::bigint as key, count(*) as n_refs from events group by user_id")
def snk_key_codec(spark, d):
    """Keys and messages stored as bytes by codecs, and read back as values."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    ds = ingest(rows, scratch(spark, "coded"), {"user": "user_id", "kind": "event_type"}, ["event_id"], codec="str", codecs={"user": "uint32", "kind": "str"}, message="event_type")
    return ds.idx["user"].stats().select(F.col("key").cast("bigint").alias("key"), "n_refs")


@query("""select key, n_refs, min_ref, max_ref from (select event_type as key, count(*) as n_refs, min(i) as min_ref, max(i) as max_ref
          from (select *, row_number() over (order by ts, event_id) - 1 as i from events) t group by event_type) t""")
def snk_keystats(spark, d):
    return _stored(spark, d).idx["event_type"].stats()


@query("""with n as (select count(*) as n from events) select 'event_type' as field, count(*) as nlinks, count(*) as nmsgs, count(distinct event_type) as nvals, 'dictionary column' as layout from events
          union all select 'user_id', count(*), count(*), count(distinct user_id), 'dictionary column' from events""")
def snk_layout(spark, d):
    return adaptive_layout(events(spark, d))


# --- key dictionary ----------------------------------------------------------------------------------------------


@query("select event_type as key, row_number() over (order by event_type) - 1 as pos from (select distinct event_type from events) t")
def key_list(spark, d):
    return events(spark, d).idx["event_type"].ranked()


@query("select event_type as key, count(*) as n_refs, min(event_id) as min_ref, max(event_id) as max_ref from events group by event_type")
def key_stats(spark, d):
    return events(spark, d).idx["event_type"].stats()


@query("select event_type as key, count(*) as n_refs from events group by event_type order by n_refs desc, key desc limit 2")
def key_topn(spark, d):
    return events(spark, d).idx["event_type"].top(2)


@query("select event_id from events where user_id between 3 and 7")
def key_range(spark, d):
    return events(spark, d).idx["user_id"][3:7].ids()


@query("select user_id as key, count(*) as n_refs from events where user_id between 3 and 7 group by user_id")
def key_between(spark, d):
    return events(spark, d).idx["user_id"](3, 7).select("key", "n_refs")


@query("select key from (select distinct user_id as key, dense_rank() over (order by user_id) - 1 as pos from events) t where pos % 10 = 0")
def key_every(spark, d):
    return events(spark, d).idx["user_id"].every(10)


@query("select count(distinct user_id) as n_keys, count(*) as n_refs, min(user_id) as low, max(user_id) as high from events")
def key_totals(spark, d):
    return events(spark, d).idx["user_id"].stats().agg(F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs"), F.min("key").alias("low"), F.max("key").alias("high"))


@query("""select count(*) as nlinks, count(distinct o) as nmsgs, bool_and(n = 1) as surjective, (select count(distinct l_partkey) from lineitem) as nvals
          from (select l_orderkey as o, l_partkey, count(*) over (partition by l_orderkey) as n from (select distinct l_orderkey, l_partkey from lineitem) t) u""")
def key_link_stats(spark, d):
    return orders(spark, d).idx["part"].link_stats()


@query("""select 'event_type' as field, event_type as key, count(*) as n_refs from events group by event_type
          union all select 'user_id', user_id::varchar, count(*) from events group by user_id""")
def key_dictionaries(spark, d):
    return events(spark, d).idx.dictionaries()


@query("""select k as key, k in (select distinct user_id from events) as known, (select count(*) from events where user_id = k) as n_refs from (values (3), (7), (-1)) t(k)""")
def key_membership(spark, d):
    user = events(spark, d).idx["user_id"]
    return spark.createDataFrame([(k, k in user, user.n_refs(k)) for k in (3, 7, -1)], "key int, known boolean, n_refs long")


@query("select user_id as key from (select distinct user_id, dense_rank() over (order by user_id) as up, dense_rank() over (order by user_id desc) as down from events) t where up = 3 or down = 2")
def key_at(spark, d):
    user = events(spark, d).idx["user_id"]
    return spark.createDataFrame([(user.key_at(2),), (user.key_at(-2),)], "key long")


@query("select min(user_id) as low, max(user_id) as high from events")
def key_bounds(spark, d):
    ds = events(spark, d)
    return ds.idx["user_id"].stats().agg(F.min("key").alias("low"), F.max("key").alias("high"))


# --- selection ---------------------------------------------------------------------------------------------------


@query("select event_id, event_type from events where event_type = 'purchase'")
def sel_key_eq(spark, d):
    return events(spark, d).idx["event_type"]["purchase"].df("event_type")


@query("select event_id from events where user_id % 2 = 0")
def sel_key_pred(spark, d):
    return events(spark, d).idx["user_id"](lambda k: k % 2 == 0).ids()


@query("select event_id from events where starts_with(event_type, 'p')")
def sel_key_prefix(spark, d):
    return events(spark, d).idx["event_type"](lambda k: k.startswith("p")).ids()


@query("select event_id from events where event_type = 'click' and user_id < 5")
def sel_kwargs_and(spark, d):
    return events(spark, d).idx(event_type="click", user_id=lambda k: k < 5).ids()


@query("select doc_id from documents join labels using (doc_id) where quality is not null")
def sel_any(spark, d):
    return labelled(spark, d).idx["quality"].any().ids()


@query("select doc_id from documents where position('the' in text) > 0")
def sel_stream_contains(spark, d):
    return labelled(spark, d).stream(lambda m: m.text.contains("the")).ids()


@query("select event_id from events where event_type = 'click' and cast(props->>'$.k' as int) > 50")
def sel_chain(spark, d):
    return events(spark, d).idx["event_type"]["click"](lambda m: F.get_json_object(m.props, "$.k").cast("int") > 50).ids()


@query("select distinct l_orderkey as msg_id from lineitem where l_partkey in (1, 2, 3)")
def sel_multi_value(spark, d):
    return orders(spark, d).idx(part=[1, 2, 3]).ids()


@query("select l_orderkey as msg_id from lineitem where l_suppkey = 1 intersect select l_orderkey from lineitem where l_suppkey = 2")
def sel_multi_both(spark, d):
    supplier = orders(spark, d).idx["supplier"]
    return (supplier[1] & supplier[2]).ids()


@query("select event_id, value from events where value > 20 and value < 30")
def sel_chained_comparison(spark, d):
    return events(spark, d).stream(lambda m: (m.value > 20) & (m.value < 30)).df("value")


@query("select doc_id from documents join labels using (doc_id) where quality is not null and toxic is not null")
def sel_has_fields(spark, d):
    return labelled(spark, d).stream(lambda m: m.has_fields("quality", "toxic")).ids()


@query("select event_id from events where user_id % 10 = 3")
def sel_without_index(spark, d):
    return events(spark, d).idx["user_id"].eval(lambda k: k % 10 == 3).ids()


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality is not null)")
def sel_missing(spark, d):
    return labelled(spark, d).idx["quality"].missing().ids()


@query("select event_id from events where event_type like '%i%' and length(event_type) = 5")
def udf_key_predicate(spark, d):
    return events(spark, d).idx["event_type"](py(lambda k: "i" in k and len(k) == 5)).ids()


@query("select event_id from events where user_id % 3 = 1 and event_type = 'view'")
def udf_message_predicate(spark, d):
    return events(spark, d).idx["event_type"]["view"](py(lambda m: m.user_id % 3 == 1)).ids()


# --- set operators -----------------------------------------------------------------------------------------------

A = "select event_id from events where event_type = 'purchase'"
B = "select event_id from events where user_id = 3"
C = "select event_id from events where value > 80"
K = "select event_id from events where event_type = 'click'"


def _sets(spark, d):
    ds = events(spark, d)
    kind = ds.idx["event_type"]
    return kind["purchase"], ds.idx["user_id"][3], ds.stream(lambda m: m.value > 80), kind["click"]


@query(f"select event_id, event_type, user_id, value from events where event_id in ({A} intersect {B})")
def set_and(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (a & b).df("event_type", "user_id", "value")


@query(f"{A} union {B}")
def set_or(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (a | b).ids()


@query(f"{A} except {B}")
def set_sub(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (a - b).ids()


@query(f"({A} union {B}) except ({A} intersect {B})")
def set_xor(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (a ^ b).ids()


@query(f"({A} intersect {B}) union ({C} except {K})")
def set_nested(spark, d):
    a, b, c, k = _sets(spark, d)
    return ((a & b) | (c - k)).ids()


@query(f"{A} union select event_id from events where false")
def set_empty(spark, d):
    a, *_ = _sets(spark, d)
    return (a | a.ds.idx["event_type"]["no such type"]).ids()


@query("select event_id from events except select event_id from events where event_type = 'error'")
def set_complement(spark, d):
    return (~events(spark, d).idx["event_type"]["error"]).ids()


@query(f"{A} union all {B} union all {K}")
def set_merge(spark, d):
    a, b, _, k = _sets(spark, d)
    return merged(a, b, k)


@query(f"{A} intersect {C} intersect select event_id from events where user_id between 3 and 20")
def set_many_and(spark, d):
    a, _, c, _ = _sets(spark, d)
    return intersection(a, c, a.ds.idx["user_id"][3:20]).ids()


@query("select event_id from events where user_id in (1, 2, 3, 5, 8, 13, 21)")
def set_many_or(spark, d):
    user = events(spark, d).idx["user_id"]
    out = user[1]
    for k in (2, 3, 5, 8, 13, 21):
        out = out | user[k]
    return out.ids()


@query("select doc_id from documents join labels using (doc_id) where quality is not null and lang is not null")
def set_fields(spark, d):
    idx = labelled(spark, d).idx
    return (idx["quality"] & idx["lang"]).ids()


@query(f"select event_id from ({A} order by event_id limit 300) t intersect ({B} union {K})")
def set_joined(spark, d):
    a, b, _, k = _sets(spark, d)
    return (a[:300] & (b | k)).ids()


# --- slices ------------------------------------------------------------------------------------------------------


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as pos from events where event_type = 'purchase') t where pos >= 0 and pos < 100 and pos % 2 = 0")
def slc_result(spark, d):
    a, *_ = _sets(spark, d)
    return a[0:100:2].ids()


@query(f"select event_id from ({B} order by event_id limit 200) t intersect {A}")
def slc_before_set(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (b[:200] & a).ids()


@query(f"select event_id from ({B} intersect {A}) t order by event_id limit 5")
def slc_after_set(spark, d):
    a, b, _, _ = _sets(spark, d)
    return (b & a)[:5].ids()


@query("select event_id from (select event_id, row_number() over (order by event_id desc) as pos from events where event_type = 'purchase') t where pos <= 10")
def slc_tail(spark, d):
    a, *_ = _sets(spark, d)
    return a.tail().ids()


@query("select event_id, row_number() over (order by event_id) - 1 as pos from events where user_id % 5 = 0")
def slc_positions(spark, d):
    return events(spark, d).idx["user_id"](lambda k: k % 5 == 0).positions()


@query("""select event_id from (select event_id, row_number() over (order by event_id) - 1 as pos, count(*) over () as n from events where event_type = 'view') t
          where pos >= n - 50 and pos < n - 10 and (pos - (n - 50)) % 3 = 0""")
def slc_negative(spark, d):
    return events(spark, d).idx["event_type"]["view"][-50:-10:3].ids()


@query("""select min(event_id) as first, max(event_id) as last, count(*) as n from (select event_id, event_id - row_number() over (order by event_id) as g from events where event_type = 'click') t group by g""")
def slc_runs(spark, d):
    *_, k = _sets(spark, d)
    return runs(k.ids(), "event_id")


# --- navigation --------------------------------------------------------------------------------------------------


def _probes(spark, d, forward):
    ds = events(spark, d)
    probes = ds.stream.ids()
    name = "ge_ref" if forward else "le_ref"
    return temporal.seek(probes, ds.idx["event_type"]["purchase"].ids(), "event_id", forward=forward, name=name)


@query("""select e.event_id, p.event_id as ge_ref from (select event_id from events) e
          asof left join (select event_id from events where event_type = 'purchase') p on e.event_id <= p.event_id""")
def nav_ge(spark, d):
    return _probes(spark, d, True)


@query("""select e.event_id, p.event_id as le_ref from (select event_id from events) e
          asof left join (select event_id from events where event_type = 'purchase') p on e.event_id >= p.event_id""")
def nav_le(spark, d):
    return _probes(spark, d, False)


@query("""select event_id, user_id, lag(event_id) over w as prev_id, lead(event_id) over w as next_id from events window w as (partition by user_id order by event_id)""")
def nav_prev_next(spark, d):
    rows = events(spark, d).stream.df("user_id")
    return temporal.prev_next(rows, "event_id", ["user_id"], prev="prev_id", next="next_id")


@query("select event_id, user_id, value, lag(value) over (partition by user_id order by event_id) as prev_value from events where event_type = 'purchase'")
def nav_prev_value(spark, d):
    rows = events(spark, d).idx["event_type"]["purchase"].df("user_id", "value")
    return temporal.carry(rows, {"prev_value": F.col("value")}, "event_id", ["user_id"], inclusive=False)


@query("""with f as (select event_id, user_id, event_type, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as c from events window w as (partition by user_id order by event_id)),
          g as (select *, sum(c) over (partition by user_id order by event_id) as run from f),
          r as (select user_id, run, lag(any_value(event_type)) over (partition by user_id order by run) as prev_different from g group by user_id, run)
          select g.event_id, g.user_id, g.event_type, r.prev_different from g join r using (user_id, run)""")
def nav_last_different(spark, d):
    rows = events(spark, d).stream.df("user_id", "event_type")
    return temporal.last_different(rows, "event_type", "event_id", ["user_id"])


@query("""select p.event_id, p.user_id, v.event_id as event_id_asof, v.value as value_asof from (select * from events where event_type = 'purchase') p
          asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.event_id > v.event_id""")
def nav_asof(spark, d):
    kind = events(spark, d).idx["event_type"]
    return temporal.asof(kind["purchase"].df("user_id"), kind["view"].df("user_id", "value"), "event_id", ["user_id"], strict=True)


@query("""select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over w as last_purchase,
          last_value(case when event_type = 'view' then value end ignore nulls) over w as last_view from events window w as (partition by user_id order by event_id rows unbounded preceding)""")
def nav_carry_forward(spark, d):
    rows = events(spark, d).stream.df("user_id", "event_type", "value")
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    state = rows.select("event_id", "user_id", of("purchase").alias("purchase"), of("view").alias("view"))
    return temporal.carry_forward(state, ["purchase", "view"], "event_id", ["user_id"]).drop("purchase", "view")


@query("select event_id, event_type from events where user_id = 3 and event_id < 5000")
def nav_prevs(spark, d):
    return events(spark, d).idx["user_id"][3].prevs(5000).select("event_id", "event_type")


@query("select event_id, event_type, user_id from events where event_type = 'purchase' order by event_id limit 40")
def nav_cursor(spark, d):
    """A client's walk over a set, forty steps on."""
    ds = events(spark, d)
    cursor = ds.idx["event_type"]["purchase"].cursor()
    rows = [cursor.next() for _ in range(40)]
    return spark.createDataFrame([(r.event_id, r.event_type, r.user_id) for r in rows], "event_id long, event_type string, user_id long")


@query("""select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (order by event_id) as purchase,
          last_value(case when event_type = 'view' then value end ignore nulls) over (order by event_id) as view from events
          where user_id = (select user_id from events where event_id = 500) qualify event_id in (select event_id from events where user_id = (select user_id from events where event_id = 500) and event_id >= 500 order by event_id limit 3)""")
def nav_state_cursor(spark, d):
    """The state of a user's log at message 500 and at the next two."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    ds = Dataset(rows.withColumns({"purchase": of("purchase"), "view": of("view")}), {"user_id": "user_id"}, msg_id="event_id")
    cursor = StateCursor(ds.idx["user_id"][ds[500]["user_id"]], ["purchase", "view"], at=500)
    seen = [(500, *cursor.state.values())]
    for _ in range(2):
        seen.append((cursor.next()["event_id"], *cursor.state.values()))
    return spark.createDataFrame(seen, "event_id long, purchase double, view double")


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev_role from conversations")
def nav_conversation(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return temporal.carry(rows, {"prev_role": F.col("role")}, "turn", ["conv_id"], inclusive=False)


# --- aggregates --------------------------------------------------------------------------------------------------


@query(f"select count(*) as n from ({A} intersect {C}) t")
def agg_count(spark, d):
    a, _, c, _ = _sets(spark, d)
    return (a & c).ids().agg(F.count("*").alias("n"))


@query("select l_partkey as key, count(distinct l_orderkey) as n_refs from lineitem group by l_partkey")
def agg_frequency(spark, d):
    return orders(spark, d).idx["part"].stats().select("key", "n_refs")


@query("select user_id, list_sort(list(distinct event_type)) as values from events group by user_id")
def agg_values_seen(spark, d):
    return quality.values_seen(events(spark, d).stream.df("user_id", "event_type"), "user_id", "event_type")


@query("""select o_orderkey as msg_id, count(distinct p_brand) as n_brands from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'F' group by 1""")
def ext_enrich(spark, d):
    """An extension: messages joined with a dimension."""
    postings = orders(spark, d).postings("part")
    done = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("msg_id"))
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), "p_brand")
    return postings.join(done, "msg_id").join(part, "key").groupBy("msg_id").agg(F.countDistinct("p_brand").alias("n_brands"))


# --- data quality ------------------------------------------------------------------------------------------------


def _lines(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


@query("""select 'l_quantity in bounds' as rule, count(*) filter (l_quantity between 0 and 49) as n_pass, count(*) filter (not l_quantity between 0 and 49) as n_fail from lineitem
          union all select 'l_discount in bounds', count(*) filter (l_discount >= 0), count(*) filter (l_discount < 0) from lineitem""")
def dq_bounds(spark, d):
    return quality.check(_lines(spark, d), [quality.bounded("l_quantity", 0, 49), quality.bounded("l_discount", 0)])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not l_quantity between 0 and 49")
def dq_offenders(spark, d):
    return quality.offenders(_lines(spark, d), quality.bounded("l_quantity", 0, 49)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""select 'quality present' as rule, count(quality) as n_pass, count(*) - count(quality) as n_fail from documents left join labels using (doc_id)
          union all select 'lang present', count(lang), count(*) - count(lang) from documents""")
def dq_required(spark, d):
    return quality.check(labelled(spark, d).messages, quality.required("quality", "lang"))


@query("""select 'unit price' as rule, count(*) filter (abs(l_extendedprice / l_quantity - p_retailprice) <= 500) as n_pass, count(*) filter (abs(l_extendedprice / l_quantity - p_retailprice) > 500) as n_fail
          from lineitem join part on p_partkey = l_partkey""")
def dq_ratio(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice")
    rows = _lines(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return quality.check(rows, [quality.ratio(F.col("l_extendedprice"), F.col("l_quantity"), F.col("p_retailprice"), 500, "unit price")])


@query("select 'l_discount <= l_tax' as rule, count(*) filter (l_discount <= l_tax) as n_pass, count(*) filter (l_discount > l_tax) as n_fail from lineitem")
def dq_ordered(spark, d):
    return quality.check(_lines(spark, d), [quality.ordered("l_discount", "l_tax")])


@query("""select 'a sorted' as rule, count(*) filter (l_discount * 100 <= l_quantity or l_discount = 0) as n_pass, count(*) filter (l_discount * 100 > l_quantity and l_discount > 0) as n_fail from lineitem""")
def dq_array_sorted(spark, d):
    rows = _lines(spark, d).select(F.array(F.col("l_discount") * 100, F.col("l_quantity")).alias("a"))
    return quality.check(rows, [quality.is_sorted("a")])


@query("""select count(*) filter (u is null) as n_pass, count(*) filter (u is not null) as n_fail from (select distinct user_id from events where event_type = 'error') a
          left join (select distinct user_id as u from events where event_type = 'purchase' and value > 95) b on user_id = u""")
def dq_disjoint(spark, d):
    ds = events(spark, d)
    kind = ds.idx["event_type"]
    return quality.disjoint(kind["error"].df("user_id"), kind["purchase"](lambda m: m.value > 95).df("user_id"), "user_id")


@query("select count(*) filter (p is not null) as n_pass, count(*) filter (p is null) as n_fail from (select distinct l_partkey from lineitem) a left join (select p_partkey as p from part where p_size > 5) b on l_partkey = p")
def dq_subset(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return quality.subset(_lines(spark, d), part, "l_partkey")


@query("select min(o_orderdate) as low, max(o_orderdate) as high from orders")
def dq_date_floor(spark, d):
    return quality.key_bounds(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate")


@query("select user_id, count(distinct event_type) = 1 as constant from events group by user_id")
def dq_constant(spark, d):
    return quality.constant_per_key(events(spark, d).stream.df("user_id", "event_type"), "user_id", "event_type")


@query("""select event_id, user_id, total, abs(total - lag(total) over (partition by user_id order by event_id) - step) <= 0.5 as holds
          from (select event_id, user_id, event_id % 7 as step, sum(event_id % 7) over (partition by user_id order by event_id)::bigint as total from events) t""")
def dq_delta(spark, d):
    rows = events(spark, d).stream.df("user_id").withColumn("step", F.col("event_id") % 7)
    from pyspark.sql import Window

    rows = rows.withColumn("total", F.sum("step").over(Window.partitionBy("user_id").orderBy("event_id")))
    return quality.running_delta(rows, ["user_id"], "event_id", "total", F.col("step"), 0.5).drop("step")


@query("select count(*) filter (event_type is not null) as n_pass, count(*) filter (event_type is null) as n_fail from events")
def dq_everywhere(spark, d):
    ds = events(spark, d)
    missing = ds.idx["event_type"].missing().ids()
    return quality.subset(ds.stream.ids(), ds.stream.ids().join(missing, "event_id", "left_anti"), "event_id")


@query("""with v as (select event_id, user_id, (value::int)::bigint as price from events),
          b as (select *, case when price <> lag(price) over w then lag(price) over w end as other from v window w as (partition by user_id order by event_id)),
          c as (select *, last_value(other ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as o from b)
          select event_id, user_id, price, coalesce(sign(price - o), 0)::int as tick from c""")
def dq_tick(spark, d):
    rows = events(spark, d).stream.df("user_id", "value").select("event_id", "user_id", F.rint("value").cast("bigint").alias("price"))
    return quality.tick_direction(rows, ["user_id"], "event_id", "price")


@query("""select count(*) filter (v.value >= p.value) as n_pass, count(*) filter (v.value is null or v.value < p.value) as n_fail from (select * from events where event_type = 'purchase') p
          asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.event_id > v.event_id""")
def dq_latest_state(spark, d):
    """Each message against the values of the latest earlier state of its key."""
    kind = events(spark, d).idx["event_type"]
    return quality.latest_state(kind["purchase"].df("user_id", "value"), kind["view"].df("user_id", "value"), ["user_id"], "event_id", lambda own, state: state["value"] >= own["value"])


@query("""with v as (select event_id, user_id, (value::int)::bigint as price from events),
          b as (select *, case when price <> lag(price) over w then lag(price) over w end as other from v window w as (partition by user_id order by event_id)),
          c as (select *, last_value(other ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as o from b),
          t as (select coalesce(sign(price - o), 0)::int as tick from c)
          select tick, count(*) as n_scan, count(*) as n_index from t group by tick""")
def dq_tick_two_ways(spark, d):
    """The direction of a price against the key's last different one: by a scan of the log, and by the key's own postings and places."""
    rows = events(spark, d).stream.df("user_id", "value").select("event_id", "user_id", F.rint("value").cast("bigint").alias("price"))
    scan = quality.tick_direction(rows, ["user_id"], "event_id", "price").groupBy("tick").agg(F.count("*").alias("n_scan"))
    index = quality.tick_by_index(rows, "user_id", "event_id", "price").groupBy("tick").agg(F.count("*").alias("n_index"))
    return scan.join(index, "tick", "full").select("tick", "n_scan", "n_index")


# --- decoding ----------------------------------------------------------------------------------------------------


@query("select event_id, cast(props->>'$.k' as int) as k from events")
def dec_json(spark, d):
    rows = events(spark, d).stream.df("props")
    return rows.select("event_id", F.variant_get(codecs.CODECS["json"].load(F.col("props").cast("binary")), "$.k", "int").alias("k"))


@query("select event_id, user_id, -event_id as negative, event_type as kind from events")
def dec_struct(spark, d):
    rows = events(spark, d).stream.df("user_id", "event_type")
    raw = F.concat(binary.le_bytes(F.col("event_id"), 8), binary.le_bytes(F.col("user_id"), 4), binary.le_bytes(-F.col("event_id"), 8), F.rpad("event_type", 12, " ").cast("binary"))
    spec = binspec.parse("[m]\nevent_id = Q\nuser_id = I\nnegative = q\nkind = 12s\n")
    out = rows.select(binspec.decode(raw, spec, "m").alias("m"))
    return out.select(F.col("m.event_id").cast("bigint").alias("event_id"), F.col("m.user_id").alias("user_id"), "m.negative", "m.kind")


@query("""select event_id, 0 as seq, 30 as msg_type, user_id % 1000 as a, cast(null as bigint) as n from events
          union all select event_id, 1, 53, user_id % 1000, 2 from events""")
def dec_packets(spark, d):
    spec = binspec.parse(PACKETS)
    u = F.col("user_id") % 1000
    add = F.concat(binary.le_bytes(F.lit(8), 2), binary.le_bytes(F.lit(30), 2), binary.le_bytes(u, 4))
    many = F.concat(binary.le_bytes(F.lit(16), 2), binary.le_bytes(F.lit(53), 2), binary.le_bytes(u, 2), binary.le_bytes(F.lit(2), 2), binary.le_bytes(u, 4), binary.le_bytes(u + 1, 4))
    head = F.concat(binary.le_bytes(F.lit(40), 2), binary.le_bytes(F.lit(2), 1), F.lit(b" "), binary.le_bytes(F.col("event_id"), 4), binary.le_bytes(F.col("event_id"), 8))
    rows = events(spark, d).stream.df("user_id").select("event_id", F.concat(head, add, many).alias("payload"))
    got = binspec.by_type(binspec.packets(rows, spec, count="pieces"), spec)
    one = got[30].select("event_id", "seq", "msg_type", F.col("order").alias("a"), F.lit(None).cast("bigint").alias("n"))
    two = got[53].where(F.col("levels")[1]["price"] == F.col("levels")[0]["price"] + 1).select("event_id", "seq", "msg_type", F.col("levels")[0]["price"].alias("a"), F.size("levels").cast("bigint").alias("n"))
    return one.union(two)


PACKETS = """
[header]
bytes = H
pieces = B
pad = 1s
serial = I
sent = Q
[add]
_type = 30
size = H
type = H
order = I
[book]
_type = 53
size = H
type = H
id = H
n = H
@levels = n level
[level]
price = I
"""


@query("select event_id, (extract(hour from ts) * 3600000 + extract(minute from ts) * 60000 + extract(millisecond from ts))::int as ms, ts::date as day from events")
def dec_time(spark, d):
    rows = events(spark, d).stream.df("ts")
    return rows.select("event_id", scalars.time_of_day(F.date_format("ts", "HH:mm:ss.SSS")).alias("ms"), scalars.slash_date(F.date_format("ts", "yyyy/MM/dd")).alias("day"))


@query("select event_id, '10.0.0.1' as ip, '9000' as port, strlen(event_type)::varchar as length from events")
def dec_header(spark, d):
    rows = events(spark, d).stream.df("event_type")
    raw = record(F.col("event_type"), F.lit("10.0.0.1"), F.lit("9000"), F.lit("09:00:00.000"), F.lit("1.000000"))
    parts = header_columns(raw)
    return rows.select("event_id", *[parts[n].alias(n) for n in ("ip", "port", "length")])


@query("select event_id, upper(hex(event_type)) as digits from events")
def dec_hex(spark, d):
    rows = events(spark, d).stream.df("event_type")
    return rows.select("event_id", F.regexp_replace(binary.hexdump(F.col("event_type").cast("binary")), " ", "").alias("digits"))


@query("select event_id as id, user_id::int as who, value as amount, abs(value - round(value)) <= 0.1 as whole from events")
def dec_translate(spark, d):
    out = scalars.translated(events(spark, d).stream.df("user_id", "value"), {"event_id": "id", "user_id": "who", "value": "amount"}, {"who": "int"})
    return out.withColumn("whole", scalars.about_equal(F.col("amount"), F.round("amount"), 0.1))


# --- streams -----------------------------------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by 1")
def str_tumbling(spark, d):
    rows = capture.event_time(events(spark, d).stream.df("ts"), "ts")
    return capture.tumbling(rows, "ts", "1 hour", F.count("*").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(c) over (partition by user_id order by ts, event_id) as s
          from (select user_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '2 hours' then 1 else 0 end as c from events) t) u group by user_id, s""")
def str_session(spark, d):
    rows = capture.event_time(events(spark, d).stream.df("ts", "user_id"), "ts")
    return capture.sessions(rows, "ts", "2 hours", F.count("*").alias("n"), by=("user_id",)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select distinct user_id, event_type from events")
def str_dedup(spark, d):
    return capture.first_only(events(spark, d).stream.df("user_id", "event_type").select("user_id", "event_type"), ["user_id", "event_type"])


@query("select event_id, user_id % 3 as a, user_id % 5 as b, user_id % 2 as c from events")
def dec_three_lists(spark, d):
    """A message with three repeating groups, one after the other."""
    spec = binspec.parse("[m]\nid = I\nna = B\nnb = B\nnc = B\n@as = na one\n@bs = nb two\n@cs = nc one\n[one]\nv = H\n[two]\nv = I\nw = b\n")
    u = F.col("user_id")
    group = lambda n, item: F.unhex(F.concat_ws("", F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("array()").cast("array<int>")), lambda k: F.hex(item(k)))))
    one, two = (lambda k: binary.le_bytes(k + 7, 2)), (lambda k: F.concat(binary.le_bytes(k * 1000, 4), binary.le_bytes(-k, 1)))
    rows = events(spark, d).stream.df("user_id")
    raw = F.concat(binary.le_bytes(F.col("event_id"), 4), binary.le_bytes(u % 3, 1), binary.le_bytes(u % 5, 1), binary.le_bytes(u % 2, 1), group(u % 3, one), group(u % 5, two), group(u % 2, one))
    m = rows.select("event_id", "user_id", raw.alias("raw")).select("event_id", binspec.decode(F.col("raw"), spec, "m").alias("m"))
    right = F.forall(F.arrays_zip(F.col("m.bs.v").alias("v"), F.col("m.bs.w").alias("w")), lambda x: x["v"] == -1000 * x["w"]) & F.forall("m.cs.v", lambda x: x == 8)
    sizes = [F.when(right, F.size(F.col(f"m.{c}s"))).cast("bigint").alias(c) for c in "abc"]
    return m.select("event_id", *sizes)


@query("select event_type as key, count(*) as n_refs from events group by 1")
def str_capture(spark, d):
    path, table = scratch(spark, "capture"), spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    capture.capture(stream, path, {"event_type": "event_type"}, ["ts", "event_id"], f"{path}-progress").awaitTermination()
    return capture.compact_capture(spark, path, ["event_type"]).idx["event_type"].stats().select("key", "n_refs")
