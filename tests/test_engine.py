import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.functions import binary, binspec, codecs, scalars
from tidelog.operators import quality, temporal
from tidelog.operators.positions import with_position
from tidelog.plans.compiler import py
from tidelog.sources.dataset import Dataset, FieldSpec, open_dataset
from tidelog.sources.playback import END, START, BadRecord, dereference, header_columns, markup, parse, read_playback, read_playback_files, record
from tidelog.sources.writer import Writer, adaptive_layout, ingest, last_id, runs
from tidelog.streaming import capture

# --- writing -----------------------------------------------------------------------------------------------------


def test_ingest_and_reopen(spark, folder):
    rows = spark.createDataFrame([(3, "a", [1, 2, 2]), (1, "b", None), (2, None, [2]), (4, "a", [])], "ts long, sym string, tags array<int>")
    ds = ingest(rows, f"{folder}/log", {"sym": "sym", "tag": "tags"}, ["ts"])
    again = open_dataset(spark, f"{folder}/log")
    for d in (ds, again, again.access("postings"), again.access("scan")):
        assert [r.ts for r in d] == [1, 2, 3, 4] and len(d) == 4
        assert sorted(r.msg_id for r in d.idx["sym"]["a"].ids().collect()) == [2, 3]
        assert sorted(r.msg_id for r in d.idx["tag"][2].ids().collect()) == [1, 2]
        assert sorted(r.msg_id for r in (d.idx["tag"][1] & d.idx["tag"][2]).ids().collect()) == [2]
        assert sorted(r.msg_id for r in d.idx["tag"](py(lambda t: t == 1)).ids().collect()) == [2]
    assert list(again.idx["tag"].items()) == [(1, 1), (2, 2)] and again.idx["tag"].mapping() == "1:many"
    assert last_id(spark, f"{folder}/log") == 3 and last_id(spark, f"{folder}/none") == -1
    assert {r.field: r.layout for r in adaptive_layout(again).collect()} == {"sym": "postings", "tag": "postings"}
    with pytest.raises(FileExistsError):
        Writer(spark, f"{folder}/log", {})
    assert len(ingest(rows, f"{folder}/log", {"sym": "sym"}, ["ts"], overwrite=True)) == 4


def test_layout_of_many_keys(spark):
    rows = spark.range(140_000).select(F.col("id").alias("msg_id"), (F.col("id") % 70_000).alias("user"), F.col("id").alias("clock"))
    layouts = adaptive_layout(Dataset(rows, {"user": "user", "clock": "clock"})).collect()
    assert {r.field: (r.nmsgs, r.nvals, r.layout) for r in layouts} == {"user": (140_000, 70_000, "dictionary column"), "clock": (140_000, 140_000, "column")}


def test_segments_continue(spark, folder):
    with Writer(spark, f"{folder}/log", {"k": F.col("v") % 3}) as w:
        assert w.append(spark.range(48).select(F.col("id").alias("v")), ["v"]) == 0
        assert w.append(spark.range(48, 96).select(F.col("id").alias("v")), ["v"]) == 48
    ds = open_dataset(spark, f"{folder}/log")
    assert [r.v for r in ds] == list(range(96)) and [r.msg_id for r in ds[46:50]] == [46, 47, 48, 49]
    assert len(ds.idx["k"][0]) == 32


def test_last_segment_again(spark, folder):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("v"))
    w = Writer(spark, f"{folder}/log", {})
    w.append(rows(0, 10), ["v"])
    assert w.append(rows(20, 25), ["v"], segment=0) == 0
    assert w.append(rows(30, 40), ["v"]) == 5 and w.append(rows(50, 52), ["v"], segment=1) == 5
    with pytest.raises(ValueError):
        w.append(rows(0, 1), ["v"], segment=0)
    ds = w.close()
    assert len(ds) == 7 and [(r.msg_id, r.v) for r in ds] == list(enumerate([20, 21, 22, 23, 24, 50, 51])) and [r.v for r in ds[:3]] == [20, 21, 22]


def test_codecs_in_the_writer(spark, folder):
    rows = spark.createDataFrame([("batman", 25, [1, 2]), ("batman", 5, None), ("robin", None, [2]), ("superman", 2000, [])], "name string, age long, tags array<long>")
    ds = ingest(rows.withColumn("n", F.monotonically_increasing_id()), f"{folder}/log", {"name": "name", "age": "age", "tag": "tags"}, ["n"], codec="str", codecs={"name": "str", "age": "uint32", "tag": "uint16"}, message="name")
    again = open_dataset(spark, f"{folder}/log")
    for d in (ds, again, again.access("postings"), again.access("scan")):
        assert sorted(d.idx["age"].keys()) == [5, 25, 2000] and d.idx["name"].keys() == ["batman", "robin", "superman"]
        assert sorted(r.msg_id for r in d.idx["age"](lambda k: k >= 6).ids().collect()) == [0, 3]
        assert sorted(r.msg_id for r in (d.idx["name"]["batman"] & d.idx["age"][25]).ids().collect()) == [0]
        assert sorted(r.msg_id for r in d.idx["tag"][2].ids().collect()) == [0, 2]
    assert [r.msg for r in again.loaded().orderBy("msg_id").collect()] == ["batman", "batman", "robin", "superman"] and dict(again.messages.dtypes)["raw"] == "binary"


def test_compound_queries_use_the_index(spark, folder):
    rows = spark.range(2000).select(F.col("id").alias("v"), (F.col("id") % 50).alias("a"), (F.col("id") % 30).alias("b"))
    ds = ingest(rows, f"{folder}/log", {"a": "a", "b": "b"}, ["v"])
    a, b = ds.access("postings").idx["a"], ds.access("postings").idx["b"]
    plan = lambda rel: rel.ids()._jdf.queryExecution().optimizedPlan().toString()
    files = lambda rel: " ".join(rel.ids().inputFiles())
    both = a[3] & b[3]
    assert "postings/field=a" in files(both) and "postings/field=b" in files(both) and "/messages/" not in files(both)
    assert sorted(r.msg_id for r in both.ids().collect()) == [i for i in range(2000) if i % 50 == 3 and i % 30 == 3]
    tested = a[3](lambda m: m.v > 1000)
    assert "postings/field=a" in files(tested) and "LeftSemi" in plan(tested)
    assert sorted(r.msg_id for r in tested.ids().collect()) == [i for i in range(1001, 2000) if i % 50 == 3]
    mixed = a[3] & ds.access("postings").stream(lambda m: m.b == 3)
    assert "postings/field=a" in files(mixed) and mixed.count() == both.count()
    assert sorted(r.msg_id for r in ((a[1] | a[2]) - b[1]).ids().collect()) == [i for i in range(2000) if i % 50 in (1, 2) and i % 30 != 1]
    assert "/postings/" not in files(ds.access("scan").idx["a"][3] & ds.access("scan").idx["b"][3])


def test_missing_and_mixed_keys(spark):
    ds = Dataset(spark.createDataFrame([(0, 3), (1, None)], "msg_id long, a long"), {"a": "a"})
    a = ds.idx["a"]
    assert [r.msg_id for r in (a[None] | a[3]).ids().collect()] == [0] and (a[None] & a[3]).count() == 0 and a[None].count() == 0 and (a[None] | a[None]).count() == 0


def test_postings_only_field(spark, folder):
    rows = spark.createDataFrame([(1, "x y"), (2, "y"), (3, "")], "ts long, words string")
    ds = ingest(rows, f"{folder}/log", {"word": F.filter(F.split("words", " "), lambda w: w != "")}, ["ts"])
    bare = Dataset(ds.messages.select("msg_id", "ts"), {"word": FieldSpec(None, True)}, path=ds.path)
    word = bare.idx["word"]
    assert sorted(r.msg_id for r in word["y"].ids().collect()) == [0, 1]
    assert sorted(r.msg_id for r in (word["y"] - word["x"]).ids().collect()) == [1]
    assert sorted(r.msg_id for r in word(py(lambda w: w > "a")).ids().collect()) == [0, 1]


def test_large_and_empty_messages(spark, folder):
    rows = spark.createDataFrame([(1, b""), (2, b"x" * (2 << 20))], "ts long, raw binary")
    assert [len(r.raw) for r in ingest(rows, f"{folder}/log", {}, ["ts"])] == [0, 2 << 20]


def test_key_bytes(spark):
    keys = [b"abc", b"abcd", b"erm", b"ab\0c", b"erq", b"x123456789", b"", b"\x80", b"\x7f\0"]
    ds = Dataset(spark.createDataFrame(list(enumerate(map(bytearray, keys))), "msg_id long, k binary"), {"k": "k"})
    k = ds.idx["k"]
    assert k.keys() == sorted(keys)
    assert all(len(k[x]) == 1 for x in keys)
    assert not any(x in k for x in (b"not_there", b"x123", b"ab", b"e", b"ab\0"))
    assert runs(ds.stream[1:4].ids()).collect()[0].asDict() == {"first": 1, "last": 3, "n": 3}


def test_positions_over_buckets(spark):
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("i"))
    got = with_position(rows, "i", "pos", bucket=64).orderBy("i").collect()
    assert [r.pos for r in got] == list(range(334))


# --- playback ----------------------------------------------------------------------------------------------------


def make(payloads):
    out = b""
    for k, p in enumerate(payloads):
        out += START + f"/A/{len(p)}/10.0.0.{k % 5}/9000/09:00:00.00{k % 10}/{1000 + k}.000001//".encode() + END + p + b"\n"
    return out


def test_playback(spark, tmp_path):
    payloads = [f"p{k}".encode() * (k % 9) for k in range(50)]
    payloads[3], payloads[7], payloads[11] = b"a\nb\n", b"x" + make([b"inner"]) + b"y", bytes(range(256))
    path = tmp_path / "cap.pb"
    path.write_bytes(make(payloads))
    (tmp_path / "packed.pb.gz").write_bytes(gzip.compress(make(payloads[:5])))
    (tmp_path / "empty.pb").write_bytes(b"")
    (tmp_path / "cut.pb").write_bytes(make(payloads[:3])[:-4])
    for split in (64 << 20, 997, 211):
        got = read_playback(spark, str(path), split).orderBy("offset").collect()
        assert [bytes(r.payload) for r in got] == payloads, split
        assert got[4].ip == "10.0.0.4" and got[4].time == "1004.000001" and bytes(got[4].msg).endswith(payloads[4])
    assert read_playback(spark, str(tmp_path / "packed.pb.gz")).count() == 5
    assert read_playback(spark, str(tmp_path / "empty.pb")).count() == 0
    assert read_playback(spark, str(tmp_path / "cut.pb")).count() == 2
    assert read_playback_files(spark, f"file://{tmp_path}").count() == 57
    with pytest.raises(BadRecord):
        list(parse(b"garbage", "x"))
    marks = markup(read_playback(spark, str(path)))
    assert sorted(bytes(r.msg) for r in dereference(marks).collect()) == sorted(bytes(r.msg) for r in read_playback(spark, str(path)).collect())
    one = spark.range(1).select(record(F.lit("hi"), F.lit("1.2.3.4"), F.lit("80"), F.lit("09:00:00.000"), F.lit("1.5")).alias("raw"))
    head = one.select(*[c.alias(n) for n, c in header_columns(F.col("raw")).items()]).first()
    assert (head.hint, head.length, head.ip, head.port, head.time_num) == ("A", "2", "1.2.3.4", "80", "1.5")
    ds = ingest(read_playback(spark, str(path)).withColumn("type", F.col("offset") % 3), f"file://{tmp_path}/log", {"ip": "ip", "type": "type"}, ["offset"])
    for ip in ds.idx["ip"]:
        assert [bytes(r.payload) for r in ds.idx["ip"][ip]] == [p for k, p in enumerate(payloads) if f"10.0.0.{k % 5}" == ip]


def test_playback_in_pieces(spark, tmp_path):
    from tidelog.sources.playback import PIECE, parse_pieces, unpacked

    payloads = [f"p{k}".encode() * (k % 9) for k in range(30)]
    payloads[3], payloads[7], payloads[11], payloads[29] = b"a\nb\n", b"x" + make([b"in", b"in"]) + b"y", bytes(range(256)), b"\n\n"
    cap = make(payloads)
    broken = cap.replace(b"/A/0/", b"/A/?/", 1)
    for data in (cap, cap[:-1], cap[:-2], cap[:-60], cap + START[:5], cap + b"\n", b"", broken, cap + b"*M*garbage"):
        for n in (1, 2, 7, 64, 1000, len(cap) + 99):
            cut = lambda b: [b[i : i + n] for i in range(0, len(b), n)]  # noqa: B023, E731
            for pieces in (cut(data), [*cut(data), b""], unpacked(cut(gzip.compress(data[:900]) + gzip.compress(data[900:])))):
                got, want = [], []
                for out, rows in ((got, parse_pieces(pieces, "x")), (want, parse(data, "x"))):
                    try:
                        out.extend(rows)
                    except BadRecord as error:
                        out.append(str(error))
                assert got == want, (len(data), n)

    drawn = []
    rows = parse_pieces((drawn.append(k) or cap for k in range(1000)), "x")
    assert [next(rows)[10] for _ in range(61)] == [*payloads, *payloads, payloads[0]] and len(drawn) == 3  # not all pieces first

    payloads = [b"%d" % k * 9 for k in range(60_000)] + [b"\n" * (3 * PIECE), b"last"]
    large = b"".join(make([p]) for p in payloads)
    (tmp_path / "a.pb").write_bytes(large)
    (tmp_path / "b.pb.gz").write_bytes(gzip.compress(large))
    (tmp_path / "c.pb").write_bytes(cap)
    (tmp_path / "d.pb").write_bytes(b"")
    got = read_playback_files(spark, f"file://{tmp_path}").orderBy("path", "offset").toLocalIterator()
    want = [row for name, data in (("a.pb", large), ("b.pb.gz", large), ("c.pb", cap)) for row in parse(data, f"file:{tmp_path}/{name}")]
    assert all(tuple(bytes(x) if isinstance(x, bytearray) else x for x in row) == next_row for row, next_row in zip(got, want, strict=True))
    assert read_playback(spark, str(tmp_path / "b.pb.gz")).count() == len(payloads)


# --- decoding ----------------------------------------------------------------------------------------------------


def test_binary_numbers(spark):
    one = spark.range(1).select(F.lit(bytes([1, 2, 255, 255, 255, 255, 255, 255, 255, 255])).alias("b"))
    r = one.select(binary.le_unsigned(F.col("b"), 0, 2), binary.le_unsigned(F.col("b"), 2, 8), binary.le_signed(F.col("b"), 2, 8), binary.le_signed(F.col("b"), 9, 1), binary.le_unsigned(F.col("b"), 9, 2), binary.hexdump(F.substring("b", F.lit(1), F.lit(2)))).first()
    assert tuple(r) == (513, (1 << 64) - 1, -1, -1, None, "01 02")


def test_packets(spark):
    spec = binspec.parse("[header]\nsize = H\nMsgCount = B\nx = 1s\n[add]\n_type = 30\nsize = H\ntype = H\nname = 4s\nlevels = 3H\n[list]\n_type = 53\nsize = H\ntype = H\nn = H\n@items = n item\n[item]\np = i\n")
    import struct

    add = struct.pack("<HH4s3H", 14, 30, b"ab \0", 1, 2, 3)
    many = struct.pack("<HHHii", 14, 53, 2, -5, 7)
    whole = struct.pack("<HBs", 32, 2, b" ") + add + many
    rows = binspec.packets(spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(whole[:-3])), (2, bytearray(b""))], "id long, payload binary"), spec)
    got = binspec.by_type(rows, spec)
    assert [(r.id, r.seq, r.name, r.levels) for r in got[30].orderBy("id").collect()] == [(0, 0, "ab", [1, 2, 3]), (1, 0, "ab", [1, 2, 3])]
    assert [(r.id, [x.p for x in r["items"]]) for r in got[53].collect()] == [(0, [-5, 7])]
    assert binspec.by_type(rows, spec, first_only=True)[30].first().levels == 1
    assert {r.id: r.types for r in binspec.message_types(rows, "id").collect()} == {0: [30, 53], 1: [30]}
    with pytest.raises(ValueError):
        binspec.parse("[m]\nx = 3Z\n")


def test_codecs_and_scalars(spark):
    row = spark.createDataFrame([("é", 513)], "s string, n long")
    for name, column, value in (("str", "s", "é"), ("uint16", "n", 513), ("uint32", "n", 513), ("uint64", "n", 513)):
        c = codecs.CODECS[name]
        assert row.select(c.load(c.dump(F.col(column)))).first()[0] == value
    j = codecs.json_codec("a int")
    assert spark.range(1).select(j.load(j.dump(F.struct(F.lit(3).alias("a"))))["a"]).first()[0] == 3
    t = spark.createDataFrame([("09:00:01.5", "2020/02/29", "1.000002"), ("25:00:00", "2021/02/29", None)], "t string, d string, e string")
    a, b = t.select(scalars.time_of_day(F.col("t")).alias("t"), scalars.slash_date(F.col("d")).cast("string").alias("d"), F.unix_micros(scalars.epoch_time(F.col("e"))).alias("e")).collect()
    assert (a.t, a.d, a.e) == (32_401_500, "2020-02-29", 1_000_002) and (b.t, b.d, b.e) == (None, None, None)
    out = scalars.translated(spark.createDataFrame([("7", "x")], "a string, b string"), {"a": "n"}, {"n": "int", "b": "int"}).first()
    assert (out.n, out.b) == (7, None)


# --- navigation and quality ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ticks(spark):
    rows = [(i, f"k{i % 3}", None if i % 7 == 0 else (i * i) % 5) for i in range(200)]
    return spark.createDataFrame(rows, "id long, k string, v long"), pd.DataFrame(rows, columns=["id", "k", "v"])


def test_carry(ticks):
    df, p = ticks
    for bucket in (7, 1 << 16):
        got = temporal.carry(df, {"x": F.col("v")}, "id", ["k"], bucket=bucket).orderBy("id").toPandas()["x"]
        want = p.groupby("k")["v"].ffill()
        assert got.fillna(-1).tolist() == want.fillna(-1).tolist()
        back = temporal.carry(df, {"x": F.col("v")}, "id", [], inclusive=False, reverse=True, bucket=bucket).orderBy("id").toPandas()["x"]
        assert back.fillna(-1).tolist() == p["v"].bfill().shift(-1).fillna(-1).tolist()


def test_seek_and_asof(ticks):
    df, p = ticks
    odd = df.where("id % 4 = 1")
    targets = p[p.id % 4 == 1].id.tolist()
    for forward in (False, True):
        for strict in (False, True):
            got = {r.id: r.ref for r in temporal.seek(df, odd, "id", forward=forward, strict=strict, bucket=16).collect()}
            for i in p.id:
                fit = [t for t in targets if (t > i or (t == i and not strict) if forward else t < i or (t == i and not strict))]
                assert got[i] == ((min(fit) if forward else max(fit)) if fit else None), (i, forward, strict)
    joined = temporal.asof(df.select("id", "k"), odd, "id", ["k"]).orderBy("id").toPandas()
    for r in joined.itertuples():
        fit = p[(p.k == r.k) & (p.id <= r.id) & (p.id % 4 == 1)]
        assert (fit.id.max() if len(fit) else -1) == (r.id_asof if pd.notna(r.id_asof) else -1)


def test_last_different(spark):
    rows = [(i, "a", v) for i, v in enumerate([1, 1, 2, None, 2, 1, 3, 3])]
    got = temporal.last_different(spark.createDataFrame(rows, "id long, k string, v int"), "v", "id", ["k"]).orderBy("id").collect()
    assert [r.prev_different for r in got] == [None, None, 1, 1, 1, 2, 1, 1]
    ticks_ = quality.tick_direction(spark.createDataFrame(rows, "id long, k string, v int"), ["k"], "id", "v").orderBy("id").collect()
    assert [r.tick for r in ticks_ if r.v is not None] == [0, 0, 1, 1, -1, 1, 1]


def test_quality(spark):
    df = spark.createDataFrame([(1, 5.0, [1, 0, 3]), (2, None, [3, 1]), (3, -1.0, None)], "id long, v double, a array<int>")
    got = {r.rule: (r.n_pass, r.n_fail) for r in quality.check(df, [quality.bounded("v", 0), quality.is_sorted("a"), *quality.required("v")]).collect()}
    assert got == {"v in bounds": (1, 2), "a sorted": (1, 2), "v present": (2, 1)}
    assert [r.id for r in quality.offenders(df, quality.bounded("v", 0)).orderBy("id").collect()] == [2, 3]
    a, b = spark.range(5), spark.range(3, 9)
    assert tuple(quality.disjoint(a, b, "id").first()) == (3, 2) and tuple(quality.subset(a, b, "id").first()) == (2, 3)
    assert tuple(quality.key_bounds(df, "id").first()) == (1, 3)


# --- streams -----------------------------------------------------------------------------------------------------


def test_capture_in_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("v"), (F.col("id") % 2).cast("string").alias("parity")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("v long, parity string").option("maxFilesPerTrigger", 1).parquet(source)
    capture.capture(stream, f"file://{tmp_path}/log", {"parity": "parity"}, ["v"], f"file://{tmp_path}/progress").awaitTermination()
    ds = capture.compact_capture(spark, f"file://{tmp_path}/log", ["parity"])
    assert [r.msg_id for r in ds] == list(range(30)) and sorted(r.v for r in ds) == list(range(30))
    assert len(ds.idx["parity"]["1"]) == 15


def test_stream_state_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("a", 3, 7)], "k string, i long, v long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = capture.carry_state(stream, "k", "i", "v").writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.i, r.previous) for r in spark.table("carried").collect()) == [(1, None), (2, None), (3, 5)]
    timed = rows.select("k", F.timestamp_seconds(F.col("i") * 40).alias("ts"))
    assert sorted(r.n for r in capture.tumbling(timed, "ts", "1 minute", F.count("*").alias("n")).collect()) == [1, 1, 1]
    assert sorted(r.n for r in capture.sliding(timed, "ts", "2 minutes", "1 minute", F.count("*").alias("n")).collect()) == [1, 1, 2, 2]
    assert [r.n for r in capture.sessions(timed, "ts", "1 minute", F.count("*").alias("n")).collect()] == [3]
    late = capture.event_time(timed, "ts", "1 minute")
    assert capture.first_only(late, ["k"]).count() == 2


def test_late_rows_on_a_stream(spark, tmp_path):
    """Windows close at the watermark: a row that comes after it is left out, one within it is counted."""
    source = str(tmp_path / "in")
    for batch in ([0, 30, 200], [210], [90, 10], [400]):  # after the first two, 90 s and 10 s lie in windows that end before the watermark of 140 s
        spark.createDataFrame([(i,) for i in batch], "i long").select(F.timestamp_seconds("i").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    counted = capture.tumbling(capture.event_time(stream, "ts", "1 minute"), "ts", "1 minute", F.count("*").alias("n"))
    q = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {int(r.start.timestamp()): r.n for r in spark.sql("select cast(start as timestamp) as start, n from windows").collect()}
    assert got == {0: 2, 180: 2}
