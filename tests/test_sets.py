import random

import pytest
from pyspark.sql import functions as F

from tidelog.plans.compiler import predicate, py
from tidelog.plans.rel import Key, Nothing, SetOp, Stream
from tidelog.plans.rules import simplify
from tidelog.sources.dataset import Dataset

ROWS = [
    (0, b"First spy \0message", "spy", "127.0.0.1", "A", "True", None),
    (1, b"First blah message", "blah", "127.0.0.2", "A", None, None),
    (2, b"Second spy message", "spy", "127.0.0.1", "B", None, None),
    (3, b"Third spy message", "spy", "127.0.0.1", "C", None, "12121"),
    (4, b"First erm \0message", "erm", "127.0.0.2", "A", "True", None),
    (5, b"Second blah message", "blah", "127.0.0.1", "C", None, None),
]
NAMES = ("sym", "ip", "msg_type", "has_null", "thingy")


@pytest.fixture(scope="module")
def ds(spark):
    rows = spark.createDataFrame(ROWS, "msg_id long, raw binary, sym string, ip string, msg_type string, has_null string, thingy string")
    return Dataset(rows, {n: n for n in NAMES})


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "batman", 25, "I am batman"), (1, "batman", 5, "I am also batman"), (2, "batman", None, "I am also batman?"), (3, "robin", 25, "I am not batman"), (4, "superman", 2000, "I am superman")]
    return Dataset(spark.createDataFrame(rows, "msg_id long, name string, age int, string string"), {"name": "name", "age": "age"})


def ids(rel):
    return [r[rel.ds.msg_id] for r in rel]


def test_keys_and_sets(ds):
    idx = ds.idx
    a, null = idx["msg_type"]["A"], idx["has_null"].any()
    assert ids(idx["sym"]["spy"]) == [0, 2, 3]
    assert ids(a & null) == [0, 4]
    assert ids(a - null) == [1] == ids(a ^ null)
    assert ids(a | idx["msg_type"]["C"]) == [0, 1, 3, 4, 5]
    assert ids(ds[:3] & idx["sym"]["spy"]) == [0, 2]
    assert ids(ds.stream(lambda m: F.contains(m.raw, F.lit(b"\0message")))) == [0, 4]
    assert ids(ds.stream(py(lambda m: b"\0message" in m.raw)) & idx["sym"]["spy"]) == [0]
    assert ids(idx["thingy"].any()) == [3]
    assert ids(~idx["thingy"].any()) == [0, 1, 2, 4, 5]
    assert ids(idx["has_null"] & idx["sym"]) == [0, 4]
    assert [r.msg_id for r in reversed(a | null)] == [4, 1, 0]


def test_empty_sides(ds):
    none, spy = ds.idx["sym"]["nothing"], ds.idx["sym"]["spy"]
    assert ids(none) == [] and len(none) == 0 and not none
    assert ids(none | spy) == [0, 2, 3] == ids(none ^ spy) == ids(spy - none)
    assert ids(none & spy) == [] == ids(none - spy)
    assert ids(ds.idx(sym=lambda k: k.startswith("zz"))) == []


def test_missing_names(ds):
    with pytest.raises(KeyError):
        ds.idx["no_field"]
    with pytest.raises(KeyError):
        ds.idx(no_field="x")


def test_dispatch_and_dictionary(ds):
    idx = ds.idx
    assert ids(idx(sym="spy", msg_type=lambda k: k != "B")) == [0, 3]
    assert ids(ds(lambda m: m.ip == "127.0.0.1", sym=["spy", "erm"])) == [0, 2, 3]
    assert idx.keys() == sorted(NAMES) and idx[0]._name == "has_null" and len(idx[::2]) == 3
    sym = idx.sym
    assert sym.keys() == ["blah", "erm", "spy"] and len(sym) == 3 and "erm" in sym and "x" not in sym
    assert sym.key_at(0) == "blah" and sym.key_at(-1) == "spy"
    with pytest.raises(IndexError):
        sym.key_at(3)
    assert list(sym.items()) == [("blah", 2), ("erm", 1), ("spy", 3)]
    assert [tuple(r) for r in sym.top(2).collect()] == [("spy", 3), ("blah", 2)]
    assert sym.n_refs("spy") == 3 and sym.n_refs("x") == 0 and sym.total_refs() == 6
    assert (sym.low(), sym.high()) == ("blah", "spy") and [r.key for r in sym.between("b", "f").orderBy("key").collect()] == ["blah", "erm"]
    assert ids(sym["b":"f"]) == [1, 4, 5]
    assert sorted(r.key for r in sym.every(2).collect()) == ["blah", "spy"]
    assert len(sym.sample(2, seed=1)) == 2 and sym.mapping() == "1:1"


def test_json_formulations(people):
    idx, stream = people.idx, people.stream
    batman = lambda m: m.string.contains("batman")
    want = [0, 3, 4]
    forms = [
        (idx["age"][25] & stream(batman)) | idx["name"]["superman"],
        idx["age"][25](batman) | idx["name"]["superman"],
        idx(age=25)(batman) | idx(name="superman"),
        stream(lambda m: ((m.age == 25) & m.string.contains("batman")) | (m.name == "superman")),
        stream(py(lambda m: (m.age == 25 and "batman" in m.string) or m.name == "superman")),
        idx["name"]["superman"] | (stream(batman) & idx["age"](lambda a: a == 25)),
        idx["name"]["superman"] | (stream(py(lambda m: "batman" in m.string)) & idx["age"](py(lambda a: a == 25))),
    ]
    for form in forms:
        assert ids(form) == want
    assert ids(stream(batman) - idx["age"][25]) == [1, 2]
    assert ids(idx["age"](lambda a: a >= 6)) == [0, 3, 4]
    assert ids(idx["age"].eval(py(lambda a: a >= 6))) == [0, 3, 4]
    assert ids(idx["age"].missing()) == [2]


def test_slices(people):
    s = people.stream
    every = list(range(5))
    for cut in [slice(None, 2), slice(-2, None), slice(1, 1), slice(1, None, 2), slice(-4, -1), slice(None, None, 3), slice(10, 20), slice(None, -1), slice(-9, 3)]:
        assert ids(s[cut]) == every[cut], cut
        assert ids(s(lambda m: m.msg_id >= 0)(py(lambda m: True))[cut]) == every[cut], cut
    assert sorted(ids(s[::-2])) == sorted(every[::-2])
    some = people.idx["name"]["batman"]
    assert ids(s[1:][:2]) == [1, 2] and ids(some[1:]) == [1, 2] and ids(some[-1:]) == [2]
    assert s[-1].msg_id == 4 and some[0].msg_id == 0 and some[-1].msg_id == 2
    for node in (s, some, some | s):
        for bad in (5, -6):
            with pytest.raises(IndexError):
                node[bad]
    assert ids(s.head(2)) == [0, 1] and ids(s.tail(2)) == [3, 4]
    # a slice is a barrier
    old = people.idx["age"](lambda a: a > 6)
    assert ids(some[:1] & old) == [0] and ids((s[:3] & old)) == [0] and ids((s & old)[:3]) == [0, 3, 4]


def test_alternating(spark):
    rows = spark.range(1000).select(F.col("id").alias("msg_id"), F.when(F.col("id") % 2 == 0, "spy").otherwise("foo").alias("sym"))
    big = Dataset(rows, {"sym": "sym"})
    assert ids(big.idx(sym="spy")[:100]) == list(range(0, 200, 2))
    spy = big.idx["sym"]["spy"]
    assert ids(spy & spy[:100]) == list(range(0, 200, 2))
    assert [r.pos for r in spy.positions().orderBy("msg_id").collect()] == list(range(500))
    odd = [k for k in range(1, 40, 2)]
    foo = big.idx["sym"]["foo"]
    for x in range(0, 40, 7):
        assert foo.ge(x) == min(k for k in [*odd, 41] if k >= x)
        assert foo.le(x) == max([k for k in odd if k <= x], default=None)


def test_cursor(people):
    c = people.stream.cursor()
    assert c.next().msg_id == 0 and c.next().msg_id == 1
    assert c.jump(3).msg_id == 3 and c.next().msg_id == 4
    with pytest.raises(StopIteration):
        c.next()
    assert c.prev().msg_id == 3
    batman = people.idx["name"]["batman"]
    assert batman.find(4).prev().msg_id == 2
    assert [r.msg_id for r in batman.prevs(2).collect()] == [1, 0]
    assert ids(batman) == ids(batman) == [0, 1, 2]


def test_rules(people):
    s, name = people.stream, people.idx["name"]
    a, b = name["batman"], people.idx["age"][25]
    assert isinstance(simplify(a - a), Nothing) and isinstance(simplify(a ^ a), Nothing)
    assert isinstance(simplify(a | s), Stream) and isinstance(simplify(s - s), Nothing)
    assert isinstance(simplify(a & a), Key) and simplify(a | name["robin"]).keys == ("batman", "robin")
    assert isinstance(simplify(a & name["robin"]), Nothing)
    assert isinstance(simplify(a & b), SetOp)
    many = name["x0"]
    for k in range(1, 3000):
        many = many | name[f"x{k}"]
    assert len(simplify(many).keys) == 3000
    plan = (a & people.idx["age"][25]).ids()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert predicate(a[:2]) is None and predicate(s[1:4] & a) is not None


def _tree(rng, ds, world, depth):
    """A random tree and the ids that it must give."""
    if depth == 0 or rng.random() < 0.2:
        kind = rng.randrange(5)
        if kind == 0:
            return ds.stream, list(range(len(world)))
        if kind == 1:
            k = rng.choice(["a", "b", "c", "zz"])
            return ds.idx["kind"][k], [i for i, w in enumerate(world) if w[0] == k]
        if kind == 2:
            k = rng.randrange(6)
            return ds.idx["tags"][k], [i for i, w in enumerate(world) if k in (w[1] or [])]
        if kind == 3:
            k = rng.randrange(10)
            return ds.stream(lambda m: m.v > k), [i for i, w in enumerate(world) if w[2] is not None and w[2] > k]
        k = rng.randrange(3)
        return ds.idx["tags"](lambda t: t % 3 == k), [i for i, w in enumerate(world) if any(t % 3 == k for t in (w[1] or []))]
    kind = rng.randrange(6)
    a, x = _tree(rng, ds, world, depth - 1)
    if kind == 4:
        cut = slice(rng.choice([None, rng.randrange(-30, 30)]), rng.choice([None, rng.randrange(-30, 30)]), rng.choice([None, 1, 2, 5]))
        return a[cut], x[cut]
    if kind == 5:
        k = rng.randrange(10)
        return a(lambda m: m.v < k), [i for i in x if world[i][2] is not None and world[i][2] < k]
    b, y = _tree(rng, ds, world, depth - 1)
    x, y = set(x), set(y)
    return [(a & b, x & y), (a | b, x | y), (a - b, x - y), (a ^ b, x ^ y)][kind][0], sorted([x & y, x | y, x - y, x ^ y][kind])


@pytest.mark.parametrize("seed", range(12))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    world = [(rng.choice("abc"), rng.choice([None, [rng.randrange(6) for _ in range(rng.randrange(4))]]), rng.choice([None, rng.randrange(10)])) for _ in range(60)]
    frame = spark.createDataFrame([(i, *w) for i, w in enumerate(world)], "msg_id long, kind string, tags array<int>, v int").coalesce(1)
    ds = Dataset(frame, {"kind": "kind", "tags": "tags"})
    tree, want = _tree(rng, ds, world, 3)
    assert sorted(r.msg_id for r in tree.ids().collect()) == want
    assert sorted(r.msg_id for r in tree.df("kind").collect()) == want


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(1000).select(F.col("id").alias("msg_id"), (F.col("id") % 7).cast("string").alias("sym"), F.lit("x").alias("wide")).write.parquet(path)
    log = Dataset(spark.read.parquet(path), {"sym": "sym"})
    plan = (log[10:20] & log.idx["sym"]["3"]).ids()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(msg_id,10)" in plan and "LessThan(msg_id,20)" in plan and "EqualTo(sym,3)" in plan
    assert "wide" not in plan and "Exchange" not in plan
    assert "TakeOrderedAndProject" in log.idx["sym"]["3"][:5].ids()._jdf.queryExecution().executedPlan().toString()
