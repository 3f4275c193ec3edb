"""Secret scans: patterns propose, a random forest removes false positives. Native.

Candidates are values given to a telling name ("name = value", "the password is value"), passwords in URLs, private keys of PEM blocks, JSON
web tokens, and runs of 16 or more key letters with a digit. Given values have 6 letters or more. Each candidate gets features from its
length, its character transitions, how much of it dictionary words cover, its look and path, and the words beside it. A
random forest, trained on the driver from labelled findings (built-in ones or the caller's), is compiled into one column expression
that runs inside the scan: no Python on the data.

The dictionary is the corpus' own: its COMMON_WORDS commonest words of 4 to 20 letters, counted over all texts, beside a few fixed words that
mark names and placeholders.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache, reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_room

TREES, DEPTH = 15, 7
MASK = "[SECRET]"
#: Telling names, and letters of keys.
NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
HINTS = ("passw", "pwd", "secret", "token", "key", "credential")  # every telling name holds one
KEY = "[A-Za-z0-9_+/=-]"
ASSIGN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_.-]{0,40}?" + NAMES + r"[A-Za-z0-9_]{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
SAYS = NAMES + r"\s{1,3}is:?\s{1,3}[\"']?"
URL = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:(?=[^\s@/]{3,64}@)"
LEAD = f"{ASSIGN}|{SAYS}|{URL}"
GIVEN = r"(?<=//[^\s:/@]{1,64}:)[^\s@/]{3,64}(?=@)|[^\s\"'<>,;]{6,}"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,8192}-----END [A-Z ]{0,30}PRIVATE KEY-----"
JWT = rf"(?<!{KEY})eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}"
RUN = rf"(?<!{KEY})(?=[A-Za-z_+/=-]*\d){KEY}{{16,}}"
CANDIDATE = rf"(?s)\G(.*?)(?:({LEAD})({GIVEN})|({PEM}|{JWT}|{RUN}))"
COMMON_WORDS = 5_000
#: Words whose presence makes a candidate a name, a path or a placeholder rather than a key.
DICTIONARY = ("account", "admin", "changeme", "client", "config", "data", "default", "demo", "dummy", "example", "fake", "file", "hello", "home", "image", "index", "insert", "item", "lib", "local", "login", "name", "null", "number", "order", "package", "page", "password", "path", "placeholder", "profile", "project", "python", "release", "replace", "report", "sample", "secret", "server", "service", "session", "setting", "site", "test", "token", "undefined", "user", "usr", "value", "version", "view", "world", "your", "here", "key")
NEAR_GOOD = r"(?i)\b(secret|token|password|passwd|pwd|auth|bearer|credential|api|access|private|login|key)"
NEAR_BAD = r"(?i)\b(example|sample|test|dummy|fake|placeholder|commit|checksum|sha1|sha256|md5|digest|etag|hash|uuid|card|order|invoice|phone|tracking|id)\b"
PATH_BAD = r"(?i)(test|example|fixture|mock|sample|docs?/)"
FEATURES = ("length", "transitions", "digits", "capitals", "distinct", "hex", "numeric", "covered", "slashes", "prefixed", "assigned", "near_bad", "near_good", "vowel_turns", "test_path", "uuid", "underscores", "known", "located", "block")


def _share(text: Column, pattern: str, of: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / of


def common_words(df: DataFrame, text: str = "text", words: int = COMMON_WORDS) -> list[str]:
    """The commonest words of 4 to 20 letters over all texts, in order; so many at most."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?<![a-z0-9])([a-z]{4,20})(?![a-z0-9])"))).alias("w"))
    top = found.groupBy("w").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "w").limit(words)
    return sorted(r["w"] for r in top.collect())


def _features(x: Column, path: Column, words: list[str]) -> Column:
    value, low = x["value"], F.lower(x["value"])
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    sound = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", ""), "[aeiouy]", "\u0001"), "[a-z]", "c")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    near = F.concat(x["before"], F.lit(" "), x["after"])
    return F.array(
        n,
        (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n,
        _share(value, "[0-9]", n),
        _share(value, "[A-Z]", n),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(32.0)),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(value.rlike("^[0-9]+$")),
        _share(low, "|".join(DICTIONARY), n),
        _share(value, "[/.]", n),
        flag(value.rlike("^(AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abp]-|eyJ|AIza)")),
        flag(x["assigned"]),
        flag(near.rlike(NEAR_BAD)),
        flag(x["before"].rlike(NEAR_GOOD)),
        (F.length(F.regexp_replace(sound, r"(.)\1+", "$1")) - 1) / n,
        flag(path.rlike(PATH_BAD)),
        flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        _share(value, "[_-]", n),
        _known(value, words) / n,
        flag(x["before"].rlike("://[^\\s:/@]{1,64}:$")),
        flag(value.startswith("-----BEGIN")),
    )


def _known(value: Column, words: list[str]) -> Column:
    """Letters of the value's parts that are words."""
    parts = F.split(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", " "), "[^A-Za-z]+")
    if not words:
        return F.lit(0.0)
    return F.aggregate(F.filter(F.transform(parts, F.lower), lambda w: w.isin(words)), F.lit(0), lambda a, w: a + F.length(w)).cast("double")


def candidates(df: DataFrame, text: str, path: str | None, words: list[str]) -> DataFrame:
    """Adds `__found`: the text's candidates in order, each with the gap before it, its context and its features."""
    low = F.lower(text)
    named = reduce(or_, [F.contains(low, F.lit(x)) for x in HINTS]) & (F.col(text).rlike(f"{ASSIGN}|{SAYS}|{PEM}"))
    named = named | (F.contains(F.col(text), F.lit("://")) & F.col(text).rlike(URL))
    numbered = F.col(text).rlike("[0-9]") & F.col(text).rlike(RUN)
    df = df.withColumn("__t", F.when(numbered | named, F.col(text)))
    parts = [F.regexp_extract_all(F.col("__t"), F.lit(CANDIDATE), F.lit(k)) for k in (1, 2, 3, 4)]
    out = df.withColumn("__cut", F.arrays_zip(*[p.alias(c) for p, c in zip(parts, ("gap", "name", "given", "run"))]))
    where = F.col(path) if path else F.lit("")

    def whole(x: Column, i: Column) -> Column:
        following = F.get(F.col("__cut"), i + 1)
        return F.struct(
            F.concat(x["gap"], x["name"]).alias("gap"),
            F.concat(x["given"], x["run"]).alias("value"),
            (x["name"] != "").alias("assigned"),
            F.concat(F.right(x["gap"], F.lit(48)), x["name"]).alias("before"),
            F.coalesce(F.left(F.concat(following["gap"], following["name"]), F.lit(32)), F.lit("")).alias("after"),
        )

    out = out.withColumn("__cut", F.transform("__cut", whole))
    return out.withColumn("__found", F.transform("__cut", lambda x: F.struct(x["gap"], x["value"], _features(x, where, words).alias("f")))).drop("__cut", "__t")


# --- the forest -------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree as (feature, threshold, left, right), or the share of secrets at a leaf."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], size=max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        values = np.unique(x[:, f])
        if len(values) > 24:
            values = np.unique(np.quantile(values, np.linspace(0, 1, 24)))
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n, m = int(low.sum()), int((~low).sum())
            if n and m:
                p, q = y[low].mean(), y[~low].mean()
                gini = n * p * (1 - p) + m * q * (1 - q)
                if best is None or gini < best[0] - 1e-12:
                    best = gini, int(f), float(t), low
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list:
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        trees.append(grow(x[rows], y[rows], rng, DEPTH))
    return trees


def to_column(trees: list, f: Column) -> Column:
    """The forest's mean vote over an array of features. As SQL text, its parsing would leave tens of megabytes in the driver for good."""

    def node(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        return F.when(f[t[0]] <= t[1], node(t[2])).otherwise(node(t[3]))

    return reduce(add, map(node, trees)) / float(len(trees))


# --- labelled findings ------------------------------------------------------------------------------------------


def labelled_findings(n: int = 1_600, seed: int = 11) -> list[tuple[str, str, int]]:
    """Built-in findings (text, path, label), half of them secrets, from rules."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    alnum, lower, hexa = string.ascii_letters + string.digits, string.ascii_lowercase, "0123456789abcdef"
    word = lambda: pick(lower, rng.randrange(2, 9))
    filler = lambda: " ".join(word() for _ in range(rng.randrange(2, 8)))

    def digitful(letters: str, k: int) -> str:
        return pick(letters, k - 2) + pick(string.digits, 2)

    sound = lambda: "".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) for _ in range(rng.randrange(2, 4)))

    def chosen() -> str:
        """A password that a person might choose."""
        out = rng.choice((sound, word))() + rng.choice(("", sound()))
        out = out[:1].upper() + out[1:] if rng.random() < 0.5 else out
        for plain, digit in (("o", "0"), ("a", "4"), ("e", "3"), ("i", "1")):
            out = out.replace(plain, digit) if rng.random() < 0.4 else out
        return f"{out}{rng.choice(('', '!', '#', '-', '$'))}{rng.randrange(10, 9999)}{rng.choice(('', '', pick(alnum, 3)))}"

    def secret() -> tuple[str, str]:
        kind = rng.randrange(10)
        where = rng.choice(("src/app.py", "config/prod.yaml", "src7", ""))
        name = rng.choice(("token", "secret", "api_key", "password", "access_key", "credential"))
        if kind == 0:
            return f"{rng.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{word()}:{chosen()}@{word()}.{word()}/x", where
        if kind == 1:
            return f"{rng.choice(('my password is', 'the password is', 'password is'))} {chosen()}", where
        if kind == 2:
            return f"{rng.choice(('PASSWORD: ', 'password=', 'passwd: '))}{rng.choice((chosen, lambda: sound() + sound() + sound()))()}", where
        if kind == 3:
            part = lambda k: pick(alnum + "_-", k)
            return f"{rng.choice(('', 'token: ', 'Authorization: Bearer '))}eyJ{part(rng.randrange(17, 40))}.{part(rng.randrange(30, 90))}.{part(43)}", where
        if kind == 4 and rng.random() < 0.4:
            label = rng.choice(("RSA ", "", "EC "))
            return f"-----BEGIN {label}PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randrange(2, 6))) + f"\n-----END {label}PRIVATE KEY-----", where
        if kind == 5:
            return f"{word().upper()}_{rng.choice(('SECRET_ACCESS_KEY', 'API_TOKEN', 'SECRET'))}={digitful(alnum + '/+', 40)}", where
        case = (lambda s: s.upper()) if rng.random() < 0.15 else (lambda s: s)
        value = rng.choice([lambda: digitful(hexa, rng.choice((32, 40, 64))), lambda: digitful(alnum, rng.randrange(18, 44)), lambda: "AKIA" + digitful(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + digitful(alnum, 36), lambda: "sk-" + digitful(alnum, 32), lambda: digitful(alnum + "+/", 43) + "="])()
        lead = rng.choice((f'{name} = "', f"{name}: ", f"{name}=", f"{name}='", "Authorization: Bearer ", f"the {name} is "))
        return case(lead) + (value.upper() if case("a") == "A" and set(value) <= set(hexa) else value) + ('"' if lead.endswith('"') else ""), where

    def other() -> tuple[str, str]:
        kind = rng.randrange(12)
        if kind == 9:
            return f"{rng.choice(('the password is', 'token is', 'the key is', 'password is'))} {rng.choice(('required', 'optional', 'expired', 'missing', 'incorrect', 'invalid', 'needed here', 'stored safely', 'not shown', 'generated'))}", "docs/readme"
        if kind == 10:
            return f"{rng.choice(('https', 'postgres', 'ftp'))}://{rng.choice(('user', 'username', 'name'))}:{rng.choice(('password', 'pass', 'secret', 'changeme', 'xxxxxx', 'your_password'))}@{rng.choice(('host', 'localhost', 'example.com'))}/x", "src/app.py"
        if kind == 11:
            return f"{rng.choice(('token', 'password', 'secret', 'api_key'))}{rng.choice(('=', ': '))}{rng.choice(('getenv', 'config', 'self', 'request', 'os.environ', 'settings'))}{rng.choice(('.get', '.value', '[name]', '(name)', '.password', '.token'))}", "src/app.py"
        if kind == 0:
            return pick(string.digits, rng.choice((16, 16, 18, 20))), "src3"
        if kind == 1:
            return rng.choice(("commit ", "sha256 ", "checksum: ", "md5 ", "etag ", "digest ")) + digitful(hexa, rng.choice((32, 40, 64))), "src/notes.md"
        if kind == 2:
            h = [digitful(hexa, k) for k in (8, 4, 4, 4, 12)]
            return rng.choice(("id ", "uuid ", "")) + "-".join(h), "src/db.sql"
        if kind == 3:
            return rng.choice(("token", "password", "api_key", "secret")) + rng.choice(("=", ": ", ' = "')) + rng.choice(("your_token_here", "changeme", "changeme123", "password123", "example_secret_value", "xxxxxxxxxxxxxxxx", "placeholder_value1", "test-token-1234", "undefined", "sample_key_number_1", "replace_with_key")), "src/app.py"
        if kind == 4:
            return "/".join(rng.choice(DICTIONARY) for _ in range(rng.randrange(3, 7))) + f"/file{rng.randrange(99)}", "src/app.py"
        if kind == 5:
            return "_".join(rng.choice(DICTIONARY) for _ in range(rng.randrange(3, 6))) + f"_{rng.randrange(999)}", "src/app.py"
        if kind == 6:
            return f'{rng.choice(("token", "secret", "password"))} = "' + digitful(alnum, rng.randrange(16, 40)) + '"', rng.choice(("tests/test_app.py", "examples/demo.py", "fixtures/keys.json"))
        if kind == 7:
            return pick(rng.choice("axz0"), rng.randrange(14, 30)) + "01", "src/app.py"
        return f"{rng.choice(('token', 'password', 'secret'))}: " + "".join(rng.choice(("tion", "er", "the", "ing", "ent", "on")) for _ in range(rng.randrange(3, 6))), "src5"

    out = []
    for i in range(n):
        value, path = secret() if i % 2 else other()
        out.append((f"{filler()} {value} {filler()}.", path, i % 2))
    return out


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, words: tuple[str, ...]) -> list:
    return fit(spark.createDataFrame(labelled_findings(), "text string, path string, label int"), "text", "path", "label", [*words])


def fit(findings: DataFrame, text: str = "text", path: str | None = "path", label: str = "label", words: list[str] | None = None) -> list:
    """Train the forest from labelled findings: one row each, whose first candidate the label is about. Bounded by the labels. words is the dictionary."""
    rows = candidates(findings, text, path, words or []).where("size(__found) > 0").select(F.get("__found", F.lit(0))["f"].alias("f"), F.col(label).alias("y")).collect()
    return train(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))


def scan(df: DataFrame, text: str = "text", path: str | None = "source", trees: list | None = None, threshold: float = 0.5, words: list[str] | None = None) -> DataFrame:
    """Adds `findings` (start, value, score, is_secret; start counts characters from 0) and `redacted`, the text with secrets masked.

    words is the dictionary; without it, it is made from df, which is then read twice. Null texts have null findings and stay null; empty texts have none. Null paths count as empty. Texts are scanned whole; repeated
    rows give equal findings; other columns pass through, own columns `findings` and `redacted` as <name>_input.
    """
    df, named = make_room(df, "findings", "redacted", "__found", "__ends", "__cut", "__t")
    text, path = named(text), named(path) if path else None
    words = common_words(df, text) if words is None else words
    trees = trees or _trained(df.sparkSession, tuple(words))
    out = candidates(df, text, path, words)
    out = out.withColumn("__found", F.transform("__found", lambda x: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), to_column(trees, x["f"]).alias("score"))))
    ends = "aggregate(__found, array(0), (a, x) -> array_append(a, element_at(a, -1) + length(x.gap) + length(x.value)), a -> slice(a, 2, size(a)))"
    out = out.withColumn("__ends", F.expr(f"if(size(__found) > 0, {ends}, array())"))
    finding = f"struct(__ends[i] - length(x.value) as start, x.value as value, x.score as score, x.score >= {threshold}D as is_secret)"
    out = out.withColumn("findings", F.expr(f"if({text} is null, null, coalesce(transform(__found, (x, i) -> {finding}), array()))"))
    masked = f"array_join(transform(__found, x -> concat(x.gap, if(x.score >= {threshold}D, '{MASK}', x.value))), '')"
    return out.withColumn("redacted", F.expr(f"if(size(__found) > 0, concat({masked}, substring({text}, __ends[size(__ends) - 1] + 1)), {text})")).drop("__found", "__ends")
