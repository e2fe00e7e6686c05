import hashlib
import json
import random

from pyspark.sql import functions as F

from lectern.functions import jsons as J


def nested(r, depth, twice=False):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice(["1", "-0", "true", "null", '"a"', '"q\\"k\\": {"', '"\\u006b"', "2.5", '""', '"]"', "12345678901234567890"])
    if kind < 0.55:
        return "[" + ", ".join(nested(r, depth - 1, twice) for _ in range(r.randint(0, 3))) + "]"
    keys = [r.choice(['"k"', '"\\u006b"', '"v"', '"a\\"b"', '"é"', '""', '"{"', '"n%d"' % i]) if twice else '"n%d"' % r.randrange(10**6) for i in range(r.randint(0, 4))]
    return "{" + ", ".join(f"{k}: {nested(r, depth - 1, twice)}" for k in keys) + "}"


def repeated(text):
    """The keys that come twice, objects in the order in which they are closed."""
    out = []

    def pairs(p):
        seen = set()
        for k, _ in p:
            if k in seen:
                out.append(k)
            seen.add(k)
        return dict(p)

    json.loads(text, object_pairs_hook=pairs)
    return out


def test_duplicate_keys_at_any_depth(spark):
    r = random.Random(1)
    texts = [nested(r, 5, True) for _ in range(400)] + ['{"a": {"k": 1}, "b": {"k": 2}}', '{"k": 1, "w": "a \\"k\\" b", "k": 2}', '[{"k": {"k": [{"z": 1, "z": 2}]}}]']
    got = {x.t: x.d for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.duplicate_keys(F.col("t")).alias("d")).collect()}
    assert sum(bool(v) for v in got.values()) > 50
    for t, d in got.items():
        assert sorted(d) == sorted(repeated(t)), t
    assert got['{"a": {"k": 1}, "b": {"k": 2}}'] == []
    assert spark.createDataFrame([(None,)], "t string").select(J.duplicate_keys(F.col("t"))).first()[0] is None


def plain(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_shortest_floats(spark):
    r = random.Random(2)
    tokens = ["1.50", "0.1", "1e16", "1E15", "123456789012345680.0", "1e-5", "0.0001", "0.00001234", "-2.50e-7", "0.0", "-0.0", "0e5", "1e22", "100.0", "5e-324", "1.7976931348623157e308", "0.30000000000000004", "9007199254740993.0", "2e23", "123.456e-2", "1e100", "10.010"]
    tokens += [repr(r.uniform(-1, 1) * 10.0 ** r.randint(-30, 30)) for _ in range(400)] + [f"{r.randint(1, 10**9)}e{r.randint(-20, 20)}" for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", J.shortest_float(F.col("t")).alias("s")).collect()
    assert [(x.t, x.s, repr(float(x.t))) for x in got if x.s != repr(float(x.t))] == []


def test_canonical_form(spark):
    r = random.Random(3)
    values = [{"b": 1, "a": [1.5, {"z": None, "y": True, "é": "ü\n\t\"\\/"}], "": {}}, [], {}, "x", 1, None, [1e20, -0.0, 10**30], {"k": {"k": {"k": [[[]]]}}}, {"a\"b": "  👍 \u007f", "a": "\x01\x1f"}]
    for _ in range(200):
        values.append(json.loads(nested(r, 4)))
    texts = [json.dumps(v, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5) for v in values]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: (x.c, x.d) for x in d.select("i", J.canonical(F.col("t")).alias("c"), J.digest(F.col("t")).alias("d")).collect()}
    for i, v in enumerate(values):
        assert got[i][0] == plain(json.loads(texts[i])), texts[i]
        assert got[i][1] == hashlib.sha256(plain(json.loads(texts[i])).encode()).hexdigest()
    bad = spark.createDataFrame([("{",), (None,), ('{"a": 1, "a": 2}',)], "t string").select(J.canonical(F.col("t"))).collect()
    assert [x[0] for x in bad] == [None, None, None]


def walk(value, sought, path="$"):
    out = []
    if isinstance(value, dict):
        if sought in " ".join(str(v) for v in value.values() if isinstance(v, (str, int, float, bool))):
            out.append(path)
        for k, v in value.items():
            out += walk(v, sought, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += walk(v, sought, f"{path}[{i}]")
    return out


def test_records_at_any_depth(spark):
    deep = {"a": {"b": [{"c": {"d": [{"name": "target", "n": 3}]}}, 7]}, "name": "not", "t": [[[{"x": "target"}]]]}
    texts = [json.dumps(deep), "no json", None, "[]", '{"name": "tar get"}', '{"a": "tar", "b": "get target"}', "3", '"target"', '{"q": [], "r": {}}', '{"u": {"v": "tar", "w": null, "x": "target"}}']
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.path) for r in J.records_with(d, ["i"], "t", "target").collect())
    want = sorted((i, p) for i, t in enumerate(texts) if t and t != "no json" for p in walk(json.loads(t), "target"))
    assert got == want and len(want) == 4
    record = next(r.record for r in J.records_with(d, ["i"], "t", "target").collect() if r.path.startswith("$.a"))
    assert json.loads(record) == {"name": "target", "n": 3}
    assert J.records_with(d.limit(0), ["i"], "t", "x").count() == 0
    truth = spark.createDataFrame([(0, '{"on": true, "n": 12}')], "i int, t string")
    assert J.records_with(truth, ["i"], "t", "True 12").count() + J.records_with(truth, ["i"], "t", "12 True").count() == 1


def test_canonical_form_of_what_no_double_holds(spark):
    """Whole numbers of any length, keys beyond the basic plane by code point; null where there is no one form."""
    texts = ['{"n": 123456789012345678901234567890123456789012345, "a": -0}', '{"\U0001f44d": 1, "￮": 2}', "[1e400]", "[NaN]", "[1] 2", '{"a": {"b": 1, "\\u0062": 2}}', "[" * 200_000]
    want = ['{"a":0,"n":123456789012345678901234567890123456789012345}', '{"￮":2,"\U0001f44d":1}', None, None, None, None, None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.c for r in d.select("i", J.canonical(F.col("t")).alias("c")).orderBy("i").collect()] == want


def test_records_are_found_in_one_pass(spark):
    """Own values in the order they stand in; no shuffle, nothing written on the way."""
    d = spark.createDataFrame([(1, '{"z": "a", "b": ["x", {"y": 1.5, "a": true}], "a": "b"}'), (2, '{"a": 1, "a": "a b"}')], "i int, t string")
    assert [tuple(r) for r in J.records_with(d, ["i"], "t", "a b").collect()] == [(1, "$", '{"a":"b","b":["x",{"a":true,"y":1.5}],"z":"a"}')]
    found = J.records_with(d, ["i"], "t", "1.5 True")
    assert [r.path for r in found.collect()] == ["$.b[1]"] and "Exchange" not in found._jdf.queryExecution().toString()
