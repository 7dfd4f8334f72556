"""Deep differences against a walk over parsed records."""

import json
import random

from sparkloom.operators import reconcile

KEYS = ["a", "b", 'q"', "back\\slash", "é", "", "a.b"]


def made(rng, depth=0):
    pick = rng.random()
    if depth < 4 and pick < 0.35:
        return {k: made(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(4))}
    if depth < 4 and pick < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, "", "text", "1", 1, 2, 1.5, -3, 10**15 + 1, 2.0])


def changed(rng, value):
    if rng.random() < 0.15:
        return made(rng, 3)
    if isinstance(value, dict):
        items = [(k, changed(rng, v)) for k, v in value.items() if rng.random() > 0.1]
        return dict(rng.sample(items, len(items)))
    if isinstance(value, list):
        return [changed(rng, v) for v in value] + ([made(rng, 3)] if rng.random() < 0.2 else [])
    return float(value) if isinstance(value, int) and not isinstance(value, bool) and rng.random() < 0.3 else value


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, path + '["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]')
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]")
    else:
        yield path, value


def kind(value):
    return {dict: "object", list: "array", bool: "boolean", type(None): "null", str: "string"}.get(type(value), "number")


def expected(left, right):
    a, b = (dict(leaves(x)) if x is not ... else {} for x in (left, right))
    for path in a.keys() | b.keys():
        if path not in b:
            yield path, "removed"
        elif path not in a:
            yield path, "added"
        elif kind(a[path]) != kind(b[path]):
            yield path, "type"
        elif a[path] != b[path]:
            yield path, "changed"


def test_equal_to_a_walk(spark):
    rng = random.Random(6)
    pairs = [(left := made(rng), changed(rng, left)) for _ in range(300)] + [({}, []), ([1, [2, {}]], [1, [2, []]]), (1, 1.0), (..., {"a": 1}), ({"a": 1}, ...)]
    text = lambda x: "broken{" if x is ... else json.dumps(x, ensure_ascii=rng.random() < 0.5)
    left = spark.createDataFrame([(k, text(a)) for k, (a, _) in enumerate(pairs)] + [(9000, "1"), (9002, None)], "id long, j string")
    right = spark.createDataFrame([(k, text(b)) for k, (_, b) in enumerate(pairs)] + [(9001, '"x"'), (9002, None)], "id long, j string")
    got = reconcile.deep_diff(left, right, "id", "j").collect()
    want = [(k, *x) for k, (a, b) in enumerate(pairs) for x in expected(a, b)] + [(9000, "$", "removed"), (9001, "$", "added")]
    assert sorted((r.id, r.path, r.change) for r in got) == sorted(want)
    assert len(want) > 100
    row = next(r for r in got if r.id == 9001)
    assert (row.left_value, row.right_value) == (None, "x")


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, '{"a": [1]}')], "id long, j string")
    plan = reconcile.deep_diff(df, df, "id", "j")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
