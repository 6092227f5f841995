"""States of moments, and the numbers of locations that are stored with an index, against what numpy and plain counts give."""

import random
from collections import Counter

import numpy as np
import pytest
from strandline.operators import index, moments
from strandline.operators.layers import LayeredIndex, Policy


def model(values):
    x = np.array(values, dtype=float)
    n = len(x)
    if not n:
        return {"n": 0, "total": 0, "mean": None, "stddev": None, "skewness": None, "kurtosis": None, "excess": None, "raw3": None}
    d, s = x - x.mean(), x.std(ddof=1) if n > 1 else None
    full = (d**4).mean() / x.var() ** 2 if x.var() > 0 else None
    return {"n": n, "total": x.sum(), "mean": x.mean(), "stddev": s, "skewness": (d**3).mean() / s**3 if s else None, "kurtosis": full, "excess": None if full is None else full - 3, "raw3": (x**3).mean()}


def check(row, values):
    for name, want in model(values).items():
        assert row[name] == (want if want is None else pytest.approx(want, rel=1e-8, abs=1e-8)), name


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(8)
    values = {k: [r.lognormvariate(k, 1) for _ in range(n)] for k, n in enumerate([200, 1, 2, 0, 50])} | {5: [7.0] * 9}
    rows = [(k, k % 2, v) for k, x in values.items() for v in x] + [(3, 1, None), (0, 0, None)]
    return values, moments.state(spark.createDataFrame(rows, "part long, half long, v double"), "v", ["part", "half"]).cache()


def test_states_and_merging(parts):
    values, states = parts
    for x in moments.described(states, ["part"]).collect():
        check(x, values[x.part])
    check(moments.described(moments.merged(states)).first(), [v for x in values.values() for v in x])
    for x in moments.described(moments.merged(states, ["half"]), ["half"]).collect():
        check(x, [v for k, own in values.items() if k % 2 == x.half for v in own])


@pytest.mark.parametrize("gone", [[0], [1], [4, 5], [3], [0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4]])
def test_removal(parts, gone):
    values, states = parts
    some = moments.merged(states.where(states.part.isin(gone)))
    check(moments.described(moments.removed(moments.merged(states), some)).first(), [v for k, x in values.items() if k not in gone for v in x])


def test_removal_by_key(spark, parts):
    values, states = parts
    less = moments.removed(moments.merged(states, ["half"]), moments.merged(states.where("part in (0, 2)"), ["half"]), ["half"])
    for x in moments.described(less, ["half"]).collect():
        check(x, [v for k, own in values.items() if k % 2 == x.half and k not in (0, 2) for v in own])


def test_too_much_is_refused(parts):
    _, states = parts
    with pytest.raises(Exception, match="more values are removed"):
        moments.removed(moments.merged(states.where("part = 1")), moments.merged(states)).collect()


def test_nothing(spark):
    none = spark.createDataFrame([], "v double, k long")
    check(moments.described(moments.merged(moments.state(none, "v"))).first(), [])
    assert moments.merged(moments.state(none, "v", ["k"]), ["k"]).count() == 0
    check(moments.described(moments.merged(moments.state(none, "v", ["k"]))).first(), [])


@pytest.mark.parametrize("policy", [Policy(5), Policy(4, True)])
def test_stored_numbers_of_locations(spark, tmp_path, policy):
    """After each step the stored numbers are those of the rows that count; only create() and compact() store new ones."""
    r = random.Random(9)
    part = lambda i, n: spark.createDataFrame([(min(r.randrange(60), r.randrange(60)), 10 * i + r.randrange(4), j) for j in range(n)], "feature long, tgt long, win int")

    def check_it(store):
        counts = store.rows(tombstones=False).groupBy("feature").count().collect()
        assert store.histogram() == dict(sorted(Counter(x["count"] for x in counts).items()))
        found, want = index.stored_statistics(spark, store.histogram()).first(), index.index_statistics(store.rows(tombstones=False)).first()
        assert found.n == want.n and found.total == want.total and found.largest == want.largest and found.kurtosis == pytest.approx(want.kurtosis)

    store = LayeredIndex.create(spark, f"{tmp_path}/ix", part(0, 40), policy, 3)
    assert store.counts["layers"] == [store.layers[0]["id"]]
    check_it(store)
    for i in (1, 2):
        store = store.append(part(i, 50), 2)
        assert store.counts["layers"] == [store.layers[0]["id"]]
        check_it(store)
    assert LayeredIndex.open(spark, f"{tmp_path}/ix").histogram() == store.histogram()
    whole = store.compact(everything=True)
    assert whole.counts["layers"] == [x["id"] for x in whole.layers] and whole.histogram() == store.histogram()
    check_it(whole.append(part(3, 30), 2))
    assert LayeredIndex.create(spark, f"{tmp_path}/none", part(0, 0), policy).histogram() == {}
    assert index.stored_statistics(spark, {}).first().n == 0
