import random

import pytest
from pyspark.sql import functions as F

from tablekeeper.functions.ordering import newest_per_group, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # one group holds most rows
    data = [
        ("hot" if rng.random() < 0.6 else f"g{rng.randrange(8)}", rng.randrange(50), i,
         rng.choice([None, rng.randrange(100)]))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "g string, t int, id int, v int")


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r.t, r.id)):
        groups.setdefault(r.g, []).append(r)
    return groups


OUT = {
    "n": ("count", None, True), "before": ("count", None, False), "s": ("sum", "v", True),
    "s0": ("sum", "v", False), "m": ("max", "v", True), "last": ("last", "v", True),
    "last0": ("last", "v", False), "first": ("first", "v", True), "first0": ("first", "v", False),
}


@pytest.mark.parametrize("rows_per_task", [10_000, 25])
def test_running(rows, rows_per_task):
    got = {r.id: r for r in running(rows, ["g"], ["t", "id"], OUT, rows_per_task).collect()}
    assert len(got) == 600
    for members in brute(rows.collect()).values():
        seen = []
        for n, r in enumerate(members):
            earlier = [x for x in seen if x is not None]
            now = earlier + ([r.v] if r.v is not None else [])
            row = got[r.id]
            assert (row.n, row.before) == (n + 1, n)
            assert (row.s, row.s0) == (sum(now), sum(earlier))
            assert row.m == (max(now) if now else None)
            assert row["last"] == (now[-1] if now else None)
            assert row.last0 == (earlier[-1] if earlier else None)
            assert row["first"] == (now[0] if now else None)
            assert row.first0 == (earlier[0] if earlier else None)
            seen.append(r.v)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_newest_per_group(rows, k):
    order = [F.desc("t"), F.desc("id")]
    got = newest_per_group(rows, ["g"], order, k, ["id"]).collect()
    want = set()
    for g, members in brute(rows.collect()).items():
        want |= {(g, r.id, i + 1) for i, r in enumerate(members[::-1][:k])}
    assert {(r.g, r.id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_newest_per_group_with_own_limit(rows):
    limited = rows.withColumn("l", F.when(F.col("g") == "hot", 7).otherwise(2))
    got = newest_per_group(limited, ["g"], [F.desc("t"), F.desc("id")], 7, ["id"], "l")
    sizes = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert sizes.pop("hot") == 7 and set(sizes.values()) == {2}
