import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions import masking as fm
from tablekeeper.operators import masking as om

KEY = fm.salt_key("test-salt")


def masked(spark, strategy, values, key=KEY, constant=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = fm.STRATEGIES[strategy](F.col("v"), key, constant)
    return [r.m for r in df.select("i", out.alias("m")).orderBy("i").collect()]


def expected(strategy, value, key=KEY):
    h = hmac.new(key, value.encode(), hashlib.sha256).hexdigest()
    if strategy == "hash":
        return h[:32]
    if strategy == "email":
        return f"user{int(h[:8], 16)}@example.com"
    if strategy == "name":
        first = fm.FIRST_NAMES[int(h[:4], 16) % 16]
        return f"{first} {fm.LAST_NAMES[int(h[4:8], 16) % 16]}"
    return "+1" + str(int(h[:12], 16)).rjust(10, "0")[:10]


VALUES = ["alice@corp.com", "", "é ü 漢字 \U0001f600", "x" * 300, "0", " "] + [f"v{i}" for i in range(200)]


@pytest.mark.parametrize("strategy", ["hash", "email", "name", "phone"])
def test_matches_the_definition(spark, strategy):
    assert masked(spark, strategy, VALUES) == [expected(strategy, v) for v in VALUES]


@pytest.mark.parametrize("strategy", sorted(fm.STRATEGIES))
def test_null_passes_through(spark, strategy):
    assert masked(spark, strategy, [None], constant="c") == [None]


def test_key_changes_output(spark):
    other = fm.salt_key(b"other-salt")
    assert masked(spark, "email", ["x@y.com"]) != masked(spark, "email", ["x@y.com"], other)


def test_long_key_is_hashed_first(spark):
    key = b"k" * 100
    want = hmac.new(key, b"abc", hashlib.sha256).hexdigest()[:32]
    assert masked(spark, "hash", ["abc"], key) == [want]


def test_redact_constant_null(spark):
    assert masked(spark, "redact", ["s"]) == ["***"]
    assert masked(spark, "redact", ["s"], constant="X") == ["X"]
    assert masked(spark, "constant", ["s"], constant="anon") == ["anon"]
    assert masked(spark, "constant", ["s"]) == [None]
    assert masked(spark, "null", ["s"]) == [None]


def test_integers_mask_like_their_text(spark):
    df = spark.createDataFrame([(30,)], "age int")
    out = om.mask_table(df, "t", [om.MaskRule("t", "age", "hash")], KEY)
    assert out.first().age == expected("hash", "30")


def test_null_keeps_type(spark):
    df = spark.createDataFrame([(30, "a")], "age int, n string")
    out = om.mask_table(df, "t", [om.MaskRule("t", "age", "null")], KEY)
    assert out.dtypes == [("age", "int"), ("n", "string")]


@pytest.fixture
def users(spark):
    rows = [(1, "alice@corp.com", "Alice", 30), (2, "bob@corp.com", "Bob", 41), (3, None, None, 22)]
    return spark.createDataFrame(rows, "id int, email string, name string, age int")


RULES = [om.MaskRule("users", "email", "email"), om.MaskRule("users", "name", "redact")]


def test_table_and_counts(users):
    rows = om.mask_table(users, "users", RULES, KEY).orderBy("id").collect()
    assert [r.email for r in rows[:2]] == [expected("email", f"{n}@corp.com") for n in ("alice", "bob")]
    assert rows[0].name == "***" and rows[2].email is None and rows[2].name is None
    assert [r.age for r in rows] == [30, 41, 22]
    counts = {r.masked_column: r.n_masked for r in om.masked_counts({"users": users}, RULES, KEY).collect()}
    assert counts == {"users.email": 2, "users.name": 2}


def test_values_already_equal_are_not_counted(spark):
    df = spark.createDataFrame([("***",), ("a",)], "v string")
    rules = [om.MaskRule("t", "v", "redact")]
    assert om.masked_counts({"t": df}, rules, KEY).first().n_masked == 1


def test_same_result_for_any_partitioning(users):
    first = sorted(om.mask_table(users, "users", RULES, KEY).collect())
    second = sorted(om.mask_table(users.repartition(7), "users", RULES, KEY).collect())
    assert [tuple(r) for r in first if r.email] == [tuple(r) for r in second if r.email]


def test_random_salt_agrees_over_all_rows(spark):
    df = spark.range(200).select(F.lit("same").alias("v")).repartition(5)
    out = om.mask_table(df, "t", [om.MaskRule("t", "v", "hash")], om.masking_key())
    assert out.distinct().count() == 1
    assert om.masking_key() != om.masking_key()


def test_sanitize(spark, users, tmp_path):
    other = spark.createDataFrame([(1,)], "x int")
    out = str(tmp_path / "out")
    counts = om.with_total(om.sanitize({"users": users, "other": other}, RULES, out, "fixed-salt"))
    assert {r.masked_column: r.n_masked for r in counts.collect()}["total"] == 4
    key = fm.salt_key("fixed-salt")
    copy = spark.read.parquet(f"{out}/users").filter("id = 1").first()
    assert copy.email == expected("email", "alice@corp.com", key) and copy.name == "***"
    assert spark.read.parquet(f"{out}/other").collect() == other.collect()
    assert users.filter("id = 1").first().email == "alice@corp.com"


@pytest.mark.parametrize("rule", [
    om.MaskRule("users", "email", "rot13"),
    om.MaskRule("users; DROP TABLE users", "email", "hash"),
    om.MaskRule("users", "e mail", "hash"),
    om.MaskRule("users", "missing", "hash"),
    om.MaskRule("nobody", "email", "hash"),
    om.MaskRule("users", "email\n", "hash"),
])
def test_bad_rules_are_refused(users, rule):
    with pytest.raises(KeeperError):
        om.masked_counts({"users": users}, [rule], KEY)


def test_sanitize_needs_rules_and_destination(users):
    with pytest.raises(KeeperError):
        om.sanitize({"users": users}, [], "/tmp/x")
    with pytest.raises(KeeperError):
        om.sanitize({"users": users}, RULES, None)


def test_join_safety(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), (None,)], "k string")
    row = om.join_safety(left, "k", right, "k", "hash", KEY).first()
    assert (row.raw_join_rows, row.masked_join_rows, row.merged_values) == (4, 4, 0)
