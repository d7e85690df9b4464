"""Skew-safe statistics, orphan references and keys, against brute force."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions.keys import WHITE_SPACE, key_form
from codeloom.operators import orphans, skew

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
day = lambda n: T0 + dt.timedelta(days=n)


def test_key_form(spark):
    raw = [" Foo\t", "\xa0BAR　", "", "  ", None, "a b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(key_form("x")).collect()]
    assert got == ["foo", "bar", None, None, None, "a b"]
    assert all(c.isspace() for c in WHITE_SPACE)


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = skew.salted_join(left, right, ["k"], how, F.col("i"), target_rows=20)
        assert sorted(map(str, salted.select(plain.columns).collect())) == sorted(map(str, plain.collect())), how


def _stat_rows(spark, rows):
    return spark.createDataFrame(rows, "table_name string, key_value string, chunk_id string, tf bigint, key_value_2 string")


def test_key_statistics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("t", None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"k{rng.integers(20)}", None if rng.random() < 0.1 else f"c{rng.integers(30)}", None if rng.random() < 0.1 else int(rng.integers(-2, 9)), "x") for _ in range(2000)]
    want = defaultdict(lambda: [0, set(), 0])
    for _, k, c, tf, _ in rows:
        want[k][0] += 1
        want[k][1] |= {c} - {None}
        want[k][2] += tf or 0
    got = {r.key_value: (r.n_rows, r.n_chunks, r.total_tf) for r in skew.key_statistics(_stat_rows(spark, rows)).collect()}
    assert got == {k: (n, len(c), tf) for k, (n, c, tf) in want.items()}


def test_key_statistics_of_nothing(spark):
    assert skew.key_statistics(_stat_rows(spark, [])).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", None, "é"]), st.integers(-(2**60), 2**60)), max_size=20), max_size=4))
def test_dense_accumulator_is_exact(batches):
    import pyarrow as pa

    acc, want = skew.DenseAccumulator(["m"]), defaultdict(int)
    for batch in batches:
        if batch:
            acc.add(pa.array([k for k, _ in batch], pa.string()), {"m": np.array([v for _, v in batch], np.int64)})
        for k, v in batch:
            want[k] = (want[k] + v + 2**63) % 2**64 - 2**63
    keys, sums = acc.result()
    assert dict(zip(keys, sums["m"].tolist())) == dict(want)


def test_heavy_keys_count_rows_without_a_value(spark):
    p = spark.createDataFrame([("a", "c1", 1)] * 2 + [(None, "c1", 1)] * 98, "term string, chunk_id string, tf int")
    c = spark.createDataFrame([], "callee string, chunk_id string")
    stats = skew.key_statistics(skew.posting_and_call_rows(p, c))
    assert [(r.table_name, r.key_value) for r in skew.heavy_keys(stats).collect()] == [("postings", "a")]
    assert skew.heavy_keys(stats, 3).count() == 0


@pytest.fixture(scope="module")
def parents(spark):
    chunks = spark.createDataFrame(
        [("A", "Foo", day(0), day(10)), ("A", "Foo", day(10), day(20)), ("a ", "Foo", day(30), None), ("b", None, None, None), ("c", "Bar", day(5), day(4)), (None, "baz", day(0), None)],
        "id string, name string, indexed_at timestamp, removed_at timestamp",
    )
    return chunks, spark.createDataFrame([("Print", "x"), (None, "x")], "symbol string, origin string")


def _orphans(spark, parents, edges=(), routes=(), calls=()):
    e = spark.createDataFrame(list(edges), "edge_ord bigint, to_chunk_id string, seen_at timestamp, key string")
    r = spark.createDataFrame(list(routes), "route_ord bigint, handler_chunk_id string, seen_at timestamp")
    c = spark.createDataFrame(list(calls), "call_ord bigint, callee string, seen_at timestamp")
    return orphans.orphan_references(e, r, c, *parents)


def test_orphans_over_time(spark, parents):
    edges = [(1, "a", day(0), "x"), (2, "A", day(15), "x"), (3, "a", day(20), "x"), (4, " a", day(29), "x"), (5, "a", day(31), "x"), (6, "zz", day(1), "x"), (6, "zz", day(1), "x"), (7, None, day(1), "x"), (8, "  ", day(1), "x"), (9, "b", day(9), "x"), (10, "c", day(5), "x"), (11, "a", None, "x")]
    got = _orphans(spark, parents, edges)
    assert sorted(r.row_ord for r in got.collect()) == [3, 4, 6, 9, 10, 11]
    assert {(r.period, r.n_orphans) for r in orphans.orphan_counts(got).collect()} == {("2024-01", 5), (None, 1)}


def test_orphan_callees(spark, parents):
    got = _orphans(spark, parents, calls=[(1, "FOO", day(5)), (2, "print", None), (3, "baz", day(99)), (4, "nobody", day(1)), (5, "foo", day(25))], routes=[(1, "q", day(1))])
    assert sorted((r.table_name, r.row_ord) for r in got.collect()) == [("call_edges", 4), ("call_edges", 5), ("routes", 1)]


def test_orphans_without_parents(spark, parents):
    empty = (parents[0].limit(0), parents[1].limit(0))
    assert _orphans(spark, empty, edges=[(1, "a", day(0), "x")]).count() == 1
    assert _orphans(spark, parents).count() == 0


def test_live_intervals_merge(spark, parents):
    got = orphans.live_intervals(*parents).where("kind = 'id' and key = 'a'").collect()
    assert len(got) == 2  # two versions that touch, and a later one


def test_salts_follow_the_count_of_a_key(spark):
    """One key with 30 % of the rows and 1,000 with 0.07 % each: no task gets more than twice the median."""
    spread = spark.range(20_000).select(F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"), "id")
    hot = skew.hot_keys(spread.groupBy("k").count(), ["k"], target_rows=500).collect()
    assert [(r.k, r._salts) for r in hot] == [("hot", 12)] and skew.hot_keys(spread.groupBy("k").count(), ["k"], target_rows=6000) is None
    right = spread.select("k").distinct().withColumn("v", F.lit(1))
    joined = skew.salted_join(spread.repartition(8), right, ["k"], "inner", F.xxhash64("id"), target_rows=500)
    assert joined.count() == 20_000
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the partitions as they are hashed
    try:
        sizes = sorted(r["count"] for r in skew.salted_join(spread, right, ["k"], "inner", F.xxhash64("id"), target_rows=500).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_salted_join_with_counts_and_nothing(spark):
    left, right = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, i int"), spark.createDataFrame([("a", 9)], "k string, v int")
    counts = spark.createDataFrame([("a", 2)], "k string, count bigint")
    assert sorted(r.i for r in skew.salted_join(left, right, ["k"], "left_semi", F.col("i"), counts=counts, target_rows=1).collect()) == [1, 2]
    assert skew.salted_join(left.limit(0), right, ["k"], "inner", F.col("i")).count() == 0


def test_blocks_of_many_codes(spark, monkeypatch):
    """Tasks hand on their arrays whenever they hold many codes; nothing is lost or counted twice."""
    monkeypatch.setattr(skew, "MAX_CODES", 10)
    monkeypatch.setattr(skew, "BLOCK_KEYS", 50)
    rows = spark.range(3000).select(F.lit("t").alias("table_name"), F.concat(F.lit("k"), (F.col("id") % 300).cast("string")).alias("key_value"), (F.col("id") % 7).cast("string").alias("chunk_id"), F.lit(2).cast("bigint").alias("tf"))
    got = {r.key_value: (r.n_rows, r.n_chunks, r.total_tf) for r in skew.key_statistics(rows).collect()}
    assert got == {f"k{i}": (10, 7, 20) for i in range(300)}


def test_live_intervals_over_months(spark):
    chunks = spark.createDataFrame([("x", "N", day(i), day(i + 2)) for i in range(0, 100, 2)] + [("y", "n ", day(200), day(201)), ("z", "N", day(300), None), ("z", "N", day(310), day(320))], "id string, name string, indexed_at timestamp, removed_at timestamp")
    none = spark.createDataFrame([], "symbol string, origin string")
    got = sorted((r.s.date(), r.e.date()) for r in orphans.live_intervals(chunks, none).where("kind = 'name' and key = 'n'").collect())
    assert got == [(day(0).date(), day(100).date()), (day(200).date(), day(201).date()), (day(300).date(), dt.date(9999, 12, 31))]


def test_orphans_of_a_hot_callee_without_times(spark, parents, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    calls = [(i, "nobody", None) for i in range(40)] + [(100 + i, "foo", day(i)) for i in range(40)]
    got = {r.row_ord for r in _orphans(spark, parents, calls=calls).collect()}
    assert got == set(range(40)) | {100 + i for i in range(20, 30)}
