"""Change detection on typed series: steps, flat series, drifts, late values."""

import math
import os
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchtide.operators import closure_table, detect, lineage, maintenance, reconcile
from benchtide.plans import detection, fixtures
from benchtide.plans.catalog import QUERIES
from benchtide.operators.series import around, in_blocks, placed


TESTDATA = "/root/testdata/sf0.001"


def series(spark, xs, fp="{}"):
    return spark.createDataFrame([(fp, k, None if x is None else float(x), k) for k, x in enumerate(xs)], "fingerprint string, value_id long, range double, domain long")


def test_thresholds(spark):
    d = detect.fixed_threshold(series(spark, [1, 2, 3, 4, 5]), 2, 4).collect()
    assert [(r.value_id, r.bound, r.direction) for r in d] == [(0, 2.0, "below"), (4, 4.0, "above")]
    assert detect.fixed_threshold(series(spark, [2]), 2, None, least_inclusive=False).count() == 1


def test_relative_difference_of_a_step(spark):
    d = detect.relative_difference(series(spark, [100] * 6 + [70])).collect()
    assert [(r.value_id, r.previous, r.last) for r in d] == [(6, 100.0, 100.0)] and d[0].ratio == pytest.approx(-30)
    assert detect.relative_difference(series(spark, [100] * 4 + [10])).count() == 0
    assert detect.relative_difference(series(spark, [100] * 9), domain=None).count() == 0


def test_deviation(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(100, 5.8, 20)
    base = (base - base.mean()) / base.std(ddof=1) * 5.81 + 100
    assert detect.deviation(series(spark, [*base, 120]), deviations=3.0).filter("value_id = 20").count() == 1
    assert detect.deviation(series(spark, [*base, 120]), deviations=4.0).filter("value_id = 20").count() == 0
    assert detect.deviation(series(spark, [100] * 12 + [101])).count() == 1
    assert detect.deviation(series(spark, [100] * 12 + [101]), direction="LOWER").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_give_the_same_as_whole_series(spark, block):
    """Against loops over whole series: three short ones, one of a single value, and one that holds most rows."""
    rng = np.random.default_rng(3)
    all_xs = {fp: rng.lognormal(3, 0.4, n).tolist() for fp, n in (("a", 120), ("b", 9), ("c", 8), ("d", 1), ("e", 6))}
    all_xs["b"][4] = all_xs["a"][50] = None
    d = None
    for fp, xs in all_xs.items():
        s = series(spark, xs, fp)
        d = s if d is None else d.unionAll(s)
    want = set()
    for fp, xs in all_xs.items():
        for k in range(7, len(xs)):
            old, new = xs[k - 7 : k - 2], xs[k - 2 : k + 1]
            if None not in old + new and abs(np.mean(new) / np.mean(old) - 1) > 0.2:
                want.add((fp, k))
    got = detect.relative_difference(d, window=3, min_previous=5, block=block, most=8)
    assert {(r.fingerprint, r.value_id) for r in got.collect()} == want and got.count() == len(want) > 10
    assert not [c for c in got.columns if c.startswith("_")]
    want = set()
    for fp, xs in all_xs.items():
        ys = [(k, x) for k, x in enumerate(xs) if x is not None]
        for i in range(4, len(ys)):
            past = [x for _, x in ys[max(0, i - 10) : i]]
            if abs(ys[i][1] - np.mean(past)) > 1.5 * np.std(past, ddof=1):
                want.add((fp, ys[i][0]))
    got = detect.deviation(d, window=10, deviations=1.5, min_points=5, block=block, most=8)
    assert {(r.fingerprint, r.value_id) for r in got.collect()} == want and got.count() == len(want) > 5
    assert {(r.fingerprint, r.value_id): r.place for r in placed(d).collect()} == {(fp, k): k + 1 for fp, xs in all_xs.items() for k in range(len(xs))}


def test_a_long_series_is_many_groups(spark):
    d = in_blocks(series(spark, range(1000)), 9, block=100, most=500)
    assert d.filter("_own").count() == 1000
    assert {r["count"] for r in d.groupBy("_block").count().collect()} == {100, 109, 9}


@pytest.mark.parametrize(("xs", "points"), [([100 + i % 3 for i in range(10)] + [200 + i % 3 for i in range(10)], [10]), ([100 + i % 3 for i in range(20)], []), ([100 + i % 3 for i in range(10)] + [200 + i % 3 for i in range(10)] + [50 + i % 3 for i in range(10)], [10, 20])])
def test_change_points(spark, xs, points):
    d = detect.e_divisive(series(spark, xs).withColumn("domain", F.col("domain").cast("string")), window=5, most_p=0.05).orderBy("index").collect()
    assert [r["index"] for r in d] == points
    if points == [10]:
        assert d[0].hazard == pytest.approx(math.log(2), abs=0.02)


def test_series_are_searched_side_by_side(spark):
    """Series of several lengths, too short ones, one without a name and missing values, each found as if alone, through batches in whose middle series end; few calls search them all."""
    rng = np.random.default_rng(11)
    rows = []
    for f in range(60):
        n = [3, 18, 18, 25][f % 4]
        at = int(rng.integers(4, 14))
        xs = rng.normal(10, 1, n) + np.where(np.arange(n) >= at, 8.0 * (f % 3), 0.0)
        rows += [(None if f == 7 else f"s{f}", k, None if f % 5 == 0 and k == 2 else float(x), str(k)) for k, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "fingerprint string, value_id long, range double, domain string").repartition(1)
    want = set()
    for fp in {r[0] for r in rows}:
        ys = [(x, i) for f, i, x, _ in rows if f == fp and x is not None]
        if len(ys) >= 5:
            [found] = detect.change_points(np.array([[x for x, _ in ys]]), 5, 0.01, 0.0)
            want |= {(fp, k, ys[k][1]) for k, _ in found}
    for size in (1, 90, 100_000):
        got = detect.e_divisive(d, window=5, most_p=0.01, at_once=size).collect()
        assert {(r.fingerprint, r["index"], r.range_value_id) for r in got} == want and len(got) == len(want) > 30


def test_a_thousand_series_take_few_calls(monkeypatch):
    """The number of calls to the statistic is that of lengths and rounds, not of series."""
    calls, statistic = [], detect.split_statistic
    monkeypatch.setattr(detect, "split_statistic", lambda x: calls.append(1) or statistic(x))
    x = np.random.default_rng(4).normal(0, 1, (1000, 30)) + np.where(np.arange(30) >= 12, 6.0, 0.0)
    found = detect.change_points(x, 5, 0.001, 0.0)
    assert np.mean([any(abs(k - 12) < 2 for k, _ in ks) for ks in found]) > 0.95 and len(calls) < 200


def test_student_tail():
    assert detect.student_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert detect.student_tail(0, 5) == 1.0


def test_cool_down(spark):
    d = series(spark, range(10)).withColumn("place", F.col("value_id"))
    assert sorted(r.value_id for r in detect.cool_down(d, 3).collect()) == [0, 4, 8]


@pytest.mark.parametrize("points", [0, 1, 4, 30])
def test_cool_down_of_hot_series(spark, points):
    """A pass in order against doubled pointers, over dense runs, gaps and a short series beside."""
    rng = np.random.default_rng(points)
    rows = []
    for fp, n in (("hot", 400), (None, 150), ("short", 5)):
        at = np.cumsum(rng.choice([1, 1, 1, 2, 9], n)).tolist()
        rows += [(fp, k, at[k]) for k in range(n)]
    d = spark.createDataFrame(rows, "fingerprint string, value_id long, place long").repartition(3)
    want = set()
    for fp in ("hot", None, "short"):
        free = -1
        for f, _, at in rows:
            if f == fp and at >= free:
                want.add((fp, at))
                free = at + points + 1
    for most in (10_000, 20):
        got = detect.cool_down(d, points, most=most)
        assert got.columns == d.columns and {(r.fingerprint, r.place) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("preceding", [True, False])
def test_rows_around_pivots(spark, preceding):
    rng = np.random.default_rng(5)
    rows = [(fp, k, float(k), None if k == 3 else int(rng.integers(0, 40))) for fp in "ab" for k in range(60)]
    pivots = [(fp, p) for fp in "abc" for p in (-1, 0, 7, 20, 41)]
    got = around(spark.createDataFrame(rows, "fingerprint string, value_id long, range double, domain long"), spark.createDataFrame(pivots, "fingerprint string, pivot long"), 5, preceding)
    want = set()
    for fp, p in pivots:
        side = sorted(((d, i) for f, i, _, d in rows if f == fp and d is not None and (d <= p if preceding else d >= p)), reverse=preceding)
        want |= {(fp, p, i, d, k + 1) for k, (d, i) in enumerate(side[:5])}
    assert {(r.fingerprint, r.pivot, r.value_id, r.domain, r["rank"]) for r in got.collect()} == want and got.count() == len(want)


def test_changes_are_replaced_where_events_share_a_domain(spark, tmp_path):
    """Events of one type and time, of users in the scope and out of it, and an event without a type."""
    rows = [(1, "a", 2, 22.0), (2, "a", 3, 22.0), (3, "a", 4, 30.0), (4, "a", 5, 30.0), (5, None, 2, 22.0), (6, None, 3, 22.0), (7, None, 4, 30.0)]
    d = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    got = detection.w10(spark, str(tmp_path)).collect()
    assert sorted((r.value_id, r.bound) for r in got) == [(2, 20.0), (3, 25.0), (4, 20.0), (6, 20.0), (7, 25.0)]


def test_stale_changes_stay_if_nothing_is_found(spark):
    s = series(spark, [1, 2, 3])
    assert detect.without_stale(s, s.limit(0), s).count() == 3
    assert [r.value_id for r in detect.without_stale(s, s.filter("value_id = 1"), s).collect()] == [1]


def test_closure_of_diamonds_and_cascade(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "x")], "child_id string, parent_id string")
    a = spark.createDataFrame([("a",)], "id string")
    assert sorted(r.id for r in lineage.closure(e, a).collect()) == list("bcde")
    assert sorted(r.id for r in lineage.closure(e, spark.createDataFrame([("e",)], "id string"), up=True).collect()) == list("abcdx")
    assert sorted(r.id for r in lineage.cascade(e, a).collect()) == list("abcd")
    assert sorted(r.id for r in lineage.subtree(e, a).collect()) == list("abcd")


def test_closure_of_loops_and_chains(spark):
    """Long chains, loops and layered diamonds against a search from each start; a closure that looks back in every round, and one that never has to."""
    rng = np.random.default_rng(6)
    for pairs in ([(k + 1, k) for k in range(10)], [((k + 1) % 5, k) for k in range(5)] + [(9, 3), (10, 9)], [(10 * a + 10 + int(i), 10 * a + int(j)) for a in range(4) for i, j in rng.integers(0, 6, (20, 2))]):
        e = spark.createDataFrame(pairs, "child_id int, parent_id int")
        ids = sorted({x for p in pairs for x in p})
        want = set()
        for root in ids:
            todo, seen = [root], set()
            while todo:
                x = todo.pop()
                todo += [c for c, p in pairs if p == x and c not in seen]
                seen |= {c for c, p in pairs if p == x}
            want |= {(root, x) for x in seen if x != root}
        start = spark.createDataFrame([(x,) for x in ids], "id int")
        assert {(r.root, r.id) for r in lineage.closure(e, start).collect()} == want
        assert {(r.id, r.root) for r in lineage.closure(e, start, up=True).collect()} == want
        gone = {ids[0]}
        while more := {c for c, _ in pairs if c not in gone and all(p in gone for d, p in pairs if d == c)}:
            gone |= more
        assert {r.id for r in lineage.cascade(e, start.limit(0).union(start.filter(F.col("id") == ids[0]))).collect()} == gone


def counted_writes(monkeypatch):
    """Rows of each table that lineage writes from now on."""
    rows, write = [], lineage.written

    def written(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", written)
    return rows


def test_what_to_recompute_costs_ids_not_pairs(spark, monkeypatch):
    """A chain and a loop of which every node is recalculated: what is stored grows with the nodes; a node in a loop is above itself."""
    pairs = [(k + 1, k) for k in range(12)] + [(100, 101), (101, 102), (102, 100), (103, 100)]
    e = spark.createDataFrame(pairs, "child_id int, parent_id int")
    n = spark.createDataFrame([(k, True) for k in [*range(13), *range(100, 104)]], "node_id int, ephemeral boolean")
    rows = counted_writes(monkeypatch)
    got = maintenance.to_recompute(e, n.select(F.col("node_id").alias("id")), n)
    assert sorted(r.id for r in got.collect()) == [*range(12), 100, 101, 102]
    assert sum(rows) < 3 * n.count()
    one = spark.createDataFrame([(3,), (103,)], "id int")
    assert sorted(r.id for r in lineage.reached(e, one, up=True).collect()) == [0, 1, 2, 100, 101, 102]
    assert sorted(r.id for r in lineage.reached(e, one).collect()) == [*range(4, 13)]


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
def test_ancestors_cost_the_pairs_that_are_asked_for(spark, monkeypatch):
    """Of an item's ancestors only its nation is wanted; pairs with parts, suppliers and regions are not stored. What a table's writing shuffles is gone when it is written."""
    edges = fixtures.value_edges(spark, TESTDATA).count()
    rows, files = counted_writes(monkeypatch), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    got = QUERIES["j7_ancestors"](spark, TESTDATA)
    assert got.count() > 0 and got.filter("id NOT LIKE 'n%' OR root NOT LIKE 'l%'").isEmpty()
    assert sum(rows) < 2 * edges
    monkeypatch.undo()  # counting shuffles too
    there = files.getAllFiles().size()
    lineage.written(spark.range(1000).repartition(3))
    assert files.getAllFiles().size() <= there


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
def test_a_cascade_stores_tables(spark):
    """Edges as checkpoints are several times as large as tables; none is made."""
    folder = Path(urlparse(lineage.shared_folder(spark)).path)
    before = {*folder.rglob("rdd-*")}
    assert QUERIES["m1_cascade"](spark, TESTDATA).count() > 1
    assert {*folder.rglob("rdd-*")} <= before


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
def test_dependents_are_bundled(spark, monkeypatch):
    """What is stored grows with ids and rounds, not with the pairs or the paths between them."""
    edges = fixtures.node_tables(spark, TESTDATA)[1].count()
    rows = counted_writes(monkeypatch)
    assert QUERIES["j9_dependents"](spark, TESTDATA).agg(F.sum("dependents")).first()[0] > 1000
    assert sum(rows) < 6 * edges


@pytest.mark.parametrize("pairs", [[((k + 1) % 4, k) for k in range(4)] + [(9, 3), (10, 9)], [(10 * a + 10 + i, 10 * a + j) for a in range(3) for i in range(6) for j in range(6) if (i + j) % 5]])
def test_a_closure_in_bundles(spark, monkeypatch, pairs):
    """Loops and layered diamonds, with so small bundles that most ids have several, and a look back in every second round."""
    monkeypatch.setattr(lineage, "BUNDLE_ROUNDS", 2)
    e = spark.createDataFrame(pairs, "child_id int, parent_id int")
    start = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id int")
    got = lineage.bundled_closure(e, start, most=2)
    want = {(r.root, r.id) for r in lineage.closure(e, start).collect()}
    assert {(r.root, r.id) for r in got.collect()} == want and got.count() == len(want) > 10


def test_a_kept_closure_follows_its_edges(spark):
    """Random edges come and go; after each change the counts are those of a closure computed anew."""
    rng = np.random.default_rng(12)
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "child_id int, parent_id int")

    def slow(pairs):
        counts = {}
        for root in range(14):
            n = {root: 1}
            for node in range(root + 1, 14):  # parents are smaller
                n[node] = sum(n.get(p, 0) for c, p in pairs if c == node)
            counts |= {(root, x): k for x, k in n.items() if k and x != root}
        return counts

    edges = {(c, int(p)) for c in range(1, 14) for p in rng.integers(0, c, 2)}
    table = closure_table.counted(frame(edges))
    for _ in range(2):
        gone = {e for e in edges if rng.random() < 0.25}
        come = {(int(c), int(rng.integers(0, c))) for c in rng.integers(1, 14, 8)} - (edges - gone)
        before, after = table, edges - gone
        if gone:
            left = {(r.root, r.id) for r in closure_table.lost(before, closure_table.difference(before, frame(gone), removed=True)).collect()}
            assert left == set(slow(edges)) - set(slow(after))
        table = closure_table.changed(before, inserted=frame(come) if come else None, deleted=frame(gone) if gone else None)
        edges = after | come
        assert {(r.root, r.id): int(r.paths) for r in table.collect()} == slow(edges)
    ladder = {(3 * k + d, 3 * k) for k in range(5) for d in (1, 2)} | {(3 * k + 3, 3 * k + d) for k in range(5) for d in (1, 2)}
    last = closure_table.counted(frame(ladder)).agg(F.max("paths")).first()[0]
    assert int(last) == 2**5


def test_a_kept_closure_leaves_its_tables_only(spark):
    """What is stored after a change is the closure before it and the one after it; the rounds' tables are gone, and others' files stay."""
    folder = Path(urlparse(lineage.shared_folder(spark)).path)
    tables = lambda: {*folder.glob("table-*")}
    edges = lambda *pairs: spark.createDataFrame(pairs, "child_id int, parent_id int")
    there = tables()
    before = closure_table.counted(edges((1, 0), (2, 0), (3, 1), (3, 2), (4, 3)))
    assert len(tables() - there) == 1
    after = closure_table.changed(before, inserted=edges((5, 4), (4, 2)), deleted=edges((3, 1)))
    assert len(tables() - there) == 2
    assert {(r.root, r.id): int(r.paths) for r in before.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 2, (0, 4): 2, (1, 3): 1, (1, 4): 1, (2, 3): 1, (2, 4): 1, (3, 4): 1}
    assert {(r.root, r.id): int(r.paths) for r in after.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 2, (2, 3): 1, (2, 4): 2, (2, 5): 2, (3, 4): 1, (3, 5): 1, (4, 5): 1}


def test_reconcile(spark):
    left = spark.createDataFrame([(1, "a", 0, "5"), (1, "b", 0, "1.0000000001"), (1, "c", 0, "TBD"), (1, "d", 0, "9"), (1, "e", 0, "3")], "run_id int, label string, pos int, value string")
    right = spark.createDataFrame([(1, "a", '"5"'), (1, "b", "1.0"), (1, "d", "8")], "run_id int, label string, value string")
    assert {r.label: r.result for r in reconcile.compared(left, right).collect()} == {"a": "EXACT", "b": "ROUNDING", "c": "STUB", "d": "MISMATCH", "e": "MISSING"}


def test_names_resolve_without_a_broadcast(spark, tmp_path):
    """The forms of names are many times what Spark takes them for; neither side may go through the driver."""
    spark.range(30).select(F.concat(F.lit("PartNo"), "id").alias("label"), F.lit("x" * 50).alias("more")).write.parquet(str(tmp_path / "names"))
    wanted = spark.read.parquet(str(tmp_path / "names"))
    n = F.substring("label", 7, 9).cast("int")
    known = wanted.select(F.explode(F.array(F.when(n % 3 == 0, F.concat("label", F.lit("2"))), F.when(n % 2 == 0, F.concat(F.lit("part_no"), n)))).alias("label")).filter("label IS NOT NULL")
    got = reconcile.resolved(wanted.unionAll(wanted), known)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(f"PartNo{k}", f"PartNo{k}2", 3) if k % 3 == 0 else (f"PartNo{k}", f"part_no{k}", 6) for k in range(30) if k % 3 == 0 or k % 2 == 0}
    assert {(r.label, r.known, r["rank"]) for r in got.collect()} == want and got.count() == len(want)


def test_upsert(spark):
    a = spark.createDataFrame([(1, "p", "x"), (1, "q", "y"), (1, "r", "z")], "run_id int, path string, data string")
    b = spark.createDataFrame([(1, "p", "x"), (1, "q", "Y"), (1, "s", "w")], "run_id int, path string, data string")
    assert {r.path: r.action for r in reconcile.upsert(a, b).collect()} == {"p": "keep", "q": "update", "r": "delete", "s": "insert"}
