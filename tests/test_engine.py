"""Hand-computed cases of the engine's operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import classify, compare, deflate, facts, hierarchy, metrics, panel, runs, selection
from mensura.sources import repository


def month(text):
    return dt.date.fromisoformat(f"{text}-01")


def series(spark, values, start=(2025, 1), pid=1):
    y, m = start
    return [(pid, dt.date(y + (m - 1 + k) // 12, (m - 1 + k) % 12 + 1, 1), float(v)) for k, v in enumerate(values) if v is not None]


def frame(spark, rows):
    return spark.createDataFrame(rows, "product_id long, month date, units double")


def test_netting_subtracts_credit_notes(spark):
    # Product 7 returns a third of what it sold, product 9 more than it sold, product 4 all of it in the month after.
    rows = [(7, month("2031-05"), 9.0, 63.0, False), (7, month("2031-05"), 3.0, 24.0, True), (9, month("2031-05"), 2.0, 5.0, False), (9, month("2031-05"), 6.0, 15.0, True), (4, month("2031-05"), 1.0, 12.0, False), (4, month("2031-06"), 1.0, 12.0, True)]
    got = facts.with_price(facts.netted(spark.createDataFrame(rows, "product_id long, month date, quantity double, amount double, credit_note boolean"), "product_id"))
    want = {(7, 5, 6.0, 39.0, 6.5), (9, 5, -4.0, -10.0, 2.5), (4, 5, 1.0, 12.0, 12.0), (4, 6, -1.0, -12.0, 12.0)}
    assert {(r.product_id, r.month.month, r.units, r.revenue, r.avg_price) for r in got.collect()} == want
    level = spark.createDataFrame([(5, month("2031-05"), q, q, c) for q, c in ((3.0, False), (3.0, True))], "product_id long, month date, quantity double, amount double, credit_note boolean")
    assert facts.with_price(facts.netted(level, "product_id")).first().avg_price is None


def test_gifts_go_by_strict_threshold(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.06,), (1.0,), (None,)], "price double")
    assert sorted(r.price for r in facts.without_gifts(df).collect()) == [0.06, 1.0]


@pytest.mark.parametrize(("values", "late"), [([40, 44] * 10 + [3], 1), ([40, 44] * 10 + [9, 5, 1], 3), ([40, 44] * 5 + [2, 2] + [40, 44] * 5, 0), ([40, 44] * 10 + [39], 0)])
def test_incomplete_months_are_a_tail(spark, values, late):
    assert facts.incomplete_months(frame(spark, series(spark, values, (2030, 4)))).count() == late


def test_dense_panel_starts_at_first_row_and_has_no_gap(spark):
    got = panel.dense(frame(spark, series(spark, [5, None, None, -2])), ["product_id"], "2025-06-01").orderBy("month").collect()
    assert [r.units for r in got] == [5, 0, 0, -2, 0, 0]


def test_cuts_leave_the_last_month_out(spark):
    df = frame(spark, series(spark, range(30), (2024, 1)))
    got = sorted(r.cut for r in panel.cuts(df, "2026-06-01").collect())
    assert (got[0], got[-1], len(got)) == (month("2024-12"), month("2026-05"), 18)
    with pytest.raises(ValueError, match="fewer"):
        panel.cuts(df, "2024-05-01")


def test_backtest_predicts_and_ends_at_the_edge(spark):
    df = frame(spark, series(spark, range(10, 20)))
    rows = panel.backtest(panel.dense(df, ["product_id"], None), panel.cuts(df, None, 6), ["product_id"], 3)
    got = {(r.cut, r.horizon): (r.real, r.LastValue) for r in rows.collect()}
    assert got[month("2025-04"), 1] == (14, 13) and got[month("2025-04"), 3] == (16, 13)
    assert [h for c, h in got if c == month("2025-09")] == [1]


def test_seasonal_naive_repeats_the_year(spark):
    df = frame(spark, series(spark, [*range(1, 13)] * 3, (2023, 1)))
    rows = panel.backtest(panel.dense(df, ["product_id"], None), panel.cuts(df, None, 18), ["product_id"]).where(F.col("cut") >= F.lit(dt.date(2024, 12, 1)))
    assert rows.where("real <> SeasonalNaive or SeasonalNaive is null").count() == 0


@pytest.mark.parametrize(("values", "want", "adi"), [([10] * 4, "suave", 1), ([1, 50, 1, 50], "erratica", 1), ([10, 0, 0, 0, 10, 0, 0, 0], "intermitente", 4), ([1, 0, 0, 0, 90, 0, 0, 0], "lumpy", 4), ([0, 0, 0], "sin_actividad", None)])
def test_quadrants(spark, values, want, adi):
    until = series(spark, values)[-1][1].isoformat()
    got = classify.classify(frame(spark, series(spark, values)), ["product_id"], until).first()
    assert (got.quadrant, got.adi) == (want, adi)


def test_classification_window_and_first_sale(spark):
    one = lambda rows, until, window: classify.classify(frame(spark, rows), ["product_id"], until, window).first().adi
    assert one([(1, month(m), 1.0) for m in ("2025-01", "2025-05", "2025-09")], "2025-09-01", 9) == 3
    assert one([(1, month(m), 1.0) for m in ("2026-04", "2026-05", "2026-06")], "2026-06-01", 36) == 1
    assert one([(1, month(m), 1.0) for m in ("2024-01", "2024-02", "2024-03")], "2024-12-01", 12) == 4
    assert one([(1, month(m), 1.0) for m in ("2020-01", "2026-04", "2026-05", "2026-06")], "2026-06-01", 12) == 4


def test_class_at_the_threshold_does_not_hang_on_order(spark):
    # Both have CV2 = 49/100 exactly; rolled through their nine months in 36, each order is one series.
    rows = []
    for k, ys in enumerate(([30, 9, 5, 1, 4, 33, 28, 32, 38], [43, 44, 4, 47, 18, 11, 53, 16, 4])):
        assert 100 * (9 * sum(y * y for y in ys) - sum(ys) ** 2) == 49 * sum(ys) ** 2
        for r in range(9):
            rows += [(10 * k + r, dt.date(2020 + i // 3, 1 + 4 * (i % 3), 1), float(y)) for i, y in enumerate(ys[r:] + ys[:r])]
    got = classify.classify(frame(spark, rows), ["product_id"], "2022-12-01").collect()
    assert len(got) == 18 and {r.quadrant for r in got} == {"intermitente"} and {round(r.cv2, 12) for r in got} == {0.49}


def test_wape_bias_and_missing_predictions(spark):
    rows = spark.createDataFrame([("A", 10.0, 12.0), ("A", 20.0, 18.0), ("B", 5.0, 5.0), ("B", 0.0, 0.0), ("C", 0.0, 1.0), ("C", 0.0, 0.0), ("D", 10.0, None)], "g string, real double, pred double")
    got = {r.g: r for r in metrics.scores(rows, ["g"]).collect()}
    assert got["A"].wape == round(4 / 30, 6) and got["A"].bias == 0 and got["B"].wape == 0 and got["C"].wape is None
    assert (got["D"].wape, got["D"].coverage, got["D"].n) == (0.0, 0.0, 1)
    with pytest.raises(Exception, match="null g"):
        metrics.scores(rows.withColumn("g", F.lit(None).cast("string")), ["g"]).collect()


def test_level_errors_cancel(spark):
    rows = spark.createDataFrame([(1, "x", 100.0, 150.0), (2, "x", 100.0, 50.0)], "product_id long, category string, real double, m double").selectExpr("*", "date'2025-01-01' as month", "date'2024-12-01' as cut", "1 as horizon")
    got = {r.level: r.wape for r in metrics.by_level(rows, ["m"], {"product": ["product_id"], "category": ["category"], "total": []}, ["product_id", "category"]).collect()}
    assert got == {"product": 0.5, "category": 0.0, "total": 0.0}


def test_interval_metrics(spark):
    rows = spark.createDataFrame([(5.0, 0.0, 10.0)] * 8 + [(50.0, 0.0, 10.0), (-50.0, 0.0, 10.0)], "real double, lo double, hi double").withColumn("h", F.lit(1))
    got = metrics.interval_coverage(rows, "lo", "hi", ["h"]).first()
    assert (got.coverage, got.n) == (0.8, 10)
    q = spark.createDataFrame([(10.0, 8.0), (20.0, 25.0), (30.0, 30.0)], "real double, P50 double").withColumn("h", F.lit(1))
    assert metrics.pinball(q, {"P50": 0.5}, ["h"]).first().pinball == pytest.approx(7 / 60 / 2, abs=1e-6)


def test_croston_and_tsb(spark):
    zero = panel.intermittent_states(panel.dense(frame(spark, series(spark, [0] * 6)), ["product_id"], None), ["product_id"]).collect()
    assert {(r.croston, r.tsb) for r in zero} == {(0.0, 0.0)}
    z = p = None
    gap, ys = 0, [10, 0, 0, 7, 0, 12, 0, 0]
    for y in ys:
        gap += 1
        if y > 0:
            z, p, gap = (y, gap, 0) if z is None else (0.1 * y + 0.9 * z, 0.1 * gap + 0.9 * p, 0)
    got = panel.intermittent_states(panel.dense(frame(spark, series(spark, ys)), ["product_id"], None), ["product_id"]).orderBy(F.desc("month")).first()
    assert got.croston == pytest.approx(0.95 * z / p)


def test_relatives_and_index(spark):
    rows = [(1, month("2024-01"), 10.0, 1000.0, 100.0), (1, month("2024-02"), 15.4, 2000.0, 130.0), (2, month("2024-01"), 1.0, 1.0, 100.0), (2, month("2024-02"), 1.0, 1.0, -250.0), (2, month("2024-03"), 1.0, 1.0, 110.0)]
    got = deflate.relatives(spark.createDataFrame(rows, "product_id long, month date, units double, revenue double, avg_price double")).collect()
    assert [(r.product_id, r.month, r.relative, r.weight) for r in got] == [(1, month("2024-02"), 1.3, 1500.0)]
    rel = [(k, month("2024-02"), r, w) for k, (r, w) in enumerate([(2.25, 1.0), (1.0, 1.0), (1.5, 1.0)])] + [(k, month("2024-03"), 1.2, -1.0) for k in range(3)] + [(0, month("2024-04"), 9.0, 1.0)]
    cat = spark.createDataFrame([(k, "c", "l") for k in range(3)], "product_id long, category string, lab string")
    index = deflate.level_index(spark.createDataFrame(rel, "product_id long, month date, relative double, weight double"), cat, "category").orderBy("month").collect()
    assert [(r.month, round(r["index"], 9)) for r in index] == [(month("2024-02"), 1.0), (month("2024-03"), 1.2)]


def test_price_times_own_deflator_is_the_anchor(spark):
    rows = [(p, dt.date(2024, m, 1), 1.0, 10.0 * p * 1.05**m, 10.0 * p * 1.05**m) for p in range(1, 6) for m in range(1, 13)]
    f = spark.createDataFrame(rows, "product_id long, month date, units double, revenue double, avg_price double")
    cat = spark.createDataFrame([(p, "c", "l") for p in range(1, 6)], "product_id long, category string, lab string")
    cpi = spark.createDataFrame([(dt.date(2024, m, 1), 100.0 * 1.05**m) for m in range(1, 13)], "month date, index double")
    index = deflate.indices(f, cat, cpi)
    d = deflate.deflators(f, cat, index, "2024-12-01").join(f, ["product_id", "month"]).join(deflate.anchors(f, cat, index, "2024-12-01"), "product_id")
    assert d.where("abs(avg_price * deflator / anchor - 1) > 1e-9").count() == 0 and d.count() == 60


def test_deflators_don_t_leak(spark):
    rows = [(p, dt.date(2023 + (m - 1) // 12, (m - 1) % 12 + 1, 1), 1.0 + m % 3, 10.0 * p * (1 + m % 5), 5.0 * p + m) for p in range(1, 5) for m in range(1, 19)]
    f = spark.createDataFrame(rows, "product_id long, month date, units double, revenue double, avg_price double")
    cat = spark.createDataFrame([(p, "c", "l") for p in range(1, 5)], "product_id long, category string, lab string")
    cpi = spark.createDataFrame([(dt.date(2023 + (m - 1) // 12, (m - 1) % 12 + 1, 1), 100.0 + m) for m in range(1, 19)], "month date, index double")

    def fit(df, cut):
        seen = df.where(F.col("month") <= F.lit(cut).cast("date"))
        return deflate.deflators(df, cat, deflate.indices(seen, cat, cpi), cut)

    assert runs.leaks(fit, f, ["2023-12-01"]) == []
    assert runs.leaks(lambda df, cut: df.agg(F.sum("units").alias("x")), f, ["2023-12-01"]) != []


def test_cascade_takes_the_best_model_that_predicted(spark):
    report = spark.createDataFrame([(1, month("2025-01"), 1, 10.0, 11.0, 5.0), (1, month("2025-01"), 2, 10.0, None, 50.0), (1, month("2025-01"), 3, 10.0, None, None)], "k long, cut date, horizon int, real double, a double, b double")
    ranking = spark.createDataFrame([(1, month("2025-01"), "a", 0), (1, month("2025-01"), "b", 1)], "k long, cut date, model string, rank int")
    rows = selection.cascade(report, ranking, ["a", "b"], ["k"]).orderBy("horizon")
    assert [(r.pred, r.used_model, r.used_rank) for r in rows.collect()] == [(11.0, "a", 0), (50.0, "b", 1), (None, None, None)]
    assert {(r.origin, r.rows) for r in selection.provenance(rows).collect()} == {("winner", 1), ("cascade", 1), ("nobody", 1)}


def test_improvement_needs_equal_coverage(spark):
    # By hand at horizon 2: k 0.3 - 0.1 gains, l 0.5 - 0.75 loses, m lacks the challenger; n has no row there, only at horizon 5.
    rows = [("k", 2, 20.0, 26.0, 22.0), ("l", 2, 8.0, 4.0, 2.0), ("m", 2, 6.0, 6.0, None), ("n", 5, 4.0, 5.0, 4.0)]
    report = spark.createDataFrame(rows, "k string, horizon int, real double, old double, new double")
    got = {r.horizon: r for r in compare.improvement(report, "old", "new", ["k"], ["horizon"]).collect()}
    assert (got[2].series, got[2].not_comparable, got[2].wins, got[2].percent_wins) == (4, 2, 1, 50.0)
    assert (got[2]["median"], got[2].p25, got[2].p75) == pytest.approx((-0.025, -0.1375, 0.0875))
    assert (got[5].series, got[5].not_comparable, got[5].wins, got[5]["median"]) == (4, 3, 1, 0.25)


def test_reconciled_forecasts_are_coherent(spark):
    # Five leaves, two categories crossed with two labs, one cell of two leaves, one cell empty.
    where = {11: ("north", "x"), 12: ("north", "x"), 13: ("north", "y"), 14: ("south", "y"), 15: ("south", "y")}
    cat = spark.createDataFrame([(p, c, lab) for p, (c, lab) in where.items()], "product_id long, category string, lab string")
    members = hierarchy.membership(cat)
    assert {r.base for r in members.where("series = 'total/y'").collect()} == {13, 14, 15}
    rng = np.random.default_rng(2)
    names = sorted({(r.level, r.series) for r in members.collect()})
    under = {n: {r.base for r in members.where(F.col("series") == n[1]).where(F.col("level") == n[0]).collect()} for n in names}
    values = {n: float(rng.uniform(5, 50)) for n in names}
    nodes = spark.createDataFrame([(*n, 1, v) for n, v in values.items()], "level string, series string, cut int, pred double")
    assert hierarchy.incoherent(nodes, members, "pred", ["cut"]).count() > 0
    leaves = sorted(where)
    summing = np.array([[float(p in under[n]) for p in leaves] for n in names])
    every = np.array([values[n] for n in names])
    for method in hierarchy.METHODS:
        out = hierarchy.reconciled(nodes, members, "pred", ["cut"], method)
        assert hierarchy.incoherent(out, members, "pred", ["cut"]).count() == 0
        if method == "bottom_up":
            want = summing @ np.array([next(v for n, v in values.items() if n[0] == "product" and under[n] == {p}) for p in leaves])
        else:
            # The dense normal equations with the whole summing matrix.
            w = np.ones(len(names)) if method == "ols" else summing.sum(1)
            want = summing @ np.linalg.solve(summing.T @ (summing / w[:, None]), summing.T @ (every / w))
        got = {(r.level, r.series): r.pred for r in out.collect()}
        assert [got[n] for n in names] == pytest.approx(list(want))
    wide = hierarchy.side_by_side(nodes, members, "pred", ["cut"], ["bottom_up", "ols"])
    assert wide.columns == ["level", "series", "cut", "pred", "pred_bottom_up", "pred_ols"] and wide.count() == len(names)


def test_incoherence_of_odd_cells(spark):
    """Missing values and nodes, unknown ones, repeated leaves and aggregates, cells of one kind of node alone, leaves seen once."""
    cat = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "product_id long, category string, lab string")
    members = hierarchy.membership(cat)
    p1, p2, p3 = "total/a/x/1", "total/a/y/2", "total/b/x/3"
    rows = [(1, p1, 2.0), (1, p2, 3.0), (1, p3, 4.0), (1, "total", 9.0), (1, "total/a", 5.0), (1, "total/b", 4.1), (1, "total/x", 6.0), (1, "total/y", 3.0), (1, "total/a/x", 2.0), (1, "total/a/y", 3.0)]
    # A missing leaf and aggregate, an unknown node and one without a name, a repeated leaf and a repeated aggregate.
    rows += [(2, p1, None), (2, p2, 3.0), (2, p2, 3.0), (2, "total", 6.0), (2, "total", 7.0), (2, "total/a", None), (2, "total/z", 1.0), (2, None, 1.0)]
    # Leaves alone, aggregates alone, and a leaf of 0 twice, which is its own sum.
    rows += [(3, p3, 1.0), (4, "total", 1.0), (5, p1, 0.0), (5, p1, 0.0), (5, "total", 0.0), (None, p2, 1.0), (None, "total/y", 1.0)]
    nodes = spark.createDataFrame(rows, "cut int, series string, pred double")
    found = hierarchy.incoherent(nodes, members, "pred", ["cut"])
    assert found.columns == ["series", "cut", "pred", "expected"]
    above = lambda *names: [n for n in ("total", *names)]
    want = [(1, "total/b/x", None, 4.0), (1, "total/b", 4.1, 4.0)]
    want += [(2, p1, None, None), (2, p2, 3.0, 6.0), (2, p2, 3.0, 6.0), (2, "total", 7.0, 6.0), (2, "total/a", None, 6.0), (2, "total/y", None, 6.0), (2, "total/a/y", None, 6.0), (2, "total/x", None, None), (2, "total/a/x", None, None)]
    want += [(2, "total/z", 1.0, None), (2, None, 1.0, None)]
    want += [(3, n, None, 1.0) for n in above("total/b", "total/x", "total/b/x")] + [(4, "total", 1.0, None)]
    want += [(5, n, None, 0.0) for n in ("total/a", "total/x", "total/a/x")]
    # Rows without a cut are a cell like any other.
    want += [(None, n, None, 1.0) for n in above("total/a", "total/a/y")]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    got = [(r.cut, r.series, r.pred, r.expected) for r in found.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_catalog_is_never_broadcast(spark):
    # A packed catalog looks small to the optimizer, and its broadcast fills the driver.
    cat = spark.range(300).selectExpr("id product_id", "concat('c', id % 3) category", "concat('l', id % 5) lab")
    members = hierarchy.membership(cat)
    rows = spark.range(300).selectExpr("id product_id", "1 cut", "1.0D pred")
    sums = hierarchy.level_sums(rows, members, "pred", "cut").where("level != 'product'")
    assert sums.count() == 24 and sums.where("series = 'total' and pred = 300").count() == 1
    nodes = hierarchy.level_sums(rows, members, "pred", "cut")
    wide = hierarchy.side_by_side(nodes, members, "pred", ["cut"], list(hierarchy.METHODS))
    for df in (sums, wide):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [product_id" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("base" in x or "leaf" in x)]


def test_hierarchy_guards(spark):
    cat = lambda *rows: spark.createDataFrame(rows, "product_id long, category string, lab string")
    with pytest.raises(Exception, match="are both u_v"):
        hierarchy.membership(cat((1, "u/v", "x"), (2, "u_v", "x"))).collect()
    assert hierarchy.membership(cat((1, "u/v", "x"), (2, "u/v", "z"))).count() == 10
    with pytest.raises(Exception, match="no or two groups"):
        hierarchy.membership(cat((1, "u", "x"), (1, "u", "z"))).collect()
    members = hierarchy.membership(cat((1, "u", "x")))
    rows = spark.createDataFrame([(1, 1, 2.0), (8, 1, 3.0)], "product_id long, cut int, pred double")
    with pytest.raises(Exception, match="not in the catalog: 8"):
        hierarchy.level_sums(rows, members, "pred", "cut").where("level != 'product'").collect()
    with pytest.raises(ValueError, match="unknown method"):
        hierarchy.reconciled(rows, members, "pred", ["cut"], "wls")
    report = spark.createDataFrame([("k", 1, 5.0)], "k string, horizon int, a double")
    with pytest.raises(Exception, match="unknown winner b"):
        selection.selected(report, spark.createDataFrame([("k", "b")], "k string, model string"), ["a"], ["k"], "a").collect()


def test_small_operators(spark):
    index = spark.createDataFrame([("c", "u", month("2030-01"), 2.0), ("c", "u", month("2030-02"), 3.0), ("c", "v", month("2030-01"), 0.0), ("c", "v", month("2030-02"), 1.0), ("c", "w", month("2030-01"), 1.0)], "level string, level_id string, month date, index double")
    assert {r.level_id: r.factor for r in deflate.factor_between(index, "2030-01-01", "2030-02-01").collect()} == {"u": 1.5, "v": None, "w": None}
    dated = spark.createDataFrame([(1, month("2030-01")), (2, month("2030-03"))], "k long, computed_on date")
    assert [r.k for r in panel.trimmed(dated, "2030-02-01").collect()] == [1] and panel.trimmed(dated.drop("computed_on"), "2030-02-01").count() == 2
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (5, 4.0)], "k long, v double")
    assert sorted(r.k for r in facts.differences(a, b, ["k"], ["v"]).collect()) == [2, 4, 5]
    assert [(r.k, r.v) for r in metrics.worst(a.withColumn("g", F.lit(0)), ["g"], "v", ["k"]).collect()] == [(4, 4.0)]
    f = frame(spark, series(spark, [5, 0, 0], pid=2) + series(spark, [1, 1, 1], pid=6))
    assert [r.product_id for r in facts.first_products(f, 1).collect()] == [2]
    assert tuple(facts.without_recent_sale(f, "2025-03-01", 2).first()) == (2, 1, 50.0)


def test_stream_closes_months_and_drops_what_comes_too_late(spark, tmp_path):
    from mensura.streaming.netting import netted_stream

    at = lambda day: dt.datetime.fromisoformat(f"2030-{day}T08:00")
    batches = [
        [(at("01-03"), 1, 5.0, 50.0, False), (at("01-28"), 1, 2.0, 20.0, True), (at("02-10"), 1, 4.0, 40.0, False)],
        [(at("01-30"), 1, 1.0, 10.0, False), (at("05-02"), 1, 9.0, 90.0, False)],
        [(at("01-31"), 1, 100.0, 1.0, False), (at("05-03"), 1, 1.0, 10.0, False)],
        [(at("09-01"), 1, 1.0, 10.0, False)],
    ]
    schema = "ts timestamp, product_id long, quantity double, amount double, credit_note boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = netted_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
    got = {(r.product_id, r.month.month): (r.units, r.revenue) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of 30 January is late but in time, that of 31 January comes when its month is closed.
    assert got[1, 1] == (4.0, 40.0) and got[1, 2] == (4.0, 40.0) and got[1, 5] == (10.0, 100.0)


def test_runs_and_repository(spark, tmp_path):
    f = frame(spark, series(spark, [1, 2, 3]))
    one = runs.run_id(facts.fingerprint(f), {"h": 12})
    assert len(one) == 12 and one != runs.run_id(facts.fingerprint(f), {"h": 6})
    r = spark.createDataFrame([(1, 1.0, 2.0)], "k long, real double, a double")
    assert runs.merged(r, r.withColumnRenamed("a", "b"), ["k"]).columns == ["k", "real", "a", "b"]
    with pytest.raises(ValueError, match="match"):
        runs.merged(r, r.withColumnRenamed("a", "b").withColumn("real", F.lit(5.0)), ["k"])
    (tmp_path / "i.csv").write_text("month,index\n2025-01-01,100\n2025-02-01,101\n")
    assert repository.read_price_index(spark, f"{tmp_path}/i.csv", "2025-01-15").count() == 1
    with pytest.raises(repository.IndexExpired):
        repository.read_price_index(spark, f"{tmp_path}/i.csv", "2025-03-01")
    saved = repository.Checkpoints(spark, f"file://{tmp_path}/run", one)
    saved.save("2025-01", r)
    assert repository.Checkpoints(spark, f"file://{tmp_path}/run", one).load(["2025-01"]).count() == 1
    with pytest.raises(ValueError, match="are of run"):
        repository.Checkpoints(spark, f"file://{tmp_path}/run", "other")
    assert "| 1 | 1.0000 | 2.0000 |" in runs.to_markdown({"t": r}, "Title")


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert "flagship_backtest_wape" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
