"""The engine's queries over the star-schema tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import classify, compare, deflate, facts, features, forecast, hierarchy, metrics, panel, runs, selection
from mensura.sources import repository
from mensura.sources.testdata import catalog, price_index, sale_lines

UNTIL, CUT, YEAR_END = "2001-10-01", "2001-09-01", "2000-12-31"
MODELS = ["SeasonalNaive", "WindowAverage", "LastValue"]
#: Candidates of the full selection, in the order that breaks ties.
CANDIDATES = ["SeasonalNaive", "WindowAverage", "AutoETS", "AutoTheta", "AutoARIMA", "CrostonSBA", "TSB"]
CELL = ["category", "lab"]
AHEAD = ["cut", "horizon"]
QUADRANTS = ["suave", "erratica", "intermitente", "lumpy", "sin_actividad"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits by order; pushed off exact halves first, and -0 made plain."""
    return df.select(*[(F.round(F.col(c) * (1 + 1e-10), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def net(spark, d):
    return facts.product_facts(sale_lines(spark, d))


def client_net(spark, d):
    return facts.netted(sale_lines(spark, d), "client_id", "product_id")


def dense(spark, d):
    return panel.dense(net(spark, d).select("product_id", "month", "units"), ["product_id"], UNTIL)


def cell_facts(spark, d):
    """Series of category and lab, all lines positive: the grain where every quadrant occurs."""
    lines = sale_lines(spark, d).join(catalog(spark, d), "product_id")
    return lines.groupBy(*CELL, "month").agg(F.sum("quantity").alias("units"))


def report(spark, d, keys=("product_id",), rows=None):
    rows = net(spark, d).select("product_id", "month", "units") if rows is None else rows
    p = panel.dense(rows, list(keys), UNTIL)
    return panel.backtest(p, panel.cuts(rows, UNTIL), list(keys))


def cell_report(spark, d):
    return report(spark, d, CELL, cell_facts(spark, d))


def labelled(spark, d):
    return report(spark, d).join(catalog(spark, d), "product_id", "left")


def index(spark, d, until=CUT):
    visible = net(spark, d).where(F.col("month") <= F.lit(until).cast("date"))
    return deflate.indices(visible, catalog(spark, d), price_index(spark).where(F.col("month") <= F.lit(until).cast("date")))


@query
def flagship_backtest_wape(spark, d):
    levels = {"product": ["product_id"], "category": ["category"], "total": []}
    return metrics.by_level(labelled(spark, d), ["SeasonalNaive"], levels, ["product_id", "category"])


@query
def facts_net(spark, d):
    return rounded(net(spark, d), 4)


@query
def gift_filter(spark, d):
    return rounded(facts.product_facts(facts.without_gifts(sale_lines(spark, d))).groupBy("month").agg(F.sum("units").alias("units"), F.count("*").alias("rows")))


@query
def client_product_rollup(spark, d):
    return rounded(facts.rollup(client_net(spark, d)), 4)


@query
def month_scan(spark, d):
    lines = sale_lines(spark, d).where("month = date'2000-05-01'")
    return rounded(lines.groupBy("product_id", "credit_note").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount")), 4)


@query
def catalog_scan(spark, d):
    return catalog(spark, d)


@query
def active_universe(spark, d):
    return facts.active_products(net(spark, d), UNTIL, 1).groupBy("product_id").agg(F.count("*").alias("months"))


@query
def incomplete_months(spark, d):
    return rounded(facts.incomplete_months(net(spark, d)))


@query
def extract_checks(spark, d):
    return facts.extract_checks(net(spark, d), catalog(spark, d))


@query
def fingerprint(spark, d):
    return facts.fingerprint(net(spark, d))


@query
def births_deaths(spark, d):
    return facts.births_and_deaths(net(spark, d), UNTIL)


@query
def purchase_histogram(spark, d):
    return facts.purchase_histogram(client_net(spark, d))


@query
def client_feature(spark, d):
    return rounded(facts.client_features(client_net(spark, d), sale_lines(spark, d), catalog(spark, d), YEAR_END), 4)


@query
def dense_panel(spark, d):
    return rounded(dense(spark, d), 4)


@query
def cuts(spark, d):
    return panel.cuts(net(spark, d), UNTIL)


@query
def backtest_naive(spark, d):
    return rounded(report(spark, d, CELL, cell_facts(spark, d)))


@query
def croston_tsb(spark, d):
    return rounded(panel.intermittent_states(panel.dense(cell_facts(spark, d), CELL, UNTIL), CELL))


@query
def classify_series(spark, d):
    return rounded(classify.classify(cell_facts(spark, d), CELL, UNTIL))


@query
def classify_products(spark, d):
    return rounded(classify.classify(net(spark, d), ["product_id"], UNTIL))


@query
def classify_by_cut(spark, d):
    rows = cell_facts(spark, d)
    return rounded(classify.classify_by_cut(rows, CELL, panel.cuts(rows, UNTIL)))


@query
def quadrant_distribution(spark, d):
    return classify.distribution(classify.classify(cell_facts(spark, d), CELL, UNTIL))


@query
def stratified_sample(spark, d):
    return classify.stratified_sample(classify.classify(net(spark, d), ["product_id"], UNTIL), "product_id", 20).select("product_id", "quadrant")


@query
def label_report(spark, d):
    rows = classify.label(cell_report(spark, d), classify.classify(cell_facts(spark, d), CELL, UNTIL), CELL)
    return rounded(rows.groupBy("quadrant", "horizon").agg(F.count("*").alias("n"), F.sum("real").alias("real")))


@query
def wape_levels(spark, d):
    levels = {"product": ["product_id"], "category": ["category"], "lab": ["lab"], "total": []}
    return metrics.by_level(labelled(spark, d), MODELS, levels, ["product_id", "category", "lab"])


@query
def by_category(spark, d):
    rows = metrics.long(labelled(spark, d).where(F.col("horizon").isin(*metrics.HORIZONS)), MODELS, ["category", "horizon", "real"])
    return metrics.scores(rows, ["category", "model", "horizon"])


@query
def by_quadrant(spark, d):
    rows = classify.label(cell_report(spark, d), classify.classify(cell_facts(spark, d), CELL, UNTIL), CELL)
    return metrics.scores(metrics.long(rows.where(F.col("horizon").isin(*metrics.HORIZONS)), MODELS, ["quadrant", "horizon", "real"]), ["quadrant", "model", "horizon"])


@query
def mase(spark, d):
    return rounded(metrics.mase(cell_report(spark, d), MODELS, CELL))


@query
def mase_by_horizon(spark, d):
    return metrics.mase_by_horizon(cell_report(spark, d), MODELS, CELL)


@query
def relatives(spark, d):
    return rounded(deflate.relatives(net(spark, d)), 4)


@query
def clamped_relatives(spark, d):
    rows = deflate.relatives(net(spark, d)).withColumn("clamped", deflate.clamped(F.col("relative")))
    return rounded(rows.groupBy("month").agg(F.count("*").alias("pairs"), F.count_if(F.col("clamped") != F.col("relative")).alias("hit"), F.avg("clamped").alias("mean")))


@query
def level_index(spark, d):
    return rounded(index(spark, d), 4)


@query
def own_anchor(spark, d):
    return rounded(deflate.own_anchor(net(spark, d), CUT), 4)


@query
def last_usable_price(spark, d):
    return rounded(deflate.last_price(net(spark, d), CUT), 4)


@query
def derived_anchor(spark, d):
    return rounded(deflate.anchors(net(spark, d), catalog(spark, d), index(spark, d), CUT), 4)


@query
def anchor_origin(spark, d):
    return deflate.anchors(net(spark, d), catalog(spark, d), index(spark, d), CUT).groupBy("origin").agg(F.count("*").alias("n"))


@query
def cascade_factor(spark, d):
    rows = deflate.with_factor(net(spark, d).where("month <= date'2001-09-01'").select("product_id", "month"), index(spark, d), catalog(spark, d), "month", F.lit(CUT).cast("date"))
    return rounded(rows, 4)


@query
def deflator(spark, d):
    return rounded(deflate.deflators(net(spark, d), catalog(spark, d), index(spark, d), CUT), 4)


@query
def deflated_revenue(spark, d):
    rows = deflate.deflated(net(spark, d), deflate.deflators(net(spark, d), catalog(spark, d), index(spark, d), CUT))
    return rounded(rows.groupBy("month").agg(F.count("*").alias("n"), F.count("revenue_real").alias("with_deflator"), F.sum("revenue_real").alias("revenue_real")), 1)


@query
def client_deflated_revenue(spark, d):
    rows = deflate.deflated(client_net(spark, d), deflate.deflators(net(spark, d), catalog(spark, d), index(spark, d), CUT))
    return rounded(rows.groupBy("client_id").agg(F.count("revenue_real").alias("n"), F.sum("revenue_real").alias("revenue_real")), 1)


@query
def relative_price(spark, d):
    return rounded(features.relative_price(net(spark, d), catalog(spark, d), index(spark, d), CUT).drop("var_price_rel_3m", "var_price_rel_12m"), 4)


@query
def feature_table(spark, d):
    return rounded(features.build(net(spark, d), catalog(spark, d), index(spark, d), CUT), 3)


@query
def lag_features(spark, d):
    return rounded(features.lags(dense(spark, d), ["product_id"]))


@query
def rolling_features(spark, d):
    return rounded(features.rolling(dense(spark, d), ["product_id"]), 4)


@query
def feature_coverage(spark, d):
    return features.coverage(features.build(net(spark, d), catalog(spark, d), index(spark, d), CUT))


@query
def series_length(spark, d):
    return features.series_length(dense(spark, d), ["product_id"])


@query
def select_retrospective(spark, d):
    return selection.best_overall(cell_report(spark, d), MODELS, CELL, "SeasonalNaive")


@query
def ranking_prospective(spark, d):
    return selection.ranked(cell_report(spark, d), MODELS, CELL, "SeasonalNaive")


def _quadrants(spark, d):
    rows = cell_facts(spark, d)
    return classify.classify_by_cut(rows, CELL, panel.cuts(rows, UNTIL)).select(*CELL, "cut", "quadrant")


def _by_quadrant(spark, d):
    return selection.ranked(cell_report(spark, d), MODELS, CELL, "SeasonalNaive", _quadrants(spark, d))


@query
def ranking_by_quadrant(spark, d):
    return _by_quadrant(spark, d)


@query
def report_selected(spark, d):
    r = cell_report(spark, d)
    return rounded(selection.selected(r, selection.best_overall(r, MODELS, CELL, "SeasonalNaive"), MODELS, CELL, "SeasonalNaive").select(*CELL, "cut", "horizon", "winner", "pred"))


def _cascaded(spark, d):
    r = cell_report(spark, d)
    return selection.cascade(r, selection.ranked(r, MODELS, CELL, "SeasonalNaive"), MODELS, CELL)


@query
def report_cascade(spark, d):
    return rounded(_cascaded(spark, d).select(*CELL, "cut", "horizon", "pred", "used_model", F.col("used_rank").cast("int").alias("used_rank")))


@query
def cascade_origin(spark, d):
    return selection.provenance(_cascaded(spark, d))


@query
def stability(spark, d):
    return selection.stability(selection.ranked(cell_report(spark, d), MODELS, CELL, "SeasonalNaive"), CELL)


@query
def winners(spark, d):
    classes = classify.classify(cell_facts(spark, d), CELL, UNTIL)
    return selection.winners(selection.ranked(cell_report(spark, d), MODELS, CELL, "SeasonalNaive"), classes, CELL, QUADRANTS)


@query
def quadrant_winners(spark, d):
    return selection.quadrant_winners(_by_quadrant(spark, d), _quadrants(spark, d), CELL)


@query
def wape_by_series(spark, d):
    return compare.wape_by_series(cell_report(spark, d), MODELS, CELL)


@query
def improvement(spark, d):
    return compare.improvement(cell_report(spark, d), "SeasonalNaive", "WindowAverage", CELL, ["horizon"])


@query
def improvement_by_category(spark, d):
    return compare.improvement(cell_report(spark, d), "SeasonalNaive", "WindowAverage", CELL, ["category", "horizon"])


@query
def head_to_head(spark, d):
    return compare.head_to_head(cell_report(spark, d), MODELS, {"series": CELL, "category": ["category"], "total": []}, CELL)


@query
def head_to_head_category(spark, d):
    return compare.head_to_head_by(cell_report(spark, d), MODELS, "category")


def _intervals(spark, d):
    return metrics.empirical_intervals(cell_report(spark, d), "WindowAverage", ["category", "horizon"])


@query
def interval_coverage(spark, d):
    return metrics.interval_coverage(_intervals(spark, d), "P10", "P90", ["horizon"])


@query
def pinball(spark, d):
    return metrics.pinball(_intervals(spark, d), {"P10": 0.1, "P50": 0.5, "P90": 0.9}, ["horizon"])


@query
def crossing_rate(spark, d):
    return metrics.crossing_rate(_intervals(spark, d), ["P10", "P50", "P90"], ["horizon"])


@query
def hier_levels(spark, d):
    return rounded(hierarchy.level_sums(dense(spark, d), hierarchy.membership(catalog(spark, d)), "units", "month").where("level != 'product'"), 4)


def _hierarchy(spark, d):
    """Seasonal-naive forecasts of every node, cut and horizon, aggregates moved off their leaves by a tenth."""
    members = hierarchy.membership(catalog(spark, d))
    rows = report(spark, d).select("product_id", *AHEAD, F.col("SeasonalNaive").alias("pred"))
    nodes = hierarchy.level_sums(rows, members, "pred", *AHEAD)
    return members, nodes.withColumn("pred", F.when(F.col("level") == "product", F.col("pred")).otherwise(1.1 * F.col("pred")))


@query
def coherence(spark, d):
    members, nodes = _hierarchy(spark, d)
    return hierarchy.incoherent(nodes, members, "pred", AHEAD).groupBy(*AHEAD).agg(F.count("*").alias("cells"))


@query
def reconcile_bottom_up(spark, d):
    members, nodes = _hierarchy(spark, d)
    return rounded(hierarchy.reconciled(nodes, members, "pred", AHEAD, "bottom_up"), 3)


@query
def reconcile_ols(spark, d):
    members, nodes = _hierarchy(spark, d)
    return rounded(hierarchy.reconciled(nodes, members, "pred", AHEAD, "ols"), 3)


@query
def reconcile_wls(spark, d):
    members, nodes = _hierarchy(spark, d)
    return rounded(hierarchy.reconciled(nodes, members, "pred", AHEAD, "wls_struct"), 3)


@query
def merge_runs(spark, d):
    r = cell_report(spark, d)
    keys = [*CELL, "cut", "horizon", "month"]
    both = runs.merged(r.select(*keys, "real", "SeasonalNaive"), r.select(*keys, "real", "WindowAverage"), keys)
    return rounded(both)


@query
def contract_json(spark, d):
    docs = repository.sales_documents(sale_lines(spark, d))
    return rounded(docs.select("order_id", "client_id", "month", "total", "n_lines"), 2)


@query
def contract_ingest(spark, d):
    good, bad = repository.accepted_sales(repository.sales_documents(sale_lines(spark, d)))
    return rounded(good.agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity")).crossJoin(bad.agg(F.count("*").alias("rejected"))))


def _all_models(spark, d):
    """Category-and-lab report with every model: simple, intermittent and fitted ones."""
    rows = cell_facts(spark, d)
    months = panel.dense(rows, CELL, UNTIL)
    cut_rows = panel.cuts(rows, UNTIL)
    simple = panel.backtest(panel.intermittent_states(months, CELL), cut_rows, CELL)
    return forecast.combined(simple, months, cut_rows, CELL)


@query
def backtest_all(spark, d):
    return rounded(_all_models(spark, d))


@query
def ranking_all(spark, d):
    return selection.ranked(_all_models(spark, d), CANDIDATES, CELL, "SeasonalNaive")


@query
def report_cascade_all(spark, d):
    # Persisted: the ranking and the cascade read one report, whose models are fitted once.
    r = _all_models(spark, d).persist()
    rows = selection.cascade(r, selection.ranked(r, CANDIDATES, CELL, "SeasonalNaive"), CANDIDATES, CELL)
    return rounded(rows.select(*CELL, *AHEAD, "pred", "used_model", F.col("used_rank").cast("int").alias("used_rank")))


@query
def wape_all(spark, d):
    return metrics.by_level(_all_models(spark, d).persist(), CANDIDATES, {"series": CELL, "category": ["category"], "total": []}, CELL)


@query
def index_factor(spark, d):
    return rounded(deflate.factor_between(index(spark, d), "2000-01-01", CUT), 4)


@query
def first_products(spark, d):
    return facts.first_products(net(spark, d), 25)


@query
def category_shares(spark, d):
    return facts.category_shares(net(spark, d), catalog(spark, d))


@query
def without_recent_sale(spark, d):
    return facts.without_recent_sale(net(spark, d), UNTIL, 12)


@query
def facts_cross_check(spark, d):
    """Product facts against the client facts summed up: no rows where both nettings agree."""
    return facts.differences(net(spark, d), facts.rollup(client_net(spark, d)), ["product_id", "month"], ["units", "revenue"], 1e-3)


@query
def reconciled_side_by_side(spark, d):
    members, nodes = _hierarchy(spark, d)
    return rounded(hierarchy.side_by_side(nodes, members, "pred", AHEAD, list(hierarchy.METHODS)), 3)
