"""Queries run over all lines: each against the repository's SQL without the filters that the SQL still has."""

import duckdb
import pytest

from mensura.plans.oracle import ORACLE_SQL
from mensura.plans.queries import AHEAD, CELL, QUERIES, cell_facts, report
from mensura.sources.testdata import sale_lines

D = "/root/testdata/sf0.001"
FILTERS = (
    " where not (product_id % 7 = 0 and month < date '2000-09-01') and product_id % 3 = 0 and quantity > 45",
    " and not (product_id % 5 = 0 and month > date '1999-06-01')",
    " where month = date '2000-05-01'",
)
#: The queries over all lines whose SQL still thins them.
WHOLE = (
    "classify_series births_deaths mase croston_tsb classify_by_cut quadrant_distribution label_report by_quadrant mase_by_horizon select_retrospective ranking_prospective "
    "ranking_by_quadrant report_selected report_cascade cascade_origin stability winners quadrant_winners wape_by_series improvement improvement_by_category head_to_head "
    "head_to_head_category interval_coverage pinball crossing_rate merge_runs"
).split()


def check(spark, name):
    sql = ORACLE_SQL[name]
    for x in FILTERS:
        sql = sql.replace(x, "")
    con = duckdb.connect()
    for table in ("lineitem", "orders", "part"):
        con.execute(f"create view {table} as select * from read_parquet('{D}/{table}.parquet')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = found.fetchall()
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, D).collect()]
    order = lambda r: tuple((x is None, str(x)) for x in r if not isinstance(x, float))
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert [pytest.approx(x, abs=2e-6, rel=1e-6) if isinstance(x, float) else x for x in b] == list(a)


@pytest.mark.parametrize("name", WHOLE)
def test_all_lines_count(spark, name):
    check(spark, name)


def test_cells_have_every_unit(spark):
    cells = cell_facts(spark, D).agg({"units": "sum"}).first()[0]
    assert cells == sale_lines(spark, D).agg({"quantity": "sum"}).first()[0]
    assert QUERIES["croston_tsb"](spark, D).select(*CELL).distinct().count() == cell_facts(spark, D).select(*CELL).distinct().count()


def test_every_cut_and_horizon_is_reconciled(spark):
    rows = report(spark, D).groupBy(*AHEAD).agg({"SeasonalNaive": "sum"}).collect()
    want = {(r[0], r[1]): r[2] for r in rows}
    assert len({c for c, _ in want}) == 18 and {h for _, h in want} == set(range(1, 13))
    assert {(r.cut, r.horizon) for r in QUERIES["coherence"](spark, D).collect()} == set(want)
    total = QUERIES["reconcile_bottom_up"](spark, D).where("level = 'total'").collect()
    assert {(r.cut, r.horizon): r.pred for r in total} == pytest.approx(want, abs=1e-2)


@pytest.mark.parametrize("name", ["contract_json", "contract_ingest"])
def test_all_months_are_exported(spark, name):
    check(spark, name)
