"""The queries' definitions in SQL for DuckDB, written from what is computed and not from our plans."""

from __future__ import annotations

PARTS = {
    "lines": """select cast(o_custkey as bigint) client_id, cast(l_partkey as bigint) product_id, cast(l_orderkey as bigint) order_id, cast(l_shipdate as date) date,
        cast(date_trunc('month', l_shipdate) as date) as month, cast(l_quantity as double) quantity, l_extendedprice * (1 - l_discount) amount,
        l_extendedprice * (1 - l_discount) / l_quantity price, l_returnflag = 'R' credit_note from lineitem join orders on l_orderkey = o_orderkey""",
    "cat": "select cast(p_partkey as bigint) product_id, coalesce(p_type, 'SIN CATEGORIA') category, p_brand lab from part",
    "cpi": "select cast(date '1995-01-01' + to_months(cast(i as integer)) as date) as month, 100 * pow(1.02, i) as index from range(83) t(i)",
    "facts": "select *, revenue / nullif(units, 0) avg_price from (select product_id, month, sum(case when credit_note then -quantity else quantity end) units, sum(case when credit_note then -amount else amount end) revenue from lines group by all)",
    "cfacts": "select client_id, product_id, month, sum(case when credit_note then -quantity else quantity end) units, sum(case when credit_note then -amount else amount end) revenue from lines group by all",
    "months": "select cast(m as date) as month from generate_series(timestamp '1990-01-01', timestamp '2001-10-01', interval 1 month) t(m)",
    "dense": "select product_id, m.month, coalesce(units, 0.0) units from (select product_id, min(month) lo from facts where month <= date '2001-10-01' group by 1) s join months m on m.month >= lo left join facts f using (product_id, month)",
    "cuts": "select month cut from months where month < date '2001-10-01' order by 1 desc limit 18",
    "cell_all": "select category, lab, month, sum(quantity) units from lines join cat using (product_id) group by all",
    "cell": "select category, lab, month, sum(quantity) units from lines join cat using (product_id) where not (product_id % 7 = 0 and month < date '2000-09-01') and product_id % 3 = 0 and quantity > 45 group by all",
    "usable": "select * from facts where avg_price > 0 and avg_price < 'infinity'::double",
    "rel": "select a.product_id, a.month, a.avg_price / b.avg_price relative, (a.revenue + b.revenue) / 2 weight from usable a join usable b on a.product_id = b.product_id and b.month = a.month - interval 1 month",
    "idx": """select level, level_id, month, exp(sum(g) over w - first_value(g) over w) as index from (select level, level_id, month, case when min(weight) <= 0 then avg(x) else sum(weight * x) / sum(weight) end g from
        (select 'category' as level, category level_id, month, weight, ln(least(greatest(relative, 1/3.0::double), 3.0)) x from rel join cat using (product_id) where month <= date '2001-09-01'
        union all select 'lab', lab, month, weight, ln(least(greatest(relative, 1/3.0::double), 3.0)) from rel join cat using (product_id) where month <= date '2001-09-01') group by all having count(*) >= 3) window w as (partition by level, level_id order by month)
        union all select 'ipc', 'nacional', month, index from cpi where month <= date '2001-09-01'""",
    "seen": "select * from facts where month <= date '2001-09-01'",
    "own": "select product_id, coalesce(sum(avg_price * units) filter (units > 0) / sum(units) filter (units > 0), avg(avg_price)) anchor from usable where month between date '2001-07-01' and date '2001-09-01' group by 1",
    "lastp": "select product_id, max_by(avg_price, month) price, max(month) price_month from usable where month <= date '2001-09-01' group by 1",
    "anch": """select p.product_id, coalesce(o.anchor, l.price * coalesce(b1.index / a1.index, b2.index / a2.index, b3.index / a3.index)) anchor, case when o.anchor is not null then 'producto' when l.price is null then 'sin_ancla'
        when b1.index / a1.index is not null then 'category' when b2.index / a2.index is not null then 'lab' when b3.index / a3.index is not null then 'ipc' else 'sin_ancla' end origin
        from (select distinct product_id from seen) p left join own o using (product_id) left join lastp l using (product_id) left join cat c using (product_id)
        left join idx a1 on a1.level = 'category' and a1.level_id = c.category and a1.month = l.price_month left join idx b1 on b1.level = 'category' and b1.level_id = c.category and b1.month = date '2001-09-01'
        left join idx a2 on a2.level = 'lab' and a2.level_id = c.lab and a2.month = l.price_month left join idx b2 on b2.level = 'lab' and b2.level_id = c.lab and b2.month = date '2001-09-01'
        left join idx a3 on a3.level = 'ipc' and a3.month = l.price_month left join idx b3 on b3.level = 'ipc' and b3.month = date '2001-09-01'""",
    "near": """select s.product_id, s.month, coalesce(b.price, f.price) price, coalesce(b.price_month, f.price_month) price_month from seen s
        left join lateral (select avg_price price, u.month price_month from usable u where u.product_id = s.product_id and u.month <= s.month order by u.month desc limit 1) b on true
        left join (select product_id, min_by(avg_price, month) price, min(month) price_month from usable where month <= date '2001-09-01' group by 1) f on f.product_id = s.product_id""",
    "defl": """select product_id, month, case when lf > 0 then least(greatest(raw / lf, 0.1), 10.0) * lf else raw end deflator from (select n.product_id, n.month,
        an.anchor / (n.price * case when n.price_month = n.month then 1.0 else coalesce(b1.index / a1.index, b2.index / a2.index, b3.index / a3.index) end) raw, coalesce(e1.index / b1.index, e2.index / b2.index) lf
        from near n join cat c using (product_id) join anch an using (product_id)
        left join idx a1 on a1.level = 'category' and a1.level_id = c.category and a1.month = n.price_month left join idx b1 on b1.level = 'category' and b1.level_id = c.category and b1.month = n.month left join idx e1 on e1.level = 'category' and e1.level_id = c.category and e1.month = date '2001-09-01'
        left join idx a2 on a2.level = 'lab' and a2.level_id = c.lab and a2.month = n.price_month left join idx b2 on b2.level = 'lab' and b2.level_id = c.lab and b2.month = n.month left join idx e2 on e2.level = 'lab' and e2.level_id = c.lab and e2.month = date '2001-09-01'
        left join idx a3 on a3.level = 'ipc' and a3.month = n.price_month left join idx b3 on b3.level = 'ipc' and b3.month = n.month where n.price is not null)""",
    "relp": """select s.product_id, s.month, an.anchor price_anchor, case when s.avg_price > 0 and an.anchor > 0 then s.avg_price * coalesce(e1.index / b1.index, e2.index / b2.index) / an.anchor end price_rel_level
        from seen s join cat c using (product_id) left join anch an using (product_id)
        left join idx b1 on b1.level = 'category' and b1.level_id = c.category and b1.month = s.month left join idx e1 on e1.level = 'category' and e1.level_id = c.category and e1.month = date '2001-09-01'
        left join idx b2 on b2.level = 'lab' and b2.level_id = c.lab and b2.month = s.month left join idx e2 on e2.level = 'lab' and e2.level_id = c.lab and e2.month = date '2001-09-01'""",
    "feat": """select r.product_id, r.month, r.price_anchor, r.price_rel_level, r.price_rel_level / a.price_rel_level - 1 var_price_rel_3m, r.price_rel_level / b.price_rel_level - 1 var_price_rel_12m, category, lab from relp r join cat using (product_id)
        left join relp a on a.product_id = r.product_id and a.month = r.month - interval 3 month left join relp b on b.product_id = r.product_id and b.month = r.month - interval 12 month""",
    "cls_at": """select k.*, case when n = 0 then 'sin_actividad' when adi < 1.32 and cv2 < 0.49 then 'suave' when adi < 1.32 then 'erratica' when cv2 < 0.49 then 'intermitente' else 'lumpy' end quadrant from
        (select category, lab, cut, count(y) n, (datediff('month', greatest(cut - interval 35 month, coalesce(min(month) filter (units > 0), cut - interval 35 month)), cut) + 1) / nullif(count(y), 0) adi, pow(stddev_pop(y) / avg(y), 2) cv2
        from (select c.*, cut, case when units > 0 and month >= cut - interval 35 month then units end y from cell c join allcuts on month <= cut) group by category, lab, cut having count(*) filter (month >= cut - interval 35 month) > 0) k""",
    "allcuts": "select cut from cuts union all select date '2001-10-01'",
    "cls": "select * exclude (cut, n) from cls_at where cut = date '2001-10-01'",
}
#: Panels and reports of three kinds of series: (name, source, keys).
for _name, _source, _keys in (("p", "facts", "product_id"), ("c", "cell", "category, lab"), ("a", "cell_all", "category, lab")):
    _on = " and ".join(f"x.{k} = d.{k}" for k in _keys.split(", "))
    PARTS[f"{_name}_dense"] = f"select {_keys}, m.month, coalesce(units, 0.0) units from (select {_keys}, min(month) lo from {_source} where month <= date '2001-10-01' group by all) s join months m on m.month >= lo left join {_source} f using ({_keys}, month)"
    PARTS[f"{_name}_scale"] = f"select {_keys.replace(', ', ', ')}, cut, avg(e) scale from (select d.{_keys.replace(', ', ', d.')}, d.month, abs(d.units - x.units) e from {_name}_dense d left join {_name}_dense x on {_on} and x.month = d.month - interval 12 month) join cuts on month <= cut group by all"
    PARTS[f"{_name}_report"] = f"""select d.{_keys.replace(', ', ', d.')}, cuts.cut, cast(h as integer) horizon, d.month, d.units as "real", x.units as "SeasonalNaive", w.v as "WindowAverage", l.units as "LastValue", scale from cuts cross join range(1, 13) t(h) join {_name}_dense d on d.month = cuts.cut + to_months(cast(h as integer))
        join {_name}_dense l on {_on.replace('x.', 'l.')} and l.month = cuts.cut left join {_name}_dense x on {_on} and x.month = d.month - interval 12 month
        left join (select {_keys}, cut, avg(units) v from {_name}_dense join cuts on month between cut - interval 2 month and cut group by all having count(*) = 3) w on {_on.replace('x.', 'w.')} and w.cut = cuts.cut
        left join {_name}_scale sc on {_on.replace('x.', 'sc.')} and sc.cut = cuts.cut"""
    PARTS[f"{_name}_long"] = f'select {_keys}, cut, horizon, month, "real", scale, m.model, case m.model when \'SeasonalNaive\' then "SeasonalNaive" when \'WindowAverage\' then "WindowAverage" else "LastValue" end pred, pos from {_name}_report cross join (values (\'SeasonalNaive\', 1), (\'WindowAverage\', 2), (\'LastValue\', 3)) m(model, pos)'
PARTS["c_mase"] = 'select category, lab, cut, model, pos, round(avg(abs("real" - pred)) / nullif(max(scale), 0), 9) mase from c_long group by all'
PARTS["c_best"] = "select category, lab, case when m is null then 'SeasonalNaive' else model end model from (select category, lab, model, pos, round(avg(mase) * 1.0000000001::double, 9) m from c_mase group by all) qualify row_number() over (partition by category, lab order by m nulls last, pos) = 1"
PARTS["c_seen"] = 'select category, lab, cuts.cut, s.cut source, model, pos, round(avg(abs("real" - pred)) / nullif(max(scale), 0), 9) mase from c_long s join cuts on s.cut < cuts.cut and s.month <= cuts.cut group by all'
PARTS["c_options"] = "select distinct category, lab, cut, model, pos from c_long"
PARTS["c_rank"] = """select category, lab, cut, model, cast(row_number() over (partition by category, lab, cut order by case when n = 0 then lead else 0 end, m nulls last, pos) - 1 as integer) rank from
    (select o.*, m, count(m) over (partition by category, lab, cut) n, case when model = 'SeasonalNaive' then 0 else 1 end lead from c_options o left join (select category, lab, cut, model, round(avg(mase) * 1.0000000001::double, 9) m from c_seen group by all) using (category, lab, cut, model))"""
PARTS["quad"] = "select category, lab, cut, quadrant from cls_at where cut < date '2001-10-01'"
PARTS["q_rank"] = """select category, lab, cut, model, cast(row_number() over (partition by category, lab, cut order by case when n = 0 then lead else 0 end, m nulls last, pos) - 1 as integer) rank from
    (select o.*, m, count(m) over (partition by category, lab, cut) n, case when model = 'SeasonalNaive' then 0 else 1 end lead from (select o.*, coalesce(quadrant, 'sin_actividad') quadrant from c_options o left join quad using (category, lab, cut)) o
    left join (select coalesce(quadrant, 'sin_actividad') quadrant, cut, model, round(avg(mase) * 1.0000000001::double, 9) m from c_seen left join quad using (category, lab, cut) group by all) using (quadrant, cut, model))"""
PARTS["c_casc"] = "select category, lab, cut, horizon, min_by(pred, rank) pred, min_by(model, rank) used_model, min(rank) used_rank from (select l.category, l.lab, l.cut, l.horizon, l.pred, case when l.pred is not null then l.model end model, case when l.pred is not null then rank end rank from c_long l join c_rank using (category, lab, cut, model)) group by all"
PARTS["c_series"] = 'select model, category, lab, horizon, round(coalesce(sum(abs("real" - pred)), 0) / nullif(sum(abs("real")), 0), 6) wape, round(coalesce(sum(pred - "real"), 0) / nullif(sum(abs("real")), 0), 6) bias, count(*) n, round(avg(cast(pred is not null as integer)), 6) coverage from c_long group by all'
PARTS["c_int"] = """select r.*, "WindowAverage" + q10 "P10", "WindowAverage" + q50 "P50", "WindowAverage" + q90 "P90" from c_report r left join (select e.category, e.horizon, cuts.cut, quantile_cont(e, 0.1) q10, quantile_cont(e, 0.5) q50, quantile_cont(e, 0.9) q90
    from (select category, horizon, month, "real" - "WindowAverage" e from c_report where "WindowAverage" is not null) e join cuts on e.month <= cuts.cut group by all) using (category, horizon, cut)"""
PARTS["members"] = """select 'total' as level, 'total' series, product_id from cat union all select 'category', 'total/' || replace(category, '/', '_'), product_id from cat union all select 'lab', 'total/' || replace(lab, '/', '_'), product_id from cat
    union all select 'category/lab', 'total/' || replace(category, '/', '_') || '/' || replace(lab, '/', '_'), product_id from cat union all select 'product', 'total/' || replace(category, '/', '_') || '/' || replace(lab, '/', '_') || '/' || product_id, product_id from cat"""
PARTS["nodes"] = "select level, series, cut, sum(\"SeasonalNaive\") * case when level = 'product' then 1 else 1.1 end pred from p_report join members using (product_id) where horizon = 1 and cut >= date '2001-07-01' group by level, series, cut"


def _sql(body: str) -> str:
    """The body with the parts that it uses, directly or not, before it."""
    import re

    used: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in used and re.search(rf"\b(?:from|join|cross join)\s+\(?{name}\b|,\s*{name}\b(?=\s+\w+\s+where)|\({name}\)", text):
                used.append(name)
                visit(PARTS[name])

    visit(body)
    # A part comes after all that it uses.
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in used:
            if other != name and re.search(rf"\b(?:from|join)\s+{other}\b", PARTS[name]):
                place(other)
        ordered.append(name)

    for name in used:
        place(name)
    return "with " + ", ".join(f"{n} as materialized ({PARTS[n]})" for n in ordered) + " " + body if ordered else body


WAPE = 'round(coalesce(sum(abs("real" - pred)), 0) / nullif(sum(abs("real")), 0), 6) wape, round(coalesce(sum(pred - "real"), 0) / nullif(sum(abs("real")), 0), 6) bias, count(*) n, round(avg(cast(pred is not null as integer)), 6) coverage'
HORIZON = "horizon in (1, 3, 6, 12)"


def _levels(rows: str, levels: dict[str, str], model: str = "model", where: str = "true") -> str:
    return " union all ".join(f"select '{name}' as level, model {model}, horizon, {WAPE} from (select {keys + ', ' if keys else ''}model, horizon, month, cut, sum(\"real\") \"real\", sum(pred) pred from {rows} where {HORIZON} and {where} group by all) group by model, horizon" for name, keys in levels.items())


_BODIES = {
    "flagship_backtest_wape": _levels("p_long join cat using (product_id)", {"product": "product_id", "category": "category", "total": ""}, where="model = 'SeasonalNaive'"),
    "facts_net": "select product_id, month, round(units, 4) units, round(revenue, 4) revenue, round(avg_price, 4) avg_price from facts",
    "gift_filter": "select month, round(sum(units), 6) units, count(*) as rows from (select product_id, month, sum(case when credit_note then -quantity else quantity end) units from lines where price > 0.05 group by all) group by 1",
    "client_product_rollup": "select product_id, month, round(units, 4) units, round(revenue, 4) revenue, round(avg_price, 4) avg_price from facts",
    "month_scan": "select product_id, credit_note, count(*) \"lines\", round(sum(quantity), 4) quantity, round(sum(amount), 4) amount from lines where month = date '2000-05-01' group by all",
    "catalog_scan": "select product_id, category, lab from cat",
    "active_universe": "select product_id, count(*) as months from facts where product_id in (select product_id from facts where units > 0 and month = date '2001-10-01') group by 1",
    "incomplete_months": "select month, round(units, 6) units, round(ratio, 6) ratio from (select m.month, m.units, m.units / (select case when count(*) >= 6 then median(units) end from (select month, sum(units) units from facts group by 1) b where b.month < m.month and b.month >= (select min(month) from (select distinct month from facts where month < m.month order by month desc limit 12))) ratio from (select month, sum(units) units from facts group by 1) m) r where not exists (select 1 from (select m.month, m.units / (select case when count(*) >= 6 then median(units) end from (select month, sum(units) units from facts group by 1) b where b.month < m.month and b.month >= (select min(month) from (select distinct month from facts where month < m.month order by month desc limit 12))) ratio from (select month, sum(units) units from facts group by 1) m) later where later.month >= r.month and coalesce(later.ratio, 1) >= 0.5)",
    "extract_checks": "select * from (select unnest(['rows', 'products', 'months', 'negative_units', 'zero_units', 'null_price', 'missing_months', 'categories']) \"check\", unnest([count(*), count(distinct product_id), count(distinct month), count(*) filter (units < 0), count(*) filter (units = 0), count(*) filter (avg_price is null), datediff('month', min(month), max(month)) + 1 - count(distinct month), (select count(distinct category) from cat)]) \"value\" from facts)",
    "fingerprint": "select count(*) as rows, count(distinct product_id) series, min(month) first_month, max(month) last_month, round(sum(units), 2) total from facts",
    "births_deaths": "select cast(year(born) as integer) as year, count(*) births, count(*) filter (quiet >= 25 and quiet > gap) deaths from (select product_id, min(month) born, datediff('month', max(month), date '2001-10-01') quiet, coalesce(max(gap), 0) gap from (select product_id, month, datediff('month', lag(month) over (partition by product_id order by month), month) gap from facts where units > 0 and not (product_id % 5 = 0 and month > date '1999-06-01')) group by 1) group by 1",
    "purchase_histogram": "select case when m <= 2 then '1-2' when m <= 5 then '3-5' when m <= 11 then '6-11' when m <= 23 then '12-23' else '24+' end as months, count(*) pairs from (select client_id, product_id, count(distinct month) m from cfacts where units > 0 group by all) group by 1",
    "client_feature": """select s.client_id, main_category, case when active <= 3 then 'ocasional' when active <= 9 then 'regular' else 'frecuente' end frequency, round(annual_units, 4) annual_units, round(annual_value, 4) annual_value, round(case when u0 > 0 then u1 / u0 - 1 else 0 end, 4) trend_3m, datediff('day', last, date '2000-12-31') recency_days, date '2000-12-31' computed_on
        from (select client_id, sum(units) annual_units, sum(revenue) annual_value, coalesce(sum(units) filter (month >= date '2000-10-01'), 0) u1, coalesce(sum(units) filter (month between date '2000-07-01' and date '2000-09-01'), 0) u0 from cfacts where month between date '2000-01-01' and date '2000-12-01' group by 1) s
        join (select client_id, category main_category from (select client_id, category, sum(units) u from cfacts join cat using (product_id) where month between date '2000-01-01' and date '2000-12-01' group by all) qualify row_number() over (partition by client_id order by u desc, category desc) = 1) using (client_id)
        join (select client_id, max(date) as last, count(distinct month) active from lines where not credit_note and date <= date '2000-12-31' group by 1) using (client_id)""",
    "dense_panel": "select product_id, month, round(units, 4) units from p_dense",
    "cuts": "select cut from cuts",
    "backtest_naive": 'select category, lab, cut, horizon, month, round("real", 6) "real", round("SeasonalNaive", 6) "SeasonalNaive", round("WindowAverage", 6) "WindowAverage", round("LastValue", 6) "LastValue", round(scale, 6) scale from a_report',
    "croston_tsb": """select p.category, p.lab, p.month, round(p.units, 6) units, round(coalesce(max(0.95 * z / ip), 0), 6) croston, round(coalesce(max(tp * tz), 0), 6) tsb from c_dense p left join lateral
        (select sum(d.units * case when i = 1 then pow(0.9, n - 1) else 0.1 * pow(0.9, n - i) end) z, sum(gap * case when i = 1 then pow(0.9, n - 1) else 0.1 * pow(0.9, n - i) end) ip, sum(d.units * case when i = 1 then pow(0.8, n - 1) else 0.2 * pow(0.8, n - i) end) tz from
            (select x.units, row_number() over (order by x.month) i, count(*) over () n, datediff('month', coalesce(lag(x.month) over (order by x.month), f.first - interval 1 month), x.month) gap from c_dense x, (select min(month) as first from c_dense y where y.category = p.category and y.lab = p.lab) f where x.category = p.category and x.lab = p.lab and x.month <= p.month and x.units > 0) d) e on true
        left join lateral (select sum(hit * case when i = 1 then pow(0.8, n - 1) else 0.2 * pow(0.8, n - i) end) tp from (select cast(x.units > 0 as integer) hit, row_number() over (order by x.month) i, count(*) over () n from c_dense x where x.category = p.category and x.lab = p.lab and x.month <= p.month)) g on true group by all""",
    "classify_series": "select category, lab, quadrant, round(adi, 6) adi, round(cv2, 6) cv2 from cls",
    "classify_products": """select product_id, case when n = 0 then 'sin_actividad' when adi < 1.32 and cv2 < 0.49 then 'suave' when adi < 1.32 then 'erratica' when cv2 < 0.49 then 'intermitente' else 'lumpy' end quadrant, round(adi, 6) adi, round(cv2, 6) cv2 from
        (select product_id, count(y) n, (datediff('month', greatest(date '1998-11-01', coalesce(min(month) filter (units > 0), date '1998-11-01')), date '2001-10-01') + 1) / nullif(count(y), 0) adi, pow(stddev_pop(y) / avg(y), 2) cv2 from (select *, case when units > 0 and month >= date '1998-11-01' then units end y from facts where month <= date '2001-10-01') group by 1 having max(month) >= date '1998-11-01')""",
    "classify_by_cut": "select category, lab, cut, quadrant, round(adi, 6) adi, round(cv2, 6) cv2 from cls_at where cut < date '2001-10-01'",
    "quadrant_distribution": "select quadrant, count(*) n, round(100 * count(*) / sum(count(*)) over (), 2) percent from cls where quadrant <> 'sin_actividad' group by 1",
    "label_report": "select coalesce(quadrant, 'sin_actividad') quadrant, horizon, count(*) n, round(sum(\"real\"), 6) \"real\" from c_report left join cls using (category, lab) group by all",
    "wape_levels": _levels("p_long join cat using (product_id)", {"product": "product_id", "category": "category", "lab": "lab", "total": ""}),
    "by_category": f"select category, model, horizon, {WAPE} from p_long join cat using (product_id) where {HORIZON} group by all",
    "by_quadrant": f"select coalesce(quadrant, 'sin_actividad') quadrant, model, horizon, {WAPE} from c_long left join cls using (category, lab) where {HORIZON} group by all",
    "mase": "select category, lab, cut, model, round(mase, 6) mase from c_mase",
    "mase_by_horizon": f"select model, horizon, round(avg(mase), 6) mean_mase, round(median(mase), 6) median_mase, count(*) n from c_long join c_mase using (category, lab, cut, model) where {HORIZON} group by all",
    "relatives": "select product_id, month, round(relative, 4) relative, round(weight, 4) weight from rel",
    "clamped_relatives": "select month, count(*) pairs, count(*) filter (relative > 3 or relative < 1/3.0::double) hit, round(avg(least(greatest(relative, 1/3.0::double), 3)), 6) mean from rel group by 1",
    "index_factor": "select k.level, k.level_id, round(case when a.index > 0 then b.index / a.index end, 4) factor from (select distinct level, level_id from idx) k left join idx a on a.level = k.level and a.level_id = k.level_id and a.month = date '2000-01-01' left join idx b on b.level = k.level and b.level_id = k.level_id and b.month = date '2001-09-01'",
    "first_products": "select distinct product_id from facts order by 1 limit 25",
    "category_shares": "select category, count(*) products, round(100.0 * count(*) / sum(count(*)) over (), 4) percent from (select distinct product_id from facts) left join cat using (product_id) group by 1",
    "without_recent_sale": "select count(*) products, count(*) filter (where not sold) stale, round(100.0 * count(*) filter (where not sold) / count(*), 4) percent from (select product_id, bool_or(month > date '2000-10-01' and units > 0) sold from facts where month <= date '2001-10-01' group by 1)",
    "facts_cross_check": "select product_id, month, f.units units_a, f.revenue revenue_a, c.units units_b, c.revenue revenue_b from facts f full join (select product_id, month, sum(units) units, sum(revenue) revenue from cfacts group by all) c using (product_id, month) where f.product_id is null or c.product_id is null or abs(f.units - c.units) > 1e-3 or abs(f.revenue - c.revenue) > 1e-3",
    "level_index": "select level, level_id, month, round(index, 4) as index from idx",
    "own_anchor": "select product_id, round(anchor, 4) anchor from own",
    "last_usable_price": "select product_id, round(price, 4) price, price_month from lastp",
    "derived_anchor": "select product_id, round(anchor, 4) anchor, origin from anch",
    "anchor_origin": "select origin, count(*) n from anch group by 1",
    "cascade_factor": """select s.product_id, s.month, round(coalesce(e1.index / b1.index, e2.index / b2.index, e3.index / b3.index), 4) factor, case when e1.index / b1.index is not null then 'category' when e2.index / b2.index is not null then 'lab' when e3.index / b3.index is not null then 'ipc' end rung from seen s join cat c using (product_id)
        left join idx b1 on b1.level = 'category' and b1.level_id = c.category and b1.month = s.month left join idx e1 on e1.level = 'category' and e1.level_id = c.category and e1.month = date '2001-09-01' left join idx b2 on b2.level = 'lab' and b2.level_id = c.lab and b2.month = s.month left join idx e2 on e2.level = 'lab' and e2.level_id = c.lab and e2.month = date '2001-09-01'
        left join idx b3 on b3.level = 'ipc' and b3.month = s.month left join idx e3 on e3.level = 'ipc' and e3.month = date '2001-09-01'""",
    "deflator": "select product_id, month, round(deflator, 4) deflator from defl",
    "deflated_revenue": "select month, count(*) n, count(deflator) with_deflator, round(sum(revenue * deflator), 1) revenue_real from facts left join defl using (product_id, month) group by 1",
    "client_deflated_revenue": "select client_id, count(deflator) n, round(sum(revenue * deflator), 1) revenue_real from cfacts left join defl using (product_id, month) group by 1",
    "relative_price": "select product_id, month, round(price_anchor, 4) anchor, round(price_rel_level, 4) price_rel_level from relp",
    "feature_table": "select product_id, month, round(price_anchor, 3) price_anchor, round(price_rel_level, 3) price_rel_level, round(var_price_rel_3m, 3) var_price_rel_3m, round(var_price_rel_12m, 3) var_price_rel_12m, category, lab from feat",
    "lag_features": "select product_id, month, " + ", ".join(f"round(lag(units, {k}) over w, 6) lag_{k}" for k in (1, 2, 3, 6, 12)) + ", cast(month(month) as integer) month_of_year from p_dense window w as (partition by product_id order by month)",
    "rolling_features": "select product_id, month, " + ", ".join(f"case when n_{k} = {k} then round(m_{k}, 4) end mean_{k}, case when n_{k} = {k} then round(s_{k}, 4) end sd_{k}, case when n_{k} = {k} and abs(m_{k}) > 1e-9 then round(s_{k} / m_{k}, 4) end cv_{k}" for k in (3, 6, 12)) + " from (select product_id, month, " + ", ".join(f"count(units) over w{k} n_{k}, avg(units) over w{k} m_{k}, stddev_samp(units) over w{k} s_{k}" for k in (3, 6, 12)) + " from p_dense window " + ", ".join(f"w{k} as (partition by product_id order by month rows between {k} preceding and 1 preceding)" for k in (3, 6, 12)) + ")",
    "feature_coverage": "select unnest(['price_anchor', 'price_rel_level', 'var_price_rel_3m', 'var_price_rel_12m', 'category', 'lab']) \"column\", unnest([count(price_anchor), count(price_rel_level), count(var_price_rel_3m), count(var_price_rel_12m), count(category), count(lab)]) filled, round(unnest([count(price_anchor), count(price_rel_level), count(var_price_rel_3m), count(var_price_rel_12m), count(category), count(lab)]) / any_value(n), 6) share from feat, (select count(*) n from relp) c",
    "series_length": "select count(*) series, round(avg(cast(n >= 13 as integer)), 6) share_long, max(n) longest from (select product_id, count(*) n from p_dense group by 1)",
    "select_retrospective": "select category, lab, model from c_best",
    "ranking_prospective": "select category, lab, cut, model, rank from c_rank",
    "ranking_by_quadrant": "select category, lab, cut, model, rank from q_rank",
    "report_selected": "select category, lab, cut, horizon, model winner, round(pred, 6) pred from c_long join c_best using (category, lab, model)",
    "report_cascade": "select category, lab, cut, horizon, round(pred, 6) pred, used_model, used_rank from c_casc",
    "cascade_origin": "select case when used_rank is null then 'nobody' when used_rank = 0 then 'winner' else 'cascade' end origin, count(*) as rows, round(100 * count(*) / sum(count(*)) over (), 2) percent from c_casc group by 1",
    "stability": "select changes, count(*) series, round(100 * count(*) / sum(count(*)) over (), 1) percent from (select category, lab, cast(coalesce(sum(cast(model <> p as integer)), 0) as bigint) changes from (select *, lag(model) over (partition by category, lab order by cut) p from c_rank where rank = 0) group by all) group by 1",
    "winners": "select model, " + ", ".join(f"count(*) filter (quadrant = '{q}') {q}" for q in ("suave", "erratica", "intermitente", "lumpy", "sin_actividad")) + ", count(*) total from c_rank left join cls using (category, lab) where rank = 0 group by 1",
    "quadrant_winners": "select cut, quadrant, min(model) model from q_rank join quad using (category, lab, cut) where rank = 0 group by all",
    "wape_by_series": "select model, category, lab, horizon, wape, bias, n, coverage from c_series",
    "head_to_head": _levels("c_long", {"series": "category, lab", "category": "category", "total": ""}, "contender"),
    "head_to_head_category": f"select category, horizon, model contender, {WAPE}, any_value(weight) weight from c_long join (select category, horizon, round(100 * sum(abs(\"real\")) / sum(sum(abs(\"real\"))) over (partition by horizon), 4) weight from c_report group by category, horizon) using (category, horizon) group by category, horizon, model",
    "interval_coverage": 'select horizon, round(avg(cast("real" >= "P10" and "real" <= "P90" as integer)) filter ("P10" is not null), 6) coverage, round(avg(cast("real" >= "P10" and "real" <= "P90" as integer)) filter ("P10" is not null) - 0.8, 6) deviation, round(sum("P90" - "P10") / nullif(sum(abs("real")) filter ("P10" is not null), 0), 6) relative_width, count("P10") n from c_int group by 1',
    "crossing_rate": 'select horizon, round(avg(cast("P50" < "P10" or "P90" < "P50" as integer)), 6) crossing_rate, count("P10") n from c_int group by 1',
    "pinball": 'select horizon, quantile, round(sum(greatest(q * ("real" - v), (q - 1) * ("real" - v))) / nullif(sum(abs("real")), 0), 6) pinball, count(*) n from (select horizon, "real", unnest([\'P10\', \'P50\', \'P90\']) quantile, unnest([0.1, 0.5, 0.9]::double[]) q, unnest(["P10", "P50", "P90"]) v from c_int) where v is not null group by all',
    "hier_levels": "select level, series, month, round(sum(units), 4) units from p_dense join members using (product_id) where level <> 'product' group by all",
    "coherence": "select cut, count(*) cells from nodes n join (select m.series, l.cut, sum(pred) expected from members m join (select n.cut, n.pred, m2.product_id from nodes n join members m2 on m2.series = n.series and m2.level = 'product' where n.level = 'product') l using (product_id) group by all) using (series, cut) where abs(pred - expected) > 1e-6 + 1e-4 * abs(expected) group by 1",
    "reconcile_bottom_up": "select m.level, m.series, l.cut, round(sum(pred), 3) pred from members m join (select n.cut, n.pred, m2.product_id from nodes n join members m2 on m2.series = n.series and m2.level = 'product' where n.level = 'product') l using (product_id) group by all",
    "merge_runs": 'select category, lab, cut, horizon, month, round("real", 6) "real", round("SeasonalNaive", 6) "SeasonalNaive", round("WindowAverage", 6) "WindowAverage" from c_report',
    "contract_json": "select order_id, client_id, month, round(sum(case when credit_note then -quantity else quantity end * price), 2) total, count(*) n_lines from lines where month = date '2000-05-01' group by all",
    "contract_ingest": "select count(*) \"lines\", round(sum(case when credit_note then -quantity else quantity end), 6) quantity, 0::bigint rejected from lines where month = date '2000-05-01'",
    "stratified_sample": "select product_id, quadrant from (select product_id, case when n = 0 then 'sin_actividad' when adi < 1.32 and cv2 < 0.49 then 'suave' when adi < 1.32 then 'erratica' when cv2 < 0.49 then 'intermitente' else 'lumpy' end quadrant from (select product_id, count(y) n, (datediff('month', greatest(date '1998-11-01', coalesce(min(month) filter (units > 0), date '1998-11-01')), date '2001-10-01') + 1) / nullif(count(y), 0) adi, pow(stddev_pop(y) / avg(y), 2) cv2 from (select *, case when units > 0 and month >= date '1998-11-01' then units end y from facts where month <= date '2001-10-01') group by 1 having max(month) >= date '1998-11-01')) qualify row_number() over (partition by quadrant order by md5('42-' || product_id), product_id) <= 20",
}
for _group, _name in (("horizon", "improvement"), ("category, horizon", "improvement_by_category")):
    _BODIES[_name] = f"""select {_group}, count(*) series, count(*) filter (g is null) not_comparable, count(*) filter (g > 0) wins, round(100.0::double * count(*) filter (g > 0) / nullif(count(g), 0), 1) percent_wins, round(quantile_cont(g, 0.5) * 1.0000000001::double, 6) median, round(quantile_cont(g, 0.25) * 1.0000000001::double, 6) p25, round(quantile_cont(g, 0.75) * 1.0000000001::double, 6) p75
        from (select a.category, a.lab, a.horizon, case when a.coverage > 0 and a.coverage = b.coverage then a.wape - b.wape end g from c_series a join c_series b using (category, lab, horizon) where a.model = 'SeasonalNaive' and b.model = 'WindowAverage') group by all"""

#: Queries whose doubles both engines push off the borders of rounding, where exact halves are common, before they round.
_PUSHED = frozenset("""facts_net client_product_rollup month_scan gift_filter incomplete_months client_feature dense_panel backtest_naive croston_tsb classify_series classify_products classify_by_cut
    label_report mase relatives clamped_relatives level_index own_anchor last_usable_price derived_anchor cascade_factor deflator deflated_revenue client_deflated_revenue relative_price feature_table
    lag_features rolling_features report_selected report_cascade hier_levels reconcile_bottom_up merge_runs contract_json contract_ingest""".split())


def _pushed(body: str) -> str:
    out, i = "", 0
    while (at := body.find("round(", i)) >= 0:
        depth, k, comma = 1, at + 6, -1
        while depth:
            depth += (body[k] == "(") - (body[k] == ")")
            comma = k if body[k] == "," and depth == 1 else comma
            k += 1
        out += body[i:at] + f"round(({body[at + 6 : comma]}) * 1.0000000001::double{body[comma : k - 1]})"
        i = k
    return out + body[i:]


ORACLE_SQL: dict[str, str] = {name: _sql(_pushed(body) if name in _PUSHED else body) for name, body in _BODIES.items()}
