"""Composite queries that chain several operators.

Their frames hold one row per nation or region and period, so groups are known to be
few and as long as the calendar; the operators are told so and count nothing.
"""

from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op
from loomframe.queries.registry import MONEY, SALES, money, query, sales
from loomframe.queries.shaping import MONTHS, month_columns
from loomframe.sources import table


@query(
    f"""select m as month, round(avg(mean), 4) as mean from
          (select n_name, cast(month(o_orderdate) as integer) as m, avg(o_totalprice) as mean
           from {SALES} group by all) group by m order by m"""
)
def x1_month_means(spark, sf):
    wide = month_columns(spark, sf)
    long = op.pivot_longer(
        wide, ids=["n_name"], names_to="month", values_to="value",
        names_pattern=r"month_(\d+)", names_cast={"month": "int"},
    )
    means = long.groupBy("month").agg(L.mean_of("value", na_rm=True).alias("mean"))
    return means.select("month", F.round("mean", 4).alias("mean")).orderBy("month")


def complete_groups(spark, sf, group, period):
    """Change per period, groups with any gap dropped, full periods counted."""
    totals = (
        sales(spark, sf)
        .groupBy(F.col(group).alias("g"), F.trunc("o_orderdate", period).alias("m"))
        .agg(money("o_totalprice").alias("sales"))
    )
    full = op.complete(totals, ["g", "m"])
    changed = op.lag_change(full, "sales", ["g"], "m", out="mom", limit=op.WHOLE_GROUPS)
    kept = op.keep_groups_all(changed, F.col("sales").isNotNull(), ["g"], few_groups=True)
    return kept.groupBy("g").agg(
        L.n_complete("sales").alias("n_complete"),
        F.round(L.mean_of("mom", na_rm=True), 6).alias("avg_mom"),
    )


@query(
    f"""with t as (select r_name g, date_trunc('month', o_orderdate) m,
          {MONEY.format('o_totalprice')} sales from {SALES} group by 1, 2),
        grid as (select a.g, b.m from (select distinct g from t) a
                 cross join (select distinct m from t) b),
        f as (select grid.g, grid.m, t.sales from grid
              left join t on t.g = grid.g and t.m = grid.m),
        w as (select g, m, sales,
                sales / nullif(lag(sales) over (partition by g order by m), 0) - 1 mom,
                bool_and(coalesce(sales is not null, false)) over (partition by g) ok from f)
        select g, cast(count(sales) as bigint) n_complete, round(avg(mom), 6) avg_mom
        from w where ok group by g"""
)
def x2_complete_groups(spark, sf):
    return complete_groups(spark, sf, "r_name", "month")


@query(
    f"""with recursive t as (select n_name, cast(year(o_orderdate) as integer) as year,
          {MONEY.format('o_totalprice')} as invest from {SALES} group by all),
        e as (select *, row_number() over (partition by n_name order by year) as i from t),
        k as (select n_name, year, i, cast(1000000 as double) as capital from e where i = 1
          union all select e.n_name, e.year, e.i, k.capital * 0.95 + e.invest
            from k join e on e.n_name = k.n_name and e.i = k.i + 1)
        select n_name, year, round(capital, 2) as capital,
          (select count(distinct n_name) from t) as n_nations from k"""
)
def x3_inventory(spark, sf):
    invest = (
        sales(spark, sf)
        .groupBy("n_name", F.year("o_orderdate").alias("year"))
        .agg(money("o_totalprice").alias("invest"))
    )
    stock = op.accumulate_affine(
        invest, 0.95, "invest", ["n_name"], "year", init=1_000_000.0, out="capital",
        limit=op.WHOLE_GROUPS,
    )
    names = invest.select("n_name").distinct().agg(F.count(F.lit(1)).alias("n"))
    return stock.select(
        "n_name", "year", F.round("capital", 2).alias("capital"),
        names.scalar().alias("n_nations"),
    )


_MONTH_NUMBER = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate)"


@query(
    f"""with recursive t as (select r_name as store, {_MONTH_NUMBER} as month,
          {MONEY.format('o_totalprice')} as sales from {SALES} group by all),
        long as (select g.store, m.month, t.sales from (select distinct store from t) g
          cross join (select unnest(range(min(month), max(month) + 1)) as month from t) m
          left join t on t.store = g.store and t.month = m.month),
        w as (select *, sales / nullif(lag(sales) over (partition by store order by month), 0)
            - 1 as change,
          bool_and(sales is not null) over (partition by store) as ok from long),
        clean as (select * from w where ok),
        k as (select store, month, cast(100 as double) as base from clean
            where month = (select min(month) from t)
          union all select c.store, c.month, k.base * 0.9 + c.sales
            from k join clean c on c.store = k.store and c.month = k.month + 1),
        s as (select store, cast(sum(cast(sales as decimal(18,2))) as double) as total,
          avg(change) as mean_change from clean group by store)
        select s.store, s.total, round(s.mean_change, 6) as mean_change,
          cast(rank() over (order by s.total desc) as integer) as place,
          round(k.base, 2) as last_base
        from s join k on k.store = s.store and k.month = (select max(month) from t)"""
)
def x4_capstone(spark, sf):
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    totals = (
        sales(spark, sf)
        .groupBy(F.col("r_name").alias("store"), month.alias("month"))
        .agg(money("o_totalprice").alias("sales"))
    )
    # All months from the first to the last of the data, also those without any sales.
    first, last = table(spark, sf, "orders").agg(F.min(month), F.max(month)).first()
    months = range(first, last + 1)
    wide = op.pivot_wider(totals, "month", "sales", values=months, names_prefix="m")
    long = op.pivot_longer(
        wide, ids=["store"], names_to="month", values_to="sales",
        names_pattern=r"m(\d+)", names_cast={"month": "int"},
    )
    changed = op.lag_change(long, "sales", ["store"], "month", limit=op.WHOLE_GROUPS)
    clean = op.keep_groups_all(
        changed, F.col("sales").isNotNull(), ["store"], few_groups=True
    )
    based = op.accumulate_affine(
        clean, 0.9, "sales", ["store"], "month", init=100.0, out="base", limit=op.WHOLE_GROUPS
    )
    stores = based.groupBy("store").agg(
        money("sales").alias("total"),
        F.round(L.mean_of("change", na_rm=True), 6).alias("mean_change"),
        F.round(F.max_by("base", "month"), 2).alias("last_base"),
    )
    return op.min_rank(stores, "-total", out="place", limit=op.WHOLE_GROUPS)
