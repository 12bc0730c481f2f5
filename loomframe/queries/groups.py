"""Grouped summaries, per-column and per-group models, group filters, row selection."""

import numpy as np
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op
from loomframe.queries.registry import GAPPY, MONEY, events_with_gaps, money, query
from loomframe.queries.shaping import line_amounts
from loomframe.sources import table


@query(
    f"""select user_id, count(*) as n, round(avg(v), 6) as mean_v,
          case when count(*) = count(v) then round(avg(v), 6) end as mean_complete
        from {GAPPY} group by user_id"""
)
def agg_group_mean(spark, sf):
    return events_with_gaps(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(L.mean_of("v", na_rm=True), 6).alias("mean_v"),
        F.round(L.mean_of("v"), 6).alias("mean_complete"),
    )


@query(
    f"""select cast(year(o_orderdate) as bigint) as year,
          count(distinct (o_custkey, o_orderdate)) as visits,
          {MONEY.format('o_totalprice')} as total,
          round({MONEY.format('o_totalprice')}
            / nullif(count(distinct (o_custkey, o_orderdate)), 0), 6) as per_visit
        from orders where not (o_custkey is null or o_orderdate is null) group by 1"""
)
def agg_ratio(spark, sf):
    orders = table(spark, sf, "orders")
    complete = op.filter_not_any(orders, ["o_custkey", "o_orderdate"], lambda c: c.isNull())
    # Visits are counted by grouping twice rather than by a distinct aggregate, so the
    # money sums combine on the map side too.
    visits = complete.groupBy(
        F.year("o_orderdate").cast("long").alias("year"), "o_custkey", "o_orderdate"
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("paid"))
    yearly = visits.groupBy("year").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("paid").cast("double").alias("total")
    )
    return yearly.withColumn("per_visit", F.round(L.safe_div("total", "visits"), 6))


@query(
    """select l_returnflag, count(distinct (nullif(l_discount, 0.0), l_tax)) as combos
       from lineitem group by l_returnflag"""
)
def agg_n_distinct_tuple(spark, sf):
    discount = F.nullif("l_discount", F.lit(0.0))
    lines = table(spark, sf, "lineitem").select("l_returnflag", discount.alias("d"), "l_tax")
    return lines.groupBy("l_returnflag").agg(L.n_distinct("d", "l_tax").alias("combos"))


@query(
    f"""select cast(year(o_orderdate) as bigint) as year, count(*) as n,
          {MONEY.format('o_totalprice')} as total from orders group by 1"""
)
def agg_by_year(spark, sf):
    dated = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return dated.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total")
    )


@query(
    f"""select user_id, round(avg(case when v is null then 1 else 0 end), 6) as missing,
          count(v) as n_complete, bool_or(v is null) as any_missing
        from {GAPPY} group by user_id"""
)
def agg_missing_rate(spark, sf):
    return events_with_gaps(spark, sf).groupBy("user_id").agg(
        F.round(L.missing_share("v"), 6).alias("missing"),
        L.n_complete("v").alias("n_complete"),
        L.any_missing("v").alias("any_missing"),
    )


@query(
    """select event_type, cast(p as double) as prob,
         round(list_extract(q, i), 6) as q
       from (select event_type, quantile_cont(value, [0.25, 0.5, 0.75]) as q
             from events group by event_type)
         cross join (values (0.25, 1), (0.5, 2), (0.75, 3)) t(p, i)"""
)
def agg_reframe_quantiles(spark, sf):
    events = table(spark, sf, "events")
    got = op.reframe_quantiles(events, "value", [0.25, 0.5, 0.75], by=["event_type"])
    return got.withColumn("q", F.round("q", 6))


@query(
    """with t as (select l_returnflag, unnest([0.01::double, 0.5::double, 0.99::double]) as prob,
           unnest(quantile_cont(l_extendedprice, [0.01, 0.5, 0.99])) as q
           from lineitem group by l_returnflag)
       select l_returnflag, prob, round(q, 6) as q from t"""
)
def agg_quantiles_select(spark, sf):
    lines = table(spark, sf, "lineitem")
    got = op.select_quantiles(
        lines, "l_extendedprice", [0.01, 0.5, 0.99], by=["l_returnflag"], accuracy=1000
    )
    return got.withColumn("q", F.round("q", 6))


@query(
    """select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as col,
         unnest([round(avg(l_quantity), 4), round(avg(l_extendedprice), 4),
                 round(avg(l_discount), 4), round(avg(l_tax), 4)]) as mean from lineitem"""
)
def agg_per_column(spark, sf):
    means = op.summarise_columns(
        table(spark, sf, "lineitem"), line_amounts, lambda c: L.mean_of(c, na_rm=True), out="mean"
    )
    return means.withColumn("mean", F.round("mean", 4))


def _line_sql(col: str, x: str) -> str:
    return f"""select '{col}' as col, round(regr_slope(l_extendedprice, {x}), 3) as slope,
      round(regr_intercept(l_extendedprice, {x}), 3) as intercept,
      round(regr_r2(l_extendedprice, {x}), 6) as r2,
      cast(regr_count(l_extendedprice, {x}) as bigint) as n
      from (select *, nullif(l_discount, 0.0) as d from lineitem)"""


def _rounded(fits):
    return fits.withColumns(
        {"slope": F.round("slope", 3), "intercept": F.round("intercept", 3),
         "r2": F.round("r2", 6), "n": F.col("n").cast("long")}
    )


@query(" union all ".join(_line_sql(c, x) for c, x in
                          [("l_quantity", "l_quantity"), ("discount", "d"), ("l_tax", "l_tax")]))
def model_per_column(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_quantity", "l_tax",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )
    return _rounded(
        op.fit_per_column(lines, "l_extendedprice", ["l_quantity", "discount", "l_tax"])
    )


@query(
    """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) as slope,
         round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
         round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
         cast(regr_count(l_extendedprice, l_quantity) as bigint) as n
       from lineitem group by l_returnflag"""
)
def model_per_group(spark, sf):
    lines = table(spark, sf, "lineitem")
    return _rounded(op.fit_per_group(lines, "l_extendedprice", "l_quantity", ["l_returnflag"]))


@query(
    """with s as (
         select l_returnflag, count(*) as n, avg(l_extendedprice) as y, avg(l_quantity) as a, avg(l_discount) as b,
           covar_pop(l_extendedprice, l_quantity) as ya, covar_pop(l_extendedprice, l_discount) as yb,
           covar_pop(l_quantity, l_discount) as ab, var_pop(l_quantity) as aa, var_pop(l_discount) as bb,
           var_pop(l_extendedprice) as yy
         from lineitem group by l_returnflag),
       f as (select *, (ya * bb - yb * ab) / (aa * bb - ab * ab) as b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) as b2 from s)
       select l_returnflag, n, 2 as rank, round(b1, 3) as b_l_quantity, round(b2, 2) as b_l_discount,
         round(y - b1 * a - b2 * b, 2) as intercept, round((b1 * ya + b2 * yb) / yy, 6) as r2
       from f"""
)
def model_multi_per_group(spark, sf):
    """Price on quantity and discount, per return flag."""
    fits = op.fit_linear(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    places = {"b_l_quantity": 3, "b_l_discount": 2, "intercept": 2, "r2": 6}
    return fits.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    """select event_id, user_id, value from
         (select *, max(value) over (partition by user_id) as m from events) where value = m"""
)
def gfilter_at_max(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return op.filter_at_max(events, "value", by=["user_id"])


_RARE = "(select *, case when value < 250 then value end as w from events)"


@query(
    f"""select event_id, user_id, w from (select *, bool_and(coalesce(w > 0.4, false))
          over (partition by user_id) as ok from {_RARE}) where ok"""
)
def gfilter_all(spark, sf):
    w = F.when(F.col("value") < 250, F.col("value"))
    events = table(spark, sf, "events").select("event_id", "user_id", w.alias("w"))
    return op.keep_groups_all(events, F.col("w") > 0.4, by=["user_id"])


@query(
    f"""select event_id, user_id, v from (select *,
          avg(case when v is null then 1 else 0 end) over (partition by user_id) as share
          from {GAPPY}) where share < 0.2"""
)
def gfilter_missing_rate(spark, sf):
    events = events_with_gaps(spark, sf).select("event_id", "user_id", "v")
    return op.keep_groups_missing_below(events, "v", ["user_id"], 0.2)


@query(f"select event_id, user_id, v from {GAPPY} where v is not null")
def gfilter_rows(spark, sf):
    events = events_with_gaps(spark, sf).select("event_id", "user_id", "v")
    return events.where(F.col("v").isNotNull())


@query(
    """select o_orderkey, o_custkey from (select *, rank() over
         (partition by o_custkey order by o_orderdate desc nulls last) as r from orders)
       where r <= 2"""
)
def slice_max_ties(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return op.slice_max(orders, "o_orderdate", n=2, by=["o_custkey"]).drop("o_orderdate")


@query(
    """select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey
         order by o_orderdate desc nulls last, o_orderkey) as r from orders) where r <= 1"""
)
def slice_max_noties(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last = op.slice_max(
        orders, "o_orderdate", by=["o_custkey"], with_ties=False, tiebreak=["o_orderkey"]
    )
    return last.drop("o_orderdate")


@query(
    """select event_id, user_id, event_type from (select *, row_number() over
         (partition by user_id order by ts) as r from events) where r <= 2"""
)
def slice_head(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return op.slice_head(events, 2, ["user_id"], "ts").drop("ts")


@query(
    """select event_id, user_id, value from
         (select *, avg(value) over (partition by user_id) as m from events) where value > m"""
)
def nest_above_mean(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    # A value that is the mean is not above it, in whatever order the values were added up:
    # two-decimal amounts are compared exactly.
    value, amount = F.col("value"), F.col("value").try_cast("decimal(18,2)")
    stats = {
        "mean": F.avg("value"),
        "n": F.count("value"),
        "total": F.sum(amount),
        "exact": F.bool_and(F.coalesce(amount.cast("double") == value, value.isNull())),
    }
    marked = op.attach_group_stats(events, ["user_id"], stats)
    above = F.when(F.col("exact"), amount * F.col("n") > F.col("total")).otherwise(value > F.col("mean"))
    return marked.where(above).drop(*stats)


@query(
    """select event_id, user_id, value from
         (select *, median(value) over (partition by user_id) as m from events) where value > m"""
)
def nest_map(spark, sf):
    """Any function of a group's rows: a user's events are few, whatever the number of users."""
    import pandas as pd

    def above(events: pd.DataFrame) -> pd.DataFrame:
        return events[events["value"] > events["value"].median()]

    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return op.group_apply(events, ["user_id"], above, events.schema)


_TOP = 20


@query(
    f"""with t as (select event_type, value, row_number() over (partition by event_type order by value desc) as r
           from events),
         g as (select event_type, value, lead(value) over (partition by event_type order by value desc) as next
           from t where r <= {_TOP})
       select event_type, cast(count(*) as bigint) as n, min(value) as least, round(max(value - next), 6) as widest_gap
       from g group by event_type"""
)
def nest_reduce(spark, sf):
    """The widest gap between neighbours among a group's largest values: groups hold a fifth of the table."""

    top = _TOP

    def update(state, rows):
        largest = np.sort(np.append(state["top"] if state else [], rows["value"].to_numpy()))
        return {"top": largest[-top:].tolist()}

    def merge(a, b):
        return {"top": sorted(a["top"] + b["top"])[-top:]}

    def finish(state):
        values = state["top"]
        gaps = [b - a for a, b in zip(values, values[1:])]
        return [{"n": len(values), "least": values[0], "widest_gap": round(max(gaps), 6) if gaps else None}]

    f = op.Reduction(update, merge, finish, "top array<double>", "n bigint, least double, widest_gap double")
    return op.group_reduce(table(spark, sf, "events").select("event_type", "value"), ["event_type"], f)


@query("select user_id, event_id, event_type, value from events")
def nest_unnest_roundtrip(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return op.unnest(op.nest(events, ["user_id"]))
