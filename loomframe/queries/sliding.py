"""Ratios over periods, ranks, running, recursive and rolling values."""

from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op
from loomframe.queries.registry import GAPPY, MONEY, SALES, events_with_gaps, money, query, sales
from loomframe.sources import table


def nation_months(spark, sf):
    """Sales per nation and month: a nation has as many rows as the calendar has months."""
    return (
        sales(spark, sf)
        .groupBy("n_name", F.trunc("o_orderdate", "month").alias("month"))
        .agg(money("o_totalprice").alias("sales"))
    )


NATION_MONTHS = f"""select n_name, cast(date_trunc('month', o_orderdate) as date) as month,
  {MONEY.format('o_totalprice')} as sales from {SALES} group by all"""

FULL_MONTHS = f"""select g.n_name, m.month, t.sales
  from (select distinct n_name from ({NATION_MONTHS})) g
    cross join (select distinct month from ({NATION_MONTHS})) m
    left join ({NATION_MONTHS}) t on t.n_name = g.n_name and t.month = m.month"""


@query(
    f"""select n_name, month, round(sales / nullif(lag(sales) over
          (partition by n_name order by month), 0) - 1, 6) as change from ({NATION_MONTHS})"""
)
def win_mom(spark, sf):
    changed = op.lag_change(
        nation_months(spark, sf), "sales", ["n_name"], "month", limit=op.WHOLE_GROUPS
    )
    return changed.select("n_name", "month", F.round("change", 6).alias("change"))


@query(
    f"""select n_name, month, round(sales / nullif(lag(sales, 12) over
          (partition by n_name order by month), 0) - 1, 6) as change from ({FULL_MONTHS})"""
)
def win_yoy(spark, sf):
    full = op.complete(nation_months(spark, sf), ["n_name", "month"])
    changed = op.lag_change(
        full, "sales", ["n_name"], "month", n=12, limit=op.WHOLE_GROUPS
    )
    return changed.select("n_name", "month", F.round("change", 6).alias("change"))


@query(
    f"""select n_name, month, round(sales / nullif(max(case when month = date '1996-01-01'
          then sales end) over (partition by n_name), 0) - 1, 6) as vs_base
        from ({NATION_MONTHS})"""
)
def win_fixed_base(spark, sf):
    base = F.lit("1996-01-01").cast("date")
    rated = op.fixed_base_change(nation_months(spark, sf), "sales", "month", base, ["n_name"], few_groups=True)
    return rated.select("n_name", "month", F.round("vs_base", 6).alias("vs_base"))


@query(
    """select event_id, round(root - avg(root) over (partition by user_id), 6) as root
       from (select *, sqrt(value) as root from events)"""
)
def win_center(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "user_id", F.sqrt("value").alias("root")
    )
    return op.center(events, "root", ["user_id"]).select("event_id", F.round("root", 6).alias("root"))


@query(
    """select event_id, round((value - avg(value) over (partition by event_type))
         / nullif(stddev_samp(value) over (partition by event_type), 0), 6) as value
       from events"""
)
def win_scale(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    scored = op.standardise(events, "value", ["event_type"])
    return scored.select("event_id", F.round("value", 6).alias("value"))


def _rank_sql(function: str, order: str) -> str:
    return f"""select event_id, case when w is not null then cast({function}() over
      (partition by event_type order by {order}) as integer) end as rank
      from (select *, case when value < 250 then value end as w from events)"""


def _rankable(spark, sf):
    w = F.when(F.col("value") < 250, F.col("value"))
    return table(spark, sf, "events").select("event_id", "event_type", w.alias("w"))


@query(_rank_sql("rank", "w desc nulls last"))
def win_min_rank(spark, sf):
    return op.min_rank(_rankable(spark, sf), "-w", ["event_type"]).select("event_id", "rank")


@query(_rank_sql("dense_rank", "w desc nulls last"))
def win_dense_rank(spark, sf):
    return op.dense_rank(_rankable(spark, sf), "-w", ["event_type"]).select("event_id", "rank")


@query(_rank_sql("row_number", "w desc nulls last, event_id"))
def win_row_number(spark, sf):
    ranked = op.row_number(_rankable(spark, sf), "-w", ["event_type"], tiebreak=["event_id"])
    return ranked.select("event_id", "rank")


@query(
    """select event_id, cast(sum(cast(value as decimal(18,2))) over
         (partition by user_id order by event_id) as double) as cum from events"""
)
def win_cumsum(spark, sf):
    amount = F.col("value").cast("decimal(18,2)")
    events = table(spark, sf, "events").select("event_id", "user_id", amount.alias("amount"))
    summed = op.cumsum(events, "amount", ["user_id"], "event_id")
    return summed.select("event_id", F.col("cum").cast("double").alias("cum"))


@query(
    """select event_id, cast(sum(cast(value as decimal(18,2))) over (order by ts) as double)
         as cum from events"""
)
def win_cumsum_global(spark, sf):
    amount = F.col("value").cast("decimal(18,2)")
    events = table(spark, sf, "events").select("event_id", "ts", amount.alias("amount"))
    summed = op.cumsum(events, "amount", order_by="ts", ties="together")
    return summed.select("event_id", F.col("cum").cast("double").alias("cum"))


@query(
    """select event_id, round(product(1 + value / 10000) over
         (partition by user_id order by event_id), 6) as cum from events"""
)
def win_cumprod(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "user_id", (1 + F.col("value") / 10000).alias("factor")
    )
    grown = op.cumprod(events, "factor", ["user_id"], "event_id")
    return grown.select("event_id", F.round("cum", 6).alias("cum"))


def _fold_sql(step, first, partition="partition by user_id", shown="acc"):
    key = "user_id" if partition else "0"
    return f"""with recursive e as (select event_id, {key} as g, value,
        row_number() over ({partition} order by event_id) as i from events),
      k as (select event_id, g, i, {first} as acc from e where i = 1
        union all select e.event_id, e.g, e.i, {step}
          from k join e on e.g = k.g and e.i = k.i + 1)
      select event_id, {shown} as acc from k"""


@query(_fold_sql("k.acc * 0.95 + e.value", "value"))
def scan_affine_grouped(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    folded = op.accumulate_affine(events, 0.95, "value", ["user_id"], "event_id")
    return folded.select("event_id", "acc")


@query(_fold_sql("k.acc * 0.95 + e.value", "value", "", "round(acc, 4)"))
def scan_affine_global(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    folded = op.accumulate_affine(events, 0.95, "value", order_by="event_id")
    return folded.select("event_id", F.round("acc", 4).alias("acc"))


@query(
    """select event_id, round(100 * product(case when i = 1 then 1.0 else p / 100 end) over
         (partition by user_id order by event_id), 4) as index
       from (select *, 100 + (value - 50) / 100 as p,
         row_number() over (partition by user_id order by event_id) as i from events)"""
)
def scan_chain_index(spark, sf):
    price = 100 + (F.col("value") - 50) / 100
    events = table(spark, sf, "events").select("event_id", "user_id", price.alias("p"))
    chained = op.chain_index(events, "p", ["user_id"], "event_id")
    return chained.select("event_id", F.round("index", 4).alias("index"))


@query(_fold_sql("greatest(k.acc * 0.9, e.value)", "value"))
def scan_custom(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    folded = op.accumulate(events, lambda k, x: max(k * 0.9, x), "value", ["user_id"], "event_id")
    return folded.select("event_id", "acc")


@query(_fold_sql("least(greatest(k.acc * 0.8765432109876::double + 1, e.value), 400)", "value", "", "round(acc, 4)"))
def scan_custom_global(spark, sf):
    """A decaying maximum over the whole table, cut into blocks: its steps compose."""
    events = table(spark, sf, "events").select("event_id", "value")
    steps = op.clamped(0.8765432109876, 1.0, low="value", high=400.0)
    folded = op.accumulate(events, steps, "value", [], "event_id")
    return folded.select("event_id", F.round("acc", 4).alias("acc"))


_FRAME = "(partition by user_id order by ts rows between 2 preceding and current row)"


@query(
    f"""select event_id, case when count(*) over w = 3 and count(v) over w = 3
          then round(avg(v) over w, 6) end as rolling
        from (select *, case when value < 250 then value end as v from events)
        window w as {_FRAME}"""
)
def win_rolling_mean(spark, sf):
    v = F.when(F.col("value") < 250, F.col("value"))
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", v.alias("v"))
    rolled = op.rolling(events, "v", "mean", before=2, by=["user_id"], order_by="ts")
    return rolled.select("event_id", F.round("rolling", 6).alias("rolling"))


_WIDE = "(order by ts, event_id rows between 2499 preceding and current row)"


@query(
    f"""select event_id, case when count(*) over w = 2500 then cast(sum(cast(v as decimal(18,2))) over w as double) end as total,
          case when count(*) over w = 2500 then round(max(v) over w - min(v) over w, 6) end as spread
        from {GAPPY} window w as {_WIDE}"""
)
def win_rolling_wide(spark, sf):
    """Frames of 2,500 rows over the whole table: a sum, and the range as a statistic of two parts."""
    events = events_with_gaps(spark, sf).select("event_id", "ts", F.col("v").cast("decimal(18,2)").alias("v"))
    span = op.Mergeable(
        {"low": (F.min, F.least), "high": (F.max, F.greatest)}, lambda p: p["high"] - p["low"]
    )
    over = {"before": 2499, "order_by": ["ts", "event_id"], "na_rm": True}
    rolled = op.rolling(events, "v", "sum", out="total", **over)
    rolled = op.rolling(rolled, "v", span, out="spread", **over)
    return rolled.select("event_id", F.col("total").cast("double"), F.col("spread").cast("double"))


@query(
    f"""select event_id, case when count(*) over w = 3 then
          round(max(value) over w - min(value) over w, 6) end as spread,
          case when count(*) over w = 3 then
            cast(list_unique(list(event_type) over w) as bigint) end as kinds
        from events window w as {_FRAME}"""
)
def win_rolling_list(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")

    def describe(rows):
        values = F.transform(rows, lambda r: r["value"])
        kinds = F.array_distinct(F.transform(rows, lambda r: r["event_type"]))
        return F.struct(
            (F.array_max(values) - F.array_min(values)).alias("spread"),
            F.size(kinds).cast("long").alias("kinds"),
        )

    rolled = op.rolling_list(
        events, ["value", "event_type"], describe, before=2, by=["user_id"], order_by="ts"
    )
    return rolled.select(
        "event_id", F.round("rolling.spread", 6).alias("spread"),
        F.col("rolling.kinds").alias("kinds"),
    )


_SET_CHANGE = """with s as (select user_id, cast(ts as date) as day, list(distinct event_type) as items
         from events group by all),
       p as (select *, lag(items) over (partition by user_id order by day) as prev from s)
       select user_id, day,
         cast(len(list_filter(prev, lambda x: not list_contains(items, x))) as bigint) as lost,
         case when prev is not null then cast(len(list_filter(items,
           lambda x: not list_contains(prev, x))) as bigint) end as gained
       from p"""


def _daily_events(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


@query(_SET_CHANGE)
def win_set_diff(spark, sf):
    events = _daily_events(spark, sf)
    return op.period_set_change(events, "event_type", ["user_id"], "day", small_sets=True)


@query(_SET_CHANGE)
def win_set_diff_split(spark, sf):
    return op.period_set_change(_daily_events(spark, sf), "event_type", ["user_id"], "day")


@query(
    """select event_id, first_value(value) over (partition by user_id order by ts rows between
           unbounded preceding and unbounded following) as first,
         last_value(value) over (partition by user_id order by ts rows between
           unbounded preceding and unbounded following) as last from events"""
)
def win_first_last(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return op.first_last(events, "value", ["user_id"], "ts").select("event_id", "first", "last")


@query(
    """select u.user_id, d.day, count(e.event_id) as n
       from (select distinct user_id from events) u
         cross join (select distinct cast(ts as date) as day from events) d
         left join events e on e.user_id = u.user_id and cast(e.ts as date) = d.day
       group by all"""
)
def grid_complete(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    daily = days.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return op.complete(daily, ["user_id", "day"], fill={"n": 0})


@query(f"select n_name, month from ({FULL_MONTHS}) where sales is null")
def check_gaps(spark, sf):
    return op.missing_cells(nation_months(spark, sf), ["n_name", "month"])


@query(
    """with seen as (select distinct user_id, cast(ts as date) as day from events),
         absent as (select user_id, day from (select distinct user_id from seen)
           cross join (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from seen)
           anti join seen using (user_id, day)),
         runs as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as run from absent)
       select user_id, min(day) as first, max(day) as last, count(*) as n from runs group by user_id, run"""
)
def check_gap_runs(spark, sf):
    """Runs of days on which a user has no event."""
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return op.gap_runs(days, "day", ["user_id"], every="day")


@query(
    """select cast(sum(n) as bigint) as n_rows, cast(11 as bigint) as n_cols,
         count(*) as n_keys, max(n) = 1 as grain_unique, max(n) = 1 as as_expected
       from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)"""
)
def check_grain(spark, sf):
    return op.check_shape(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], n_cols=11)


@query(
    """select (select max(n) from (select count(*) n from orders group by o_custkey)) as left_most,
         (select max(n) from (select count(*) n from customer group by c_custkey)) as right_most,
         case when (select max(n) from (select count(*) n from orders group by o_custkey)) > 1
              then 'N' else '1' end || ':' ||
         case when (select max(n) from (select count(*) n from customer group by c_custkey)) > 1
              then 'N' else '1' end as relation"""
)
def check_join_relation(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return op.join_relation(orders, customer, {"o_custkey": "c_custkey"})


@query(
    """select cast(sum(n) as bigint) as n_rows, count(*) as n_keys,
         count(*) filter (n > 1) as n_tied_keys, count(*) filter (n > 1) = 0 as unique
       from (select count(*) as n from orders group by o_custkey, o_orderdate)"""
)
def check_order_key(spark, sf):
    return op.check_order_key(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate"])


# The same work with groups cut into blocks, as large groups are.
_BLOCK_ROWS = 400


def _numbered_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value", "ts")


@query(
    """select event_id, cast(rank() over (partition by event_type order by value) as integer)
         as rank from events"""
)
def win_rank_blocks(spark, sf):
    ranked = op.min_rank(_numbered_events(spark, sf), "value", ["event_type"], limit=_BLOCK_ROWS)
    return ranked.select("event_id", "rank")


@query(
    """select event_id, lag(value, 3) over (partition by event_type order by ts, event_id)
         as lagged from events"""
)
def win_lag_blocks(spark, sf):
    events = _numbered_events(spark, sf)
    got = op.lag(events, "value", ["event_type"], ["ts", "event_id"], n=3, limit=_BLOCK_ROWS)
    return got.select("event_id", "lagged")


@query(
    """select event_id, case when count(*) over w = 5 then round(avg(value) over w, 6) end
         as rolling from events window w as (partition by event_type order by ts, event_id
           rows between 4 preceding and current row)"""
)
def win_rolling_blocks(spark, sf):
    got = op.rolling(
        _numbered_events(spark, sf), "value", "mean", 4, ["event_type"], ["ts", "event_id"],
        limit=_BLOCK_ROWS,
    )
    return got.select("event_id", F.round("rolling", 6).alias("rolling"))


@query(
    """select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by event_type
         order by ts, event_id rows unbounded preceding) as double) as cum from events"""
)
def win_cumsum_blocks(spark, sf):
    events = _numbered_events(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)"))
    got = op.cumsum(events, "value", ["event_type"], ["ts", "event_id"], limit=_BLOCK_ROWS)
    return got.select("event_id", F.col("cum").cast("double").alias("cum"))


@query(
    """with t as (select event_type, unnest([0.1::double, 0.5::double, 0.9::double]) as prob,
           unnest(quantile_cont(value, [0.1, 0.5, 0.9])) as q from events group by event_type)
       select event_type, prob, round(q, 6) as q from t"""
)
def agg_quantiles_blocks(spark, sf):
    got = op.reframe_quantiles(
        _numbered_events(spark, sf), "value", [0.1, 0.5, 0.9], ["event_type"], limit=_BLOCK_ROWS
    )
    return got.withColumn("q", F.round("q", 6))
