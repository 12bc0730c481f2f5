"""Projection, row predicates, reshaping, splitting."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import functions as L
from loomframe import operators as op
from loomframe.queries.registry import GAPPY, MONEY, SALES, events_with_gaps, money, query, sales
from loomframe.sources import table

MONTHS = list(range(1, 13))
TYPES = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("select r_name, cast(m as integer) as month from region cross join range(1, 13) t(m)")
def gen_expand_grid(spark, sf):
    regions = table(spark, sf, "region").select("r_name")
    return op.expand_grid(regions, month=F.sequence(F.lit(1), F.lit(12)))


@query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) as unit_revenue
       from lineitem"""
)
def proj_derived_ratio(spark, sf):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        L.safe_div(revenue, "l_quantity").alias("unit_revenue"),
    )


@query("select c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def proj_drop_first(spark, sf):
    return op.drop_positions(table(spark, sf, "customer"), 0)


@query(
    """select o_orderkey, o_custkey, o_totalprice from orders
       where o_totalprice > 100000 and o_orderstatus = 'F'"""
)
def filter_rows(spark, sf):
    orders = table(spark, sf, "orders")
    picked = orders.where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"))
    return picked.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    """select l_orderkey, l_partkey, l_linenumber, discount, tax from
         (select *, nullif(l_discount, 0.0) as discount, nullif(l_tax, 0.0) as tax from lineitem)
       where discount is not null and tax is not null"""
)
def filter_if_all(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )
    return op.filter_if_all(lines, ["discount", "tax"], lambda c: c.isNotNull())


@query(f"select event_id, user_id, v from {GAPPY} where not (user_id is null or v is null)")
def filter_not_any_null(spark, sf):
    events = events_with_gaps(spark, sf).select("event_id", "user_id", "v")
    return op.filter_not_any(events, ["user_id", "v"], lambda c: c.isNull())


_LABEL = """case when c_acctbal < 0 then null when c_mktsegment = 'BUILDING' then '  Total '
  else c_mktsegment end"""


@query(
    f"""select c_custkey, c_name, label from (select *, {_LABEL} as label from customer)
        where not (trim(regexp_replace(coalesce(label, ''), '\\s+', ' ', 'g')) = 'Total'
                or trim(regexp_replace(coalesce(c_name, ''), '\\s+', ' ', 'g')) = 'Total')"""
)
def filter_summary_rows(spark, sf):
    labelled = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.expr(_LABEL).alias("label")
    )
    return op.drop_matching_rows(labelled, "^Total$")


@query("select distinct o_custkey, o_orderstatus from orders")
def distinct_keys(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query(
    """select l_returnflag, l_linestatus, count(*) as n from lineitem
       group by l_returnflag, l_linestatus"""
)
def count_by(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select event_id, case when v > 50 then 'high' when not (v > 50) then 'low' end as level
        from {GAPPY}"""
)
def cond_if_else(spark, sf):
    level = L.if_else(F.col("v") > 50, F.lit("high"), F.lit("low"))
    return events_with_gaps(spark, sf).select("event_id", level.alias("level"))


@query(
    """select o_orderkey, case when o_totalprice >= 400000 then 'top'
         when o_totalprice >= 200000 then 'mid' when o_totalprice >= 50000 then 'low'
         else 'base' end as band from orders"""
)
def cond_case_when(spark, sf):
    price = F.col("o_totalprice")
    band = L.case_when(
        (price >= 400000, "top"), (price >= 200000, "mid"), (price >= 50000, "low"),
        default="base",
    )
    return table(spark, sf, "orders").select("o_orderkey", band.alias("band"))


@query(
    f"""select event_id, coalesce(v, 0.0) as v,
          coalesce(nullif(event_type, 'view'), 'other') as kind from {GAPPY}"""
)
def fill_na(spark, sf):
    kind = F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("other"))
    events = events_with_gaps(spark, sf).select("event_id", "v", kind.alias("kind"))
    return events.na.fill({"v": 0.0})


@query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round((l_quantity - avg(l_quantity) over ())
           / nullif(stddev_samp(l_quantity) over (), 0), 6) as l_quantity,
         round((l_extendedprice - avg(l_extendedprice) over ())
           / nullif(stddev_samp(l_extendedprice) over (), 0), 6) as l_extendedprice
       from lineitem"""
)
def across_scale(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_extendedprice")
    scaled = op.scale_columns(lines, op.numeric(), exclude=keys)
    return op.mutate_across(
        scaled, ["l_quantity", "l_extendedprice"], lambda c: F.round(c, 6)
    )


def line_amounts(schema):
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    return [c for c in op.starts_with("l_")(schema) if c in doubles]


@query(
    """select round(avg(l_quantity), 4) as mean_l_quantity,
         round(avg(l_extendedprice), 4) as mean_l_extendedprice,
         round(avg(l_discount), 4) as mean_l_discount, round(avg(l_tax), 4) as mean_l_tax
       from lineitem"""
)
def across_mean_prefix(spark, sf):
    lines = table(spark, sf, "lineitem")
    return op.summarise_across(
        lines, line_amounts, lambda c: F.round(L.mean_of(c, na_rm=True), 4), name="mean_{col}"
    )


def _by_year(spark, sf):
    return (
        sales(spark, sf)
        .groupBy("n_name", F.year("o_orderdate").alias("year"))
        .agg(money("o_totalprice").alias("total"))
    )


_BY_YEAR = f"""select n_name, cast(year(o_orderdate) as integer) as year,
  {MONEY.format('o_totalprice')} as total from {SALES} group by all"""


@query(
    f"""with t as ({_BY_YEAR})
        select g.n_name, cast(y as varchar) as year, total
        from (select distinct n_name from t) g cross join (select distinct year as y from t) r
          left join t on t.n_name = g.n_name and t.year = y"""
)
def reshape_longer(spark, sf):
    wide = op.pivot_wider(_by_year(spark, sf), "year", "total")
    return op.pivot_longer(wide, ids=["n_name"], names_to="year", values_to="total")


def month_columns(spark, sf, by="n_name"):
    """Mean order value per calendar month, the months as columns month_1 ... month_12."""
    means = (
        sales(spark, sf)
        .groupBy(by, F.month("o_orderdate").alias("m"))
        .agg(F.avg("o_totalprice").alias("mean"))
    )
    return op.pivot_wider(means, "m", "mean", values=MONTHS, names_prefix="month_")


_BY_MONTH = f"""select n_name, month(o_orderdate) as m, avg(o_totalprice) as mean
  from {SALES} group by all"""


@query(
    f"""with t as ({_BY_MONTH})
        select g.n_name, cast(k as integer) as month, round(mean, 4) as mean
        from (select distinct n_name from t) g cross join range(1, 13) r(k)
          left join t on t.n_name = g.n_name and t.m = k"""
)
def reshape_longer_pattern(spark, sf):
    long = op.pivot_longer(
        month_columns(spark, sf), ids=["n_name"], names_to="month", values_to="mean",
        names_pattern=r"month_(\d+)", names_cast={"month": "int"},
    )
    return long.withColumn("mean", F.round("mean", 4))


# Rows that a task is dealt, about: at least, where fewer tasks will do, and at most.
_LEAST_DEALT, _MOST_DEALT = 50_000, 500_000


@query(
    """with t as (select l_orderkey, l_linenumber, cast(sum(l_quantity) as double) as qty,
           cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
         from lineitem group by all)
       select g.l_orderkey, cast(k as integer) as num, qty, price
       from (select distinct l_orderkey from t) g cross join range(1, 8) r(k)
         left join t on t.l_orderkey = g.l_orderkey and t.l_linenumber = k"""
)
def reshape_longer_value(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    # Dealt by order once; both aggregations then find their rows in place. A task holds the
    # groups of its rows, so the number of tasks grows with the table.
    rows = lines.count()
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _LEAST_DEALT)), -(-rows // _MOST_DEALT), 1)
    lines = (
        lines.repartition(tasks, "l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.sum("l_quantity").alias("qty"), money("l_extendedprice").alias("price"))
    )
    wide = op.pivot_wider(lines, "l_linenumber", ["qty", "price"], values=range(1, 8))
    return op.pivot_longer(
        wide, ids=["l_orderkey"], names_to=[".value", "num"], names_pattern=r"(.*)_(\d+)",
        names_cast={"num": "int"},
    )


_SEGMENT_COUNTS = ", ".join(
    f"max(case when c_mktsegment = '{s}' then n end) as \"{s}\"" for s in SEGMENTS
)


@query(
    f"""select c_nationkey, {_SEGMENT_COUNTS} from
          (select c_nationkey, c_mktsegment, count(*) as n from customer group by all)
        group by c_nationkey"""
)
def reshape_wider(spark, sf):
    counts = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return op.pivot_wider(counts, "c_mktsegment", "n", values=SEGMENTS)


_TYPE_CELLS = ", ".join(
    f"max(case when event_type = '{t}' then n end) as n_{t}, "
    f"max(case when event_type = '{t}' then total end) as total_{t}"
    for t in TYPES
)


@query(
    f"""select user_id, {_TYPE_CELLS} from (select user_id, event_type, count(*) as n,
          {MONEY.format('value')} as total from events group by all) group by user_id"""
)
def reshape_wider_multi(spark, sf):
    cells = (
        table(spark, sf, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), money("value").alias("total"))
    )
    return op.pivot_wider(cells, "event_type", ["n", "total"], values=TYPES)


_SEGMENT_ROWS = ", ".join(
    f"max(case when c_mktsegment = '{s}' then c_acctbal end) as \"{s}\"" for s in SEGMENTS
)


@query(
    f"""select n, {_SEGMENT_ROWS} from (select *, row_number() over
          (partition by c_mktsegment order by c_custkey) as n from customer) group by n"""
)
def reshape_wider_rn(spark, sf):
    numbered = op.row_number(
        table(spark, sf, "customer"), "c_custkey", by=["c_mktsegment"], out="n"
    ).withColumn("n", F.col("n").cast("long"))
    return op.pivot_wider(
        numbered, "c_mktsegment", "c_acctbal", id_cols=["n"], values=SEGMENTS
    )


_SEGMENT_LISTS = ", ".join(
    f"array_to_string(list(n order by y) filter (c_mktsegment = '{s}'), ',') as \"{s}\""
    for s in SEGMENTS
)


@query(
    f"""select n_name, {_SEGMENT_LISTS} from (select n_name, c_mktsegment,
          year(o_orderdate) as y, count(*) as n from {SALES} group by all) group by n_name"""
)
def reshape_wider_list(spark, sf):
    counts = (
        sales(spark, sf)
        .groupBy("n_name", "c_mktsegment", F.year("o_orderdate").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = op.pivot_wider(
        counts, "c_mktsegment", "n", id_cols=["n_name"], values=SEGMENTS,
        values_fn="list", order_by=["y"],
    )
    return wide.withColumns({s: F.array_join(F.col(s).cast("array<string>"), ",") for s in SEGMENTS})


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITY_LISTS = ", ".join(
    f"array_to_string(list(y order by y) filter (o_orderpriority = '{s}'), ',') as \"{s}\""
    for s in PRIORITIES
)


@query(
    f"""select o_custkey, {_PRIORITY_LISTS} from (select o_custkey, o_orderpriority,
          year(o_orderdate) as y from orders) group by o_custkey"""
)
def reshape_wider_list_sparse(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")
    )
    wide = op.pivot_wider(
        orders, "o_orderpriority", "y", id_cols=["o_custkey"], values=PRIORITIES, values_fn="list"
    )
    return wide.withColumns({s: F.array_join(F.col(s).cast("array<string>"), ",") for s in PRIORITIES})


def _strict_mean(v: str, here: str, name: str) -> str:
    cell = f"filter (where {here})"
    return f"case when count(*) {cell} = count({v}) {cell} then round(avg({v}) {cell}, 6) end as \"{name}\""


_TYPE_MEANS = ", ".join(_strict_mean("v", f"event_type = '{t}'", t) for t in TYPES)


@query(f"select user_id, {_TYPE_MEANS} from {GAPPY} group by user_id")
def reshape_wider_mean_strict(spark, sf):
    cells = events_with_gaps(spark, sf).select("user_id", "event_type", "v")
    wide = op.pivot_wider(
        cells, "event_type", "v", id_cols=["user_id"], values=TYPES, values_fn=L.mean_of
    )
    return wide.withColumns({t: F.round(t, 6) for t in TYPES})


_MONTH_MEANS = ", ".join(
    _strict_mean(v, f"month(ts) = {m}", f"{v}_m{m}") for v in ("v", "value", "half") for m in MONTHS
)


@query(f"select user_id, {_MONTH_MEANS} from (select *, value / 2 as half from {GAPPY}) group by user_id")
def reshape_wider_mean_strict_many(spark, sf):
    cells = events_with_gaps(spark, sf).select(
        "user_id", F.month("ts").alias("m"), "v", "value", (F.col("value") / 2).alias("half")
    )
    wide = op.pivot_wider(
        cells, "m", ["v", "value", "half"], id_cols=["user_id"], values=MONTHS,
        names_prefix="m", values_fn=L.mean_of,
    )
    return wide.withColumns({c: F.round(c, 6) for c in wide.columns if c != "user_id"})


@query(
    """with t as (select *, sum(case when role = 'user' then 1 else 0 end)
           over (order by conv_id, turn) as record from conversations)
       select cast(record as bigint) as record,
         cast(sum(case when role = 'system' then length(text) end) as bigint) as chars_system,
         cast(sum(case when role = 'user' then length(text) end) as bigint) as chars_user,
         cast(sum(case when role = 'assistant' then length(text) end) as bigint)
           as chars_assistant
       from t group by record"""
)
def reshape_records(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("chars")
    )
    records = op.record_id(turns, F.col("role") == "user", ["conv_id", "turn"])
    return op.pivot_wider(
        records, "role", "chars", id_cols=["record"], values=["system", "user", "assistant"],
        names_prefix="chars_", values_fn=F.sum,
    )


_DOUBLED = ", ".join(
    f"round(max(case when m = {m} then mean end) * 2, 4) as month_{m}" for m in MONTHS
)


@query(f"select n_name, {_DOUBLED} from ({_BY_MONTH}) group by n_name")
def reshape_roundtrip_scale(spark, sf):
    long = op.pivot_longer(
        month_columns(spark, sf), ids=["n_name"], names_to="var", values_to="val"
    )
    changed = long.withColumn("val", F.round(F.col("val") * 2, 4))
    return op.pivot_wider(changed, "var", "val", values=[f"month_{m}" for m in MONTHS])


@query(
    """select o_orderkey, split_part(o_orderpriority, '-', 1) as code,
         split_part(o_orderpriority, '-', 2) as label from orders"""
)
def split_delim(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return op.separate_delim(orders, "o_orderpriority", "-", ["code", "label"])


@query(
    """select c_custkey, substring(c_name, 1, 8) as kind, substring(c_name, 10, 9) as num
       from customer"""
)
def split_position(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return op.separate_position(customers, "c_name", [("kind", 8), (None, 1), ("num", 9)])


@query(
    """select doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squished,
         regexp_matches(text, '[0-9]{3}') as has_number,
         nullif(regexp_extract(text, '[0-9]+'), '') as first_number,
         lang || '/' || source as origin from documents"""
)
def scalar_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(L.str_squish("text")).cast("long").alias("squished"),
        L.str_detect("text", "[0-9]{3}").alias("has_number"),
        L.str_extract("text", "[0-9]+").alias("first_number"),
        L.paste(F.col("lang"), "/", F.col("source")).alias("origin"),
    )


@query(
    """select o_custkey, cast(year(min(o_orderdate)) as bigint) as first_year,
         cast(date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 as bigint) as n_months,
         try_cast(substring(min(o_orderpriority), 1, 1) as integer) as top_priority
       from orders group by o_custkey"""
)
def scalar_dates(spark, sf):
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"),
        F.min("o_orderpriority").alias("p"),
    )
    months = L.month_sequence(F.trunc("a", "month"), F.trunc("b", "month"))
    return spans.select(
        "o_custkey",
        F.year("a").cast("long").alias("first_year"),
        F.size(months).cast("long").alias("n_months"),
        L.as_integer(F.substring("p", 1, 1)).alias("top_priority"),
    )


@query(
    """select cast(c_custkey as bigint) as c_custkey, c_name, number from
         (select *, try_cast(substring(c_name, 10) as integer) as number from customer)
       order by number desc nulls last"""
)
def sort_numeric_cast(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", "c_name", L.as_integer(F.substring("c_name", 10, 9)).alias("number")
    )
    return op.arrange(customers, "-number")


@query("select l_orderkey, l_linenumber from lineitem where l_discount > 0.09 or l_tax > 0.07")
def filter_if_any(spark, sf):
    lines = table(spark, sf, "lineitem")
    limits = {"l_discount": 0.09, "l_tax": 0.07}
    flags = lines.withColumns({f"{c}_high": F.col(c) > v for c, v in limits.items()})
    kept = op.filter_if_any(flags, ["l_discount_high", "l_tax_high"], lambda c: c)
    return kept.select("l_orderkey", "l_linenumber")


@query(
    """select user_id, cast(count(*) filter (where odd and not even) as integer) as only_odd from
         (select user_id, event_type, bool_or(month(ts) % 2 = 1) as odd,
            bool_or(month(ts) % 2 = 0) as even from events group by all) group by user_id"""
)
def scalar_set_difference(spark, sf):
    odd = F.month("ts") % 2 == 1
    sets = table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set(F.when(odd, F.col("event_type"))).alias("odd"),
        F.collect_set(F.when(~odd, F.col("event_type"))).alias("even"),
    )
    return sets.select("user_id", L.set_difference_size("odd", "even").alias("only_odd"))
