"""Queries of row, column, set, window, imputation and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import ordering, preparation, series, tables
from causeway.plans.catalog import query, table


def _events(spark, sf):
    """Events in time order: a dense row number and two columns."""
    e = table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("u"))
    return ordering.with_row_number(e, "t", ["event_id"]).select("_row", "x", "u")


_EVENTS = "with e as (select row_number() over (order by ts, event_id) - 1 as _row, value as x, cast(user_id as double) as u from events)"


@query(_EVENTS + " select * from e")
def row_numbers(spark, sf):
    return _events(spark, sf)


@query(_EVENTS + ', l as (select _row, x, u, lag(x, 1) over w as "x:1", lag(u, 1) over w as "u:1", lag(x, 2) over w as "x:2", lag(u, 2) over w as "u:2" from e window w as (order by _row)) select _row - 2 as _row, x, u, "x:1", "u:1", "x:2", "u:2", _row - 1 as time from l where _row >= 2')
def lag_embedding(spark, sf):
    return series.lag_embed(_events(spark, sf), 2, with_time=True)


@query(_EVENTS + ", d as (select _row, x - 2 * lag(x, 1) over w + lag(x, 2) over w as x, u - 2 * lag(u, 1) over w + lag(u, 2) over w as u from e window w as (order by _row)) select _row - 2 as _row, round(x, 8) as x, u from d where _row >= 2")
def second_difference(spark, sf):
    return series.difference(_events(spark, sf), 2).withColumn("x", F.round("x", 8))


@query(_EVENTS + ", n as (select count(*) n from e), s as (select _row, lead(x, 2) over (order by _row) as x, u from e) select s._row, x, u from s, n where s._row < n - 2")
def shifted_columns(spark, sf):
    return series.shift(_events(spark, sf), [0, 2])


@query(_EVENTS + ", l as (select x, lag(x) over (order by _row) y, u, lag(u) over (order by _row) v from e) select 'x' as variable, round(regr_slope(x, y), 8) as slope from l union all select 'u', round(regr_slope(u, v), 8) from l")
def self_loops(spark, sf):
    return spark.createDataFrame([(k, round(v, 8)) for k, v in series.self_loop_coefficients(_events(spark, sf)).items()], "variable string, slope double")


@query(_EVENTS + ", l as (select _row, x, lag(x) over (order by _row) y from e), f as (select regr_slope(x, y) b, regr_intercept(x, y) a from l) select _row - 1 as _row, round(x - a - b * y, 7) as x from l, f where y is not null")
def ar_residuals(spark, sf):
    return series.residuals(_events(spark, sf).select("_row", "x"), 1).withColumn("x", F.round("x", 7))


@query()
def var_stability(spark, sf):
    m = series.fit_var(_events(spark, sf), 2)
    return spark.createDataFrame([(t, float(v), series.is_stable(_events(spark, sf), 2)) for t, v in zip(m.targets, m.residual_variance)], "target string, residual_variance double, stable boolean")


@query("select event_type as child, lag(event_type) over (order by ts, event_id) as parent from events".join(["with l as (", ") select child, parent, count(*) as count from l where parent is not null group by 1, 2"]))
def lagged_crosstab(spark, sf):
    e = table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type")
    return series.lagged_crosstab(ordering.with_row_number(e, "t", ["event_id"]), "event_type", "event_type", 1)


@query("select p_partkey, round((p_retailprice - avg(p_retailprice) over ()) / stddev_samp(p_retailprice) over (), 8) as z, round(p_size - avg(p_size) over (), 8) as c from part")
def standardized(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("z"), F.col("p_size").alias("c"))
    out = series.center(series.standardize(p, ["z"]), ["c"])
    return out.select("p_partkey", F.round("z", 8).alias("z"), F.round("c", 8).alias("c"))


@query()
def nonparanormal(spark, sf):
    return series.nonparanormal(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query(_EVENTS + " select _row, round(avg(x) over (order by _row rows between 4 preceding and current row), 8) as moving_mean from e")
def moving_mean(spark, sf):
    return series.moving_window(_events(spark, sf).select("_row", "x"), "x", 5).select("_row", F.round("moving_mean", 8).alias("moving_mean"))


def _spending(spark, sf):
    """Customers with the mean price and first month of their urgent open orders, missing for those without."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"), F.min(F.substring(F.col("o_orderdate").cast("string"), 1, 7)).alias("priority"))
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")


_SPENDING = "with o as (select o_custkey, avg(o_totalprice) price, min(left(o_orderdate::varchar, 7)) priority from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT' group by 1), s as (select c_custkey, c_acctbal, price, priority from customer left join o on o_custkey = c_custkey)"


@query(_SPENDING + " select c_custkey, round(coalesce(price, (select avg(price) from s)), 6) as price from s")
def impute_mean(spark, sf):
    return preparation.impute_mean(_spending(spark, sf), ["price"]).select("c_custkey", F.round("price", 6).alias("price"))


@query(_SPENDING + ", m as (select priority p, count(*) n from s where priority is not null group by 1 order by 2 desc, 1 limit 1) select c_custkey, round(coalesce(price, (select median(price) from s)), 6) as price, coalesce(priority, (select p from m)) as priority from s")
def impute_mode(spark, sf):
    return preparation.impute_mode(_spending(spark, sf), ["price", "priority"]).select("c_custkey", F.round("price", 6).alias("price"), "priority")


@query(_SPENDING + ', f as (select regr_slope(price, c_acctbal) b, regr_intercept(price, c_acctbal) a from s) select c_custkey, round(coalesce(price, a + b * c_acctbal), 3) as price from s, f')
def impute_regression(spark, sf):
    return preparation.impute_regression(_spending(spark, sf), ["price", "c_acctbal"]).select("c_custkey", F.round("price", 3).alias("price"))


@query(_SPENDING + " select c_custkey, coalesce(priority, 'Missing') as \"priority+\" from s")
def impute_category(spark, sf):
    return preparation.impute_category(_spending(spark, sf), "priority").select("c_custkey", "priority+")


@query()
def impute_random(spark, sf):
    return preparation.impute_random(_spending(spark, sf), ["price", "priority"], 7, "c_custkey")


@query(_SPENDING + " select c_custkey, priority from s where price is not null and priority is not null")
def complete_cases(spark, sf):
    return tables.complete_cases(_spending(spark, sf)).select("c_custkey", "priority")


@query(_SPENDING + " select 'price' as most_missing, count(*) > count(price) as has_missing from s")
def missing_report(spark, sf):
    s = _spending(spark, sf).select("c_custkey", "price")
    return spark.createDataFrame([(tables.column_with_most_missing(s), tables.has_missing(s))], "most_missing string, has_missing boolean")


@query("select p_partkey, p_size from part")
def drop_constant_columns(spark, sf):
    return tables.drop_constant_columns(table(spark, sf, "part").select("p_partkey", "p_size", F.lit(1).alias("one")))


def _nations(spark, sf):
    return ordering.with_row_number(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("select t.i::bigint as _row, n_nationkey, n_name, n_regionkey from (select unnest([0, 1, 2, 3]) as i, unnest([5, 2, 5, 0]) as r) t join (select *, row_number() over (order by n_nationkey) - 1 as k from nation) on k = r")
def subset_rows(spark, sf):
    return tables.subset_rows(_nations(spark, sf), [5, 2, 5, 0]).select("_row", "n_nationkey", "n_name", "n_regionkey")


@query("select k as _row, n_nationkey from (select *, row_number() over (order by n_nationkey) - 1 as k from nation) where k not in (1, 3)")
def remove_rows(spark, sf):
    return tables.remove_rows(_nations(spark, sf), [1, 3]).select("_row", "n_nationkey")


@query("select n_name, n_regionkey from nation")
def subset_columns(spark, sf):
    return tables.subset_columns(table(spark, sf, "nation"), ["n_name", 2])


@query("select a.k as _row, a.n_name, b.n_regionkey + 100 as shifted from (select *, row_number() over (order by n_nationkey) - 1 as k from nation) a join (select *, row_number() over (order by n_nationkey) - 1 as k from nation) b on a.k = b.k")
def bind_columns(spark, sf):
    n = _nations(spark, sf)
    return tables.bind_columns([n.select("_row", "n_name"), n.select("_row", (F.col("n_regionkey") + 100).alias("shifted"))])


@query("select n_name as name, n_regionkey as k from nation union all select r_name, r_regionkey from region")
def concatenate(spark, sf):
    return tables.concatenate([table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@query("with n as (select *, row_number() over (order by n_nationkey) - 1 as k from nation), g as (select unnest(range(0, 27)) as _row) select _row, case when _row < 3 then n.n_regionkey when _row < 5 then null else m.n_regionkey end as n_regionkey, n.n_name from g left join n on n.k = _row left join n m on m.k = _row - 2")
def shift_column_down(spark, sf):
    return tables.shift_column_down(_nations(spark, sf), 3, "n_regionkey", 2).select("_row", "n_regionkey", "n_name")


@query("select p_partkey from part where p_size > 10 and p_size < 20 and p_brand in ('Brand#11', 'Brand#12', 'Brand#13')")
def conditioning(spark, sf):
    return tables.allowed(tables.between(table(spark, sf, "part"), "p_size", 10, 20), {"p_brand": ["Brand#11", "Brand#12", "Brand#13"]}).select("p_partkey")


@query("select l_orderkey, l_linenumber, 'N' as l_linestatus from lineitem where l_returnflag = 'R'")
def manipulation(spark, sf):
    return tables.manipulate(table(spark, sf, "lineitem"), {"l_returnflag": "R"}, {"l_linestatus": "N"}).select("l_orderkey", "l_linenumber", "l_linestatus")


@query("select n_nationkey from nation, (select unnest(range(0, 5)) as k) where k < n_regionkey")
def expand_cases(spark, sf):
    return tables.expand_cases(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey")


@query("select k as _row, cast((k >= 5)::int + (k >= 12)::int as int) as part from (select row_number() over (order by n_nationkey) - 1 as k from nation)")
def split_cases(spark, sf):
    return tables.split_cases(_nations(spark, sf), [5, 12]).select("_row", "part")


@query("select [a.r_name, b.r_name, c.r_name] as combination from region a join region b on a.r_name < b.r_name join region c on b.r_name < c.r_name".replace("[a.r_name, b.r_name, c.r_name]", "a.r_name || ',' || b.r_name || ',' || c.r_name"))
def combinations(spark, sf):
    return tables.combinations_of(table(spark, sf, "region"), "r_name", 3).select(F.array_join("combination", ",").alias("combination"))


@query("select a.r_regionkey || ',' || b.r_regionkey || ',' || c.r_regionkey as permutation from region a join region b on a.r_regionkey <> b.r_regionkey join region c on c.r_regionkey <> a.r_regionkey and c.r_regionkey <> b.r_regionkey")
def permutations(spark, sf):
    return tables.permutations_of(table(spark, sf, "region"), "r_regionkey", 3).select(F.array_join(F.col("permutation").cast("array<string>"), ",").alias("permutation"))


@query("select true as ordered, a.r_regionkey || ',' || b.r_regionkey as selection from region a, region b union all select false, a.r_regionkey || ',' || b.r_regionkey || ',' || c.r_regionkey from region a join region b on a.r_regionkey <= b.r_regionkey join region c on b.r_regionkey <= c.r_regionkey")
def selections(spark, sf):
    shown = F.array_join(F.col("selection").cast("array<string>"), ",").alias("selection")
    r = table(spark, sf, "region")
    return tables.selections_of(r, "r_regionkey", 2).select(F.lit(True).alias("ordered"), shown).union(tables.selections_of(r, "r_regionkey", 3, ordered=False).select(F.lit(False), shown))


@query("select sum(k) over () * 0 + 1 as n, k from (select unnest(range(0, 32)) as k)".replace("sum(k) over () * 0 + 1 as n, k", "cast(bit_count(k) as int) as size, count(*) as n").replace(")", ")", 1) + " group by 1")
def power_set(spark, sf):
    return tables.power_set(table(spark, sf, "region"), "r_regionkey").groupBy(F.size("subset").alias("size")).agg(F.count("*").alias("n"))


@query("select a.d0, b.d1, c.d2 from (select unnest(range(0, 2)) as d0) a, (select unnest(range(0, 3)) as d1) b, (select unnest(range(0, 4)) as d2) c")
def product_grid(spark, sf):
    return tables.grid(spark, [2, 3, 4])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf):
    return tables.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25)


@query("select c_custkey, c_acctbal, cast(list_position(list_sort((select list(distinct c_mktsegment) from customer)), c_mktsegment) - 1 as int) as c_mktsegment from customer")
def index_categories(spark, sf):
    return tables.index_categories(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_mktsegment"])[0]


@query("select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 4) as running from orders")
def cumulative_within(spark, sf):
    return series.cumulative_within(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round("running", 4).alias("running"))


@query("select (k // 100)::int as replicate, count(*) as n from (select unnest(range(0, 300)) as k) group by 1")
def bootstrap_sizes(spark, sf):
    return preparation.bootstrap(_nations(spark, sf), 100, 11, 3).groupBy("replicate").agg(F.count("*").alias("n"))


@query()
def bootstrap_rows(spark, sf):
    return preparation.bootstrap(_events(spark, sf), 500, 3, 2)


@query("with n as (select count(*) n from events) select k::int as fold, n // 7 + (k < n % 7)::int as n from n, (select unnest(range(0, 7)) as k)")
def fold_sizes(spark, sf):
    return preparation.folds(_events(spark, sf), 7, 5).groupBy("fold").agg(F.count("*").alias("n"))


@query()
def subsample_rows(spark, sf):
    return preparation.subsample(_events(spark, sf), 100, 9, 2)


@query()
def permuted_rows(spark, sf):
    return tables.permute_rows(_nations(spark, sf), 4)


@query("select a.n_nationkey as kept, b.n_nationkey as fold from nation a join nation b on a.n_nationkey <> b.n_nationkey")
def leave_one_out(spark, sf):
    return preparation.leave_one_out(_nations(spark, sf)).select(F.col("n_nationkey").cast("int").alias("kept"), F.col("fold").cast("int").alias("fold"))
