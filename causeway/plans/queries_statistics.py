"""Queries of statistics, counts, ranks, regression and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import statistics as st
from causeway.functions.distributions import FUNCTIONS, column
from causeway.functions.expressions import transform
from causeway.operators import independence, moments, ordering, preparation, regression, scores
from causeway.plans.catalog import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]


@query("\nunion all ".join(f"select '{a}' as var_i, '{b}' as var_j, round(covar_samp({a}, {b}), 6) as value from lineitem" for a, b in _PAIRS))
def covariance_lineitem(spark, sf):
    return moments.covariance_frame(table(spark, sf, "lineitem"), NUMBERS).withColumn("value", F.round("value", 6))


@query("\nunion all ".join(f"select '{a}' as var_i, '{b}' as var_j, round(corr({a}, {b}), 8) as value from lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, sf):
    cov = moments.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS)
    return spark.createDataFrame([(a, b, round(float(cov.matrix[cov.index(a), cov.index(b)]), 8)) for a, b in _PAIRS], "var_i string, var_j string, value double")


@query("""
with c as (select * from lineitem), m as (select l_returnflag f, avg(l_extendedprice) m, count(*) n from c group by 1),
s as (select l_returnflag f, n, sum(pow(l_extendedprice - m, 2)) s2, sum(pow(l_extendedprice - m, 3)) s3, sum(pow(l_extendedprice - m, 4)) s4 from c join m on f = l_returnflag group by 1, 2)
select l_returnflag, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(median(l_extendedprice), 4) as median, min(l_extendedprice) as minimum, max(l_extendedprice) as maximum,
round(max(l_extendedprice) - min(l_extendedprice), 4) as range, round(var_samp(l_extendedprice) / 1e6, 6) as variance_millions, round(stddev_samp(l_extendedprice), 4) as sd, round(any_value(s2) / 1e9, 4) as ssx_billions,
round(any_value((s3 / (s.n - 1)) / pow(s2 / s.n, 1.5)), 6) as skewness, round(any_value((s4 / s.n) / pow(s2 / (s.n - 1), 2) - 3), 6) as kurtosis
from lineitem join s on f = l_returnflag group by l_returnflag""")
def moments_by_flag(spark, sf):
    x = "l_extendedprice"
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            st.count(x).alias("n"), F.round(st.mean(x), 4).alias("mean"), F.round(st.median(x), 4).alias("median"), st.minimum(x).alias("minimum"), st.maximum(x).alias("maximum"), F.round(st.value_range(x), 4).alias("range"),
            F.round(st.variance(x) / 1e6, 6).alias("variance_millions"), F.round(st.sd(x), 4).alias("sd"), F.round(st.ssx(x) / 1e9, 4).alias("ssx_billions"), F.round(st.skewness(x), 6).alias("skewness"), F.round(st.kurtosis(x), 6).alias("kurtosis"),
        )
    )


@query("select l_linestatus, round(covar_pop(l_quantity, l_extendedprice) * count(*) / 1e6, 6) as sxy_millions, round(covar_samp(l_quantity, l_extendedprice), 4) as covariance, round(corr(l_quantity, l_extendedprice), 8) as correlation, cast(trunc(corr(l_quantity, l_extendedprice) * 10000) as smallint) as compressed from lineitem group by 1")
def pair_statistics(spark, sf):
    x, y = "l_quantity", "l_extendedprice"
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(st.sxy(x, y) / 1e6, 6).alias("sxy_millions"), F.round(st.covariance(x, y), 4).alias("covariance"), F.round(st.correlation(x, y), 8).alias("correlation"), st.compressed_correlation(x, y).alias("compressed"))


@query("""
with m as (select l_returnflag f, avg(l_quantity) m, stddev_samp(l_quantity) s from lineitem group by 1)
select l_returnflag, round(avg(abs(l_quantity - m)), 6) as average_deviation, round(avg(pow((l_quantity - m) / s, 5)), 6) as fifth_moment, round(avg(pow((l_quantity - m) / s, 6)), 6) as sixth_moment,
round(pow(avg(ln((exp((l_quantity - m) / s) + exp(-(l_quantity - m) / s)) / 2)) - 0.3746764078432371, 2), 9) as log_cosh_score, round(pow(avg(abs((l_quantity - m) / s)) - sqrt(2 / pi()), 2), 9) as mean_absolute_score, round(ln(avg(exp((l_quantity - m) / s))), 8) as exp_score
from lineitem join m on f = l_returnflag group by 1""")
def two_pass_statistics(spark, sf):
    out = st.two_pass(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    digits = {"average_deviation": 6, "fifth_moment": 6, "sixth_moment": 6, "log_cosh_score": 9, "mean_absolute_score": 9, "exp_score": 8}
    return out.select("l_returnflag", *[F.round(c, d).alias(c) for c, d in digits.items()])


_QUARTILE = "(select count(*) as n from orders), r as (select o_totalprice x, row_number() over (order by o_totalprice) - 1 as k from orders)"


@query(f"with c as {_QUARTILE}, q as (select unnest([1, 2, 3]) as q), p as (select q, q / 4.0 * (n + 1) - 1 as p from q, c) select cast(q as integer) as q, round(a.x + (p - floor(p)) * (b.x - a.x), 4) as value from p join r a on a.k = floor(p) join r b on b.k = ceil(p)")
def quartiles(spark, sf):
    orders = table(spark, sf, "orders")
    return spark.createDataFrame([(q, round(st.quartile(orders, "o_totalprice", q), 4)) for q in (1, 2, 3)], "q int, value double")


@query("""
with e as (select min(l_extendedprice) a, max(l_extendedprice) b, cast(ceil(log2(count(*)) + 1) as int) k from lineitem),
n as (select least(k - 1, cast(floor((l_extendedprice - a) / ((b - a) / k)) as int)) as bin, count(*) as n from lineitem, e group by 1), g as (select unnest(range(0, k)) as bin, a, b, k from e)
select cast(g.bin as int) as bin, round(a + g.bin * ((b - a) / k), 4) as low, round(a + (g.bin + 1) * ((b - a) / k), 4) as high, cast(coalesce(n, 0) as bigint) as n from g left join n on n.bin = g.bin""")
def histogram_sturges(spark, sf):
    return moments.histogram(table(spark, sf, "lineitem"), "l_extendedprice").select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.col("n").cast("long").alias("n"))


@query("with c as (select event_type, count(*) n from events group by 1), t as (select sum(n) t from c) select round(-sum(n / t * log2(n / t)), 8) as entropy from c, t")
def entropy_events(spark, sf):
    return spark.createDataFrame([(round(moments.entropy(table(spark, sf, "events"), ["event_type"]), 8),)], "entropy double")


@query("""
with j as (select o_orderstatus a, o_orderpriority b, count(*) n from orders group by 1, 2), t as (select sum(n) t from j),
x as (select a, sum(n) n from j group by 1), y as (select b, sum(n) n from j group by 1)
select round((select -sum(n / t * log2(n / t)) from x, t) + (select -sum(n / t * log2(n / t)) from y, t) - (select -sum(n / t * log2(n / t)) from j, t), 8) as mutual_information""")
def mutual_information(spark, sf):
    return spark.createDataFrame([(round(moments.mutual_information(table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"]), 8),)], "mutual_information double")


@query("with e as (select min(l_quantity) a, max(l_quantity) b from lineitem), n as (select cast(trunc((l_quantity - a) / (b - a) * 9) as int) c, count(*) n from lineitem, e group by 1) select round(-sum(n / 9.0 * ln(n / 9.0)) / 1e3, 6) as entropy_thousands from n")
def histogram_entropy(spark, sf):
    return spark.createDataFrame([(round(st.histogram_entropy(table(spark, sf, "lineitem"), "l_quantity", 10) / 1e3, 6),)], "entropy_thousands double")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def contingency_orders(spark, sf):
    return moments.contingency(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as bigint) as subset from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return moments.cube_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("select o_orderstatus, sum(n) as n from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2) group by 1".replace("sum(n)", "cast(sum(n) as bigint)"))
def marginal_orders(spark, sf):
    return moments.marginal(moments.contingency(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), ["o_orderstatus"])


@query("with c as (select o_orderstatus, o_orderpriority, count(*) n from orders group by 1, 2), k as (select count(distinct o_orderpriority) k from orders) select o_orderstatus, o_orderpriority, n, round((n + 1) / (sum(n) over (partition by o_orderstatus) + k), 8) as p from c, k")
def conditional_probabilities(spark, sf):
    return moments.conditional_probabilities(table(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"], prior=1.0).withColumn("p", F.round("p", 8))


_CHI = """
with c as (select l_returnflag a, l_linestatus b, l_linenumber z, count(*) n from lineitem group by 1, 2, 3),
r as (select z, a, sum(n) n from c group by 1, 2), s as (select z, b, sum(n) n from c group by 1, 2), t as (select z, sum(n) n from c group by 1),
g as (select r.z, r.a, s.b, r.n * s.n / t.n as e, coalesce(c.n, 0) as o from r join s on r.z = s.z join t on t.z = r.z left join c on c.z = r.z and c.a = r.a and c.b = s.b),
d as (select z, (count(distinct a) - 1) * (count(distinct b) - 1) as d from g group by 1)
"""


@query(_CHI + "select round((select sum((o - e) * (o - e) / e) from g), 4) as chi_square, cast((select sum(d) from d) as bigint) as df")
def chi_square(spark, sf):
    test = independence.ChiSquare.of(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    chi, df = test.statistic("l_returnflag", "l_linestatus", ["l_linenumber"])
    return spark.createDataFrame([(round(float(chi), 4), df)], "chi_square double, df long")


@query(_CHI + "select round((select sum(case when o > 0 then 2 * o * ln(o / e) else 0 end) from g), 4) as g_square, cast((select sum(d) from d) as bigint) as df")
def g_square(spark, sf):
    test = independence.ChiSquare.of(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], g_square=True)
    g, df = test.statistic("l_returnflag", "l_linestatus", ["l_linenumber"])
    return spark.createDataFrame([(round(float(g), 4), df)], "g_square double, df long")


@query("select p_partkey, (rank() over (order by p_size) + rank() over (order by p_size) + count(*) over (partition by p_size) - 1) / 2.0 as rank from part".replace("2.0", "2.0::double"))
def average_ranks(spark, sf):
    return ordering.average_ranks(table(spark, sf, "part"), "p_size").select("p_partkey", "rank")


@query("select c_custkey, cast(count(*) over (order by c_acctbal range between unbounded preceding and current row) as double) as rank from customer")
def ecdf_ranks(spark, sf):
    return ordering.ecdf_ranks(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "rank")


@query("with r as (select (2 * rank() over (order by p_size) + count(*) over (partition by p_size) - 1) / 2.0 a, (2 * rank() over (order by p_retailprice) + count(*) over (partition by p_retailprice) - 1) / 2.0 b from part) select round(corr(a, b), 8) as rho from r")
def rank_correlation(spark, sf):
    return spark.createDataFrame([(round(st.rank_correlation(table(spark, sf, "part"), "p_size", "p_retailprice"), 8),)], "rho double")


@query("with s as (select s_suppkey k, s_acctbal x, s_nationkey y from supplier), n as (select count(*) n from s) select round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / any_value(n * (n - 1) / 2), 8) as tau from s a join s b on a.k < b.k, n")
def kendalls_tau(spark, sf):
    return spark.createDataFrame([(round(float(st.kendalls_tau(table(spark, sf, "supplier"), "s_acctbal", "s_nationkey")), 8),)], "tau double")


@query("select distinct p_size as x, round(cume_dist() over (order by p_size), 8) as p from part".replace("p_size as x", "cast(p_size as double) as x"))
def empirical_cdf(spark, sf):
    return st.empirical_cdf(table(spark, sf, "part"), "p_size").withColumn("p", F.round("p", 8))


_P = "select cast(p_partkey as double) * 7919 % 1009 / 1009 as p from part"


@query(f"with p as ({_P}), c as (select p, count(*) n from p group by 1), k as (select p, cast(sum(n) over (order by p) as bigint) k from c), m as (select count(*) m from p) select round(p, 10) as p, k, p <= k / (m + 1)::double * 0.4 as ok from k, m")
def fdr(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey").cast("double") * 7919 % 1009 / 1009).alias("p"))
    return st.fdr(p, 0.4).select(F.round("p", 10).alias("p"), "k", "ok")


_ROC = "with d as (select cast(n_chars as double) score, quality y from documents join labels using (doc_id)), g as (select score, sum(y) pos, sum(1 - y) neg from d group by 1)"


@query(_ROC + " select score, cast(sum(pos) over (order by score desc) as bigint) as tp, cast(sum(neg) over (order by score desc) as bigint) as fp from g")
def roc_points(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return st.roc(d, "n_chars", "quality").select("score", "tp", "fp")


@query(_ROC + ", r as (select pos, neg, sum(pos) over (order by score desc) tp from g) select round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 8) as auc from r")
def roc_auc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return spark.createDataFrame([(round(float(st.auc(d, "n_chars", "quality")), 8),)], "auc double")


@query("with m as (select max(s_acctbal / 1000) m from supplier) select round(any_value(m) + ln(sum(exp(s_acctbal / 1000 - m))), 8) as log_sum from supplier, m")
def log_sum(spark, sf):
    return st.log_sum(table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000).alias("x")), "x").select(F.round("log_sum", 8).alias("log_sum"))


#: Hart's rational approximation of the upper normal tail, highest power first.
_HART_ABOVE = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_HART_BELOW = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _upper_tail(z: str) -> str:
    """SQL of the normal probability beyond a number that isn't negative."""

    def polynomial(powers: list[float]) -> str:
        out = repr(powers[0])
        for p in powers[1:]:
            out = f"({out} * ({z}) + {p!r})"
        return out

    far = f"(({z}) + 1 / (({z}) + 2 / (({z}) + 3 / (({z}) + 4 / (({z}) + 0.65)))))"
    return f"(case when ({z}) < 7.07106781186547 then exp(-({z}) * ({z}) / 2) * {polynomial(_HART_ABOVE)} / {polynomial(_HART_BELOW)} else exp(-({z}) * ({z}) / 2) / ({far} * 2.506628274631) end)"


@query(f"""
with m as (select avg(o_totalprice) m, stddev_samp(o_totalprice) s, count(*)::double n from orders),
z as (select (o_totalprice - m) / s as z, n, row_number() over (order by o_totalprice) as i from orders, m),
t as (select z, n, i, {_upper_tail("abs(z)")} as u from z), p as (select n, i, case when z < 0 then u else 1 - u end as p from t),
a as (select n, sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) as s from p group by n), q as (select -n - s / n as a, (-n - s / n) * (1 + 0.75 / n + 2.25 / (n * n)) as b from a)
select round(a, 6) as a_squared, round(b, 6) as a_squared_star, round(case when b < 0.2 then 1 - exp(-13.436 + 101.14 * b - 223.73 * b * b) when b < 0.34 then 1 - exp(-8.318 + 42.796 * b - 59.938 * b * b) when b < 0.6 then exp(0.9177 - 4.279 * b - 1.38 * b * b) else exp(1.2937 - 5.709 * b + 0.0186 * b * b) end, 9) as p from q""")
def anderson_darling(spark, sf):
    return spark.createDataFrame([tuple(round(float(x), d) for x, d in zip(st.anderson_darling(table(spark, sf, "orders"), "o_totalprice"), (6, 6, 9)))], "a_squared double, a_squared_star double, p double")


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 8) as r_squared from lineitem")
def ols_one(spark, sf):
    f = regression.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(f.coefficients[1]), 6), round(float(f.coefficients[0]), 4), round(f.r_squared, 8))], "slope double, intercept double, r_squared double")


@query("""
with s as (select var_pop(l_quantity) a, var_pop(l_discount) b, covar_pop(l_quantity, l_discount) ab, covar_pop(l_quantity, l_extendedprice) ay, covar_pop(l_discount, l_extendedprice) yb, avg(l_extendedprice) y, avg(l_quantity) q, avg(l_discount) d from lineitem),
b as (select (b * ay - ab * yb) / (a * b - ab * ab) b1, (a * yb - ab * ay) / (a * b - ab * ab) b2, y, q, d from s)
select round(y - b1 * q - b2 * d, 3) as intercept, round(b1, 5) as b_quantity, round(b2, 3) as b_discount from b""")
def ols_two(spark, sf):
    f = regression.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(float(f.coefficients[0]), 3), round(float(f.coefficients[1]), 5), round(float(f.coefficients[2]), 3))], "intercept double, b_quantity double, b_discount double")


def _logistic_sql(steps: int = 6) -> str:
    """SQL of Newton's method for two regressors: each step adds up gradient and Hessian, and solves three equations by minors."""
    out = ["with v as (select l_quantity / 10 as q, l_discount * 10 as d, (l_linestatus = (select max(l_linestatus) from lineitem))::int as y from lineitem), b0 as (select 0.0::double as c0, 0.0::double as c1, 0.0::double as c2)"]
    minors = "h11 * h22 - h12 * h12 as m00, h02 * h12 - h01 * h22 as m01, h01 * h12 - h02 * h11 as m02, h00 * h22 - h02 * h02 as m11, h01 * h02 - h00 * h12 as m12, h00 * h11 - h01 * h01 as m22"
    for k in range(steps):
        out.append(f"e{k} as (select q, d, y, c0, c1, c2, 1 / (1 + exp(-(c0 + c1 * q + c2 * d))) as p from v, b{k})")
        sums = ", ".join(f"sum(p * (1 - p) * {x} * {z}) as h{i}{j}" for i, x in enumerate(("1", "q", "d")) for j, z in enumerate(("1", "q", "d")) if i <= j)
        out.append(f"h{k} as (select any_value(c0) c0, any_value(c1) c1, any_value(c2) c2, sum(y - p) g0, sum((y - p) * q) g1, sum((y - p) * d) g2, {sums} from e{k})")
        out.append(f"i{k} as (select *, {minors}, h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11) as det from h{k})")
        out.append(f"b{k + 1} as (select c0 + (m00 * g0 + m01 * g1 + m02 * g2) / det as c0, c1 + (m01 * g0 + m11 * g1 + m12 * g2) / det as c1, c2 + (m02 * g0 + m12 * g1 + m22 * g2) / det as c2, sqrt(m00 / det) s0, sqrt(m11 / det) s1, sqrt(m22 / det) s2 from i{k})")
    out.append(f"f as (select 'const' as term, c0 as b, s0 as e from b{steps} union all select 'l_quantity', c1 / 10, s1 / 10 from b{steps} union all select 'l_discount', c2 * 10, s2 * 10 from b{steps})")
    return ", ".join(out) + f" select (select max(l_linestatus) from lineitem) as class, term, round(b, 7) as coefficient, round(e, 7) as error, round(2 * {_upper_tail('abs(b / e)')}, 6) as p from f"


@query(_logistic_sql())
def logistic_status(spark, sf):
    f = regression.logistic(table(spark, sf, "lineitem"), "l_linestatus", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(str(c), n, round(float(b), 7), round(float(e), 7), round(float(p), 6)) for c, row in zip(f.classes[1:], zip(f.coefficients, f.errors, f.p)) for n, b, e, p in zip(f.names, *row)], "class string, term string, coefficient double, error double, p double")


@query("select l_returnflag as category, count(*) as rows, round(sum(l_quantity), 3)::double as quantity from lineitem group by l_returnflag")
def multinomial_moments(spark, sf):
    """Numbers and quantities that the fitted multinomial model expects of each flag: at a maximum those of the table."""
    df = table(spark, sf, "lineitem")
    f = regression.logistic(df, "l_returnflag", ["l_quantity"])
    logits = [F.lit(0.0), *[F.lit(float(row[0])) + F.lit(float(row[1])) * F.col("l_quantity") for row in f.coefficients]]
    total = sum((F.exp(x) for x in logits[1:]), F.exp(logits[0]))
    sums = [s for k, x in enumerate(logits) for s in (F.sum(F.exp(x) / total).alias(f"n{k}"), F.sum(F.exp(x) / total * F.col("l_quantity")).alias(f"q{k}"))]
    row = df.agg(*sums).first()
    return spark.createDataFrame([(str(c), round(row[f"n{k}"]), round(row[f"q{k}"], 3)) for k, c in enumerate(f.classes)], "category string, rows long, quantity double")


@query()
def multinomial_flag(spark, sf):
    f = regression.logistic(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity"])
    return spark.createDataFrame([(str(c), n, float(b)) for c, row in zip(f.classes[1:], f.coefficients) for n, b in zip(f.names, row)], "class string, term string, coefficient double")


@query()
def cox_orders(spark, sf):
    """Days to the first shipment as survival times, F orders as events."""
    o = table(spark, sf, "orders")
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"), F.sum("l_quantity").alias("quantity"))
    d = o.join(ship, "o_orderkey").select(F.abs(F.datediff("s", "o_orderdate")).cast("double").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"), "quantity", (F.col("o_totalprice") / 1e5).alias("price"))
    f = regression.cox(d, "t", "e", ["quantity", "price"])
    return spark.createDataFrame([(n, float(b), float(e), float(p)) for n, b, e, p in zip(f.names, f.coefficients, f.errors, f.p)], "term string, coefficient double, error double, p double")


_FZ = " union all ".join(f"select '{a}' as x, '{b}' as y, corr({a}, {b}) as r from lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])


@query(f"with r as ({_FZ}), n as (select count(*) n from lineitem) select x, y, round(r, 8) as r, round(sqrt(n - 3) * atanh(r), 5) as z from r, n")
def fisher_z_pairs(spark, sf):
    return independence.fisher_z_frame(table(spark, sf, "lineitem"), NUMBERS).select("x", "y", F.round("r", 8).alias("r"), F.round("z", 5).alias("z"))


@query(f"with r as ({_FZ}), n as (select count(*) n from lineitem), z as (select x, y, abs(sqrt(n - 3) * atanh(r)) as z from r, n) select x, y, round(2 * {_upper_tail('z')}, 9) as p from z")
def fisher_z_p_values(spark, sf):
    test = independence.FisherZ(moments.covariance_matrix(table(spark, sf, "lineitem"), NUMBERS))
    return spark.createDataFrame([(a, b, round(float(test.p_value(a, b, [])), 9)) for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1 :]], "x string, y string, p double")


_BIC = " union all ".join([f"select '{a}' as child, '' as parent, var_samp({a}) as s2, 1 as k from lineitem" for a in NUMBERS] + [f"select '{a}', '{b}', var_samp({a}) - pow(covar_samp({a}, {b}), 2) / var_samp({b}), 3 from lineitem" for a in NUMBERS for b in NUMBERS if a != b])


@query(f"with s as ({_BIC}), n as (select count(*)::double n from lineitem) select child, parent, round(-n * ln(s2 * n / (n - k)) - 2 * k * ln(n), 3) as score from s, n")
def sem_bic_pairs(spark, sf):
    cov = moments.covariance_matrix(table(spark, sf, "lineitem"), NUMBERS)
    s = scores.SemBic(cov)
    rows = [(a, "", round(s.local(i, []), 3)) for i, a in enumerate(NUMBERS)] + [(a, b, round(s.local(i, [j]), 3)) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i != j]
    return spark.createDataFrame(rows, "child string, parent string, score double")


@query("""
with c as (select o_orderpriority p, o_orderstatus s, count(*) n from orders group by 1, 2), k as (select count(distinct o_orderstatus) c, count(distinct o_orderpriority) r from orders), t as (select p, sum(n) n from c group by 1)
select round((select sum(lgamma(1.0 / r) - lgamma(1.0 / r + n)) from t, k) + (select sum(lgamma(1.0 / (r * c) + n) - lgamma(1.0 / (r * c))) from c, k), 4) as score""")
def bdeu_orders(spark, sf):
    chi = independence.ChiSquare.of(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return spark.createDataFrame([(round(scores.BDeu(chi, structure_prior=0).local(0, [1]), 4),)], "score double")


@query("""
with c as (select o_orderpriority p, o_orderstatus s, count(*) n from orders group by 1, 2), t as (select p, sum(n) n from c group by 1), k as (select count(distinct o_orderstatus) c, count(distinct o_orderpriority) r, count(*)::double n from orders)
select round(2 * (select sum(c.n * ln(c.n / t.n)) from c join t on t.p = c.p) - (select r * (c - 1) * ln(n) from k), 4) as score""")
def discrete_bic_orders(spark, sf):
    chi = independence.ChiSquare.of(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return spark.createDataFrame([(round(scores.DiscreteBic(chi).local(0, [1]), 4),)], "score double")


_GAUSS = "-n / 2 * (ln({det}) + {k} * ln(2 * pi()) + {k})"
_DET2 = "var_pop(l_quantity) * var_pop(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) ** 2"


@query(f"""
with t as (select count(*)::double as t from lineitem), g as (select l_returnflag, count(*)::double as n, var_pop(l_quantity) as v, {_DET2} as w from lineitem group by 1),
a as (select count(*)::double as n, var_pop(l_quantity) as vq, var_pop(l_extendedprice) as vp, {_DET2} as w from lineitem),
l as (select (select {_GAUSS.format(det="vq", k=1)} from a) as q, (select {_GAUSS.format(det="vp", k=1)} from a) as p, (select {_GAUSS.format(det="w", k=2)} from a) as qp, (select sum(n * ln(n / t)) from g, t) as r,
  (select sum(n * ln(n / t) + {_GAUSS.format(det="v", k=1)}) from g, t) as qr, (select sum(n * ln(n / t) + {_GAUSS.format(det="w", k=2)}) from g, t) as qpr, (select count(*) from g) as c, (select ln(t) from t) as ln),
s as (select 'l_quantity' as child, '' as parents, 2 * q - 2 * ln as s from l union all select 'l_quantity', 'l_extendedprice', 2 * (qp - p) - 3 * ln from l union all select 'l_quantity', 'l_returnflag', 2 * (qr - r) - 2 * c * ln from l
  union all select 'l_extendedprice', 'l_quantity,l_returnflag', 2 * (qpr - qr) - 3 * c * ln from l union all select 'l_returnflag', 'l_quantity', 2 * (qr - q) - (3 * c - 3) * ln from l)
select child, parents, round(s, 3) as score from s""")
def conditional_gaussian_scores(spark, sf):
    s = scores.ConditionalGaussian(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"])
    return spark.createDataFrame([(s.names[i], ",".join(s.names[j] for j in p), round(float(s.local(i, p)), 3)) for i, p in ((0, []), (0, [1]), (0, [2]), (1, [0, 2]), (2, [0]))], "child string, parents string, score double")


def _mixed_bic_sql(steps: int = 6) -> str:
    """SQL of linear BICs, and of logistic ones by Newton's method with one regressor."""
    out = ["with v as (select l_quantity / 10 as q, (l_linestatus = (select max(l_linestatus) from lineitem))::int as y from lineitem), b0 as (select 0.0::double as c0, 0.0::double as c1)"]
    for k in range(steps):
        out.append(f"h{k} as (select any_value(c0) c0, any_value(c1) c1, sum(y - p) g0, sum((y - p) * q) g1, sum(p * (1 - p)) h00, sum(p * (1 - p) * q) h01, sum(p * (1 - p) * q * q) h11 from (select q, y, c0, c1, 1 / (1 + exp(-(c0 + c1 * q))) as p from v, b{k}))")
        out.append(f"b{k + 1} as (select c0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as c0, c1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as c1 from h{k})")
    out.append(f"fit as (select sum(ln(1 / (1 + exp(-(2 * y - 1) * (c0 + c1 * q))))) as ll from v, b{steps}), none as (select sum(n * ln(n / t)) as ll from (select count(*)::double as n, sum(count(*)) over () as t from v group by y))")
    out.append("n as (select count(*)::double as n, var_samp(l_quantity) as v, var_samp(l_quantity) - covar_samp(l_quantity, l_extendedprice) ** 2 / var_samp(l_extendedprice) as r from lineitem)")
    rows = [("l_quantity", "", "-n * ln(v * n / (n - 1)) - 4 * ln(n)", "n"), ("l_quantity", "l_extendedprice", "-n * ln(r * n / (n - 3)) - 12 * ln(n)", "n"), ("l_linestatus", "", "2 * ll - 4 * ln(n)", "none, n"), ("l_linestatus", "l_quantity", "2 * ll - 8 * ln(n)", "fit, n")]
    return ", ".join(out) + " " + " union all ".join(f"select '{c}' as child, '{p}' as parent, round({e}, 2) as score from {t}" for c, p, e, t in rows)


@query(_mixed_bic_sql())
def mixed_bic_scores(spark, sf):
    s = scores.MixedBic(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linestatus"])
    return spark.createDataFrame([(s.names[i], "".join(s.names[j] for j in p), round(s.local(i, p), 2)) for i, p in ((0, []), (0, [1]), (2, []), (2, [0]))], "child string, parent string, score double")


@query()
def distribution_functions(spark, sf):
    """Every distribution function on a grid of arguments."""
    base = spark.range(1, 20).select((F.col("id") / 20).alias("u"), F.col("id").cast("double").alias("k"))
    args = {1: lambda: [F.col("u")], 2: lambda: [F.col("u"), F.lit(3.0)], 3: lambda: [F.col("u"), F.lit(4.0), F.lit(0.6)]}
    return base.select("u", *[column(n, *(args[a]()[::-1] if n in ("gamma_quantile", "gamma_cdf") else args[a]())).alias(n) for n, (_, a) in FUNCTIONS.items()])


@query("select p_partkey, round(p_retailprice * 1.1 - p_size ^ 2 / (1 + p_size), 6) as a, ln(p_retailprice) > 7 as b, floor(p_size / 7.0 + 0.5) as c, case when p_size >= 25 then greatest(p_size, 30) else least(p_size, 10) end as d, 1 / (1 + exp(-(p_size - 25) / 10.0)) as e from part".replace("ln(p_retailprice) > 7 as b", "cast(ln(p_retailprice) > 7 as double) as b").replace("as d", "::double as d").replace("1 / (1 + exp(-(p_size - 25) / 10.0)) as e", "round(1 / (1 + exp(-(p_size - 25) / 10.0)), 9) as e").replace("end ::double", "end::double"))
def calculator(spark, sf):
    out = transform(table(spark, sf, "part"), "a = p_retailprice * 1.1 - p_size ^ 2 / (1 + p_size)", "b = ln(p_retailprice) > 7", "c = round(p_size / 7)", "d = IF(p_size >= 25, max(p_size, 30), min(p_size, 10))", "e = logistic((p_size - 25) / 10)")
    return out.select("p_partkey", F.round("a", 6).alias("a"), "b", "c", "d", F.round("e", 9).alias("e"))


@query("select p_partkey, round(sin(p_size) + cos(p_size) * tan(p_size / 100.0) - atan(p_size), 9) as trigonometry, round(sinh(p_size / 10.0) / cosh(p_size / 10.0), 9) as hyperbolic, round(sqrt(abs(p_size - 25)) + log10(p_retailprice) + exp(p_size / 50.0) + sign(p_size - 25) + ceil(p_size / 3.0), 8) as other, cast((p_size < 10 or p_size > 40) as double) as logic, case p_size % 3 when 0 then 5.0 when 1 then 6.0 else 7.0 end::double as choice from part".replace("as choice", "as choice"))
def calculator_functions(spark, sf):
    df = table(spark, sf, "part").withColumn("m", F.col("p_size") % 3)
    out = transform(
        df,
        "trigonometry = sin(p_size) + cos(p_size) * tan(p_size / 100) - atan(p_size)",
        "hyperbolic = sinh(p_size / 10) / cosh(p_size / 10)",
        "other = sqrt(abs(p_size - 25)) + log10(p_retailprice) + exp(p_size / 50) + signum(p_size - 25) + ceil(p_size / 3)",
        "logic = OR(p_size < 10, p_size > 40)",
        "choice = Switch(m, 5, 6, 7)",
    )
    return out.select("p_partkey", *[F.round(c, d).alias(c) for c, d in (("trigonometry", 9), ("hyperbolic", 9), ("other", 8))], "logic", "choice")


@query()
def calculator_draws(spark, sf):
    draws = ["U(0, 2)", "N(1, 2)", "LogNormal(0, 1)", "ExponentialDist(3)", "Cauchy(0, 1)", "Gumbel(0, 1)", "Laplace(0, 1)", "Levy(0, 1)", "Pareto(1, 2)", "Weibull(2, 1)", "Triangular(0, 4, 1)", "Indicator(0.3)", "Discrete(0.2, 0.3, 0.5)", "Mixture(0.5, 0, 1, 0.5, 10, 1)", "Split(0, 1, 2, 4)", "DiscError(U(0, 1), 0, 1, 2)", "ChiSquare(3)", "Gamma(2, 1)", "Beta(2, 3)", "FDist(4, 9)", "Nakagami(1, 2)", "Poisson(4)", "StudentT(5)", "TruncNormal(0, 1, -1, 1)"]
    return transform(table(spark, sf, "part").select("p_partkey"), *[f"d{i} = {d}" for i, d in enumerate(draws)])


@query("with e as (select min(l_quantity) a, max(l_quantity) b from lineitem) select l_orderkey, l_linenumber, cast(case when l_quantity < a + (b - a) / 4 then 0 when l_quantity < a + (b - a) / 4 * 2 then 1 when l_quantity < a + (b - a) / 4 * 3 then 2 else 3 end as int) as code from lineitem, e")
def equal_intervals(spark, sf):
    return preparation.equal_intervals(table(spark, sf, "lineitem"), "l_quantity", 4, "code").select("l_orderkey", "l_linenumber", "code")


@query("with r as (select c_acctbal x, row_number() over (order by c_acctbal) - 1 k, count(*) over () n from customer), c as (select max(case when k = n // 3 then x end) a, max(case when k = n // 3 * 2 then x end) b from r) select c_custkey, cast((c_acctbal >= a)::int + (c_acctbal >= b)::int as int) as code from customer, c")
def equal_counts(spark, sf):
    return preparation.equal_counts(table(spark, sf, "customer"), "c_acctbal", 3, "code").select("c_custkey", "code")
