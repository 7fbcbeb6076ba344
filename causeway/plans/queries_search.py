"""Queries of graphs, searches, simulations and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from causeway.functions import distributions
from causeway.operators import count_tree as count_trees
from causeway.operators import delta, independence, moments, preparation, scores, tables
from causeway.operators.ordering import with_row_number
from causeway.plans import bayes, bayes_em, clusters, compare, graphs, lofs, mags, mixed, nongaussian, queries_statistics, ricf, search, sem, simulate, stability
from causeway.plans.catalog import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EDGES = "n1 string, n2 string, end1 string, end2 string"


def _values(rows, columns: str) -> str:
    """SQL of rows that are known beforehand: the structure that data were drawn from."""
    return f"select * from (values {', '.join('(' + ', '.join(repr(v) for v in r) + ')' for r in rows)}) as t({columns})"


def _cov(spark, sf):
    return moments.covariance_matrix(table(spark, sf, "lineitem"), NUMBERS)


#: Columns of a known structure, a -> c <- b and c -> d: each sum has a column of the table as noise that nothing else has.
LINEAR = {"a": "l_quantity / 14", "b": "l_extendedprice / 28000", "c": "l_quantity / 14 + l_extendedprice / 28000 + l_discount * 30", "d": "l_quantity / 14 + l_extendedprice / 28000 + l_discount * 30 + l_tax * 60"}
#: The same structure in categories: a third of the rows of c and d have a number that depends on nothing.
DISCRETE = {
    "a": "case when l_quantity > 25 then 1 else 0 end",
    "b": "case when l_discount > 0.045 then 1 else 0 end",
    "c": "case when l_tax > 0.055 then l_linenumber % 3 else case when l_quantity > 25 then 1 else 0 end + case when l_discount > 0.045 then 1 else 0 end end",
    "d": "case when month(l_shipdate) <= 4 then day(l_shipdate) % 3 else case when l_tax > 0.055 then l_linenumber % 3 else case when l_quantity > 25 then 1 else 0 end + case when l_discount > 0.045 then 1 else 0 end end end",
}
ALPHA = 1e-4


def _columns(spark, sf, columns):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def _separations() -> str:
    """SQL: partial correlations of each pair given every set of the others, and who is adjacent: no set separates them."""
    names, crit = list(LINEAR), float(abs(distributions.normal_quantile(ALPHA / 2)))
    pairs = [(x, y) for x in names for y in names if x != y]
    return f"""
with v as (select {", ".join(f"{e} as {c}" for c, e in LINEAR.items())} from lineitem), n as (select count(*) as n from v),
r as ({" union all ".join(f"select '{x}' as x, '{y}' as y, corr({x}, {y}) as r from v" for x, y in pairs)}),
p1 as (select i.x, i.y, k.y as z, (i.r - k.r * l.r) / sqrt((1 - k.r * k.r) * (1 - l.r * l.r)) as r from r i join r k on k.x = i.x and k.y <> i.y join r l on l.x = i.y and l.y = k.y),
p2 as (select i.x, i.y, i.z, k.y as w, (i.r - k.r * l.r) / sqrt((1 - k.r * k.r) * (1 - l.r * l.r)) as r from p1 i join p1 k on k.x = i.x and k.z = i.z and k.y <> i.y join p1 l on l.x = i.y and l.z = i.z and l.y = k.y),
s as (select x, y, [] as given, r from r union all select x, y, [z], r from p1 union all select x, y, [z, w], r from p2),
sep as (select x, y, given from s, n where abs(atanh(r)) * sqrt(n - len(given) - 3) <= {crit!r}),
adj as (select x, y from r where not exists (select 1 from sep where sep.x = r.x and sep.y = r.y)),
first as (select x, y, min(len(given)) as k from sep group by x, y),
collider as (select i.x, i.y as z, j.x as y from adj i join adj j on i.y = j.y and i.x <> j.x join first f on f.x = i.x and f.y = j.x where not exists (select 1 from sep where sep.x = i.x and sep.y = j.x and len(given) = f.k and list_contains(given, i.y))),
away as (select distinct c.z as x, a.y from collider c join adj a on a.x = c.z where a.y <> c.x and a.y <> c.y and not exists (select 1 from adj o where o.x = c.x and o.y = a.y) and not exists (select 1 from collider d where d.z = c.z and (d.x = a.y or d.y = a.y))),
pointed as (select distinct x, z as y from collider union select x, y from away)"""


def _edges_sql(plain: str, tail: str, away: bool = True) -> str:
    """SQL of the edges: ``>`` where something points, ``tail`` at the other end of a collider's edge, ``plain`` where nothing is known."""
    arrows = "pointed" if away else "(select distinct x, z as y from collider)"
    mark = lambda here, there: f"case when exists (select 1 from {arrows} i where i.x = e.{there} and i.y = e.{here}) then '>' when exists (select 1 from away w where w.x = e.{here} and w.y = e.{there}) and {'true' if away else 'false'} then '-' when exists (select 1 from {arrows} i where i.x = e.{here} and i.y = e.{there}) then '{tail}' else '{plain}' end"
    return f"{_separations()} select e.x as n1, e.y as n2, {mark('x', 'y')} as end1, {mark('y', 'x')} as end2 from adj e where e.x < e.y"


def _inverse_sql(threshold: float) -> str:
    return f"{_separations()} select distinct x as n1, y as n2, '-' as end1, '-' as end2 from p2 where x < y and abs(r) > {threshold}"


_PATTERN, _PAG, _CYCLIC = _edges_sql("-", "-"), _edges_sql("o", "o"), _edges_sql("o", "-", away=False)


def _frame(spark, g):
    return spark.createDataFrame(list(g.edges()), EDGES)


def _in_order(spark, g):
    """Edges with their nodes in order of name."""
    return spark.createDataFrame([(a, b, x, y) if a < b else (b, a, y, x) for a, b, x, y in g.edges()], EDGES)


def _model(spark, nodes=8, edges=10, rows=5000, errors="normal"):
    """A linear model, and the covariance of rows drawn from it on the executors."""
    m = simulate.linear_model(simulate.random_forward(nodes, edges, 3), 4)
    data = simulate.simulate_linear(spark, m, rows, 5, errors)
    return m, data, moments.covariance_matrix(data, m.graph.nodes)


_SQL_OF = {
    **dict.fromkeys(("pc_stable", "pc", "cpc", "pc_majority", "pc_max", "pc_deterministic", "pc_fdr", "fges", "gpc", "mmhc"), _PATTERN),
    **dict.fromkeys(("fci", "rfci", "cfci", "fci_max", "gfci"), _PAG),
    "ccd": _CYCLIC,
    "inverse_correlation": _inverse_sql(0.05),
}
_ON_COVARIANCES = {
    "pc_stable": lambda t, s: search.pc_stable(t),
    "pc": lambda t, s: search.pc(t, stable=False),
    "cpc": lambda t, s: search.cpc(t),
    "pc_majority": lambda t, s: search.pc_majority(t),
    "pc_max": lambda t, s: search.pc_max(t),
    "pc_deterministic": lambda t, s: search.pcd(t),
    "pc_fdr": lambda t, s: search.pc_fdr(t, 0.001),
    "fci": lambda t, s: search.fci(t),
    "rfci": lambda t, s: search.rfci(t),
    "cfci": lambda t, s: search.cfci(t),
    "fci_max": lambda t, s: search.fci_max(t),
    "gfci": lambda t, s: search.gfci(t, s),
    "fges": lambda t, s: search.fges(s),
    "gpc": lambda t, s: search.gpc(t, s),
    "mmhc": lambda t, s: search.mmhc(t, s),
    "ccd": lambda t, s: search.ccd(t),
    "inverse_correlation": lambda t, s: search.inverse_correlation(t.cov, 0.05),
    "glasso": lambda t, s: _precision_graph(t.cov),
}


def _precision_graph(cov):
    r = cov.correlation()
    p = search.glasso(r.matrix, 0.02)
    return graphs.Graph(r.names, [(a, b, "-", "-") for i, a in enumerate(r.names) for j, b in enumerate(r.names) if i < j and abs(p[i, j]) > 1e-8])


def _search_query(name, f):
    def on_lineitem(spark, sf):
        cov = moments.covariance_matrix(_columns(spark, sf, LINEAR), list(LINEAR))
        return compare.canonical(_frame(spark, f(independence.FisherZ(cov, ALPHA), scores.SemBic(cov))))

    query(_SQL_OF.get(name), name=f"{name}_lineitem")(on_lineitem)


for _name, _f in _ON_COVARIANCES.items():
    _search_query(_name, _f)


@query()
def search_accuracy(spark, sf):
    """Every search on data drawn from a known model: adjacency and arrow precision and recall."""
    m, _, cov = _model(spark)
    truth = graphs.dag_to_pattern(m.graph)
    rows = []
    for name, f in _ON_COVARIANCES.items():
        found = f(independence.FisherZ(cov, 0.01), scores.SemBic(cov))
        rows.append((name, *[float(compare.STATISTICS[s](truth, found)) for s in ("AP", "AR", "AHP", "AHR", "SHD")]))
    return spark.createDataFrame(rows, "search string, ap double, ar double, ahp double, ahr double, shd double")


@query(_values([(s, *e) for s in ("pc", "fges_bdeu", "fges_bic") for e in (("a", "c", "-", ">"), ("b", "c", "-", ">"), ("c", "d", "-", ">"))], "search, n1, n2, end1, end2"))
def discrete_search(spark, sf):
    """Searches of categories whose structure is known (``DISCRETE``)."""
    chi = independence.ChiSquare.of(_columns(spark, sf, DISCRETE), list(DISCRETE), ALPHA)
    rows = [("pc", *e) for e in search.pc_stable(chi).edges()] + [("fges_bdeu", *e) for e in search.fges(scores.BDeu(chi)).edges()] + [("fges_bic", *e) for e in search.fges(scores.DiscreteBic(chi)).edges()]
    return spark.createDataFrame(rows, "search string, " + EDGES)


_BLANKETS = {"grow_shrink": search.grow_shrink, "iamb": search.iamb, "inter_iamb": search.inter_iamb, "iamb_pc": search.iamb_pc, "mmpc": search.mmpc, "mmmb": search.mmmb, "hiton_mb": search.hiton_mb}
_BLANKET_GRAPH = simulate.random_forward(8, 8, 7)


def _blanket(search_name: str, n: str) -> str:
    """What a search should find around a node: its neighbours, or its whole Markov blanket."""
    g = _BLANKET_GRAPH
    return ",".join(sorted(g.neighbours(n) if search_name in ("iamb_pc", "mmpc") else g.markov_blanket(n)))


@query(_values([(n, name, _blanket(name, n)) for n in _BLANKET_GRAPH.nodes for name in _BLANKETS], "target, search, found"))
def markov_blankets(spark, sf):
    m = simulate.linear_model(_BLANKET_GRAPH, 4)
    test = independence.FisherZ(moments.covariance_matrix(simulate.simulate_linear(spark, m, 50_000, 5), m.graph.nodes), 1e-5)
    return spark.createDataFrame([(n, name, ",".join(sorted(f(test, n)))) for n in m.graph.nodes for name, f in _BLANKETS.items()], "target string, search string, found string")


@query()
def independence_tests(spark, sf):
    """p-values of the tests on continuous columns, over all rows."""
    cov, df = _cov(spark, sf), table(spark, sf, "lineitem")
    kernel = independence.WholeKernelTest(df, NUMBERS)
    tests = {"fisher_z": independence.FisherZ(cov), "correlation_t": independence.CorrelationT(cov), "cramer_t": independence.CramerT(cov), "full_order": independence.FullOrderCorrelation(cov), "kernel": kernel, "conditional_correlation": independence.WholeConditionalCorrelation(df, NUMBERS, like=kernel)}
    rows = [(name, x, y, ",".join(z), float(t.p_value(x, y, z))) for name, t in tests.items() for x, y, z in (("l_quantity", "l_extendedprice", []), ("l_quantity", "l_discount", ["l_tax"]), ("l_discount", "l_tax", ["l_quantity", "l_extendedprice"]))]
    kernel.release()
    return spark.createDataFrame(rows, "test string, x string, y string, z string, p double")


@query()
def mixed_regression_tests(spark, sf):
    df = table(spark, sf, "lineitem")
    t = independence.MixedRegression(df, ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])
    rows = [(x, y, ",".join(z), float(t.p_value(x, y, z))) for x, y, z in (("l_quantity", "l_extendedprice", []), ("l_quantity", "l_returnflag", []), ("l_linestatus", "l_returnflag", ["l_quantity"]))]
    return spark.createDataFrame(rows, "x string, y string, z string, p double")


_NATION_EDGES = "select 'r' || n_regionkey as n1, 'n' || n_nationkey as n2, '-' as end1, '>' as end2 from nation union all select 'n' || s_nationkey, 's' || s_suppkey, '-', '>' from supplier"


def _geography(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("n1"), F.concat(F.lit("n"), "n_nationkey").alias("n2"), F.lit("-").alias("end1"), F.lit(">").alias("end2"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), F.lit("-"), F.lit(">"))
    return n.union(s)


@query(f"with recursive e as ({_NATION_EDGES}), a(ancestor, node) as (select n1, n2 from e union select a.ancestor, e.n2 from a join e on e.n1 = a.node) select * from a")
def ancestor_pairs(spark, sf):
    return compare.ancestor_pairs(_geography(spark, sf))


@query(f"with e as ({_NATION_EDGES}), b as (select n1, n2 from e union select n2, n1 from e) select x.n1 as a, x.n2 as b, y.n1 as c from b x join b y on x.n2 = y.n2 and x.n1 < y.n1 where not exists (select 1 from b z where z.n1 = x.n1 and z.n2 = y.n1)")
def unshielded_triples(spark, sf):
    return compare.unshielded_triples(_geography(spark, sf))


_OTHER = "select 'r' || (n_regionkey + n_nationkey % 2) % 5 as n1, 'n' || n_nationkey as n2, case when n_nationkey % 3 = 0 then '>' else '-' end as end1, '>' as end2 from nation"


def _other(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("r"), ((F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5).cast("string")).alias("n1"), F.concat(F.lit("n"), "n_nationkey").alias("n2"), F.when(F.col("n_nationkey") % 3 == 0, ">").otherwise("-").alias("end1"), F.lit(">").alias("end2"))


@query(f"""
with t as ({_NATION_EDGES}), e as ({_OTHER}), c as (select least(n1, n2) a, greatest(n1, n2) b, case when n1 < n2 then end1 else end2 end x, case when n1 < n2 then end2 else end1 end y from t),
d as (select least(n1, n2) a, greatest(n1, n2) b, case when n1 < n2 then end1 else end2 end x, case when n1 < n2 then end2 else end1 end y from e), j as (select c.x cx, c.y cy, d.x dx, d.y dy from c full join d on c.a = d.a and c.b = d.b),
h as (select cx is not null t, dx is not null e, coalesce(cx = '>', false) a1, coalesce(cy = '>', false) a2, coalesce(dx = '>', false) b1, coalesce(dy = '>', false) b2 from j)
select count(*) filter (where t and e) as adj_tp, count(*) filter (where not t) as adj_fp, count(*) filter (where not e) as adj_fn, count(*) filter (where a1 and b1) + count(*) filter (where a2 and b2) as arrow_tp,
count(*) filter (where not a1 and b1) + count(*) filter (where not a2 and b2) as arrow_fp, count(*) filter (where a1 and not b1) + count(*) filter (where a2 and not b2) as arrow_fn from h""")
def compare_edges(spark, sf):
    return compare.compare_edges(_geography(spark, sf), _other(spark, sf))


@query(f"with t as ({_NATION_EDGES}), e as ({_OTHER}), c as (select least(n1, n2) n1, greatest(n1, n2) n2, case when n1 < n2 then end1 else end2 end end1, case when n1 < n2 then end2 else end1 end end2 from t) select * from c where not exists (select 1 from e where least(e.n1, e.n2) = c.n1 and greatest(e.n1, e.n2) = c.n2)")
def adjacencies_missing(spark, sf):
    return compare.adjacencies_missing(_geography(spark, sf), _other(spark, sf))


@query(f"with t as ({_NATION_EDGES}), e as ({_OTHER}) select least(t.n1, t.n2) as n1, greatest(t.n1, t.n2) as n2, case when t.n1 < t.n2 then t.end1 else t.end2 end as end1, case when t.n1 < t.n2 then t.end2 else t.end1 end as end2 from t join e using (n1, n2) where t.end1 = e.end1 and t.end2 = e.end2")
def common_edges(spark, sf):
    return compare.common_edges([_geography(spark, sf), _other(spark, sf)])


@query("with c as (select 0 as cluster, [0.5, 0.5] as c union all select 1, [-0.5, 0.5] union all select 2, [0.0, -0.5]), p as (select vec_id, embedding[1]::double a, embedding[2]::double b from embeddings), d as (select vec_id, a, b, cluster, pow(a - c[1], 2) + pow(b - c[2], 2) as d from p, c), n as (select *, row_number() over (partition by vec_id order by d, cluster) k from d) select cluster::int as cluster, count(*) as size, round(avg(a), 8) as c0, round(avg(b), 8) as c1 from n where k = 1 group by 1")
def kmeans_step(spark, sf):
    points = table(spark, sf, "embeddings").select(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    out = stability.lloyd_step(points, "v", [[0.5, 0.5], [-0.5, 0.5], [0.0, -0.5]])
    return out.select("cluster", "size", F.round(F.element_at("center", 1), 8).alias("c0"), F.round(F.element_at("center", 2), 8).alias("c1"))


@query("with s as (select p_partkey, p_brand, p_retailprice x, lag(p_retailprice) over w l, lead(p_retailprice) over w r from part window w as (partition by p_brand order by p_retailprice, p_partkey)) select p_partkey, round(least(coalesce(x - l, r - x), coalesce(r - x, x - l)), 8) as nearest from s")
def nearest_in_category(spark, sf):
    return stability.nearest_in_category(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", "p_brand").select("p_partkey", F.round("nearest", 8).alias("nearest"))


@query(f"with r as ({' union all '.join(f'select {a!r} as v, abs(corr({a}, {b})) as r from lineitem' for a in NUMBERS for b in NUMBERS)}), i as (select v, sum(r) as s, max(r) filter (where r < 0.999) as m from r group by v) select cast(row_number() over (order by s desc) - 1 as int) as place, v as variable from i where m < 0.5 order by s desc limit 3")
def diverse_selection(spark, sf):
    cov = moments.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS)
    picked = stability.diverse_top([(n, float(abs(cov.matrix[cov.index(n)]).sum())) for n in NUMBERS], lambda a, b: cov.matrix[cov.index(a), cov.index(b)], 3, 0.5)
    return spark.createDataFrame(list(enumerate(picked)), "place int, variable string")


@query()
def bootstrap_votes(spark, sf):
    """Searches of bootstrap replicates, each in a task, and their votes."""
    m, data, _ = _model(spark, 5, 5, 400)
    samples = preparation.bootstrap(data, 400, 8, 10)
    names = m.graph.nodes

    def find(pdf: pd.DataFrame):
        return search.pc_stable(independence.FisherZ(moments.Covariance(names, np.cov(pdf.to_numpy().T), len(pdf)), 0.05))

    return stability.edge_votes(stability.resampled_edges(samples, names, find), 10)


@query()
def stability_selection(spark, sf):
    m, data, _ = _model(spark, 5, 5, 400)
    names = m.graph.nodes

    def find(pdf: pd.DataFrame, level: float):
        return search.pc_stable(independence.FisherZ(moments.Covariance(names, np.cov(pdf.to_numpy().T), len(pdf)), level))

    return stability.stars(preparation.subsample(data, 200, 3, 6), names, find, [0.0001, 0.001, 0.01, 0.1])[1]


#: Columns of the line items for mixed models: the ship date as a time, whether the order is filled as its event.
MIXED = {"a": "l_quantity / 14", "b": "l_quantity / 14 + l_extendedprice / 28000", "c": "l_tax", "d": "l_returnflag", "e": "case when l_quantity > 25 or l_discount > 0.08 then 'many' else 'few' end", "time": "datediff(l_shipdate, date '1992-01-01')", "event": "case when l_linenumber <= 4 then 1 else 0 end"}


def _mixed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in MIXED.items()])


def _pair_rows(spark, model):
    return spark.createDataFrame([(x.a, x.b, x.kind, round(model.norm(x), 4), model.norm(x) > 0) for x in model.pairs], "n1 string, n2 string, kind string, strength double, present boolean")


@query()
def mixed_model(spark, sf):
    """Pairs of a mixed graphical model over all line items."""
    return _pair_rows(spark, mixed.fit(_mixed(spark, sf), ["a", "b", "c"], ["d", "e"], None, {"cc": 0.1, "cd": 0.1, "dd": 0.1}))


@query()
def survival_mixed_model(spark, sf):
    """The same with the time to shipping as a right-censored column."""
    return _pair_rows(spark, mixed.fit(_mixed(spark, sf), ["a", "b", "c"], ["d", "e"], [mixed.Survival("s", "time", "event")], {k: 0.1 for k in mixed.KINDS}))


def _entry_sql() -> str:
    """SQL: slopes of the loss at the model without pairs, whose columns each stand by themselves."""
    dates = "date_diff('day', date '1992-01-01', l_shipdate)"
    own = ", ".join(f"{dates if c == 'time' else e} as {c}" for c, e in MIXED.items())
    numbers, kinds = ["a", "b", "c"], ["d", "e"]
    pairs = lambda x, y: [(p, q) for p in x for q in y if p < q]
    cc = " union all ".join(f"select '{x}' as n1, '{y}' as n2, 'cc' as kind, abs(2 * avg({x} * {y})) as v from z" for x, y in pairs(numbers, numbers))
    cd = " union all ".join(f"select '{x}', '{y}', 'cd', sqrt(sum(g * g)) / any_value(w) from (select {y}, 2 * sum({x}) / any_value(n) as g from z, k group by {y}), w{y}" for x in numbers for y in kinds)
    dd = " union all ".join(f"select '{x}', '{y}', 'dd', sqrt(sum(pow(2 * (p{x}.p * p{y}.p - coalesce(j.p, 0)), 2))) / any_value(w{x}.w * w{y}.w) from p{x} cross join p{y} left join (select {x}, {y}, count(*) / any_value(n)::double as p from z, k group by {x}, {y}) j on j.{x} = p{x}.{x} and j.{y} = p{y}.{y}, w{x}, w{y}" for x, y in pairs(kinds, kinds))
    levels = " union all ".join([f"select '{x}' as n1, '' as c, time, count(*) as r, count(*) filter (where event = 1) as m, sum({x}) as s, coalesce(sum({x}) filter (where event = 1), 0) as d from z group by time" for x in numbers] + [f"select '{x}', v.v, time, count(*), count(*) filter (where event = 1), sum(({x} = v.v)::int)::double, (count(*) filter (where event = 1 and {x} = v.v))::double from z, (select distinct {x} as v from z) v group by time, v.v" for x in kinds])
    return f"""
with raw as (select {own} from lineitem), k as (select count(*) as n, {", ".join(f"avg({x}) as m{x}, stddev_samp({x}) as s{x}" for x in numbers)} from raw),
z as (select {", ".join(f"({x} - m{x}) / s{x} as {x}" for x in numbers)}, d, e, time, event from raw, k),
{", ".join(f"p{y} as (select {y}, count(*) / any_value(n)::double as p from z, k group by {y}), w{y} as (select sqrt(sum(p * (1 - p))) as w from p{y})" for y in kinds)},
levels as ({levels}),
risk as (select n1, c, m, d, sum(r) over (partition by n1, c order by time desc) as r, sum(s) over (partition by n1, c order by time desc) as s from levels),
score as (select n1, c, (sum((s - l / m * d) / (r - l / m * m)) - sum(case when l = 0 then d else 0 end)) as g from (select *, unnest(range(m))::double as l from risk where m > 0) group by n1, c),
found as ({cc} union all {cd} union all {dd} union all select n1, 's', case when n1 in ('d', 'e') then 'sd' else 'sc' end, sqrt(sum(g * g)) / (select count(*) from z where event = 1) from score group by n1)
select n1, n2, kind, round(v, 6) as penalty from found"""


@query(_entry_sql())
def mixed_entry_penalties(spark, sf):
    """For each pair the penalty below which it enters: slopes of all conditional likelihoods at the model without pairs."""
    rows = mixed.entry_penalties(_mixed(spark, sf), ["a", "b", "c"], ["d", "e"], [mixed.Survival("s", "time", "event")])
    return spark.createDataFrame([(a, b, kind, round(x, 6)) for a, b, kind, x in rows], "n1 string, n2 string, kind string, penalty double")


@query(_values([(a, b, "-", ">") for a, b, *_ in simulate.random_forward(5, 5, 3).edges()], "n1, n2, end1, end2"))
def lingam_search(spark, sf):
    m, data, _ = _model(spark, 5, 5, 5000, "uniform")
    return _frame(spark, nongaussian.lingam(nongaussian.sample_rows(data, m.graph.nodes), m.graph.nodes)[0])


#: Two factors from columns of the line items that depend on nothing: quantity, and quantity with price.
_F, _G = "l_quantity / 14.4", "(l_quantity / 28.8 + l_extendedprice / 28000)"
_NOISE = ["l_discount / 0.04", "l_tax / 0.033", "l_linenumber / 2.5", "dayofmonth(l_shipdate) / 11.0", "month(l_shipdate) / 4.3", "(l_partkey % 100) / 36.0", "(l_orderkey % 50) / 18.0", "(l_suppkey % 10) / 3.6"]
#: Four indicators of each factor; in the second table six of both at once, and two of neither.
ONE_EACH = {f"x{k + 1}": f"{1 + k % 4 / 10} * {_F if k < 4 else _G} + {z}" for k, z in enumerate(_NOISE)}
OF_BOTH = {f"y{k + 1}": f"{[1, 1.2, 0.8, 0.3, 0.4, 0.2][k]} * {_F} + {[0.3, 0.2, 0.5, 1, 1.2, 0.9][k]} * l_extendedprice / 28000 + {z}" if k < 6 else z for k, z in enumerate(_NOISE)}


def _delta(spark, sf, columns):
    return delta.from_table(_columns(spark, sf, columns), list(columns))


def _slopes_sql(columns: dict[str, str], cases: list[tuple[str, list[str], list[list[tuple[str, str, str]]]]]) -> str:
    """SQL of delta tests of one or two restrictions: a label, their values, their slopes as (column, column, slope)."""
    names = list(columns)
    table_ = ", ".join(f"{e.replace('dayofmonth', 'day')} as {c}" for c, e in columns.items())
    means = ", ".join(f"avg({c}) as m_{c}" for c in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    covs = ", ".join(f"covar_samp({a}, {b}) as s_{a}_{b}" + (f", covar_samp({a}, {b}) as s_{b}_{a}" if a != b else "") for a, b in pairs)
    out = []
    for label, values, slopes in cases:
        # A row's share in a restriction: the slopes times its own products, less their mean.
        share = [" + ".join(f"({w}) * ({a} * {b} - s_{a}_{b})" for a, b, w in each) for each in slopes]
        mean = [" + ".join(f"({w}) * s_{a}_{b}" for a, b, w in each) for each in slopes]
        gross = [f"({x} + {m})" for x, m in zip(share, mean)]
        v = [[f"(avg({gross[i]} * {gross[j]}) - any_value(({mean[i]}) * ({mean[j]})))" for j in range(len(values))] for i in range(len(values))]
        t = [f"any_value({x})" for x in values]
        if len(values) == 1:
            chi = f"count(*) * {t[0]} * {t[0]} / {v[0][0]}"
        else:
            chi = f"count(*) * ({t[0]} * {t[0]} * {v[1][1]} - 2 * {t[0]} * {t[1]} * {v[0][1]} + {t[1]} * {t[1]} * {v[0][0]}) / ({v[0][0]} * {v[1][1]} - {v[0][1]} * {v[0][1]})"
        out.append(f"select '{label}' as restriction, round(sqrt({chi}), 4) as root, {len(values)} as degrees from c, s")
    return f"with d as (select {table_} from lineitem), m as (select {means} from d), s as (select {covs} from d), c as (select {', '.join(f'{x} - m_{x} as {x}' for x in names)} from d, m) " + " union all ".join(out)


def _tetrad_sql(a, b, c, d):
    return f"s_{a}_{b} * s_{c}_{d} - s_{a}_{c} * s_{b}_{d}", [(a, b, f"s_{c}_{d}"), (c, d, f"s_{a}_{b}"), (a, c, f"-s_{b}_{d}"), (b, d, f"-s_{a}_{c}")]


def _sextad_sql(*six):
    x, y = six[:3], six[3:]
    minor = lambda i, j: f"(s_{x[(i + 1) % 3]}_{y[(j + 1) % 3]} * s_{x[(i + 2) % 3]}_{y[(j + 2) % 3]} - s_{x[(i + 1) % 3]}_{y[(j + 2) % 3]} * s_{x[(i + 2) % 3]}_{y[(j + 1) % 3]})"
    return " + ".join(f"s_{x[0]}_{y[j]} * {minor(0, j)}" for j in range(3)), [(x[i], y[j], minor(i, j)) for i in range(3) for j in range(3)]


_TETRADS = [[("x1", "x2", "x3", "x4")], [("x1", "x2", "x5", "x6")], [("x1", "x5", "x6", "x2")], [("x1", "x2", "x3", "x4"), ("x1", "x2", "x4", "x3")], [("x1", "x2", "x5", "x6"), ("x3", "x4", "x7", "x8")]]
_SEXTADS = [[("y1", "y2", "y3", "y4", "y5", "y6")], [("y1", "y4", "y5", "y2", "y3", "y6")], [("y1", "y2", "y3", "y4", "y5", "y6"), ("y1", "y3", "y5", "y2", "y4", "y6")]]


def _label(names) -> str:
    return "; ".join(" ".join(x) for x in names)


def _delta_sql(columns, cases, of) -> str:
    made = [[of(*x) for x in names] for names in cases]
    return _slopes_sql(columns, [(_label(names), [v for v, _ in x], [s for _, s in x]) for names, x in zip(cases, made)])


@query(_delta_sql(ONE_EACH, _TETRADS, _tetrad_sql))
def delta_tetrads(spark, sf):
    """Delta tests of tetrads within and across two planted clusters, with the fourth moments of all line items: roots of the chi-square statistics."""
    test = _delta(spark, sf, ONE_EACH)
    return spark.createDataFrame([(_label(names), round(float(np.sqrt(test.tetrads(*names)[0])), 4), len(names)) for names in _TETRADS], "restriction string, root double, degrees int")


@query(_delta_sql({c: e for c, e in OF_BOTH.items() if c <= "y6"}, _SEXTADS, _sextad_sql))
def delta_sextads(spark, sf):
    test = _delta(spark, sf, OF_BOTH)
    return spark.createDataFrame([(_label(names), round(float(np.sqrt(test.sextads(*names)[0])), 4), len(names)) for names in _SEXTADS], "restriction string, root double, degrees int")


@query(_values([(k, f"x{4 * k + i}") for k in range(2) for i in range(1, 5)], "cluster, variable"))
def pure_clusters(spark, sf):
    """Clusters planted in the line items: four indicators of each of two correlated factors."""
    found = clusters.build_pure_clusters(_delta(spark, sf, ONE_EACH), 0.001)
    return spark.createDataFrame([(k, n) for k, c in enumerate(found) for n in c], "cluster int, variable string")


@query(_values([(0, f"y{i}") for i in range(1, 7)], "cluster, variable"))
def two_factor_clusters(spark, sf):
    """Six indicators of the same two factors, beside two of neither."""
    found = clusters.two_factor_clusters(_delta(spark, sf, OF_BOTH), 0.001)
    return spark.createDataFrame([(k, n) for k, c in enumerate(found) for n in c], "cluster int, variable string")


_SKELETON = "a---c,b---c,c---d"


@query(_values([("a", "c", "-", ">"), ("b", "c", "-", ">"), ("c", "d", "-", ">")], "n1, n2, end1, end2"))
def lofs_parents(spark, sf):
    """Parents by the residuals farthest from normal, among all sets of neighbours."""
    return _in_order(spark, lofs.rule1(_columns(spark, sf, LINEAR), graphs.from_spec(_SKELETON)))


@query(_values([("a", "c", "-", ">"), ("b", "c", "-", ">"), ("c", "d", "-", ">")], "n1, n2, end1, end2"))
def lofs_edges(spark, sf):
    """Each edge by both ends' residuals, over all other parents they may have."""
    return _in_order(spark, lofs.rule2(_columns(spark, sf, LINEAR), graphs.from_spec(_SKELETON)))


def _shape_sql() -> str:
    forms = {"a": "a", "c": "c", "d": "d", "c | a": "c - regr_slope(c, a) over () * a", "a | c": "a - regr_slope(a, c) over () * c", "d | c": "d - regr_slope(d, c) over () * c", "c | d": "c - regr_slope(c, d) over () * d"}
    z = queries_statistics._upper_tail("abs(z)")
    return f"""
with d as (select {", ".join(f"{e} as {c}" for c, e in LINEAR.items())} from lineitem), v as ({" union all ".join(f"select '{k}' as residual, {e} as v from d" for k, e in forms.items())}),
m as (select residual, avg(v) as m, stddev_samp(v) as s, count(*)::double as n from v group by residual),
z as (select residual, n, (v - m) / s as z, row_number() over (partition by residual order by v) as i from v join m using (residual)),
p as (select residual, n, i, case when z < 0 then u else 1 - u end as p, case when z < 0 then 1 - u else u end as q from (select residual, n, i, z, {z} as u from z))
select residual, round((-any_value(n) - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(q)) / any_value(n)) * (1 + 0.75 / any_value(n) + 2.25 / (any_value(n) * any_value(n))), 4) as statistic from p group by residual"""


@query(_shape_sql())
def residual_shapes(spark, sf):
    """Anderson-Darling statistics of variables and residuals, in one job."""
    wanted = [lofs.Candidate("a"), lofs.Candidate("c"), lofs.Candidate("d"), lofs.Candidate("c", ("a",)), lofs.Candidate("a", ("c",)), lofs.Candidate("d", ("c",)), lofs.Candidate("c", ("d",))]
    found = lofs.anderson_darling(_columns(spark, sf, LINEAR), list(LINEAR), wanted)
    return spark.createDataFrame([(" | ".join([c.name, *c.parents]), round(found[c], 4)) for c in wanted], "residual string, statistic double")


#: A cycle p -> q -> r -> p with an effect on s, solved for its independent columns: (1 - effects) ** -1.
_EFFECTS = {("p", "q"): 0.8, ("q", "r"): 0.7, ("r", "p"): -0.6, ("q", "s"): 0.9}
_OWN = ["l_quantity / 14.4", "l_extendedprice / 28000", "l_discount / 0.03", "l_tax / 0.025"]


def _cycle() -> dict[str, str]:
    names = ["p", "q", "r", "s"]
    b = np.zeros((4, 4))
    for (x, y), v in _EFFECTS.items():
        b[names.index(y), names.index(x)] = v
    total = np.linalg.inv(np.eye(4) - b)
    return {n: " + ".join(f"{float(total[i, j])!r} * {z}" for j, z in enumerate(_OWN) if abs(total[i, j]) > 1e-12) for i, n in enumerate(names)}


@query("select cause, effect, coefficient::double as coefficient from (" + _values(sorted((x, y, v) for (x, y), v in _EFFECTS.items()), "cause, effect, coefficient") + ")")
def cyclic_model(spark, sf):
    """The stable one of the cyclic models of columns that a planted cycle makes from the line items."""
    found = nongaussian.ling(_columns(spark, sf, _cycle()), ["p", "q", "r", "s"])[0]
    return spark.createDataFrame([(x, y, round(v, 1)) for x, y, v in found.edges()], "cause string, effect string, coefficient double")


@query(f"""
with d as (select {", ".join(f"{LINEAR[c]} as {c}" for c in "abc")} from lineitem),
s as (select var_samp(a) as aa, var_samp(b) as bb, var_samp(c) as cc, covar_samp(a, b) as ab, covar_samp(a, c) as ac, covar_samp(b, c) as bc from d),
r as (select *, (ac * bb - bc * ab) / (aa * bb - ab * ab) as x, (bc * aa - ac * ab) / (aa * bb - ab * ab) as y from s),
i as (select *, x * x * aa + y * y * bb + cc - x * ac - y * bc as v from r)
select 'a' as var_i, 'a' as var_j, round(aa, 6) as implied from i union all select 'a', 'b', 0 from i union all select 'a', 'c', round(x * aa, 6) from i union all select 'b', 'b', round(bb, 6) from i union all select 'b', 'c', round(y * bb, 6) from i union all select 'c', 'c', round(v, 6) from i""")
def correlated_errors(spark, sf):
    """Implied covariances of a <-> c <-> b, which says what a -> c <- b says: the SQL is that model's regression."""
    fit = ricf.ricf(moments.covariance_matrix(_columns(spark, sf, {c: LINEAR[c] for c in "abc"}), list("abc")), graphs.from_spec("a<->c,b<->c"))
    at = {n: i for i, n in enumerate(fit.names)}
    return spark.createDataFrame([(a, b, round(float(fit.implied[at[a], at[b]]), 6) + 0.0) for k, a in enumerate("abc") for b in "abc"[k:]], "var_i string, var_j string, implied double")


#: Two effects of a cause that isn't among the columns, each with a cause and noise of its own.
HIDDEN = {"a": "l_extendedprice / 28000", "b": "l_extendedprice / 28000 + l_quantity / 14 + l_discount * 30", "c": "l_quantity / 14 + l_tax * 40 + l_linenumber / 2.0", "d": "l_tax * 40"}


@query(_values([("a", "b", "o", ">"), ("b", "c", ">", ">"), ("c", "d", ">", "o")], "n1, n2, end1, end2"))
def hidden_cause(spark, sf):
    """Both effects of a planted hidden cause point at each other, and nothing else is joined."""
    cov = moments.covariance_matrix(_columns(spark, sf, HIDDEN), list(HIDDEN))
    return _in_order(spark, search.fci(independence.FisherZ(cov, ALPHA)))


@query(_values([(1, "a", "c", "o", ">"), (1, "b", "c", "o", ">"), (1, "c", "d", "-", ">"), (2, "a", "c", ">", ">"), (2, "a", "d", ">", ">"), (2, "b", "c", "o", ">"), (2, "c", "d", "-", ">")], "solution, n1, n2, end1, end2"))
def overlapping_views(spark, sf):
    """All that two searches, which see a, b, c and b, c, d, leave open about the four; the SQL lists what enumeration of all classes gives."""
    views = [search.fci(independence.FisherZ(moments.covariance_matrix(_columns(spark, sf, {c: LINEAR[c] for c in names}), list(names)), ALPHA)) for names in ("abc", "bcd")]
    rows = [(k + 1, *((a, b, x, y) if a < b else (b, a, y, x))) for k, g in enumerate(mags.integrate(views)) for a, b, x, y in g.edges()]
    return spark.createDataFrame(rows, "solution int, " + EDGES)


_SETS = [["a"], ["a", "c"], ["b", "d"], ["a", "b", "c"], ["d", "b", "c"]]


@query("with d as (select " + ", ".join(f"{e} as {c}" for c, e in DISCRETE.items()) + " from lineitem) " + " union all ".join(f"select '{' '.join(x)}' as columns, concat_ws(' ', {', '.join(x)}) as cell, count(*) as n from d group by {', '.join(x)}" for x in _SETS))
def count_tree(spark, sf):
    """Counts of sets of columns, all from one pass over the line items."""
    with count_trees.CountTree(_columns(spark, sf, DISCRETE), list(DISCRETE)) as tree:
        rows = [(" ".join(x), " ".join(map(str, key)), n) for x in _SETS for *key, n in tree.counts(tuple(x))]
    return spark.createDataFrame(rows, "columns string, cell string, n long")


#: A third of the rows that aren't returned miss their status; whether one does depends on the flag alone.
_GAPS = "case when l_returnflag <> 'R' and l_partkey % 3 = 0 then null else l_linestatus end"


@query(f"""
with d as (select l_returnflag as f, {_GAPS} as s from lineitem), c as (select f, s, count(*) as n from d where s is not null group by f, s)
select f as flag, s as status, round(n / sum(n) over (partition by f), 3)::double as probability from c""")
def em_table(spark, sf):
    """Tables with missing values, by expected counts; where the child alone has gaps they are the complete rows' shares."""
    df = table(spark, sf, "lineitem").selectExpr("l_returnflag as f", f"{_GAPS} as s")
    coded, held = tables.index_categories(df, ["f", "s"])
    net = bayes_em.em(coded, graphs.from_spec("f-->s"), {c: len(v) for c, v in held.items()}, steps=200, tolerance=1e-7)
    return spark.createDataFrame([(held["f"][i], held["s"][j], round(float(net.tables["s"][i, j]), 3)) for i in range(len(held["f"])) for j in range(len(held["s"])) if net.tables["s"][i, j] > 1e-6], "flag string, status string, probability double")


@query(_values([("a", "c", "-", ">"), ("b", "c", "-", ">"), ("c", "d", "-", ">")], "n1, n2, end1, end2"))
def structural_em(spark, sf):
    """The planted structure of categories, found although c misses in a seventh of the rows and b in a fifth."""
    gaps = {"b": "case when l_partkey % 5 = 0 then null else {} end", "c": "case when l_partkey % 7 = 0 then null else {} end"}
    df = table(spark, sf, "lineitem").selectExpr(*[f"{gaps.get(c, '{}').format('(' + e + ')')} as {c}" for c, e in DISCRETE.items()])
    net, _ = bayes_em.structural_em(df, {"a": 2, "b": 2, "c": 3, "d": 3})
    return _in_order(spark, graphs.dag_to_pattern(net.graph))


@query()
def structural_model(spark, sf):
    m, _, cov = _model(spark)
    fit = sem.fit_dag(cov, m.graph)
    return spark.createDataFrame([(a, b, m.coefficients[a, b], w, fit.p_values[a, b], fit.p, fit.rmsea, fit.cfi) for (a, b), w in fit.coefficients.items()], "cause string, effect string, truth double, estimate double, p double, model_p double, rmsea double, cfi double")


@query(_values([(k, f"X{4 * k + i}") for k in range(2) for i in range(1, 5)], "cluster, variable"))
def factor_clusters(spark, sf):
    g = simulate.multiple_indicator(2, 4, 1, 5)
    m = simulate.linear_model(g, 6, 0.8, 1.2, (0.3, 0.6))
    cov = moments.covariance_matrix(simulate.simulate_linear(spark, m, 5000, 7), [n for n in g.nodes if n not in g.latent])
    return spark.createDataFrame([(k, n) for k, c in enumerate(sem.one_factor_clusters(cov, 0.001)) for n in c], "cluster int, variable string")


@query("""
with d as (select l_returnflag f, l_linestatus s, month(l_shipdate) m from lineitem), fs as (select distinct f from d), ss as (select distinct s from d), k as (select count(distinct f) kf, count(distinct s) ks, count(distinct m) km, count(*) n from d),
g as (select f, s from fs, ss), pf as (select f, (count(*) + 1) / any_value(n + kf)::double p from d, k group by f),
ps as (select g.f, g.s, (select count(*) + 1 from d where d.f = g.f and d.s = g.s) / ((select count(*) from d where d.f = g.f) + ks)::double p from g, k),
pm as (select g.f, g.s, (select count(*) + 1 from d where d.f = g.f and d.s = g.s and d.m = 6) / ((select count(*) from d where d.f = g.f and d.s = g.s) + km)::double p from g, k),
j as (select f, sum(pf.p * ps.p * pm.p) w from pf join ps using (f) join pm using (f, s) group by f)
select f as category, round(w / sum(w) over (), 9) as probability from j""")
def bayes_net(spark, sf):
    """The flag given the sixth month (category 5)."""
    g = graphs.from_spec("l_returnflag-->l_linestatus,l_returnflag-->l_shipmonth,l_linestatus-->l_shipmonth")
    df = table(spark, sf, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    net = bayes.estimate(df, g, 1.0)
    p = bayes.posterior(net, "l_returnflag", {"l_shipmonth": 5})
    return spark.createDataFrame([(str(c), round(float(v), 9)) for c, v in zip(net.categories["l_returnflag"], p)], "category string, probability double")


_HALF = "(select count(*) from d where d.h = hs.h"


@query(f"""
with d as (select l_returnflag f, l_linestatus s, l_orderkey % 2 h from lineitem), fs as (select distinct f from d), ss as (select distinct s from d), hs as (select distinct h from d), kf as (select count(*) kf from fs), ks as (select count(*) ks from ss),
pf as (select h, f, ({_HALF} and d.f = fs.f) + 1)::double / ({_HALF}) + kf) as p from hs, fs, kf),
ps as (select h, f, s, ({_HALF} and d.f = fs.f and d.s = ss.s) + 1)::double / ({_HALF} and d.f = fs.f) + ks) as p from hs, fs, ss, ks)
select round(sqrt((select sum(pow(a.p - b.p, 2)) from pf a join pf b on a.f = b.f and a.h = 0 and b.h = 1) + (select sum(pow(a.p - b.p, 2)) from ps a join ps b on a.f = b.f and a.s = b.s and a.h = 0 and b.h = 1)), 9) as distance""")
def bayes_distance(spark, sf):
    """Between the nets of the rows with even and with odd order keys."""
    df, g = table(spark, sf, "lineitem"), graphs.from_spec("l_returnflag-->l_linestatus")
    even, odd = (bayes.estimate(df.filter(F.col("l_orderkey") % 2 == k), g, 1.0) for k in (0, 1))
    return spark.createDataFrame([(round(bayes.distance(even, odd), 9),)], "distance double")


@query()
def algorithm_comparison(spark, sf):
    def draw(run: int):
        g = simulate.random_forward(6, 7, 100 + run)
        m = simulate.linear_model(g, run)
        r = np.random.default_rng(run)
        return g, pd.DataFrame(r.multivariate_normal(np.zeros(6), m.implied_covariance(), 500), columns=g.nodes)

    def cov(pdf):
        return moments.Covariance(list(pdf.columns), np.cov(pdf.to_numpy().T), len(pdf))

    c = compare.Comparison({"linear": draw}, {"pc": lambda d: search.pc_stable(independence.FisherZ(cov(d), 0.01)), "fges": lambda d: search.fges(scores.SemBic(cov(d)))}, runs=4)
    return c.tables(c.cells(spark).filter("statistic != 'E'"))


@query()
def random_graph(spark, sf):
    return simulate.random_forward_distributed(spark, 50_000, 50_000, 42)


@query(_values([("A", "B", ">", ">"), ("A", "C", ">", "o"), ("B", "D", ">", "o")], "n1, n2, end1, end2"))
def pag_of_dag(spark, sf):
    g = graphs.from_spec("Latent(L),L-->A,L-->B,C-->A,D-->B")
    return _frame(spark, graphs.dag_to_pag(g))


@query(_values([(f"X{i + 1}", f"X{j + 1}:1", ">", "-") for i, j in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2))], "n1, n2, end1, end2"))
def time_series_search(spark, sf):
    from causeway.operators.series import lag_embed

    a = np.array([[0.5, 0.0, 0.0], [0.4, 0.3, 0.0], [0.0, 0.5, 0.2]])
    data = simulate.simulate_time_series(spark, a, 2000, 3).drop("series")
    lagged = lag_embed(data, 1)
    names = [c for c in lagged.columns if c != "_row"]
    return _frame(spark, search.time_series_pc(moments.covariance_matrix(lagged, names), 0.001))


@query()
def censored_model(spark, sf):
    from causeway.operators.regression import cox

    f = cox(simulate.simulate_censored(spark, 3000, 4, [0.7, -0.4]), "survival", "event", ["X1", "X2"])
    return spark.createDataFrame([(n, float(b), float(e)) for n, b, e in zip(f.names, f.coefficients, f.errors)], "term string, coefficient double, error double")


@query("select k::int as half, (n + 1 - k) // 2 as n from (select count(*) n from orders) t, (select unnest([0, 1]) as k) u")
def complementary_halves(spark, sf):
    rows = with_row_number(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return preparation.complementary_pairs(rows, 1, 6).groupBy("half").agg(F.count("*").alias("n"))
