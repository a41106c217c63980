"""Queries over measurement-shaped tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions.workers import importable
from ratelens.operators import curves, matching, statistics
from ratelens.plans.registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Five operating points for each return flag: weight, value and size of every line."""
    return _t(spark, sf_dir, "lineitem").select(
        *extra, F.col("l_returnflag").alias("codec"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("point"),
        (F.col("l_linenumber") + 1).alias("w"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("b"),
    )


_POINTS = """points as (select l_returnflag as codec, l_linestatus as status, cast(ceil(l_quantity / 10) as integer) as point, l_linenumber + 1 as w,
  l_quantity as v, l_extendedprice as b from lineitem),
curve as (select status, codec, point, 8 * sum(b) / sum(w) as rate, sum(w * v) / sum(w) as quality from points group by all)"""


@query("q01_weighted_curve", """
with points as (select l_returnflag as codec, cast(ceil(l_quantity / 10) as integer) as point, l_linenumber + 1 as w, l_quantity as v, l_extendedprice as b from lineitem)
select codec, point, round(8 * sum(b) / sum(w), 4) as rate, round(sum(w * v) / sum(w), 8) as quality, round(10 * log10(65025 / (sum(w * v) / sum(w))), 8) as db
from points group by codec, point""")
def weighted_curve(spark, sf_dir):
    p = _points(spark, sf_dir)
    plain = curves.weighted_curve(p, ["codec", "point"], "w", "v", "b")
    return plain.select("codec", "point", F.round("rate", 4).alias("rate"), F.round("quality", 8).alias("quality"), F.round(curves.mse_to_db(F.col("quality")), 8).alias("db"))


_FRONT = """u as (select {k}, quality, min(rate) as rate from {t} where rate > 0 group by {k}, quality),
d as (select *, min(rate) over (partition by {k} order by quality desc rows between unbounded preceding and 1 preceding) as least from u),
e as (select {k}, quality, rate from d where least is null or rate < least),
f as (select *, max(rate) over (partition by {k} order by quality rows between unbounded preceding and 1 preceding) as most from e),
front as (select {k}, quality, rate from f where most is null or rate > most)"""


@query("q02_pareto_frontier", "with p as (select p_brand, cast(p_size as double) as quality, p_retailprice as rate from part), "
       + _FRONT.format(k="p_brand", t="p") + " select * from front")
def pareto_frontier(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("quality"), F.col("p_retailprice").alias("rate"))
    return curves.pareto_frontier(p, ["p_brand"])


def _bd_sql(keys: str, source: str) -> str:
    """Monotone cubic integration in SQL over a table c(keys.., codec, quality, rate)."""
    k = keys + ", " if keys else ""
    on = "".join(f" and a.{x.strip()} is not distinct from s.{x.strip()}" for x in keys.split(",") if x.strip())
    end = lambda h0, d0, h1, d1: (
        f"case when sign(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})) <> sign({d0}) then 0.0 when sign({d0}) <> sign({d1}) and "
        f"abs(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})) > 3 * abs({d0}) then 3 * {d0} else ((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}) end"
    )
    w = f"over (partition by {k}codec order by quality)"
    area = " + ".join(f"c{i} * (pow(least(high, x0 + h) - x0, {i + 1}) - pow(greatest(low, x0) - x0, {i + 1})) / {i + 1}" for i in range(4))
    return f"""
{source}, {_FRONT.format(k=k + "codec", t="c")},
g1 as (select {k}codec, quality as x, ln(rate) as y, count(*) over (partition by {k}codec) as n, lead(quality) {w} - quality as h,
  (lead(ln(rate)) {w} - ln(rate)) / (lead(quality) {w} - quality) as d from front),
g2 as (select *, lag(h) over q as hp, lag(d) over q as dp, lead(h) over q as hn, lead(d) over q as dn, lag(h, 2) over q as hpp, lag(d, 2) over q as dpp
  from g1 where n >= 3 window q as (partition by {k}codec order by x)),
g3 as (select *, case when hp is null then {end('h', 'd', 'hn', 'dn')} when h is null then {end('hp', 'dp', 'hpp', 'dpp')}
  when dp * d <= 0 then 0.0 else 3 * (hp + h) / ((2 * h + hp) / dp + (h + 2 * hp) / d) end as m from g2),
g4 as (select *, lead(m) over (partition by {k}codec order by x) as m1 from g3),
seg as (select {k}codec, x as x0, h, y as c0, m as c1, (3 * d - 2 * m - m1) / h as c2, (m + m1 - 2 * d) / (h * h) as c3 from g4 where h is not null),
span as (select {k}codec, min(quality) as lo, max(quality) as hi, count(*) as n from front group by {k}codec),
pairs as (select {", ".join("s." + x.strip() for x in keys.split(",")) + ", " if keys else ""}s.codec,
  case when s.n >= 3 and a.n >= 3 and least(s.hi, a.hi) - greatest(s.lo, a.lo) > 1e-9 then greatest(s.lo, a.lo) end as low,
  case when s.n >= 3 and a.n >= 3 and least(s.hi, a.hi) - greatest(s.lo, a.lo) > 1e-9 then least(s.hi, a.hi) end as high
  from span s left join span a on a.codec = 'R'{on} where s.codec <> 'R'),
parts as (select {", ".join("p." + x.strip() for x in keys.split(",")) + ", " if keys else ""}p.codec, case when s.codec = 'R' then -1 else 1 end * ({area}) as v
  from pairs p join seg s on s.codec in ('R', p.codec){on.replace('a.', 'p.')} where x0 < high and x0 + h > low),
total as (select {k}codec, sum(v) as v from parts group by {k}codec)
select {", ".join("p." + x.strip() for x in keys.split(",")) + ", " if keys else ""}p.codec as candidate, 'R' as anchor, round((exp(v / (high - low)) - 1) * 100, 6) as bd_rate_pct, round(low, 8) as low, round(high, 8) as high
from pairs p left join total s on s.codec = p.codec{on.replace('a.', 'p.')}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"bd_rate_pct": F.round("bd_rate_pct", 6), "low": F.round("low", 8), "high": F.round("high", 8)})


@query("q03_bd_rate", _bd_sql("", """with points as (select l_returnflag as codec, cast(ceil(l_quantity / 10) as integer) as point, l_linenumber + 1 as w, l_quantity as v, l_extendedprice as b from lineitem),
c as (select codec, 8 * sum(b) / sum(w) as rate, sum(w * v) / sum(w) as quality from points group by codec, point)"""))
def bd_rate(spark, sf_dir):
    c = curves.weighted_curve(_points(spark, sf_dir), ["codec", "point"], "w", "v", "b")
    return _rounded(curves.bd_rate(c, [], "codec", "R"))


@query("q04_omission_sensitivity", _bd_sql("omitted_point", """with points as (select l_returnflag as codec, cast(ceil(l_quantity / 10) as integer) as point, l_linenumber + 1 as w, l_quantity as v, l_extendedprice as b from lineitem),
whole as (select codec, point, 8 * sum(b) / sum(w) as rate, sum(w * v) / sum(w) as quality from points group by codec, point),
c as (select o as omitted_point, codec, quality, rate from whole, (values (2), (3), (4)) as omit(o) where point <> o)"""))
def omission_sensitivity(spark, sf_dir):
    c = curves.weighted_curve(_points(spark, sf_dir), ["codec", "point"], "w", "v", "b")
    return _rounded(curves.omission_sensitivity(c, [], "codec", "point", [2, 3, 4], "R"))


@query("q05_percentile_interval", """
select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) as low, round(quantile_cont(l_extendedprice, 0.975), 6) as high,
  round(quantile_cont(l_extendedprice, 0.05 / 14), 6) as family_low, round(quantile_cont(l_extendedprice, 1 - 0.05 / 14), 6) as family_high
from lineitem group by l_returnflag""")
def percentile_interval(spark, sf_dir):
    at = {"low": 0.025, "high": 0.975, "family_low": 0.05 / 14, "family_high": 1 - 0.05 / 14}
    p = statistics.percentiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", at)
    return p.select("l_returnflag", *[F.round(c, 6).alias(c) for c in at])


@query("q06_median_ratio", """
with m as (select c_mktsegment, o_custkey, o_orderpriority, median(o_totalprice) as m from orders join customer on c_custkey = o_custkey group by all),
b as (select c_mktsegment, o_custkey, max(m) filter (where o_orderpriority = '1-URGENT') as c, max(m) filter (where o_orderpriority = '5-LOW') as a from m group by all)
select c_mktsegment, count(*) as units, round((sum(c) / sum(a) - 1) * 100, 6) as ratio_pct, round(exp(avg(ln(c / a))), 8) as geo_ratio, round(min(c / a), 8) as least_ratio, round(max(c / a), 8) as most_ratio
from b where c is not null and a is not null group by c_mktsegment""")
def median_ratio(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    r = statistics.median_ratio(o, ["c_mktsegment"], "o_custkey", "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW")
    return r.select("c_mktsegment", "units", F.round("ratio_pct", 6).alias("ratio_pct"), *[F.round(c, 8).alias(c) for c in ("geo_ratio", "least_ratio", "most_ratio")])


_ELIGIBLE = """p as (select o_custkey, max(o_totalprice) filter (where o_orderpriority = '1-URGENT') as cs, max(o_totalprice) filter (where o_orderpriority = '5-LOW') as a_s,
  bool_or(o_orderstatus <> 'P') filter (where o_orderpriority = '1-URGENT') as cm, bool_or(o_orderstatus <> 'P') filter (where o_orderpriority = '5-LOW') as am from orders group by o_custkey),
r as (select o_custkey, case when cs is null or a_s is null then 'missing' when not (cm and am) then 'unmatched' when abs(cs - a_s) > 0.5 * a_s then 'tolerance' end as reason, cs, a_s from p)"""


@query("q07_eligible_pairs", f"with {_ELIGIBLE} select coalesce(reason, 'eligible') as reason, count(*) as n from r group by 1")
def eligible_pairs(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("whole", F.col("o_orderstatus") != "P")
    r = matching.eligible_pairs(o, ["o_custkey"], "o_orderpriority", "1-URGENT", "5-LOW", "whole", "o_totalprice", 0.5)
    return r.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("q08_common_subset", """
select l_orderkey, count(*) as n from lineitem where l_orderkey in (select l_orderkey from lineitem where l_quantity > 5 and l_returnflag in ('A', 'N', 'R') group by 1 having count(distinct l_returnflag) = 3) group by 1""")
def common_subset(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    keys = matching.common_subset(li, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], F.col("l_quantity") > 5)
    return li.join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("q09_completeness_audit", """
with e as (select n_nationkey as nation, s as segment from nation, (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('GALAXY')) as v(s)),
a as (select c_nationkey as nation, c_mktsegment as segment, count(*) as n from customer group by all)
select coalesce(e.nation, a.nation) as nation, coalesce(e.segment, a.segment) as segment, coalesce(n, 0) as n,
  case when n is null then 'missing' when e.nation is null then 'unexpected' else 'duplicate' end as problem
from e full join a on e.nation = a.nation and e.segment = a.segment where n is null or e.nation is null or n > 1""")
def completeness_audit(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    expected = nations.withColumn("segment", F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "GALAXY")))))
    actual = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return matching.completeness(expected, actual, ["nation", "segment"])


_TARGETS = """p as (select p_brand, p_retailprice as spot, p_partkey from part), t as (select p_brand, min(spot) + q * (max(spot) - min(spot)) as target, q from p, (values (0.25), (0.5), (0.75)) as v(q) group by p_brand, q),
x as (select p.p_brand, spot, p_partkey, target from p join t using (p_brand))"""


@query("q10_bracket_search", f"""
with {_TARGETS}, w as (select p_brand, target, spot as low_at, lead(spot) over (partition by p_brand, target order by spot) as high_at from x),
b as (select p_brand, target, min(low_at) as low_at, min(high_at) as high_at from w where low_at <= target and target <= high_at group by all),
n as (select p_brand, target, spot, p_partkey, row_number() over (partition by p_brand, target order by round(abs(spot - target), 9), p_partkey) as r,
  row_number() over (partition by p_brand, target order by round(abs(ln(spot) - ln(target)), 9), p_partkey) as l from x)
select b.p_brand, round(b.target, 6) as target, low_at, high_at, n.p_partkey as nearest, m.p_partkey as nearest_log
from b join n on n.p_brand = b.p_brand and n.target = b.target and n.r = 1 join n m on m.p_brand = b.p_brand and m.target = b.target and m.l = 1""")
def bracket_search(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("at"), "p_partkey")
    span = p.groupBy("p_brand").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    targets = span.select("p_brand", F.explode(F.array(*[F.col("lo") + q * (F.col("hi") - F.col("lo")) for q in (0.25, 0.5, 0.75)])).alias("target"))
    x = p.join(targets, "p_brand")
    b = matching.brackets(x, ["p_brand"], "at", "target")
    near = matching.nearest(x, ["p_brand"], "at", "p_partkey", "target").select("p_brand", "target", F.col("p_partkey").alias("nearest"))
    log = matching.nearest(x, ["p_brand"], "at", "p_partkey", "target", log=True).select("p_brand", "target", F.col("p_partkey").alias("nearest_log"))
    return b.join(near, ["p_brand", "target"]).join(log, ["p_brand", "target"]).withColumn("target", F.round("target", 6))


@query("q11_bootstrap_means", """
with u as (select c_mktsegment as s, c_custkey as id, c_acctbal as v, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as place, count(*) over (partition by c_mktsegment) as n from customer),
d as (select r as replicate, s, cast('0x' || substr(md5(concat(r, ':', s, ':', place)), 1, 15) as bigint) % n as drawn from u, range(50) as t(r))
select replicate, round(sum(v) / count(*), 6) as mean from d join u on u.s = d.s and u.place = d.drawn group by replicate""")
def bootstrap_means(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return statistics.bootstrap_means(c, "c_mktsegment", "c_custkey", "c_acctbal", 50).select(F.col("replicate").cast("long").alias("replicate"), F.round("mean", 6).alias("mean"))


_DRAW = "cast('0x' || substr(md5(concat({parts})), 1, 15) as bigint) % {n}"


def _draw(n: str, *parts: str) -> str:
    return _DRAW.format(n=n, parts=", ':', ".join(parts))


@query("q41_nested_bootstrap", f"""
with t as (select l_suppkey as unit, l_returnflag as s, l_linenumber % 3 as block, row_number() over (partition by l_suppkey, l_returnflag, l_linenumber % 3 order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i,
  l_extendedprice as c, l_quantity * 1000 as a from lineitem), k as (select * from t where i < 4),
u as (select s, unit, row_number() over (partition by s order by unit) - 1 as place, count(*) over (partition by s) as n from (select distinct s, unit from k)),
d as (select r as replicate, s, place as slot, {_draw('n', 'r', 's', 'place')} as drawn from u, range(20) as x(r)),
e as (select replicate, d.s, slot, u.unit, {_draw('3', 'replicate', 'd.s', 'slot', 'b')} as block, b from d join u on u.s = d.s and u.place = d.drawn, range(3) as x(b)),
f as (select replicate, s, slot, unit, block, {_draw('4', 'replicate', 's', 'slot', 'b', 'r')} as i from e, range(4) as x(r)),
m as (select replicate, f.s, slot, median(c) as c, median(a) as a from f join k on k.unit = f.unit and k.s = f.s and k.block = f.block and k.i = f.i group by all)
select replicate, round((sum(c) / sum(a) - 1) * 100, 6) as change_pct from m group by replicate""")
def nested_bootstrap(spark, sf_dir):
    """Suppliers' items of one flag are a unit, line numbers modulo 3 its blocks, four items of each its repetitions."""
    t = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", F.format_string("%06d", "l_suppkey")).alias("unit"), F.col("l_returnflag").alias("s"), (F.col("l_linenumber") % 3).alias("block"),
        F.expr("row_number() over (partition by l_suppkey, l_returnflag, l_linenumber % 3 order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1").alias("i"),
        F.col("l_extendedprice").alias("c"), (F.col("l_quantity") * 1000).alias("a"),
    )
    found = statistics.nested_bootstrap(t.where("i < 4"), "s", "unit", "block", "i", "c", "a", 3, 4, 20)
    return found.select(F.col("replicate").cast("long").alias("replicate"), F.round("change_pct", 6).alias("change_pct"))


@query("q12_won_tied_lost", f"""
with {_ELIGIBLE}, v as (select o_custkey % 7 as bunch, case when reason is null then round(cs / a_s - 1, 6) end as v from r),
s as (select bunch, count(*) filter (where v < -1e-9) as won, count(*) filter (where abs(v) <= 1e-9) as tied, count(*) filter (where v > 1e-9) as lost, count(*) filter (where v is null) as missing,
  median(v) as median_value, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from v group by bunch)
select bunch, won, tied, lost, missing, round(median_value, 8) as median_value, case when high < 0 then 'lower_rate' when low > 0 then 'higher_rate' else 'inconclusive' end as conclusion from s""")
def won_tied_lost(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("whole", F.col("o_orderstatus") != "P")
    at = lambda p: F.max(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    r = matching.eligible_pairs(o, ["o_custkey"], "o_orderpriority", "1-URGENT", "5-LOW", "whole", "o_totalprice", 0.5)
    sizes = o.groupBy("o_custkey").agg(at("1-URGENT").alias("cs"), at("5-LOW").alias("s"))
    v = r.join(sizes, "o_custkey").select((F.col("o_custkey") % 7).alias("bunch"), F.when(F.col("reason").isNull(), F.round(F.col("cs") / F.col("s") - 1, 6)).alias("v"))
    counts = statistics.won_tied_lost(v, ["bunch"], "v")
    ci = statistics.percentile_interval(v, ["bunch"], "v")
    return counts.join(ci, "bunch").select("bunch", "won", "tied", "lost", "missing", F.round("median_value", 8).alias("median_value"), statistics.conclusion(F.col("low"), F.col("high"), F.lit(1), F.lit(1)).alias("conclusion"))


@query("q20_noise_group_filter", """
select event_type, count(*) as n, round(sum(value), 4) as total from events e
where not exists (select 1 from events x where x.user_id = e.user_id and x.ts::date = e.ts::date and x.event_type = 'error') group by event_type""")
def noise_group_filter(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = matching.drop_disturbed(e, ["user_id", "day"], F.col("event_type") == "error")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
