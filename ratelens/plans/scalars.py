"""Queries over scalar rules, top-2, moments and code tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelens.functions import scalars
from ratelens.operators import blocks
from ratelens.plans.evidence import _t
from ratelens.plans.registry import query


@query("q34_plane_geometry", """
with p as (select l_orderkey, l_linenumber, l_partkey % 4000 + 1 as w, l_suppkey % 3000 + 1 as h, case l_linenumber % 3 when 0 then 444 when 1 then 422 else 420 end as mode from lineitem)
select mode, cast(sum(case when mode = 444 then w else (w + 1) // 2 end) as bigint) as cw, cast(sum(case when mode = 420 then (h + 1) // 2 else h end) as bigint) as ch, cast(sum(((w + 7) // 8) * ((h + 7) // 8)) as bigint) as cells, cast(sum((w + 15) // 16) as bigint) as regions from p group by mode""")
def plane_geometry(spark, sf_dir):
    w, h = F.col("l_partkey") % 4000 + 1, F.col("l_suppkey") % 3000 + 1
    p = _t(spark, sf_dir, "lineitem").select(w.alias("w"), h.alias("h"), F.expr("case l_linenumber % 3 when 0 then 444 when 1 then 422 else 420 end").alias("mode"))
    p = p.withColumn("c", scalars.chroma_size(F.col("w"), F.col("h"), F.col("mode")))
    cells = scalars.halves_up(F.col("w"), 8) * scalars.halves_up(F.col("h"), 8)
    return p.groupBy("mode").agg(F.sum("c.cw").alias("cw"), F.sum("c.ch").alias("ch"), F.sum(cells).alias("cells"), F.sum(scalars.halves_up(F.col("w"), 16)).alias("regions"))


@query("q35_filter_strength", """
with p as (select o_orderkey, o_orderkey % 103 as q, o_custkey % 3 as plane, o_custkey % 4 as level from orders), b as (select *, (119 - q) // 20 as base from p where q between 1 and 100),
a as (select *, case when level = 0 and base > 1 then base - 1 when level = 3 then base + 1 else base end as s from b),
c as (select *, least(5, case when plane <> 0 and s > 1 then (s * 3 + 2) // 4 else s end) as t from a),
r as (select q, plane, level, cast(case when q >= 96 then 0 else t end as integer) as strength, cast(greatest(3, ((3 + (103 - q) // 4) * case level when 0 then 90 when 1 then 97 when 2 then 108 else 118 end + 50) // 100) as integer) as threshold from c
  union all select q, plane, level, -1, null from p where q not between 1 and 100)
select strength, threshold, count(*) as n from r group by all""")
def filter_strength(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 103).alias("q"), (F.col("o_custkey") % 3).alias("plane"), (F.col("o_custkey") % 4).alias("level"))
    t = F.when(F.col("q").between(1, 100), scalars.edge_threshold(F.col("q"), F.col("level")))
    p = p.select(scalars.filter_strength(F.col("q"), F.col("plane"), F.col("level")).alias("strength"), t.alias("threshold"))
    return p.groupBy("strength", "threshold").agg(F.count("*").alias("n"))


@query("q36_best_and_runner_up", """
with r as (select p_brand, p_partkey, round(p_retailprice, 2) as score, row_number() over (partition by p_brand order by round(p_retailprice, 2), p_partkey) as place from part)
select p_brand, max(p_partkey) filter (where place = 1) as best, max(p_partkey) filter (where place = 2) as runner_up, round(max(score) filter (where place = 2) - max(score) filter (where place = 1), 2) as gap from r where place <= 2 group by p_brand""")
def best_and_runner_up(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("score"))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("score", "p_partkey"))).where("place <= 2")
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return p.groupBy("p_brand").agg(at(1, "p_partkey").alias("best"), at(2, "p_partkey").alias("runner_up"), F.round(at(2, "score") - at(1, "score"), 2).alias("gap"))


@query("q37_coefficient_moments", """
with e as (select label, i - 1 as position, cast(round(embedding[i] * 128) as bigint) as v from embeddings, range(1, 65) as t(i))
select label, position, count(*) as n, cast(sum(v) as bigint) as s, cast(sum(v * v) as bigint) as s2, cast(sum(abs(v)) as bigint) as sa from e group by all""")
def coefficient_moments(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    v = F.round(F.col("x").cast("double") * 128).cast("long")
    return e.groupBy("label", F.col("position").cast("long").alias("position")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.sum(F.abs(v)).alias("sa"))


@query("q38_throughput", """
with o as (select o_orderpriority, round(sum(o_totalprice) / 1e6, 6) as mpix, cast(sum(o_custkey) as double) as ms, count(*) as n from orders group by 1)
select o_orderpriority, n, round(1000 * mpix / ms, 9) as mpix_s, round(ms / n, 6) as mean_ms, case when ms / n > 0 then (case when (ms / n - 100) / 100 * 100 >= 0 then '+' else '' end) || printf('%.2f', (ms / n - 100) / 100 * 100) || '%' end as shown from o""")
def throughput(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("mpix"), F.sum("o_custkey").cast("double").alias("ms"), F.count("*").alias("n"))
    mean = F.col("ms") / F.col("n")
    return o.select("o_orderpriority", "n", F.round(1000 * F.col("mpix") / F.col("ms"), 9).alias("mpix_s"), F.round(mean, 6).alias("mean_ms"), scalars.percentage((mean - 100) / 100 * 100).alias("shown"))


@query("q39_huffman_tables")
def huffman_tables(spark, sf_dir):
    """Canonical code of each event type's symbols: symbol, n, code, bits."""
    from ratelens.functions.models import huffman_codes, huffman_lengths

    c = _t(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 64).cast("int").alias("symbol")).agg(F.count("*").alias("n"))

    def run(pdf):
        codes = huffman_codes(*huffman_lengths(dict(zip(pdf["symbol"].tolist(), pdf["n"].tolist()))))
        return pdf.assign(code=[codes[s][0] for s in pdf["symbol"]], bits=[codes[s][1] for s in pdf["symbol"]])

    return c.groupBy("event_type").applyInPandas(run, "event_type string, symbol int, n long, code int, bits int")


_STEPS = [blocks.scaled_table(q)[0] for q in range(1, 101)]


@query("q40_quant_steps", f"""
select cast(p_size as bigint) as quality, count(*) as n, cast(list_extract({_STEPS}, p_size) as integer) as step from part where p_size between 1 and 100 group by p_size""")
def quant_steps(spark, sf_dir):
    p = _t(spark, sf_dir, "part").where("p_size between 1 and 100").groupBy(F.col("p_size").cast("long").alias("quality")).agg(F.count("*").alias("n"))
    return p.select("quality", "n", scalars.quant_step(F.col("quality")).alias("step"))
