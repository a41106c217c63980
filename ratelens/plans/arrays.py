"""Queries over symbol sequences, grids and blocks, each with SQL for the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ratelens.operators import blocks, codec, monitor, quality, search, symbols
from ratelens.plans.evidence import _t
from ratelens.plans.registry import query


@query("q13_histogram", """
with n as (select event_type as model, cast(floor(value) as bigint) % 16 as symbol, count(*) as n from events group by all)
select m as model, coalesce(symbol, 0) as symbol, coalesce(n, 1) as n from (values ('signup'), ('purchase'), ('error'), ('view'), ('click'), ('idle')) as d(m) left join n on model = m""")
def histogram(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("symbol", F.floor("value") % 16)
    return symbols.histogram(e, "event_type", "symbol", ["signup", "purchase", "error", "view", "click", "idle"])


_COUNTS = "c as (select event_type as model, cast(user_id % 48 as integer) as symbol, cast(count(*) as bigint) as n from events group by all)"


def _counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 48).cast("int").alias("symbol")).agg(F.count("*").alias("n"))


@query("q14_normalise_4096", f"""
with {_COUNTS}, t as (select *, sum(n) over (partition by model) as total from c), b as (select *, greatest(1, n * 4096 // total) as base from t),
s as (select *, 4096 - sum(base) over (partition by model) as short, n * 4096 - base * total as score from b),
p as (select *, row_number() over (partition by model order by score desc, symbol) as place from s)
select model, symbol, n, cast(base + case when place <= short then 1 else 0 end as bigint) as freq,
  cast(coalesce(sum(base + case when place <= short then 1 else 0 end) over (partition by model order by symbol rows between unbounded preceding and 1 preceding), 0) as bigint) as cum from p""")
def normalise(spark, sf_dir):
    return symbols.normalise(_counts(spark, sf_dir), ["model"])


@query("q15_cost_table", f"""
with {_COUNTS} select model, symbol, round(-log2((n + 0.25) / (sum(n) over (partition by model) + 0.25 * count(*) over (partition by model))), 9) as bits from c""")
def cost_table(spark, sf_dir):
    return symbols.cost_table(_counts(spark, sf_dir), ["model"]).withColumn("bits", F.round("bits", 9))


_AMP = "case when {v} < 0 then {v} + cast(pow(2, {b}) as bigint) - 1 else {v} end"
_BITS = "case when {v} = 0 then 0 else length(bin(abs({v}))) end"


@query("q16_dc_delta", f"""
with d as (select event_id, event_type, cast(floor(value) as bigint) - lag(cast(floor(value) as bigint), 1, 0) over (partition by event_type order by ts, event_id) as delta from events),
b as (select *, {_BITS.format(v='delta')} as bits from d) select event_id, event_type, delta, bits, {_AMP.format(v='delta', b='bits')} as amp from b""")
def dc_delta(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.floor("value").cast("long").alias("dc"))
    return symbols.differences(e, ["event_type"], ["ts", "event_id"], "dc", F.to_date("ts")).select("event_id", "event_type", "delta", F.col("bits").cast("long").alias("bits"), "amp")


_LEVELS = """v as (select o_orderkey // 64 as block, cast(o_orderkey % 64 as integer) as pos, cast(case when o_custkey % 5 = 0 then cast(floor(o_totalprice / 1000) as bigint) % 41 - 20 else 0 end as bigint) as v from orders),
nz as (select block, pos, v, pos - coalesce(lag(pos) over (partition by block order by pos), 0) - 1 as run from v where v <> 0 and pos > 0),
tok as (select block, pos, cast(run // 16 as integer) as sub, cast((run % 16) * 16 + length(bin(abs(v))) as integer) as symbol, cast(length(bin(abs(v))) as integer) as bits, case when v < 0 then v + cast(pow(2, length(bin(abs(v)))) as bigint) - 1 else v end as amp from nz
  union all select block, pos, cast(i as integer), 240, 0, 0 from nz, range(4) as r(i) where i < run // 16
  union all select block, 64, 0, 0, 0, 0 from v group by block having coalesce(max(pos) filter (where v <> 0 and pos > 0), 0) < 63)"""


def _tokens(spark, sf_dir):
    v = F.when(F.col("o_custkey") % 5 == 0, F.floor(F.col("o_totalprice") / 1000) % 41 - 20).otherwise(0)
    o = _t(spark, sf_dir, "orders").select(F.expr("o_orderkey div 64").alias("block"), (F.col("o_orderkey") % 64).alias("pos"), v.alias("v"))
    return symbols.zero_run_tokens(o, ["block"], "pos", "v")


@query("q17_zero_run_tokens", f"with {_LEVELS} select * from tok")
def zero_run_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir)


@query("q18_map_predict", """
with g as (select l_suppkey as r, l_linenumber as c, cast(max(l_quantity) as integer) % 4 as level from lineitem group by all)
select r, c, level, ((level - coalesce(lag(level) over (partition by r order by c), lag(level) over (partition by c order by r), 1)) % 4 + 4) % 4 as delta from g""")
def map_predict(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("c")).agg((F.max("l_quantity").cast("int") % 4).alias("level"))
    return symbols.predicted_map(g, [], "r", "c", "level", 1, 4)


@query("q19_context_model", f"""
with {_LEVELS}, p as (select *, lag(pos, 1, 0) over (partition by block order by pos, sub) as pp, coalesce(lag(bits) over (partition by block order by pos, sub), 0) >= 3 as active from tok),
f as (select *, max(case when sub = 0 then pp + 1 end) over (partition by block, pos) + 16 * sub as start from p)
select (case when start >= 28 then 3 when start >= 15 then 2 when start >= 6 then 1 else 0 end) * 2 + cast(active as integer) as model, symbol, count(*) as n from f group by all""")
def context_model(spark, sf_dir):
    return symbols.contexts(_tokens(spark, sf_dir), ["block"]).groupBy("model", "symbol").agg(F.count("*").alias("n"))


def _ycc_sql(name: str, w: tuple) -> str:
    k = [int(abs(x) * 65536 + 0.5) * (1 if x >= 0 else -1) for x in w]
    return f"cast(greatest(0, least(255, (r * ({k[0]}) + g * ({k[1]}) + b * ({k[2]}) + {32768 + (0 if name == 'y' else 128 << 16)}) >> 16)) as integer) as {name}"


@query("q21_colour_transform", "with p as (select p_partkey, cast(p_partkey * 7 % 256 as bigint) as r, cast(p_size * 5 % 256 as bigint) as g, cast(cast(floor(p_retailprice) as bigint) % 256 as bigint) as b from part) select p_partkey, "
       + ", ".join(_ycc_sql(n, w) for n, w in zip(("y", "cb", "cr"), blocks.WEIGHTS)) + " from p")
def colour_transform(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("r"), (F.col("p_size") * 5 % 256).cast("long").alias("g"), (F.floor("p_retailprice") % 256).alias("b"))
    return p.select("p_partkey", blocks.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b")).alias("o")).select("p_partkey", "o.*")


_CELLS = "e as (select vec_id, i - 1 as i, cast(round(embedding[i] * 128) as bigint) as v from embeddings, range(1, 65) as t(i))"
_DCT = "(case when {u} = 0 then sqrt(1.0 / 8) else 0.5 end) * cos((2 * {x} + 1) * {u} * " + repr(math.pi) + " / 16)"
_COEF = f"""rows_ as (select vec_id, i // 8 as y, u, sum({_DCT.format(u='u', x='(i % 8)')} * v) as t from e, range(8) as f(u) group by all),
coef as (select vec_id, w * 8 + u as i, sum({_DCT.format(u='w', x='y')} * t) as c from rows_, range(8) as f(w) group by all)"""


def _blocks(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 128).cast("long")).alias("block"))


@query("q22_dct8", f"with {_CELLS}, {_COEF} select vec_id, i, round(c, 6) + 0 as c from coef")
def dct8(spark, sf_dir):
    c = _blocks(spark, sf_dir).select("vec_id", F.posexplode(blocks.dct8("block")).alias("i", "c"))
    return c.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("c", 6) + 0).alias("c"))


@query("q23_hadamard_satd", f"""
with {_CELLS}, r as (select vec_id, i // 8 as y, u, sum((1 - 2 * (bit_count((i % 8) & u) % 2)) * v) as t from e, range(8) as f(u) group by all),
h as (select vec_id, w, u, sum((1 - 2 * (bit_count(y & w) % 2)) * t) as c from r, range(8) as f(w) group by all)
select vec_id, cast(sum(abs(c)) as bigint) as satd from h group by vec_id""")
def hadamard_satd(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", blocks.satd("block").alias("satd"))


_ZZ, _TABLE = blocks.zigzag(), blocks.scaled_table(30)


@query("q24_quantise_zigzag", f"""
with {_CELLS}, {_COEF}, s as (select vec_id, p, cast(floor(round(c * 4, 6) + 0.5) as bigint) as c, q from coef join (select unnest({_ZZ}) as i, unnest(range(64)) as p) z using (i)
  join (select unnest(range(64)) as i, unnest({_TABLE}) as q) t using (i)),
l as (select vec_id, p, cast(sign(c) * ((abs(c) + q // 2) // q) as integer) as level from s)
select vec_id, list(level order by p) as levels, cast(sum(case when level <> 0 then case when p = 63 then (-9223372036854775807 - 1)::hugeint else (1::bigint << p)::hugeint end else 0 end) as bigint) as mask, cast(count(*) filter (where level <> 0) as bigint) as used from l group by vec_id""")
def quantise_zigzag(spark, sf_dir):
    c = _blocks(spark, sf_dir).select("vec_id", F.transform(blocks.dct8("block"), lambda x: F.floor(F.round(x * 4, 6) + 0.5).cast("long")).alias("c"))
    q = c.select("vec_id", blocks.quantise("c", _TABLE).alias("levels"))
    return q.select("vec_id", "levels", blocks.nonzero_mask("levels").alias("mask"), F.size(F.filter("levels", lambda x: x != 0)).cast("long").alias("used"))


_GRID = "g as (select l_suppkey // 16 as plane, l_suppkey % 16 as y, l_linenumber - 1 as x, cast(max(l_quantity) as bigint) as v from lineitem group by all)"


@query("q25_downsample_upsample", f"""
with {_GRID}, d as (select plane, y // 2 as y, x // 2 as x, sum(v * case when x = 6 then 2 else 1 end) as s, sum(case when x = 6 then 2 else 1 end) as n from g group by all),
m as (select plane, y, x, (s + n // 2) // n as v from d), w as (select *, lag(v, 1, v) over (partition by plane, y order by x) as a, lead(v, 1, v) over (partition by plane, y order by x) as b from m)
select cast(plane as bigint) as plane, cast(y as bigint) as y, cast(x * 2 as bigint) as x, cast(3 * v + a as bigint) as v from w union all select plane, y, x * 2 + 1, 3 * v + b from w""")
def downsample_upsample(spark, sf_dir):
    """Every 16 suppliers are a plane of 16 rows and 7 columns."""
    at = F.col("l_suppkey")
    g = _t(spark, sf_dir, "lineitem").groupBy(F.floor(at / 16).alias("plane"), (at % 16).alias("y"), (F.col("l_linenumber") - 1).alias("x")).agg(F.max("l_quantity").cast("long").alias("v"))
    d = blocks.downsample(g, ["plane"], "y", "x", "v", 7, 16)
    return blocks.upsample_row(d, ["plane"], "y", "x", "v").select(*[F.col(c).cast("long").alias(c) for c in ("plane", "y", "x", "v")])


@query("q26_activity_levels", """
with d as (select l_suppkey, abs(q - 2 * lag(q, 1) over w + lag(q, 2) over w) as m from (select l_suppkey, l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as q from lineitem) window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, q)),
s as (select l_suppkey, sum(case when m > 32 then 32 else m end) as s, count(m) as n from d group by l_suppkey),
a as (select l_suppkey, cast(case when n = 0 then 0 else (s * 256 + n // 2) // n end as bigint) as score from s)
select l_suppkey, score, case when score < 512 then 0 when score < 2048 then 1 when score < 4608 then 2 else 3 end as level from a""")
def activity_levels(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return blocks.activity(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "q"], "q")


@query("q27_segmentation_means")
def segmentation(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("score", F.round(F.col("p_retailprice") * 16))
    return blocks.segments(p, ["p_brand"], "p_partkey", "score")


@query("q42_cpu_rates", """
with s as (select user_id % 7 as host, user_id as pid, cast(floor(epoch(ts)) as bigint) // 3600 as hour, event_id % 3 as started, cast(max(event_id) as bigint) as ticks from events group by all),
r as (select host, pid, hour, greatest(0, (ticks - lag(ticks) over w) / (100.0 * (hour - lag(hour) over w))) as cores, lag(hour) over w as before from s window w as (partition by host, pid, started order by hour))
select host, hour as at, count(*) filter (where cores >= 0.5) as busy, round(sum(cores), 6) as cores, count(*) filter (where cores >= 0.5) > 0 or sum(cores) >= 1 as disturbed from r where before is not null group by host, hour""")
def cpu_rates(spark, sf_dir):
    """Users are processes of seven hosts, event numbers their ticks, hours the snapshots."""
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), F.col("user_id").alias("pid"), F.expr("unix_timestamp(ts) div 3600").alias("at"), (F.col("event_id") % 3).alias("started"), "event_id")
    s = e.groupBy("host", "pid", "at", "started").agg(F.max("event_id").cast("long").alias("ticks"))
    d = monitor.disturbances(monitor.cpu_rates(s, ["host"]), ["host"])
    return d.select("host", "at", "busy", F.round("cores", 6).alias("cores"), "disturbed")


@query("q43_best_layout", """
with c as (select l_partkey, l_linenumber % 3 as layout, cast(sum(l_quantity) as bigint) as sse, cast(sum(l_suppkey) as bigint) as size from lineitem group by all),
k as (select *, 100 * sse + 255 * 4 * size * 8 as cost from c), r as (select *, row_number() over (partition by l_partkey order by cost, size, layout) as place from k)
select l_partkey, cast(layout as integer) as layout, sse, size, cast(cost as bigint) as cost from r where place = 1""")
def best_layout(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") % 3).cast("int").alias("layout")).agg(F.sum("l_quantity").cast("long").alias("sse"), F.sum("l_suppkey").cast("long").alias("size"))
    k = c.withColumn("cost", search.image_cost(F.col("sse"), F.lit(2).cast("long"), F.col("size") * 8))
    return search.best_layout(k, ["l_partkey"], "cost", "size", "layout")


@query("q44_smooth_plane", """
with g as (select l_suppkey // 16 as plane, l_suppkey % 16 as y, l_linenumber - 1 as x, cast(max(l_quantity) as bigint) as v from lineitem group by all),
h as (select *, lag(v, 1, v) over (partition by plane, y order by x) + v + lead(v, 1, v) over (partition by plane, y order by x) as h from g),
d as (select *, lag(h, 1, h) over (partition by plane, x order by y) + h + lead(h, 1, h) over (partition by plane, x order by y) - 9 * v as d from h),
s as (select plane, y, x, v, cast(v + floor((d + 18) / 36.0) as bigint) as w from d)
select cast(plane as bigint) as plane, count(*) as n, round(cast(sum((v - w) * (v - w)) as double), 6) as sse, round(sum((v - w) * (v - w)) / count(*), 9) as mse,
  case when sum((v - w) * (v - w)) > 0 then round(10 * log10(65025 * count(*) / sum((v - w) * (v - w))), 8) end as psnr_db, cast(sum(w) as bigint) as total from s group by plane""")
def smooth_plane(spark, sf_dir):
    """Smoothed planes of 16 suppliers, and how far they are from the planes before."""
    g = _t(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_suppkey") / 16).alias("plane"), (F.col("l_suppkey") % 16).alias("y"), (F.col("l_linenumber") - 1).alias("x")).agg(F.max("l_quantity").cast("long").alias("v"))
    s = blocks.smooth(g.withColumn("w", F.col("v")), ["plane"], "y", "x", "w").join(g, ["plane", "y", "x"])
    e = blocks.errors(s, ["plane"], "v", "w").join(s.groupBy("plane").agg(F.sum("w").alias("total")), "plane")
    return e.select("plane", "n", F.round("sse", 6).alias("sse"), F.round("mse", 9).alias("mse"), F.round("psnr_db", 8).alias("psnr_db"), "total")


@query("q45_baseline_images")
def baseline_images(spark, sf_dir):
    """Vectors as 8 x 8 images in grey, coded and decoded: sizes, and how far the samples moved."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + x * 100).cast("int")))).alias("s"))
    hexed = F.array_join(F.transform("s", lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), 3)), "")
    images = v.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexed).alias("pixels"))
    files = codec.encode_images(images, ["vec_id"], b"IMAGE", 90, 2)
    back = codec.decode_images(files, ["vec_id"], b"IMAGE").withColumnsRenamed({"pixels": "got", "error": "failed", "width": "w", "height": "h"})
    both = quality.pair_metrics(images.join(back, "vec_id"), ["vec_id"], "pixels", "got")
    return both.join(files.select("vec_id", F.octet_length("content").cast("long").alias("n_bytes")), "vec_id").select("vec_id", "n_bytes", F.round("mse_y", 6).alias("mse_y"), F.round("ssim", 6).alias("ssim"))


@query("q46_map_restore", """
with g as (select l_suppkey as r, l_linenumber as c, cast(max(l_quantity) as bigint) % 4 as level from lineitem group by all)
select r, c, level from g""")
def map_restore(spark, sf_dir):
    """Maps of levels, predicted and restored: 16 suppliers a map."""
    g = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("c")).agg((F.max("l_quantity").cast("long") % 4).alias("level"))
    p = symbols.predicted_map(g.withColumn("plane", F.floor(F.col("r") / 16)), ["plane"], "r", "c", "level", 1, 4).drop("level")
    return symbols.restored_map(p, ["plane"], "r", "c", "delta", 1, 4).select("r", "c", "level")


@query("q47_bit_map_switches", """
with g as (select l_suppkey as r, l_linenumber as c, cast(max(l_quantity) > 45 as integer) as bit from lineitem group by all)
select r, c, bit, xor(bit, coalesce(lag(bit) over (partition by r order by c), lag(bit) over (partition by c order by r), 0)) as delta from g""")
def bit_map_switches(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("c")).agg((F.max("l_quantity") > 45).cast("int").alias("bit"))
    return symbols.mode_switches(g, [], "r", "c", "bit")


@query("q48_adaptive_costs", """
with t as (select event_type as model, cast(user_id % 16 as integer) as symbol, row_number() over (partition by event_type, user_id % 5 order by ts, event_id) - 1 as seen, count(*) over (partition by event_type) as n,
  row_number() over (partition by event_type, user_id % 16 order by ts, event_id) - 1 as before, row_number() over (partition by event_type order by ts, event_id) - 1 as place, count(*) over (partition by event_type, user_id % 16) as uses from events),
c as (select model, count(*) as n, sum(-log2(uses * 1.0 / n)) as fixed_bits, sum(-log2((before + 1.0) / (place + 16.0))) as adaptive_bits from t group by model)
select model, n, round(fixed_bits, 6) as fixed_bits, round(adaptive_bits, 6) as adaptive_bits, n > 1 and adaptive_bits + 1 < fixed_bits as adaptive from c""")
def adaptive_costs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", "ts", "event_id", (F.col("user_id") % 16).cast("int").alias("symbol"))
    c = symbols.adaptive_choice(e, ["event_type"], ["ts", "event_id"], "symbol", 16)
    return c.select(F.col("event_type").alias("model"), "n", F.round("fixed_bits", 6).alias("fixed_bits"), F.round("adaptive_bits", 6).alias("adaptive_bits"), "adaptive")
