"""Queries over files, digests, masks and coded bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import matching
from ratelens.plans.evidence import _t
from ratelens.plans.registry import query
from ratelens.sources import container

_MAGIC = b"IMAGE"


def _le(v: str, size: int) -> str:
    return " || ".join(f"printf('%02X', ({v} >> {8 * i}) & 255)" for i in range(size))


@query("q28_header_parse", """
with o as (select o_orderkey, o_custkey % 9 as version, o_orderkey % 5000 as width, o_custkey % 3000 as height, o_orderkey % 97 + 1 as payload, o_orderkey % 101 as quality, o_custkey % 4 as chroma, o_orderkey % 11 as effort, o_custkey % 13 as meta,
  case o_orderkey % 4 when 0 then 199 when 1 then 1991 when 2 then 1 else 4096 end as flags, (o_custkey % 5 = 0)::integer as cut, o_orderkey % 29 = 0 as wrong from orders),
s as (select *, case version when 2 then 255 when 3 then 4039 when 4 then 128967 when 5 then 1046471 when 6 then 134215623 else 4294967295 end as mask from o),
v as (select *, flags & 4294967295 & ~mask::bigint = 0 as supported, case flags when 199 then version between 2 and 7 when 1991 then version between 3 and 7 when 1 then version = 2 else false end as valid from s)
select o_orderkey, case when wrong then 'invalid_format' when version not between 1 and 7 then 'unsupported_version'
  when version = 1 then 'ok' when not (width >= 1 and height >= 1 and meta > 0 and quality between 1 and 100 and chroma <= 2 and effort <= 9 and valid)
  then case when supported then 'invalid_format' else 'unsupported_feature' end when cut = 1 then 'length' else 'ok' end as status,
  cast(width as bigint) as width, cast(height as bigint) as height, cast(flags as bigint) as flags from v""")
def header_parse(spark, sf_dir):
    byte = lambda v, size: [F.expr(f"lpad(hex(shiftright({v}, {8 * i}) & 255), 2, '0')") for i in range(size)]
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("o_custkey % 9").alias("version"), F.expr("o_orderkey % 5000").alias("width"), F.expr("o_custkey % 3000").alias("height"), F.expr("o_orderkey % 97 + 1").alias("payload"),
        F.expr("o_orderkey % 101").alias("quality"), F.expr("o_custkey % 4").alias("chroma"), F.expr("o_orderkey % 11").alias("effort"), F.expr("o_custkey % 13").alias("meta"),
        F.expr("case o_orderkey % 4 when 0 then 199L when 1 then 1991L when 2 then 1L else 4096L end").alias("flags"), F.expr("if(o_custkey % 5 = 0, 1L, 0L)").alias("cut"), F.expr("o_orderkey % 29 = 0").alias("wrong"),
    )
    size = F.expr("cast(payload + meta - cut as int)")
    text = F.concat(
        F.when(F.col("wrong"), F.lit(b"OTHER".hex().upper())).otherwise(F.lit(_MAGIC.hex().upper())), *byte("version", 1), *byte("(32 + meta)", 2), *byte("width", 4), *byte("height", 4),
        *byte("payload", 4), *byte("flags", 4), *byte("quality", 1), *byte("chroma", 1), *byte("effort", 1), F.lit("00"), *byte("meta", 4), F.repeat(F.lit("00"), size),
    )
    h = container.read_headers(o.select("o_orderkey", F.unhex(text).alias("content")), _MAGIC)
    return h.select("o_orderkey", "status", "header.width", "header.height", "header.flags")


@query("q29_digest_inventory", """
with a as (select doc_id, sha256(text) as digest from documents), c as (select digest, count(*) as n, min(doc_id) as first from a group by digest)
select digest, n, first, case when n > 1 then 'repeated' else 'single' end as kind from c""")
def digest_inventory(spark, sf_dir):
    a = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return a.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).withColumn("kind", F.when(F.col("n") > 1, "repeated").otherwise("single"))


@query("q30_line_protocol", """
with e as (select user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as i, value from events where value is not null)
select user_id, event_type as codec, count(*) as n, round(sum(round(value, 3)), 3) as total, true as ok from e group by all""")
def line_protocol(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value is not null")
    e = e.withColumn("i", F.expr("row_number() over (partition by user_id, event_type order by ts, event_id) - 1"))
    lines = e.select("user_id", F.concat_ws(",", F.lit("sample"), "event_type", "i", F.round("value", 3), F.lit("1.0")).alias("value"))
    s = container.driver_records(lines, "user_id")["sample"]
    ok = matching.contiguous(s, ["user_id", "codec"], "index")
    total = s.groupBy("user_id", "codec").agg(F.round(F.sum("encode_ms"), 3).alias("total"))
    return ok.join(total, ["user_id", "codec"]).select("user_id", "codec", "n", "total", "ok")


_FORBIDDEN = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}|[Ll]icen[cs]ed?"


@query("q31_forbidden_tokens", f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)
select doc_id, cast(line as integer) as line, regexp_extract(s, '({_FORBIDDEN})', 1) as found from l where regexp_matches(s, '{_FORBIDDEN}')""")
def forbidden_tokens(spark, sf_dir):
    return matching.forbidden_lines(_t(spark, sf_dir, "documents"), "doc_id", "text", _FORBIDDEN)


def _mask_sql() -> str:
    def rules(*versions: int) -> str:
        out = ["true"]
        for v in versions:
            for name, needed in container.NEEDS[v].items():
                out += [f"(flags & {1 << container.FEATURES[name]} = 0 or flags & {1 << container.FEATURES[x]} <> 0)" for x in needed]
        return " and ".join(out)

    within = lambda v: f"flags & {0xFFFFFFFF ^ container.SUPPORTED[v]} = 0"
    base = "flags & 1 <> 0 and flags & 4 <> 0"
    return f"""
with f as (select l_orderkey, l_linenumber, 2 + (l_partkey % 6) as version, (l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296 & case when l_suppkey % 2 = 0 then 8191 else 131071 end | 5 as flags from lineitem)
select version, cast(flags & 7 as bigint) as low, case version when 2 then {within(2)} and {rules(2)} when 3 then {within(3)} and {base} and {rules(3)} when 4 then {within(4)} and {base} and {rules(3, 4)}
  when 5 then {within(5)} and {base} and {rules(3, 4)} when 6 then {within(6)} and {base} and {rules(3, 4)} else {base} end as valid, count(*) as n from f group by all"""


@query("q32_feature_masks", _mask_sql())
def feature_masks(spark, sf_dir):
    f = _t(spark, sf_dir, "lineitem").select(
        F.expr("2 + (l_partkey % 6)").alias("version"),
        F.expr("(l_orderkey * 2654435761L + l_partkey * 40503L) % 4294967296L & if(l_suppkey % 2 = 0, 8191L, 131071L) | 5L").alias("flags"),
    )
    return f.groupBy("version", F.expr("flags & 7L").alias("low"), container.features_valid(F.col("version"), F.col("flags")).alias("valid")).agg(F.count("*").alias("n"))


@query("q33_range_coder_roundtrip")
def range_coder_roundtrip(spark, sf_dir):
    """Every whole text coded under its own normalised byte model and decoded again: sizes and
    whether the bytes came back."""
    import pyarrow as pa

    def run(batches):
        from ratelens.functions.lanes import decode_lanes, encode_lanes, models_of

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                freq = models_of(data)
                coded = encode_lanes(data, freq)
                back = decode_lanes(coded, list(map(len, data)), freq)
                sizes = [pa.array(list(map(len, x)), pa.int64()) for x in (data, coded)]
                yield pa.RecordBatch.from_arrays([b.column(0), *sizes, pa.array([x == y for x, y in zip(data, back)])], names=["doc_id", "n_bytes", "n_coded", "same"])

    return _t(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_coded long, same boolean")
