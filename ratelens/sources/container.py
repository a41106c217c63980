"""Image files and codec containers: binary scans, header parsing and feature rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])

# Feature bits by name.
FEATURES = {
    "rans": 0, "context": 1, "intra": 2, "perceptual_color": 3, "adaptive_quant": 4, "variable_transform": 5, "rdo": 6, "loop_filter": 7,
    "directional_intra": 8, "intra_4x4": 9, "contextual_rdo": 10, "perceptual_trellis": 11, "reconstruction_aware_chroma": 12, "joint_chroma_intra": 13,
    "calibrated_chroma_quant": 14, "segmentation": 15, "adaptive_loop_filter": 16,
}
# Masks of the supported bits, and what a bit needs, by format version.
SUPPORTED = {2: 0xFF, 3: 0xFC7, 4: 0x1F7C7, 5: 0xFF7C7, 6: 0x7FFF7C7, 7: 0xFFFFFFFF}
NEEDS = {
    2: {"context": ["rans"], "intra": ["rans"], "perceptual_color": ["rans"], "adaptive_quant": ["rans", "intra"], "variable_transform": ["rans", "intra"], "rdo": ["rans", "intra"], "loop_filter": ["rans", "intra"]},
    3: {"contextual_rdo": ["rdo", "context"], "perceptual_trellis": ["contextual_rdo"]},
    4: {"joint_chroma_intra": ["contextual_rdo"], "segmentation": ["calibrated_chroma_quant", "contextual_rdo"], "adaptive_loop_filter": ["segmentation", "loop_filter"]},
}


def parse_ppm(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels) of a binary P6 file of 8-bit samples; comments and white space between
    header fields are skipped; anything else raises ValueError."""
    if data[:2] != b"P6":
        raise ValueError("not P6")
    at, numbers = 2, []
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("bad header")
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = numbers
    if top != 255 or w < 1 or h < 1:
        raise ValueError("only 8-bit samples are read")
    if not data[at : at + 1].isspace():
        raise ValueError("bad header")
    pixels = data[at + 1 : at + 1 + 3 * w * h]
    if len(pixels) != 3 * w * h:
        raise ValueError("short pixel data")
    return w, h, pixels


def ppm_bytes(width: int, height: int, pixels: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (width, height) + pixels


def pgm_bytes(width: int, height: int, samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, height) + samples


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path, width, height, pixels, error (null if it was read)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((p, *parse_ppm(data), None))
                except ValueError as e:
                    rows.append((p, None, None, None, str(e)))
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=IMAGE.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGE)


def _little(content: str, offset: int, size: int) -> Column:
    return sum(F.shiftleft(F.ascii(F.decode(F.substring(content, offset + 1 + i, 1), "ISO-8859-1")).cast("long"), 8 * i) for i in range(size))


def features_valid(version: Column, flags: Column) -> Column:
    """Whether the flags are supported by the version and have what they need (versions 2 to 4 in
    full; later ones: supported bits and the rules of version 4)."""
    bit = lambda name: flags.bitwiseAND(F.lit(1 << FEATURES[name])) != 0

    def rules(*versions: int) -> Column:
        out = F.lit(True)
        for v in versions:
            for name, needed in NEEDS[v].items():
                for x in needed:
                    out = out & (~bit(name) | bit(x))
        return out

    def within(v: int) -> Column:
        return flags.bitwiseAND(F.lit(0xFFFFFFFF ^ SUPPORTED[v])) == 0

    base = bit("rans") & bit("intra")
    return (
        F.when(version == 2, within(2) & rules(2)).when(version == 3, within(3) & base & rules(3)).when(version == 4, within(4) & base & rules(3, 4))
        .when(version == 5, within(5) & base & rules(3, 4)).when(version == 6, within(6) & base & rules(3, 4)).when(version == 7, base).otherwise(F.lit(False))
    )


STATUS = ("ok", "truncated", "invalid_format", "unsupported_version", "unsupported_feature", "length")


def read_headers(df: DataFrame, magic: bytes, content: str = "content") -> DataFrame:
    """df with `header`, a struct of the 32-byte header's fields, and `status`, one of STATUS: rows
    are marked, never dropped. All little-endian, JVM only. `magic` is the five bytes that a
    container begins with."""
    n = F.octet_length(content)
    version = _little(content, 5, 1)
    fields = [("version", 5, 1), ("header_size", 6, 2), ("width", 8, 4), ("height", 12, 4), ("payload_size", 16, 4), ("flags", 20, 4), ("quality", 24, 1), ("chroma", 25, 1), ("effort", 26, 1), ("chroma_quality", 27, 1), ("metadata_size", 28, 4)]
    # An explode of one entry keeps Spark from pasting the struct into each use of a field.
    found = F.when(n >= 32, F.struct(*[_little(content, o, s).alias(name) for name, o, s in fields]))
    out = df.select(*[c for c in df.columns if c not in ("header", "status")], F.explode(F.array(found)).alias("header"))
    h = lambda c: F.col(f"header.{c}")
    supported = F.lit(True)
    for v, mask in SUPPORTED.items():
        supported = supported & ((h("version") != v) | (h("flags").bitwiseAND(F.lit(0xFFFFFFFF ^ mask)) == 0))
    calibrated = h("version").between(4, 7) & (h("flags").bitwiseAND(F.lit(1 << 14)) != 0)
    fine = (
        h("width").between(1, 2**31 - 1) & h("height").between(1, 2**31 - 1) & (h("payload_size") > 0) & (h("metadata_size") > 0) & h("quality").between(1, 100)
        & h("chroma").between(0, 2) & (h("effort") <= 9) & F.when(calibrated, h("chroma_quality").between(1, 100)).otherwise(h("chroma_quality") == 0)
        & features_valid(h("version"), h("flags"))
    )
    status = (
        F.when(n < 6, "truncated").when(F.substring(content, 1, 5) != F.lit(magic), "invalid_format").when(~version.between(1, 7), "unsupported_version")
        .when((version > 1) & (n < 32), "truncated").when((version > 1) & ~fine, F.when(supported, "invalid_format").otherwise("unsupported_feature"))
        .when((version > 1) & ((h("header_size") != 32 + h("metadata_size")) | (n != h("header_size") + h("payload_size"))), "length").otherwise("ok")
    )
    return out.withColumn("status", status)


def driver_records(lines: DataFrame, key: str, value: str = "value") -> dict[str, DataFrame]:
    """The comma records of a benchmark driver's output as typed tables, keyed by the run."""
    p = lines.select(key, F.split(F.trim(value), ",").alias("p"))
    kind = lambda name, n: p.where((F.col("p")[0] == name) & (F.size("p") == n))
    col = lambda i, t, name: F.col("p")[i].cast(t).alias(name)
    return {
        "meta": kind("meta", 12).select(key, F.slice("p", 2, 11).alias("values")),
        "calibration": kind("calibration", 4).select(key, col(1, "string", "codec"), col(2, "int", "encode_loops"), col(3, "int", "decode_loops")),
        "sample": kind("sample", 5).select(key, col(1, "string", "codec"), col(2, "int", "index"), col(3, "double", "encode_ms"), col(4, "double", "decode_ms")),
        "result": kind("result", 4).select(key, col(1, "string", "codec"), col(2, "long", "bytes"), col(3, "string", "state")),
    }
