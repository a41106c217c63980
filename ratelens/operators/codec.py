"""Baseline coding of images as distributed operators: one image is one row, whatever the partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _each(df: DataFrame, keys: list[str], need: list[str], one, out: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """keys and what one(*need) gives, row by row in short Arrow batches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # images are large
                b = batch.slice(at, 16)
                rows = [one(*r) for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in need))]
                own = [b.column(b.schema.get_field_index(k)) for k in keys]
                made = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(out)]
                yield pa.RecordBatch.from_arrays(own + made, names=[*keys, *(n for n, _, _ in out)])

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t, _ in out])
    return df.select(*dict.fromkeys([*keys, *need])).mapInArrow(run, schema)


def encode_images(images: DataFrame, keys: list[str], magic: bytes, quality: int = 75, layout: int = 2, width: str = "width", height: str = "height", pixels: str = "pixels") -> DataFrame:
    """keys, content (a version 1 container) and error (null if it was coded; nulls and pixels of
    another size are errors)."""

    def one(w, h, data):
        from ratelens.functions import baseline

        try:
            if not w or not h or data is None:
                raise ValueError("no image")
            return baseline.encode(w, h, data, quality, layout, magic), None
        except ValueError as e:
            return None, str(e)

    return _each(images, keys, [width, height, pixels], one, [("content", T.BinaryType(), pa.binary()), ("error", T.StringType(), pa.string())])


def decode_images(files: DataFrame, keys: list[str], magic: bytes, content: str = "content") -> DataFrame:
    """keys, width, height, pixels (interleaved 8-bit RGB) and error (null if it was read)."""

    def one(data):
        from ratelens.functions import baseline

        try:
            if data is None:
                raise ValueError("no data")
            return (*baseline.decode(data, magic), None)
        except ValueError as e:
            return None, None, None, str(e)

    return _each(files, keys, [content], one, [("width", T.IntegerType(), pa.int32()), ("height", T.IntegerType(), pa.int32()), ("pixels", T.BinaryType(), pa.binary()), ("error", T.StringType(), pa.string())])
