"""Image-pair metrics as a distributed operator: one pair of images is one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

METRICS = ("mse_rgb", "mse_y", "mse_cb", "mse_cr", "mse_chroma", "psnr_rgb_db", "psnr_y_db", "psnr_chroma_db", "ssim")


def pair_metrics(pairs: DataFrame, keys: list[str], reference: str = "reference", distorted: str = "distorted", width: str = "width", height: str = "height") -> DataFrame:
    """keys and METRICS of pairs of interleaved 8-bit RGB images; null where a side is missing or of
    another size. PSNR of equal images is infinite."""
    from ratelens.functions import color

    def one(a, b, w, h):
        if a is None or b is None or not w or not h or len(a) != 3 * w * h or len(b) != 3 * w * h:
            return (None,) * len(METRICS)
        x, y = (np.frombuffer(v, np.uint8).reshape(h, w, 3) for v in (a, b))
        e = color.channel_errors(x, y)
        return (*e.values(), color.psnr(e["mse_rgb"]), color.psnr(e["mse_y"]), color.psnr(e["mse_chroma"]), color.ssim(color.ycbcr(x)[..., 0], color.ycbcr(y)[..., 0]))

    def run(batches):
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            rows = [one(*r) for r in zip(get(reference), get(distorted), get(width), get(height))]
            own = [b.column(b.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], pa.float64()) for i in range(len(METRICS)))], names=[*keys, *METRICS])

    need = list(dict.fromkeys([*keys, reference, distorted, width, height]))
    schema = T.StructType([pairs.schema[k] for k in keys] + [T.StructField(m, T.DoubleType()) for m in METRICS])
    return pairs.select(*need).mapInArrow(run, schema)
