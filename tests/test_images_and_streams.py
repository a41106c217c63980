import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ratelens.functions import color, models
from ratelens.operators.quality import pair_metrics
from ratelens.streaming.checkpoints import follow


def test_pair_metrics(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (24, 20, 3), dtype=np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-9, 10, a.shape), 0, 255).astype(np.uint8)
    rows = [(1, a.tobytes(), b.tobytes(), 20, 24), (2, a.tobytes(), a.tobytes(), 20, 24), (3, a.tobytes(), None, 20, 24), (4, a.tobytes(), b.tobytes()[:-1], 20, 24)]
    df = spark.createDataFrame(rows, "id int, reference binary, distorted binary, width int, height int")
    r = {x.id: x for x in pair_metrics(df, ["id"]).collect()}
    assert r[1].mse_rgb == pytest.approx(((a.astype(float) - b) ** 2).mean()) and 0 < r[1].ssim < 1
    assert r[2].psnr_rgb_db == float("inf") and r[2].ssim == pytest.approx(1) and r[3].ssim is None and r[4].mse_y is None


def test_colours_come_back():
    v = np.array([[r, g, b] for r in range(0, 256, 17) for g in range(0, 256, 17) for b in range(0, 256, 17)], np.uint8)
    assert np.abs(color.rgb(color.ycbcr(v)).astype(int) - v).max() <= 2
    assert color.ycbcr(np.array([[0, 0, 0], [255, 255, 255], [255, 0, 0]], np.uint8)).tolist() == [[0, 128, 128], [255, 128, 128], [76, 85, 255]]


def test_models_as_bytes_and_adaptive_coding():
    freq = [0] * 256
    for s, f in zip((0, 3, 40, 255), models.normalise_counts([9, 1, 500, 3])):
        freq[s] = f
    assert models.read_model(models.write_model(freq)) == freq
    data = bytes([0, 40, 40, 255, 3] * 50)
    coded = models.encode_adaptive(data, freq)
    assert models.decode_adaptive(coded, len(data), freq) == data
    for bad in (b"", models.write_model(freq)[:-1], models.write_model(freq) + b"\x00"):
        with pytest.raises(ValueError):
            models.read_model(bad)


def test_follow_works_on_complete_keys_once(spark, tmp_path):
    schema = StructType([StructField("image", StringType()), StructField("point", IntegerType())])
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = dict(path=str(inbox), schema=schema, key="image", parts=["point"], expected=2, store=str(tmp_path / "store"), checkpoint=str(tmp_path / "ck"), out=str(tmp_path / "out"))
    work = lambda rows: rows.groupBy("image").agg(F.count("*").alias("n"))
    for k, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [("c", 2), ("a", 2)]]):
        (inbox / f"{k}.json").write_text("\n".join(json.dumps({"image": i, "point": p}) for i, p in rows))
        follow(spark, work=work, **args)
    found = sorted((r.image, r.batch) for r in spark.read.parquet(args["out"]).collect())
    assert found == [("a", 1), ("c", 2)]


def test_integer_transforms():
    from ratelens.functions import transforms
    from ratelens.functions.scalars import fnv1a

    as_bytes = lambda n: transforms.dct_matrix(n).astype("<i2").tobytes()
    assert fnv1a(as_bytes(4) + as_bytes(16)) == 0xB17CB6D69247A7E9 and fnv1a(as_bytes(32)) == 0xB27F5DA0E4D360B1
    x = np.random.default_rng(0).integers(-255, 256, (4, 16, 16))
    assert np.abs(transforms.inverse_dct(transforms.dct(x)) - x).max() <= 1


def test_opponent_colours():
    from ratelens.functions import transforms

    v = np.stack(np.meshgrid(*[np.arange(0, 256, 17)] * 3, indexing="ij"), axis=-1).reshape(-1, 3).astype(np.uint8)
    e = transforms.from_opponent(transforms.to_opponent(v)).astype(int) - v
    assert 10 * np.log10(65025 / (e**2).mean()) == pytest.approx(46.242195944944, abs=1e-9) and np.abs(e).max() == 14
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    assert set(map(tuple, transforms.to_opponent(grey)[:, 1:].tolist())) == {(94, 115)}
