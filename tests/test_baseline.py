import numpy as np
import pytest

from ratelens.functions import baseline, color
from ratelens.operators import codec

MAGIC = b"IMAGE"


def _image(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([(x * 5 + y) % 256, (y * 3 + 40) % 256, 128 + 90 * np.sin(x / 7) * np.cos(y / 5)], axis=-1)
    return np.clip(base + rng.normal(0, 4, base.shape), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (7, 23), (64, 48), (33, 17)])
@pytest.mark.parametrize("layout", [0, 1, 2])
def test_round_trip(size, layout):
    h, w = size
    image = _image(h, w)
    last = None
    for quality in (5, 50, 100):
        data = baseline.encode(w, h, image.tobytes(), quality, layout, MAGIC)
        assert data[:5] == MAGIC and len(data) > baseline.HEAD_SIZE
        got = baseline.decode(data, MAGIC)
        assert got[:2] == (w, h) and len(got[2]) == 3 * w * h
        back = np.frombuffer(got[2], np.uint8).reshape(h, w, 3)
        luma = (color.ycbcr(image)[..., 0].astype(float) - color.ycbcr(back)[..., 0]) ** 2
        assert last is None or luma.mean() <= last + 1
        last = luma.mean()
    assert last < 6
    flat = np.full((h, w, 3), 77, np.uint8)
    again = baseline.decode(baseline.encode(w, h, flat.tobytes(), 90, layout, MAGIC), MAGIC)[2]
    assert np.abs(np.frombuffer(again, np.uint8).astype(int) - 77).max() <= 2


def test_symbols_restore_levels():
    """Symbols replayed one by one give the levels back, runs of 16 and more and full blocks too."""
    rng = np.random.default_rng(1)
    levels = rng.integers(-900, 900, (40, 64)) * (rng.random((40, 64)) < rng.random((40, 1)))
    levels[3, 1:], levels[4, 1:63], levels[5] = 0, 0, 1
    got = np.zeros_like(levels)
    block, at, before = -1, 64, 0
    for of_dc, s, extra, size in zip(*baseline.symbols(levels)):
        v = int(extra) if not size or extra >> (size - 1) else int(extra) - (1 << size) + 1
        if of_dc:
            assert at >= 64
            block, at, before = block + 1, 1, before + v
            got[block, 0] = before
        elif s == 0:
            at = 64
        elif s == 0xF0:
            at += 16
        else:
            at += s >> 4
            got[block, at] = v
            at += 1
    assert (got == levels).all() and block == 39


def test_bits_and_tables():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 31, 500)
    values = np.array([int(rng.integers(0, 1 << n)) if n else 0 for n in sizes])
    bits = baseline._Bits(baseline.pack_bits(values, sizes))
    assert [bits.read(int(n)) for n in sizes] == values.tolist()
    spec = ([0, 1, 2] + [0] * 13, [5, 0, 9])
    assert baseline.read_tables(baseline.tables_bytes([spec] * 4)) == ([spec] * 4, 4 * 19)
    for bad in (([3] + [0] * 15, [1, 2, 3]), ([0, 2] + [0] * 14, [1, 1]), ([0] * 16, []), ([0, 2] + [0] * 14, [1])):
        assert not baseline.valid_table(*bad)
        with pytest.raises(ValueError):
            baseline.tables_bytes([bad])


def test_sampling_repeats_the_border():
    p = np.array([[10, 20, 31], [12, 22, 33], [50, 60, 71]], np.uint8)
    assert baseline.shrink(p, 2, 2).tolist() == [[16, 32], [55, 71]]
    assert baseline.grow(np.array([[8, 16]], np.uint8), 2, 2, 2, 3).tolist() == [[8, 10, 14]] * 2
    b = baseline.split_blocks(_image(13, 9)[..., 0])
    assert b.shape == (4, 8, 8) and (baseline.join_blocks(b, 13, 9) == _image(13, 9)[..., 0]).all()
    x = np.random.default_rng(3).normal(0, 50, (5, 8, 8))
    assert np.allclose(baseline.inverse_dct(baseline.dct(x)), x)


def test_damaged_containers_are_refused():
    data = baseline.encode(16, 16, _image(16, 16).tobytes(), 75, 2, MAGIC)
    for bad in (b"", data[:5], data[:30], data[:-1], data + b"x", b"OTHER" + data[5:], data[:5] + b"\2" + data[6:], data[:6] + b"\xff" * 8 + data[14:]):
        with pytest.raises(ValueError):
            baseline.decode(bad, MAGIC)
    rng = np.random.default_rng(4)
    for _ in range(60):  # whatever the bytes are, an error or an image of the stated size
        x = bytearray(data)
        x[rng.integers(21, len(x))] ^= 1 << int(rng.integers(8))
        try:
            assert len(baseline.decode(bytes(x), MAGIC)[2]) == 768
        except ValueError:
            pass


def test_operators_don_t_depend_on_partitions(spark):
    rows = [(i, 8 + i, 9, _image(9, 8 + i, i).tobytes(), "kept") for i in range(12)] + [(90, 4, 4, b"short", "x"), (91, None, 4, None, "x")]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3]) if r[3] is not None else None, r[4]) for r in rows], "id long, width int, height int, pixels binary, content string")
    found = [{r.id: (r.content and bytes(r.content), r.error) for r in codec.encode_images(df.repartition(n), ["id"], MAGIC).collect()} for n in (1, 5)]
    assert found[0] == found[1] and {i for i, (c, _) in found[0].items() if c is None} == {90, 91}
    back = codec.decode_images(codec.encode_images(df, ["id"], MAGIC, 95, 0), ["id"], MAGIC).collect()
    assert {r.id: (r.width, r.height) for r in back if r.error is None} == {r[0]: (r[1], r[2]) for r in rows[:12]}
    assert all(np.abs(np.frombuffer(bytes(r.pixels), np.uint8).astype(int) - np.frombuffer(rows[r.id][3], np.uint8)).mean() < 6 for r in back if r.error is None)
    assert codec.encode_images(df.limit(0), ["id"], MAGIC).count() == 0
