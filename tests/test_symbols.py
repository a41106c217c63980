import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.functions import models
from ratelens.operators import blocks, symbols
from ratelens.sources import container


def _normalise(counts, scale=4096):
    total = sum(counts)
    freq = [max(1, c * scale // total) for c in counts]
    while sum(freq) != scale:
        up = sum(freq) < scale
        score = [c * scale - f * total for c, f in zip(counts, freq)]
        ok = [i for i, f in enumerate(freq) if up or f > 1]
        i = min(ok, key=lambda i: (-score[i] if up else score[i], i))
        freq[i] += 1 if up else -1
    return freq


@pytest.mark.parametrize("seed", range(6))
def test_normalisation_equals_the_unit_by_unit_rule(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 1, 2, rng.randint(1, 10 ** rng.randint(1, 6))]) for _ in range(rng.randint(1, 250))]
    want = _normalise(counts)
    assert models.normalise_counts(counts) == want
    df = spark.createDataFrame([("m", i, c) for i, c in enumerate(counts)], "model string, symbol int, n long")
    rows = symbols.normalise(df, ["model"]).orderBy("symbol").collect()
    assert [r.freq for r in rows] == want and [r.cum for r in rows] == models.cumulative(want)[:-1]


def test_range_coder_round_trip_and_checks():
    rng = random.Random(3)
    data = bytes(rng.choice(b"aaaaabbbc\x00\xff") for _ in range(5000))
    freq = [0] * 256
    used = sorted(set(data))
    for s, f in zip(used, models.normalise_counts([data.count(s) for s in used])):
        freq[s] = f
    coded = models.encode_symbols(data, freq)
    assert models.decode_symbols(coded, len(data), freq) == data and len(coded) < len(data) / 2
    with pytest.raises(ValueError):
        models.decode_symbols(coded + b"\x00", len(data), freq)
    with pytest.raises(ValueError):
        models.decode_symbols(coded[:-1], len(data), freq)


def test_huffman_is_a_prefix_code_within_the_limit():
    freq = {i: 2**i for i in range(24)}
    bits, order = models.huffman_lengths(freq)
    codes = models.huffman_codes(bits, order)
    assert len(codes) == 24 and max(n for _, n in codes.values()) <= 16
    words = sorted(format(c, f"0{n}b") for c, n in codes.values())
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert all("0" in w for w in words)  # all ones stay reserved
    assert models.huffman_lengths({7: 5}) == ([1] + [0] * 15, [7])


def test_zero_runs_rebuild_the_block(spark):
    rng = random.Random(5)
    rows = []
    for b in range(12):
        for p in range(64):
            rows.append((b, p, rng.choice([0] * (b * 2) + [rng.randint(-40, 40)]) if b else 0))
    df = spark.createDataFrame(rows, "b int, pos int, v int")
    tokens = symbols.zero_run_tokens(df, ["b"], "pos", "v").orderBy("b", "pos", "sub").collect()
    for b in range(12):
        out, at = [0] * 64, 1
        for t in (t for t in tokens if t.b == b):
            if t.symbol == 0:
                break
            if t.symbol == 0xF0:
                at += 16
                continue
            at += t.symbol >> 4
            n = t.symbol & 15
            out[at] = t.amp if t.amp >> (n - 1) else t.amp - (1 << n) + 1
            at += 1
        assert out[1:] == [v for x, p, v in rows if x == b and p]


def test_block_transforms_equal_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-128, 128, (3, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, block array<long>")
    k = np.arange(8)
    d = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    h = np.array([[(-1) ** bin(a & b).count("1") for b in range(8)] for a in range(8)])
    for r in df.select("i", blocks.dct8("block").alias("c"), blocks.satd("block").alias("s")).collect():
        m = x[r.i].reshape(8, 8)
        assert np.allclose(np.array(r.c).reshape(8, 8), d @ m @ d.T)
        assert r.s == np.abs(h @ m @ h.T).sum()


def test_zigzag_and_table():
    z = blocks.zigzag()
    assert sorted(z) == list(range(64)) and z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert blocks.scaled_table(50) == blocks.LUMA and set(blocks.scaled_table(100)) == {1} and max(blocks.scaled_table(1)) == 255


def test_odd_sizes_are_clamped(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (5, 7))
    df = spark.createDataFrame([(y, x, int(g[y, x])) for y in range(5) for x in range(7)], "y int, x int, v long")
    p = np.pad(g, ((0, 1), (0, 1)), mode="edge")
    for r in blocks.downsample(df, [], "y", "x", "v", 7, 5).collect():
        assert r.v == (p[2 * r.y : 2 * r.y + 2, 2 * r.x : 2 * r.x + 2].sum() + 2) // 4


def test_segments(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 1, 2, 50, 51, 100, 101, 400])], "k string, i int, s long")
    r = blocks.segments(df, ["k"], "i", "s").orderBy("i").collect()
    assert [x.level for x in r] == sorted(x.level for x in r) and {x.level for x in r} <= {0, 1, 2, 3}


def test_ppm(spark, tmp_path):
    pixels = bytes(range(36))
    (tmp_path / "a.ppm").write_bytes(container.ppm_bytes(4, 3, pixels))
    (tmp_path / "b.ppm").write_bytes(b"P6 # note\n4 # more\n3\n255\n" + pixels)
    (tmp_path / "c.ppm").write_bytes(b"P6\n4 3\n65535\n" + pixels)
    (tmp_path / "d.ppm").write_bytes(container.ppm_bytes(4, 3, pixels)[:-1])
    (tmp_path / "e.ppm").write_bytes(b"P5\n1 1\n255\n.")
    rows = {r.path[-5]: r for r in container.read_ppm(spark, f"{tmp_path}/*.ppm").collect()}
    assert bytes(rows["a"].pixels) == bytes(rows["b"].pixels) == pixels and (rows["a"].width, rows["a"].height) == (4, 3)
    assert all(rows[x].pixels is None and rows[x].error for x in "cde")


def test_headers_are_marked_and_kept(spark):
    def header(version=7, w=4, h=3, flags=5, payload=2, meta=3, magic=b"MAGIC"):
        return magic + bytes([version]) + (32 + meta).to_bytes(2, "little") + b"".join(x.to_bytes(4, "little") for x in (w, h, payload, flags)) + bytes([50, 2, 3, 0]) + meta.to_bytes(4, "little") + bytes(meta + payload)

    rows = [(0, header()), (1, b"MAG"), (2, header(magic=b"OTHER")), (3, header(version=9)), (4, header(w=0)), (5, header(version=2, flags=1 << 20)), (6, header() + b"x"), (7, header()[:20]), (8, None)]
    df = spark.createDataFrame(rows, "i int, content binary")
    found = {r.i: r.status for r in container.read_headers(df, b"MAGIC").collect()}
    assert [found[i] for i in range(8)] == ["ok", "truncated", "invalid_format", "unsupported_version", "invalid_format", "unsupported_feature", "length", "truncated"]
    r = container.read_headers(df, b"MAGIC").where("i = 0").select("header.*").first()
    assert (r.width, r.height, r.flags, r.quality) == (4, 3, 5, 50)


def test_contiguous_and_records(spark):
    from ratelens.operators import matching

    lines = spark.createDataFrame([("r", "sample,a,0,1.5,2"), ("r", " sample,a,2,1.5,2 "), ("r", "meta,1"), ("r", "result,a,99,ok"), ("r", "")], "run string, value string")
    t = container.driver_records(lines, "run")
    assert t["meta"].count() == 0 and t["result"].first().bytes == 99
    assert matching.contiguous(t["sample"], ["run", "codec"], "index").first().ok is False
    assert t["sample"].agg(F.sum("encode_ms")).first()[0] == 3.0


def test_differences_over_spans_are_those_of_one_run(spark):
    import random

    from pyspark.sql import functions as F

    from ratelens.operators import symbols

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i * 7 % 200, rng.randrange(-50, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    whole = symbols.differences(df, ["k"], ["at"], "v")
    spans = symbols.differences(df, ["k"], ["at"], "v", F.floor(F.col("at") / 13))
    assert whole.columns == spans.columns and sorted(map(str, whole.collect())) == sorted(map(str, spans.collect()))


def test_maps_come_back(spark):
    import random

    from ratelens.operators import symbols

    rng = random.Random(5)
    rows = [(k, r, c, rng.randrange(4)) for k in range(3) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(rows, "k long, r long, c long, level long")
    got = symbols.restored_map(symbols.predicted_map(df, ["k"], "r", "c", "level", 1, 4).drop("level"), ["k"], "r", "c", "delta", 1, 4)
    assert sorted((x.k, x.r, x.c, x.level) for x in got.collect()) == rows
    bits = symbols.mode_switches(df.selectExpr("k", "r", "c", "cast(level > 1 as int) as bit"), ["k"], "r", "c", "bit").collect()
    at = {(x.k, x.r, x.c): x for x in bits}
    for (k, r, c), x in at.items():
        before = at.get((k, r, c - 1)) or at.get((k, r - 1, c))
        assert x.delta == x.bit ^ (before.bit if before else 0)
