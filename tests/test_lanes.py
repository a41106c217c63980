import random

import numpy as np
import pytest

from ratelens.functions import lanes, models


@pytest.mark.parametrize("few", [1, 4, 1000])
def test_lanes_give_the_bytes_of_one_by_one(few, monkeypatch):
    monkeypatch.setattr(lanes, "FEW", few)
    rng = random.Random(few)
    strings = [bytes(rng.choice(b"abcdefgh \x00\xff"[: rng.randrange(1, 11)]) for _ in range(rng.choice([0, 1, 2, 7, 40, 300]))) for _ in range(60)] + [bytes(range(256)) * 3]
    freq = lanes.models_of(strings)
    assert all(f.sum() == 4096 or not s for s, f in zip(strings, freq))
    coded = lanes.encode_lanes(strings, freq)
    for s, c, f in zip(strings, coded, freq.tolist()):
        assert c == (models.encode_symbols(s, f) if s else b"")
    assert lanes.decode_lanes(coded, list(map(len, strings)), freq) == strings
    # Bytes that are cut or changed are found out, or decode to something else, as one by one.
    broken = [c[:-1] if i % 2 else bytes([c[0] ^ 1]) + c[1:] if c else c for i, c in enumerate(coded)]
    for s, c, f, got in zip(strings, broken, freq.tolist(), lanes.decode_lanes(broken, list(map(len, strings)), freq)):
        try:
            want = models.decode_symbols(c, len(s), f) if s else b""
        except ValueError:
            want = None
        assert got == want
    assert lanes.encode_lanes([], np.zeros((0, 256), np.int64)) == [] == lanes.decode_lanes([], [], np.zeros((0, 256), np.int64))


def test_symbols_without_a_frequency_are_refused():
    freq = lanes.models_of([b"aaa"])
    with pytest.raises(ValueError):
        lanes.encode_lanes([b"ab"], freq)
