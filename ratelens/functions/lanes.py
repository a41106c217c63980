"""Range coding of many byte strings at once: one state a string, a NumPy step for all of them.

The bytes are those of encode_symbols() and decode_symbols() in models.py. Strings are ordered by
length, so that a step works on a prefix of the lanes; what a few long strings have beyond the others
is cheaper one by one."""

from __future__ import annotations

import numpy as np

from ratelens.functions.models import LOW, SCALE_BITS

#: Lanes below which a step of NumPy costs more than a loop over them.
FEW = 32
_TOP, _MASK = (LOW >> SCALE_BITS) << 8, (1 << SCALE_BITS) - 1


def models_of(strings: list[bytes]) -> np.ndarray:
    """(n, 256) frequencies of sum 4096 for each string's own bytes, none for an empty one: the
    largest remainders get what is left over, and the least owed give what is too much."""
    from ratelens.functions.models import normalise_counts

    out = np.zeros((len(strings), 256), np.int64)
    for i, x in enumerate(strings):
        if x:
            n = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
            used = np.flatnonzero(n)
            out[i, used] = normalise_counts(n[used].tolist())
    return out


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings from the longest to the shortest, and for each step how many are still at work."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -np.arange(longest), "left")


def encode_lanes(strings: list[bytes], freq: np.ndarray) -> list[bytes]:
    if not strings:
        return []
    lengths = np.array(list(map(len, strings)))
    order, active = _lanes(lengths)
    data = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
    size = lengths[order]
    last = np.cumsum(size) - 1
    f = freq[order]
    cum = np.concatenate((np.zeros((len(order), 1), np.int64), np.cumsum(f, axis=1)[:, :-1]), axis=1)
    if (np.take_along_axis(f.ravel(), np.repeat(np.arange(len(order)) * 256, size) + data, 0) < 1).any():
        raise ValueError("a symbol has no frequency")
    x = np.full(len(order), LOW, np.int64)
    # A symbol gives two bytes at most.
    room = 2 * size + 8
    begin = np.concatenate(([0], np.cumsum(room)[:-1]))
    out, at = np.zeros(int(room.sum()), np.uint8), begin.copy()
    flat, base = f.ravel(), np.arange(len(order)) * 256
    steps = int((active >= FEW).sum())
    for j in range(steps):
        k = active[j]
        i = base[:k] + data[last[:k] - j]
        g, s = flat[i], x[:k]
        for _ in range(2):
            m = np.flatnonzero(s >= _TOP * g)
            if not len(m):
                break
            out[at[m]] = s[m] & 255
            at[m] += 1
            s[m] >>= 8
        q = s // g
        x[:k] = (q << SCALE_BITS) + s - q * g + cum.ravel()[i]
    result: list = [b""] * len(strings)
    for lane, i in enumerate(order.tolist()):
        if not lengths[i]:
            continue
        done = out[begin[lane] : at[lane]].tobytes()
        state, more = int(x[lane]), bytearray()
        if lengths[i] > steps:
            own, before = f[lane].tolist(), cum[lane].tolist()
            for s in reversed(strings[i][: lengths[i] - steps]):
                g = own[s]
                while state >= _TOP * g:
                    more.append(state & 255)
                    state >>= 8
                state = (state // g << SCALE_BITS) + state % g + before[s]
        result[i] = (done + bytes(more) + state.to_bytes(4, "little"))[::-1]
    return result


def decode_lanes(coded: list[bytes], lengths: list[int], freq: np.ndarray) -> list[bytes | None]:
    """The strings; None where the bytes end too soon or the state doesn't end where it began."""
    n = np.array(lengths)
    order, active = _lanes(n)
    f = freq[order]
    cum = np.concatenate((np.zeros((len(order), 1), np.int64), np.cumsum(f, axis=1)), axis=1)
    slots = np.zeros((len(order), 1 << SCALE_BITS), np.uint8)
    for lane, i in enumerate(order.tolist()):
        if lengths[i]:
            slots[lane] = np.repeat(np.arange(256, dtype=np.uint8), f[lane])
    sizes = np.array([len(coded[i]) for i in order])
    data = np.frombuffer(b"".join(coded[i] for i in order) + b"\0", np.uint8)
    end = np.cumsum(sizes)
    at = end - sizes + 4
    x = np.array([int.from_bytes(coded[i][:4], "big") for i in order], np.int64)
    short = sizes < 4
    first = np.concatenate(([0], np.cumsum(n[order])[:-1])) if len(order) else np.zeros(0, np.int64)
    out = np.zeros(int(n.sum()), np.uint8)
    lanes = np.arange(len(order))
    steps = int((active >= FEW).sum())
    for j in range(steps):
        k = active[j]
        low = x[:k] & _MASK
        s = slots[lanes[:k], low]
        out[first[:k] + j] = s
        y = f[lanes[:k], s] * (x[:k] >> SCALE_BITS) + low - cum[lanes[:k], s]
        for _ in range(2):
            m = np.flatnonzero(y < LOW)
            if not len(m):
                break
            over = at[m] >= end[m]
            short[m[over]] = True
            y[m] = y[m] << 8 | np.where(over, 0, data[np.minimum(at[m], len(data) - 1)])
            at[m] += 1
        x[:k] = y
    result: list = [b""] * len(coded)
    for lane, i in enumerate(order.tolist()):
        if not lengths[i]:
            continue
        state, place, tail, bad = int(x[lane]), int(at[lane]), bytearray(), bool(short[lane])
        if lengths[i] > steps and not bad:
            own, before, slot, stop = f[lane].tolist(), cum[lane].tolist(), slots[lane].tobytes(), int(end[lane])
            for _ in range(lengths[i] - steps):
                low = state & _MASK
                s = slot[low]
                state = own[s] * (state >> SCALE_BITS) + low - before[s]
                while state < LOW and not bad:
                    bad = place >= stop
                    state = state << 8 | int(data[place])
                    place += 1
                if bad:
                    break
                tail.append(s)
        whole = not bad and state == LOW and place == end[lane]
        result[i] = out[first[lane] : first[lane] + min(steps, lengths[i])].tobytes() + bytes(tail) if whole else None
    return result
