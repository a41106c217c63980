"""Sequential kernels over small integer arrays: model normalisation, canonical Huffman lengths and
byte-wise range coding. Spark distributes them one group or one row at a time."""

from __future__ import annotations

import heapq

LOW, SCALE_BITS = 1 << 23, 12


def normalise_counts(counts: list[int], scale: int = 1 << SCALE_BITS) -> list[int]:
    """Frequencies of sum `scale` for positive counts, by largest remainder with a floor of one. The
    lowest place wins ties, when one is added as when one is taken."""
    if not counts or len(counts) > scale or min(counts) < 1:
        raise ValueError("between one and `scale` positive counts are needed")
    total = sum(counts)
    freq = [max(1, c * scale // total) for c in counts]
    short = scale - sum(freq)
    step = 1 if short > 0 else -1
    # A heap in place of a scan for each unit: score is what a symbol is owed.
    heap = [(-step * (c * scale - f * total), i) for i, (c, f) in enumerate(zip(counts, freq)) if step > 0 or f > 1]
    heapq.heapify(heap)
    for _ in range(abs(short)):
        score, i = heapq.heappop(heap)
        freq[i] += step
        if step > 0 or freq[i] > 1:
            heapq.heappush(heap, (score + total, i))
    return freq


def huffman_lengths(frequencies: dict[int, int], limit: int = 16, reserved: int = 256) -> tuple[list[int], list[int]]:
    """(how many codes there are of each length 1 to limit, symbols in code order) of a canonical
    code in which one code, all ones, stays unused. Of equal frequencies the highest symbol is merged
    first; lengths over the limit are moved up as the image standards do."""
    nodes = {s: f for s, f in frequencies.items() if f > 0}
    if not nodes:
        raise ValueError("no symbol is used")
    weight = {**nodes, reserved: 1}
    members = {s: [s] for s in weight}
    size = dict.fromkeys(weight, 0)
    heap = [(f, -s) for s, f in weight.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (f1, s1), (f2, s2) = heapq.heappop(heap), heapq.heappop(heap)
        members[-s1] += members.pop(-s2)
        for s in members[-s1]:
            size[s] += 1
        heapq.heappush(heap, (f1 + f2, s1))
    longest = max(max(size.values()), limit)
    bits = [0] * (longest + 2)
    for s in size.values():
        bits[s] += 1
    for length in range(longest, limit, -1):
        while bits[length] > 0:
            shorter = next(x for x in range(length - 2, 0, -1) if bits[x])
            bits[length] -= 2
            bits[length - 1] += 1
            bits[shorter + 1] += 2
            bits[shorter] -= 1
    bits[max(i for i in range(limit + 1) if bits[i])] -= 1  # the reserved code is the last
    return bits[1 : limit + 1], sorted(nodes, key=lambda s: (size[s], s))


def huffman_codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def cumulative(freq: list[int]) -> list[int]:
    out = [0]
    for f in freq:
        out.append(out[-1] + f)
    return out


def encode_symbols(symbols: bytes, freq: list[int]) -> bytes:
    """Range-coded bytes of symbols under one model of 256 frequencies: the state is kept in
    [LOW, LOW * 256), symbols are taken from the last to the first, bytes come out reversed."""
    cum, x, out = cumulative(freq), LOW, bytearray()
    for s in reversed(symbols):
        f = freq[s]
        if not f:
            raise ValueError("a symbol has no frequency")
        top = ((LOW >> SCALE_BITS) << 8) * f
        while x >= top:
            out.append(x & 255)
            x >>= 8
        x = (x // f << SCALE_BITS) + x % f + cum[s]
    out += x.to_bytes(4, "little")
    return bytes(reversed(out))


def decode_symbols(data: bytes, n: int, freq: list[int]) -> bytes:
    """The n symbols; raises if the state doesn't end at LOW with every byte used."""
    cum = cumulative(freq)
    slot = bytearray(1 << SCALE_BITS)
    for s, f in enumerate(freq):
        slot[cum[s] : cum[s] + f] = bytes([s]) * f
    if len(data) < 4:
        raise ValueError("truncated")
    x, at, out, mask = int.from_bytes(data[:4], "big"), 4, bytearray(), (1 << SCALE_BITS) - 1
    for _ in range(n):
        low = x & mask
        s = slot[low]
        x = freq[s] * (x >> SCALE_BITS) + low - cum[s]
        while x < LOW:
            if at >= len(data):
                raise ValueError("truncated")
            x = x << 8 | data[at]
            at += 1
        out.append(s)
    if x != LOW or at != len(data):
        raise ValueError("corrupt")
    return bytes(out)


def quantile_clusters(scores: list[int], k: int = 4, rounds: int = 8) -> tuple[list[int], list[int]]:
    """(centres, level of each score): Lloyd rounds from quantile seeds with rounded integer means;
    ties to the lower level, empty levels keep their centre, stop when nothing changes."""
    ordered, n = sorted(scores), len(scores)
    if not n:
        return [], []
    centres = [ordered[min(n - 1, (2 * i + 1) * n // (2 * k))] for i in range(k)]
    level = lambda s: min(range(k), key=lambda i: (abs(s - centres[i]), i))
    for _ in range(rounds):
        sums, counts = [0] * k, [0] * k
        for s in scores:
            i = level(s)
            sums[i] += s
            counts[i] += 1
        new = [(sums[i] + counts[i] // 2) // counts[i] if counts[i] else centres[i] for i in range(k)]
        if new == centres:
            break
        centres = new
    return centres, [level(s) for s in scores]


def adapt(freq: list[int], symbol: int, shift: int = 6) -> None:
    """Moves a 2**-shift part of what other symbols have above one to `symbol`, in proportion and by
    largest remainder, ties to the lower symbol; the sum stays."""
    if freq[symbol] < 1:
        raise ValueError("a symbol has no frequency")
    spare = {s: f - 1 for s, f in enumerate(freq) if f > 1 and s != symbol}
    available = sum(spare.values())
    move = available >> shift
    if not move:
        return
    share = {s: divmod(move * c, available) for s, c in spare.items()}
    left = move - sum(q for q, _ in share.values())
    extra = sorted((s for s in spare if share[s][0] < spare[s]), key=lambda s: (-share[s][1], s))[:left]
    for s, (q, _) in share.items():
        freq[s] -= q
    for s in extra:
        freq[s] -= 1
    freq[symbol] += move


def encode_adaptive(symbols: bytes, freq: list[int], shift: int = 6) -> bytes:
    """encode_symbols() under a model that adapts after every symbol: the intervals are found
    forwards, the bytes written backwards."""
    model, spans = list(freq), []
    for s in symbols:
        spans.append((model[s], sum(model[:s])))
        adapt(model, s, shift)
    x, out = LOW, bytearray()
    for f, c in reversed(spans):
        top = ((LOW >> SCALE_BITS) << 8) * f
        while x >= top:
            out.append(x & 255)
            x >>= 8
        x = (x // f << SCALE_BITS) + x % f + c
    out += x.to_bytes(4, "little")
    return bytes(reversed(out))


def decode_adaptive(data: bytes, n: int, freq: list[int], shift: int = 6) -> bytes:
    model, out, mask = list(freq), bytearray(), (1 << SCALE_BITS) - 1
    if len(data) < 4:
        raise ValueError("truncated")
    x, at = int.from_bytes(data[:4], "big"), 4
    for _ in range(n):
        low, c, s = x & mask, 0, 0
        while c + model[s] <= low:
            c += model[s]
            s += 1
        x = model[s] * (x >> SCALE_BITS) + low - c
        while x < LOW:
            if at >= len(data):
                raise ValueError("truncated")
            x = x << 8 | data[at]
            at += 1
        out.append(s)
        adapt(model, s, shift)
    if x != LOW or at != len(data):
        raise ValueError("corrupt")
    return bytes(out)


def write_model(freq: list[int]) -> bytes:
    """A model as bytes: symbol count (256 as 0), first symbol, gaps as 4-bit codes (15: the symbol
    follows in 8 bits) packed high bits first, then all frequencies but the last in base 128."""
    used = [s for s, f in enumerate(freq) if f]
    bits = "".join(f"{b - a - 1:04b}" if b - a <= 15 else f"1111{b:08b}" for a, b in zip(used, used[1:]))
    bits += "0" * (-len(bits) % 8)
    out = bytearray([len(used) & 255, used[0]]) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    for s in used[:-1]:
        v = freq[s]
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def read_model(data: bytes, scale: int = 1 << SCALE_BITS) -> list[int]:
    """The frequencies of write_model(); raises on bytes that it would not have written."""
    try:
        count, used, bit = data[0] or 256, [data[1]], 16

        def take(n: int) -> int:
            nonlocal bit
            v = 0
            for _ in range(n):
                v = v << 1 | data[bit >> 3] >> (7 - (bit & 7)) & 1
                bit += 1
            return v

        while len(used) < count:
            code = take(4)
            used.append(used[-1] + code + 1 if code < 15 else take(8))
            if used[-1] > 255 or used[-1] <= used[-2] or code == 15 and used[-1] <= used[-2] + 15:
                raise ValueError("corrupt")
        if take(-bit % 8):
            raise ValueError("corrupt")
        at, left, freq = bit >> 3, scale, [0] * 256
        for i, s in enumerate(used[:-1]):
            v = shift = 0
            while True:
                b = data[at]
                at += 1
                v |= (b & 127) << shift
                if b < 128:
                    break
                shift += 7
            if shift and not b or not 0 < v <= left - (count - i - 1):
                raise ValueError("corrupt")
            freq[s] = v
            left -= v
        freq[used[-1]] = left
    except IndexError:
        raise ValueError("truncated") from None
    if at != len(data):
        raise ValueError("corrupt")
    return freq
