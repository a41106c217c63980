"""Token ids with a public tokenizer file, fast and with bounded memory.

The byte-level pre-tokenizer never joins text across the place where white space begins a new
piece. So a text is cut there, each different piece is encoded once by the tokenizers library and
kept, as little-endian bytes, in a table of bounded size. Regular texts (words parted by single
spaces, lines by single line feeds) are cut at spaces and their words numbered by Arrow, so that
each different word of a chunk is looked up once; others are cut by a pattern; texts with
characters on whose being white space Python and the library may disagree, or with the string of a
special token, go to the library whole. A new piece of letters, digits or punctuation alone is one
word for the library, so its model is asked directly; the others pass its pre-tokenizer first.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratelens.llm.common import append, fields, slices

_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_UNSURE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
#: What a regular text doesn't have, of what is found fast.
_IRREGULAR = ("\n\n", "\t", "\r", "\x0b", "\x0c")
#: A word of letters below U+0250 and the punctuation behind it, which the pre-tokenizer parts too.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]+)")
#: Packs so many ids.
_IDS = [struct.Struct(f"{n}I").pack for n in range(16)]
#: Pieces that the pre-tokenizer leaves whole, and how it shows bytes: those without a sign of their own from U+0100 on.
_ALONE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-/:-@\\[-`{-~]+")
_SHOWN = {b: 0x100 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Different pieces remembered by a worker, the longest piece that is, and characters worked on at once.
PIECES, PIECE_CHARS, CHUNK_CHARS = 500_000, 64, 1 << 21


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes, equal to the library's."""

    _made: dict[tuple, "Encoder"] = {}

    def __init__(self, path: str, special_as_text: bool = False, pieces: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.pieces = pieces
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        #: Strings that the library takes out of a text before it cuts it.
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        probe = ["word", "\u00c9lan", "x", "2024", "!?", "'", "\u0142\u00f3d\u017a"]
        if self._whole(probe + [" " + x for x in probe]) != self._alone(probe, "") + self._alone(probe, " "):
            self.model = None  # a tokenizer of another kind
        #: Pieces as they are, and words as they are behind a space (those with a line feed: behind that).
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @classmethod
    def of(cls, *how) -> "Encoder":
        """One for each worker and file."""
        if how not in cls._made:
            cls._made[how] = cls(*how)
        return cls._made[how]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, pieces: list[str], space: str) -> list[bytes]:
        """Ids of pieces that are one word each, behind `space`."""
        if self.model is None:
            return self._whole([space + x for x in pieces])
        ask, lead = self.model.tokenize, space.translate(_SHOWN)
        shown = [lead + (x if x.isascii() else x.encode().decode("latin-1").translate(_SHOWN)) for x in pieces]
        return [_IDS[len(ids)](*ids) if len(ids := [t.id for t in ask(x)]) < len(_IDS) else array("I", ids).tobytes() for x in shown]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        was = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the tables are large
        try:
            while len(out) < len(texts):
                i = j = len(out)
                size = 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
                    size += len(texts[j] or "")
                    j += 1
                out += self._chunk(texts[i:j])
        finally:
            if was:
                gc.enable()
        return out

    @staticmethod
    def _numbered(texts: list[str]) -> tuple[pa.ListArray, pa.DictionaryArray, list[str]] | None:
        """Regular texts cut at spaces, their words as numbers, and the different words; None if a
        text isn't regular. A line's first word holds its line feed, and each text begins with one."""
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        if not texts:
            return cut, coded, []
        # Joined and split, as Arrow makes a scalar for each value that it gives to Python.
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        bare = joined.replace("\n", "")
        return (cut, coded, joined.split(" ")) if bare.split() == bare.split(" ") else None

    def _chunk(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        regular, odd = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(c in t for c in (_UNSURE[:4] if t.isascii() else _UNSURE)) or any(x in t for x in self.special):
                out[i] = self._whole([t])[0]
            elif t[0].isspace() or t[-1].isspace() or any(x in t for x in _IRREGULAR):
                odd.append(i)
            else:
                regular.append(i)
        # Each different word of all regular texts is looked up once. What else makes a text odd is
        # sought in these words first.
        numbered = self._numbered([texts[i] for i in regular])
        if numbered is None:
            odd += [i for i in regular if texts[i].split() != texts[i].replace("\n", " ").split(" ")]
            regular = sorted(set(regular) - set(odd))
            numbered = self._numbered([texts[i] for i in regular])
        split, coded, words = numbered
        found = list(map(self.spaced.get, words))
        new = [j for j, v in enumerate(found) if v is None]
        new_lines = {words[j] for j in new if words[j][0] == "\n"}
        new_spaced = {words[j] for j in new} - new_lines
        pieces = [_PIECE.findall(texts[i]) for i in odd]
        new_plain = ({"\n"}.union(*pieces) | {x[1:] for x in new_lines}) - self.plain.keys()
        self._learn(new_plain, new_spaced)
        feed = self.plain["\n"]
        for x in new_lines:
            self.spaced[x] = feed + self.plain[x[1:]]
        for j in new:
            found[j] = self.spaced[words[j]]
        for i, p in zip(odd, pieces):
            out[i] = b"".join(map(self.plain.__getitem__, p))
        if regular:
            # All words' ids in a row, gathered from those of the different ones.
            size = np.fromiter(map(len, found), np.int32, len(found)) >> 2
            at = coded.indices.to_numpy()
            n = size[at]
            end = np.cumsum(n, dtype=np.int32)
            take = np.repeat((np.cumsum(size, dtype=np.int32) - size)[at] - (end - n), n)
            take += np.arange(len(take), dtype=np.int32)
            ids = np.frombuffer(b"".join(found), "<u4")[take]
            bounds = np.concatenate(([0], end))[split.offsets.to_numpy()].tolist()
            raw = memoryview(ids).cast("B")
            for i, s, e in zip(regular, bounds, bounds[1:]):
                out[i] = bytes(raw[4 * s + len(feed) : 4 * e])
        self._forget(new_plain, new_spaced | new_lines)
        return out

    def _learn(self, plain, spaced) -> None:
        """Encodes new pieces, those of letters and punctuation in two parts that recur more."""
        alone, rest, double = {True: set(), False: set()}, {True: [], False: []}, []
        for behind, pieces in ((False, plain), (True, spaced)):
            letters, others = alone[behind].add, rest[behind].append
            for x in pieces:
                if x.isalpha() and x.isascii():
                    letters(x)
                elif m := _WORD.fullmatch(x):
                    double.append((behind, x, *m.groups()))
                    letters(m[1])
                    alone[False].add(m[2])
                elif _ALONE.fullmatch(x):
                    letters(x)
                else:
                    others(x)
        for behind, known in ((False, self.plain), (True, self.spaced)):
            space = " " if behind else ""
            todo = [x for x in alone[behind] if x not in known]
            known.update(zip(todo, self._alone(todo, space)))
            todo = rest[behind]
            for i in range(0, len(todo), 4096):
                part = todo[i : i + 4096]
                known.update(zip(part, self._whole([space + x for x in part])))
        for behind, x, letters, marks in double:
            known = self.spaced if behind else self.plain
            known[x] = known[letters] + self.plain[marks]

    def _forget(self, plain, spaced) -> None:
        for known, pieces in ((self.plain, plain), (self.spaced, spaced)):
            for x in pieces:
                if len(x) > PIECE_CHARS:
                    known.pop(x, None)
        most = self.pieces or PIECES
        keep = most // 2  # the first met are the frequent ones
        if len(self.plain) > PIECES // 5:
            self.plain = dict(islice(self.plain.items(), PIECES // 10))
        if len(self.spaced) > most:
            self.spaced = dict(islice(self.spaced.items(), keep))


def lists(parts: list[bytes]) -> pa.Array:
    """Id bytes as an array of lists of 32-bit integers, without a Python number for each."""
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def with_ids(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", path: str | None = None, end_id: int | None = None, special_as_text: bool = False, pieces: int | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) and the token ids of the whole text (null: none), then
    end_id if one is given. A column of the output's name is replaced. A special token's string has
    that token's id, as in a plain call of the library, unless special_as_text. A worker remembers so
    many `pieces` (PIECES by default; a million take some 150 MB)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    path = path or default_path()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(path, special_as_text, pieces)
        for b in slices(batches, 512):
            ids = [x + end for x in encoder.encode_many(b.column(b.schema.get_field_index(text)).to_pylist())]
            yield append(b, keep, {out: lists(ids)})

    need = list(dict.fromkeys([*keep, text]))
    return docs.select(*need).mapInArrow(run, T.StructType([*fields(docs, keep), T.StructField(out, T.ArrayType(T.IntegerType()))]))
