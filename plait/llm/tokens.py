"""Token ids of texts by the tokenizers library, with a cache of words.

Most public tokenizers drop white space and never join what stands on its two
sides. Their ids of a text are then the ids of its words one after another, and a
word that was seen before is only looked up, all words of a stretch of text at once by
array operations. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import slices

# The word pattern for which splitting at white space is known to be exact.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words, and runs that they are put together from, held by one Python worker; beyond
# that it starts anew.
CACHED_WORDS = 1_000_000
CACHED_UNITS = 200_000

# Bytes of text that are looked up at a time.
SLICE = 1 << 19

# Any odd number does; equal sums are told apart by their bytes.
BASE = 0x9E3779B97F4A7C15

# Latin letters that stay one letter when composed and put in lower case
# (U+00C0 to U+024F without the two signs and the dotted capital I).
_LETTER = (
    rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]"
    rb"|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
)
_LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
_MARK = rb"[!-&(-/:-@\[-`{-~]"
_MARKS = bytes(b for b in range(0x21, 0x7F) if re.fullmatch(_MARK, bytes([b])))
_UNIT = re.compile(_LETTER + rb"+|[0-9]|" + _MARK + rb"+")


class Encoder:
    """Ids of whole texts without special tokens, packed as little-endian integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.by_word = _drops_space(parts)
        self.words = Words(np.dtype(f"<u{self.width}"))
        self.units: dict[bytes, bytes] = {}
        if self.by_word:
            # Exactly the last id of a run of letters or marks stands for a word end.
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            suffix = parts["model"]["end_of_word_suffix"]
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def pack(self, *ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def packed(self, texts: list[bytes | None]) -> list[bytes]:
        """The packed ids of each text; null counts as empty."""
        out: list[bytes] = []
        for a, b in slices([len(t or b"") for t in texts], SLICE):
            out += self._by_word(texts[a:b]) if self.by_word else self._whole(texts[a:b])
        return out

    def _encode(self, text: str) -> list[int]:
        # The batch call without offsets takes two thirds of the time of ``encode``.
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, texts: list[bytes | None]) -> list[bytes]:
        return [self.pack(*self._encode((t or b"").decode("utf-8", "replace"))) for t in texts]

    def _by_word(self, texts: list[bytes | None]) -> list[bytes]:
        data = b"\n".join([*(t or b"" for t in texts), b""])
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        parts: list[list[bytes]] = [[] for _ in texts]
        at = first = 0
        while at < len(data):
            stop = _stretch(data, at)
            stretch = np.frombuffer(data, np.uint8, stop - at, at)
            last = int(np.searchsorted(ends, stop, "left"))
            cuts = np.append(ends[first:last] - at, stop - at)
            for i, ids in enumerate(self._looked_up(stretch, cuts), first):
                if ids:
                    parts[i].append(ids)
            # The next stretch begins in this text or in the one after it.
            first = last + 1 if last < len(ends) and ends[last] == stop else last
            at = stop
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def _looked_up(self, data: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The packed ids of what stands up to each cut; ``data`` ends with white space."""
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
        if not len(starts):
            return [b""] * len(cuts)
        if self.words.count > CACHED_WORDS:
            self.words = Words(self.words.ids.dtype)
        found = self.words.find(data, space, starts, ends, self._learn)
        if found is None:  # different words with one sum: rare, and settled without sums
            distinct = list({data[a:b].tobytes() for a, b in zip(starts, ends)})
            known = dict(zip(distinct, self._learn(distinct)))
            packed = [known[data[a:b].tobytes()] for a, b in zip(starts, ends)]
            sizes = np.array([len(p) // self.width for p in packed])
            ids = np.frombuffer(b"".join(packed), self.words.ids.dtype)
        else:
            ids, sizes = self.words.gather(found)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = upto[np.concatenate([[0], np.searchsorted(starts, cuts)])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words. Plain words are put together from their runs, as the
        tokenizer cuts them at the same places; all others go to the library whole."""
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        made: dict[bytes, tuple] = {}
        other: dict[bytes, bytes] = {}
        for word in words:
            # Most are letters, with marks behind them or without.
            core = word.rstrip(_MARKS)
            if b"<|" not in word:
                if core.isalpha() or _LETTERS.fullmatch(core.decode("utf-8", "replace")):
                    low = core.lower()
                    made[word] = (low,) if len(core) == len(word) else (low, word[len(core) :])
                    continue
                parts = _UNIT.findall(word.lower())
                if sum(map(len, parts)) == len(word):
                    made[word] = tuple(parts)
                    continue
            other[word] = self.pack(*self._encode(word.decode("utf-8", "replace")))
        units = list(set(chain.from_iterable(made.values())).difference(self.units))
        ids = np.array(self._encode(b" ".join(units).decode()), f"<u{self.width}")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        data = ids.tobytes()
        packed = [data[at:stop] for at, stop in zip([0, *stops], stops)]
        self.units.update(zip(units, packed, strict=True))
        one = self.units.__getitem__
        get = made.get
        return [
            other[word] if (parts := get(word)) is None else one(parts[0]) if len(parts) == 1 else b"".join(map(one, parts))
            for word in words
        ]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x09-\x0D\x20]")


def _stretch(data: bytes, at: int) -> int:
    """Where a stretch of about ``SLICE`` bytes that begins at ``at`` ends, after white space."""
    if len(data) - at <= SLICE:
        return len(data)
    end = _BLANK.search(data, at + SLICE - 1)
    return end.end() if end else len(data)


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.size = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            wider = np.empty(max(need, 2 * len(self.held)), self.held.dtype)
            wider[: self.size] = self.held[: self.size]
            self.held = wider
        self.held[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


class Words:
    """Known words with their ids, found by sums of their bytes and compared byte by byte."""

    powers = np.ones(1, np.uint64)
    undone = np.ones(1, np.uint64)

    def __init__(self, dtype):
        # Sums in order with the numbers of their words: many old ones and few new ones.
        self.tiers = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.letters, self.ids_held = _Column(np.uint8), _Column(dtype)
        self.begins, self.sizes = _Column(np.int64), _Column(np.int32)
        self.id_begins, self.id_sizes = _Column(np.int64), _Column(np.int32)

    @property
    def count(self) -> int:
        return self.begins.size

    @property
    def ids(self) -> np.ndarray:
        return self.ids_held.all

    @classmethod
    def _tables(cls, n: int) -> None:
        if len(cls.powers) < n:
            base = np.uint64(BASE)
            back = np.uint64(pow(BASE, -1, 1 << 64))
            for name, factor in (("powers", base), ("undone", back)):
                table = np.full(n, factor, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))

    def _sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word the sum of ``(byte + 1) * BASE ** place``, modulo 2 ** 64."""
        self._tables(len(data))
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=upto[1:])
        return (upto[ends] - upto[starts]) * self.undone[starts]

    def find(self, data, space, starts, ends, learn) -> np.ndarray | None:
        """The number of each word, new ones learned; None if two words have one sum."""
        sums, first, where = np.unique(self._sums(data, starts, ends), return_index=True, return_inverse=True)
        numbers = np.full(len(sums), -1, np.int64)
        for keys, held in self.tiers:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, sums), len(keys) - 1)
                numbers = np.where(keys[at] == sums, held[at], numbers)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            numbers[new] = self._add(sums[new], words, learn(words))
        found = numbers[where]
        sizes = ends - starts
        if (self.sizes.all[found] != sizes).any():
            return None
        shift = np.repeat(self.begins.all[found] - starts, sizes)
        inside = np.flatnonzero(~space)
        if (self.letters.all[inside + shift] != data[inside]).any():
            return None
        return found

    def _add(self, sums: np.ndarray, words: list[bytes], packed: list[bytes]) -> np.ndarray:
        numbers = np.arange(self.count, self.count + len(words))
        for text, held, begins, sizes in (
            (words, self.letters, self.begins, self.sizes),
            (packed, self.ids_held, self.id_begins, self.id_sizes),
        ):
            width = held.held.dtype.itemsize
            own = np.fromiter(map(len, text), np.int64, len(text)) // width
            begins.add(held.size + np.cumsum(own) - own)
            sizes.add(own)
            held.add(np.frombuffer(b"".join(text), held.held.dtype))
        keys, held = self.tiers[1]
        keys, held = np.concatenate([keys, sums]), np.concatenate([held, numbers])
        if len(keys) > max(1 << 16, len(self.tiers[0][0]) // 8):
            keys, held = np.concatenate([self.tiers[0][0], keys]), np.concatenate([self.tiers[0][1], held])
            order = np.argsort(keys, kind="stable")
            self.tiers = [(keys[order], held[order]), (np.empty(0, np.uint64), np.empty(0, np.int64))]
        else:
            order = np.argsort(keys, kind="stable")
            self.tiers[1] = (keys[order], held[order])
        return numbers

    def gather(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        sizes = self.id_sizes.all[found].astype(np.int64)
        upto = np.cumsum(sizes)
        shift = np.repeat(self.id_begins.all[found] - (upto - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift], sizes


def _drops_space(parts: dict) -> bool:
    def flat(part):
        nested = (part or {}).get("normalizers") or (part or {}).get("pretokenizers")
        return list(chain.from_iterable(map(flat, nested))) if nested else [part] if part else []

    normal = {(p["type"], json.dumps(p.get("pattern"))) for p in flat(parts["normalizer"])}
    allowed = {("NFC", "null"), ("Lowercase", "null"), ("Replace", json.dumps({"Regex": r"\s+"}))}
    before = flat(parts["pre_tokenizer"])
    return (
        normal == allowed
        and parts["model"].get("end_of_word_suffix")
        and len(before) == 2
        and before[0].get("pattern") == {"Regex": KNOWN_PATTERN}
        and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True)
        and (before[1]["type"], before[1]["use_regex"]) == ("ByteLevel", False)
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
            for t in parts["added_tokens"]
        )
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that its words outlive a task."""
    return Encoder(path)
