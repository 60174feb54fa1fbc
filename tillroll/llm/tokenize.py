"""Token ids of many texts at once, equal to those of a byte-level BPE file of the tokenizers library.

A byte-level BPE cuts a text into pieces by a fixed pattern and merges inside each piece. The pieces are found and hashed here
for a whole chunk of texts with numpy; the library encodes only pieces that this worker hasn't met (a cache of bounded size).
Texts with characters beyond ``SAFE`` go to the library whole. Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tillroll.llm.hashing import U, mix, powers

#: Characters below this have a class table (Latin, Greek, Cyrillic and neighbours, general punctuation).
SAFE = 0x2070
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
CLASSES = np.array(
    [_SPACE if c in _WHITE else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(SAFE)],
    np.uint8,
)
#: Characters without a meaning in older tables are left to the library too.
KNOWN = np.array([unicodedata.ucd_3_2_0.category(chr(c)) != "Cn" or unicodedata.category(chr(c)) == "Cn" for c in range(SAFE)])
VALUES = mix(np.arange(1, SAFE + 1, dtype=U) * U(0x9E3779B97F4A7C15))
#: Most pieces kept by a worker before it starts a new cache.
CACHE_PIECES = 1_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start: points are code points, offsets the texts' places among them."""
    kind = CLASSES[points]
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    start |= begins[:-1]
    # The last white space before something else stands alone, and if it is a blank, it belongs to what follows.
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:-1])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # 's 't 're 've 'm 'll 'd at the start of a piece
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        at = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0) * ~np.maximum.reduce(
            [begins[np.minimum(quote + j, n)] for j in range(1, k + 1)])
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == 108) & (two == 108))
        start[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes lists of texts; keeps the ids of the pieces that it has met."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.keys, keys)  # the new keys are sorted
        self.place = np.insert(self.place, at, np.arange(len(found)) + len(self.ends) - 1)
        self.keys = np.insert(self.keys, at, keys)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets), and the number of ids before each text (one more for the end)."""
        whole = data.decode("utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            places = offsets
        else:
            leads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            places = leads[offsets]
        n = len(places) - 1
        odd = points >= SAFE
        odd[~odd] = ~KNOWN[points[~odd]]
        if odd.any():
            strange = np.add.reduceat(np.append(odd, False).astype(np.int64), places[:-1]) > 0
            strange &= places[:-1] < places[1:]
            points = np.where(odd, 32, points).astype(np.uint32)
        else:
            strange = np.zeros(n, bool)
        if len(points):
            starts = piece_starts(points, places)
            ends = np.append(starts[1:], len(points))
            up, down = powers(len(points))
            prefix = np.zeros(len(points) + 1, U)
            np.cumsum(VALUES[points] * up[: len(points)], out=prefix[1:])
            hashes = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))
            if strange.any():
                ok = ~strange[np.searchsorted(places, starts, "right") - 1]
                starts, ends, hashes = starts[ok], ends[ok], hashes[ok]
            unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHE_PIECES:
                self.forget()
            at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
            new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
            if new.any():
                spots = index[new]
                self.learn(unique[new], [whole[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            place = self.place[np.searchsorted(self.keys, unique)][inverse]
            begin, size = self.ends[place], self.ends[place + 1] - self.ends[place]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
            before = total[np.searchsorted(starts, places)]
        else:
            ids, before = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if strange.any():
            parts, counts = [], np.diff(before)
            for i in range(n):
                part = ids[before[i] : before[i + 1]]
                if strange[i]:
                    part = np.array(self.library.encode(whole[places[i] : places[i + 1]], add_special_tokens=False).ids, np.uint32)
                    counts[i] = len(part)
                parts.append(part)
            ids, before = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        return ids, before
