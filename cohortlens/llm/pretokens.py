"""Pre-tokens of the byte-level BPE tokenizer, over whole Arrow batches.

The tokenizer first cuts a text into pre-tokens with a fixed pattern and
merges bytes only inside one.  So ids and counts need the library once per
*distinct* pre-token; everything else is finding the cuts and looking
pre-tokens up.  The cuts of a batch of texts are found here with numpy, on
one array of code points.  Which code points are letters, numbers or white
space is asked of the library itself, so its Unicode tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_POINTS = 0x110000


class PreTokens:
    """The pre-tokens of a list of texts: where each starts, and its key.

    start, end   code point range in ``joined``
    text         number of its text in the list
    key          64-bit hash of its code points (seeded polynomial)
    """

    __slots__ = ("joined", "start", "end", "text", "key")

    def __init__(self, joined, start, end, text, key):
        self.joined, self.start, self.end, self.text, self.key = joined, start, end, text, key

    def strings(self, at: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


class ByteLevelCutter:
    """Cuts texts as a byte-level BPE ``Tokenizer`` with no normalizer does."""

    MULTIPLIER = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pre = self.tokenizer.pre_tokenizer
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.letters = self._byte_letters()
        self.classes = np.full(_POINTS, UNKNOWN, np.uint8)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _byte_letters() -> dict[int, int]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}

    def _alone(self, prefix: str, char: str) -> bool:
        return len(self.pre.pre_tokenize_str(prefix + char)) == 1

    def _class(self, point: int) -> int:
        char = chr(point)
        return next((k for k, p in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if self._alone(p, char)), SPACE)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == UNKNOWN).any():
            for p in np.unique(points[out == UNKNOWN]).tolist():
                self.classes[p] = self._class(p)
            out = self.classes[points]
        return out

    def _power_tables(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(self.MULTIPLIER, -1, 1 << 64)
            for name, base in (("powers", self.MULTIPLIER), ("inverses", inverse)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def _segments(self, texts: list[str]):
        """Texts cut at the special strings, which the library takes out first."""
        parts, owner, special = [], [], []
        for t, text in enumerate(texts):
            at = 0
            while True:
                found = min(((p, s) for s in self.special if (p := text.find(s, at)) >= 0), default=None)
                if found is None:
                    break
                for piece, sid in ((text[at : found[0]], -1), (found[1], self.special[found[1]])):
                    if piece:
                        parts.append(piece), owner.append(t), special.append(sid)
                at = found[0] + len(found[1])
            if at < len(text):
                parts.append(text[at:]), owner.append(t), special.append(-1)
        return parts, np.array(owner, np.int64), np.array(special, np.int64)

    def cut(self, texts: list[str]) -> PreTokens:
        parts, owner, special = self._segments(texts)
        lengths = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(lengths) - lengths
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(points)
        if n == 0:
            none = np.zeros(0, np.int64)
            return PreTokens(joined, none, none, none, np.zeros(0, np.uint64))
        kind = self._classes(points)
        first = np.zeros(n + 1, bool)
        first[begin] = True
        first[n] = True
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        cut = run.copy()
        # white space before a run: its last character stands alone, a plain space joins the run
        after = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
        cut[after - 1] = True
        cut[after] = points[after - 1] != 0x20
        # 's 't 're 've 'm 'll 'd
        mark = np.flatnonzero(points == 0x27)
        mark = mark[mark + 1 < n]
        mark = mark[run[mark] & run[mark + 1] & ~first[mark + 1] & (kind[mark + 1] == LETTER)]
        mark = mark[first[mark] | (points[mark - 1] != 0x20)]
        if len(mark):
            a = points[mark + 1]
            two = np.where((mark + 2 < n) & ~run[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            pair = np.zeros(len(mark), bool)
            for s in ("re", "ve", "ll"):
                pair |= (a == ord(s[0])) & (two == ord(s[1]))
            size = np.where(one, 1, np.where(pair, 2, 0))
            mark, size = mark[size > 0], size[size > 0]
            cut[mark + 1] = False
            cut[mark + 1 + size] = True
        special_at = np.flatnonzero(special >= 0)
        for s in special_at.tolist():
            cut[begin[s] + 1 : begin[s] + lengths[s]] = False
        bounds = np.flatnonzero(cut)
        start, end = bounds[:-1], bounds[1:]
        self._power_tables(n + 1)
        value = points.astype(np.uint64)
        value = (value + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        value *= self.powers[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        key = (total[end] - total[start]) * self.inverses[start]
        key ^= key >> np.uint64(29)
        segment = np.searchsorted(begin, start, side="right") - 1
        is_special = special[segment] >= 0
        if is_special.any():
            key[is_special] = special[segment[is_special]].astype(np.uint64)
        return PreTokens(joined, start, end, owner[segment], key)

    def ids(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token, from the library's own merge model."""
        merge, special, letters = self.tokenizer.model.tokenize, self.special, self.letters
        return [
            [special[p]] if p in special else [t.id for t in merge(p.encode().decode("latin-1").translate(letters))]
            for p in pre_tokens
        ]


_CUTTERS: dict[str, ByteLevelCutter] = {}


def cutter(path: str) -> ByteLevelCutter:
    """One cutter per Python worker."""
    if path not in _CUTTERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CUTTERS[path] = ByteLevelCutter(path)
    return _CUTTERS[path]


class IdCache:
    """Ids of the pre-tokens met by one Python worker, as sorted arrays.

    It holds ``limit`` pre-tokens at most and is emptied when full; that costs
    time only, as missing ones are asked of the library again.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.cutter, self.limit = cutter(path), limit
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, at: np.ndarray, keys: np.ndarray, strings: list[str]) -> None:
        found = self.cutter.ids(strings)
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.first = np.insert(self.first, at, self.used + np.cumsum(sizes) - sizes)
        self.count = np.insert(self.count, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array, and the number of ids of each text."""
        cut = self.cutter.cut(texts)
        if not len(cut.key):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys, where, inverse = np.unique(cut.key, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = at == len(self.keys)
        new[~new] = self.keys[at[~new]] != keys[~new]
        if new.any():
            self._learn(at[new], keys[new], cut.strings(where[new]))
            at = np.searchsorted(self.keys, keys)
        slot = at[inverse]
        first, count = self.first[slot], self.count[slot].astype(np.int64)
        done = np.cumsum(count)
        per_text = np.bincount(cut.text, weights=count, minlength=len(texts)).astype(np.int64)
        return self.flat[np.repeat(first - (done - count), count) + np.arange(int(done[-1]))], per_text


_CACHES: dict[str, IdCache] = {}


def id_cache(path: str) -> IdCache:
    """One cache per Python worker; ``forget_ids`` at the end of a task gives its memory back."""
    if path not in _CACHES:
        _CACHES[path] = IdCache(path)
    return _CACHES[path]


def forget_ids() -> None:
    """Workers outlive a task: the next stage's shall not find this one's cache in their memory."""
    _CACHES.clear()


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths sum to about ``most`` each (one row at least)."""
    if not len(lengths):
        return []
    group = (np.cumsum(lengths) - lengths) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)]))


def text_slices(column: pa.Array, most: int = 500_000) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive rows of about ``most`` characters and their texts (null as empty): bounds what a worker holds."""
    for a, b in slices(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False), most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
