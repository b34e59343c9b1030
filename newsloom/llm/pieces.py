"""SentencePiece encoding and decoding in numpy, for models of byte-pair pieces.

Text is cut into units that no piece crosses. Distinct units of one length advance together: at each place the hashes of
the substrings that end there probe the sorted hashes of the pieces, and the best candidate's start is stored as a
back-pointer. A candidate is a piece that byte-pair merging would leave standing beside the last piece of its start's
own best path; exactly one can, and where pieces' scores alone rank paths, as with a unigram model, results would differ
from the library's for these models. So the score that is maximised is 1 for a candidate that can stand and 0 otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import Kept, in_arrow, slices

BLANK = "▁"
#: Units longer than this advance alone, without tables for a group. Characters of texts handled at once. What a process
#: keeps for later texts of a task: distinct units, about 250 bytes each. Places for pairs met, 8 bytes each, a power of two.
LONG, SLICE, KEPT, PLACES = 64, 1 << 20, 60_000, 1 << 20
_P, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


def _spread(code: int | np.ndarray) -> int | np.ndarray:
    return code * 0x1000193 + 1


class Pieces:
    """A model's pieces: ids, scores as ranks, and which pieces may stand side by side."""

    def __init__(self, pieces: list[tuple[str, float, int]], add_blank: bool = True) -> None:
        """pieces: text, score and type of each id, in order; types: 1 normal, 2 unknown, 3 control, 6 byte."""
        self.texts, self.add_blank = [p[0] for p in pieces], add_blank
        self.types = [p[2] for p in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == 1}
        self.score = {t: s for t, s, kind in pieces if kind == 1}
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(f"[^{BLANK}]{BLANK}", t) for t in self.ids):
            raise ValueError("a piece has a blank inside")
        inner = {c for t in self.ids for c in t}
        apart = "".join(re.escape(c) for c in "\n\t\r\0\v\f" if c not in inner)
        self.units = re.compile(f"[{apart}]|{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" if apart else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.halves = {t: self.merge(t, 2) for t in self.ids if len(t) > 1}
        usable = [(t, i) for t, i in self.ids.items() if len(t) == 1 or len(self.merge(t)) == 1]
        rises = all(self.score.get(h, 0) >= self.score[t] for t, _ in usable if len(t) > 1 for h in self.halves[t] if len(h) > 1)
        #: From a piece's first or last character up to the piece: the parts that border its left or right side as it is merged.
        self.left, self.right = ({t: self._side(t, k) for t, _ in usable} if rises else {} for k in (0, 1))
        hashes = np.array([self._hash(t) for t, _ in usable], np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.keys, self.key_ids = hashes[order], np.array([i for _, i in usable], np.int32)[order]
        tops = self.keys >> _TOP
        self.sieve = np.zeros(1 << 20, bool)  # by the hashes' top bits, which values a piece has
        self.sieve[tops] = True
        #: Where the keys of a value begin, and how many keys a value has at most.
        self.starts = np.searchsorted(tops, np.arange(1 << 20, dtype=np.uint64)).clip(0, max(0, len(tops) - 1)).astype(np.int32)
        self.most = int(np.bincount(tops.astype(np.int64)).max(initial=1))
        self.usable = dict(usable)
        self._pairs: dict[int, bool] = {}
        self._met = np.full(PLACES, -1, np.int64)  # of each place the pair met last, and in the lowest bit whether it stands
        self._known: dict[str, bytes] = {}
        silent = {2: " ⁇ ".encode(), 3: b""}
        plain = [bytes([self.byte_of[i]]) if i in self.byte_of else silent.get(kind, t.replace(BLANK, " ").encode()) for i, (t, _, kind) in enumerate(pieces)]
        self.plain = pa.array(plain, pa.binary())

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h + _spread(ord(c))) * int(_P) % 2**64  # multiplied last: the top bits depend on all
        return h

    def _side(self, text: str, half: int) -> list[str]:
        out = [text]
        while len(out[-1]) > 1:
            out.append(self.halves[out[-1]][half])
        return out[::-1]

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merging by its definition, down to least parts: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > least:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(pairwise(parts))))
            if best[0] == -np.inf:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their joined text is merged; an id of -1 is a character without a piece."""
        if left < 0 or right < 0:
            return True
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        a, b = self.texts[left], self.texts[right]
        return self._apart(self.right[a], self.left[b]) if self.left else self.merge(a + b) == [a, b]

    def _apart(self, left: list[str], right: list[str]) -> bool:
        """Follow what borders the seam as both sides are merged, best score first: no join across the seam comes before its parts' own next joins."""
        score, i, j = self.score, 0, 0
        while True:
            mine = score[left[i + 1]] if i + 1 < len(left) else -np.inf
            other = score[right[j + 1]] if j + 1 < len(right) else -np.inf
            across = score.get(left[i] + right[j], -np.inf)
            if across > mine and across >= other and across > -np.inf:
                return False
            if mine == other == -np.inf:
                return True
            if mine >= other:
                i += 1
            else:
                j += 1

    def _group(self, units: list[str]) -> Iterator[bytes]:
        """The pieces of units of one length, as int32 each."""
        n, size = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        codes = _spread(codes.T.astype(np.uint64))
        hashes = np.zeros((size, n), np.uint64)  # of the substrings that end at the place reached, by their start
        last, back = np.full((size + 1, n), -2, np.int64), np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            low = max(0, end - self.longest)
            probe = hashes[low:end]
            probe += codes[end - 1]
            probe *= _P
            at, piece = self._pieces(probe.ravel())
            before = last[low:end].ravel()[at]
            open_ = before < 0
            ask = np.flatnonzero(~open_)
            if len(ask):
                open_[ask] = self._stand(before[ask] << 32 | piece[ask])
            lone = np.ones(n, bool)
            single = (end - 1 - low) * n
            lone[at[np.searchsorted(at, single) :] - single] = False
            if strange := np.count_nonzero(lone):
                last[end, lone], back[end, lone] = -1, end - 1
            at, piece = at[open_], piece[open_]
            start, row = np.divmod(at, n)
            if strange or len(at) != n:  # characters without a piece leave a choice: the first start
                row, first = np.unique(row, return_index=True)
                start, piece = start[first], piece[first]
            last[end, row], back[end, row] = piece, low + start
        path, place, rows = [], np.full(n, size), np.arange(n)
        while place.any():
            at = place * n + rows
            path.append(last.ravel()[at])
            place = back.ravel()[at]
        path = np.stack(path[::-1], axis=1)
        flat, ends = path[path > -2].astype(np.int32).tobytes(), (4 * np.cumsum((path > -2).sum(axis=1))).tolist()
        strange = (path == -1).any(axis=1).tolist()
        start = 0
        for i, end in enumerate(ends):
            yield self._trace(units[i], last[:, i].tolist(), back[:, i].tolist()) if strange[i] else flat[start:end]
            start = end

    def _pieces(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and these pieces."""
        tops = (hashes >> _TOP).view(np.int64)
        at = np.flatnonzero(self.sieve[tops])
        found, key = hashes[at], self.starts[tops[at]]
        for _ in range(self.most - 1):  # the keys of one value lie side by side
            key = np.where(self.keys[key] < found, np.minimum(key + 1, len(self.keys) - 1), key)
        same = self.keys[key] == found
        return at[same], self.key_ids[key[same]].astype(np.int64)

    def _stand(self, pairs: np.ndarray) -> np.ndarray:
        """stand() of many pairs, each left << 32 | right. What was found is kept in one of four places that follow from the pair, until another takes it."""
        place = lambda x: (x.view(np.uint64) * _P >> np.uint64(65 - PLACES.bit_length())).view(np.int64)
        at = place(pairs)
        met = self._met[at]
        out, new = (met & 1).astype(bool), np.flatnonzero(met >> 1 != pairs)
        for k in range(1, 4):
            met = self._met[at[new] ^ k]
            same = met >> 1 == pairs[new]
            out[new[same]] = met[same] & 1
            new = new[~same]
        if len(new):
            own, where = np.unique(pairs[new], return_inverse=True)
            stands = np.fromiter((self._stands(x >> 32, x & 0xFFFFFFFF) for x in own.tolist()), bool, len(own))
            out[new] = stands[where]
            at, met = place(own), own << 1 | stands
            for k in range(4):
                free = self._met[at ^ k] < 0
                self._met[at[free] ^ k] = met[free]
                at, met = at[~free], met[~free]
            self._met[at ^ (met >> 1 & 3)] = met
        return out

    def _alone(self, unit: str) -> bytes:
        """The same for one long unit, in memory that grows with its length alone."""
        last, back = [-2] * (len(unit) + 1), [0] * (len(unit) + 1)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.usable.get(unit[start:end], -1 if start == end - 1 else -2)
                if piece > -2 and (last[start] < 0 or self.stand(last[start], piece)):
                    last[end], back[end] = piece, start
                    break
        return self._trace(unit, last, back)

    def _trace(self, unit: str, last: list[int], back: list[int]) -> bytes:
        out, end = [], len(unit)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(unit[back[end] : end].encode())]
            else:
                out.append(self.unknown)
            end = back[end]
        return np.array(out[::-1], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken in slices of SLICE characters, or one that is longer; of the units met, those of
        the last slice stay known once there are more than KEPT."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.units.findall((BLANK if self.add_blank and t else "") + t.replace(" ", BLANK)) for t in texts]
        used = set().union(*cut)
        if len(self._known) > KEPT:
            self._known = {u: self._known[u] for u in used if u in self._known}
        known, lengths = self._known, {}
        for u in used.difference(known):
            if len(u) > LONG:
                known[u] = self._alone(u)
            else:
                lengths.setdefault(len(u), []).append(u)
        for units in lengths.values():
            for at in range(0, len(units), 4096):
                own = units[at : at + 4096]
                known.update(zip(own, self._group(own), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in cut]

    def forget(self) -> None:
        """Let go of all units met; pairs stay in their places for later tasks."""
        self._known, self._pairs = {}, {}

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids, without the blank put before it. Control pieces are silent; the unknown piece is U+2047, and so is an id beyond the vocabulary."""
        own, n = np.asarray(ids, np.int64), len(self.plain)
        own = np.where((own >= 0) & (own < n), own, self.unknown)
        data = self.plain.take(pa.array(own)).buffers()[2]
        text = data.to_pybytes().decode("utf-8", "replace") if data else ""
        return text[1:] if self.add_blank and text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model of a file, read once in each Python process."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only byte-pair models without normalisation are read")
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces], norm.add_dummy_prefix)


@cache
def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = (), model: str | None = None, decoded: bool = False) -> DataFrame:
    """Kept columns and ids array<int> of every whole text, with decoded string if asked for; null and empty texts have no ids.

    model: the path of the model's file, on every machine; None: the public one of the tokenizers package. Raises ValueError where
    a kept column is named like one of the result's.
    """
    kept = Kept(df, keep, ("ids", *["decoded"] * decoded))
    rows = df.select(*kept.columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model or default_model())
        try:
            for b in slices(batches, 512):
                ids = pieces.encode(b.column("__text").to_pylist())
                more = [pa.array(ids, pa.list_(pa.int32()))] + ([pa.array([pieces.decode(x) for x in ids], pa.string())] if decoded else [])
                own = b.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "ids", *["decoded"] * decoded])
        finally:
            pieces.forget()

    schema = rows.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType()))
    return kept.named(in_arrow(rows, run, schema.add("decoded", "string") if decoded else schema))


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[Column, ...] = (), model: str | None = None) -> DataFrame:
    """Kept columns and text of every list of ids; null gives null. Null ids, and ids beyond the vocabulary, read as the unknown piece.

    Raises ValueError where a kept column is named text.
    """
    kept = Kept(df, keep, ("text",))
    rows = df.select(*kept.columns, F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model or default_model())
        for b in slices(batches, 2048):
            own = b.drop_columns(["__ids"])
            texts = [None if x is None else pieces.decode([-1 if i is None else i for i in x]) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], names=[*own.schema.names, "text"])

    return kept.named(in_arrow(rows, run, rows.drop("__ids").schema.add("text", "string")))
