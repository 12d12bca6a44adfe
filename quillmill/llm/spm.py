"""What the SentencePiece operators share: a model file read into arrays, and texts cut into words.

Two kinds of model are covered. In a unigram model the best path by summed scores is the encoding. In a
BPE model the encoding is the only path on which every two neighbouring pieces are *settled*: merging
the two pieces' own characters in order of rank never joins across their border. Both are found by the
same search from left to right; only the rule that admits and ranks a step differs.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN = 0  # the inner id of any character that is no piece
UNK_PENALTY = 10.0  # fixed value of the tokenizer: an unknown character scores this much below the worst piece


@dataclass
class Model:
    """Inner ids: 0 for unknown characters, then single characters, then longer pieces by rank."""

    kind: str  # "unigram" or "bpe"
    strings: list[str]  # by inner id
    ids: np.ndarray  # piece id by inner id
    scores: np.ndarray
    byte_ids: np.ndarray | None  # piece ids of the 256 bytes
    unk_id: int
    inner: dict[str, int]
    left: np.ndarray  # the pieces that an inner id was last merged from; itself for single characters
    right: np.ndarray
    usable: np.ndarray
    pair_keys: np.ndarray  # sorted left * 2^20 + right
    pair_to: np.ndarray
    tied: frozenset[str]  # characters of pieces that share a score: words with them take encode_scalar()
    text_of: list[bytes]  # by piece id

    def __post_init__(self) -> None:
        self.lengths = np.array([max(1, len(s)) for s in self.strings])
        self.longest = int(self.lengths[self.usable].max())
        self._seen_keys = np.full(1 << 21, -1, np.int64)
        self._seen = np.zeros(1 << 21, bool)

    # ---- BPE: which neighbours are settled

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_to[at], -1)

    def _settled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges next to the border, the latest first; at each stage a merge across the border
        that outranks all that is still to be undone shows that the border would not have held."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, bound = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(live):
            to = self._merged(a, b)
            bad = (to >= 0) & (to < bound)
            ok[live[bad]] = False
            undo_a = a > b
            a_next, b_next = self.right[a], self.left[b]
            a_fixed, b_fixed = a_next == a, b_next == b
            undo_a = np.where(a_fixed, False, np.where(b_fixed, True, undo_a))
            done = bad | (a_fixed & b_fixed)
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_next, a), np.where(undo_a, b, b_next)
            go = ~done
            live, a, b, bound = live[go], a[go], b[go], bound[go]
        return ok

    def settled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_settled() by way of a table of earlier answers."""
        key = (a.astype(np.int64) << 20) | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        miss = np.flatnonzero(self._seen_keys[at] != key)
        out = self._seen[at]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            found = self._settled(new >> 20, new & ((1 << 20) - 1))
            out[miss] = found[back]
            slot = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
            self._seen_keys[slot] = new
            self._seen[slot] = found
            # two new keys may share a slot: the last one stands in both arrays
        return out

    # ---- one text by itself, for ties, long runs of spaces, and long words whose segments do not agree

    def encode_scalar(self, text: str) -> list[int]:
        """Inner ids. BPE by merging the best pair, leftmost first, with a heap; unigram by a search over lists."""
        if self.kind == "bpe":
            return _merge(list(text), self.inner, self.scores)[0]
        best, back, piece = [0.0], [0], [-1]
        for j in range(1, len(text) + 1):
            top = (-np.inf, 0, UNKNOWN)
            for length in range(min(j, self.longest), 0, -1):
                k = self.inner.get(text[j - length : j], UNKNOWN if length == 1 else -1)
                if k >= 0 and best[j - length] + self.scores[k] > top[0]:
                    top = (best[j - length] + self.scores[k], length, k)
            for values, x in zip((best, back, piece), top):
                values.append(x)
        out, j = [], len(text)
        while j:
            out.append(piece[j])
            j -= back[j]
        return out[::-1]

    # ---- inner ids to piece ids

    def expand(self, inner: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Piece ids; an unknown character (its code point in `chars`) becomes its bytes, or unk."""
        if not (inner == UNKNOWN).any():
            return self.ids[inner]
        out: list[int] = []
        for i, c in zip(inner.tolist(), chars.tolist()):
            if i != UNKNOWN:
                out.append(int(self.ids[i]))
            elif self.byte_ids is None:
                out.append(self.unk_id)
            else:
                out.extend(self.byte_ids[x] for x in chr(c).encode("utf-8", "replace"))
        return np.array(out, np.int32)


def _merge(symbols: list[str], inner: dict[str, int], scores: np.ndarray) -> tuple[list[int], tuple[str, str] | None]:
    """Ids of the merged symbols, and the last pair that was merged."""
    n = len(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        j = nxt[i] if 0 <= i < n else n
        if 0 <= i and j < n and (k := inner.get(symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (-float(scores[k]), i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i)
    last = None
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        last = (symbols[i], symbols[j])
        symbols[i], symbols[j] = symbols[i] + symbols[j], ""
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(prv[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(inner.get(symbols[i], UNKNOWN))
        i = nxt[i]
    return out, last


def parse(data: bytes) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    norm, kinds = m.normalizer_spec, {1: "unigram", 2: "bpe"}
    kind = kinds.get(m.trainer_spec.model_type)
    if kind is None or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("covered are unigram and BPE models without normalization, with a leading space")
    if any(p.type == 4 for p in m.pieces):
        raise ValueError("user-defined pieces are not covered")
    normal = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type == 1]
    if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
        raise ValueError("pieces across spaces are not covered")
    normal.sort(key=lambda x: (len(x[1]) > 1, -x[2] if len(x[1]) > 1 else 0, x[0]))
    strings = ["", *(p for _, p, _ in normal)]
    inner = {p: k for k, p in enumerate(strings) if k}
    scores = np.array([0.0, *(s for _, _, s in normal)])
    scores[UNKNOWN] = scores[1:].min() - UNK_PENALTY
    n = len(strings)
    left, right, usable, pairs = np.arange(n), np.arange(n), np.ones(n, bool), {}
    tied: set[str] = set()
    if kind == "bpe":
        long_scores = [s for _, p, s in normal if len(p) > 1]
        twice = {s for s, c in zip(*np.unique(long_scores, return_counts=True)) if c > 1}
        for k, s in enumerate(strings):
            if len(s) < 2:
                continue
            if scores[k] in twice:
                tied.update(s)
            for cut in range(1, len(s)):
                if s[:cut] in inner and s[cut:] in inner:
                    pairs[(inner[s[:cut]] << 20) | inner[s[cut:]]] = k
            got, last = _merge(list(s), inner, scores)
            usable[k] = got == [k]
            if usable[k]:
                left[k], right[k] = inner[last[0]], inner[last[1]]
    keys = np.array(sorted(pairs) or [0], np.int64)
    byte_ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    text_of = []
    for p in m.pieces:
        text_of.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 5) else " ⁇ ".encode() if p.type == 2 else b"")
    return Model(
        kind, strings, np.array([m.trainer_spec.unk_id, *(i for i, _, _ in normal)], np.int32), scores, np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)]) if byte_ids else None,
        m.trainer_spec.unk_id, inner, left, right, usable, keys, np.array([pairs.get(k, -1) for k in keys.tolist()]), frozenset(tied), text_of,
    )


@functools.lru_cache(maxsize=2)
def load(data: bytes) -> Model:
    """parse(), once per Python worker."""
    return parse(data)


def shared(df: DataFrame, path: str) -> Broadcast:
    """The model file's bytes (a megabyte or so), read on the driver, for all workers."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text into a flat array of words. A word stands for the space before it and itself, and
    holds a space mark for each further space in between; the texts' words put together are the texts."""
    words = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    offsets, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if not len(empty):
        return offsets, flat
    touched = np.unique(np.searchsorted(offsets, empty, "right") - 1)
    parts, lengths, done = [], np.diff(offsets), 0
    for i in touched.tolist():
        new, run = [], 0
        for w in (own := flat[offsets[i] : offsets[i + 1]].to_pylist()):
            if w:
                new.append(SPACE * run + w)
                run = 0
            else:
                run += 1
        if run and len(own) > 1:
            new.append(SPACE * (run - 1))
        parts += [flat[done : offsets[i]], pa.array(new, flat.type)]
        done, lengths[i] = offsets[i + 1], len(new)
    parts.append(flat[done:])
    return np.r_[0, np.cumsum(lengths)], pa.chunked_array(parts).combine_chunks()


def segment_size(model: Model) -> int:
    """Characters of a segment: three times the overlap of two, which is some longest pieces long."""
    return 3 * max(64, 2 * model.longest)


def segments(n: int, model: Model) -> np.ndarray:
    """Where the segments of a text of n characters begin; the last one ends with the text."""
    size = segment_size(model)
    return np.r_[np.arange(0, n - size, 2 * size // 3), n - size]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all given pieces, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
