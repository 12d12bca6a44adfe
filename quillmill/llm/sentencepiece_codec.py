"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Each batch's distinct words are searched once. Words of equal length form a matrix and advance together,
one end position at a time: the hash of every substring that can end a piece is probed in the sorted
piece keys, and maxima over the piece lengths leave a backpointer per word and position. Unigram models
maximise the score; BPE models admit only settled neighbours (see spm.py), of which there is one.

A long word advances as many segments of one length, each begun afresh some way into the one before. What a
search finds at a position depends on the longest piece's number of positions before it, so where two segments
agree on as many, the later one's backpointers are the word's own from there on (as they nearly always are).
Else the word is searched by itself.

Defined cases: null and empty text have no tokens; unknown characters become their bytes (or unk); a word
with characters of tied pieces (runs of spaces) is merged step by step; columns named as the added ones are
replaced, other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmill.llm import spm
from quillmill.llm.common import chunks, fresh

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Cells of a matrix that are searched at a time.
CELLS = 1_000_000


def _key_tables(model: spm.Model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: sorted hashes of pieces and of ends of longer pieces, the inner ids (-1 for mere ends), and whether longer
    pieces end so."""
    if not hasattr(model, "key_tables"):
        by: list[dict[int, list[int]]] = [{} for _ in range(model.longest + 1)]
        for k, s in enumerate(model.strings):
            if k and model.usable[k]:
                h, power = 0, 1
                for n, c in enumerate(reversed(s), 1):
                    h = (h + (ord(c) + 1) * power) & (2**64 - 1)
                    power = power * int(_BASE) & (2**64 - 1)
                    entry = by[n].setdefault(h, [-1, 0])
                    if n == len(s):
                        entry[0] = k
                    else:
                        entry[1] = 1
        model.key_tables = []
        for entries in by:
            keys = np.array(sorted(entries), np.uint64)
            model.key_tables.append((keys, np.array([entries[h][0] for h in keys.tolist()], np.int64), np.array([entries[h][1] for h in keys.tolist()], bool)))
    return model.key_tables


def _probe(table: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner ids (-1: no piece), and whether longer pieces may end so."""
    keys, ids, more = table
    if not len(keys):
        return np.full(len(h), -1), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    same = keys[at] == h
    return np.where(same, ids[at], -1), same & more[at]


def _search(model: spm.Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes: words x positions. The backpointers: length and inner id of the last piece at each end; its score."""
    tables = _key_tables(model)
    n, m = codes.shape
    back, piece = np.zeros((n, m + 1), np.int32), np.full((n, m + 1), -1, np.int32)
    score = np.full((n, m + 1), -np.inf)
    score[:, 0] = 0
    steps = np.zeros((m + 1, n), np.uint64)
    powers = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for j in range(m):
            steps[j + 1] = steps[j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        for _ in range(len(tables)):
            powers.append(powers[-1] * _BASE)
        for j in range(1, m + 1):
            live = np.arange(n)
            for length in range(1, min(j, len(tables) - 1) + 1):
                found, more = _probe(tables[length], steps[j][live] - steps[j - length][live] * powers[length])
                if length == 1:
                    found = np.where(found < 0, spm.UNKNOWN, found)
                rows = np.flatnonzero(found >= 0)
                known, rows = found[rows], live[rows]
                if model.kind == "bpe":
                    if j > length and len(rows):
                        fits = piece[rows, j - length] >= 0
                        known, rows = known[fits], rows[fits]
                        fits = model.settled(piece[rows, j - length].astype(np.int64), known)
                        known, rows = known[fits], rows[fits]
                else:
                    total = score[rows, j - length] + model.scores[known]
                    better = total >= score[rows, j]  # of equal scores the longer piece
                    known, rows = known[better], rows[better]
                    score[rows, j] = total[better]
                back[rows, j], piece[rows, j] = length, known
                live = live[more]
                if not len(live):
                    break
    return back, piece, score


def _search_segments(model: spm.Model, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text (code points, longer than a segment) the backpointers, as of _search(); None if its segments do not
    agree."""
    size, w = spm.segment_size(model), model.longest
    starts = [spm.segments(len(t), model) for t in texts]
    grid = np.concatenate([t[s[:, None] + np.arange(size)] for t, s in zip(texts, starts)])
    parts = [_search(model, grid[a : a + max(1, CELLS // size)]) for a in range(0, len(grid), max(1, CELLS // size))]
    back, piece, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    row = 0
    for text, s in zip(texts, starts):
        own = slice(row, row + len(s))
        row += len(s)
        ends = size - np.diff(s)  # where, in each later segment, the one before it ends
        tail, head = np.arange(size - w + 1, size + 1)[None, :], (ends[:, None] + np.arange(-w + 1, 1))
        at = np.arange(1, len(s))[:, None]
        same = (back[own][:-1][at - 1, tail] == back[own][at, head]) & (piece[own][at - 1, tail] == piece[own][at, head])
        if model.kind != "bpe":
            a, b = score[own][at - 1, tail], score[own][at, head]
            same &= np.abs((a - a[:, -1:]) - (b - b[:, -1:])) < 1e-6
        if not same.all():
            yield None
            continue
        whole = []
        for table in (back[own], piece[own]):
            out = np.empty(len(text) + 1, np.int32)
            out[: size + 1] = table[0]
            for k in range(1, len(s)):
                out[s[k] + ends[k - 1] + 1 : s[k] + size + 1] = table[k, ends[k - 1] + 1 :]
            whole.append(out)
        yield whole[0], whole[1]


def _walk(back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follows the backpointers of all words at once: counts, and the flat inner ids and end positions."""
    n, m = back.shape[0], back.shape[1] - 1
    at, rows, taken = np.full(n, m), np.arange(n), []
    while len(rows):
        taken.append((rows, piece[rows, at[rows]], at[rows].copy()))
        step = back[rows, at[rows]]
        if not step.all():
            raise AssertionError("a word has no path")
        at[rows] -= step
        rows = rows[at[rows] > 0]
    word, ids, ends = (np.concatenate(x) for x in zip(*taken))
    order = np.lexsort((ends, word))
    return np.bincount(word, minlength=n), ids[order], ends[order]


def _path(back: np.ndarray, piece: np.ndarray) -> tuple[list[int], list[int]]:
    """Follows one text's backpointers: inner ids and end positions."""
    back, piece, ids, ends = back.tolist(), piece.tolist(), [], []
    j = len(back) - 1
    while j:
        ids.append(piece[j])
        ends.append(j)
        j -= back[j]
    return ids[::-1], ends[::-1]


def encode_words(model: spm.Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words: offsets per word into the flat piece ids."""
    n = len(words)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    tied = np.zeros(n, bool)
    if model.tied:
        hit = np.isin(codes, [ord(c) for c in model.tied])
        tied[np.searchsorted(starts, np.flatnonzero(hit), "right") - 1] = True
    counts, found = np.zeros(n, np.int64), []
    alone = tied if model.kind == "bpe" else np.zeros(n, bool)
    mark = np.uint32(ord(spm.SPACE))
    long = np.flatnonzero((lengths >= spm.segment_size(model)) & ~alone)
    paths: dict[int, tuple[list[int], list[int]]] = {}
    texts = [np.r_[mark, codes[starts[i] : starts[i] + lengths[i]]] for i in long.tolist()]
    for i, tables in zip(long.tolist(), _search_segments(model, texts) if texts else ()):
        if tables:
            paths[i] = _path(*tables)
    alone[long] = True
    for m in np.unique(lengths[~alone]).tolist():
        rows = np.flatnonzero((lengths == m) & ~alone)
        grid = np.empty((len(rows), m + 1), np.uint32)
        grid[:, 0] = mark
        grid[:, 1:] = codes[starts[rows, None] + np.arange(m)]
        back, piece, _ = _search(model, grid)
        own, inner, ends = _walk(back, piece)
        counts[rows] = own
        word = np.repeat(np.arange(len(rows)), own)
        found.append((rows, own, inner, grid[word, ends - 1]))
    for i in np.flatnonzero(alone).tolist():
        if i in paths:
            inner, ends = paths[i]
        else:
            inner = model.encode_scalar(spm.SPACE + words[i].as_py())
            ends = np.cumsum(model.lengths[inner]).tolist()
        last = [codes[starts[i] + e - 2] if e > 1 else mark for e in ends]
        counts[i] = len(inner)
        found.append((np.array([i]), np.array([len(inner)]), np.array(inner), np.array(last, np.uint32)))
    # unknown characters become several ids: count again per word
    out_counts, parts = np.zeros(n, np.int64), []
    for rows, own, inner, last in found:
        ids = model.expand(inner, last)
        if len(ids) != len(inner):
            width = np.ones(len(inner), np.int64)
            unknown = np.flatnonzero(inner == spm.UNKNOWN)
            width[unknown] = [len(chr(c).encode("utf-8", "replace")) for c in last[unknown].tolist()]
            own = np.add.reduceat(width, np.cumsum(own) - own)
        out_counts[rows] = own
        parts.append((rows, own, ids))
    offsets = np.r_[0, np.cumsum(out_counts)]
    flat = np.empty(offsets[-1], np.int32)
    for rows, own, ids in parts:
        flat[spm.spread(offsets[rows], own)] = ids
    return offsets, flat


def encode_texts(model: spm.Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text into the flat piece ids."""
    offsets, words = spm.words_of(texts)
    if not len(words):
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
    coded = words.dictionary_encode()
    word_offsets, ids = encode_words(model, coded.dictionary)
    index = coded.indices.to_numpy()
    lengths = np.diff(word_offsets)[index]
    ends = np.r_[0, np.cumsum(lengths)]
    out = np.empty(ends[-1], np.int32)
    for a in range(0, len(index), 500_000):
        b = min(a + 500_000, len(index))
        out[ends[a] : ends[b]] = ids[spm.spread(word_offsets[index[a:b]], lengths[a:b])]
    return ends[offsets], out


def decode_ids(model: spm.Model, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
    """The texts of token lists. Bytes that are no UTF-8 become U+FFFD."""
    if not hasattr(model, "bytes_flat"):
        model.bytes_flat = np.frombuffer(b"".join(model.text_of), np.uint8)
        model.bytes_len = np.array([len(x) for x in model.text_of], np.int64)
        model.bytes_at = np.cumsum(model.bytes_len) - model.bytes_len
    out: list[str] = []
    at = 0
    while at < len(offsets) - 1:  # some 400,000 tokens at a time
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 400_000, "right")) - 1)
        own = ids[offsets[at] : offsets[end]]
        lengths = model.bytes_len[own]
        data = model.bytes_flat[spm.spread(model.bytes_at[own], lengths)].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][offsets[at : end + 1] - offsets[at]].tolist()
        for a, b in zip(ends, ends[1:]):
            out.append(data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
        at = end
    return out


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens", lossless_col: str | None = None) -> DataFrame:
    """The rows of `docs` with token ids and their number, and, if a name for it is given, a column that says whether
    decoding the ids gives the text again (null as empty)."""
    added = [ids_col, count_col, *filter(None, [lossless_col])]
    rest = docs.drop(*added)
    name, names = fresh(docs, "__spm_text"), [*rest.columns, *added]
    data = spm.shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spm.load(data.value)
        for batch in batches:
            for b in chunks(batch, name):
                offsets, ids = encode_texts(model, b.column(name))
                columns = [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets), pa.int64())]
                if lossless_col:
                    columns.append(_same(decode_ids(model, offsets, ids), b.column(name)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rest.schema.add(ids_col, T.ArrayType(T.IntegerType())).add(count_col, "long")
    if lossless_col:
        out = out.add(lossless_col, "boolean")
    return rest.withColumn(name, docs[text_col]).mapInArrow(run, out)


def _same(texts: list[str], given: pa.Array) -> pa.Array:
    return pc.equal(pa.array(texts, pa.string()), pc.fill_null(given.cast(pa.string()), ""))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """The rows of `tokens` with their text. A null list has a null text."""
    rest = tokens.drop(text_col)
    name, names = fresh(tokens, "__spm_ids"), [*rest.columns, text_col]
    data = spm.shared(tokens, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spm.load(data.value)
        for b in batches:
            lists = b.column(name)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = decode_ids(model, np.r_[0, np.cumsum(lengths)].astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string(), mask=pc.is_null(lists).to_numpy(zero_copy_only=False))], names=names)

    return rest.withColumn(name, tokens[ids_col]).mapInArrow(run, rest.schema.add(text_col, "string"))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers),
    decoded_sha256 (of the decoded text) and same (whether that is the text itself, null as empty)."""
    data = spm.shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spm.load(data.value)
        for batch in batches:
            for b in chunks(batch, "text"):
                offsets, ids = encode_texts(model, b.column("text"))
                raw, ends = ids.astype("<i4").tobytes(), (offsets * 4).tolist()
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:])]
                texts = decode_ids(model, offsets, ids)
                back = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                same = _same(texts, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(digests), pa.array(back), same], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
    return out.withColumnRenamed("id", id_col)
