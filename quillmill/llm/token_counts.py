"""Token counts without tokens: an Aho-Corasick automaton over the vocabulary lists every match in a
batch's distinct words, and dynamic programming from left to right carries, per end position, the best
score and the number of pieces on the best path.

The ties are the tokenizer's own. Unigram: among paths of equal score to one position the one found first
stands, that is the one whose last piece starts first. BPE: the step that is admitted is the only one
whose last two pieces are settled neighbours (see spm.py), so counts equal those of step-by-step merging.
Scores are summed per word in double precision.

A long word is read as segments of one length that advance together, each begun afresh some way into the one
before. Where two agree on as many positions as the longest piece has, in pieces and in what each position adds
to count and score, the later one goes on as the word itself would, and its increments are added.

Defined cases: null and empty text count 0; an unknown character counts as its bytes (as 1 without byte
pieces); words with characters of tied pieces, and long words whose segments do not agree, are searched by
themselves; columns named as the added ones are replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.llm import spm
from quillmill.llm.common import chunks, fresh

#: Stands between words in the text that the automaton reads. A word that holds it is counted by itself.
_BREAK = "\x00"
#: Characters that the automaton reads at a time.
READ = 1_000_000


def _automaton(model: spm.Model):
    if not hasattr(model, "automaton"):
        import ahocorasick

        model.automaton = ahocorasick.Automaton()
        for k, s in enumerate(model.strings):
            if k and model.usable[k]:
                model.automaton.add_word(s, k)
        model.automaton.make_automaton()
    return model.automaton


def _matches(model: spm.Model, text: str, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) and inner ids of all matches, unknown characters among them, by end and then start."""
    packed = np.fromiter(((end + 1) << 20 | k for end, k in _automaton(model).iter(text)), np.int64)
    ends, ids = packed >> 20, packed & ((1 << 20) - 1)
    alone = ~known
    alone[ends[model.lengths[ids] == 1] - 1] = False
    extra = np.flatnonzero(alone) + 1
    ends, ids = np.r_[ends, extra], np.r_[ids, np.zeros(len(extra), np.int64)]
    order = np.argsort(ends * 64 - model.lengths[ids], kind="stable")
    return ends[order], ids[order]


def _search(model: spm.Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One search that all words advance in together: where each begins, and per position the score, the number of
    pieces, and the last piece, with `len(word)` positions after its beginning."""
    text = _BREAK.join(words)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = np.zeros(len(codes), bool)
    gap[(starts + lengths)[:-1]] = True
    ends, ids = _matches(model, text, gap)
    word = np.searchsorted(starts, ends - 1, "right") - 1
    depth = ends - starts[word]
    order = np.argsort(depth, kind="stable")
    ends, ids, depth = ends[order], ids[order], depth[order]
    score, count, last = np.full(len(codes) + 1, -np.inf), np.zeros(len(codes) + 1, np.int64), np.full(len(codes) + 1, -1)
    score[starts] = 0
    width = np.ones(len(ends), np.int64)
    if model.byte_ids is not None and len(unknown := np.flatnonzero(ids == spm.UNKNOWN)):
        c = codes[ends[unknown] - 1]
        width[unknown] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        width[unknown[(c >= 0xD800) & (c < 0xE000)]] = 1
    levels = np.searchsorted(depth, np.arange(1, lengths.max() + 2))
    for a, b in zip(levels, levels[1:]):  # all steps that end at the same position of their words
        e, k, w = ends[a:b], ids[a:b], width[a:b]
        s = e - model.lengths[k]
        if model.kind == "bpe":
            at_start = last[s] < 0
            ok = at_start & (score[s] == 0) & (count[s] == 0)
            inner = np.flatnonzero(~at_start)
            ok[inner] = model.settled(last[s[inner]], k[inner])
            e, k, w, s = e[ok], k[ok], w[ok], s[ok]
            total = score[s] + model.scores[k]
            first = np.r_[True, e[1:] != e[:-1]] if len(e) else np.zeros(0, bool)
        else:
            total = score[s] + model.scores[k]
            heads = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            best = np.repeat(np.maximum.reduceat(total, heads), np.diff(np.r_[heads, len(e)]))
            hit = np.flatnonzero(total == best)
            first = np.zeros(len(e), bool)
            first[hit[np.r_[True, e[hit][1:] != e[hit][:-1]]]] = True
        e, s = e[first], s[first]
        score[e], count[e], last[e] = total[first], count[s] + w[first], k[first]
    return starts, score, count, last


def _count_chunk(model: spm.Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and scores of words."""
    starts, score, count, _ = _search(model, words)
    ends = starts + [len(w) for w in words]
    return count[ends], score[ends]


def _count_long(model: spm.Model, words: list[str]) -> list[tuple[int, float]]:
    """Counts and scores of words that are longer than a segment."""
    size, w = spm.segment_size(model), model.longest
    at = [spm.segments(len(x), model) for x in words]
    rows = [x[a : a + size] for x, s in zip(words, at) for a in s.tolist()]
    ends = np.concatenate([np.r_[size, size - np.diff(s)] for s in at])  # where in a segment the one before it ends
    parts = []
    for a in range(0, len(rows), READ // size):
        own = rows[a : a + READ // size]
        starts, score, count, last = _search(model, own)
        tail = starts[:, None] + np.arange(size - w + 1, size + 1)
        head = starts[:, None] + ends[a : a + len(own), None] + np.arange(-w + 1, 1)
        parts.append([x[i] for i in (tail, head) for x in (last, count, score)])
    last, count, score, last0, count0, score0 = (np.concatenate(x) for x in zip(*parts))
    same = last[:-1] == last0[1:]
    same &= (count[:-1] - count[:-1, -1:]) == (count0[1:] - count0[1:, -1:])
    if model.kind != "bpe":
        same &= np.abs((score[:-1] - score[:-1, -1:]) - (score0[1:] - score0[1:, -1:])) < 1e-6
    same, out, row = same.all(axis=1), [], 0
    for word, s in zip(words, at):
        k = row + len(s) - 1
        if same[row:k].all():
            out.append((int(count[row : k + 1, -1].sum() - count0[row + 1 : k + 1, -1].sum()), float(score[row : k + 1, -1].sum() - score0[row + 1 : k + 1, -1].sum())))
        else:
            out.append(_count_alone(model, word))
        row = k + 1
    return out


def _count_alone(model: spm.Model, word: str) -> tuple[int, float]:
    inner = np.array(model.encode_scalar(word))
    n = len(inner)
    if model.byte_ids is not None and (unknown := np.flatnonzero(inner == spm.UNKNOWN)).size:
        at = np.cumsum(model.lengths[inner]) - 1
        n += sum(len(word[i].encode("utf-8", "replace")) - 1 for i in at[unknown].tolist())
    return n, float(model.scores[inner].sum())


def count_words(model: spm.Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and scores of distinct words (each with the space before it)."""
    counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
    marks = model.tied if model.kind == "bpe" else frozenset()
    plain, long, size = [], [], 0

    def flush() -> None:
        if plain:
            counts[plain], scores[plain] = _count_chunk(model, [spm.SPACE + words[i] for i in plain])
            plain.clear()

    for i, w in enumerate(words):
        is_long = len(w) >= spm.segment_size(model)
        if any(c in w for c in marks) or (is_long and _BREAK in w):
            counts[i], scores[i] = _count_alone(model, spm.SPACE + w)
        elif is_long:
            long.append(i)
        else:
            if size + len(w) > READ or _BREAK in w:
                flush()
                size = 0
            plain.append(i)
            size += len(w) + 2
            if _BREAK in w:
                flush()
                size = 0
    flush()
    if long:
        for i, found in zip(long, _count_long(model, [spm.SPACE + words[i] for i in long])):
            counts[i], scores[i] = found
    return counts, scores


def count_texts(model: spm.Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed score of each text."""
    offsets, words = spm.words_of(texts)
    if not len(words):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts))
    coded = words.dictionary_encode()
    counts, scores = count_words(model, coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    totals = (np.r_[0, np.cumsum(counts[index])][offsets], np.r_[0.0, np.cumsum(scores[index])][offsets])
    return np.diff(totals[0]), np.diff(totals[1])


def count(docs: DataFrame, model_path: str, text_col: str = "text", count_col: str = "n_tokens", score_col: str = "score") -> DataFrame:
    """The rows of `docs` with two more columns: how many tokens, and the summed score of their pieces."""
    rest = docs.drop(count_col, score_col)
    name, names = fresh(docs, "__count_text"), [*rest.columns, count_col, score_col]
    data = spm.shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spm.load(data.value)
        for batch in batches:
            for b in chunks(batch, name):
                n, s = count_texts(model, b.column(name))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(s)], names=names)

    return rest.withColumn(name, docs[text_col]).mapInArrow(run, rest.schema.add(count_col, "long").add(score_col, "double"))
