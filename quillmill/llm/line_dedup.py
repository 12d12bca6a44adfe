"""Line dedup: hashes of lines are range-partitioned and sorted by document and position, and each
partition is read as a stream that keeps the first occurrence (that in the largest document id).

The range key is (hash, document), so a line that a third of all documents share is spread over many
partitions. Only the runs at a partition's two ends can be incomplete; their rows are settled in a
second step from a summary with at most two keys a partition (and one for each million rows of a run,
which is passed on rather than held).

The outcome is a compressed keep-bitmap per document that loses a line. apply() brings the bitmaps to the texts
where they are few (a measured size), and else moves texts of documents that may have one.

Defined cases: null text is one empty line; a line's key is the line stripped of ASCII white space with
A-Z lower-cased; lines of a null id rank as the smallest id; rows that repeat an id count as one document, and
each row's own lines are judged; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import bloom
from quillmill.llm.common import chunks, cut, shuffle_partitions

MIN_CHARS, MIN_DOCS = 20, 3
#: Rows of one run that are held until its end is seen.
HOLD = 1 << 20
#: Lines that a range holds about.
RANGE = 1_000_000
#: Bytes of bitmaps that are broadcast at most.
BROADCAST = 16_000_000
_KEY = ("h1", "h2", "doc", "row", "pos")
_LOWEST = -(2**63)
#: Two keys of the hash function, so that a line has 128 independent bits.
_SEEDS = ("line-dedup-key-1", "line-dedup-key-2")


def _hashed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch, "text"):
            lists = pc.split_pattern(b.column("text"), "\n")
            ends = lists.offsets.to_numpy().astype(np.int64)
            key = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=" \t\n\x0b\x0c\r"))
            at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), min_chars).to_numpy(zero_copy_only=False))
            coded = key.take(pa.array(at)).dictionary_encode()
            known, index = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy(zero_copy_only=False)
            hashes = [(pd.util.hash_array(known, hash_key=seed, categorize=False) if len(known) else np.zeros(0, np.uint64)).view(np.int64)[index] for seed in _SEEDS]
            row = np.searchsorted(ends - ends[0], at, "right") - 1
            own = [b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "row")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*hashes, *own, at - (ends - ends[0])[row])], names=list(_KEY))


def lines_of(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, row, pos) of each line whose key is long enough; 128 bits of hash stand for the key."""
    return rows.select("doc", "row", "text").mapInArrow(lambda batches: _hashed(batches, min_chars), ", ".join(f"{c} long" for c in _KEY))


def _to_drop(cols: list[np.ndarray], min_docs: int) -> np.ndarray:
    """Of whole runs, sorted: which rows are lines of a key in enough documents, but not of its first one."""
    new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new_doc = new | np.r_[True, cols[2][1:] != cols[2][:-1]]
    return (np.add.reduceat(new_doc.astype(np.int64), starts)[run] >= min_docs) & (cols[2] != cols[2][starts][run])


def _first_occurrences(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted lines in; out come the lines to drop (settled) and all lines of runs that may go on in another
    partition or are too long to hold (not settled)."""
    empty = [np.empty(0, np.int64)] * len(_KEY)
    held, passing, begun = empty, None, False

    def out(cols: list[np.ndarray], settled: bool) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in cols]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(cols[0]), settled))], names=[*_KEY, "settled"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        held, n = empty, len(cols[0])
        starts = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        lead, first_key = 0, (cols[0][0], cols[1][0])
        if not begun or passing == first_key:
            begun, passing = True, first_key
            lead = int(starts[1]) if len(starts) > 1 else n
            yield out([c[:lead] for c in cols], False)
            if lead == n:
                continue
        last = int(starts[-1])
        if last > lead:
            whole = [c[lead:last] for c in cols]
            drop = _to_drop(whole, min_docs)
            yield out([c[drop] for c in whole], True)
        passing, held = None, [c[last:] for c in cols]
        if n - last > HOLD:
            yield out(held, False)
            passing, held = (held[0][0], held[1][0]), empty
    if len(held[0]):
        yield out(held, False)


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, pos) of the lines to drop."""
    lines = cut(lines)  # hashed once, for the sample of the ranges and for dealing
    n = max(shuffle_partitions(lines.sparkSession), lines.count() // RANGE)
    dealt = lines.repartitionByRange(n, "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "row", "pos").select(*_KEY)
    seen = cut(dealt.mapInArrow(lambda batches: _first_occurrences(batches, min_docs), ", ".join(f"{c} long" for c in _KEY) + ", settled boolean"))
    ends = seen.where("not settled")
    keys = ends.groupBy("h1", "h2").agg(F.max("doc").alias("first"), F.countDistinct("doc").alias("n")).where(F.col("n") >= min_docs)
    late = ends.join(F.broadcast(keys.select("h1", "h2", "first")), ["h1", "h2"]).where("doc <> first")
    return seen.where("settled").select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def _bitmap(drop: list[int]) -> bytes:
    keep = np.ones((max(drop) // 8 + 1) * 8, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def _bits(keep: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool)


def _with_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        drop = b.column("drop").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), pa.array([len(d) for d in drop], pa.int64()), pa.array([_bitmap(d) for d in drop], pa.binary())], names=["doc", "row", "n_dropped", "keep"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(_LOWEST)).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each document that loses a line: doc, row (hash of its text), n_dropped, and keep, a zlib-compressed bitmap
    with a bit per line, most significant bit first; lines beyond its end are kept, as are all lines of other documents."""
    drop = dropped_lines(lines_of(_rows(docs, id_col, text_col), min_chars), min_docs)
    return drop.groupBy("doc", "row").agg(F.collect_set("pos").alias("drop")).mapInArrow(_with_bitmaps, "doc long, row long, n_dropped long, keep binary")


def _kept(text: str, keep: bytes) -> str:
    lines, bits = text.split("\n"), _bits(keep)
    return "\n".join([line for line, k in zip(lines, bits) if k] + lines[len(bits) :])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_kept(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), b.column("n_lines"), b.column("n_dropped")], names=["id", "text", "n_lines", "n_dropped"])


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST, **options) -> DataFrame:
    """One row per row of `docs`: id, text (its kept lines), n_lines (before), n_dropped. At most `broadcast` bytes of
    bitmaps are sent to all texts."""
    bitmaps = cut(keep_bitmaps(docs, id_col, text_col, **options))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = _rows(docs, id_col, text_col).withColumn("n_lines", n_lines.cast("long"))
    size = bitmaps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("keep") + 64), F.lit(0)).alias("bytes")).first()
    whole = lambda df: df.select("id", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    if size.bytes <= broadcast:
        joined = rows.join(F.broadcast(bitmaps), ["doc", "row"], "left")
        same, less = [whole(joined.where(F.col("keep").isNull()))], joined.where(F.col("keep").isNotNull())
    else:
        own = F.struct("doc", "row")
        flagged = bloom.flag(rows, own, bloom.of_keys(bitmaps, own, size.n), "maybe")
        moved = flagged.where("maybe").join(bitmaps, ["doc", "row"], "left")
        same, less = [whole(flagged.where(~F.col("maybe"))), whole(moved.where(F.col("keep").isNull()))], moved.where(F.col("keep").isNotNull())
    out = less.select("id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_cut_texts, f"id {dict(docs.dtypes)[id_col]}, text string, n_lines long, n_dropped long")
    for part in same:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "text", "n_lines", "n_dropped")


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """apply() with the SHA-256 of the kept text in place of the text."""
    out = apply(docs, id_col=id_col, **options)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.pos, (h.key IS NOT NULL AND k.doc_id <> h.keeper) AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
