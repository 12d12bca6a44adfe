"""Token ids of documents in raw binary files, with a minimal perfect hash index for keyed access.

A dataset is a folder:

* payload/part-K-*: shard K: the ids of its documents, one after the other, as little-endian unsigned integers of two bytes where
  all ids fit, else of four. Documents are in ascending order of id, over all shards; each ends with the end id. A
  footer lists the documents' ids and sizes, so that a shard can be read by itself.
* shards: a row per shard (Parquet): its file, its documents and ids, and the ids in all shards before it.
* index: a row per bucket of some thousand keys (Parquet): a minimal perfect hash function of the keys, and one entry of
  fixed width per slot: the key's fingerprint, shard, offset in it, number of ids, and how many documents have its id.

A lookup hashes a key to its bucket and slot, compares the fingerprint and reads one range of one shard's file: constant
work for each key. A key that is not there passes for another with a chance of 2^-32. Keys that are asked for
together are read in order of place, so that a scan reads every file once. Files are written by Spark's committed
writers and read by pyarrow.fs, which knows local paths, HDFS, S3 and GCS; the payload is never shuffled on reading.

The tokenizer sees each distinct stretch of text once, while a task remembers it: there are places where a byte-level
pre-tokenizer surely begins a word, and stretches between such places encode by themselves. Texts with the name of an added token, and all texts of other kinds of tokenizers, are encoded whole.

Defined cases: a null text is empty and has the end id alone; a null id sorts before all ids and can be looked up
as null; documents that repeat an id lie next to each other, in an order that depends on their texts' hashes, and a lookup
of the id gives all of them; an id that is asked for twice is answered once, one that is not there not at all;
one very long text makes one long range; an empty table makes an empty dataset; other columns are ignored. Ids are integers,
the end id is below 2^31.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import perfect_hash
from quillmill.llm.common import broadcast_if_small, chunks, shuffle_partitions, stored

#: Bytes of text a shard has about, and bytes it has at least where shards are made smaller to keep all tasks busy.
SHARD_BYTES, LEAST_BYTES = 256_000_000, 1_000_000
#: Keys a bucket of the index has about; sampled keys per shard when shards are cut; ids that are read at once, about.
BUCKET, A_SHARD, READ = 4096, 64, 1_000_000
#: Distinct stretches of text whose ids a task remembers.
REMEMBERED = 600_000
_MARK = b"tokens1"
_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4"), ("documents", "<u8")])
_ORDER = ("id", "tie", "salt")


# -- Encoding


def _kinds() -> np.ndarray:
    """Bits of bytes: 1 ASCII letter, 2 ASCII white space, 4 other printable ASCII, 8 first byte of a letter of two bytes (of
    most; two signs are among them), 16 a byte that continues."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 4
    for low in (0x41, 0x61):
        kind[low : low + 26] = 1
    kind[0x09:0x0E] = kind[0x20] = 2
    kind[0xC3:0xC6] = 8
    kind[0x80:0xC0] = 16
    return kind


_KINDS = _kinds()


class Encoder:
    """Texts to ids by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.splits = (
            spec["normalizer"] is None and spec["truncation"] is None and spec["padding"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
            and not spec["model"].get("dropout")
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.size = array("I"), array("q"), array("q")

    def _borders(self, data: np.ndarray) -> np.ndarray:
        """Where a byte-level pre-tokenizer surely begins a word, whatever stands further left or right: at white space after
        something else, at another character after a letter, and at a letter after a sign or digit (but for the apostrophe)."""
        kind = _KINDS[data]
        now, one, two = kind[2:], kind[1:-1], kind[:-2]
        wide = (one == 16) & (two == 8)
        letter = (one == 1) | wide & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # these two are signs after C3
        space = (now == 2) & ((one == 1) | (one == 4) | wide)
        return np.flatnonzero(space | (now == 4) & letter | (now == 1) & (one == 4) & (data[1:-1] != 0x27)) + 2

    def _note(self, stretch: bytes, ids: list[int] | array) -> None:
        self.known[stretch] = len(self.first)
        self.first.append(len(self.pool))
        self.size.append(len(ids))
        self.pool.extend(ids)

    def _of(self, stretches: list[bytes]) -> np.ndarray:
        """Where in `first` and `size` the ids of these stretches are noted."""
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:  # what came up again stays
            known, pool, first, size = self.known, self.pool, self.first, self.size
            self._forget()
            for s in stretches:
                if (at := known.get(s)) is not None:
                    self._note(s, pool[first[at] : first[at] + size[at]])
        for s, e in zip(new, self.tokenizer.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)):
            self._note(s, e.ids)
        return np.array([self.known[s] for s in stretches], np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and each with the end id, and how many each has. No text is null."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        starts = offsets[:-1][np.diff(offsets) > 0]  # an empty text is no stretch at all
        if self.splits and len(data) > 2:
            cuts = offsets[0] + self._borders(data[offsets[0] : offsets[-1]])
            named = np.zeros(n, bool)
            for token in self.added:
                named |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            if named.any():
                cuts = cuts[~named[np.searchsorted(offsets, cuts, "right") - 1]]
            starts = np.sort(np.r_[starts, cuts], kind="stable")
            starts = starts[np.diff(starts, prepend=-1) > 0]
        bounds = np.r_[starts, offsets[-1]].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), raw]).dictionary_encode()
        noted = self._of(coded.dictionary.to_pylist())
        pool, first, size = np.array(self.pool, "<u4"), np.array(self.first, np.int64)[noted], np.array(self.size, np.int64)[noted]
        pool, first, size = np.r_[pool, np.array([end_id], "<u4")], np.r_[first, len(pool)], np.r_[size, 1]
        ends = np.searchsorted(starts, offsets[1:], "left")  # stretches up to the end of each text
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(noted))
        long = size[codes]
        upto = np.cumsum(long)
        out = pool[np.repeat(first[codes] - (upto - long), long) + np.arange(upto[-1] if n else 0)]
        return out, np.diff(upto[ends + np.arange(n)], prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# -- Shards


def _bounds(rows: DataFrame, shards: int, total: int) -> np.ndarray:
    """The first keys of all shards but one, from a sample weighted by size; at most a row per shard reaches the driver."""
    chance = F.col("n") * F.lit(A_SHARD * shards / max(total, 1))
    u = F.xxhash64(*_ORDER, F.lit("sample")).cast("double") / F.lit(2.0**64) + 0.5
    key = F.struct(F.col("id").isNotNull().alias("f"), F.coalesce("id", F.lit(0)).alias("id"), "tie", "salt")
    drawn = rows.where(u < chance).select(key.alias("k"), F.greatest(chance, F.lit(1.0)).alias("w"))
    upto = F.sum("w").over(Window.orderBy("k"))
    at = F.floor(upto * shards / F.greatest(F.sum("w").over(Window.partitionBy()), F.lit(1.0)))
    first = drawn.select("k", at.alias("at")).groupBy("at").agg(F.min("k").alias("k")).where(F.col("at").between(1, shards - 1)) if shards > 1 else None
    keys = sorted(tuple(r.k) for r in first.collect()) if first is not None else []
    return np.array(keys, [("f", "?"), ("id", "<i8"), ("tie", "<i8"), ("salt", "<i8")])


def _shard(bounds: np.ndarray) -> Column:
    """How many of the sorted bounds are at most the row's key."""
    if not len(bounds):
        return F.lit(0)

    @F.pandas_udf("int")
    def shard(given: pd.Series, id_: pd.Series, tie: pd.Series, salt: pd.Series) -> pd.Series:
        keys = np.empty(len(id_), bounds.dtype)
        for name, x in zip(bounds.dtype.names, (given, id_, tie, salt)):
            keys[name] = x
        return pd.Series(np.searchsorted(bounds, keys, "right").astype(np.int32))

    return shard(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), F.col("tie"), F.col("salt"))


def _width(tokenizer: str, end_id: int) -> int:
    """Bytes an id takes: two where all ids fit. The last byte of the end id separates documents as Spark's writer writes
    them, so it is an ASCII one."""
    ids = max(_encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if ids <= 1 << 16 and end_id < 1 << 15 else 4
    if not 0 <= end_id < 1 << (8 * width - 1):
        raise ValueError("an end id is not negative and below 2^31")
    return width


def _footer(given: list[np.ndarray], ids: list[np.ndarray], n: list[np.ndarray], last: bytes) -> bytes:
    """What ends a shard's file: whether each document has an id, the ids, and the numbers of token ids; then how many documents
    there are, and a mark."""
    columns = [np.concatenate(x) for x in (given, ids, n)]
    return b"".join(c.astype(t).tobytes() for c, t in zip(columns, ("u1", "<i8", "<u8"))) + np.array([len(columns[0])], "<u8").tobytes() + _MARK + last


def _read_footer(file: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with _open(file) as f:
        f.seek(length - 16)
        tail = f.read(16)
        if tail[8:15] != _MARK:
            raise OSError(f"{file} is not complete")
        count = int(np.frombuffer(tail, "<u8", 1)[0])
        f.seek(length - 16 - 17 * count)
        raw = f.read(17 * count)
    return np.frombuffer(raw, "u1", count).astype(bool), np.frombuffer(raw, "<i8", count, count), np.frombuffer(raw, "<u8", count, 9 * count).astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET) -> None:
    """Writes the dataset of `docs` to the folder `path`, which all machines share and which is not there yet.
    `tokenizer`: a file of the tokenizers library, at the same place on all machines."""
    spark, width = docs.sparkSession, _width(tokenizer, end_id)
    text, last = F.coalesce(F.col(text_col), F.lit("")), end_id.to_bytes(width, "little")[-1:]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("salt"), text.alias("text"))
    sized = rows.withColumn("n", (F.octet_length("text") + 1).cast("long"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-total // shard_bytes), min(shuffle_partitions(spark), total // min(LEAST_BYTES, shard_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's documents in order, then its footer, each without its last byte."""
        encoder, held = _encoder(tokenizer), ([], [], [])
        for batch in batches:
            for b in chunks(batch):
                ids, n = encoder.encode(b.column("text"), end_id)
                raw, ends = memoryview(ids.astype(f"<u{width}").tobytes()), (np.cumsum(n) * width).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([bytes(raw[e - k : e - 1]) for e, k in zip(ends, (n * width).tolist())], pa.binary())], names=["value"])
                id_ = b.column("id")
                for to, x in zip(held, (id_.is_valid().to_numpy(zero_copy_only=False), id_.fill_null(0).to_numpy(), n)):
                    to.append(x)
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([_footer(*held, last)[:-1]], pa.binary())], names=["value"])

    # partition k is shard k, and part-k its file
    placed = rows.repartitionById(shards, _shard(_bounds(sized, shards, total))).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "salt")
    payload = placed.select("id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    payload.write.option("lineSep", last.decode("ascii")).option("compression", "none").text(f"{path}/payload")
    places = _write_shards(spark, path, width)
    _write_index(spark, places, path, bucket, width)


def _write_shards(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Writes the table of shards, from the files' footers. Returns (id, shard, n, offset, nth, documents) of every document;
    nth and documents count those of the same id in the shard."""
    files = spark.read.format("binaryFile").load(f"{path}/payload").where("length > 0").select(F.col("path").alias("file"), "length").withColumn("shard", F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, shard in zip(*(c.to_pylist() for c in b.columns)):
                given, ids, n = _read_footer(file, length)
                if length != width * n.sum() + 17 * len(n) + 16:
                    raise OSError(f"{file} is not as long as its documents")
                new = np.r_[True, (ids[1:] != ids[:-1]) | (given[1:] != given[:-1])]
                first, run_ = np.flatnonzero(new), np.cumsum(new) - 1
                columns = [pa.array(ids, mask=~given), pa.array(np.full(len(n), shard, np.int32)), pa.array(n), pa.array(np.cumsum(n) - n), pa.array(np.arange(len(n)) - first[run_]), pa.array(np.diff(np.r_[first, len(n)])[run_])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "shard", "n", "offset", "nth", "documents"])

    listed = stored(files)
    places = stored(listed.repartition(max(1, min(shuffle_partitions(spark), listed.count())), "shard").mapInArrow(run, "id long, shard int, n long, offset long, nth long, documents long"))
    sizes = places.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    listed.join(sizes, "shard").select("shard", "file", "documents", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")
    return places


# -- Index


def _hashes(key: Column, nth: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key, key.isNull(), nth).alias(name) for seed, name in ((1, "h"), (2, "g"))]


def _over_all_shards(places: DataFrame) -> DataFrame:
    """nth and documents, which count within a shard, made to count over all shards. Only the first and the last id of a shard
    can lie in others too: at most two rows per shard."""
    ends = places.groupBy("shard").agg(F.min("offset").alias("a"), F.max("offset").alias("b"))
    edge = places.join(broadcast_if_small(stored(ends)), "shard").where("offset in (a, b) and nth in (0, documents - 1)").select("id", "shard", "documents").distinct()
    of_id = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = edge.select("id", "shard", F.coalesce(F.sum("documents").over(of_id), F.lit(0)).alias("before"), F.sum("documents").over(Window.partitionBy("id")).alias("total"), "documents").where("total > documents")
    spans = stored(spans.select(F.col("id").alias("i"), F.col("shard").alias("s"), "before", "total"))
    if not spans.limit(1).count():
        return places
    out = places.join(broadcast_if_small(spans), F.col("id").eqNullSafe(F.col("i")) & (F.col("shard") == F.col("s")), "left")
    return out.select("id", "shard", "n", "offset", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), F.coalesce("total", "documents").alias("documents"))


def _write_index(spark: SparkSession, places: DataFrame, path: str, bucket: int, width: int) -> None:
    buckets = max(1, -(-places.count() // bucket))
    entries = _over_all_shards(places).select(*_hashes(F.col("id"), F.col("nth")), "shard", "offset", "n", "documents").withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        h, g = (rows.column(c).to_numpy().view(np.uint64) for c in "hg")
        function, out = perfect_hash.build(h, g), np.empty(len(h), _ENTRY)
        at = perfect_hash.slots(function, h, g)
        out["fingerprint"][at] = perfect_hash.fingerprints(h, g)
        for name in ("shard", "offset", "n", "documents"):
            out[name][at] = rows.column(name).to_numpy()
        return pa.table([rows.column("bucket").slice(0, 1), pa.array([function], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["bucket", "function", "entries"])

    entries.groupBy("bucket").applyInArrow(build, "bucket int, function binary, entries binary").write.parquet(f"{path}/index")
    spark.createDataFrame([(buckets, width)], "buckets int, width int").coalesce(1).write.parquet(f"{path}/meta")


def _probe(keys: DataFrame, path: str) -> DataFrame:
    """(id, nth, shard, offset, n, documents) of those of the keys (id, nth) that are there."""
    spark = keys.sparkSession
    buckets = spark.read.parquet(f"{path}/meta").first().buckets
    asked = keys.select("id", "nth", *_hashes(F.col("id"), F.col("nth"))).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    schema = pa.schema([("id", pa.int64()), ("nth", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()), ("documents", pa.int64())])

    def find(keys: pa.Table, index: pa.Table) -> pa.Table:
        if not keys.num_rows or not index.num_rows:
            return schema.empty_table()
        h, g = (keys.column(c).to_numpy().view(np.uint64) for c in "hg")
        entries = np.frombuffer(index.column("entries")[0].as_buffer(), _ENTRY)
        at = perfect_hash.slots(index.column("function")[0].as_py(), h, g)
        hit = entries[at]
        there = np.flatnonzero((at >= 0) & (hit["fingerprint"] == perfect_hash.fingerprints(h, g)))
        found = keys.select(["id", "nth"]).take(there)
        return pa.table([*found.columns, *[pa.array(hit[n][there].astype(t.to_pandas_dtype())) for n, t in ((f.name, f.type) for f in list(schema)[2:])]], schema=schema)

    index = spark.read.parquet(f"{path}/index")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, "id long, nth long, shard int, offset long, n long, documents long")


# -- Reading


def _open(file: str):
    """A file that Spark wrote, for reading ranges of it."""
    from pyarrow import fs

    kind, rest = file.split(":", 1) if ":/" in file else ("file", file)
    kind = {"s3a": "s3", "s3n": "s3"}.get(kind, kind)
    rest = "/" + rest.lstrip("/") if kind == "file" else rest.removeprefix("//")
    where, name = fs.FileSystem.from_uri(f"{kind}://{quote(rest)}")
    return where.open_input_file(name)


def _spans(start: np.ndarray, n: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring ranges in slices that hold about `most` ids and no gaps of more than 16,384 ids."""
    at = 0
    for i in range(1, len(start) + 1):
        if i == len(start) or start[i] + n[i] - start[at] > most or start[i] - (start[i - 1] + n[i - 1]) > 16_384 or start[i] < start[i - 1]:
            yield slice(at, i)
            at = i


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id", read: int = READ) -> DataFrame:
    """(<id>, start, n_tokens, ids) of the documents with these ids: the ids in the files before it, how many it has, and the
    ids as little-endian unsigned 32-bit integers."""
    spark = keys.sparkSession
    first = stored(_probe(keys.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("nth")).distinct(), path))
    found = first.drop("documents")
    more = first.where("documents > 1")
    if more.limit(1).count():  # the other documents of repeated ids, in steps so that no row lists a hot id's
        step = F.explode(F.sequence(F.lit(1).cast("long"), F.col("documents") - 1, F.lit(8192).cast("long")))
        steps = more.select("id", "documents", step.alias("at")).repartition(shuffle_partitions(spark), "id", "at")
        rest = steps.select("id", F.explode(F.sequence("at", F.least(F.col("at") + 8191, F.col("documents") - 1))).alias("nth"))
        found = found.unionByName(_probe(rest, path).drop("documents"))
    shards = spark.read.parquet(f"{path}/shards").select("shard", "file", "start")
    placed = found.join(broadcast_if_small(shards), "shard").select("id", "file", "offset", "n", (F.col("start") + F.col("offset")).alias("start"))
    dealt = placed.repartition(shuffle_partitions(spark), "file", F.floor(F.col("offset") / (8 * read))).sortWithinPartitions("file", "offset")
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    width = spark.read.parquet(f"{path}/meta").first().width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for b in batches:
            offset, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("offset", "n"))
            files = b.column("file").dictionary_encode()
            codes = files.indices.to_numpy(zero_copy_only=False)
            for run_ in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1):
                file = files.dictionary[int(codes[run_[0]])].as_py()
                if file != name:
                    opened, name = _open(file), file
                for s in _spans(offset[run_], n[run_], read):
                    rows = run_[s]
                    base, end = int(offset[rows[0]]), int(offset[rows[-1]] + n[rows[-1]])
                    opened.seek(width * base)
                    raw = opened.read(width * (end - base))
                    if len(raw) != width * (end - base):
                        raise OSError(f"{file} ends within a document")
                    raw = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                    ids = pa.array([raw[4 * (int(o) - base) : 4 * (int(o + k) - base)] for o, k in zip(offset[rows], n[rows])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in ("id", "start", "n")), ids], schema=schema)

    out = dealt.mapInArrow(run, "id long, start long, n long, ids binary")
    return out.select(F.col("id").alias(id_col), "start", F.col("n").alias("n_tokens"), "ids")
