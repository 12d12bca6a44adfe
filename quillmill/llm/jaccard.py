"""N-gram Jaccard join: which documents share enough word shingles, exactly, over whole texts.

Two documents link when |A & B| / |A | B| >= 3/4 for their sets of 5-word shingles. The product of
the document by n-gram incidence matrix with its transpose holds all overlaps; it is computed block by
block, and size-derived bounds keep out what cannot reach the threshold:

1. A linked document shares at least 3/4 of its shingles, so of any part of them all but a quarter of its whole
   number. With shingles dealt by hash, one pass counts per document which of those with an even hash occur
   elsewhere; documents below the bound link with nothing. Each task sends a shingle once, whatever the number
   of its documents, so common passages do not weigh.
2. Documents with equal sets become one class, represented by the smallest id.
3. Among the representatives, shingles are counted exactly. Ordered by that count, a document's rarest quarter and
   one more must hold one of the rarest seventh and one more of any linked document that is no larger;
   documents that meet there form candidate groups.
4. A group's incidence matrix is multiplied by its transpose. Small groups take one block each; a large
   group is cut into blocks by set size, only pairs of blocks whose sizes allow a link meet, and overlaps
   below ceil(3 (a + b) / 7) are discarded. Large groups first meet a few blocks of their own; what that links
   is contracted, and blocks of one component need not meet each other.
5. Links (a spanning forest per block) give components.

No list of pairs is built but for the forests. Steps 1 to 3 and 5 move tables of the size of the input or less, in
parts whose number follows the data. Step 4 is linear but for groups of many blocks that do not link: their
pairs of blocks of about one size all meet.

Defined cases: a document of one to four words has one shingle, all its words; null, empty and blank texts have
none and link with nothing; rows that repeat an id share its component, whatever their texts; null ids stay null;
an empty table gives an empty result; other columns are ignored by join() and kept by drop_linked().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import bloom
from quillmill.llm.common import chunks, cut, fresh, shuffle_partitions
from quillmill.llm.components import components

WORDS = 5
#: Documents and shingles that a block of a large group holds about; groups up to this size are one block.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Postings that a part of the shingles holds about, and a task at a time.
PART, HELD = 4_000_000, 3_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- sets of shingles


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text into the flat sorted distinct shingle hashes."""
    # no cast before ascii_lower(): it misreads cast slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, row = flat.filter(pa.array(full)), row[full]
    coded = flat.dictionary_encode()
    h = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(texts))
    start = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        mixed = np.full(len(h), np.uint64(words))
        for k in range(words):
            part = np.zeros(len(h), np.uint64)
            part[: max(0, len(h) - k)] = h[k:]
            mixed = (mixed ^ part) * _MIX
            mixed ^= mixed >> np.uint64(29)
        keep = np.arange(len(h)) - start[row] + words <= count[row]
        few = np.flatnonzero((count > 0) & (count < words))
        one = np.array(count[few], np.uint64) * np.uint64(0x5851F42D4C957F2D)
        for k in range(words - 1):
            more = count[few] > k
            one[more] = (one[more] ^ h[start[few[more]] + k]) * _MIX
            one ^= one >> np.uint64(29)
    row, mixed = np.r_[row[keep], few], np.r_[mixed[keep], one]
    order = np.lexsort((mixed, row))
    row, mixed = row[order], mixed[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])] if len(row) else np.zeros(0, bool)
    return np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(texts)))], mixed[new]


def _signatures(offsets: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
            x = (hashes ^ (hashes >> np.uint64(31))) * salt
            total = np.r_[np.uint64(0), np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)]
            out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out


def _lists(by: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    """The columns, a list per key; `by` names the key of each value, and both are sorted."""
    offsets = pa.array(np.r_[np.searchsorted(by, keys), len(by)].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _tasks(df: DataFrame, values: int) -> int:
    """Partitions for so many 8-byte values: some 32 MB each."""
    return max(shuffle_partitions(df.sparkSession), int(values) // PART)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and, per value, the number of its row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), size)


def _chunk_id(seq: int) -> int:
    return (TaskContext.get().partitionId() << 32) | seq


# ---- 1: documents that cannot link


_DEALT = "key long, chunk long, ids array<long>, a array<int>, b array<int>, c array<int>, s1 array<long>, s2 array<long>"
_DEALT_NAMES = ["key", "chunk", "ids", "a", "b", "c", "s1", "s2"]


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Per chunk of documents: a row for each part of the shingles that it has any of (a: hashes that one document has,
    b: its number in the chunk, c: hashes that several have), and one for the chunk itself (a: set sizes, b: sizes of
    the even half, c: how many of these recur in the chunk)."""
    seq, held, size = 0, [], 0

    def dealt() -> Iterator[pa.RecordBatch]:
        ids, sets, signs, h, r = zip(*held)
        held.clear()
        start = np.cumsum([0, *map(len, ids)])
        n, chunk = int(start[-1]), _chunk_id(seq)
        h, r = np.concatenate(h), np.concatenate([x + at for x, at in zip(r, start)])
        found, back, times = np.unique(h, return_inverse=True, return_counts=True)
        many = times[back] > 1
        head = [np.concatenate(sets), np.bincount(r, minlength=n), np.bincount(r[many], minlength=n)]
        one_list = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(t))
        wide = [one_list(np.concatenate(x), pa.int64()) for x in zip(*signs)]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk], pa.int64()), pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(ids)), *[one_list(x, pa.int32()) for x in head], *wide], names=_DEALT_NAMES)
        part_of = lambda x: ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        short = lambda x: ((x >> np.uint64(1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        one, several = h[~many], found[times > 1]
        order, order2 = np.argsort(part_of(one), kind="stable"), np.argsort(part_of(several), kind="stable")
        one, r, several = one[order], r[~many][order], several[order2]
        own = np.union1d(part_of(one), part_of(several))
        lists = [*_lists(part_of(one), own, short(one), r.astype(np.int32)), *_lists(part_of(several), own, short(several))]
        none = pa.nulls(len(own), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), chunk)), none, *lists, none, none], names=_DEALT_NAMES)

    for batch in batches:
        for b in chunks(batch, "text"):
            offsets, hashes = shingle_sets(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            even = (hashes & np.uint64(1)) == 0
            held.append((b.column("id").cast(pa.int64()), np.diff(offsets), _signatures(offsets, hashes), hashes[even], row[even]))
            size += len(held[-1][3]) + b.num_rows
            if size >= HELD:
                yield from dealt()
                seq, size = seq + 1, 0
    if held:
        yield from dealt()


def _recurring(part: pa.Table) -> pa.Table:
    """Of a part: per chunk its documents (b) and how many of their shingles here (a) occur elsewhere."""
    if part.column("key")[0].as_py() < 0:
        return part
    one, from_row = _flat(part.column("a"))
    doc, _ = _flat(part.column("b"))
    several, _ = _flat(part.column("c"))
    _, back, times = np.unique(np.r_[one, several], return_inverse=True, return_counts=True)
    weight = np.bincount(back, weights=np.r_[np.ones(len(one)), np.full(len(several), 2)])
    again = weight[back[: len(one)]] > 1
    chunk = part.column("chunk").to_numpy()
    at, n = np.unique(from_row[again].astype(np.int64) << 32 | doc[again], return_counts=True)
    own = np.unique(at >> 32)
    lists = _lists(at >> 32, own, n.astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32))
    none, none32 = pa.nulls(len(own), pa.list_(pa.int64())), pa.nulls(len(own), pa.list_(pa.int32()))
    return pa.table([pa.array(np.zeros(len(own), np.int64)), pa.array(chunk[own]), none, *lists, none32, none, none], names=_DEALT_NAMES)


def _judge(chunk: pa.Table) -> pa.Table:
    """Per document of a chunk: may it link?"""
    own = pc.less(chunk.column("key"), 0)
    head, rest = chunk.filter(own), chunk.filter(pc.invert(own))
    n, half, recur = (_flat(head.column(c))[0].astype(np.int64) for c in "abc")
    times, _ = _flat(rest.column("a"))
    doc, _ = _flat(rest.column("b"))
    recur = recur + np.bincount(doc, weights=times, minlength=len(n)).astype(np.int64)
    live = (n > 0) & (recur >= half - n // 4)
    s1, s2 = (_flat(head.column(c))[0] for c in ("s1", "s2"))
    ids = head.column("ids").combine_chunks().flatten()
    return pa.table([ids, pa.array(n), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(live)], names=["id", "n", "s1", "s2", "live"])


def judged(rows: DataFrame) -> DataFrame:
    """(id, n, s1, s2, live) per row (id, text): set size, signature, and whether it may link at all."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("x")).first().x
    parts = _tasks(rows, size // 12)  # some 6 bytes of text a word, of which every other posting is dealt
    dealt = rows.mapInArrow(lambda batches: _deal(batches, parts), _DEALT).repartition(parts, "key")
    counted = dealt.groupBy("key").applyInArrow(_recurring, _DEALT)
    return counted.groupBy("chunk").applyInArrow(_judge, "id long, n long, s1 long, s2 long, live boolean")


# ---- 2, 3: representatives and their candidate groups


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch, "text"):
            offsets, hashes = shingle_sets(b.column("text"))
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(s) for s in _signatures(offsets, hashes)], sets], names=["id", "s1", "s2", "shingles"])


def representatives(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, shingles) for one row of each class (rep, s1, s2)."""
    maybe = bloom.flag(rows, F.col("id"), bloom.of_keys(classes, F.col("rep")), "maybe").where("maybe").select("id", "text")
    sets = maybe.mapInArrow(_with_sets, "id long, s1 long, s2 long, shingles array<long>")
    found = sets.join(classes.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"])
    return found.groupBy("id", "s1", "s2").agg(F.first("shingles").alias("shingles")).select("id", "shingles")


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, ids, n, shingles) of many documents each."""
    seq = 0
    for b in batches:
        total = np.cumsum(pc.list_value_length(b.column("shingles")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
            part, at = b.slice(at, end - at), end
            values, row = _flat(part.column("shingles"))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (part.column("id").to_numpy(), np.bincount(row, minlength=part.num_rows).astype(np.int64), values.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([_chunk_id(seq)], pa.int64()), *lists], names=["chunk", "ids", "n", "shingles"])
            seq += 1


def _deal_counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            found, times = np.unique(b.column("shingles")[i].values.to_numpy(zero_copy_only=False), return_counts=True)
            part = ((found.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            own = np.unique(part)
            lists = _lists(part[order], own, found[order], times[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), b.column("chunk")[i].as_py())), *lists], names=["key", "chunk", "h", "n"])


def _totals(part: pa.Table) -> pa.Table:
    """Per chunk the shingles of this part that several documents have, with the number of documents."""
    h, row = _flat(part.column("h"))
    n, _ = _flat(part.column("n"))
    _, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, weights=n)[back].astype(np.int32) if len(h) else np.zeros(0, np.int32)
    several = total > 1
    own = np.unique(row[several])
    return pa.table([pa.array(part.column("chunk").to_numpy()[own]), *_lists(row[several], own, h[several], total[several])], names=["chunk", "h", "n"])


def _prefixes(sets: pa.Table, totals: pa.Table) -> pa.Table:
    """Per document that may link: its rarest quarter of shingles and one more, without those it has alone; `low`
    marks the rarest seventh and one more."""
    ids, _ = _flat(sets.column("ids"))
    n, _ = _flat(sets.column("n"))
    shingles, _ = _flat(sets.column("shingles"))
    h, _ = _flat(totals.column("h"))
    total, _ = _flat(totals.column("n"))
    order = np.argsort(h, kind="stable")
    h, total = h[order], total[order]
    doc = np.repeat(np.arange(len(ids)), n)
    at = np.minimum(np.searchsorted(h, shingles), max(0, len(h) - 1))
    shared = h[at] == shingles if len(h) else np.zeros(len(shingles), bool)
    alone = n - np.bincount(doc[shared], minlength=len(ids))
    doc, shingles, rare = doc[shared], shingles[shared], total[at[shared]] if len(h) else np.zeros(0, np.int32)
    order = np.lexsort((shingles, rare, doc))
    doc, shingles = doc[order], shingles[order]
    first = np.searchsorted(doc, np.arange(len(ids)))
    rank = np.arange(len(doc)) - first[doc] + alone[doc]
    take = rank < (n // 4 + 1)[doc]
    return pa.table([pa.array(ids[doc[take]], pa.int64()), pa.array(shingles[take], pa.int64()), pa.array((rank < (n // 7 + 1)[doc])[take])], names=["id", "h", "low"])


def candidate_groups(bundles: DataFrame, shingles: int) -> DataFrame:
    """(id, component) of documents that meet in a rare shingle, directly or by way of others. A linked pair's smaller
    document has at most a seventh of its shingles alone, so a shingle in nobody's rarest seventh joins nobody."""
    tasks = _tasks(bundles, shingles)
    counts = bundles.mapInArrow(lambda batches: _deal_counts(batches, tasks), "key long, chunk long, h array<long>, n array<int>").repartition(tasks, "key")
    totals = counts.groupBy("key").applyInArrow(_totals, "chunk long, h array<long>, n array<int>")
    rare = cut(bundles.repartition(tasks, "chunk").groupBy("chunk").cogroup(totals.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_prefixes, "id long, h long, low boolean"))
    hubs = rare.groupBy("h").agg(F.min("id").alias("v"), F.count("*").alias("n"), F.bool_or("low").alias("low")).where("n > 1 and low").select("h", "v")
    return components(rare.join(cut(hubs), "h").select(F.col("id").alias("u"), "v"))


# ---- 4: overlaps within groups


def _links(sizes: np.ndarray, doc: np.ndarray, shingle: np.ndarray, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's documents that link. The product of incidence matrix and transpose is summed
    over blocks of shingles, each with `cells` terms about."""
    k = len(sizes)
    order = np.lexsort((doc, shingle))
    doc, shingle = doc[order], shingle[order]
    new = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(shingle)])
    new, times = new[times > 1], times[times > 1]
    overlap, done = np.zeros(k * k, np.int32), np.cumsum(times.astype(np.int64) ** 2)
    a = 0
    while a < len(new):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + cells, "right")))
        start, t = new[a:b], times[a:b]
        rows = np.repeat(start, t) + _within(t)
        left = np.repeat(doc[rows], np.repeat(t, t))
        right = doc[np.repeat(np.repeat(start, t), np.repeat(t, t)) + _within(np.repeat(t, t))]
        overlap += np.bincount(left.astype(np.int64) * k + right, minlength=k * k).astype(np.int32)
        a = b
    overlap = overlap.reshape(k, k)
    i, j = np.nonzero(np.triu(7 * overlap.astype(np.int64) >= 3 * (sizes[:, None] + sizes[None, :]), 1))
    return i, j


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1, for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the pairs to connect what they connect."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _link_tile(tile: pa.Table) -> pa.Table:
    """Links between the documents of each group in a tile."""
    ids, group = tile.column("id").to_numpy(), tile.column("grp").to_numpy()
    shingles, row = _flat(tile.column("shingles"))
    out: list[tuple[int, int]] = []
    order = np.argsort(group, kind="stable")
    size = np.bincount(row, minlength=len(ids))
    at = np.cumsum(size) - size
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(rows) > 1:
            n = size[rows]
            own = shingles[np.repeat(at[rows], n) + _within(n)]
            i, j = _links(n, np.repeat(np.arange(len(rows)), n), own)
            out += [(int(ids[rows[a]]), int(ids[rows[b]])) for a, b in _forest(len(rows), i, j)]
    u, v = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
    return pa.table([pa.array(u), pa.array(v)], names=["u", "v"])


def _run_tiles(tiled: DataFrame, shingles: int) -> DataFrame:
    """tiled: (tile, grp, id, shingles), with so many shingles about."""
    tasks = _tasks(tiled, shingles)
    return cut(tiled.repartition(tasks, "tile").groupBy("tile").applyInArrow(_link_tile, "u long, v long"))


def links(sets: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): a spanning forest, at least, of the links within the groups. sets: (id, shingles); groups: (id,
    component)."""
    member = groups.select("id", F.col("component").alias("grp")).unionByName(groups.select(F.col("component").alias("id"), F.col("component").alias("grp")).distinct())
    docs = cut(sets.join(member, "id").select("id", "grp", F.size("shingles").alias("n"), "shingles"))
    sizes = docs.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    sizes = cut(sizes.withColumn("large", (F.col("members") > block) | (F.col("total") > BLOCK_SHINGLES)))
    held = sizes.groupBy("large").agg(F.sum("total").alias("total")).collect()  # a row or two
    held = {r.large: r.total for r in held}
    docs = docs.join(sizes.select("grp", "large"), "grp")
    tile = F.pmod(F.xxhash64("grp"), F.lit(4 * _tasks(sets, held.get(False, 0))))
    found = _run_tiles(docs.where(~F.col("large")).select(tile.alias("tile"), "grp", "id", "shingles"), held.get(False, 0))
    if True in held:
        found = found.unionByName(_large_links(docs.where("large").select("id", "grp", "n", "shingles"), block))
    return found


def _large_links(docs: DataFrame, block: int) -> DataFrame:
    plain = cut(docs.select("id", "grp", "n", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(4 / 3)))).cast("int").alias("cls")))
    # first all documents meet one block of their own size class and of the next
    first = _meet(docs, _blocks(plain.withColumn("comp", F.lit(None).cast("long")), block), hubs_only=True)
    linked = plain.join(components(first).withColumnRenamed("component", "comp"), "id", "left")
    linked = cut(linked.withColumn("comp", F.coalesce("comp", "id")))
    rest = _meet(docs, _blocks(linked, block), hubs_only=False)
    return first.unionByName(rest)


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """docs: (id, grp, n, cls, comp). (id, grp, n, cls, pure, sub): pure is the component that the block consists of, if
    it is of one; sub numbers the blocks alike."""
    per = docs.groupBy("grp", "cls", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n")).withColumn("pure", F.when(F.col("k") >= block // 2, F.col("comp")))
    key = [F.col("grp"), F.col("cls"), F.col("pure")]
    full = F.greatest(F.sum("k") / block, F.sum("n") / BLOCK_SHINGLES)
    held = per.groupBy(*key).agg(F.ceil(full).cast("int").alias("subs"))
    per = cut(per.select(F.col("grp").alias("g1"), F.col("cls").alias("k1"), F.col("comp").alias("c1"), "pure"))
    held = cut(held.select(F.col("grp").alias("g2"), F.col("cls").alias("k2"), F.col("pure").alias("c2"), "subs"))
    same = lambda i, c: (F.col("grp") == F.col(f"g{i}")) & (F.col("cls") == F.col(f"k{i}")) & F.col(c).eqNullSafe(F.col(f"c{i}"))
    out = docs.join(per, same(1, "comp")).join(held, same(2, "pure"))
    return cut(out.select("id", "grp", "n", "cls", "pure", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub")))


def _meet(docs: DataFrame, blocks: DataFrame, hubs_only: bool) -> DataFrame:
    """Links between documents of blocks that meet: those of one size class or of neighbouring ones, but not two
    of one component. With hubs_only, one of the two is the first block of its class."""
    one = blocks.select("grp", "cls", "pure", "sub").distinct()
    name = lambda p: F.concat_ws("/", f"{p}cls", F.coalesce(F.col(f"{p}pure").cast("string"), F.lit("-")), f"{p}sub")
    left, right = (one.select("grp", *[F.col(c).alias(p + c) for c in ("cls", "pure", "sub")]).withColumn(p + "name", name(p)) for p in "lr")
    pairs = left.join(right, "grp").where((F.col("rcls") - F.col("lcls")).between(0, 1) & ((F.col("lcls") < F.col("rcls")) | (F.col("lname") <= F.col("rname"))))
    pairs = pairs.where(F.col("lpure").isNull() | ~F.col("lpure").eqNullSafe(F.col("rpure")))
    if hubs_only:
        pairs = pairs.where((F.col("lsub") == 0) | (F.col("rsub") == 0))
    tile = F.xxhash64("grp", "lname", "rname")
    use = pairs.select("grp", tile.alias("tile"), F.explode(F.array_distinct(F.array("lname", "rname"))).alias("name"))
    placed = cut(blocks.select("id", "grp", "n", name("").alias("name")).join(cut(use), ["grp", "name"]).select("id", "tile", "grp", "n"))
    shingles = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _run_tiles(placed.drop("n").join(docs.select("id", "shingles"), "id").select("tile", "grp", "id", "shingles"), shingles)


# ---- the operator


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): edges between ids that repeat with different texts and the representatives of these."""
    sign = F.struct("s1", "s2", "n")
    several = cut(rows.where("id is not null").groupBy("id").agg(F.min(sign).alias("lo"), F.max(sign).alias("hi")).where("lo <> hi").select("id"))
    return cut(rows.join(several, "id").join(classes, ["s1", "s2", "n"]).select(F.col("id").alias("u"), F.col("rep").alias("v")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_ = cut(judged(rows))
    may = F.col("live") & F.col("id").isNotNull()
    live = all_.where(may)
    classes = cut(live.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    sets = cut(representatives(rows, classes))
    bundles = cut(sets.mapInArrow(_bundle, "chunk long, ids array<long>, n array<long>, shingles array<long>"))
    shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same_id = _of_one_id(all_, classes)
    found = cut(components(links(sets, cut(candidate_groups(bundles, shingles)), block).unionByName(same_id)))
    named = cut(classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component")))
    rest = all_.where(~may)
    if same_id.limit(1).count():
        own = found.join(same_id.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
        rest = rest.join(own, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    else:
        rest = rest.select("id", "n", F.col("id").alias("component"))
    joined = live.join(named, ["s1", "s2", "n"]).select("id", "n", "component")
    return rest.unionByName(joined).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` with one row of each component, that with the smallest id."""
    name, gone = fresh(docs, "__maybe_linked"), fresh(docs, "__linked")
    lost = join(docs, id_col, text_col, **options).where(F.col(id_col) > F.col("component_id"))
    lost = cut(lost.select(F.col(id_col).cast("long").alias(gone)).distinct())
    flagged = bloom.flag(docs, F.col(id_col).cast("long"), bloom.of_keys(lost, F.col(gone)), name)
    rest = flagged.where(F.col(name)).join(lost, F.col(id_col).cast("long") == F.col(gone), "left_anti")
    return flagged.where(~F.col(name)).unionByName(rest).drop(name)
