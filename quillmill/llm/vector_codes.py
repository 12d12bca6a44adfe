"""Product-quantisation codes of vectors, with codebooks learnt by Yinyang Lloyd in whole numbers.

Every component x becomes floor(4096 x); vectors are cut into equal parts, each with a codebook of its own. A round assigns each
part to its nearest entry and moves the entries to the floored means of their parts. As everything is whole numbers,
results do not depend on how rows are dealt out.

Yinyang (Ding et al., "Yinyang k-means", 2015): the entries of a codebook are clustered into groups once. A part carries an
upper bound of the distance to its entry and, for each group, one lower bound of the distance to the group's other entries. When
entries move, the upper bound grows by how far the part's own entry moved, and a group's bound shrinks by how far its
farthest mover went. Groups whose bound still lies above the upper bound are not looked at. The others are scanned in whole
numbers, which settles ties too: bounds are rounded away from each other and only decide what is scanned.

A round is one pass over a table of rows (integers, codes, bounds), which writes the next one; the former is dropped when the next is
complete. A task also writes one row with the sums that its moved parts take from one entry and give to another. Spark adds
them up: a codebook's sums, a number of fixed size, are all that reaches the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; the first row in order of id decides
the length of vectors, and rows of another length are an error, as are components from 2^15 on, whose errors would not fit
64 bits; where the length is no multiple of the parts, zeros are added at the end; a null id comes after all ids and is coded like
others; rows that repeat an id are rows of their own (the smaller vector first); with fewer rows than entries there are as many entries as rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import broadcast_if_small, discard, shared_folder, stored_at

#: A component is floor(SCALE * x).
SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Components are smaller than this.
MOST = 1 << 15
_STATE = "id long, label long, v array<int>, code binary, bounds binary, error long, moved array<long>"


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _groups(book: np.ndarray, groups: int) -> np.ndarray:
    """Entry -> group, by a few rounds of Lloyd among the entries themselves."""
    groups = min(groups, len(book))
    centres = book[np.linspace(0, len(book) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(5):
        own = ((book[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = book[own == g].mean(axis=0)
    return own


def _square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """rows x entries: squared distances, in 64-bit integers."""
    out = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        d = x - e
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


_UP, _DOWN = np.float32(np.inf), np.float32(0)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), _UP), _UP)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float32), -_UP), -_UP), _DOWN)


def assign_part(x: np.ndarray, book: np.ndarray, group: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties to the lower index), the new bounds, and how many distances were taken. `own`: the
    entries before (None at first); `drift`: how far each entry has moved since."""
    n, groups = len(x), int(group.max()) + 1
    members = [np.flatnonzero(group == g) for g in range(groups)]
    if own is None:
        own, work, scan = np.zeros(n, np.int64), np.arange(n), np.ones((n, groups), bool)
        lower = np.zeros((n, groups), np.float32)
        upper = np.zeros(n, np.float32)
    else:
        far = np.array([drift[m].max() if len(m) else 0.0 for m in members])
        upper = _up(upper.astype(np.float64) + drift[own])
        lower = _down(lower.astype(np.float64) - far)
        work = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    d = x[work] - book[own[work]]
    best, entry = np.einsum("ij,ij->i", d, d), own[work].copy()
    upper[work] = _up(np.sqrt(best))
    taken = len(work)
    scan = lower[work] <= upper[work][:, None]
    old, old_square = entry.copy(), best.copy()
    first = np.full((len(work), groups), np.iinfo(np.int64).max)  # the least squares of each scanned group
    first_at, second = np.zeros((len(work), groups), np.int64), first.copy()
    for g, m in enumerate(members):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows) or not len(m):
            continue
        squares = _square(x[work[rows]], book[m])
        taken += squares.size
        k = squares.argmin(axis=1)  # members ascend, so the first of equals is the lowest
        first[rows, g], first_at[rows, g] = squares[np.arange(len(rows)), k], m[k]
        squares[np.arange(len(rows)), k] = np.iinfo(np.int64).max
        second[rows, g] = squares.min(axis=1)
        better = (first[rows, g] < best[rows]) | (first[rows, g] == best[rows]) & (first_at[rows, g] < entry[rows])
        best[rows] = np.where(better, first[rows, g], best[rows])
        entry[rows] = np.where(better, first_at[rows, g], entry[rows])
    # a scanned group's bound: its nearest entry but the row's own
    rest = np.where(first_at == entry[:, None], second, first)
    fresh = _down(np.sqrt(rest.astype(np.float64)))
    kept = lower[work]
    left = (entry != old) & ~scan[np.arange(len(work)), group[old]]  # the entry before is one of the others now
    kept[left, group[old][left]] = np.minimum(kept[left, group[old][left]], _down(np.sqrt(old_square[left])))
    lower[work] = np.where(scan, fresh, kept)
    upper[work] = _up(np.sqrt(best))
    own = own.copy()
    own[work] = entry
    return own, upper, lower, taken


def _moved(x: np.ndarray, new: np.ndarray, old: np.ndarray | None, entries: int) -> np.ndarray:
    """entries x (width + 1): what each entry gains in sums and in count."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    change = np.arange(len(x)) if old is None else np.flatnonzero(new != old)
    for own, sign in ((new, 1), *(() if old is None else ((old, -1),))):
        for e in np.unique(own[change]):
            rows = change[own[change] == e]
            out[e, :-1] += sign * x[rows].sum(axis=0)
            out[e, -1] += sign * len(rows)
    return out


def _pass(batches: Iterator[pa.RecordBatch], books: np.ndarray, groups: np.ndarray, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """State rows to state rows under `books` (parts x entries x width), and at last a row of sums. `before`: the
    books that the state's bounds speak of."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, width + 1), np.int64)
    drift = np.zeros((parts, entries)) if before is None else np.sqrt(((books - before) ** 2).sum(axis=2).astype(np.float64))
    deep = int(groups.max(initial=0)) + 1
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())), ("code", pa.binary()), ("bounds", pa.binary()), ("error", pa.int64()), ("moved", pa.list_(pa.int64()))])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        x = np.zeros((n, parts * width), np.int64)
        flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
        x[:, : len(flat) // n] = flat.reshape(n, -1)
        x = x.reshape(n, parts, width)
        codes, bounds, error = np.empty((n, parts), np.uint8), np.zeros((n, parts, 1 + deep), np.float32), np.zeros(n, np.int64)
        if before is not None:
            was = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
            held = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.float32).reshape(n, parts, 1 + deep)
        for p in range(parts):
            old = None if before is None else was[:, p].astype(np.int64)
            first = int(groups[p].max(initial=0)) + 1
            upper, lower = (None, None) if before is None else (held[:, p, 0], held[:, p, 1 : 1 + first])
            own, upper, lower, _ = assign_part(x[:, p], books[p], groups[p], old, upper, lower, drift[p])
            codes[:, p], bounds[:, p, 0], bounds[:, p, 1 : 1 + first] = own, upper, lower
            d = x[:, p] - books[p][own]
            error += np.einsum("ij,ij->i", d, d)
            total[p] += _moved(x[:, p], own, old, entries)
        raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], raw(codes), raw(bounds), pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
    if total.any():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:6]), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], schema=schema)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """(<id>, <label>, code, error) of each row that takes part, code as bytes, and the codebooks (parts x entries x width)."""
    spark = vectors.sparkSession
    folder, number = shared_folder(spark), 0
    big = F.exists("embedding", lambda x: F.abs(x) >= MOST)
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("int"))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    q = F.when(big, F.raise_error(F.lit(f"a component is not below {MOST}"))).otherwise(q)
    rows = stored_at(named.where(finite(F.col("embedding"))).select("id", "label", q.alias("v")))
    heads = rows[0].orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    dims = len(heads[0].v) if heads else 0
    if rows[0].where(F.size("v") != dims).limit(1).count():
        raise ValueError("vectors differ in length")
    width = -(-dims // parts)
    start = np.zeros((len(heads), parts * width), np.int64)
    for k, h in enumerate(heads):
        start[k, :dims] = h.v
    books = start.reshape(len(heads), parts, width).transpose(1, 0, 2).copy()
    if not heads:
        return rows[0].select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), books
    grouped = np.array([_groups(b, groups) for b in books])
    sums, before, state = np.zeros((parts, len(heads), width + 1), np.int64), None, rows
    for number in range(rounds + 1):
        given = state[0].where("v is not null") if number else state[0].select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("bounds", "binary"))])
        after = stored_at(given.select("id", "label", "v", "code", "bounds").mapInArrow(lambda batches, books=books, before=before: _pass(batches, books, grouped, before), _STATE))
        discard(spark, state[1])
        state = after
        if number < rounds:
            moved = after[0].where("moved is not null").select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
            for r in moved:
                sums.flat[r["at"]] += r.x
            count = sums[:, :, -1:]
            before, books = books, np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
    out = state[0].where("v is not null").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")
    return out, books


def digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(<id>, code, error, label_error, codebooks_sha256): the code in hexadecimal, the error summed over rows of equal
    label, and the digest of all entries' components."""
    rows, books = encode(vectors, id_col, vector_col, label_col, **options)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), "code", "error")
    by_label = broadcast_if_small(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain Lloyd in SQL, for the tables' 64 components."""
    width = 64 // parts
    steps = []
    for r in range(1, rounds + 2):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT x.id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r - 1} b USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r <= rounds:
            steps.append(f"""
b{r} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{r - 1} b LEFT JOIN (
  SELECT a.part, a.entry, x.pos, (sum(x.v) - (sum(x.v) % count(*) + count(*)) % count(*)) // count(*) AS v FROM a{r} a JOIN x USING (id, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return f"""
WITH good AS (SELECT vec_id AS id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, (pos - 1) // {width} AS part, (pos - 1) % {width} AS pos, v FROM (
  SELECT id, generate_subscripts(embedding, 1) AS pos, unnest(list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT))) AS v FROM good)),
firsts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM good QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT x.part, f.entry, x.pos, x.v FROM x JOIN firsts f USING (id)),{",".join(steps)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds + 1} GROUP BY id),
books AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha FROM b{rounds})
SELECT g.id AS vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY g.label) AS BIGINT) AS label_error, books.sha AS codebooks_sha256
FROM good g JOIN coded c USING (id) CROSS JOIN books
"""
