"""Bloom filters as Spark tables: rows (page, bits) with 4 KB of bits each.

A filter has 16 bits a key, but never more than MOST_PAGES pages (128 MB), so it can be broadcast within a
proven bound. Beyond some 10^8 keys it lets more rows through (3 % at 10^8, 70 % at 10^9); what follows it
is exact, so results never depend on it. Both bits of a key lie in one page, so a test is one join.

Tasks pack what they hit before the shuffle: a row per page with the positions hit, two bytes each, however
often a key comes up. So far fewer rows move than keys are read, and no key weighs more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import cut, fresh

#: Bits a page has, and bits a key gets.
PAGE, A_KEY = 1 << 15, 16
MOST_PAGES = 1 << 15
#: Keys that a task packs at a time.
HOLD = 1 << 20


class Filter(NamedTuple):
    table: DataFrame  # (page, bits)
    pages: int


def _hashes(key: Column) -> tuple[Column, Column]:
    """Of the page and of the bits; two seeds, so that they are independent."""
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def _pack(batches: Iterator[pa.RecordBatch], pages: int) -> Iterator[pa.RecordBatch]:
    """(page, once, twice): the positions that were hit, and those that were hit more than once."""
    held: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        slots, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        page = np.unique(slots // PAGE)
        lists = []
        for own in (slots, slots[times > 1]):
            ends = np.searchsorted(own // PAGE, np.r_[page, pages]).astype(np.int32) * 2
            lists.append(pa.Array.from_buffers(pa.binary(), len(page), [None, pa.py_buffer(ends), pa.py_buffer((own % PAGE).astype("<u2").tobytes())]))
        return pa.RecordBatch.from_arrays([pa.array(page), *lists], names=["page", "once", "twice"])

    for b in batches:
        for at in range(0, b.num_rows, HOLD):
            h, g = (b.column(i).slice(at, HOLD).to_numpy(zero_copy_only=False) for i in (0, 1))
            bit = g & (PAGE - 1)
            other = (bit + 1 + ((g >> 15) & (PAGE // 2 - 1))) & (PAGE - 1)
            held += [(h % pages) * PAGE + x for x in (bit, other)]
            if sum(map(len, held)) >= 2 * HOLD:
                yield packed()
    if held:
        yield packed()


def _merge(rows: pa.Table, repeated: bool) -> pa.Table:
    """One page's rows to its bits."""
    once, twice = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u2") for c in ("once", "twice"))
    hits = np.bincount(once, minlength=PAGE)
    if repeated:
        hits = hits + np.bincount(twice, minlength=PAGE) - 1
    return pa.table([rows.column("page").slice(0, 1), pa.array([np.packbits(hits > 0, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])


def _build(df: DataFrame, key: Column, keys: int | None, repeated: bool) -> Filter:
    keys = df.count() if keys is None else keys
    pages = min(MOST_PAGES, max(1, -(-keys * A_KEY // PAGE)))
    packed = df.select(*[h.alias(n) for n, h in zip("hg", _hashes(key))]).mapInArrow(lambda batches: _pack(batches, pages), "page long, once binary, twice binary")
    return Filter(cut(packed.groupBy("page").applyInArrow(lambda rows: _merge(rows, repeated), "page long, bits binary")), pages)


def of_keys(df: DataFrame, key: Column, keys: int | None = None) -> Filter:
    """The filter of all keys. `keys`: how many there are, if that is known."""
    return _build(df, key, keys, repeated=False)


def of_repeated(df: DataFrame, key: Column, keys: int | None = None) -> Filter:
    """The filter of keys that may occur on more than one row: both of their bits were hit twice."""
    return _build(df, key, keys, repeated=True)


def flag(df: DataFrame, key: Column, seen: Filter, name: str) -> DataFrame:
    """The rows with a boolean column `name`: false where the key is surely not in the filter."""
    page, bit, p, bits = (fresh(df, f"__bloom_{x}") for x in ("page", "bit", "p", "bits"))
    h, g = _hashes(key)
    out = df.withColumn(page, F.pmod(h, F.lit(seen.pages))).withColumn(bit, g)
    out = out.join(F.broadcast(seen.table.select(F.col("page").alias(p), F.col("bits").alias(bits))), F.col(page) == F.col(p), "left")

    def on(at: Column) -> Column:
        byte = F.conv(F.hex(F.col(bits).substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.get(F.array(*[byte.bitwiseAND(1 << k) != 0 for k in range(8)]), at.bitwiseAND(7).cast("int"))

    first = F.col(bit).bitwiseAND(PAGE - 1)
    second = (first + 1 + F.shiftright(bit, 15).bitwiseAND(PAGE // 2 - 1)).bitwiseAND(PAGE - 1)
    return out.withColumn(name, F.col(bits).isNotNull() & F.coalesce(on(first) & on(second), F.lit(False))).drop(page, bit, p, bits)
