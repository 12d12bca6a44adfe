"""Text as Spark columns.

Empty text is the usual "missing": text_or() skips it. White space is a wider class than Spark's own trim
and \\s cover, so one explicit class is used throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.slices import sliced

# fixed values: the characters that count as white space
SPACES = "\t\n\x0b\x0c\r                  　﻿"
_SPACES = r"\t\n\x0B\f\r    -     　﻿"
# printable ASCII is told apart first: most characters are
SPACE = f"[[^!-~]&&[{_SPACES}]]"
WORD = f"[[!-~][^{_SPACES}]]+"

# fixed values: texts that a page shows in place of its content
SCRIPT_GATES = (
    "debe tener activado javascript para poder acceder a este sitio",
    "you need to enable javascript to run this app",
    "you need to enable javascript to access this site",
    "javascript is required to access this site",
)

# fixed values: words that are no topics
STOPWORDS = (
    "and", "are", "for", "from", "into", "that", "this", "with", "your", "week", "module", "page", "pages", "assignment", "assignments", "content", "course",
    "class", "canvas", "file", "files", "source", "section", "synced", "extract", "extracted", "overview", "recap",
)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def once(c: Column) -> Column:
    """c, evaluated once a row for all columns and filters above it: what draws a random number (here without effect) is neither copied
    into the expressions that refer to it nor pushed down with them."""
    return F.when(F.rand(0) >= 0, c)


def text(c: Column | str) -> Column:
    """Trimmed; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def text_or(*cols: Column | str) -> Column:
    """The first that is neither null nor empty; null if there is none."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def collapse(c: Column) -> Column:
    """White space runs become one space."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "), F.lit(" "))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _hashed(texts: pa.Array, points: bool = False) -> pa.Array:
    """All texts of a slice at once: each UTF-16 unit (or code point) times its power of 31, summed per text in wrapping 32 bits."""
    coding, unit = ("utf-32-le", np.dtype(np.uint32)) if points else ("utf-16-le", np.dtype(np.uint16))
    coded = [t.encode(coding, "surrogatepass") for t in texts.to_pylist()]
    n = np.array([len(c) // unit.itemsize for c in coded], np.int64)
    if not n.sum():
        return pa.array(["h0"] * len(n), pa.string())
    powers = np.full(n.max(), 31, np.uint32)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint32)
    codes = np.frombuffer(b"".join(coded), unit).astype(np.uint32, copy=False)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(codes)) - 1  # units after each one in its text
    total, filled_ = np.zeros(len(n), np.uint32), n > 0
    total[filled_] = np.add.reduceat(codes * powers[left], (np.cumsum(n) - n)[filled_])
    return pa.array([f"h{abs(x)}" for x in total.view(np.int32).astype(np.int64).tolist()], pa.string())


def stable_hash(c: Column, points: bool = False) -> Column:
    """h and the absolute value of a 31-based rolling hash over UTF-16 units, wrapped to 32 bits. points: over code points, which differ
    from units beyond the basic plane."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(((b,) for b in batches), lambda t: _hashed(t, points))

    return run(F.coalesce(c, F.lit("")))


def is_script_gate(c: Column) -> Column:
    """At most 40 words, one of the gate texts among them."""
    def test(plain: Column) -> Column:
        hit = F.lit(False)
        for gate in SCRIPT_GATES:
            hit |= plain.contains(gate)
        return hit & (F.size(F.split(plain, " ")) <= 40)

    return let(F.lower(collapse(c)), test)


def line_endings(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")


def plain_text(c: Column) -> Column:
    """No blanks before line ends, at most one blank line, trimmed."""
    return text(F.regexp_replace(F.regexp_replace(line_endings(c), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def paragraphs(c: Column) -> Column:
    """Split at blank lines; the lines of one are joined by spaces."""
    return F.filter(F.transform(F.split(plain_text(c), r"\n{2,}"), lambda p: collapse(p)), lambda p: p != "")


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def minified_html(c: Column) -> Column:
    """Without white space between elements, other white space runs as one space."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), f">{SPACE}+<", "><"))


def phrase(c: Column) -> Column:
    """Lower case; all but a-z, 0-9 and white space becomes a space."""
    lowered = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"(?!{SPACE})[^a-z0-9]", " ")
    return collapse(lowered)


def is_useful_phrase(normal: Column) -> Column:
    return (F.length(normal) >= 4) & ~normal.isin(*STOPWORDS) & ~normal.rlike("^[0-9]+$")


def title_segments(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|:;/\\-]+"), lambda p: text(p))
    return F.filter(parts, lambda p: F.length(p) >= 4)


def title_case(c: Column) -> Column:
    """Every letter or digit at the start of a word in upper case, the rest as it is."""
    parts = F.split(c, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p)))), "")


def type_label(c: Column) -> Column:
    return title_case(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))


def one_of(c: Column, allowed: tuple[str, ...] | list[str], otherwise: Column | str) -> Column:
    """The value if it is an allowed one."""
    return F.when(c.isin(*allowed), c).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def distinct_texts(c: Column) -> Column:
    """Trimmed, not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text(x)), lambda x: x != ""))


def longer(a: Column, b: Column) -> Column:
    """The longer text; the first on ties."""
    return F.when(~filled(a), F.coalesce(F.nullif(b, F.lit("")), a)).when(~filled(b), a).when(F.length(b) > F.length(a), b).otherwise(a)


def mask(c: Column) -> Column:
    """The two ends of a secret."""
    return F.when(~filled(c), F.lit("")).otherwise(F.concat(F.substring(c, 1, 6), F.lit("…"), F.right(c, F.lit(4))))


def uuid(c: Column) -> Column:
    """The first UUID in a text, with or without hyphens, in its usual form; else the last segment of a path."""

    def form(u: Column) -> Column:
        h = F.lower(F.replace(u, F.lit("-"), F.lit("")))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    found = F.regexp_extract(c, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}", 0)
    path = F.regexp_replace(F.regexp_replace(text(c), r"[?#].*$", ""), "/$", "")
    return F.when(found != "", form(found)).otherwise(F.regexp_extract(path, "[^/]*$", 0))
