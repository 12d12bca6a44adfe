"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - t_k): one weight per feature, shared by all grades, and ordered thresholds
t_1 < t_2 < ...; a document's severity is the expected grade, the sum of these probabilities. Features
are words (lower-cased letter runs) and their first four and five letters; x is log2(1 + distinct tokens
with the feature), so long texts do not drown what is rare in them.

The fit uses at most `max_rows` labelled ids (those of smallest hash; the parameter is the documented
bound), with one text each. Feature statistics of these rows are counted on Spark; features are kept that three rows
have at least and whose likelihood ratio G2 between graded and clean texts exceeds 2 ln(candidates). Only the kept counts
of the bounded sample reach the driver, where the weights are found; prediction covers every row.

Labels that are mere flags hold no severity. With `split_flag` flagged texts are graded by how many tokens with kept features
they hold: the second grade is then a proxy for how much of a text is toxic, not a judgement by people, and only the
probability of the first grade rests on labels.

Defined cases: null and empty text have no features (their severity is that of the thresholds); labels with a
null id or grade are ignored, of several grades for an id the highest counts, of several texts the last in order;
without labels or without two grades the severity is 0; an empty table gives an empty result; columns named as the added
ones are replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import chunks, cut, fresh

MAX_ROWS, MIN_ROWS = 20_000, 3
#: Bytes of text that are worked on at a time.
SLICE = 3_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of grade >= 1, 2, ...

    def reached(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) per row and k."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -60, 60)))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct tokens: (index of the token, feature hash), without repeats."""
    at, names = [], []
    for i, w in enumerate(words):
        for run in _LETTERS.findall(w):
            at.append(i)
            names.append(run)
            for n in (4, 5):
                if len(run) > n:
                    at.append(i)
                    names.append(f"{run[:n]}*")
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.array(at), pd.util.hash_array(np.array(names, object), categorize=False)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per token its row and its index among the distinct tokens; these."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = words.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    return rows, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _counts(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, distinct tokens of the row with it); `only`: sorted hashes of the features that count, of
    which the index is given then."""
    rows, token, words = _tokens(texts)
    at, feature = _features(words)
    if only is not None:
        where = np.minimum(np.searchsorted(only, feature), max(0, len(only) - 1))
        hit = only[where] == feature if len(only) else np.zeros(len(feature), bool)
        at, feature = at[hit], where[hit].astype(np.uint64)
        used = np.zeros(len(words), bool)
        used[at] = True
        rows, token = rows[used[token]], token[used[token]]
    pair = np.unique(rows.astype(np.int64) * max(1, len(words)) + token)
    rows, token = pair // max(1, len(words)), pair % max(1, len(words))
    order = np.argsort(at, kind="stable")
    at, feature = at[order], feature[order]
    first, n = np.searchsorted(at, token), np.searchsorted(at, token, "right") - np.searchsorted(at, token)
    picked = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row, feature = np.repeat(rows, n), feature[picked]
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])] if len(row) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return row[starts], feature[starts], np.diff(np.r_[starts, len(row)])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, max_rows: int) -> DataFrame:
    """(id, text, grade) of at most max_rows labelled ids, one text each."""
    grades = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(grade_col).cast("int")).alias("grade"))
    chosen = grades.orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "grade").agg(F.max("text").alias("text"))


def select_features(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that tell graded texts from clean ones. They are as many as a bounded sample can hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text", SLICE):
                row, feature, _ = _counts(b.column("text"))
                graded = b.column("grade").to_numpy(zero_copy_only=False)[row] > 0
                found, back = np.unique(feature, return_inverse=True)
                n = np.bincount(back, minlength=len(found))
                n1 = np.bincount(back, weights=graded, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(n1)], names=["feature", "n", "n1"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)).alias("n1")).first()
    if not 0 < total.n1 < total.n:
        return np.zeros(0, np.uint64)
    stats = rows.mapInArrow(count, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_ROWS)
    cells = []
    for seen, of in ((F.col("n1"), total.n1), (F.col("n") - F.col("n1"), total.n - total.n1)):
        share = F.col("n") * F.lit(of / total.n)
        cells.append(F.when(seen > 0, seen * F.log(seen / share)).otherwise(0.0))
        cells.append(F.when(seen < of, (F.lit(of) - seen) * F.log((F.lit(of) - seen) / (F.lit(of) - share))).otherwise(0.0))
    g2 = 2 * (cells[0] + cells[1] + cells[2] + cells[3])
    stats = stats.select("feature", g2.alias("g2"))
    stats = cut(stats)
    least = 2 * float(np.log(max(1, stats.count())))
    return np.sort(np.array([r.feature for r in stats.where(F.col("g2") > least).collect()], np.int64).view(np.uint64))


def _fit(n: int, row: np.ndarray, feature: np.ndarray, x: np.ndarray, grade: np.ndarray, features: np.ndarray, ridge: float = 0.3, rounds: int = 500) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam on the whole sample."""
    top = int(grade.max())
    share = np.array([np.mean(grade >= k) for k in range(1, top + 1)])
    start = np.log((1 - share) / share)
    params = np.r_[np.zeros(len(features)), start[0], np.log(np.maximum(np.diff(start), 0.05))]
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(features)
    for t in range(1, rounds + 1):
        w, theta = params[:k], params[k] + np.r_[0, np.cumsum(np.exp(params[k + 1 :]))]
        linear = np.bincount(row, weights=w[feature] * x, minlength=n)
        upper = 1 / (1 + np.exp(-np.clip(linear[:, None] - np.r_[-np.inf, theta, np.inf][None, :], -60, 60)))
        upper[:, 0], upper[:, -1] = 1, 0
        i = np.arange(n)
        hi, lo = upper[i, grade], upper[i, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_linear = -(d_hi - d_lo)
        d_theta = np.array([np.sum(d_hi[grade == j]) - np.sum(d_lo[grade == j - 1]) for j in range(1, top + 1)])
        grad = np.r_[np.bincount(feature, weights=d_linear[row] * x, minlength=k) + ridge * w, d_theta.sum(), [d_theta[j:].sum() * np.exp(params[k + j]) for j in range(1, top)]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(features, params[:k], params[k] + np.r_[0, np.cumsum(np.exp(params[k + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = MAX_ROWS, split_flag: bool = False) -> Model:
    """Fits the model to integer grades 0, 1, 2, ... With `split_flag` the grade column is a mere flag and
    severity is taken from the texts: a flagged text is of grade 2 if it holds more tokens with kept features than
    the median flagged text, else of grade 1."""
    rows = cut(sample(docs, labels, id_col, text_col, grade_col, max_rows))  # read three times
    features = select_features(rows)
    if not len(features):
        return Model()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text", SLICE):
                row, feature, n = _counts(b.column("text"), features)
                offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int32))) for c in (feature, n)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grade"), *lists], names=["id", "grade", "feature", "n"])

    got = rows.mapInArrow(collect, f"id {dict(rows.dtypes)['id']}, grade int, feature array<int>, n array<int>").toPandas().sort_values("id", kind="stable")
    sizes = got.feature.map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), sizes)
    feature = np.concatenate([np.asarray(f, np.int64) for f in got.feature]) if sizes.sum() else np.zeros(0, np.int64)
    n = np.concatenate([np.asarray(f, float) for f in got.n]) if sizes.sum() else np.zeros(0)
    grade = got.grade.to_numpy().astype(int)
    if split_flag:
        hits = np.bincount(row, weights=n, minlength=len(got))
        grade = np.where(grade > 0, 1 + (hits > np.median(hits[grade > 0])), 0)
    grade = np.unique(np.maximum(grade, 0), return_inverse=True)[1]  # grades that do not occur have no threshold
    return _fit(len(got), row, feature, np.log2(1 + n), grade, features)


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows of `docs` with severity (expected grade) and p_toxic, the probability of any grade above 0."""
    added = [f"{prefix}severity", f"{prefix}p_toxic"]
    rest = docs.drop(*added)
    name = fresh(docs, "__toxic_text")
    names = [*rest.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, name, SLICE):
                n = b.num_rows
                if len(model.features):
                    row, feature, x = _counts(b.column(name), model.features)
                    reached = model.reached(np.bincount(row, weights=model.weights[feature.astype(np.int64)] * np.log2(1 + x), minlength=n))
                else:
                    reached = np.zeros((n, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(reached.sum(axis=1)), pa.array(reached[:, 0])], names=names)

    return rest.withColumn(name, docs[text_col]).mapInArrow(run, rest.schema.add(added[0], "double").add(added[1], "double"))
