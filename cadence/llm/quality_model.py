"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made in Arrow batches. Trees are grown on binned statistics of a bounded sample of
labelled rows; fitted trees are complete binary trees flattened into arrays, so that a batch walks a tree with one
vectorised step a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import hashed_share

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "upper", "lower", "digits", "spaces", "line_feeds", "high_bytes", "commas", "full_stops",
    "exclamations", "questions", "colons", "pipes", "symbols", "brackets", "quotes", "distinct_words", "distinct_lines", "most_frequent_word",
    "capital_words", "words_a_line", "distinct_pairs",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "spaces": b" \t", "line_feeds": b"\n",
    "high_bytes": bytes(range(128, 256)), "commas": b",", "full_stops": b".", "exclamations": b"!", "questions": b"?", "colons": b":;", "pipes": b"|",
    "symbols": b"#*$%&<>@^~=+_\\", "brackets": b"()[]{}", "quotes": b"\"'",
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _MASKS[list(_chars), _k] = 1


def statistics(text: str | None) -> list[float]:
    """FEATURES of one text; a null or empty text has zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MASKS / len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    n = len(words)
    return [
        np.log1p(len(data)), np.log1p(n), np.log1p(len(lines)), sum(map(len, words)) / n, *shares, len(counts) / n, len(set(lines)) / len(lines),
        max(counts.values()) / n, sum(w[:1].isupper() for w in words) / n, n / len(lines), len(pairs) / max(1, n - 1),
    ]


@dataclass
class Trees:
    """Flattened trees of one depth: node i has children 2i+1 and 2i+2; a leaf's value is leaves[tree, place]."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.features.shape[1] if len(self.features) else 0
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: float = 1.0) -> Trees:
    """Boosted trees for labels y in {0, 1} by second-order gains over histograms; constant if y has one class or none."""
    inner = 2**depth - 1
    if len(y) == 0:
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    mean = float(np.clip(y.mean(), 0.001, 0.999))
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    all_f, all_t, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key, size = local * bins + binned[:, j], width * bins
                hg = np.bincount(key, g, size).reshape(width, bins).cumsum(axis=1)
                hh = np.bincount(key, h, size).reshape(width, bins).cumsum(axis=1)
                total_g, total_h = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + 1) + (total_g - hg) ** 2 / (total_h - hh + 1) - total_g**2 / (total_h + 1)
                gain = np.where((hh >= least) & (total_h - hh >= least), gain, 0)[:, : len(cuts[j])]
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                f[first : first + width] = np.where(better, j, f[first : first + width])
                t[first : first + width] = np.where(better, cuts[j][k], t[first : first + width])
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        place = node - inner
        leaf = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + 1)
        raw += leaf[place]
        all_f.append(f)
        all_t.append(t)
        all_leaves.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_leaves))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000
) -> Trees:
    """Fit on a hashed sample of about `sample_rows` labelled ids (all, if fewer), which is what the driver gathers.

    Null labels and ids are ignored; an id with several labels takes their rounded mean. Documents that share an id
    all count, but never more than twice `sample_rows` rows, those of the smallest hashes.
    """
    labels = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where("label_id IS NOT NULL AND y IS NOT NULL")
    labels = labels.groupBy("label_id").agg(F.round(F.avg("y")).alias("y"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    sample = labels.where(hashed_share(F.col("label_id"), share))
    # the sample is bounded by sample_rows, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("label_id"))

    def measure(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["x", "y", "h"])

    table = rows.select("text", "y", F.xxhash64("id", "text").alias("h")).mapInArrow(measure, "x array<double>, y double, h long").orderBy("h").limit(2 * sample_rows).toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return grow(x, table.column("y").to_numpy().clip(0, 1))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= 0.5, else 0) of every row, and the columns in `keep` as they are.

    Null and empty texts have all statistics zero and get the score of that; null and repeated ids are rows like
    others. Columns not in `keep` are not read; `keep` must not hold the result's names.
    """
    names = ["_text", "_id", *(f"_keep{i}" for i in range(len(keep)))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip((text_col, id_col, *keep), names, strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop("_text").schema
    schema = schema.add("score", "double").add("predicted", "integer")

    def judge(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([statistics(t) for t in part.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
                s = shared.value.score(x)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s), pa.array((s >= 0.5).astype("i4"))], [*part.schema.names[1:], "score", "predicted"])

    out = rows.mapInArrow(judge, schema)
    return out.select(F.col("_id").alias(id_col), "score", "predicted", *(F.col(n).alias(c) for c, n in zip(keep, names[2:], strict=True)))
