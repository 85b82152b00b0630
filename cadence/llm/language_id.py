"""Language identification with spans of mixed-language text.

Words are runs of letters. A word's script, by Unicode ranges, narrows its candidates to the languages that were seen
in that script; each candidate has a score from hashed character n-grams (with word ends, 2 to 4 long). Viterbi over
the words of a whole text, with a penalty for switching, labels every word; a document's language is the one whose
words hold most letters.

Training counts n-grams in Spark, over a bounded sample of labelled rows; the model is languages x 2^16 numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import crc_mod, hashed_share

#: First and last code points of scripts; 0 is any other.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_EDGES = sorted((a, b, k) for k, spans in enumerate(SCRIPTS.values(), 1) for a, b in spans)
_STARTS = np.array([a for a, _, _ in _EDGES])
_ENDS = np.array([b for _, b, _ in _EDGES])
_KINDS = np.array([k for _, _, k in _EDGES])

ORDERS = (2, 3, 4)
BITS = 16
#: A language is a candidate in a script that has at least this share of its letters.
LEAST_SHARE = 0.01
_RUNS = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 200_000
_CELLS = 600_000


def scripts_of(codes: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(_STARTS, codes, "right") - 1, 0, None)
    return np.where((codes >= _STARTS[k]) & (codes <= _ENDS[k]), _KINDS[k], 0)


def letter_runs(text: str) -> list[str]:
    return _RUNS.findall(text.lower())


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of words between end marks."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    at, buckets = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        at.append(owner[: len(h)][inside])
        buckets.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(buckets)


@dataclass
class Model:
    """languages in code point order; weights[bucket, language] log-probabilities; allowed[script, language]."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 8000, id_col: str = "doc_id") -> Model:
    """Learn from rows with text and language, a hashed sample of about `sample_rows` of them (all, if fewer).

    Rows with a null text or language are not learned from; null ids are ids like others. Rows are sampled by id and
    text, and rows alike in id, text and language count once, so no id and no repeated row fills the sample. Without
    any row the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n = rows.select("id", "lang").count()
    share = min(1.0, sample_rows / max(1, n))
    rows = rows.where(hashed_share(F.struct("id", "text"), share)).dropDuplicates(["id", "text", "lang"]).select("text", "lang")

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, []).extend(letter_runs(text))
            for lang, words in by.items():
                if not words:
                    continue
                kinds, counts = np.unique(np.array(words, object), return_counts=True)
                at, buckets = word_ngrams(kinds.tolist())
                sums = np.bincount(buckets, weights=counts[at].astype(float), minlength=1 << BITS)
                codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
                letters = np.bincount(scripts_of(codes), minlength=len(SCRIPTS) + 1).astype(float)
                hit = np.flatnonzero(sums)
                seen = np.flatnonzero(letters)
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * (len(hit) + len(seen)),
                    "bucket": np.concatenate([hit, -1 - seen]).astype("i8"),
                    "n": np.concatenate([sums[hit], letters[seen]]),
                })

    # at most languages x (2^16 + scripts) rows
    counted = rows.mapInArrow(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    who = np.array([place[x] for x in counted.column("lang").to_pylist()], dtype=int)
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    counts, letters = np.zeros((1 << BITS, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    gram = bucket >= 0
    counts[bucket[gram], who[gram]] = n[gram]
    letters[-1 - bucket[~gram], who[~gram]] = n[~gram]
    smooth = counts + 0.5
    weights = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype("f4") if langs else counts.astype("f4")
    weights -= weights.mean(axis=1, keepdims=True) if langs else 0
    allowed = letters >= LEAST_SHARE * np.maximum(letters.sum(axis=0, keepdims=True), 1)
    return Model(langs, weights, allowed)


class Labeller:
    """Words to rows of scores, kept between texts; Viterbi over blocks of texts of like length."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, np.float32(penalty)
        self.label = np.min_scalar_type(max(len(model.languages) - 1, 0))  # of a language's number
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1, len(self.model.languages)), "f4")  # row 0: no word
        self.letters = np.zeros(1, "f8")
        self.evident = np.zeros(1, bool)

    def learn(self, words: list[str]) -> None:
        """Scores of words not seen before."""
        pure = ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in words]
        at, buckets = word_ngrams(pure)
        scores = np.zeros((len(words), len(self.model.languages)), "f4")
        for k in range(scores.shape[1]):
            scores[:, k] = np.bincount(at, weights=self.model.weights[buckets, k], minlength=len(words))
        first = np.array([ord(w[0]) if w else 0 for w in pure])
        allowed = self.model.allowed[scripts_of(first)] & np.array([bool(w) for w in pure])[:, None]
        evident = allowed.any(axis=1)
        scores = np.where(allowed, scores, np.float32(-30.0))
        scores[~evident] = 0
        base = len(self.letters)
        self.place |= {w: base + i for i, w in enumerate(words)}
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, [float(len(w)) for w in pure]])
        self.evident = np.concatenate([self.evident, evident])

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of each word of each text."""
        lens = np.array([len(t) for t in texts])
        out: list[np.ndarray] = [np.empty(0, self.label)] * len(texts)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        at = 0
        while at < len(order):
            longest = lens[order[at]]
            block = order[at : at + max(1, min(1024, _CELLS // longest))]
            at += len(block)
            index = np.zeros((longest, len(block)), "i4")
            for j, i in enumerate(block):
                index[: lens[i], j] = [self.place[w] for w in texts[i]]
            labels = self._viterbi(index)
            for j, i in enumerate(block):
                out[i] = labels[: lens[i], j]
        return out

    def _viterbi(self, index: np.ndarray) -> np.ndarray:
        steps, n = index.shape
        k = self.scores.shape[1]
        back = np.empty((steps, n, k), self.label)
        own, each = np.arange(k, dtype=self.label)[None, :], np.arange(n)
        v = self.scores[index[0]]
        for t in range(1, steps):
            best = v.argmax(axis=1)
            switch = v[each, best][:, None] - self.penalty
            back[t] = np.where(v >= switch, own, best[:, None])
            v = np.maximum(v, switch) + self.scores[index[t]]
        labels = np.empty((steps, n), self.label)
        state = v.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            labels[t] = state
            if t:
                state = back[t][each, state]
        return labels


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, with_spans: bool = False
) -> DataFrame:
    """id, lang_pred, score (and spans) of every row.

    score is the share of the text's letters in words labelled lang_pred whose script has candidates. spans lists
    (lang, start, end), in characters, of runs of words with one label; each reaches to the next one's start.

    Null texts and texts without a letter give `und`, score 0 and no span; so does every text if the model has no
    language. A text in a script without candidates gets the first language and score 0. Ids may be null or repeat.
    Further columns are not read.
    """
    schema = f"`{id_col}` long, lang_pred string, score double" + ", spans array<struct<lang:string,start:long,end:long>>" * with_spans
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        labeller = Labeller(shared.value, penalty)
        langs = shared.value.languages
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < 6_000_000):
                    part.append(texts[at + len(part)] or "")
                    size += len(part[-1])
                if len(labeller.place) > KEPT_WORDS:
                    labeller.clear()
                words = [letter_runs(t) for t in part]
                new = list({w for t in words for w in t} - labeller.place.keys()) if langs else []
                for i in range(0, len(new), 20_000):
                    labeller.learn(new[i : i + 20_000])
                preds, scores, spans = [], [], []
                paths = labeller.paths(words) if langs else [np.empty(0, labeller.label)] * len(part)
                for text, own, path in zip(part, words, paths, strict=True):
                    which = np.fromiter((labeller.place[w] for w in own), "i8", len(own)) if langs else np.empty(0, "i8")
                    letters = labeller.letters[which]
                    if not letters.sum():
                        preds.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    by = np.bincount(path, weights=letters, minlength=len(langs))
                    best = int(by.argmax())
                    sure = (letters * labeller.evident[which] * (path == best)).sum()
                    preds.append(langs[best])
                    scores.append(float(sure / letters.sum()))
                    if with_spans:
                        spans.append(_spans(text, path, langs))
                data = [ids.slice(at, len(part)), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
                if with_spans:
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                    data.append(pa.array(spans, kind))
                yield pa.RecordBatch.from_arrays(data, [id_col, "lang_pred", "score", "spans"][: len(data)])
                at += len(part)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(label, schema)


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    low = text.lower()
    starts = [m.start() for m in _RUNS.finditer(low if len(low) == len(text) else text)][: len(path)]
    turns = [0, *(np.flatnonzero(np.diff(path.astype(int))) + 1).tolist()]
    edges = [0, *(starts[i] for i in turns[1:] if i < len(starts)), len(text)]
    return [{"lang": langs[path[i]], "start": a, "end": b} for i, a, b in zip(turns, edges[:-1], edges[1:], strict=False)]


def held_out(id_col: Column, divisor: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves `rest`; false for a null id."""
    return F.coalesce(crc_mod(id_col, divisor) == rest, F.lit(False))
