"""Quality classifier by co-training.

Two logistic models see a document in different ways: one its text (hashed words, marks of style, the
layout of its lines), the other its metadata (language, source and stated length).  Both start from a
bounded sample of labelled documents.  In each round each model scores every document outside that
sample, and teaches the other those of which it is surest: at most `taught` different texts of each
class, if it is sure of them and has proved right where it was sure on labelled rows set apart for
that.  Another part of the labelled sample, which neither has learned from and which proves nothing,
then calibrates both (a logistic map of each score) and combines them.  All documents are scored,
whole, in one pass.

The sample, at most LABELLED documents, is that with the least hashes of ids; the pseudo-labels are at
most ROUNDS * 4 * TAUGHT documents.  Their features are all that the driver holds; all three are
parameters.  A round keeps `taught` documents of each task, those are cut down in SLICES places, and
what these keep in one.

Defined results: null and empty texts have zero text features and are scored by the models' biases;
null metadata is a value of its own; texts of any length are read whole; a doc_id that repeats is
scored in each row; labels that are null, or whose document is missing, teach nothing, and of several
for one document the least counts, and of several documents with one id that with the least text
hash; if either class has fewer than four labelled documents, all documents get the share of good
labels (0.5 without labels) and are kept if it is at least 0.5; an empty table gives an empty result;
further columns of any name are not read.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm.common import as_text, let_go

LABELLED, TAUGHT, ROUNDS, SLICES = 4000, 200, 2, 64
#: What a model must be sure of to teach it, and how often it must have been right where it was.
SURE, PROVED = 0.9, 0.9
TEXT_BUCKETS, META_BUCKETS = 512, 64
SEED = 9
_STYLE, _META = 20, 3
TEXT_SIZE, META_SIZE = _STYLE + TEXT_BUCKETS, _META + META_BUCKETS
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")


def _bucket(value: str, n: int) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass")) % n


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        b = _bucket(word, TEXT_BUCKETS)
        if len(word) <= 32:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = b
        return b


_buckets = _Buckets()


def text_features(text: str | None) -> np.ndarray:
    """Marks of style, the layout of the lines, then shares of hashed words."""
    x = np.zeros(TEXT_SIZE, np.float32)
    if not text:
        return x
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = text.split()
    k = max(len(words), 1)
    symbols = n - len(raw.translate(None, _SYMBOLS))
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - len(raw.translate(None, b"0123456789"))
    stops = raw.count(b".") + raw.count(b"?")
    counts = Counter(words)
    top = max(counts.values(), default=0)
    same = sum(map(str.__eq__, words[1:], words))
    bangs, pipes, hashes = raw.count(b"!"), raw.count(b"|"), raw.count(b"#") + raw.count(b"$") + raw.count(b"%") + raw.count(b"*") + raw.count(b"&")
    lines = text.split("\n")
    size = [len(y) for y in lines]
    mean = sum(size) / len(size)
    breaks = sum(y.rstrip()[-1:].isalnum() for y in lines)
    x[:_STYLE] = (
        min(symbols / k, 2), upper / n, digits / n, min(stops / k, 1), math.log1p(k) / 10, top / k, same / k, len(counts) / k,
        min(bangs / k, 2), min(pipes / k, 2), min(hashes / k, 2), min(n / k, 30) / 30, float(k < 5), 1.0,
        math.log1p(len(lines)) / 8, math.log1p(mean) / 8, min(float(np.std(size)) / (mean + 1), 3), breaks / len(lines), float(len(lines) == 1), (len(lines) - len(set(lines))) / len(lines),
    )
    at = np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts))
    v = np.bincount(at, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=TEXT_BUCKETS)
    x[_STYLE:] = np.sqrt(v / k)
    return x


def meta_features(lang, source, n_chars) -> np.ndarray:
    """Language, source and both together as hashed values, and the stated length."""
    x = np.zeros(META_SIZE, np.float32)
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    size = math.log1p(max(n, 0)) / 12
    x[:_META] = 1.0, size, size * size
    for value in (f"lang={lang}", f"source={source}", f"lang={lang} source={source}"):
        x[_META + _bucket(value, META_BUCKETS)] += 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights of a logistic model with a last, unpenalised bias, by Adam over all rows."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _even(y: np.ndarray) -> np.ndarray:
    """Row weights under which both classes weigh the same."""
    good = max(y.mean(), 1e-9)
    return np.where(y > 0, 0.5 / good, 0.5 / max(1 - good, 1e-9))


class CoTrained:
    """Both views' models, their calibration and their combination."""

    def __init__(self, share: float = 0.5):
        self.share = share
        self.text = self.meta = self.calibration = self.weights = None

    def fit(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, sure_of=None, rounds: int = ROUNDS) -> "CoTrained":
        """Fit on labelled rows; sure_of(models, may) gives the rows that each view teaches the other.

        models are the two views' weights and may[view][class] says whether a view has proved itself;
        the rows come as (view that is sure, class, text features, meta features).
        """
        if len(y) == 0 or min(y.sum(), (1 - y).sum()) < 4:
            self.share = float(y.mean()) if len(y) else 0.5
            return self
        part = np.zeros(len(y), int)
        for c in (0, 1):  # of each class, a quarter calibrates and a quarter proves
            at = np.flatnonzero(y == c)
            part[at] = np.arange(len(at)) % 4
        held, proof, known = part == 0, part == 1, part > 1
        views = {"text": text, "meta": meta}
        taught = {k: (np.zeros((0, x.shape[1]), np.float32), np.zeros(0)) for k, x in views.items()}
        models = {}
        for r in range(rounds + 1):
            for k, x in views.items():
                xs, ys = np.r_[x[known], taught[k][0]], np.r_[y[known], taught[k][1]]
                # A pseudo-label weighs less than a label.
                models[k] = fit_logistic(xs, ys, _even(ys) * np.r_[np.ones(known.sum()), np.full(len(taught[k][1]), 0.3)])
            if r == rounds or sure_of is None:
                break
            may = {}
            for k, x in views.items():
                p = sigmoid(self._raw(models[k], x[proof]))
                sure = (1 - p > SURE, p > SURE)
                may[k] = [bool(sure[c].any() and (y[proof][sure[c]] == c).mean() > PROVED) for c in (0, 1)]
            for view, c, t, m in sure_of(models, may):
                other, x = ("meta", m) if view == "text" else ("text", t)
                taught[other] = np.r_[taught[other][0], x[None]], np.r_[taught[other][1], float(c)]
        self.text, self.meta = models["text"], models["meta"]
        z = np.stack([self._raw(self.text, text[held]), self._raw(self.meta, meta[held])], axis=1)
        yh = y[held].astype(float)
        flat = np.ones(len(yh))
        self.calibration = [fit_logistic(z[:, [i]] / 4, yh, flat, 1e-2) for i in (0, 1)]
        c = np.stack([self._calibrated(i, z[:, i]) for i in (0, 1)], axis=1)
        self.weights = fit_logistic(c / 4, yh, flat, 1e-3)
        return self

    @staticmethod
    def _raw(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def _calibrated(self, i: int, z: np.ndarray) -> np.ndarray:
        w = self.calibration[i]
        return np.clip(z / 4 * w[0] + w[1], -12, 12)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good: by text, by metadata, combined."""
        if self.text is None:
            p = np.full(len(text), self.share)
            return p, p, p
        c = np.stack([self._calibrated(0, self._raw(self.text, text)), self._calibrated(1, self._raw(self.meta, meta))], axis=1)
        return sigmoid(c[:, 0]), sigmoid(c[:, 1]), sigmoid(c / 4 @ self.weights[:2] + self.weights[2])


def _views(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features of a batch with text, lang, source and n_chars."""
    return np.stack([text_features(x) for x in b["_text"]]), np.stack([meta_features(*x) for x in zip(b["_lang"], b["_source"], b["_n"])])


_COLUMNS = ("text as _text", "lang as _lang", "source as _source", "cast(n_chars as double) as _n")


def _known(docs: DataFrame, labels: DataFrame, labelled: int, seed: int) -> list:
    """The labelled sample: rows doc_id, k, y, t, m (features as bytes) in order of k."""
    taken = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    # Twice the bound is drawn, since some labelled documents may be gone.
    drawn = taken.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(2 * labelled)
    found = docs.selectExpr("doc_id", *_COLUMNS).join(F.broadcast(drawn), "doc_id").withColumn("k", F.xxhash64("doc_id", F.lit(seed)))
    found = found.orderBy("k", "doc_id", F.xxhash64("_text"), F.xxhash64("_lang", "_source", "_n")).limit(labelled).withColumn("doc_id", F.col("doc_id").cast("string"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, m = _views(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "k": b["k"], "y": b["y"], "t": [x.tobytes() for x in t], "m": [x.tobytes() for x in m]})

    rows = sorted(found.mapInPandas(work, "doc_id string, k bigint, y int, t binary, m binary").collect(), key=lambda r: (r["k"], r["doc_id"], r["t"], r["m"]))
    return [r for i, r in enumerate(rows) if i == 0 or r["doc_id"] != rows[i - 1]["doc_id"]]


def _surest(docs: DataFrame, models: dict, may: dict, apart: frozenset, taught: int, slices: int) -> list:
    """Of all documents but those of `apart`, what each view is surest of: (view, class, text, meta features).

    Of equal texts one counts, so that a text with many copies is one pseudo-label.
    """
    jobs = [(view, c) for view in ("text", "meta") for c in (0, 1) if may[view][c]]
    if not jobs:
        return []

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {j: {} for j in jobs}
        for b in batches:
            b = b[~b["doc_id"].isin(apart)]
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                t, m = _views(part)
                keys, tie = part["key"].to_numpy(), part["tie"].to_numpy()
                raw = {"text": CoTrained._raw(models["text"], t), "meta": CoTrained._raw(models["meta"], m)}
                for view, c in jobs:
                    held = best[view, c]
                    p = sigmoid(raw[view] if c else -raw[view]).round(6)  # the last bits depend on the batch
                    for j in np.flatnonzero(p > SURE):
                        row = (float(p[j]), int(tie[j]), t[j].tobytes(), m[j].tobytes())
                        if keys[j] not in held or held[keys[j]][:2] < row[:2]:
                            held[keys[j]] = row
                    if len(held) > taught:
                        best[view, c] = dict(sorted(held.items(), key=lambda x: x[1][:2], reverse=True)[:taught])
        rows = [(view, c, int(key), *row) for (view, c), held in best.items() for key, row in held.items()]
        _buckets.clear()  # workers are used again by other stages
        yield pd.DataFrame(rows, columns=["view", "cls", "key", "p", "tie", "t", "m"])
        best.clear()
        let_go()

    sent = docs.selectExpr("coalesce(cast(doc_id as string), '') as doc_id", *_COLUMNS, "xxhash64(coalesce(text, '')) as key", "xxhash64(doc_id, lang, source, n_chars) as tie")
    found = sent.mapInPandas(work, "view string, cls int, key bigint, p double, tie bigint, t binary, m binary")
    each = found.groupBy("view", "cls", "key").agg(F.max(F.struct("p", "tie", "t", "m")).alias("r")).select("view", "cls", "key", "r.*")
    rank = lambda *by: F.row_number().over(Window.partitionBy("view", "cls", *by).orderBy(F.desc("p"), F.desc("tie"), "key"))
    each = each.withColumn("slice", F.pmod("key", F.lit(slices)))
    each = each.withColumn("n", rank("slice")).where(F.col("n") <= taught).withColumn("n", rank()).where(F.col("n") <= taught)
    rows = sorted(each.select("view", "cls", "n", "t", "m").collect(), key=lambda r: (r["view"], r["cls"], r["n"]))
    return [(r["view"], r["cls"], np.frombuffer(r["t"], np.float32), np.frombuffer(r["m"], np.float32)) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS, seed: int = SEED, slices: int = SLICES) -> CoTrained:
    """Fit on at most `labelled` labelled documents and, in each round, at most `taught` others a view and class."""
    rows = _known(docs, labels, labelled, seed)
    stack = lambda c, size: np.stack([np.frombuffer(r[c], np.float32) for r in rows]) if rows else np.zeros((0, size), np.float32)
    y = np.array([r["y"] > 0 for r in rows], float)
    apart = frozenset(r["doc_id"] for r in rows)
    return CoTrained().fit(stack("t", TEXT_SIZE), stack("m", META_SIZE), y, lambda models, may: _surest(docs, models, may, apart, taught, slices), rounds)


def score(docs: DataFrame, model: CoTrained, keep_at: float = 0.5, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> the given columns, p_text, p_meta, score and keep (score >= keep_at)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for i in range(0, len(b), 512):
                c = b.iloc[i : i + 512]
                parts.append(np.stack(model.score(*_views(c)), axis=1))
            p = np.concatenate(parts) if parts else np.zeros((0, 3))
            out = b[list(columns)].copy()
            out["p_text"], out["p_meta"], out["score"] = p[:, 0], p[:, 1], p[:, 2]
            out["keep"] = p[:, 2] >= keep_at
            yield out
        _buckets.clear()  # workers are used again by other stages
        let_go()

    sent, back = as_text(docs.selectExpr(*(f"`{c}`" for c in columns), *_COLUMNS), *columns)
    return back(sent.mapInPandas(work, ", ".join(f"`{c}` string" for c in columns) + ", p_text double, p_meta double, score double, keep boolean"))
