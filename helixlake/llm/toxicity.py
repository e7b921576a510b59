"""Toxic spans by a linear-chain conditional random field; its marginals give document scores and offsets."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.arrowio import plainly_named, slices, texts
from helixlake.plans.staging import ship

#: Labelled documents that the classifier is fitted on, at most about so many of each label (by a hash of doc_id).
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 3000
#: Windows of _WINDOW tokens, with cues and without, that the chain is fitted on at most.
HOT_WINDOWS, PLAIN_WINDOWS = 6000, 3000
#: Bytes, about, of the words whose potentials a Python worker keeps; when full, it starts anew.
CACHE_BYTES = 24 << 20
_WORD = re.compile(r"[^\W_]+")
_STEMS = range(3, 9)
_WINDOW = 64


def lowered(text: str) -> str:
    """In lower case, each character for itself, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def units(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return [word + "$", *(word[:n] for n in _STEMS if len(word) >= n)]


def marginals(score: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each token, by forward-backward over chains laid one after another.

    score: log potential of label 1 over label 0; starts: first tokens of chains; trans: 2 x 2 log potentials.
    The tokens are cut into blocks whose transfer matrices are multiplied side by side; the blocks are then chained,
    and the messages run side by side within all blocks. A chain's first matrix forgets what was before.
    """
    n = len(score)
    if not n:
        return np.zeros(0)
    width = 128
    rows = -(-n // width)
    up = np.zeros(rows * width)
    up[:n] = np.clip(score, -40, 40)
    first = np.zeros(rows * width, bool)
    first[starts] = True
    first[n:] = True  # what fills the last block is no part of the last chain
    t = np.exp(trans)
    e = np.exp(up)
    top = np.maximum(e, 1.0)
    # m[j][k]: from label j to label k, scaled
    m = [[np.where(first, 1.0, t[j, k]) * (e if k else 1.0) / top for k in (0, 1)] for j in (0, 1)]
    m = [[x.reshape(rows, width) for x in r] for r in m]
    whole = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
    for c in range(width):
        whole = [[whole[j][0] * m[0][k][:, c] + whole[j][1] * m[1][k][:, c] for k in (0, 1)] for j in (0, 1)]
        norm = whole[0][0] + whole[0][1] + whole[1][0] + whole[1][1]
        whole = [[x / norm for x in r] for r in whole]
    w = np.stack([whole[0][0], whole[0][1], whole[1][0], whole[1][1]], 1).tolist()
    a0, a1, begin = 0.5, 0.5, []
    for p, q, r, s in w:
        begin.append((a0, a1))
        a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
    b0, b1, end = 0.5, 0.5, []
    for p, q, r, s in reversed(w):
        end.append((b0, b1))
        b0, b1 = p * b0 + q * b1, r * b0 + s * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    a, b = np.asarray(begin).T.copy(), np.asarray(end[::-1]).T.copy()
    forward = np.empty((2, width, rows))
    for c in range(width):
        a = np.stack([a[0] * m[0][0][:, c] + a[1] * m[1][0][:, c], a[0] * m[0][1][:, c] + a[1] * m[1][1][:, c]])
        a /= a[0] + a[1]
        forward[:, c] = a
    out = np.empty((width, rows))
    for c in range(width - 1, -1, -1):
        one = forward[1, c] * b[1]
        out[c] = one / (forward[0, c] * b[0] + one)
        b = np.stack([m[0][0][:, c] * b[0] + m[0][1][:, c] * b[1], m[1][0][:, c] * b[0] + m[1][1][:, c] * b[1]])
        b /= b[0] + b[1]
    return out.T.reshape(-1)[:n]


class Tagger:
    """Feature weights, transitions and the document layer. score() is what tasks run."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, doc: np.ndarray):
        self.weights, self.bias, self.trans, self.doc = weights, bias, trans, doc
        self.known: dict[str, int] = {}
        self.scores = np.zeros(0)
        self.held = 0

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(u, 0.0) for u in units(word))

    def tokens(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, and n + 1 bounds of documents among them."""
        new = {w for w in set().union(*docs) if w not in self.known}
        self.held += 2 * sum(map(len, new)) + 180 * len(new)
        if self.held > CACHE_BYTES:
            self.known, self.scores, self.held = {}, np.zeros(0), 0
            new = set().union(*docs)
        if new:
            new = list(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, [self.word_score(w) for w in new]])
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        at = np.concatenate([np.fromiter(map(self.known.__getitem__, d), np.int64, len(d)) for d in docs] or [np.zeros(0, np.int64)])
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        return marginals(self.scores[at], starts, self.trans), bounds

    def score(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, bounds) @ self.doc, -30, 30)))


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: bias, log of the expected number of toxic tokens and of its square's part, the largest marginal, log length."""
    n = len(bounds) - 1
    total, most = np.zeros(n), np.zeros(n)
    some = bounds[:-1] < bounds[1:]
    if some.any():
        at = bounds[:-1][some]
        total[some], most[some] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    length = np.log1p(bounds[1:] - bounds[:-1])
    x = np.log1p(total)
    return np.stack([np.ones(n), x, np.log1p(np.maximum(total - most, 0)), most, length / 5, x * length / 5], 1)


def _fit_chain(seqs: list[tuple[np.ndarray, np.ndarray]], features: list[list[int]], size: int, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum conditional likelihood of labelled windows by Adam. seqs: (word numbers, labels); features: by word."""
    n, width = len(seqs), max(len(s[0]) for s in seqs)
    word, label, here = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (w, y) in enumerate(seqs):
        word[i, : len(w)], label[i, : len(w)], here[i, : len(w)] = w, y, True
    pair_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
    pair_feature = np.asarray([x for f in features for x in f], np.int64)
    theta = np.zeros(size + 5)  # features, bias, four transitions
    theta[size] = -2
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = here[:, 1:]
    tokens = here.sum()
    for step in range(1, rounds + 1):
        s = np.bincount(pair_word, theta[pair_feature], len(features))[word] + theta[size]
        trans = theta[size + 1 :].reshape(2, 2)
        t = np.exp(trans)
        e = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], 2)
        alpha, beta = np.empty((width, n, 2)), np.ones((width, n, 2))
        a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        alpha[0] = a
        for c in range(1, width):
            x = (a @ t) * e[:, c]
            a = np.where(here[:, c, None], x / x.sum(1, keepdims=True), a)
            alpha[c] = a
        edge = np.zeros((2, 2))
        for c in range(width - 1, 0, -1):
            x = e[:, c] * beta[c]
            pairs = alpha[c - 1][:, :, None] * t * x[:, None, :]
            pairs /= pairs.sum((1, 2), keepdims=True)
            edge += pairs[here[:, c]].sum(0)
            x = x @ t.T
            beta[c - 1] = np.where(here[:, c, None], x / x.sum(1, keepdims=True), beta[c - 1])
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(2)).T
        gap = np.where(here, label - p, 0)
        by_word = np.bincount(word.ravel(), gap.ravel(), len(features))
        g = np.zeros_like(theta)
        g[:size] = np.bincount(pair_feature, by_word[pair_word], size)
        g[size] = gap.sum()
        true = np.bincount((label[:, :-1] * 2 + label[:, 1:])[both], minlength=4)
        g[size + 1 :] = true - edge.ravel()
        g = g / tokens * 20 - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def _fit_documents(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    theta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (y - p)) - decay * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(theta))
        theta = theta + np.linalg.solve(h, g)
    return theta


def fit(rows: Iterable[tuple[str, int]], weight_of: dict[int, float]) -> Tagger | None:
    """A tagger from labelled documents. Words of toxic documents are labelled toxic where they, or a beginning of
    them, are in toxic documents far more often (five times the share, and more than chance among so many would give)."""
    number: dict[str, int] = {}
    docs = [(np.asarray([number.setdefault(w, len(number)) for w in _WORD.findall(lowered(t))], np.int32), int(y)) for t, y in rows]
    words = list(number)
    del number
    n = Counter(y for _, y in docs)
    if not n[0] or not n[1]:
        return None
    toxic: Counter = Counter()
    for d, y in docs:
        if y:
            toxic.update({u for i in np.unique(d) for u in units(words[i])})
    toxic = Counter({u: k for u, k in toxic.items() if k >= 3})
    clean: Counter = Counter()
    for d, y in docs:
        if not y:
            clean.update({u for i in np.unique(d) for u in units(words[i]) if u in toxic})
    share = lambda u: (toxic[u] / n[1]) / ((clean[u] + 0.5) / n[0])
    often = [u for u in toxic if share(u) >= 5]

    def surprise(u: str) -> float:
        out, p = 0.0, (toxic[u] + clean[u]) / (n[0] + n[1])
        for k, all_ in ((toxic[u], n[1]), (clean[u], n[0])):
            for seen, want in ((k, all_ * p), (all_ - k, all_ * (1 - p))):
                out += 2 * seen * math.log(seen / want) if seen else 0
        return out

    cues = {u for u in often if surprise(u) >= 2 * math.log(max(2, len(often))) + 2}
    feature = {u: i for i, u in enumerate(sorted(toxic))}
    marked = np.asarray([any(u in cues for u in units(w)) for w in words], bool)
    hot, plain = [], []
    for d, y in docs:
        for a in range(0, len(d), _WINDOW):
            part = d[a : a + _WINDOW]
            (hot if marked[part].any() else plain).append((part, (marked[part] & bool(y)).astype(np.int8)))
    seqs = hot[:: max(1, -(-len(hot) // HOT_WINDOWS))] + plain[:: max(1, -(-len(plain) // PLAIN_WINDOWS))]
    if not seqs:
        return None
    features = [[feature[u] for u in units(w) if u in feature] for w in words]
    w, bias, trans = _fit_chain(seqs, features, max(1, len(feature)))
    tagger = Tagger({u: float(w[i]) for u, i in feature.items() if abs(w[i]) > 1e-3}, bias, trans, np.zeros(6))
    scores = np.asarray([tagger.word_score(x) for x in words])
    bounds = np.concatenate([[0], np.cumsum([len(d) for d, _ in docs])]).astype(np.int64)
    p = marginals(scores[np.concatenate([d for d, _ in docs])], bounds[:-1][bounds[:-1] < bounds[1:]], trans)
    y = np.asarray([y for _, y in docs])
    tagger.doc = _fit_documents(document_features(p, bounds), y, np.asarray([weight_of[int(k)] for k in y]))
    return tagger


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Tagger | None:
    """Fit on labelled documents (labels: doc_id, toxic 0 or 1; nulls are left out), about `toxic` and `clean` of each at most.

    This bounded sample is all that the driver reads; it is taken by a hash of doc_id and does not grow with the data. The
    chain is fitted on evenly chosen windows of the sample, HOT_WINDOWS with cues and PLAIN_WINDOWS without at most; the
    document layer on all of the sample. Scores always cover whole texts.
    """
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = {k: min(1.0, most / max(1, have.get(k, 0))) for k, most in ((1, toxic), (0, clean))}
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1e6
    chosen = labels.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).limit(2 * (toxic + clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text")
    return fit(((r.text or "", int(r.toxic)) for r in rows.toLocalIterator()), {k: 1 / share[k] for k in share})


def _score(tagger: Tagger, names: list[str], spans: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                low = [lowered(t) for t in texts(part)]
                p, bounds = tagger.tokens([_WORD.findall(t) for t in low])
                score = tagger.score(p, bounds)
                cols = [part.column(c) for c in names] + [pa.array(score), pa.array((score >= 0.5).astype("i4"))]
                if spans:
                    hot = np.flatnonzero(p >= 0.5)
                    found: list[list] = [[] for _ in low]
                    for d in np.unique(np.searchsorted(bounds, hot, "right") - 1).tolist():
                        mine = set((hot[(hot >= bounds[d]) & (hot < bounds[d + 1])] - bounds[d]).tolist())
                        found[d] = [{"start": m.start(), "end": m.end()} for i, m in enumerate(_WORD.finditer(low[d])) if i in mine]
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted", *["spans"] * spans])

    return run


def predict(docs: DataFrame, tagger: Tagger | None, spans: bool = True) -> DataFrame:
    """docs with score double (0 to 1), predicted int (1 from 0.5 on) and spans array<struct<start,end>> (code points) of
    the tokens whose marginal is 0.5 or more.

    A null text is scored as an empty one. Without a tagger (nothing to learn from) scores are 0. Columns of docs with
    these names are replaced; nulls elsewhere, repeated rows and further columns stay; an empty table gives an empty
    result. Whole texts are one chain each.
    """
    ship(docs.sparkSession)
    docs, named = plainly_named(docs.drop("score", "predicted", "spans"))
    added = "score double, predicted int" + ", spans array<struct<start:bigint,end:bigint>>" * spans
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(added).fields)
    if tagger is None:
        extra = [F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(schema.fields[-1].dataType).alias("spans")]
        return named(docs.select("*", *extra[: 2 + spans]))
    return named(docs.mapInArrow(_score(tagger, docs.columns, spans), schema))
