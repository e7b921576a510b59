"""Language identification by unigram piece models that sum over all segmentations of each word."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.arrowio import plainly_named, slices, texts
from helixlake.llm.textkit import U64, mix
from helixlake.plans.staging import ship

#: Languages learned at most.
LANGUAGES = 200
#: Learning reads longer runs of letters in parts of so many. Predictions sum over whole runs, of any length.
LEARNED_RUN = 40
#: Places whose pieces are looked up together, so that a run of any length takes bounded memory.
PLACES = 512
#: Bytes, about, of the words whose probabilities a Python worker keeps; when full, it starts anew.
CACHE_BYTES = 48 << 20
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(rf"[^\W\d_]{{1,{LEARNED_RUN}}}")
_SCALE = 30.0
_BASE = 0xC2B2AE3D27D4EB4F | 1


class Pieces:
    """The lower-cased pieces of letters of a public vocabulary, each found by a hash of its letters."""

    def __init__(self, pieces: list[str]):
        self.names = sorted({p for p in (x.lower() for x in pieces) if p and (p.lstrip("▁").isalpha() or p == "▁") and "▁" not in p[1:]})
        self.longest = max(map(len, self.names), default=1)
        wide = PLACES + self.longest + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([U64(1)], np.full(wide, _BASE, U64))), dtype=U64)
            inverse = U64(pow(_BASE, -1, 1 << 64))
            self.inverse = np.cumprod(np.concatenate(([U64(1)], np.full(wide, inverse, U64))), dtype=U64)
        self.bits = 20
        keys = np.asarray([self._hash(p) for p in self.names], U64)
        self.key = np.zeros(1 << self.bits, U64)
        self.slot = np.zeros(1 << self.bits, np.int32)  # 0: nothing, 1: a letter without a piece, then the pieces
        self.depth = 1
        for i, k in enumerate(keys):
            at, step = int(k >> U64(64 - self.bits)), 1
            while self.slot[at]:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            self.key[at], self.slot[at] = k, i + 2
            self.depth = max(self.depth, step)

    def _hash(self, p: str) -> int:
        with np.errstate(over="ignore"):
            return mix(np.asarray([sum(ord(c) * int(w) for c, w in zip(p, self.power.tolist(), strict=False)) & (2**64 - 1)], U64) + U64(len(p)))[0]

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the begin mark, and the words' letters with it as numbers, a row each, 0 after the end."""
        lengths = np.asarray([len(w) + 1 for w in words])
        wide = int(lengths.max())
        codes = np.zeros((len(words), wide), np.uint32)
        codes[:, 0] = ord("▁")
        codes[:, 1:][np.arange(wide - 1) < (lengths - 1)[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return lengths, codes

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """For n = 1.. the ids of the pieces of n letters at each place of the rows (0: none)."""
        wide = codes.shape[1]
        sums = np.zeros((len(codes), wide + 1), U64)
        np.cumsum(codes * self.power[:wide], axis=1, out=sums[:, 1:])
        found = []
        top = (1 << self.bits) - 1
        for n in range(1, min(self.longest, wide) + 1):
            h = mix((sums[:, n:] - sums[:, :-n]) * self.inverse[: wide - n + 1] + U64(n))
            at = (h >> U64(64 - self.bits)).astype(np.int64)
            ids = np.where(self.key[at] == h, self.slot[at], 0)
            for step in range(1, self.depth):
                a = (at + step) & top
                ids = np.where(self.key[a] == h, self.slot[a], ids)
            if n == 1:
                ids[ids == 0] = 1
            found.append(ids)
        return found


class Model:
    """prob[id, language] of each piece, times _SCALE for each of its letters to keep sums in range."""

    def __init__(self, pieces: Pieces, languages: list[str], prob: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.prob, self.prior = pieces, languages, prob, prior
        size = np.asarray([1, 1, *map(len, pieces.names)])
        self.scaled = prob * (_SCALE ** size[:, None])

    def forward(self, lengths: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """alpha[place, word, language]: the summed probability of all segmentations of the letters before a place."""
        wide = int(lengths.max())
        alpha = np.zeros((wide + 1, len(lengths), len(self.languages)))
        alpha[0] = 1
        for i in range(1, wide + 1):
            for n in range(1, min(len(found), i) + 1):
                alpha[i] += alpha[i - n] * self.scaled[found[n - 1][:, i - n]]
        return alpha

    def log_words(self, words: list[str]) -> np.ndarray:
        """Each word's log probability by language."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 2048 and (end - start) * len(words[order[end]]) < 1 << 17:
                end += 1
            out[order[start:end]] = self._log_group([words[i] for i in order[start:end]])
            start = end
        return out

    def _log_group(self, words: list[str]) -> np.ndarray:
        """log_words of words of about one length: the forward sums of the last `longest` places only, scaled as they go."""
        lengths, codes = self.pieces.codes(words)
        wide, rows = codes.shape[1], self.pieces.longest + 1
        sums = np.zeros((rows, len(words), len(self.languages)))
        sums[0] = 1
        scale, out = np.zeros(sums.shape[1:]), np.zeros(sums.shape[1:])
        for a in range(0, wide, PLACES):
            found = self.pieces.find(codes[:, a : a + PLACES + rows - 2])
            some = [(n, ids, (ids != 0).any(0)) for n, ids in enumerate(found, 1)]
            for s in range(a, min(a + PLACES, wide)):
                here = sums[s % rows]
                done = lengths == s
                if done.any():
                    out[done] = np.log(here[done]) + scale[done]
                for n, ids, has in some:
                    if s - a < len(has) and has[s - a]:
                        sums[(s + n) % rows] += here * self.prob[ids[:, s - a]]
                here[:] = 0
                if s % 8 == 7:
                    top = sums.max(0)
                    sums /= top
                    scale += np.log(top)
        done = lengths == wide
        out[done] = np.log(sums[wide % rows][done]) + scale[done]
        return out


def fit(pieces: Pieces, counts: dict[str, Counter], docs: dict[str, float], rounds: int = 4) -> Model:
    """Expectation maximisation of each language's piece probabilities over its word counts, from occurrences of pieces."""
    languages = sorted(counts)
    words = sorted(set().union(*counts.values()), key=lambda w: (len(w), w))
    weight = np.asarray([[counts[g][w] for g in languages] for w in words], float)
    size = len(pieces.names) + 2
    prior = np.asarray([docs[g] for g in languages]) / sum(docs.values())
    single = np.asarray([0, 1, *(len(p) == 1 for p in pieces.names)], bool)
    coded = [(slice(a, a + 2048), *pieces.codes(words[a : a + 2048])) for a in range(0, len(words), 2048)]
    blocks = [(at, lengths, pieces.find(codes)) for at, lengths, codes in coded]
    model = None
    for _ in range(rounds + 1):
        seen = np.zeros((size, len(languages)))
        for at, lengths, found in blocks:
            if model is not None:
                alpha = model.forward(lengths, found)
                wide = int(lengths.max())
                beta = np.zeros_like(alpha)
                beta[lengths, np.arange(len(lengths))] = 1
                for i in range(wide - 1, -1, -1):
                    for n in range(1, min(len(found), wide - i) + 1):
                        beta[i] += beta[i + n] * model.scaled[found[n - 1][:, i]]
                share = weight[at] / beta[0]
            for n, ids in enumerate(found, 1):
                for i in range(ids.shape[1]):
                    if model is None:
                        w = weight[at] * (i + n <= lengths)[:, None]
                    else:
                        w = alpha[i] * model.scaled[ids[:, i]] * beta[i + n] * share
                    for g in range(len(languages)):
                        seen[:, g] += np.bincount(ids[:, i], w[:, g], size)
        seen[0] = 0
        prob = (seen + 0.01 * (1 + single[:, None])) / (seen.sum(0) + 0.01 * size)
        prob[0] = 0
        prob[1] = 1e-7
        model = Model(pieces, languages, prob, prior)
    return model


def _predict(model: Model, names: list[str]):
    state: dict = {}

    def run(batches):
        groups = len(model.languages)
        for batch in batches:
            for part in slices(batch):
                words = [_WORDS.findall(t.lower()) for t in texts(part)]
                known = state.setdefault("known", {})
                new = {w for w in set().union(*words) if w not in known}
                state["bytes"] = state.get("bytes", CACHE_BYTES) + sum(map(len, new)) * 2 + len(new) * (180 + 8 * groups)
                if state["bytes"] > CACHE_BYTES:
                    known = state["known"] = {}
                    state["logs"] = np.zeros((0, groups))
                    state["bytes"] = 0
                    new = set().union(*words)
                if new:
                    new = list(new)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    state["logs"] = np.concatenate([state["logs"], model.log_words(new)])
                total = np.zeros((len(words), groups))
                for i, w in enumerate(words):
                    if w:
                        total[i] = state["logs"][np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(0)
                total += np.log(model.prior)
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                lettered = [any(map(str.isalpha, "".join(w[:50]))) or any(map(str.isalpha, "".join(w))) for w in words]
                lang = [model.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, share[np.arange(len(words)), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def train(docs: DataFrame, vocabulary: list[str], per_language: int = 500) -> Model | None:
    """A model from docs (doc_id, text, lang), without null languages or texts; None if nothing is left.

    It is fitted on about `per_language` documents of each language (all, where there are fewer), chosen by a hash of
    doc_id, and on the LANGUAGES most frequent languages (ties by name): the only bounds of this operator, both independent
    of the input's size. Tasks count the sample's runs of letters, read in parts of LEARNED_RUN; the driver gets the counts.
    The model has all lower-cased pieces of letters that the vocabulary has.
    """
    ship(docs.sparkSession)
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r[0]: r[1] for r in found.collect()}
    if not sizes:
        return None
    share = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) / 1e6
    known = docs.sparkSession.createDataFrame(list(sizes.items()), "lang string, n long")  # LANGUAGES rows at most
    some = docs.join(F.broadcast(known), "lang").filter(share * F.col("n") < per_language).select("lang", "text")
    counts: dict[str, Counter] = {g: Counter() for g in sizes}
    counted = some.mapInArrow(_count_parts, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n"))
    for g, part, k in sorted(counted.collect()):  # in one order, so that the sums of the fit are the same each time
        counts[g][part] = k
    return fit(Pieces(vocabulary), counts, sizes)


def _count_parts(batches):
    for batch in batches:
        for some in slices(batch):
            got: dict[tuple[str, str], int] = Counter()
            for g, t in zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True):
                got.update((g, x) for x in _PARTS.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array([x for _, x in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "part", "n"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns without text, with lang_pred string and score double (the language's posterior).

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learned. Columns of docs
    with these names are replaced; nulls elsewhere, repeated rows and further columns stay; an empty table gives an
    empty result. Whole texts are scored.
    """
    ship(docs.sparkSession)
    docs, named = plainly_named(docs.drop("lang_pred", "score"))
    names = [c for c in docs.columns if c != "text"]
    if model is None:
        return named(docs.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    schema = T.StructType(docs.select(*names).schema.fields + T.StructType.fromDDL("lang_pred string, score double").fields)
    return named(docs.mapInArrow(_predict(model, names), schema))
