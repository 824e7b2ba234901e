"""Toxic spans by a linear-chain conditional random field over words.

Labels say which documents are toxic, not which words. Words of toxic training documents whose features hardly occur
in others are the first labelled tokens; on these a chain of two tags (clean, toxic) is fitted, with features of each
word and of the words beside it. The tags of toxic documents are then taken anew from the chain's own marginals, given
that a toxic document holds a toxic word and others hold none, and the chain is fitted again. Forward-backward
marginals then give each word's chance to be toxic, and these add up to a document's score and its offending offsets.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, zstd_models

#: A word, or what ends a sentence: chains run over the words of one sentence.
WORD = re.compile(r"[^\W\d_]+|[.!?\n]")
#: Lengths of the word beginnings that count as features beside the whole word.
PREFIXES = range(3, 9)
#: Words whose score a task keeps.
CACHE = 300_000
PLAIN = 64


def word_features(word: str) -> list[str]:
    w = word.lower()
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)]


def chain_features(words: list[str]) -> list[list[str]]:
    """Of each word of a chain its own features, and the words before (<) and after it (>)."""
    low = [w.lower() for w in words]
    return [[*word_features(w), *([f"<{low[i - 1]}"] if i else []), *([f">{low[i + 1]}"] if i + 1 < len(low) else [])] for i, w in enumerate(words)]


@dataclass(frozen=True)
class ToxicityModel:
    #: Weight of each feature for the toxic tag, the toxic tag's bias, log-potentials [from, to] of tags and of a start.
    emission: dict[str, float]
    bias: float
    transition: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]
    #: Of evidence(), bias last.
    calibration: tuple[float, ...]


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for many chains at once: scores holds the toxic tag's log-potential of each word, chain after
    chain. Returns each word's toxic marginal, the expected transitions [from, to], and the log-partition of each chain."""
    n, first = len(lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    first, size = first[order], lengths[order]
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if n else 0)]  # chains longer than t
    t00, t01, t10, t11 = transition.ravel()
    for t, m in enumerate(active):
        at = first[:m] + t
        if t == 0:
            alpha[at, 0], alpha[at, 1] = start[0], start[1] + scores[at]
        else:
            a, b = alpha[at - 1, 0], alpha[at - 1, 1]
            alpha[at, 0] = _logsum(a + t00, b + t10)
            alpha[at, 1] = _logsum(a + t01, b + t11) + scores[at]
    pairs = np.zeros((2, 2))
    last = first + size - 1
    z = np.zeros(n)
    z[order] = _logsum(alpha[last, 0], alpha[last, 1])
    zs = z[order]
    for t in range(len(active) - 2, -1, -1):
        m = active[t + 1]
        at = first[:m] + t
        c, d = beta[at + 1, 0], beta[at + 1, 1] + scores[at + 1]
        beta[at, 0], beta[at, 1] = _logsum(t00 + c, t01 + d), _logsum(t10 + c, t11 + d)
        for i in (0, 1):
            pairs[i, 0] += np.exp(alpha[at, i] + transition[i, 0] + c - zs[:m]).sum()
            pairs[i, 1] += np.exp(alpha[at, i] + transition[i, 1] + d - zs[:m]).sum()
    both = alpha + beta
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    return p, pairs, z


def chains(text: str) -> list[list[str]]:
    out, now = [], []
    for w in WORD.findall(text):
        if w in ".!?\n":
            if now:
                out.append(now)
                now = []
        else:
            now.append(w)
    if now:
        out.append(now)
    return out


def fit_chain(examples: list[tuple[list[list[str]], np.ndarray]], names: list[str], rounds: int = 80, ridge: float = 1.0) -> tuple[dict[str, float], float, np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge, by gradient steps of adapted size. examples: (features of each word, tags); a
    tag is 0, 1 or, where it isn't certain, the chance of 1."""
    index = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(t) for _, t in examples], dtype=np.int64)
    tags = np.concatenate([t for _, t in examples]).astype(float)
    word, feat, k = [], [], 0
    for fs, _ in examples:
        for f in fs:
            known = [index[x] for x in f if x in index]
            word += [k] * len(known)
            feat += known
            k += 1
    word, feat = np.array(word, dtype=np.int64), np.array(feat, dtype=np.int64)
    ends = np.cumsum(lengths) - 1
    inside = np.ones(len(tags), dtype=bool)
    inside[ends] = False
    at = np.flatnonzero(inside)
    seen_pairs = np.zeros((2, 2))
    for i, x in enumerate((1 - tags[at], tags[at])):
        for j, y in enumerate((1 - tags[at + 1], tags[at + 1])):
            seen_pairs[i, j] = (x * y).sum()
    begins = ends - lengths + 1
    seen_feat = np.bincount(feat, weights=tags[word], minlength=len(names))
    theta = np.zeros(len(names) + 1 + 4 + 2)
    theta[len(names)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, bias, tr, st = theta[: len(names)], theta[len(names)], theta[-6:-2].reshape(2, 2), theta[-2:]
        scores = np.full(len(tags), bias)
        np.add.at(scores, word, w[feat])
        p, pairs, _ = marginals(scores, lengths, tr, st)
        grad = np.concatenate([seen_feat - np.bincount(feat, weights=p[word], minlength=len(names)), [tags.sum() - p.sum()], (seen_pairs - pairs).ravel(), [(1 - tags[begins]).sum() - (1 - p[begins]).sum(), tags[begins].sum() - p[begins].sum()]])
        grad = grad - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return dict(zip(names, theta[: len(names)].tolist(), strict=True)), float(theta[len(names)]), theta[-6:-2].reshape(2, 2), theta[-2:]


def expected_tags(features: list[list[list[str]]], toxic: np.ndarray, doc: np.ndarray, emission: dict[str, float], bias: float, transition: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Each chain's chances of toxic words given its document's label: none in a clean document; in a toxic one the
    chain's marginals over the chance that one of the document's words is toxic. That none is toxic is one path of each
    of its chains, so its chance is exact: the path's score less the chain's log-partition, added up over the chains."""
    lengths = np.array([len(c) for c in features], dtype=np.int64)
    scores = np.array([bias + sum(emission.get(f, 0.0) for f in fs) for c in features for fs in c])
    p, _, z = marginals(scores, lengths, transition, start)
    clean = start[0] + (lengths - 1) * transition[0, 0] - z
    some = -np.expm1(np.minimum(np.bincount(doc, weights=clean, minlength=int(doc.max()) + 1), 0.0))
    q = np.where(np.repeat(toxic, lengths), np.minimum(p / np.maximum(some, 1e-9)[np.repeat(doc, lengths)], 1.0), 0.0)
    return np.split(q, np.cumsum(lengths)[:-1])


class _Scores(dict):
    """The place of each word that a task has met, and by place the toxic tag's log-potential of the word (of what ends
    a sentence no number) and what the word adds to those of the words after and before it."""

    def __init__(self, emission: dict[str, float], bias: float):
        self.emission, self.bias = emission, bias
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.own, self.onward, self.back = array("d"), array("d"), array("d")

    def __missing__(self, word: str) -> int:
        get, low, end = self.emission.get, word.lower(), word in ".!?\n"
        self.own.append(float("nan") if end else self.bias + sum([get(f, 0.0) for f in word_features(word)]))
        self.onward.append(0.0 if end else get(f"<{low}", 0.0))
        self.back.append(0.0 if end else get(f">{low}", 0.0))
        found = self[word] = len(self.own) - 1
        return found


class Tagger:
    """The model in a Python worker."""

    def __init__(self, emission: dict[str, float], bias: float, transition: np.ndarray, start: np.ndarray):
        self.bias, self.transition, self.start = bias, np.array(transition), np.array(start)
        self.scores = _Scores(emission, bias)
        #: Chains without a known feature have the same marginals at the same length: those of up to PLAIN words.
        self.plain = [marginals(np.full(n, bias), np.array([n]), self.transition, self.start)[0] for n in range(1, PLAIN + 1)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The marginal of each word of each text, in order."""
        kept, parts = self.scores, []
        if len(kept) >= CACHE:
            kept.restart()
        for text in texts:
            parts.append(np.array([kept[w] for w in WORD.findall(text)] + [kept["."]]))
        place = np.concatenate([np.zeros(0, np.int64), *parts])
        own, onward, back = (np.array(x) for x in (kept.own, kept.onward, kept.back))
        held = own[place]
        held[1:] += onward[place[:-1]]
        held[:-1] += back[place[1:]]
        ends = np.isnan(held)
        chain, scores = np.cumsum(ends)[~ends], held[~ends]
        p = np.zeros(len(scores))
        if len(scores):
            first = np.flatnonzero(np.diff(chain, prepend=-1))
            lengths = np.diff(first, append=len(scores))
            hot = (np.add.reduceat(scores != self.bias, first) > 0) | (lengths > PLAIN)
            if hot.any():
                at = np.repeat(hot, lengths)
                p[at] = marginals(scores[at], lengths[hot], self.transition, self.start)[0]
            for n in np.unique(lengths[~hot]):
                same = first[~hot & (lengths == n)]
                p[same[:, None] + np.arange(n)] = self.plain[n - 1]
        sizes = [int(len(x) - np.isnan(own[x]).sum()) for x in parts]
        return np.split(p, np.cumsum(sizes)[:-1]) if sizes else []


def evidence(p: np.ndarray) -> tuple[float, float, float]:
    """Of a document: the log-odds of its worst word, and its expected toxic words, in number and by share."""
    top = float(np.clip(p.max(), 1e-6, 1 - 1e-6)) if len(p) else 1e-6
    total = float(p.sum())
    return float(np.log(top / (1 - top))), float(np.log1p(total)), float(np.log1p(100 * total / max(len(p), 1)))


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets [start, end) of runs of words with a marginal of at least `least`, a sentence's end apart."""
    out: list[tuple[int, int]] = []
    i, open_run = 0, False
    for m in WORD.finditer(text):
        if m.group() in ".!?\n":
            open_run = False
            continue
        if p[i] >= least:
            if open_run:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            open_run = True
        else:
            open_run = False
        i += 1
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [Counter(), Counter()]
        for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
            n[y].update({f for c in chains(text) for fs in chain_features(c) for f in fs})
        names = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([n[k][f] for f in names], pa.int64()) for k in (0, 1))], names=["feature", "clean", "toxic"])


def fit_toxicity(labelled: DataFrame, label: str = "toxic", rows_per_class: int = 2500, max_features: int = 1500, max_chains: int = 12_000, plain_chains: int = 8, max_words: int = 200, refits: int = 1, calibrate_rows: int = 3000) -> ToxicityModel:
    """Learns from doc_id, text and a 0/1 label column; rows with a null label or text are no examples.

    All fitting is on a bounded sample: rows_per_class documents of each label for words and chains (at most
    max_chains of these: all with a telling word, and of the others every plain_chains-th of a document; each in pieces
    of max_words), calibrate_rows other documents in their natural shares for the score. Words count over the sample in
    Spark; the driver gets max_features features, the chains and three numbers for each calibration row. refits is how
    often tags are taken anew. Without an example of either label, or a telling word, all texts get one score.
    """
    spark = labelled.sparkSession
    rows = labelled.where(f"{label} in (0, 1) and text is not null").select("doc_id", "text", F.col(label).cast("int").alias("_y"))
    fold = F.crc32(F.concat(F.lit("tox"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 3
    ids = common.pick_ids(rows.where(fold < 2), "_y", rows_per_class)
    # By doc_id alone Spark can cut the texts down to the sample below the join with the labels.
    sample = rows.where(fold < 2).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text", "_y")
    sample = common.written(sample, "toxicity-sample")
    totals = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    counts = common.arrow_map(sample, _counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Hardly ever in clean documents: the odds of the label given the feature, smoothed by one document of each kind.
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    telling = counts.where((F.col("toxic") >= 3) & (odds >= 8)).orderBy(F.desc(F.col("toxic") * F.log(odds)), "feature").limit(max_features)
    found = telling.collect()
    if not found or not n0:
        return ToxicityModel({}, -4.0, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0), (0.0, 0.0, 0.0, float(np.log((n1 + 0.5) / (n0 + 0.5)))))
    names = [r["feature"] for r in found]
    known = spark.sparkContext.broadcast(frozenset(names))

    def telling_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, own, docs = [], [], []
            for text, y, d in zip(*(batch.column(k).to_pylist() for k in ("text", "_y", "_d")), strict=True):
                for i, c in enumerate(chains(text)):
                    if i % plain_chains == 0 or any(f in known.value for w in c for f in word_features(w)):
                        for k in range(0, len(c), max_words):
                            words.append(c[k : k + max_words])
                            own.append(y)
                            docs.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(own, pa.int32()), pa.array(docs, pa.int64())], names=["words", "_y", "_d"])

    order = F.xxhash64(F.array_join("words", " "))
    picked = common.arrow_map(sample.withColumn("_d", F.xxhash64("text")), telling_chains, "words array<string>, _y int, _d long").orderBy(order, "_y", "_d").limit(max_chains).collect()
    features = [chain_features(r["words"]) for r in picked]
    toxic = np.array([r["_y"] == 1 for r in picked])
    # The words beside a telling word aren't labelled for it.
    tags = [np.array([y and any(f in known.value for f in word_features(w)) for w in r["words"]], dtype=float) for r, y in zip(picked, toxic, strict=True)]
    emission, bias, transition, start = fit_chain(list(zip(features, tags, strict=True)), names)
    doc = np.unique([r["_d"] for r in picked], return_inverse=True)[1]
    for _ in range(refits):
        tags = expected_tags(features, toxic, doc, emission, bias, transition, start)
        emission, bias, transition, start = fit_chain(list(zip(features, tags, strict=True)), names)
    emission = {f: w for f, w in emission.items() if abs(w) > 1e-3}
    parts = (emission, bias, tuple(map(tuple, transition.tolist())), tuple(start.tolist()))
    held = spark.sparkContext.broadcast(parts)
    own = rows.where(fold == 2)
    ids = common.pick_ids(own.withColumn("_all", F.lit(1)), "_all", calibrate_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*held.value)
        for batch in batches:
            e = np.array([evidence(p) for p in tagger(batch.column("text").to_pylist())]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(e[:, k]) for k in range(3)), batch.column("_y")], names=["a", "b", "c", "y"])

    seen = common.arrow_map(own.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text", "_y"), measure, "a double, b double, c double, y int").collect()
    common.dropped(sample)
    x, y = np.array([[r.a, r.b, r.c] for r in seen]).reshape(-1, 3), np.array([r.y for r in seen], dtype=float)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0) if len(x) else np.ones(3)
    w = zstd_models.fit_logistic(x / scale, y, ridge=0.1)
    return ToxicityModel(*parts, (*(w[:-1] / scale).tolist(), float(w[-1])))


_SCHEMA = "doc_id long, score double, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher where the label is likelier 1) and spans, the offending
    code point offsets [start, end) in the text.

    Only doc_id and text are read, and texts are tagged whole. Null counts as empty; a text without words gets the
    lowest score and no spans. Equal texts get equal results. An empty table gives an empty result.
    """
    parts = (model.emission, model.bias, model.transition, model.start)
    held = docs.sparkSession.sparkContext.broadcast((parts, model.calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = held.value
        tagger = Tagger(*own)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ps = tagger(texts)
            z = [float(np.dot(evidence(p), weights[:-1])) + weights[-1] for p in ps]
            score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            found = [[{"start": a, "end": b} for a, b in spans(t, p)] if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, ps, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(found, _SPANS)], names=["doc_id", "score", "spans"])

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)
