"""Toxic passages by maximum-scoring segments.

Words are runs of letters and digits, lower-cased (A-Z); the beginnings of longer
words count as forms of their own, which reaches inflected and compound words
that training has not seen.  Each form's log-odds
between toxic and other labelled texts are shrunk by an informative Dirichlet
prior, the forms' shares in both classes together with `prior` of all their
occurrences.  Forms whose log-odds are significant (z of at least `least_z`) make
the lexicon and score their log-odds less two standard errors; a word scores as
its best form, and -`drift` without any.  A linear scan finds all maximal scoring segments of a text
(Ruzzo and Tompa).

A segment's score S is calibrated as an extreme value: lambda solves the
condition that the expectation of exp(lambda s) over words of other texts is 1,
and lambda S - log(words of the text) is what the Gumbel law of the maximum
depends on.  The values of a text's significant segments are added up, and a
logistic curve fitted on the training rows turns the sum into a probability.

Labels come from at most `sample` labelled training rows, those of the least hash, a bound that
is a parameter.  The lexicon has every significant form; as one occurrence isn't
significant, they are fewer than half of the words of those rows' toxic texts.  The
scan covers all words of all texts.

Null and empty texts have no segment.  A document with several labels is toxic if one
says so; null labels are none.  Without labels of both classes the lexicon is
empty, and every score is the share of toxic rows, or 0.  Null identifiers are
in the training part but never labelled.  Repeated rows are scored alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder
from .textbatch import PUNCT, U64, Tokens, hash_spans, mix, signed, slices, tokenize

BINS = 200


@dataclass(frozen=True)
class Settings:
    prior: float = 0.1
    least_z: float = 3.0
    drift: float = 0.5
    sample: int = 50_000


#: Bytes of the beginnings that count as forms.
BEGINNINGS = (6, 8)


def forms(data: np.ndarray, tokens: Tokens) -> list[np.ndarray]:
    """The hashes of all words, then of the words' beginnings; 0 for words that are no longer than those."""
    out = [tokens.hashes]
    for k in BEGINNINGS:
        longer = tokens.ends - tokens.starts > k
        h = np.zeros(len(longer), U64)
        h[longer] = mix(hash_spans(data, tokens.starts[longer], tokens.starts[longer] + k) + U64(k))
        out.append(h)
    return out


@dataclass
class Model:
    words: np.ndarray
    scores: np.ndarray
    drift: float
    scale: float
    curve: tuple[float, float]

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[self.words.astype(np.int64) & 0xFFFFF] = True

    def find(self, data: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Places of words of the lexicon and their scores."""
        best = np.zeros(len(tokens.hashes))
        for h in forms(data, tokens):
            at = np.flatnonzero(self.near[h.astype(np.int64) & 0xFFFFF])
            if len(at) and len(self.words):
                place = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
                best[at] = np.maximum(best[at], np.where(self.words[place] == h[at], self.scores[place], 0))
        at = np.flatnonzero(best > 0)
        return at, best[at]

    def value(self, segments: list[tuple[int, int, float]], words: int) -> float:
        """The sum of the calibrated scores of the segments above what chance gives a text of so many words."""
        base = math.log(max(words, 1))
        return sum(max(0.0, self.scale * s - base) for _, _, s in segments)

    def probability(self, value: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * value, -50, 50)))


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that scores -drift everywhere but at the given places.

    Each segment knows the last one before it with a smaller total before it, so that the search for one goes from
    link to link and the whole takes linear time.
    """
    found: list[list] = []  # first, last, total before it, total with it, link
    total, before = 0.0, -1
    for place, score in zip(places, scores):
        total -= drift * (place - before - 1)
        new = [place, place, total, total + score, -1]
        total += score
        before = place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _rate(p: np.ndarray, s: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum(p exp(lambda s)) + (1 - sum p) exp(-lambda drift) = 1."""
    rest = 1 - p.sum()
    if not len(s) or p.sum() <= 0 or (p * s).sum() - rest * drift >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: (p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(-x * drift) - 1
    while value(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _curve(x: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression on counts, with a weak pull of the slope to 1."""
    w = np.array([math.log((label @ n + 0.5) / ((1 - label) @ n + 0.5)), 1.0])
    features = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -50, 50)))
        grad = features.T @ (n * (label - p)) - np.array([0.0, w[1] - 1])
        hess = (features * (n * p * (1 - p))[:, None]).T @ features + np.diag([1e-6, 1.0])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), part: int = 0) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) of rows whose remainder is not `part`."""
    marked = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != part)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample).withColumnRenamed("doc_id", "l_id")
    train = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("toxic", "text")  # at most `sample` rows

    def count(batches):
        for batch in batches:
            for piece, data, bounds in slices(batch):
                t = tokenize(data, bounds, PUNCT)
                toxic = piece.column("toxic").to_numpy() > 0
                hashes, mark = np.concatenate(forms(data, t)), np.tile(np.repeat(toxic, t.counts), 1 + len(BEGINNINGS))
                words, inv = np.unique(hashes, return_inverse=True)
                bad = np.bincount(inv, mark, len(words)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"word": pa.array(signed(words)), "t": pa.array(bad), "n": pa.array(np.bincount(inv, minlength=len(words)) - bad)})

    counts = train.mapInArrow(count, "word long, t long, n long").where("word <> 0").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    counts = counts.cache()
    total = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    nt, nn = float(total.t or 0), float(total.n or 0)
    toxic = train.groupBy("toxic").count().collect()
    bad, good = (sum(r["count"] for r in toxic if (r.toxic > 0) == k) for k in (True, False))
    if not nt or not nn:
        share = bad / (bad + good) if bad + good else 0.0
        counts.unpersist()
        return Model(np.zeros(0, np.uint64), np.zeros(0), settings.drift, 1.0, (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 1.0))
    mass = settings.prior * (nt + nn)
    a = (F.col("t") + F.col("n")) * settings.prior
    odds = F.log((F.col("t") + a) / (nt + mass - F.col("t") - a)) - F.log((F.col("n") + a) / (nn + mass - F.col("n") - a))
    error = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("n") + a))
    lexicon = counts.select("word", "n", odds.alias("odds"), error.alias("error")).where(F.col("odds") >= settings.least_z * F.col("error"))
    lexicon = lexicon.toArrow()
    counts.unpersist()
    words = lexicon.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    s = (lexicon.column("odds").to_numpy() - 2 * lexicon.column("error").to_numpy())[order]
    p = (lexicon.column("n").to_numpy()[order] + 0.5) / nn
    model = Model(words[order], s, settings.drift, _rate(p, s, settings.drift), (0.0, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def binned(batches):
        table = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            for piece, data, bounds in slices(batch):
                for (_, value), is_toxic in zip(_scan(shared.value, data, bounds), piece.column("toxic").to_pylist()):
                    table[int(is_toxic > 0), min(BINS, math.ceil(value * 2))] += 1
        yield pa.RecordBatch.from_pydict({"toxic": pa.array(np.repeat([0, 1], BINS + 1), pa.int32()), "bin": pa.array(np.tile(np.arange(BINS + 1), 2), pa.int32()), "n": pa.array(table.reshape(-1))})

    bins = train.mapInArrow(binned, "toxic int, bin int, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toPandas()
    model.curve = _curve(bins["bin"].to_numpy() / 2.0, bins["toxic"].to_numpy().astype(float), bins["n"].to_numpy().astype(float))
    return model


def _scan(model: Model, data: np.ndarray, bounds: np.ndarray):
    """For each text its segments as (first byte, last byte + 1, score), and its value."""
    t = tokenize(data, bounds, PUNCT)
    at, scores = model.find(data, t)
    cut = np.searchsorted(at, t.offsets)
    for i in range(len(bounds) - 1):
        a, b = cut[i], cut[i + 1]
        if a == b:
            yield [], 0.0
            continue
        places = (at[a:b] - t.offsets[i]).tolist()
        segments = maximal_segments(places, scores[a:b].tolist(), model.drift)
        first = t.offsets[i]
        yield [(int(t.starts[first + x] - bounds[i]), int(t.ends[first + y] - bounds[i]), s) for x, y, s in segments], model.value(segments, int(t.offsets[i + 1] - first))


def toxicity(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score, predicted, value, segments (first byte, byte after the last, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for piece, data, bounds in slices(batch):
                segments, values = zip(*_scan(shared.value, data, bounds))
                score = shared.value.probability(np.array(values))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(values, pa.float64()), pa.array([[{"first": a, "end": b, "score": s} for a, b, s in x] for x in segments], pa.list_(segment))],
                    names=["doc_id", "score", "predicted", "value", "segments"],
                )

    own = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, predicted int, value double, segments array<struct<first: bigint, end: bigint, score: double>>")


def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity(docs, fit(docs, labels))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


__all__ = ["Model", "Settings", "fit", "maximal_segments", "op3_toxicity", "toxicity"]
