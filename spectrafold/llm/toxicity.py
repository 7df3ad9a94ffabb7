"""Toxicity: a counterfactual-regularised classifier of sentences; a text is as toxic as its most toxic sentence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import WORD_BYTES, chunks, flat, map_texts, mix, rows_of, span_hashes, spans
from spectrafold.llm.samples import labelled_sample

# Identity terms that are swapped for one another, by language.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists gay lesbian straight transgender black white asian "
    "latino african european american mexican immigrants refugees disabled blind deaf elderly young "
    "femmes hommes musulmans chrétiens juifs immigrés réfugiés handicapés homosexuels noirs blancs "
    "frauen männer muslime christen juden einwanderer flüchtlinge behinderte schwule schwarze weiße "
    "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados discapacitados homosexuales negros blancos"
).split()

#: Words of a sentence at most, length of the weight table, bytes of the word beginnings that are features beside words.
SENTENCE, BUCKETS, BEGINNINGS = 16, 1 << 18, (4, 5, 6)
#: Bytes of text whose features are made at a time for fitting, which is done on the driver.
CHUNK = 1 << 18
#: Labelled texts that the model is fitted on: at most this many of each label.
MAX_TRAIN = 1500
#: Weight of a squared score change between a sentence and its counterpart with another identity term or none.
COUNTERFACTUAL = 2.0
DECAY, ROUNDS, STEPS, RATE = 1e-4, 3, 60, 0.5
#: A feature may have a weight if its presence in texts goes with the label by so much (log-likelihood ratio).
ASSOCIATION = 16.0


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS
    bias: float
    slope: float  # probability = sigmoid(slope * logit + offset)
    offset: float


class Sentences:
    """Features of a batch of texts: words, their buckets, the sentence of each word and the row of each sentence."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(pc.utf8_lower(texts))
        starts, ends = spans(data, offsets, WORD_BYTES)
        row = rows_of(starts, offsets)
        hashes = span_hashes(data, starts, ends)
        size = ends - starts
        self.buckets = [hashes]
        for n in BEGINNINGS:
            long = size > n
            part = np.zeros(len(starts), np.uint64)
            part[long] = mix(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
            self.buckets.append(part)
        count = np.bincount(row, minlength=len(texts))
        first = (np.cumsum(count) - count)[row]
        at = np.arange(len(starts)) - first
        fresh = at % SENTENCE == 0
        again = np.zeros(len(starts), bool)  # a word repeated at once counts once
        again[1:] = (hashes[1:] == hashes[:-1]) & ~fresh[1:]
        keep = [~again, *((size > n) & ~again for n in BEGINNINGS)]
        for part, kept in zip(self.buckets, keep):
            part &= np.uint64(BUCKETS - 1)
            part[~kept] = BUCKETS
        self.buckets = np.stack([x.astype(np.int32) for x in self.buckets])
        self.starts = np.flatnonzero(fresh)  # of sentences
        self.row = row[self.starts]
        self.rows = len(texts)

    @classmethod
    def of(cls, texts: pa.Array) -> Sentences:
        """The same for many texts, made chunk by chunk, as the features need far less memory than their making."""
        parts, out = [cls(texts.slice(low, high - low)) for low, high in chunks(texts, CHUNK)], cls(texts.slice(0, 0))
        words = np.cumsum([0, *(p.buckets.shape[1] for p in parts)])
        rows = np.cumsum([0, *(p.rows for p in parts)])
        out.buckets = np.concatenate([out.buckets, *(p.buckets for p in parts)], axis=1)
        out.starts = np.concatenate([out.starts, *(p.starts + w for p, w in zip(parts, words))])
        out.row = np.concatenate([out.row, *(p.row + r for p, r in zip(parts, rows))])
        out.rows = int(rows[-1])
        return out

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """A logit for each sentence."""
        if not len(self.starts):
            return np.zeros(0)
        full = np.append(weights, 0.0)
        each = full[self.buckets[0]]
        for part in self.buckets[1:]:
            each += full[part]
        return np.add.reduceat(each, self.starts) + bias

    def highest(self, logits: np.ndarray, bias: float) -> np.ndarray:
        """The highest logit of each row; rows without words have the bias."""
        out = np.full(self.rows, float(bias))
        if len(logits):
            first = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[first]] = np.maximum.reduceat(logits, first)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _term_buckets(terms: list[str]) -> np.ndarray:
    """Buckets of each identity term: (feature, term)."""
    return Sentences(pa.array(terms)).buckets if terms else np.zeros((1 + len(BEGINNINGS), 0), np.int64)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits on labelled texts, of which only the label of the whole is known.

    Each round takes as examples the sentence that the present model finds most toxic (toxic texts: also others it finds
    toxic; clean texts: also two at random), and descends on the log loss plus COUNTERFACTUAL times the squared change of
    the score when an identity term of a sentence is swapped for another, or one is put into a sentence that has none.
    Probabilities are calibrated on a fifth of the texts that the weights were not fitted to. One label alone gives a
    constant score.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 8.0 if len(y) and y[0] else -8.0)
    rng = np.random.default_rng(seed)
    sent = Sentences.of(pa.array(texts, pa.string()))
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    used = ~check
    # features that go with the label, and smoothed log odds of their presence in a text as starting weights
    word_row = np.repeat(sent.row, np.diff(np.r_[sent.starts, sent.buckets.shape[1]]))
    has = np.zeros((2, BUCKETS + 1))
    cuts = np.searchsorted(word_row, np.arange(0, len(y) + 100, 100))
    for low, high in zip(cuts, cuts[1:]):  # texts that have a feature, by label
        for part in sent.buckets:
            row, bucket = np.divmod(np.unique(word_row[low:high] * (BUCKETS + 1) + part[low:high]), BUCKETS + 1)
            for k in (0, 1):
                has[k] += np.bincount(bucket[used[row] & (y[row] == k)], minlength=BUCKETS + 1)
    has = has[:, :BUCKETS]
    n0, n1 = float((used & (y == 0)).sum()), float((used & (y == 1)).sum())
    weights = np.log((has[1] + 0.5) / (n1 + 1)) - np.log((has[0] + 0.5 * n0 / max(n1, 1)) / (n0 + 1))
    told = _association(has[1], has[0], n1, n0) >= ASSOCIATION
    allowed = np.append(told, False)
    weights, bias = np.where(told, weights, 0.0), -2.0
    lens = np.diff(np.r_[sent.starts, sent.buckets.shape[1]])
    terms = _term_buckets(list(IDENTITY_TERMS))
    term_of = {int(b): i for i, b in enumerate(terms[0])}
    for _ in range(ROUNDS):
        logits = sent.logits(weights, bias)
        top = sent.highest(logits, bias)
        witness = logits >= top[sent.row]
        chosen = used[sent.row] & np.where(y[sent.row] == 1, witness | (logits > 0), witness | (rng.random(len(logits)) < 0.1))
        picked = np.flatnonzero(chosen)
        index = np.concatenate([np.arange(a, a + n) for a, n in zip(sent.starts[picked], lens[picked])])
        example = np.repeat(np.arange(len(picked)), lens[picked])
        target = y[sent.row[picked]]
        balance = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(target)
        own = np.full(len(picked), -1)  # identity term of the sentence, if it has one
        known = np.array([term_of.get(int(b), -1) for b in sent.buckets[0][index]])
        np.maximum.at(own, example, known)
        features, place = sent.buckets[:, index], np.tile(example, len(sent.buckets))
        # identity terms may get weights too, which the penalty then takes away
        open_ = allowed.copy()
        open_[terms.ravel()] = True
        open_[BUCKETS] = False
        grad_w, grad_b = np.full(BUCKETS + 1, 1e-6), 1e-6
        full = np.append(weights, 0.0)
        for _ in range(STEPS):
            swap = rng.integers(0, len(IDENTITY_TERMS), len(picked))
            score = np.bincount(place, full[features].ravel(), minlength=len(picked)) + bias
            there = np.where(own >= 0, full[terms[:, own]].sum(axis=0), 0.0)
            change = full[terms[:, swap]].sum(axis=0) - there
            err = balance * (_sigmoid(score) - target) / len(picked)
            pull = 2 * COUNTERFACTUAL * change / len(picked)
            gradient = np.bincount(features.ravel(), err[place], minlength=BUCKETS + 1)
            gradient += np.bincount(terms[:, swap].ravel(), np.tile(pull, len(terms)), minlength=BUCKETS + 1)
            gradient -= np.bincount(terms[:, own].ravel(), np.tile(np.where(own >= 0, pull, 0.0), len(terms)), minlength=BUCKETS + 1)
            gradient += DECAY * full / len(picked)
            gradient[~open_] = 0.0
            grad_w += gradient**2
            grad_b += err.sum() ** 2
            full -= RATE * gradient / np.sqrt(grad_w)
            bias -= RATE * err.sum() / np.sqrt(grad_b)
        weights = full[:BUCKETS]
    weights = weights.astype(np.float32)
    held = check if min((y[check] == 1).sum(), (y[check] == 0).sum()) >= 20 else np.ones(len(y), bool)
    top = sent.highest(sent.logits(weights, bias), bias)
    slope, offset = platt(top[held], y[held])
    pa.default_memory_pool().release_unused()
    return Model(weights, float(bias), slope, offset)


def _association(in1: np.ndarray, in0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio (G squared) of presence and label, for each feature."""
    def term(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    n, seen = n1 + n0, in1 + in0
    return 2 * (term(in1, seen * n1 / n) + term(in0, seen * n0 / n) + term(n1 - in1, (n - seen) * n1 / n) + term(n0 - in0, (n - seen) * n0 / n))


def platt(logits: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through logits and labels with the least log loss, with Platt's softened
    targets; both labels count alike. A grid of slopes and middle points, so separable labels are no trouble. A logit may
    stand for *count* of its kind."""
    count = np.ones(len(y)) if count is None else count
    n1, n0 = count[y == 1].sum(), count[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = count * np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    best = (np.inf, 1.0, 0.0)
    for middle in np.unique(np.r_[np.quantile(logits, np.linspace(0, 1, 61)), np.linspace(logits.min(), logits.max(), 61)]):
        for slope in np.geomspace(0.05, 4, 16):
            x = slope * (logits - middle)
            loss = float((weight * (np.logaddexp(0, -x) * target + np.logaddexp(0, x) * (1 - target))).sum())
            best = min(best, (loss, float(slope), float(-slope * middle)))
    return best[1], best[2]


def held_out(id_column: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves no rest when divided by 5."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          max_train: int = MAX_TRAIN) -> Model:
    """A model of at most *max_train* texts of each label, rows of :func:`held_out` left out.

    Of repeated labels of one id the largest counts; ids without a text and labels that are neither 0 nor 1 take no part.
    """
    marks = labels.filter(F.col(f"`{label_column}`").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max(f"`{label_column}`").cast("int").alias("__label"))
    own = F.col(f"`{id_column}`")
    ids = docs.filter(~held_out(own) & F.col(f"`{text_column}`").isNotNull()).select(own)
    chosen = labelled_sample(ids.join(marks, own == F.col("__id")), docs, id_column, text_column, F.col("__label"), max_train)
    order = np.random.default_rng(11).permutation(len(chosen))
    return fit([chosen[i][0] for i in order], [chosen[i][1] for i in order])


def score(docs: DataFrame, model: Model, text_column: str = "text", into: str = "score", keep_text: bool = True) -> DataFrame:
    """*docs* and *into*, the probability (0 to 1) that a text is toxic; null and empty texts have that of no words.

    The whole text is read; repeated rows stay; a column named *into* is replaced. Only the model's table of fixed length
    goes to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> dict:
        m = shared.value
        sent = Sentences(texts)
        top = sent.highest(sent.logits(m.weights, m.bias), m.bias)
        return {into: _sigmoid(m.slope * top + m.offset)}

    return map_texts(docs.drop(into), run, f"`{into}` double", text_column, keep_text)
