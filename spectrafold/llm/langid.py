"""Language identification: averaged hashed subword embeddings with a linear softmax, and a calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.llm.batches import BYTE_VALUES, WORD_BYTES, flat, map_texts, mix, powers
from spectrafold.llm.samples import labelled_sample

#: Subwords are the 1 to 4 bytes from each byte on, of lower-cased text in which what isn't part of a word is a blank.
LENGTHS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 15, 16
#: Texts that the model is fitted on: at most this many of each language.
MAX_TRAIN = 1500
EPOCHS, BATCH, RATE, SNIPPET = 6, 64, 2.0, 240
#: Share of held-in texts of known languages that the rejection may lose.
REJECTED = 0.01
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray = field(repr=False)  # (BUCKETS + 1, languages): embeddings times the softmax matrix; the last row is zero
    bias: np.ndarray
    temperature: float
    least: float  # texts with a lower calibrated score are rejected


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets: (lengths, bytes), offsets): the subwords that start at each byte; BUCKETS where one would leave its row."""
    data, offsets = flat(pc.utf8_lower(texts))
    data = np.where(WORD_BYTES[data], data, 0x20).astype(np.uint8)
    n, base = len(data), powers(max(LENGTHS))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    out, running = np.full((len(LENGTHS), n), BUCKETS, np.int32), np.zeros(n, np.uint64)
    values = BYTE_VALUES[data]
    for k, length in enumerate(LENGTHS):
        running[:max(0, n - k)] += values[k:] * base[k]
        out[k] = np.where(room >= length, (mix(running + np.uint64(length)) & np.uint64(BUCKETS - 1)).astype(np.int32), BUCKETS)
    # a lone blank or a run of blanks says nothing
    blank = data == 0x20
    out[0][blank] = BUCKETS
    return out, offsets


def _means(table: np.ndarray, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over the subwords of each text; zero where there is none."""
    rows, full = len(offsets) - 1, offsets[1:] > offsets[:-1]
    total, count = np.zeros((rows, table.shape[1])), np.zeros(rows)
    if full.any():
        first = offsets[:-1][full]
        for part in buckets:
            total[full] += np.add.reduceat(table[part], first, axis=0)
            count[full] += np.add.reduceat((part < BUCKETS).astype(np.int64), first)
    return total / np.maximum(count, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippets(text: str, rng: np.random.Generator) -> str:
    size = int(rng.integers(20, SNIPPET))
    at = int(rng.integers(0, max(1, len(text) - size)))
    return text[at:at + size]


def fit(texts: list[str], languages: list[str], seed: int = 3) -> Model:
    """Stochastic gradient descent on the log loss of snippets of the texts, new ones each epoch, so short texts count too.

    A tenth of the texts sets the temperature of the softmax and the score below which a text is rejected. Without texts
    there is no language; with one language all texts have it.
    """
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS + 1, max(1, len(names))), np.float32), np.zeros(max(1, len(names))), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in languages])
    check = np.arange(len(y)) % 10 == 9 if len(y) >= 100 else np.zeros(len(y), bool)
    used = np.flatnonzero(~check)
    embed = np.vstack([rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH, np.zeros((1, WIDTH))])
    heads, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    steps, done = EPOCHS * -(-len(used) // BATCH), 0
    weight = len(used) / (len(names) * np.maximum(1, np.bincount(y[used], minlength=len(names))))
    for _ in range(EPOCHS):
        order = rng.permutation(used)
        for low in range(0, len(order), BATCH):
            rows = order[low:low + BATCH]
            buckets, offsets = subwords(pa.array([_snippets(texts[i], rng) for i in rows], pa.string()))
            hidden = _means(embed, buckets, offsets)
            error = _softmax(hidden @ heads + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[y[rows]][:, None] / len(rows)
            rate, done = RATE * (1 - done / steps), done + 1
            back = error @ heads.T
            heads -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            size = np.maximum(1, np.add.reduceat((buckets < BUCKETS).sum(axis=0), np.minimum(offsets[:-1], buckets.shape[1] - 1)) if buckets.shape[1] else np.ones(len(rows)))
            push = np.repeat(back / size[:, None], np.diff(offsets), axis=0)
            for part in buckets:
                # the mean's gradient is shared by all its subwords; its length makes up for their number
                np.add.at(embed, part, -rate * len(rows) * push)
            embed[BUCKETS] = 0.0
    table = (embed @ heads).astype(np.float32)
    held = np.flatnonzero(check) if check.any() else used
    temperature, least = _calibrate(table, bias, [_snippets(texts[i], rng) for i in held], y[held])
    return Model(names, table, bias, temperature, least)


def _calibrate(table: np.ndarray, bias: np.ndarray, texts: list[str], y: np.ndarray) -> tuple[float, float]:
    logits = _means(table, *subwords(pa.array(texts, pa.string()))) + bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    return best, float(np.quantile(_softmax(logits / best).max(axis=1), REJECTED))


def held_out(id_column: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """A model of at most *max_train* texts with a letter of each language; rows of :func:`held_out` are left out."""
    rows = docs.filter(~held_out(F.col(f"`{id_column}`")) & has_letter(F.col(f"`{text_column}`")))
    found = labelled_sample(rows, rows, id_column, text_column, F.col(f"`{lang_column}`").cast("string"), max_train)
    order = np.random.default_rng(11).permutation(len(found))
    return fit([found[i][0] for i in order], [found[i][1] for i in order])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The columns of *docs* but the text, with lang_pred, score (calibrated, 0 to 1) and rejected.

    Null texts, texts without a letter, and all texts if no language was learned, are "und" with score 0 and rejected. A
    rejected text is one that scores lower than all but REJECTED of known texts; it still names the likeliest language.
    The whole text is read; repeated rows stay; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected").withColumn("__letter", has_letter(F.col(f"`{text_column}`")))

    def run(texts: pa.Array) -> dict:
        m = shared.value
        p = _softmax((_means(m.table, *subwords(texts)) + m.bias) / m.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        names = m.languages or [None]
        return {"lang_pred": pa.array([names[i] for i in best], pa.string()), "score": score, "rejected": score < m.least}

    out = map_texts(docs, run, "lang_pred string, score double, rejected boolean", text_column)
    known = F.col("__letter") & F.col("lang_pred").isNotNull()
    return out.withColumns({
        "lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(known, F.col("score")).otherwise(0.0),
        "rejected": F.when(known, F.col("rejected")).otherwise(True)}).drop("__letter")
