"""Language of whole texts: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 3- and 4-grams inside words, with the spaces around a word as its boundary marks.
Each hashes to one of a fixed number of embedding rows; a text is the mean of its rows. Embeddings and
softmax are fitted by stochastic gradient descent on a bounded sample of labelled rows: ``max_rows`` in
all, and ``least_rows`` of every language where it has so many, so that a rare language is learned at any
size of the table. A part of them sets a temperature for the probabilities and the score below which a
text is rejected.
After fitting, embeddings and softmax fold into one table of logits per subword row, so predicting is
a mean of table rows over the whole text, inside the tasks that read it.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; with
no labelled row at all, every text is; ties go to the first label in code-point order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulcast.llm.texthash import BLOCK_BYTES, blocks, text_bytes

ROWS = 1 << 16  # embedding rows
DIMENSIONS = 16
MAX_ROWS = 4000  # labelled documents that the model is fitted on
LEAST_ROWS = 200  # labelled documents of each language that are drawn besides
LETTER = r"\p{L}"
UNKNOWN = "und"


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # logits per subword row and label
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def subwords(data: np.ndarray, edges: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the subwords of consecutive texts and the text of each, text by text; of those that begin in the first ``starts`` bytes."""
    n = len(data)
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[[*range(0x09, 0x0E)]] = 0x20
    byte = fold[data]
    space = byte == 0x20
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    rows, owners = [], []
    for size in (3, 4):
        m = n - size + 1 if starts is None else min(starts, n - size + 1)
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint32)
        inside = text[:m] == text[size - 1 : m + size - 1]
        for k in range(size):
            code = code * np.uint32(257) + byte[k : k + m]
            if 0 < k < size - 1:
                inside &= ~space[k : k + m]
        code = (code + np.uint32(size)) * np.uint32(2654435761)
        rows.append((code >> np.uint32(16))[inside])
        owners.append(text[:m][inside])
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


def _counts(batches):
    """Subword rows and shares of every text, for fitting."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows, shares = [], []
        for k in range(batch.num_rows):
            ids, _ = subwords(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
            unique, count = np.unique(ids, return_counts=True)
            rows.append(unique.astype("<u2").tobytes())
            shares.append((count / max(1, len(ids))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary()), pa.array(shares, pa.binary())], ["lang", "rows", "shares"])


def _softmax_sgd(samples, n_labels: int, epochs: int, rate: float, seed: int):
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (ROWS, DIMENSIONS))
    weight = np.zeros((DIMENSIONS, n_labels))
    bias = np.zeros(n_labels)
    steps, total = 0, max(1, epochs * len(samples))
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            label, rows, shares = samples[k]
            step = rate * (1 - steps / total)
            steps += 1
            mean = shares @ embed[rows]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weight @ p
            weight -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embed[rows] -= step * len(rows) * shares[:, None] * back / 50
    return embed, weight, bias


def fit(
    docs: DataFrame, train: Column, max_rows: int = MAX_ROWS, epochs: int = 8, rate: float = 2.0, rejected: float = 0.002, seed: int = 5, least_rows: int = LEAST_ROWS
) -> LanguageModel:
    """Fit on rows where ``train`` holds and lang is known; about ``max_rows`` in all and ``least_rows`` of each lang, chosen by hash.

    Equal texts of one lang count once. ``rejected`` is the share of rightly labelled calibration texts
    that the rejection may cost.
    """
    known = docs.filter(train & F.col("lang").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string"), "text")
    sizes = known.groupBy("lang").count().collect()  # one row per language, as the model has one column each
    rows = sum(n for _, n in sizes)
    cuts = [F.lit(x) for lang, n in sizes for x in (lang, int((1 << 30) * min(1.0, max_rows / rows + least_rows / n)))]
    cut = F.create_map(*cuts)[F.col("lang")] if cuts else F.lit(0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    sample = known.filter(draw < cut).filter(F.col("text").rlike(LETTER)).select("lang", "text").dropDuplicates()
    found = sample.mapInArrow(_counts, "lang string, rows binary, shares binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["rows"]), bytes(r["shares"])))
    labels = sorted({r["lang"] for r in found})
    samples = [(labels.index(r["lang"]), np.frombuffer(r["rows"], "<u2"), np.frombuffer(r["shares"], "<f4").astype(float)) for r in found]
    held = [s for k, s in enumerate(samples) if k % 5 == 0]
    fitted = [s for k, s in enumerate(samples) if k % 5] or held
    embed, weight, bias = _softmax_sgd(fitted, len(labels), epochs, rate, seed)
    model = LanguageModel(labels, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    if held:
        logits = np.array([s @ model.table[r] for _, r, s in held])
        truth = np.array([label for label, _, _ in held])
        grid = np.geomspace(0.25, 4, 33)

        def loss(t):
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = float(min(grid, key=loss))
        p = model.probabilities(logits)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        # never reject a text whose label has more than half of the probability
        model.reject_below = float(min(0.5, np.quantile(right, rejected))) if len(right) else 0.0
    return model


def _scores(model: LanguageModel, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Best label and its probability for every text of a batch."""
    data, offsets = text_bytes(batch.column("text"))
    sums = np.zeros((batch.num_rows, len(model.labels) + 1))  # logits and, last, subwords
    for i, j in blocks(offsets):
        alone = j == i + 1
        for at in range(offsets[i], offsets[j], BLOCK_BYTES) if alone else [offsets[i]]:
            # a long text is read in pieces; each gives the subwords that begin in it
            to = min(offsets[j], at + BLOCK_BYTES + 3) if alone else offsets[j]
            edges = np.array([0, to - at]) if alone else offsets[i : j + 1] - at
            rows, owner = subwords(data[at:to], edges, BLOCK_BYTES if alone else None)
            sums[i:j, -1] += np.bincount(owner, minlength=j - i)
            for c in range(len(model.labels)):
                sums[i:j, c] += np.bincount(owner, weights=model.table[rows, c], minlength=j - i)
    logits = sums[:, :-1] / np.maximum(1, sums[:, -1:])
    p = model.probabilities(logits)
    return p.argmax(axis=1), p.max(axis=1)


def _answers(model: LanguageModel, batch: pa.RecordBatch, letter: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    letter = letter.to_numpy(zero_copy_only=False).astype(bool) & bool(model.labels)
    if not model.labels:
        best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
    else:
        best, score = _scores(model, batch)
    names = pa.array([model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letter)], pa.string())
    return names, pa.array(np.where(letter, score, 0.0)), pa.array(~letter | (score < model.reject_below))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected."""

    def run(batches):
        for batch in batches:
            columns = _answers(model, batch, batch.column("letter"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows that the model rejects; rows keep all their columns."""

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            kept = pc.invert(_answers(model, texts, batch.column("letter"))[2])
            yield pa.RecordBatch.from_arrays([row.filter(kept)], ["row"])

    letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letter")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), letter)
    out = T.StructType([T.StructField("row", docs.select(F.struct("*").alias("row")).schema["row"].dataType)])
    return rows.mapInArrow(run, out).select("row.*")
