"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the mean, over gram lengths, of the cosine of their presence vectors of letter n-grams.
A bounded sample of labelled texts gives landmarks; Nystroem features of the sample and one-versus-rest ridge
regression on them are solved in numpy on the driver. A text's decision values are its kernel row against the
landmarks times the regression weights. As the kernel is linear in the presence vectors, landmarks and weights are
multiplied once, and a batch of texts is scored by one matrix product per gram length.

What is bounded: ``train_rows`` labelled texts are fitted (those with the smallest hash of doc_id and text, whole
texts) and ``landmarks`` of them are landmarks. Everything is scored, whole texts included.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; so is every text where there is no
labelled row. Grams that no landmark has count for nothing. Ties go to the label that sorts first. Rows are scored one
by one, so repeated rows agree; a NULL doc_id is held out. Columns besides text (and doc_id, lang for fitting) are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import bounded_batches, worker_state

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 18
PIECE = 500_000
#: Odd multipliers of the gram hash.
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
TABLE = 0x3000


def letter_table() -> np.ndarray:
    """Lower-case code of each letter below U+3000, a space for everything else."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(TABLE)], dtype=np.uint32)


def grams(texts: list[str], letters: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, (row, hashed gram) of every gram of ``texts``; and whether a text has a letter."""
    # a text stands between zeros and spaces; no gram reaches over a zero
    codes = np.frombuffer(("\0 " + " \0 ".join(t.replace("\0", " ") for t in texts) + " \0").encode("utf-32-le", "replace"), "<u4")
    low = letters[np.minimum(codes, TABLE - 1)]
    for i in np.flatnonzero(codes >= TABLE):
        low[i] = ord(c.lower()[0]) if (c := chr(codes[i])).isalpha() else 32
    wall = codes == 0
    low[wall] = 0
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low, wall = low[keep], wall[keep]
    rows = (np.cumsum(wall) - 1).astype(np.int32)
    has = np.bincount(rows[low > 32], minlength=len(texts))[:len(texts)] > 0
    out = {}
    for n in ORDERS:
        size = max(len(low) - n + 1, 0)
        value, clear = np.zeros(size, np.uint32), np.ones(size, bool)
        for k in range(n):
            value += low[k:k + size] * FACTORS[k]
            clear &= ~wall[k:k + size]
        value ^= value >> np.uint32(15)
        value *= np.uint32(2246822519)
        out[n] = rows[:size][clear], (value >> np.uint32(32 - BITS))[clear]
    return out, has


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts in batches of about PIECE characters; a longer text comes in several pieces."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            part = text[max(at - max(ORDERS) + 1, 0):at + PIECE]
            if rows and (size + len(part) > PIECE or len(rows) >= 256):
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


@dataclass
class Model:
    labels: list[str]
    columns: dict[int, np.ndarray]  # per order: hashed gram -> column, or -1
    weights: dict[int, np.ndarray]  # per order: column x label

    def presence(self, texts: list[str], letters: np.ndarray) -> Iterator[tuple[int, int, dict[int, np.ndarray], np.ndarray]]:
        """Batches (first row, end, presence matrix per order, has a letter); a text is never split over batches."""
        held: dict[int, np.ndarray] | None = None
        lo = hi = 0
        has = np.zeros(0, bool)
        for rows, parts in pieces(texts):
            found, letter = grams(parts, letters)
            index = np.array(rows)
            if held is not None and index[0] >= hi:
                yield lo, hi, held, has
                held = None
            if held is None:
                lo, hi = index[0], index[0]
                held, has = {n: np.zeros((0, int(c.max()) + 1), np.float32) for n, c in self.columns.items()}, np.zeros(0, bool)
            grow = index[-1] + 1 - hi
            hi = index[-1] + 1
            has = np.concatenate([has, np.zeros(grow, bool)])
            np.logical_or.at(has, index - lo, letter)
            for n, (row, gram) in found.items():
                held[n] = np.concatenate([held[n], np.zeros((grow, held[n].shape[1]), np.float32)])
                column = self.columns[n][gram]
                ok = column >= 0
                held[n][index[row[ok]] - lo, column[ok]] = 1
        if held is not None:
            yield lo, hi, held, has

    def decide(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decision values (text x label), and whether a text has a letter."""
        values, has = np.zeros((len(texts), len(self.labels)), np.float32), np.zeros(len(texts), bool)
        for lo, hi, matrix, letter in self.presence(texts, letters):
            has[lo:hi] = letter
            for n, x in matrix.items():
                norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                values[lo:hi] += x @ self.weights[n] / norm
        return values, has


def fit(texts: list[str], labels: list[str], landmarks: int = 240, ridge: float = 1e-3) -> Model:
    """Nystroem features from ``landmarks`` texts, taken from the labels in turn, and one-versus-rest ridge weights."""
    names, letters = sorted(set(labels)), letter_table()
    turns: dict[str, int] = {}
    order = []
    for i, label in enumerate(labels):
        turns[label] = turns.get(label, -1) + 1
        order.append((turns[label], label, i))
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    marks = [texts[i] for i in chosen]
    seen = {n: np.zeros(1 << BITS, bool) for n in ORDERS}
    for _, parts in pieces(marks):
        for n, (_, gram) in grams(parts, letters)[0].items():
            seen[n][gram] = True
    columns = {n: np.where(s, np.cumsum(s) - 1, -1).astype(np.int32) for n, s in seen.items()}
    model = Model(names, columns, {})

    def unit(batch: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {n: x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) for n, x in batch.items()}

    stacks: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
    for _, _, matrix, _ in model.presence(marks, letters):
        for n, x in unit(matrix).items():
            stacks[n].append(x)
    base = {n: np.concatenate(s) for n, s in stacks.items()}
    kernel = np.concatenate([sum(x @ base[n].T for n, x in unit(m).items()) / len(ORDERS)
                             for _, _, m, _ in model.presence(texts, letters)]).astype(float)
    vectors, power = _half(kernel[chosen])
    features = kernel @ vectors * power
    target = (np.array(labels)[:, None] == np.array(names)[None, :]).astype(float)
    weight = 1 / np.maximum(target.sum(axis=0), 1) @ target.T  # every label weighs the same
    scaled = features * weight[:, None]
    solved = np.linalg.solve(scaled.T @ features + ridge * np.eye(features.shape[1]), scaled.T @ target)
    alpha = (vectors * power) @ solved / len(ORDERS)
    model.weights = {n: (x.T @ alpha).astype(np.float32) for n, x in base.items()}
    return model


def _half(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors of the landmark kernel and the inverse roots of its eigenvalues; near-zero directions are left out."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    power = np.where(values > values.max() * 1e-7, 1 / np.sqrt(np.maximum(values, 1e-12)), 0)
    return vectors, power


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, train_rows: int = 2000, landmarks: int = 240) -> Model | None:
    """Fit on the labelled rows that are not held out; None where there is none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text", "lang")
    last = usable.select("h").orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = usable.where(F.col("h") <= last).orderBy("h", "doc_id").limit(train_rows).select("text", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks)


def predict(text: Column, model: Model | None) -> Column:
    """A struct of ``lang_pred`` and ``score``, the winning decision value cut to 0..1."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def batches(texts):
        letters = worker_state("letters", letter_table)
        for series in texts:
            values, has = model.decide(list(series), letters)
            best = values.argmax(axis=1)
            score = np.where(has, np.clip(values[np.arange(len(best)), best], 0, 1), 0).astype(float)
            yield pd.DataFrame({"lang_pred": np.where(has, np.array(model.labels, dtype=object)[best], UNKNOWN), "score": score})

    batches.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, "lang_pred string, score double")(F.coalesce(text, F.lit("")))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
