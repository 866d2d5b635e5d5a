"""Language identification with a string kernel.

Two texts are as alike as the character n-grams (one to three, of letters and
word edges) that both have: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), the
normalised blended spectrum kernel on presence.  A few training texts of every
language are landmarks; a text's Nystroem features are its kernel values against
them times the inverse square root of the landmarks' own kernel matrix.  Kernel
ridge regression on these features, one target column per language, is the
classifier: the highest column wins, ties go to the first language by name.

Everything is scored in batches: a 0/1 matrix of texts by n-grams times one of
n-grams by landmarks gives all kernel values, two small products the scores.

Training is bounded whatever the size of the table: `LANDMARKS` landmarks and
`TRAIN_ROWS` rows in all, in equal parts by language (of the `LANGUAGES` most
frequent ones), chosen by the digest of the id among texts of at most
`TRAIN_CHARS` characters that have a letter; a language of longer texts only is
not learned.  The kernel counts the `FEATURES` n-grams that most landmarks have.
The normal equations are summed over the training rows in Spark, a matrix of
landmarks by landmarks per task.  Prediction reads every text whole, in blocks.

Defined results: a null text, or one without a letter, is `und` with score 0; rows
with a null id are predicted, never held out and never learned from; with nothing
to learn from every row is `und`; equal texts get equal results; an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import chunks, stored

LANDMARKS = 128
TRAIN_ROWS = 2048
TRAIN_CHARS = 50_000
LANGUAGES = 64
FEATURES = 32_768
RIDGE = 1e-3  # of the mean diagonal of the normal equations
FLOOR = 1e-6  # of the largest eigenvalue of the landmarks' kernel matrix
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

BLOCK = 1 << 20  # code points at a time
MATRIX_ROWS = 256  # texts in one matrix
WORD = re.compile(r"[^\W\d_]+")
POINT_BITS = 21


def grams(text: str | None) -> np.ndarray:
    """Distinct n-grams of one to three of a text's lower-cased words, with a blank at each edge, as numbers."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) <= BLOCK:
        words = letters(WORD.findall(text.lower()))
        return _numbers(words) if words else np.empty(0, np.uint64)
    found, words, size = [], [], 0
    for word in (w for match in WORD.finditer(text) for w in letters([match.group().lower()])):
        while len(word) > BLOCK:  # cut with two characters in common, so that no n-gram is lost
            found.append(_numbers([word[:BLOCK]]))
            word = word[BLOCK - 2 :]
        words.append(word)
        size += len(word) + 1
        if size > BLOCK:
            found.append(_numbers(words))
            words, size = [], 0
    if words:
        found.append(_numbers(words))
    return pd.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def letters(words: list[str]) -> list[str]:
    """The words without the characters of numbers that Python's patterns count as letters."""
    if "".join(words).isalpha():
        return words
    return [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]


def _numbers(words: list[str]) -> np.ndarray:
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    pairs = points[:-1] << np.uint64(POINT_BITS) | points[1:]
    triples = pairs[:-1] << np.uint64(POINT_BITS) | points[2:]
    # A blank alone says nothing, and one number never stands for n-grams of two lengths: none holds a null.
    return pd.unique(np.concatenate([points[points != 0x20], pairs, triples]))


@dataclass
class Kernel:
    """Landmarks as a matrix of n-grams by landmarks, and what maps kernel values to scores."""

    features: np.ndarray  # sorted n-grams
    presence: np.ndarray  # float32 (features, landmarks)
    sizes: np.ndarray  # n-grams of each landmark
    whiten: np.ndarray  # inverse square root of the landmarks' kernel matrix
    weights: np.ndarray | None = None  # (landmarks, languages)
    languages: tuple[str, ...] = ()

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> "Kernel":
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        if len(every) > FEATURES:
            often = np.lexsort((every, -counts))[:FEATURES]
            every = np.sort(every[often])
        presence = np.zeros((len(every), len(sets)), np.float32)
        for column, own in enumerate(sets):
            presence[_positions(every, own), column] = 1
        kernel = cls(every, presence, presence.sum(axis=0), np.empty((0, 0)))
        values, vectors = np.linalg.eigh(kernel.values(sets).astype(np.float64))
        values = np.maximum(values, values.max() * FLOOR)
        kernel.whiten = (vectors / np.sqrt(values)) @ vectors.T
        return kernel

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values (texts, landmarks)."""
        texts = np.zeros((len(sets), len(self.features)), np.float32)
        for row, own in enumerate(sets):
            texts[row, _positions(self.features, own)] = 1
        sizes = np.maximum(texts.sum(axis=1), 1)
        return (texts @ self.presence) / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def mapped(self, sets: list[np.ndarray]) -> np.ndarray:
        """Nystroem features (texts, landmarks)."""
        return self.values(sets).astype(np.float64) @ self.whiten

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.mapped(sets) @ self.weights


def _positions(features: np.ndarray, own: np.ndarray) -> np.ndarray:
    at = np.searchsorted(features, own)
    at[at == len(features)] = 0
    return at[features[at] == own] if len(features) else at[:0]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def training_rows(docs: DataFrame, rows: int) -> DataFrame:
    """lang, rank, text: up to rows / languages rows of each language, by the digest of id and text.

    A first scan counts the rows of each language, and a second one takes those
    below a digest that leaves about four times the rows wanted.
    """
    usable = (F.length("text") <= TRAIN_CHARS) & F.col("text").rlike(r"\p{L}")
    learned = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT) & usable)
    counts = learned.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang STRING, rank INT, text STRING")
    share = max(rows // len(counts), 1)
    parts = [(row.lang, min((4 * share + 64) / row.n, 1.0)) for row in counts]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang STRING, part DOUBLE"))
    order = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("order")
    near = learned.select("lang", "text", order).join(wanted, "lang")
    near = near.where(F.pmod("order", F.lit(1 << 30)) < F.col("part") * (1 << 30)).drop("part")
    kept = stored(near, "language-sample")
    numbers = kept.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set("order")), 1, share).alias("orders"))
    ranked = F.broadcast(numbers.select("lang", F.posexplode("orders").alias("rank", "order")))
    return kept.join(ranked, ["lang", "order"]).dropDuplicates(["lang", "rank"]).select("lang", "rank", "text")


def train(docs: DataFrame, landmarks: int = LANDMARKS, rows: int = TRAIN_ROWS) -> Kernel | None:
    """The classifier, or None if there is nothing to learn from."""
    sample = stored(training_rows(docs, rows), "language-training")
    languages = tuple(sorted(row.lang for row in sample.select("lang").distinct().collect()))
    if not languages:
        return None
    share = max(landmarks // len(languages), 1)
    chosen = sample.where(F.col("rank") < share).orderBy("lang", "rank").toArrow()
    kernel = Kernel.of([grams(text) for text in chosen["text"].to_pylist()])
    spark, m, n = docs.sparkSession, len(kernel.sizes), len(languages)
    shipped = spark.sparkContext.broadcast(kernel)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total = shipped.value, np.zeros((m, m + n))
        for batch in batches:
            for part in _matrices(batch):
                x = kernel.mapped([grams(text) for text in part.column("text").to_pylist()])
                y = np.array([[lang == one for one in languages] for lang in part.column("lang").to_pylist()], float)
                total += x.T @ np.hstack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    sums = sample.select("lang", "text").mapInArrow(normal_equations, "sums BINARY").toArrow()
    total = sum(np.frombuffer(one, float).reshape(m, m + n) for one in sums["sums"].to_pylist())
    shipped.destroy()
    gram, target = total[:, :m], total[:, m:]
    kernel.weights = np.linalg.solve(gram + np.eye(m) * RIDGE * np.trace(gram) / m, target)
    kernel.languages = languages
    return kernel


def _matrices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few enough rows and bytes of text for one matrix."""
    for part in chunks(batch, "text"):
        for start in range(0, part.num_rows, MATRIX_ROWS):
            yield part.slice(start, MATRIX_ROWS)


def scored(kernel: Kernel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    languages, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    sets = [grams(text) for text in texts]
    rows = [i for i, own in enumerate(sets) if len(own)]
    if kernel is not None and rows:
        found = kernel.scores([sets[i] for i in rows])
        best = found.argmax(axis=1)
        for i, at in zip(rows, best.tolist()):
            languages[i] = kernel.languages[at]
        score[rows] = np.clip(found[np.arange(len(rows)), best], 0, 1)
    return languages, score


def predict(docs: DataFrame, kernel: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shipped: Broadcast = docs.sparkSession.sparkContext.broadcast(kernel)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _matrices(batch):
                languages, score = scored(shipped.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(languages, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    id_type = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(work, f"doc_id {id_type}, lang_pred STRING, score DOUBLE")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    predicted = predict(docs, train(docs))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
