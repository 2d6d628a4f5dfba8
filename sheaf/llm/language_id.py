"""Language identification by nearest centroids of TF-IDF vectors of character n-grams.

A text's vector counts its byte n-grams of two and three bytes, lower-cased, without digits and ASCII punctuation, hashed to DIMENSIONS
cells; counts are damped by a square root, weighted by inverse document frequencies over all learning texts, and
normalised. Each language has several centroids, clustered from a bounded sample of its texts by spherical k-means; the
nearest centroid by cosine names the language. A text whose nearest centroid is farther than nearly all of that
language's sample is marked as rejected.

The sample has about SAMPLE different texts of each language, or all if there are fewer, chosen by a hash of the text;
copies count once, so a language that is mostly copies of a few texts keeps them. Frequencies cover all learning texts. What
is held of a language has a fixed size: sampled texts become vectors before they meet in one group, and CENTROIDS vectors of
DIMENSIONS floats go to the driver and to every worker.

Defined results. A text that is null or has no letter gets `und` with score 0 and is rejected, as does every text if there
is nothing to learn from. Repeated rows give equal rows; an identifier that is no number becomes null. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written

DIMENSIONS = 4096
#: Texts of each language from which centroids are clustered, centroids of a language, and rounds of k-means.
SAMPLE, CENTROIDS, ROUNDS = 1000, 4, 12
#: Share of a language's sample that may lie beyond the distance of rejection.
BEYOND = 0.002
#: Sharpness of the score: the weight of the best language among all, by cosine.
SHARPNESS = 25.0

_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPACES = re.compile(rb" +")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """Damped counts of hashed n-grams."""
    raw = _SPACES.sub(b" ", b" " + text.lower().encode().translate(_TABLE) + b" ")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    cells = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(20)
    return np.sqrt(np.bincount(cells, minlength=DIMENSIONS).astype(np.float32))


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if has_letter(text := text.as_py()):
                found += counts(text) > 0
                rows += 1
    cells = np.append(np.arange(DIMENSIONS), -1)
    columns = [pa.array(cells, pa.int32()), pa.array(np.append(found, rows), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of sampled texts, in batches of a few MB."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = [counts(t.as_py()).tobytes() for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["lang", "order", "counts"])


def _clustered(idf: np.ndarray, centroids: int, rounds: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        x = _normal(np.stack([np.frombuffer(v, np.float32) for v in group["counts"]]) * idf)
        k = min(centroids, len(x))
        chosen = [0]
        while len(chosen) < k:  # farthest first
            chosen.append(int((x @ x[chosen].T).max(1).argmin()))
        c = x[chosen]
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            c = _normal(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)]))
        near = float(np.quantile((x @ c.T).max(1), BEYOND))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(c), "near": near})

    return run


class CentroidModel:
    def __init__(self, learn: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, rounds: int = ROUNDS):
        learn = learn.select(F.col("text"), F.col("lang")).filter("text is not null and lang is not null")
        cells = learn.select("text").mapInArrow(_frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        seen = {row.cell: row.n for row in cells.collect()}  # DIMENSIONS rows
        rows = seen.pop(-1, 0)
        self.idf = np.log((rows + 1) / (np.array([seen.get(i, 0) for i in range(DIMENSIONS)]) + 1)).astype(np.float32) + 1
        order = F.xxhash64("text")
        learn = learn.filter(F.col("text").rlike(r"\p{L}")).withColumn("order", order)
        sizes = F.broadcast(written(learn.groupBy("lang").agg(F.count_distinct("order").alias("size")), "language-sizes"))  # a row per language
        share = F.shiftrightunsigned("order", 11).cast("double") / float(1 << 53)
        taken = learn.join(sizes, "lang").filter(share <= F.lit(1.0 * sample) / F.col("size"))
        taken = taken.groupBy("lang", "order").agg(F.min("text").alias("text"))
        taken = taken.mapInArrow(_vectors, "lang string, order long, counts binary")
        fitted = taken.groupBy("lang").applyInPandas(_clustered(self.idf, centroids, rounds), "lang string, centroid array<float>, near double")
        found = sorted(fitted.collect(), key=lambda row: (row.lang, row.near, row.centroid))
        self.langs = [row.lang for row in found]
        self.near = np.array([row.near for row in found])
        self.centroids = np.array([row.centroid for row in found], np.float32).reshape(len(found), DIMENSIONS)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, cosine of the nearest centroid, whether it is too far)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, 0.0, True
        cosines = self.centroids @ _normal(counts(text) * self.idf)
        best = int(cosines.argmax())
        of = {}
        for lang, value in zip(self.langs, cosines, strict=True):
            of[lang] = max(of.get(lang, -1.0), float(value))
        top = of[self.langs[best]]
        score = 1 / sum(np.exp(SHARPNESS * (value - top)) for value in of.values())
        return self.langs[best], float(score), top, bool(top < self.near[best])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return run


def predict_languages(docs: DataFrame, learn: DataFrame, **parameters) -> DataFrame:
    """doc_id, lang_pred, score, cosine and rejected for every text of docs, learnt from (text, lang) of learn."""
    model = docs.sparkSession.sparkContext.broadcast(CentroidModel(learn, **parameters))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
