"""Quality classifier by Bradley-Terry pairwise ranking.

Each text becomes a vector of style features (shares of character classes and of their neighbours, word and
line statistics). From preference pairs, a document of label 1 over one of label 0, weights are learned by
logistic loss on the differences of features. The cut is the quantile of the training scores that agrees best
with their labels; a score is the logistic of the distance to the cut, shifted so that the cut is at 0.3.

The weights are fitted on the driver on at most `sample_rows` labelled rows (a bound, 12,000 as a rule, taken by
the hash of the id); all texts are scored, whole, on the executors.

Defined results: a null text counts as empty and is scored; a label row that is null, of other labels than 0 and
1, or without a document is ignored; of labels repeated for an id each counts; with no label 0 or no label 1 all
scores are 0.5; equal texts have equal scores, and a score on the cut counts as above it; rows with a null id are scored
and never learned from; repeated rows are kept; very long texts are read whole, in blocks; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, widened
from .language import held_out

SAMPLE_ROWS = 12000
PAIRS = 60000
STEPS = 300
RATE = 0.3
L2 = 1e-4
CLIP = 12
CUT = 0.3
#: Character classes: other, lower case, upper case, digit, blank, line end, then one for each of these marks.
MARKS = ".,;:!?-'\"()[]{}|*#%$&@/\\<>=+_~^`"
CLASSES = 7 + len(MARKS)
CHARS = 1 << 18

_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each code point below 0x250; those above count as lower case letters or other."""
    if not _classes:
        t = np.zeros(0x250, np.uint8)
        for i in range(0x250):
            c = chr(i)
            t[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 0
            if c in MARKS:
                t[i] = 6 + MARKS.index(c)
        _classes.append(t)
    return _classes[0]


def features(text: bytes) -> np.ndarray:
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    table = class_table()
    single, pair = np.zeros(CLASSES), np.zeros((8, 8))
    for i in range(0, len(points), CHARS):
        part = points[i : i + CHARS + 1]
        kind = np.where(part < len(table), table[np.minimum(part, len(table) - 1)], CLASSES - 1)
        single += np.bincount(kind[:CHARS], minlength=CLASSES)
        coarse = np.minimum(kind, 6).astype(np.int64)
        pair += np.bincount(coarse[:-1] * 8 + coarse[1:], minlength=64).reshape(8, 8)
    n = len(points)
    tokens = text.split()
    size = np.array([len(t) for t in tokens]) if tokens else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lower = text.lower().split()
    stats = [
        np.log1p(len(points)),
        np.log1p(len(tokens)),
        size.mean(),
        size.std(),
        np.log1p(len(tokens) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        len(set(lower)) / max(1, len(lower)) if lower else 1.0,
        np.log(len(set(lower)) / max(1, len(lower)) + 0.01) if lower else 0.0,
        max(Counter(lower).values()) / len(lower) if len(lower) > 20 else 0.05,
        np.sqrt(sum(map(eq, lower, lower[1:])) / max(1, len(lower))),
        float(np.mean(size == 1)),
        float(np.mean(size <= 3)),
        float(np.mean(size > 12)),
    ]
    shares = np.concatenate([single, pair[:7, :7].ravel()]) / (n + 20)
    return np.concatenate([np.log(shares + 1e-3), np.sqrt(shares), stats]).astype(np.float32)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        out = 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + shift, -40, 40)))
        return np.where(self.raw(x) >= self.cut, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


def fit(x: np.ndarray, label: np.ndarray) -> Ranker | None:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    rng = np.random.default_rng(11)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w, first, second = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    batch = 4000
    for step in range(1, STEPS + 1):
        at = rng.integers(0, PAIRS, batch)
        d = z[better[at]] - z[worse[at]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))[:, None]).mean(axis=0) + L2 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - RATE / np.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    grid = np.unique(np.quantile(s, np.linspace(0, 0.98, 393)))
    order = np.sort(s[good]), np.sort(s[bad])
    right = len(good) - np.searchsorted(order[0], grid) + np.searchsorted(order[1], grid)
    best = np.flatnonzero(right == right.max())
    return Ranker(mean, scale, w, float(grid[best[len(best) // 2]]))


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or b"").tolist() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    return rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<float>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranker | None:
    """Fitted on at most sample_rows of the labelled (doc_id, text) rows."""
    arrow_batches(docs.sparkSession)
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # ids first, so that few texts move; then rows, as ids may be repeated in either table
    wanted = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = _featured(docs.join(wanted, "doc_id"))
    sample = rows.orderBy(F.xxhash64("doc_id", "x"), "quality").limit(sample_rows).select("quality", "x").toPandas()
    if not len(sample):
        return None
    return fit(np.array(sample["x"].tolist(), np.float64), sample["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Ranker | None, text_col: str = "text") -> DataFrame:
    """docs with score and predicted; columns of these names in docs are replaced."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            if shared.value is None or not text:
                s = np.full(len(text), 0.5)
            else:
                s = shared.value.score(np.array([features(t) for t in text], np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, widened(docs, score="double", predicted="integer"))


def train_on_rest(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample_rows: int = SAMPLE_ROWS) -> Ranker | None:
    """The model learned from the labels of the rows that aren't held out."""
    rest = F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)
    return train(docs.select("doc_id", F.col("text").cast("string").alias("text")).where(rest), labels.select("doc_id", "quality").where(rest), sample_rows)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    model = train_on_rest(docs, labels, modulus, remainder, sample_rows)
    rows = docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score_documents(rows, model).drop("text")
