"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The most frequent tokens are classes of their own; the
others belong to a class by the hash of their last letters. P(class | history) is a softmax over hashed features of
the history: the last word, the one before, both, and the third last as a skip. P(word | class) is the add-one share
of the word's count.

Training. Counts cover all training texts. The weights are learned in rounds, each on its own slice of the training
texts: tasks start from the round's weights, make AdaGrad steps on their part, and send the change of each weight row
with its number of uses; rows are averaged by use per block in Spark, and the new weights (a fixed size) go out with
the next round. Every training text is used in one round. As tasks make their own steps between two averages, weights,
and with them scores, depend a little on how the rows lie in partitions; counts and base scores don't.

Scoring. Texts are scored in numpy batches. The counts of the TOP most frequent words, a bound on what is sent to the
tasks, are looked up there; all other words go through a join with the table of counts, so the result is exact.

Defined results: a null text counts as empty and has the end token alone; a row with a null id is scored and not held
out; repeated rows are scored, and counted, one by one, and equal texts score alike; of equally frequent words the first in
byte order is a class of its own; very long texts are read whole; without training texts every token is unknown; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, texts, through_disk, words
from .language import held_out

END = b"\n"
SINGLES = 15
SUFFIXES = 24
CLASSES = SINGLES + 1 + SUFFIXES
#: Rows of the weight table for each kind of feature: bias, last, second last, both, third last.
ROWS = (1, 4096, 2048, 8192, 2048)
STARTS = np.cumsum([0, *ROWS])
BLOCK_ROWS = 256
TOP = 100_000
COUNT_BINS = 1024
ROUNDS = 3
RATES = (0.25, 0.12, 0.06)
STEP_TOKENS = 32768
CACHE = 150_000
FLUSH = 400_000
TRIM = b",.;:!?\"'()"


class _Codes(dict):
    """word -> hash << 8 | class, remembered."""

    def __init__(self, singles: dict[bytes, int]) -> None:
        super().__init__()
        self.singles = singles

    def __missing__(self, word: bytes) -> int:
        k = SINGLES if word == END else self.singles.get(word, -1)
        if k < 0:
            k = SINGLES + 1 + zlib.crc32((word.rstrip(TRIM) or word)[-2:]) % SUFFIXES
        code = zlib.crc32(word) << 8 | k
        if len(self) >= CACHE:
            self.clear()
        self[word] = code
        return code


class _Logs(dict):
    """word -> log10 of its count and one, -1 for a word that isn't among the most frequent."""

    def __init__(self, top: dict[bytes, int]) -> None:
        super().__init__((w, float(np.log10(c + 1))) for w, c in top.items())

    def __missing__(self, word: bytes) -> float:
        return -1.0


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    h = (x * np.uint64(0x9E3779B97F4A7C15)) ^ y
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def encoded(flat: list[bytes], size: np.ndarray, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Of texts' tokens one after another, `size` of each text, the end token last: feature rows (n, 5) and classes (n)."""
    code = np.fromiter(map(codes.__getitem__, flat), np.uint64, len(flat))
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    word = (code >> np.uint64(8)) + np.uint64(2)
    back = []
    for lag in (1, 2, 3):
        w = np.ones(len(code), np.uint64)
        if len(code) > lag:
            np.copyto(w[lag:], word[:-lag], where=place[lag:] >= lag)
        back.append(w)
    rows = np.zeros((len(ROWS), len(code)), np.int32)  # the first kind, the bias, is row 0
    for k, h in enumerate((_mix(back[0], np.uint64(1)), _mix(back[1], np.uint64(2)), _mix(back[0], _mix(back[1], np.uint64(3))), _mix(back[2], np.uint64(4))), 1):
        rows[k] = (h & np.uint64(ROWS[k] - 1)).astype(np.int32)
        rows[k] += STARTS[k]
    return rows.T, (code & np.uint64(255)).astype(np.intp)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(weights, rows[:, 1], axis=0)
    for k in range(2, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    z += weights[0]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> np.ndarray:
    """One AdaGrad step on some tokens, in place; the number of uses of each row. squares: (classes, rows)."""
    g = np.exp(log_softmax(weights, rows))
    g[np.arange(len(g)), classes] -= 1
    g = np.ascontiguousarray(g.T, dtype=np.float64)
    total = np.empty_like(squares)
    uses = np.zeros(len(weights), np.int64)
    for k, n in enumerate(ROWS):
        at = rows[:, k].astype(np.intp) - STARTS[k]
        here = slice(STARTS[k], STARTS[k + 1])
        uses[here] = np.bincount(at, minlength=n)
        for c in range(len(g)):
            total[c, here] = np.bincount(at, g[c], n)
    squares += total * total
    total /= np.sqrt(squares) + np.float32(1e-4)
    weights -= np.float32(rate) * total.T
    return uses


def _tokens(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts, one after another, and their number in each."""
    flat: list[bytes] = []
    size = []
    for t in texts(column):
        before = len(flat)
        flat += words(t)
        flat.append(END)
        size.append(len(flat) - before)
    return flat, np.array(size, np.int64)


@dataclass
class Model:
    weights: np.ndarray
    singles: dict[bytes, int]
    top: dict[bytes, int]
    class_size: np.ndarray  # N + V + 1 of each class
    tokens: int
    distinct: int


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text); word is binary, the end token a line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in texts(b.column(0)):
                seen.update(words(t))
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
            seen[END] += b.num_rows
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, top: int = TOP) -> list[tuple[bytes, int]]:
    """The words above the least count that at most `top` words reach."""
    inside, level = counts, F.floor(F.log2("c") * 4)
    least, total = None, 0
    while True:
        bins = inside.groupBy(level.alias("bin")).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).orderBy(F.desc("low")).collect()
        border = None
        for r in bins:
            if total + r["n"] > top:
                border = r
                break
            total += r["n"]
            least = r["low"]
        if border is None or border["low"] == border["high"]:
            break
        # the bin over the limit is cut finer, down to single counts
        inside = counts.where(F.col("c").between(border["low"], border["high"]))
        level = F.floor((F.col("c") - border["low"]) / ((border["high"] - border["low"]) // COUNT_BINS + 1))
    if least is None:
        return []
    return [(bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()]


def _class_sizes(counts: DataFrame, singles: dict[bytes, int]) -> tuple[np.ndarray, int, int]:
    """N + V + 1 per class, all tokens, and all distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = _Codes(singles), np.zeros((CLASSES, 2), np.int64)
        for b in batches:
            k = np.array([codes[w] & 255 for w in b.column("word").to_pylist()], np.int64)
            np.add.at(sizes, k, np.stack([b.column("c").to_numpy(), np.ones(len(k), np.int64)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])], names=["k", "n", "v"])

    sizes = np.zeros((CLASSES, 2), np.int64)
    for r in counts.mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sizes[r["k"]] = r["n"], r["v"]
    return sizes.sum(axis=1) + 1.0, int(sizes[:, 0].sum()), int(sizes[:, 1].sum())


def _round(docs: DataFrame, weights: np.ndarray, singles: dict[bytes, int], rate: float) -> np.ndarray:
    """The weights after one round over docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.copy()
        squares, uses, codes = np.zeros(w.shape[::-1], np.float32), np.zeros(len(w), np.int64), _Codes(singles)
        for b in batches:
            rows, classes = encoded(*_tokens(b.column(0)), codes)
            for i in range(0, len(rows), STEP_TOKENS):
                uses += _descend(w, squares, rows[i : i + STEP_TOKENS], classes[i : i + STEP_TOKENS], rate)
        change = (w - shared.value) * np.sqrt(uses)[:, None].astype(np.float32)
        at = range(0, len(w), BLOCK_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i in at], pa.int32()), pa.array([change[i : i + BLOCK_ROWS].tobytes() for i in at], pa.binary()), pa.array([np.sqrt(uses[i : i + BLOCK_ROWS]).tobytes() for i in at], pa.binary())],
            names=["block", "change", "uses"],
        )

    def add(t: pa.Table) -> pa.Table:
        change = sum(np.frombuffer(x, np.float32).reshape(-1, CLASSES) for x in t.column("change").to_pylist())
        uses = sum(np.frombuffer(x, np.float64) for x in t.column("uses").to_pylist())
        return pa.table({"block": t.column("block")[:1], "change": pa.array([(change / np.maximum(uses, 1e-9)[:, None]).astype(np.float32).tobytes()], pa.binary())})

    out = weights.copy()
    for r in docs.mapInArrow(run, "block int, change binary, uses binary").groupBy("block").applyInArrow(add, "block int, change binary").collect():
        out[r["block"] : r["block"] + BLOCK_ROWS] += np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
    return out


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs (key, text), and its table of counts (word, c)."""
    arrow_batches(docs.sparkSession)
    counts = through_disk(count_words(docs), "counts")
    first = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(SINGLES + 1).collect()]
    singles = {w: k for k, (w, _) in enumerate([x for x in first if x[0] != END][:SINGLES])}
    top = dict(_most_frequent(counts)) | dict(first)
    class_size, tokens, distinct = _class_sizes(counts, singles)
    weights = np.zeros((STARTS[-1], CLASSES), np.float32)
    weights[0] = np.log(class_size / class_size.sum())
    for k in range(ROUNDS if tokens else 0):
        part = docs.where(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == k).select("text")
        weights = _round(part, weights, singles, RATES[k])
    return Model(weights, singles, top, class_size, tokens, distinct), counts


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) per row of docs (key, text); keys must be unique."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(model.tokens + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes, of_class = _Codes(m.singles), np.log10(m.class_size)
        logs = _Logs(m.top)
        for b in batches:
            flat, size = _tokens(b.column("text"))
            n, text = len(size), np.repeat(np.arange(len(size)), size)
            rows, classes = encoded(flat, size, codes)
            log_p = np.empty(len(flat))
            for i in range(0, len(flat), STEP_TOKENS):
                part = slice(i, i + STEP_TOKENS)
                z = log_softmax(m.weights, rows[part])
                log_p[part] = z[np.arange(len(z)), classes[part]] / np.log(10) - of_class[classes[part]]
            own = np.bincount(text, log_p, n)
            found = np.fromiter(map(logs.__getitem__, flat), np.float64, len(flat))
            known = found >= 0
            n_known = np.bincount(text, known, n).astype(np.int64)
            counted = np.bincount(text, np.where(known, found, 0), n)
            names = ["key", "n_tokens", "n_known", "counted", "own", "word"]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size), pa.array(n_known), pa.array(counted), pa.array(own), pa.nulls(n, pa.binary())], names=names)
            rare = np.flatnonzero(~known)
            keys, zero, nil = b.column("key").to_numpy()[text[rare]], np.zeros(len(rare), np.int64), np.zeros(len(rare))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(zero), pa.array(zero), pa.array(nil), pa.array(nil), pa.array([flat[i] for i in rare.tolist()], pa.binary())], names=names)

    rows = through_disk(docs.select("key", "text").mapInArrow(run, "key long, n_tokens long, n_known long, counted double, own double, word binary"), "scored")
    here = rows.where("word IS NULL").drop("word")
    rare = rows.where("word IS NOT NULL").select("key", "word").join(counts, "word")
    met = rare.groupBy("key").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("rest"))
    both = here.join(met, "key", "left")
    counted = F.col("counted") + F.coalesce("rest", F.lit(0.0))
    return both.select("key", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (counted - F.col("n_tokens") * base).alias("base_score"), (F.col("own") + counted).alias("score"))


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    keyed = through_disk(rows, "texts")
    model, counts = train(keyed.where("NOT held_out"))
    scored = score_texts(keyed, model, counts)
    named = keyed.select("key", "doc_id", "held_out").join(scored, "key")
    return named.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
