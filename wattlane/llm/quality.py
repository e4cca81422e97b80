"""Quality classifier: a factorisation machine over whole texts (operator 4).

Method.  A document is a sparse vector of hashed words (term counts, scaled to
length one) followed by dense structure statistics and size metadata.  The score is

    sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost one pass over the non-zero entries (the
sum-of-squares identity).  The model is fitted with Adam on at most
``max_train_rows`` labelled documents (chosen by a hash of doc_id, a documented
bound); their vectors are made by Spark, and only those bounded vectors reach
the driver.  Scoring maps the broadcast model (a few hundred KB, fixed by
``WORD_SLOTS`` and ``FACTORS``) over every whole text, without a shuffle.

Never an input: labels, lang, source, doc_id.

Edge cases: null and empty texts have an all-zero vector and get the score of
that vector; labels that are null are ignored, and of several labels of one
document the mean decides; with no usable labels, or labels of one kind only,
every score is the smoothed share of label 1 (0.5 without labels); repeated
rows get equal scores; extra columns are ignored.
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

from wattlane.llm.common import own_columns

WORD_SLOTS = 1 << 13
FACTORS = 8
MAX_TRAIN_ROWS = 6000
#: Scores below this are rejected.
THRESHOLD = 0.3
DENSE = (
    "log_words", "log_chars", "log_lines", "bytes_per_char", "mean_word", "long_words", "short_words", "upper", "digits",
    "punctuation", "exclamations", "symbols", "bars", "shouted_words", "distinct_words", "top_word", "repeated_next",
    "distinct_pairs", "words_per_line", "repeated_lines", "full_stops", "word_tails", "control",
)
SIZE = WORD_SLOTS + len(DENSE)

_CLASS = np.zeros((8, 256), np.int64)
for _row, _chars in enumerate((range(65, 91), range(48, 58), b".,;:!?'\"()-", b"!", b"#*%$&@^~_=<>{}[]\\/+", b"|", b".", [*range(9), 11, 12, *range(14, 32)])):
    _CLASS[_row, list(_chars)] = 1
_slots: dict[str, int] = {}


def slot(word: str) -> int:
    found = _slots.get(word)
    if found is None:
        if len(_slots) >= 50_000:
            _slots.clear()
        found = _slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
    return found


def vector(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, their weights, and the dense statistics (unscaled) of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(DENSE), np.float32)
    raw = text.encode("utf-8", "surrogatepass")
    upper, digits, punct, bangs, symbols, bars, stops, control = _CLASS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = len(text)
    shouted = sum(map(str.isupper, words))
    tails = sum([not (w[-1].isalnum() or w[-1] in ".,") for w in words])
    dense = np.array([
        np.log1p(n), np.log1p(chars), np.log1p(len(lines)), len(raw) / chars, sizes.mean(), (sizes > 12).mean(), (sizes < 4).mean(),
        upper / chars, digits / chars, punct / chars, bangs / chars, symbols / chars, bars / chars, shouted / n, len(seen) / n,
        max(seen.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / n,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), stops / n, tails / n, control / chars,
    ], np.float32)
    at = np.fromiter(map(slot, seen), np.int64, len(seen))
    weight = np.bincount(at, np.fromiter(seen.values(), np.float64, len(seen)), WORD_SLOTS)
    slots = np.flatnonzero(weight)
    weight = np.sqrt(weight[slots])
    return slots.astype(np.int32), (weight / np.sqrt((weight**2).sum())).astype(np.float32), dense


@dataclass
class FactorisationMachine:
    """Weights of the machine, and the scaling of the dense statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -6, 6) * 0.5

    def score(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        at, x, doc = stacked(docs, self.inputs(np.stack([d[2] for d in docs]).astype(np.float64)))
        return sigmoid(self.margin(at, x, doc, len(docs))[0])

    def margin(self, at: np.ndarray, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, and by document the factor sums that the gradient needs too. Every document has its dense entries."""
        starts = np.searchsorted(doc, np.arange(n))
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + pairs, sums, vx


def stacked(docs, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (slot, value, document) list for several documents."""
    own = np.arange(WORD_SLOTS, SIZE)
    at = np.concatenate([np.concatenate((d[0], own)) for d in docs])
    x = np.concatenate([np.concatenate((d[1], v)) for d, v in zip(docs, dense, strict=True)])
    return at, x, np.repeat(np.arange(len(docs)), [len(d[0]) + len(own) for d in docs])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_machine(docs: list, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01,
                decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss; both labels weigh the same in sum."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    dense = np.stack([d[2] for d in docs]).astype(np.float64) if docs else np.zeros((1, len(DENSE)))
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, FACTORS)),
                              dense.mean(0), dense.std(0) + 1e-3)
    if len(set(labels.tolist())) < 2:
        return fm
    fm.bias = 0.0
    fm.factors = rng.normal(0, 0.02, (SIZE, FACTORS))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (fm.linear, fm.factors, np.zeros(1))]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            at, x, doc = stacked([docs[i] for i in pick], fm.inputs(dense[pick]))
            z, sums, vx = fm.margin(at, x, doc, len(pick))
            g = (sigmoid(z) - labels[pick]) * weight[pick] / len(pick)
            gx = (g[doc] * x)
            grad_w = np.bincount(at, gx, SIZE) + decay * fm.linear
            each = gx[:, None] * (sums[doc] - vx)
            grad_v = np.stack([np.bincount(at, each[:, f], SIZE) for f in range(FACTORS)], 1) + decay * fm.factors
            bias = np.array([fm.bias])
            step += 1
            for p, d, (m, s) in zip((fm.linear, fm.factors, bias), (grad_w, grad_v, np.array([g.sum()])), state, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            fm.bias = float(bias[0])
    return fm


def texts_of(part: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in part.column(column).to_pylist()]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(label, slots, weights, dense) of at most ``max_rows`` labelled documents, picked by a hash of doc_id."""
    picked = (labels.where("quality is not null and doc_id is not null")
              .where("crc32(cast(doc_id as string)) % 5 != 0")
              .groupBy("doc_id").agg(F.avg("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # at most max_rows rows: broadcast
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .selectExpr("cast(label >= 0.5 as int) label", "text", "cast(doc_id as long) doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k].astype(np.float32 if k else np.int32).tobytes() for f in found], pa.binary()) for k in range(3)),
                 batch.column(2)],
                names=["label", "slots", "weights", "dense", "doc_id"])

    return rows.mapInArrow(run, "label int, slots binary, weights binary, dense binary, doc_id long")


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> FactorisationMachine:
    """Fit on the labelled documents outside the held-out fifth."""
    rows = training_rows(docs, labels, max_train_rows).toArrow()  # bounded: max_train_rows sparse vectors
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    label = rows.column("label").to_numpy()[order].astype(np.float64)
    kinds = (np.int32, np.float32, np.float32)
    parts = [rows.column(c) for c in ("slots", "weights", "dense")]
    vectors = [tuple(np.frombuffer(p[int(i)].as_py(), k) for p, k in zip(parts, kinds, strict=True)) for i in order]
    return fit_machine(vectors, label)


def score_quality(docs: DataFrame, machine: FactorisationMachine, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as column ``name``; only the text goes through Python."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # size fixed by WORD_SLOTS x FACTORS

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.value.score([vector(t or "") for t in texts.slice(lo, 64).to_pylist()]) for lo in range(0, len(texts), 64)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                 max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns."""
    score = "quality_classifier_score"
    return score_quality(docs, fit_quality(docs, labels, max_train_rows), score).where(F.col(score) >= threshold).select(*own_columns(docs))
