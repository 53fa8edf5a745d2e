"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

* Features of a word are the hashed 2- and 3-byte pieces of its letters in lower case, with its ends marked.
  A text is the mean of the embeddings of all features of all its words, and a linear layer with softmax classifies that.
* The model is trained in numpy by stochastic gradient descent on a bounded sample: no more than SAMPLE_ROWS labelled rows and
  SAMPLE_BYTES of text (none longer than a 16th of that), spread evenly over all labels, and only rows whose crc32(doc_id) mod 3 isn't 1. Which rows these are depends on
  their own hashes alone, not on partitions or order. More than MOST_LANGUAGES labels are an error, as no table of scores could hold them.
* A fifth of the sample only calibrates: the temperature of the softmax, and the two limits of rejection. A text is rejected if
  its calibrated score, or the share of its features that training has seen, is below what all but REJECT of the
  calibration texts reach (with a margin); a text of an unknown language or of noise falls below one of them.
* Prediction reads the whole text and nothing else. As the mean is linear, a text's scores are the mean of its features' parts of them; numpy
  hashes the features of a whole batch at once and adds up their parts by text, so nothing is remembered between texts.

lang_pred is "und" (score 0, rejected) where the text is null or has no letter. With nothing to learn from, every text is "und".
Null or repeated doc_ids are rows like any other (rows with a null doc_id aren't learned from, and held_out is false). An
empty table gives an empty result. Columns other than doc_id, text and, for training, lang are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, keep_keys, key_of, slices, staged

BUCKETS = 1 << 16
WIDTH = 16
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 12 << 20
MOST_LANGUAGES = 1000
EPOCHS = 6
RATE = 0.5
BATCH = 16
REJECT = 0.0005
#: Bytes of runs of letters whose features are hashed at once.
HASHED_AT_ONCE = 1 << 17
LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = LETTERS.findall
_HAS_LETTER = LETTERS.search


def features(word: str) -> list[int]:
    """Buckets of the subwords of a white-space delimited word; none without letters."""
    out = []
    for run in _RUNS(word.lower()):
        b = f"<{run}>".encode()
        out += [zlib.crc32(b[k : k + n]) % BUCKETS for n in (2, 3) for k in range(len(b) - n + 1)]
    return out


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Steps of CRC-32 for a byte, and its state after each two bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    one = step[(0xFF ^ np.arange(256)) & 0xFF] ^ np.uint32(0xFFFFFFFF >> 8)
    first, second = np.divmod(np.arange(1 << 16), 256)
    return step, step[(one[first] ^ second.astype(np.uint32)) & np.uint32(0xFF)] ^ (one[first] >> np.uint32(8))


_STEP, _AFTER_TWO = _crc_tables()
_CLOSE = ord(">")


def buckets(a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of marked runs of letters as bytes: the buckets of all 2-byte and of all 3-byte subwords, and the bytes at which these begin."""
    if len(a) < 3:
        return []
    two = _AFTER_TWO[a[:-1].astype(np.intp) << 8 | a[1:]]
    three = _STEP[(two[:-1] ^ a[2:]) & np.uint32(0xFF)] ^ (two[:-1] >> np.uint32(8))
    inside = a[:-1] != _CLOSE
    return [((~state[at] % np.uint32(BUCKETS)).astype(np.intp), at) for state, at in ((two, np.flatnonzero(inside)), (three, np.flatnonzero(inside[:-1] & inside[1:])))]


@dataclass
class Model:
    languages: list[str]
    parts: np.ndarray  # for each bucket: its part of the scores of each language, and whether it was seen
    bias: np.ndarray
    temperature: float
    least_score: float
    least_known: float


def marked(text: str) -> bytes:
    """A text's runs of letters in lower case, each between marks."""
    runs = _RUNS(text.lower())
    return f"<{'><'.join(runs)}>".encode() if runs else b""


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the means of its features' parts, by language, and the share of features seen."""
    total, count = np.zeros((len(texts), model.parts.shape[1])), np.zeros(len(texts))
    runs = list(map(marked, texts))
    ends = np.cumsum([0, *map(len, runs)])
    data = np.frombuffer(b"".join(runs), np.uint8)
    for at in range(0, len(data), HASHED_AT_ONCE):
        for found, begin in buckets(data[at : at + HASHED_AT_ONCE + 2]):
            n = int(np.searchsorted(begin, min(HASHED_AT_ONCE, len(data) - at)))  # those that begin in this part
            owner = np.searchsorted(ends, begin[:n] + at, "right") - 1
            if n:
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total[owner[first]] += np.add.reduceat(model.parts[found[:n]], first, axis=0)
                count[owner[first]] += np.diff(np.concatenate([first, [n]]))
    mean = total / np.maximum(count, 1)[:, None]
    return mean[:, :-1], mean[:, -1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, str, str]]) -> Model | None:
    """rows: (doc_id, text, lang) of the sample."""
    rows = sorted((r for r in rows if _HAS_LETTER(r[1])), key=lambda r: (str(r[0]), r[2]))
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(0)
    fold = np.array([zlib.crc32(b"calibrate" + str(r[0]).encode()) % 5 == 0 for r in rows])
    if fold.all() or not fold.any() or {r[2] for r, c in zip(rows, fold) if not c} != set(languages):
        fold[:] = False
    number = {x: k for k, x in enumerate(languages)}
    bags: list[tuple[np.ndarray, np.ndarray]] = []  # 6 bytes for each distinct feature of a text, so the sample's features are smaller than its texts
    labels: list[int] = []
    seen = np.zeros(BUCKETS, bool)
    for (_, text, lang), c in zip(rows, fold):
        if c:
            continue
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 12)))
        for part in (text, " ".join(words[at : at + int(rng.integers(4, 13))])):  # the text, and a short piece of it
            found = [f for f, _ in buckets(np.frombuffer(marked(part), np.uint8))]
            if found:
                index, times = np.unique(np.concatenate(found), return_counts=True)
                seen[index] = True
                bags.append((index.astype(np.uint16), (times / times.sum()).astype(np.float32)))
                labels.append(number[lang])
    y = np.array(labels)
    weight = (len(y) / (len(languages) * np.maximum(1, np.bincount(y, minlength=len(languages)))))[y]
    e = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            pick = order[k : k + BATCH]
            index = np.concatenate([bags[p][0] for p in pick]).astype(np.intp)
            share = np.concatenate([bags[p][1] for p in pick])
            owner = np.repeat(np.arange(len(pick)), [len(bags[p][0]) for p in pick])
            starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            h = np.add.reduceat(e[index] * share[:, None], starts)
            g = softmax(h @ w + bias)
            g[np.arange(len(pick)), y[pick]] -= 1
            g *= weight[pick, None]
            back = (g @ w.T)[owner] * share[:, None]
            np.subtract.at(e, index, (rate * 20 * back).astype(np.float32))  # a mean's gradient is thin: features share it
            w -= rate * (h.T @ g).astype(np.float32)
            bias -= 0.1 * rate * g.sum(axis=0)
    parts = np.concatenate([(e @ w) * seen[:, None], seen[:, None]], axis=1).astype(np.float32)
    model = Model(languages, parts, bias.astype(np.float64), 1.0, 0.0, 0.0)
    check = [r for r, c in zip(rows, fold) if c] or rows
    z, share = scores(model, [r[1] for r in check])
    z = z + model.bias
    truth = np.array([number[r[2]] for r in check])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    top = softmax(z / model.temperature).max(axis=1)
    model.least_score = 0.9 * float(min(0.5, np.quantile(top, REJECT)))
    model.least_known = 0.7 * float(np.quantile(share, REJECT))
    return model


def predict(model: Model | None):
    """An Arrow function (doc_id, text, ...) -> its columns, lang_pred, score, known, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            pred, score, share, out = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if model:
                z, known = scores(model, texts)
                p = softmax((z + model.bias) / model.temperature)
                for i in [i for i, t in enumerate(texts) if _HAS_LETTER(t)]:
                    k = int(p[i].argmax())
                    pred[i], score[i], share[i] = model.languages[k], float(p[i, k]), float(known[i])
                    out[i] = bool(score[i] < model.least_score or share[i] < model.least_known)
            yield pa.record_batch([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64()), pa.array(out, pa.bool_())], [*b.schema.names, "lang_pred", "score", "known", "rejected"])

    return run


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Trains on a bounded sample of the labelled rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(remainder() != 1)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.octet_length("text")).alias("size")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = sample_rows / len(counts)
    share = None
    for r in counts:
        part = min(1.0, each / r.n, sample_bytes / len(counts) / max(1.0, r.n * r.size))
        own = F.when(F.col("lang") == r.lang, F.lit(part))
        share = own if share is None else share.when(F.col("lang") == r.lang, F.lit(part))
    key = F.xxhash64("doc_id", F.lit(11))
    picked = rows.where(F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).withColumn("size", F.octet_length("text"))
    # about as many as asked for; the hard bounds cut in order of a second hash
    order = [F.xxhash64("doc_id", "text", F.lit(12)), "doc_id", "lang"]
    taken, size = [], 0
    small = picked.where(F.col("size") <= sample_bytes // 16).orderBy(*order).limit(2 * sample_rows)
    for r in staged(small, "sample").orderBy(*order).toLocalIterator():
        size += r.size
        if size > 2 * sample_bytes:
            break
        taken.append((r.doc_id, r.text, r.lang))
    return train(taken)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, with lang_pred, score, known and rejected instead of any that are called so."""
    kept = docs.drop("lang_pred", "score", "known", "rejected")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return in_arrow(kept, predict(model), T.StructType([*kept.schema.fields, *added]))


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, known, rejected."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected; same columns, even those of the result's names. Only texts and their keys pass through Python."""
    found = identify(docs.select("text", *key_of("text")), fit(docs)).where("rejected")
    return keep_keys(docs, staged(found.select("k1", "k2", F.lit(False).alias("stays")), "rejected"), "text")
