"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is lower-cased, and its UTF-8 bytes are cut into windows. The network reads a window from both ends and labels
every position, of letters or not, with probabilities of the languages. A document's probabilities are their means over
all positions of all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftline.llm.common import stored, table, tidy

UNDETERMINED = "und"
#: Labelled documents to learn from: so many at most of each language, the first by a hash of doc_id; and of each so many stretches, at places chosen by a hash in the whole text.
DOCUMENTS = 300
STRETCHES = 16
HIDDEN = 8
#: Bytes of a window, and windows read at once.
WINDOW = 64
WINDOWS = 4096
STEPS = 500
BATCH = 256
RATE = 0.02
SEED = 3
#: Texts handled at once.
SLICE = 512
#: Languages whose counts are broadcast, at most.
BROADCAST_ROWS = 100_000
PAD = 256

_LETTER = re.compile(r"[^\W\d_]")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the windows of all texts, PAD after a text's end, as (window, place); and how many windows each text has."""
    many = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(many.sum()) * WINDOW, PAD, np.int16)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = (np.cumsum(many) - many) * WINDOW
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    flat[at] = np.frombuffer(b"".join(texts), np.uint8)
    return flat.reshape(-1, WINDOW), many


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


@dataclass
class Network:
    """Weights of the two directions, x: a row for each byte (PAD: nought) and gate, h: recurrent, b: biases; and of the labels."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        h, w = HIDDEN, {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (PAD + 1, 3 * h)).astype(np.float32)
            w[f"x{d}"][PAD] = 0
            w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            w[f"b{d}"] = np.zeros(3 * h, np.float32)
        w["o"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        w["c"] = np.zeros(len(languages), np.float32)
        return cls(w, languages)

    def direction(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, hidden, window) after each step over x (time, window), backwards for "b". Columns are windows, so that each gate is one block of memory."""
        wx, wh, b, h = self.weights[f"x{d}"].T, self.weights[f"h{d}"].T, self.weights[f"b{d}"][:, None], HIDDEN
        wx, wh, b = (np.concatenate([0.5 * w[: 2 * h], w[2 * h :]]) for w in (wx, wh, b))  # a logistic gate is half a tanh of half
        wx = np.ascontiguousarray(wx + np.where(np.arange(PAD + 1) < PAD, b, 0))
        state, out, tape = np.zeros((h, x.shape[1]), wx.dtype), np.empty((len(x), h, x.shape[1]), wx.dtype), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates, back = wx[:, x[t]], wh @ state
            both = gates[: 2 * h]
            both += back[: 2 * h]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            z, r, n = both[:h], both[h:], back[2 * h :].copy() if keep else back[2 * h :]
            n *= r
            n += gates[2 * h :]
            np.tanh(n, out=n)
            if keep:
                tape.append((t, state, z, r, back[2 * h :], n))
            state = (state - n) * z
            state += n
            out[t] = state
        return out, tape

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, window) of every position of x (time, window)."""
        o, h = self.weights["o"], HIDDEN
        y = np.matmul(o[:h].T, self.direction(x, "f")[0]) + np.matmul(o[h:].T, self.direction(x, "b")[0]) + self.weights["c"][:, None]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions of x (time, window), and its gradients by backpropagation through time."""
        h, w = HIDDEN, self.weights
        states = {d: self.direction(x, d, keep=True) for d in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], 1)
        y = np.matmul(w["o"].T, both) + w["c"][:, None]
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        real = (x < PAD)[:, None]
        n, own = max(1, int(real.sum())), np.arange(len(target))
        loss = -float((np.log(p[:, target, own] + 1e-30) * real[:, 0]).sum()) / n
        dy = p.copy()
        dy[:, target, own] -= 1
        dy *= real / n
        grads = {"o": np.einsum("thb,tlb->hl", both, dy), "c": dy.sum((0, 2))}
        dboth = np.matmul(w["o"], dy)
        for k, d in enumerate("fb"):
            wh = w[f"h{d}"]
            given, gh = np.zeros((PAD + 1, 3 * h)), np.zeros_like(wh)
            carry, inputs = np.zeros((h, x.shape[1]), wh.dtype), np.empty((len(x), 3 * h, x.shape[1]), wh.dtype)
            for t, state, z, r, back, cand in reversed(states[d][1]):
                g = carry + dboth[t, k * h : (k + 1) * h]
                dn = g * (1 - z) * (1 - cand**2)
                dz = g * (state - cand) * z * (1 - z)
                dr = dn * back * r * (1 - r)
                gates = np.concatenate([dz, dr])
                inputs[t] = np.concatenate([gates, dn])
                gh[:, : 2 * h] += state @ gates.T
                gh[:, 2 * h :] += state @ (dn * r).T
                carry = g * z + wh[:, : 2 * h] @ gates + wh[:, 2 * h :] @ (dn * r)
            flat = inputs.transpose(0, 2, 1).reshape(-1, 3 * h)
            for j in range(3 * h):
                given[:, j] = np.bincount(x.ravel(), flat[:, j], minlength=PAD + 1)
            grads |= {f"x{d}": given.astype(wh.dtype) * (np.arange(PAD + 1) < PAD)[:, None], f"h{d}": gh, f"b{d}": given[:PAD].sum(0).astype(wh.dtype)}
        return loss, grads

    def scores(self, x: np.ndarray) -> np.ndarray:
        """For each window (window, place) the sums over its positions of the languages' probabilities, and the number of positions."""
        out = np.empty((len(x), len(self.languages) + 1))
        for at in range(0, len(x), WINDOWS):
            own = np.ascontiguousarray(x[at : at + WINDOWS].T)
            real = own < PAD
            out[at : at + WINDOWS, :-1] = np.einsum("tlw,tw->wl", self.labels(own), real)
            out[at : at + WINDOWS, -1] = real.sum(0)
        return out


def train(x: np.ndarray, target: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Adam over batches of windows (window, place); the same data give the same network."""
    rng = np.random.default_rng(SEED)
    net = Network.fresh(languages, rng)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), BATCH)
        _, grads = net.gradients(np.ascontiguousarray(x[some].T), target[some])
        rate = RATE * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame) -> Network | None:
    """Learns from a bounded sample of labelled documents that aren't held out, as many of each language; None if there is none with a letter. A language's first documents are found before any shuffle, and texts leave the executors only as stretches."""
    known = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    rows = known.select("doc_id", "lang", key.alias("h"), F.xxhash64("text").alias("text_hash"))
    counts = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.count() <= BROADCAST_ROWS:  # of a language with many documents only a hashed share, with four times as many as are taken, is put in order
        rows = rows.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit(4 * DOCUMENTS << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash"))
    first = rows.withColumn("place", place).where(F.col("place") <= DOCUMENTS)
    ids = F.broadcast(first.select("doc_id", "lang", "text_hash").distinct())  # DOCUMENTS a language
    rows = known.withColumn("text_hash", F.xxhash64("text")).join(ids, ["doc_id", "lang", "text_hash"], "left_semi").dropDuplicates(["doc_id", "lang", "text_hash"])
    some = F.transform(F.sequence(F.lit(1), F.lit(STRETCHES)), lambda i: F.substring("text", F.pmod(F.xxhash64(F.col("text_hash"), i), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1, F.lit(WINDOW)))
    got = sorted((r.lang, t) for r in rows.select("lang", some.alias("some")).collect() for t in r.some)
    by: dict[str, list[bytes]] = {}
    for lang, t in got:
        by.setdefault(lang, []).append(as_bytes(t)[:WINDOW])
    if not by:
        return None
    languages = sorted(by)
    most = max(map(len, by.values()))
    flat = [by[lang][i % len(by[lang])] for lang in languages for i in range(most)]  # as many of each
    return train(windows(flat)[0], np.repeat(np.arange(len(languages)), most), languages)


def predict(documents: DataFrame, network: Network | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), echo: bool = True) -> DataFrame:
    """All columns of documents (without echo: those before `text`), and the language and score of the column `text`."""
    place = documents.columns.index(text)
    sent = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column(place).to_pylist()]
                pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                some = np.flatnonzero([bool(_LETTER.search(t)) for t in texts])
                if net is not None and len(some):
                    x, many = windows([as_bytes(texts[i]) for i in some])
                    sums = np.add.reduceat(net.scores(x), np.cumsum(many) - many, axis=0)
                    p = sums[:, :-1] / sums[:, -1:]
                    best = p.argmax(1)
                    score[some] = np.clip(p[np.arange(len(some)), best], 0, 1)
                    for i, b in zip(some, best, strict=True):
                        pred[i] = net.languages[b]
                columns = batch.columns if echo else batch.columns[:place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names[: len(columns)], *names])

    return documents.mapInArrow(tidy(run), StructType([*list(documents.schema)[: None if echo else place], StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score.

    held_out: crc32 of doc_id as text leaves 2 by division by 4 (a null doc_id: false); those documents' labels are never
    learned. lang_pred is one of the languages learned, "und" with score 0 for a null text and one without a letter, or
    where nothing was learned. score is the pooled probability of lang_pred. Text and the labels of others alone decide,
    so repeated rows get the same answer; equal probabilities go to the first language by code point. Whole texts are read
    however long. An empty table gives no rows.
    """
    # The text is read in Python and doesn't come back.
    out = predict(documents.select("doc_id", "text"), fit(documents), echo=False)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
