"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order chains over printable ASCII give each long token a log-likelihood ratio; tokens beyond a threshold are
secrets of kind "markov". The chain of random strings is trained on the values that the fixed patterns find in a bounded
sample of documents and on strings drawn over usual alphabets, the other on words of the sample, a fixed list, and
identifiers joined from both. A part of the labelled samples, held out by a hash, measures precision and recall.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table, tidy

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The run of a greedy match fails or holds as a whole, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: A token is judged from so many characters on.
LEAST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")

#: Labelled samples: so many documents at most, the first by a hash of doc_id, give their commonest words and the values of fixed patterns, the first by a hash; and so many strings are drawn.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_WORDS = 20_000
SAMPLE_VALUES = 2_000
RANDOM_STRINGS = 4_000
#: A sample in so many is held out.
HOLD_OUT = 5
#: The share of ordinary samples that may pass the threshold, and the least one.
FALSE_ALARMS = 1e-4
LEAST_RATIO = 12.0
SEED = 20
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)


# Ordinary words that identifiers are made of, besides those of the corpus.
WORDS = """
account action address amount array author average base batch block body buffer build bytes cache call change channel char
check child class client close code column command config connect content context control copy count create current customer
data date default delete detail device directory document domain double entry error event example export factory field file
filter first folder format function group handle hash header height image import index input instance integer item iterator
job key label language last layer length level library limit line link list load local lock log machine manager map master
match max memory message method metric min mode model module month name network next node number object offset open option
order output owner package page parent parse part path pattern payload point policy pool position prefix previous process
product profile project property query queue random range read record region remote render report request response result
root row rule run sample schema score search section segment select sequence server service session setting shape size
source start state status stream string table target task template test text thread time total type update user value
version view width window word worker write year
""".split()


def train(random_strings: list[str], ordinary: list[str]) -> np.ndarray:
    """A 128 x 128 table of log P(next | character) under the chain of random strings less that under the ordinary chain; one count is added everywhere, row 0 is the start."""
    tables = []
    for sample in (random_strings, ordinary):
        counts = np.full((128, 128), 0.5)
        for s in sample:
            codes = np.frombuffer(b"\0" + s.encode("ascii", "ignore"), np.uint8)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        tables.append(np.log(counts / counts.sum(1, keepdims=True)))
    return (tables[0] - tables[1]).astype(np.float32)


def ratio(model: np.ndarray, token: str) -> float:
    codes = np.frombuffer(b"\0" + token.encode("ascii"), np.uint8)
    return float(model[codes[:-1], codes[1:]].sum())


def labelled(words: list[str], values: list[str] = ()) -> tuple[list[str], list[str]]:
    """Secrets: the values and random strings over usual alphabets; and identifiers made of the words: alone, in upper case, joined by _ - or / or by capitals, some with a short number."""
    draw = random.Random(SEED)
    positive = [*values, *["".join(draw.choices(draw.choice(_ALPHABETS), k=draw.randrange(LEAST, 65))) for _ in range(RANDOM_STRINGS)]]
    words = sorted({w for w in [*words, *WORDS] if w.isascii() and w.isalpha()})
    negative = []
    for _ in range(4 * len(words) + 2000):
        some = [draw.choice(words) for _ in range(draw.randrange(1, 5))]
        style = draw.randrange(6)
        s = draw.choice("_-/").join(some) if style < 2 else "".join(x.capitalize() for x in some) if style == 2 else draw.choice("_-").join(some).upper() if style == 3 else "".join(some)
        negative.append(s + (f"{draw.choice(['', '_', '-'])}{draw.randrange(1000)}" if draw.random() < 0.15 else ""))
    return positive, negative


@dataclass(frozen=True)
class Model:
    """The table of ratios, the threshold, and on the held-out samples the share of secrets among what passes it, and of what passes among secrets."""

    table: np.ndarray
    threshold: float
    precision: float
    recall: float

    def secret(self, token: str) -> float | None:
        """The ratio of a token that passes the threshold."""
        got = ratio(self.table, token)
        return got if got > self.threshold else None


def learn(words: list[str], values: list[str] = ()) -> Model:
    positive, negative = labelled(words, values)
    held = lambda s: zlib.crc32(s.encode()) % HOLD_OUT == 0
    table = train([s for s in positive if not held(s)], [s for s in negative if not held(s)])
    long = [s for s in negative if len(s) >= LEAST]
    threshold = max(LEAST_RATIO, float(np.quantile([ratio(table, s) for s in long if not held(s)] or [0.0], 1 - FALSE_ALARMS)))
    hits, alarms = ([ratio(table, s) > threshold for s in sample if len(s) >= LEAST and held(s)] for sample in (positive, long))
    passed = sum(hits) + sum(alarms)
    return Model(table, threshold, sum(hits) / passed if passed else 1.0, sum(hits) / len(hits) if hits else 1.0)


def fit(documents: DataFrame) -> Model:
    """Learns from SAMPLE_DOCUMENTS documents, whole texts: their SAMPLE_WORDS commonest words of letters, and SAMPLE_VALUES values that the fixed patterns find. Nothing but these bounded lists reaches the driver."""
    ids = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    sample = documents.join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null").select("text")
    # Whole tokens of letters, so that pieces of random strings don't count as words.
    plain = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{2,19}[.,;:!?]*$"))
    words = sample.select(F.explode(F.array_distinct(F.transform(plain, lambda w: F.regexp_replace(w, "[^A-Za-z]+$", "")))).alias("w")).groupBy("w").count()
    words = words.orderBy(F.desc("count"), "w").limit(SAMPLE_WORDS)
    found = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((_ASSIGN.pattern.replace("(password", "(?i:(password").replace("api_?key)", "api_?key))"), 2), (_ACCESS.pattern, 0), (_HEX.pattern, 0))])
    values = sample.select(F.explode(F.flatten(found)).alias("v")).where(F.length("v").between(LEAST, 200) & F.col("v").rlike(r"^[\x21-\x7E]+$")).distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE_VALUES)
    return learn([r.w for r in words.collect()], [r.v for r in values.collect()])


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans (start, kind as listed, end), and the spans that the models add, with their ratios: long tokens that no base span holds as a whole."""
    base = []
    if _KEYWORD.search(text):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    more, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach, at = max(reach, base[at][2]), at + 1
        if reach < m.end() and (got := model.secret(m[0])) is not None:
            more.append((m.start(), m.end(), got))
    return base, more


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov, max_ratio (of the added spans; null without one).

    A null text counts as empty: no spans, the digest of nothing. Offsets are code points. Base matches of one kind
    are the leftmost, not overlapping; kinds may overlap each other; at the same start they go by kind as listed. Rows are independent: repeated
    rows give repeated rows, an empty table none (the models are then those of the seeds alone).
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or fit(documents))
    kinds = dict.fromkeys(("n_assign", "n_access", "n_hex"), pa.int64()) | {"base_sha256": pa.string(), "spans": pa.string(), "n_markov": pa.int64(), "max_ratio": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = find(text or "", model)
                named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                spans = sorted([(a, k, b) for a, k, b in base] + [(a, 3, b) for a, b, _ in more])
                rows.append((*[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(f"{(*KINDS, 'markov')[k]}:{a}:{b}" for a, k, b in spans), len(more), max((r for _, _, r in more), default=None)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *kinds])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, max_ratio double")


def redacted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """documents with the secrets in text replaced by [SECRET], each stretch of touching spans once; all columns and rows stay. A null text stays null, an empty table empty."""
    place = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                base, more = find(text or "", sent.value)
                spans = sorted([*base, *[(a, 3, b) for a, b, _ in more]])
                texts.append(redact(text, spans) if spans else text)
            yield batch.set_column(place, "text", pa.array(texts, batch.column(place).type))

    return documents.mapInArrow(tidy(run), documents.schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch that spans cover replaced once."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = b
    return "".join([*out, text[at:]])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
