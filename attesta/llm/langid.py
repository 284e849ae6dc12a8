"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of ORDER characters over lower-case letters, with everything between words as one space. The
top order has plain counts, the lower ones continuation counts; every order is interpolated with the next lower one and
the lowest with a uniform distribution. The n-grams of all languages stand in sorted arrays of 64-bit hashes, each with
one interpolated log-probability a language, so a text's characters are looked up once for all languages; an n-gram that
no language has seen falls back to the weight of its context and the next lower order.

The language of the lowest cross-entropy for each character is predicted. Rejection is calibrated on documents that the
counts leave out (a fifth of the sample and about CALIBRATION_ROWS further ones a language): a document's z is its
cross-entropy above what its language's documents of that length have, in deviations, and it is rejected if its z is over
the one that a share of REJECT_RATE of its language's left-out documents exceeds.

Training sees at most TRAIN_ROWS documents a language, those whose ids have the smallest hashes, as whole texts.

Defined results: a null text or one without a letter is `und`, score 0 and rejected; ties go to the language first in
the alphabet; without any training documents everything is `und`; repeated rows stay; rows with a null lang are scored
but never learnt from; further columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_mod, ensure_columns, give_back, trimmed

ORDER = 4
#: Sampled documents a language at most.
TRAIN_ROWS = 400
#: Further documents a language, about, whose z is measured.
CALIBRATION_ROWS = 1000
#: Share of a language's own documents that may be rejected.
REJECT_RATE = 0.005
#: The least limit of z: what a normal distribution exceeds at REJECT_RATE.
LEAST_Z = 2.576
#: The limit of a language with too few documents to leave any out.
UNKNOWN_Z = 20.0
#: Characters that count at most towards the score's certainty, as neighbouring ones depend on each other.
EVIDENCE = 40
_BLANK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its symbol: itself if a letter (those beyond 16 bits folded), else the blank."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, _BLANK, np.uint64)
        at = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        table[at] = np.where(at < 0x10000, at, 0xE000 + at % 0x1900)
        _LETTERS = table
    return _LETTERS


def symbols(text: str | None) -> np.ndarray:
    """The text's symbols after ORDER - 1 blanks, with a blank at the end; only these if it has no letter."""
    pad = np.full(ORDER - 1, _BLANK, np.uint64)
    if not text:
        return pad
    s = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    letter = s != _BLANK
    if not letter.any():
        return pad
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a word
    return np.concatenate([pad, s[keep]]) if keep[-1] and not letter[-1] else np.concatenate([pad, s[keep], pad[:1]])


def hashed(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n symbols that end at each place from ORDER - 1 on (a bijection of 16 bits a symbol)."""
    out = np.zeros(max(len(s) - ORDER + 1, 0), np.uint64)
    for k in range(n, 0, -1):
        out = (out << np.uint64(16)) | s[ORDER - k : len(s) - k + 1]
    return out * _MIX


def _count(texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order: sorted n-gram codes (not hashed) and their counts; below the top order, continuation counts."""
    codes = np.concatenate([hashed(s, ORDER) for s in texts]) * np.uint64(pow(int(_MIX), -1, 1 << 64))
    out = {ORDER: np.unique(codes, return_counts=True)}
    for n in range(ORDER - 1, 0, -1):
        # each distinct n-gram of one more symbol is one context before
        out[n] = np.unique(out[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class KneserNey:
    """One language's counts."""

    def __init__(self, texts: list[np.ndarray], alphabet: int):
        self.grams = _count(texts)
        self.alphabet = alphabet
        self.context: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.discount = {}
        for n, (codes, counts) in self.grams.items():
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            self.discount[n] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            heads, first = np.unique(codes >> np.uint64(16), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts
            self.context[n] = heads, total, np.diff(np.append(first, len(codes)))

    def weight(self, n: int, heads: np.ndarray) -> np.ndarray:
        """What a context hands on to the next lower order; all of it if it wasn't seen."""
        keys, total, kinds = self.context[n]
        at, ok = _find(keys, heads)
        return np.where(ok, self.discount[n] * kinds[at] / total[at], 1.0)

    def prob(self, n: int, codes: np.ndarray) -> np.ndarray:
        if not n:
            return np.full(len(codes), 1 / self.alphabet)
        keys, counts = self.grams[n]
        at, ok = _find(keys, codes)
        heads = codes >> np.uint64(16)
        ctx, total, _ = self.context[n]
        h, known = _find(ctx, heads)
        own = np.where(ok & known, np.maximum(counts[at] - self.discount[n], 0) / total[h], 0.0)
        return own + self.weight(n, heads) * self.prob(n - 1, codes & np.uint64((1 << 16 * (n - 1)) - 1))


class Model:
    """All languages' models in shared sorted arrays."""

    def __init__(self, langs: list[str], models: list[KneserNey], spread: list[tuple[float, float, float]]):
        self.langs, self.spread = langs, np.array(spread)
        self.limits = np.full(len(langs), UNKNOWN_Z)
        self.tables, self.weights = {}, {}
        for n in range(1, ORDER + 1):
            codes = np.unique(np.concatenate([m.grams[n][0] for m in models]))
            heads = np.unique(codes >> np.uint64(16))
            for kept, these, f in ((self.tables, codes, KneserNey.prob), (self.weights, heads, KneserNey.weight)):
                hashes = these * _MIX
                order = np.argsort(hashes)
                kept[n] = hashes[order], np.log(np.stack([f(m, n, these[order]) for m in models], 1)).astype(np.float32)
        self.unseen = np.log(np.array([[1 / m.alphabet for m in models]], np.float32))

    def logs(self, s: np.ndarray) -> np.ndarray:
        """Log-probability of every symbol in every language."""
        keys, values = self.tables[ORDER]
        h = hashed(s, ORDER)
        at, ok = _find(keys, h)
        out = values[at]
        left = np.flatnonzero(~ok)
        if len(left):
            out[left] = 0
        for n in range(ORDER, 0, -1):
            if not len(left):
                return out
            # the context's weight, then the next lower order
            heads, weights = self.weights[n]
            back = h[left] * np.uint64(pow(int(_MIX), -1, 1 << 64))
            at, ok = _find(heads, ((back & np.uint64((1 << 16 * n) - 1 if n < 4 else 2**64 - 1)) >> np.uint64(16)) * _MIX)
            out[left] += np.where(ok[:, None], weights[at], 0)
            if n == 1:
                out[left] += self.unseen
                break
            keys, values = self.tables[n - 1]
            at, ok = _find(keys, (back & np.uint64((1 << 16 * (n - 1)) - 1)) * _MIX)
            out[left] += np.where(ok[:, None], values[at], 0)
            left = left[~ok]
        return out


def _train(texts: list[str]) -> bytes:
    """Counts of four fifths of a language's sample; the others are handed on as they are, for calibration."""
    s = [x for x in map(symbols, texts) if len(x) >= ORDER]
    held = s[4::5] if len(s) >= 10 else []
    used = [x for i, x in enumerate(s) if i % 5 != 4] if held else s
    return pickle.dumps((used, held))


def limit(z: np.ndarray, rate: float = REJECT_RATE) -> float:
    """The z that a further document exceeds with a probability of rate, by that of n documents.

    It is the order statistic that a share of rate of n + 1 documents exceeds. Where n is too small for one, the largest z
    is stretched as in a tail of 1 / z^2.
    """
    n = len(z)
    if not n:
        return UNKNOWN_Z
    place = int(np.ceil((n + 1) * (1 - rate)))
    found = np.sort(z)[place - 1] if place <= n else max(z.max(), 1.0) * np.sqrt(1 / (rate * (n + 1)))
    return float(max(found, LEAST_Z))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, further: int = CALIBRATION_ROWS) -> Model | None:
    """docs: the documents (doc_id, text, lang) that may be learnt from."""
    known = ensure_columns(docs, doc_id="long", text="string", lang="string").filter("lang is not null and text is not null")
    spark = docs.sparkSession
    sizes = known.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return None
    share = spark.createDataFrame([(r.lang, min(1.0, 1.5 * rows / r["count"] + 1e-4)) for r in sizes], "lang string, share double")
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.join(F.broadcast(share), "lang").withColumn("luck", luck).filter("luck < share")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "doc_id"))
    sample = some.withColumn("place", place).filter(F.col("place") <= rows).select("lang", "place", "luck", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return pa.table({"lang": table["lang"].slice(0, 1), "luck": table["luck"].slice(len(table) - 1), "texts": pa.array([_train(table["text"].to_pylist())], pa.binary())})

    found = sorted((r.lang, *pickle.loads(bytes(r.texts)), r.luck) for r in sample.groupBy("lang").applyInArrow(run, "lang string, luck double, texts binary").toLocalIterator())
    found = [x for x in found if x[1]]
    if not found:
        return None
    alphabet = len(np.unique(np.concatenate([s for _, used, _, _ in found for s in used]))) + 1
    models = [KneserNey(used, alphabet) for _, used, _, _ in found]
    model = Model([lang for lang, _, _, _ in found], models, [(0, 1, 1)] * len(found))
    spread = []
    for k, (_, used, held, _) in enumerate(found):
        logs = [-model.logs(s)[:, k].astype(float) for s in held or used]
        means, sizes_ = np.array([x.mean() for x in logs]), np.array([len(x) for x in logs])
        mean = float(np.average(means, weights=sizes_))
        within = float(np.concatenate(logs).var())
        between = float(np.average((means - mean) ** 2, weights=sizes_))
        spread.append((mean, within, between))
    model.spread = np.array(spread)
    left_out = {lang: [_nearest(model, s)[2] for s in held] for lang, _, held, _ in found}
    count = {r.lang: r["count"] for r in sizes}
    # documents just beyond the sample's hashes; a row that is there many times counts once
    after = spark.createDataFrame([(lang, luck, luck + further / count[lang]) for lang, _, _, luck in found], "lang string, after double, until double")
    more = known.join(F.broadcast(after), "lang").withColumn("luck", luck).filter("luck > after and luck <= until").select("lang", "luck", "text")
    for r in more.mapInArrow(_measurer(spark, model), "lang string, luck double, z double").groupBy("lang", "luck").agg(F.max("z").alias("z")).collect():
        left_out[r.lang].append(r.z)
    model.limits = np.array([limit(np.array(left_out[lang])) for lang in model.langs])
    del found, models, left_out
    give_back()  # the driver's process lives on, too
    return model


def _measurer(spark: SparkSession, model: Model):
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = map(symbols, (x.as_py() for x in batch.column("text")))  # one text's symbols at a time
            z = [_nearest(sent.value, x)[2] if len(x) >= ORDER else None for x in found]
            rows = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("luck"), pa.array(z, pa.float64())], names=["lang", "luck", "z"])
            yield rows.filter(rows.column("z").is_valid())

    return trimmed(run)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs, model, False), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    return docs.mapInArrow(_scorer(docs, model, True), docs.schema)


def _scorer(docs: DataFrame, model: Model | None, keep_rows: bool):
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                out.append(_one(own, value.as_py()))
            if keep_rows:
                yield batch.filter(pa.array([not row[3] for row in out], pa.bool_()))
                continue
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([row[k] for row in out], schema.field(k + 1).type) for k in range(4))], schema=schema)

    return trimmed(run)


#: Symbols scored at once, so that a very long text needs no more memory than others.
_PART = 1 << 17


def _nearest(model: Model, s: np.ndarray) -> tuple[int, np.ndarray, float]:
    """The language of the lowest cross-entropy, every language's cross-entropy, and the z of the lowest."""
    n = len(s) - ORDER + 1
    total = np.zeros(len(model.langs))
    for at in range(0, n, _PART):
        total += model.logs(s[at : min(at + _PART, n) + ORDER - 1]).sum(0, dtype=np.float64)
    entropy = -total / n
    best = int(np.argmin(entropy))
    mean, within, between = model.spread[best]
    return best, entropy, float((entropy[best] - mean) / np.sqrt(between + 4 * within / n + 1e-12))


def _one(model: Model | None, text: str | None) -> tuple[str, float, float | None, bool]:
    s = symbols(text)
    n = len(s) - ORDER + 1
    if n <= 0 or model is None:
        return "und", 0.0, None, True
    best, entropy, z = _nearest(model, s)
    certainty = np.exp(-(entropy - entropy[best]) * min(n, EVIDENCE))
    return model.langs[best], float(1 / certainty.sum()), float(entropy[best]), bool(z > model.limits[best])


def learnable(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """Documents whose crc32(doc_id as text) mod parts isn't held_out."""
    return docs.filter(crc32_mod("doc_id", parts) != held_out)
