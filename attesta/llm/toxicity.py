"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is a logistic function of its hashed words; a document's is the noisy-or of its sentences' scores,
1 - prod(1 - s). Only documents have labels, so the gradient reaches the sentences through the noisy-or, in proportion
to each one's share. The sentence with the highest score is the offending one.

Defined results: a null or empty text has no sentences and the score of an empty sentence; repeated rows stay; without
labelled rows of both kinds every score is 0. Ties between sentences go to the first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_LETTER, crc32_mod, ensure_columns, flat, pieces, word_hash, words
from .learn import fitted, labelled_sample

#: Labelled rows that the model is fitted to at most.
TRAIN_ROWS = 8000
THRESHOLD = 0.7
BITS = 18
STEM = 5
TURNS = 12
RATE = 2.0
#: Training documents that a word must occur in.
LEAST_DOCUMENTS = 5
#: What each turn takes from every weight.
SHRINK = 0.3

_STOP = np.ones(256, bool)
_STOP[list(b".!?\n")] = False


def _sentences(low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slots of the words, the sentence of each, and begin, end and text of every sentence that has a word."""
    b, e, before = words(low, starts, NO_LETTER)
    slots = (word_hash(low, b, e) >> np.uint64(64 - BITS)).astype(np.int64)
    owner = np.searchsorted(before, np.arange(len(b)), "right") - 1
    # a word also counts as its stem, its first bytes
    stem = (word_hash(low, b, np.minimum(e, b + STEM)) >> np.uint64(64 - BITS)).astype(np.int64) ^ 1
    stops = np.zeros(len(low) + 1, np.int64)
    np.cumsum(~_STOP[low], out=stops[1:])
    group = stops[b]
    new = np.ones(len(b), bool)
    new[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(b))[: len(first)] - 1
    slots, sentence = np.concatenate([slots, stem]), np.concatenate([sentence, sentence])
    return slots, sentence, b[first] if len(b) else b, e[last] if len(b) else e, owner[first] if len(b) else owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(table: pa.Table) -> bytes:
    y = table["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return b""
    data, starts = flat(table["text"])
    low = LOWER[data]
    rows = []
    for a, b in pieces(starts, 1 << 20):
        slots, sentence, _, _, text = _sentences(low[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        # a word counts once in a sentence
        pairs = np.unique((sentence.astype(np.int64) << BITS) | slots)
        for i in range(b - a):
            lo, hi = map(int, np.searchsorted(text, [i, i + 1]))
            p, q = np.searchsorted(pairs, [lo << BITS, hi << BITS])
            pair = pairs[p:q] - (lo << BITS)
            rows.append((pair & ((1 << BITS) - 1), pair >> BITS, hi - lo))
    # a word of fewer documents explains a label by chance; it keeps the weight 0
    seen = np.bincount(np.concatenate([np.unique(at) for at, _, _ in rows]), minlength=1 << BITS)
    rows = [(at[own_ok], own[own_ok], n) for at, own, n in rows for own_ok in [seen[at] >= LEAST_DOCUMENTS]]
    weights, grown, bias, grown_bias = np.zeros(1 << BITS), np.full(1 << BITS, 0.3), -7.0, 10.0
    rng = np.random.default_rng(8)
    for _ in range(TURNS):
        for i in rng.permutation(len(rows)):
            at, own, n = rows[i]
            if not n:
                continue
            s = _sigmoid(np.bincount(own, weights[at], n) + bias)
            safe = np.exp(np.log1p(-np.minimum(s, 1 - 1e-12)).sum())
            # d log-likelihood / d z of each sentence, through the noisy-or
            g = s * (safe / max(1 - safe, 1e-12)) if y[i] else -s
            gw = g[own]
            np.add.at(grown, at, gw**2)
            np.add.at(weights, at, RATE * gw / np.sqrt(grown[at]))
            step = np.clip(g.sum(), -2, 2)
            grown_bias += step**2
            bias += RATE * step / np.sqrt(grown_bias)
        # soft threshold: only words that keep being needed keep a weight
        weights = np.sign(weights) * np.maximum(np.abs(weights) - SHRINK, 0)
    return pickle.dumps({"weights": weights.astype(np.float32), "bias": bias})


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, held_out: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, score, predicted, n_sentences, and the offending sentence: its number, bytes, score and text.

    held_out: (n, r) leaves documents whose crc32(doc_id as text) mod n is r out of the training.
    """
    known = docs.filter(crc32_mod("doc_id", held_out[0]) != held_out[1]) if held_out else docs
    blob = fitted(labelled_sample(known, _known_labels(labels, held_out), "toxic", train_rows), fit)
    sent = docs.sparkSession.sparkContext.broadcast(blob)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int32()), ("worst", pa.int32()), ("worst_begin", pa.int32()), ("worst_end", pa.int32()), ("worst_score", pa.float64()), ("worst_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value) if sent.value else {"weights": np.zeros(1 << BITS, np.float32), "bias": -30.0}
        for batch in batches:
            data, starts = flat(batch.column(1))
            out: list[list] = [[] for _ in range(8)]
            for a, b in pieces(starts, 1 << 20):
                part = data[starts[a] : starts[b]]
                low = LOWER[part]
                slots, sentence, begin, end, text = _sentences(low, starts[a : b + 1] - starts[a])
                if len(slots):
                    # a word counts once in a sentence
                    pair = np.unique((sentence.astype(np.int64) << BITS) | slots)
                    z = np.bincount(pair >> BITS, model["weights"][pair & ((1 << BITS) - 1)], len(begin)) + model["bias"]
                else:
                    z = np.zeros(0)
                s = _sigmoid(z)
                n = np.bincount(text, minlength=b - a)
                score = -np.expm1(np.bincount(text, np.log1p(-np.minimum(s, 1 - 1e-12)), b - a))
                score = np.where(n > 0, score, _sigmoid(np.array(model["bias"])))
                first = np.searchsorted(text, np.arange(b - a))
                order = np.lexsort((np.arange(len(s)), -s, text))
                worst = np.where(n > 0, order[np.minimum(first, max(len(s) - 1, 0))] if len(s) else 0, 0)
                for i in range(b - a):
                    w = int(worst[i])
                    none = not n[i]
                    lo = 0 if none else int(begin[w])
                    hi = 0 if none else int(end[w])
                    base = int(starts[a + i] - starts[a])
                    row = (float(score[i]), int(score[i] >= threshold), int(n[i]), None if none else w - int(first[i]), None if none else lo - base, None if none else hi - base, None if none else float(s[w]), None if none else part[lo:hi].tobytes().decode(errors="replace"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, schema.field(k + 1).type) for k, v in enumerate(out))], schema=schema)

    return ensure_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, predicted int, n_sentences int, worst int, worst_begin int, worst_end int, worst_score double, worst_text string")


def _known_labels(labels: DataFrame, held_out: tuple[int, int] | None) -> DataFrame:
    out = ensure_columns(labels, doc_id="long", toxic="int")
    return out.filter(crc32_mod("doc_id", held_out[0]) != held_out[1]) if held_out else out.filter(F.lit(True))
