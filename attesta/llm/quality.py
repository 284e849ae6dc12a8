"""Quality rules: plain counts of a text, and a logistic regression on hashed n-grams with calibrated probabilities.

The regression sees hashed words, hashed character 4-grams and shape ratios of a text. It is fitted to a bounded
sample of labelled rows (TRAIN_ROWS), its margin is turned into a probability by Platt scaling on rows that the fit
didn't see, and the probability is held against a fixed threshold.

Defined results: a null text is an empty one: all counts 0, base_failed true and kept false. Repeated rows stay. Without
any labelled rows of both kinds, or with an empty table, the regression keeps what passes the base rules.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, NO_LETTER, SPACE, ensure_columns, flat, gram_hash, mix, pieces, word_hash, words
from .learn import fitted, labelled_sample

#: Labelled rows that the regression is fitted to at most.
TRAIN_ROWS = 4000
#: Kept from this calibrated probability of quality 1 on.
THRESHOLD = 0.5
BITS = 16
MIN_WORDS = 50
MAX_REPEATED = 50

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = (((np.arange(256) & 0xC0) != 0x80) & ~SPACE).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def _repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether an equal key of the same owner is there twice, and whether it isn't the first such."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    got = own[order]
    same = got[1:] == got[:-1]
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def base_counts(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    begin, end, before = words(data, starts)
    n_words = np.diff(before)
    out = {"n_words": n_words, "word_chars": _sums(_POINT[data], starts), "n_symbols": _sums(_SYMBOL[data], starts)}
    texts = len(starts) - 1
    # lines
    cut = np.flatnonzero(data == 10)
    line_begin = np.unique(np.concatenate([starts[:-1][np.diff(starts) > 0], cut + 1]))
    line_begin = line_begin[line_begin < len(data)]
    line_end = np.append(line_begin[1:], len(data))[: len(line_begin)]
    line_end = line_end - (data[line_end - 1] == 10)
    word_bytes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=word_bytes[1:])
    has = word_bytes[line_end] > word_bytes[line_begin]
    line_begin, line_end = line_begin[has], line_end[has]
    owner = np.searchsorted(starts, line_begin, "right") - 1
    _, later = _repeated(owner, word_hash(data, line_begin, line_end))
    out["n_dup_lines"] = np.bincount(owner[later], minlength=texts)
    # three words in a row
    h = word_hash(data, begin, end)
    owner = np.searchsorted(before, np.arange(len(h)), "right") - 1
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        three = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:]
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        twice, _ = _repeated(owner[inside], three[inside])
        at = inside[twice]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=texts)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _items(data: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For words and for character 4-grams the items' weight numbers and where each text's begin; and the shape ratios."""
    counts = base_counts(data, starts)
    low = LOWER[data]
    begin, end, before = words(low, starts, NO_LETTER)
    slots = (word_hash(low, begin, end) >> np.uint64(64 - BITS)).astype(np.int64)
    grams = (mix(gram_hash(low, 4)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    size = np.maximum(np.diff(starts), 1)
    n = np.maximum(counts["n_words"], 1)
    letters = _sums((~NO_LETTER[data]).astype(np.int64), starts)
    upper = _sums(((data >= 65) & (data <= 90)).astype(np.int64), starts)
    lines = _sums((data == 10).astype(np.int64), starts) + 1
    shape = np.stack([np.ones(len(n)), np.log1p(counts["n_words"]) / 8, 8 * counts["n_symbols"] / size, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / n, letters / size, upper / size, counts["word_chars"] / n / 16], 1)
    return [(slots, before), (grams, starts)], shape


def _margins(data: np.ndarray, starts: np.ndarray, model: dict) -> np.ndarray:
    lists, shape = _items(data, starts)
    out = shape @ model["shape"]
    for at, first in lists:
        values = model["weights"][at].astype(np.float64)
        out += _sums(values, first) / np.maximum(np.diff(first), 1)
    return out


def fit(table: pa.Table) -> bytes:
    """Adagrad over the sample's texts, then Platt scaling on every fifth one; empty without both labels."""
    y = table["label"].to_numpy().astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return b""
    data, starts = flat(table["text"])
    rows = []
    for a, b in pieces(starts, 1 << 20):
        own = starts[a : b + 1] - starts[a]
        lists, shape = _items(data[starts[a] : starts[b]], own)
        for i in range(b - a):
            at, value = [], []
            for slots, first in lists:
                u, n = np.unique(slots[first[i] : first[i + 1]], return_counts=True)
                at.append(u)
                value.append(n / max(n.sum(), 1))
            rows.append((np.concatenate(at), np.concatenate(value), shape[i]))
    check = np.arange(len(y)) % 5 == 4
    weights, grown = np.zeros(2 << BITS), np.full(2 << BITS, 1e-3)
    flatw, flatg = np.zeros(rows[0][2].shape), np.full(rows[0][2].shape, 1e-3)
    train, rng = np.flatnonzero(~check), np.random.default_rng(5)
    for _ in range(6):
        for i in rng.permutation(train):
            at, value, shape = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weights[at] @ value + flatw @ shape, -30, 30))) - y[i]
            gw = g * value
            grown[at] += gw * gw
            weights[at] -= 0.3 * gw / np.sqrt(grown[at])
            gs = g * shape
            flatg += gs * gs
            flatw -= 0.1 * gs / np.sqrt(flatg)
    margins = np.array([weights[at] @ value + flatw @ shape for at, value, shape in rows])
    m, t = margins[check], y[check]
    if t.min() == t.max():
        m, t = margins, y
    # Platt: smoothed targets, Newton steps with a ridge
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[v @ (m * m) + 1e-3, v @ m], [v @ m, v.sum() + 1e-3]])
        step = np.linalg.solve(h, [r @ m + 1e-3 * (a - 1), r.sum()])
        a, b = a - step[0], b - step[1]
    return pickle.dumps({"weights": weights.astype(np.float32), "shape": flatw, "a": max(a, 1e-3), "b": b})


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, quality (the probability, null without a model) and kept."""
    blob = fitted(labelled_sample(docs, labels, "quality", train_rows), fit)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())])
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value) if sent.value else None
        for batch in batches:
            data, starts = flat(batch.column(1))
            found: dict[str, list] = {n: [] for n in [*names, "quality"]}
            for a, b in pieces(starts, 1 << 20):
                own, part = starts[a : b + 1] - starts[a], data[starts[a] : starts[b]]
                for k, v in base_counts(part, own).items():
                    found[k].append(v)
                found["quality"].append(1 / (1 + np.exp(-np.clip(model["a"] * _margins(part, own, model) + model["b"], -30, 30))) if model else np.full(b - a, np.nan))
            got = {k: np.concatenate(v) if v else np.zeros(0) for k, v in found.items()}
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED * got["n_words"])
            kept = ~failed & ((got["quality"] >= threshold) | (model is None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[n], pa.int64()) for n in names), pa.array(failed), pa.array(got["quality"], pa.float64(), from_pandas=True), pa.array(kept)], schema=schema)

    kinds = ", ".join(f"{n} long" for n in names)
    return ensure_columns(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, quality double, kept boolean")
