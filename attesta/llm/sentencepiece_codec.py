"""SentencePiece BPE encoding and decoding by a prefix table.

In BPE the encoding of every prefix of a text ends in one token only. So for each position the table holds that last
token: among the vocabulary's tokens that end there (found by an Aho-Corasick automaton) it is the one that may stand
after the last token of the prefix before it. Whether two tokens may stand together is decided by undoing their merges,
latest first, and looking for a merge across the border that would have come earlier. The ids come from walking the
table backwards. Each word (with its space) is encoded once and kept in a bounded table of the worker.

Defined results: a null text is an empty one, which has no ids and decodes to an empty text; a character that no token
starts with becomes its byte tokens; runs of spaces of any length are joined from the left as the library does;
repeated rows stay; further columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ensure_columns, trimmed

SPACE_MARK = "▁"
#: Words that a worker keeps; the older half goes when the table is full.
KEPT_WORDS = 400_000
#: The same where words are kept for one task only.
KEPT_BRIEFLY = 150_000
#: Decided pairs that a worker keeps.
KEPT_PAIRS = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


class PrefixTableCodec:
    """A BPE model file of the sentencepiece library with byte fallback and an identity normaliser."""

    def __init__(self, model_path: str):
        self.pieces: list[str] = []
        scores, kinds = [], []
        with open(model_path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, 1))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        words = [i for i, p in enumerate(self.pieces) if kinds[i] == 1]
        self.runs = {len(self.pieces[i]): i for i in words if not self.pieces[i].strip(SPACE_MARK)}
        self.id_of = {self.pieces[i]: i for i in words if len(self.pieces[i]) == 1 or self.pieces[i].strip(SPACE_MARK)}
        order = sorted((i for i in self.id_of.values() if len(self.pieces[i]) > 1), key=lambda i: -scores[i])
        self.rank = {i: -1 for i in self.id_of.values()} | {t: r for r, t in enumerate(order)}
        self.known = {c for p in self.id_of for c in p}
        self.known = {c for c in self.known if c in self.id_of}
        self.inner = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.found = ahocorasick.Automaton()
        for t in [*(i for i in self.id_of.values() if len(self.pieces[i]) == 1), *order]:
            if len(self.pieces[t]) > 1 and not self._reached(t):
                continue
            self.found.add_word(self.pieces[t], (t, len(self.pieces[t])))
        self.found.make_automaton()
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.most = KEPT_WORDS

    def _reached(self, t: int) -> bool:
        """Notes the last merge that makes t, if merging its characters ends in t."""
        left = [self.id_of.get(c) for c in self.pieces[t]]
        if None in left:
            return False
        while len(left) > 1:
            best, at, made = None, -1, -1
            for i in range(len(left) - 1):
                joined = self.id_of.get(self.pieces[left[i]] + self.pieces[left[i + 1]])
                if joined is not None and (best is None or self.rank[joined] < best):
                    best, at, made = self.rank[joined], i, joined
            if best is None:
                return False
            if len(left) == 2:
                self.split[made] = (left[0], left[1])
            left[at : at + 2] = [made]
        return left[0] == t

    def together(self, a: int, b: int) -> bool:
        """Whether a then b is how their joined text is encoded."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        x, y, rank, ok = a, b, self.rank, True
        #: Both pieces stand side by side until the merge of this rank; at that rank itself the left one wins.
        until, inclusive = len(rank) + 1, False
        while True:
            joined = self.id_of.get(self.pieces[x] + self.pieces[y])
            if joined is not None and (rank[joined] < until or (inclusive and rank[joined] == until)):
                ok = False
                break
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] > rank[y]:
                until, inclusive, x = rank[x], False, self.split[x][1]
            else:
                # equal ranks: the left of two equal merges is made first, so the right one is undone first
                until, inclusive, y = rank[y], True, self.split[y][0]
        self.pairs[a << 20 | b] = ok
        return ok

    def _known_ids(self, text: str) -> list[int]:
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        kept, together = self.pairs.get, self.together
        for end, (t, n) in self.found.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end > n:
                before = last[end - n]
                if before < 0:
                    continue
                ok = kept(before << 20 | t)
                if not (together(before, t) if ok is None else ok):
                    continue
            last[end], size[end] = t, n
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _run_ids(self, n: int) -> list[int]:
        """Ids of n spaces alone: equal scores, so the leftmost pair is joined first, again and again."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return [self.runs[s] for s in out]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text whose space marks all stand at its begin."""
        body = word.lstrip(SPACE_MARK)
        marks = len(word) - len(body)
        if not body:
            return self._run_ids(marks)
        text = SPACE_MARK * (marks > 0) + body
        if self.known.issuperset(text):
            ids = self._known_ids(text)
        else:
            ids, run = [], ""
            for c in text:
                if c in self.known:
                    run += c
                    continue
                ids += self._known_ids(run)
                ids += [self.bytes[x] for x in c.encode()]
                run = ""
            ids += self._known_ids(run)
        if marks > 1:
            alone = ids[0] == self.runs[1]
            ids = self._run_ids(marks - 1 + alone) + ids[alone:]
        return ids

    def decoded(self, ids: list[int]) -> str:
        """The ids' text with every space mark a space; for whole texts the first one is to be left out."""
        out, run = [], b""
        for i in ids:
            if i in self.byte_of:
                run += bytes([self.byte_of[i]])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = b""
            out.append(self.pieces[i].replace(SPACE_MARK, " "))
        return "".join(out) + run.decode(errors="replace")

    def kept(self, word: str) -> tuple[str, int, str]:
        if word[-1] in ",." and len(word) > 2 and self._apart(word[-2], word[-1]):
            stem, tail = [self.cache.get(w) or self.kept(w) for w in (word[:-1], word[-1])]
            out = (f"{stem[0]},{tail[0]}", stem[1] + tail[1], stem[2] + tail[2])
        else:
            ids = self.word_ids(word)
            out = (",".join(map(str, ids)), len(ids), self.decoded(ids))
        if len(self.cache) >= self.most:
            for old in list(self.cache)[: self.most // 2]:
                del self.cache[old]
        self.cache[word] = out
        return out

    def forget(self) -> None:
        """Drop the kept words and pairs."""
        self.cache.clear()
        self.pairs.clear()

    def _apart(self, a: str, b: str) -> bool:
        """Whether no token has b right after a, so that what stands before is encoded without what stands behind."""
        return (a + b) not in self.inner and a != SPACE_MARK

    def text(self, text: str | None) -> tuple[list[str], int, str]:
        """Decimal ids joined by commas, by word; their number; the decoded text."""
        if not text:
            return [], 0, ""
        words = _WORDS.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
        try:
            out = list(map(self.cache.__getitem__, words))
        except KeyError:
            known = {w: self.kept(w) for w in set(words).difference(self.cache)}
            # a word that was kept may have made room for these
            out = [known.get(w) or self.cache.get(w) or self.kept(w) for w in words]
        ids, sizes, texts = zip(*out, strict=True)
        return ids, sum(sizes), "".join(texts)[1:]


#: A word with the marks before it; a line end is one of its own, as no token holds one with what follows it.
_WORDS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")
_CODECS: dict[str, PrefixTableCodec] = {}


def codec(model_path: str) -> PrefixTableCodec:
    """One codec of a model for each worker, which keeps it from task to task."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PrefixTableCodec(model_path)
    return _CODECS[model_path]


def encode_documents(docs: DataFrame, model_path: str, digests: bool = True, keep_words: bool = True) -> DataFrame:
    """doc_id, n_tokens and, with digests, ids_sha256 and decoded_sha256, else ids and decoded.

    keep_words: whether a worker keeps encoded words from task to task, which is quicker but takes memory that other stages
    of a pipeline may want.
    """
    extra = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        own.most = KEPT_WORDS if keep_words else KEPT_BRIEFLY
        for batch in batches:
            counts, a, b = [], [], []
            for value in batch.column(1):
                ids, n, text = own.text(value.as_py())
                counts.append(n)
                joined = ",".join(ids)
                if digests:
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    b.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    a.append([int(x) for x in joined.split(",") if x])
                    b.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, schema.field(2).type), pa.array(b, pa.string())], schema=schema)
        if not keep_words:
            own.forget()

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return ensure_columns(docs, doc_id="long", text="string").mapInArrow(trimmed(run), f"doc_id long, n_tokens long, {kinds}")
