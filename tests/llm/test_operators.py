import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import components, jaccard_join, langid, mixing, pitman_yor, quality, queries, sentencepiece_codec, suffix_dedup, token_files, topk, toxicity

from . import brute

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def labels(spark, ids, **columns):
    return spark.createDataFrame([(i, *(f(i) for f in columns.values())) for i in ids], ", ".join(["doc_id long", *(f"{c} int" for c in columns)]))


# --- 1


def test_suffix_dedup(nasty):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(nasty).collect())
    assert got == sorted(brute.suffix_dedup(pairs(nasty)))
    left = suffix_dedup.remove_repeats(nasty, texts=True)
    assert set(left.columns) >= {"lang", "source", "score", "comp", "text"}
    kept = {r.doc_id: r for r in left.collect()}
    assert hashlib.sha256(kept[43].text.encode()).hexdigest() == kept[43].kept_sha256 and kept[1].text == ""


def test_suffix_dedup_odd_tables(odd, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert sorted(map(str, got)) == sorted(str(r[:3]) for r in brute.suffix_dedup(pairs(odd)))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    copied, own = "the same words in both of these rows, more than fifty bytes of them", "another text of the same number, which nothing else has in it at all, long enough"
    table = spark.createDataFrame([(1, copied, 3, 4), (2, copied, 5, 6), (2, own, 7, 8)], "doc_id long, text string, chunk int, N_Bytes int")
    got = suffix_dedup.remove_repeats(table, texts=True)
    assert got.columns == ["doc_id", "text", "chunk", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((r.doc_id, r.text, r.chunk, r.n_removed) for r in got.collect()) == sorted([(1, copied, 3, 0), (2, "", 5, len(copied)), (2, own, 7, 0)])


def test_frequent_beginnings_are_split(spark):
    rng = np.random.default_rng(3)
    common = [b"https://www.site" + bytes(rng.integers(97, 123, 16).astype(np.uint8)) for _ in range(3000)]
    other = [bytes(rng.integers(0, 256, 32).astype(np.uint8)) for _ in range(1000)]
    cuts = suffix_dedup._splitters(spark.createDataFrame([(bytearray(a),) for a in common + other], "a binary"), 16)
    at = suffix_dedup.bucket(np.array(common + other, "S32"), np.array(cuts, "S32"))
    assert np.bincount(at).max() < 400 and cuts == sorted(cuts)
    assert suffix_dedup._splitters(spark.createDataFrame([], "a binary"), 16) == []


def test_multikey_quicksort_groups_equal_strings():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 2, 500).astype(np.uint64) for _ in range(7)]
    at, run = suffix_dedup.equal_strings(500, 7, lambda k, at: words[k][at])
    strings = list(zip(*words, strict=True))
    many = Counter(strings)
    assert sorted(at) == [i for i, s in enumerate(strings) if many[s] > 1]
    for r in np.unique(run):
        assert len({strings[i] for i in at[run == r]}) == 1
    splitters = np.array([5, 9], np.uint64)
    assert list(suffix_dedup.bucket(np.array([4, 5, 5, 8, 9], np.uint64), splitters)) == [0, 1, 1, 1, 2]


def test_one_long_text_in_parts():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5_000_000).astype(np.uint8)
    s = suffix_dedup.suffixes(data, np.array([0, len(data)]))
    # every start is covered once
    assert s["first"][0] == 0 and s["last"].max() == len(data) - suffix_dedup.LENGTH
    order = np.argsort(s["first"])
    assert (s["first"][order][1:] == s["last"][order][:-1] + 1).all()


# --- 2


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs, langid.train(langid.learnable(docs))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.02


def test_language_id_rejects_what_it_never_saw(spark):
    import random

    rng = random.Random(9)

    def language(letters):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(150)]
        return lambda n: " ".join(rng.choice(words) for _ in range(n))

    own, other, left_out = language("abcdefghiklmnorst"), language("aeiouklmnprst"), language("abdefgilmnoprstuvz")
    rows = [(i, f(rng.randint(20, 200)), lang) for i, (f, lang) in enumerate([(own, "aa"), (other, "bb")] * 500)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200, 300)
    clean = [own(rng.randint(20, 200)) for _ in range(300)] + [other(rng.randint(20, 200)) for _ in range(300)]
    rejected = lambda texts: np.mean([langid._one(model, t)[3] for t in texts])
    assert rejected(clean) < 0.02
    assert rejected(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) for _ in range(50)]) == 1
    assert rejected(["".join(rng.choice("абвгдежзийклмнопр ") for _ in range(30)) for _ in range(50)]) == 1
    assert rejected([left_out(30) for _ in range(50)]) > 0.9


def test_language_id_limit():
    z = np.arange(1000.0)
    assert np.mean(z > langid.limit(z, 0.01)) <= 0.01 and langid.limit(z, 0.01) < 992
    assert langid.limit(np.array([3.0]), 0.005) == pytest.approx(30) and langid.limit(z[:0]) == langid.UNKNOWN_Z


def test_language_id_edge_cases(nasty, odd, empty):
    model = langid.train(langid.learnable(nasty))
    got = {r.doc_id: r for r in langid.identify(nasty, model).collect()}
    for i in (40, 41, 42):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[54].lang_pred == "und" and got[47].lang_pred in model.langs
    assert langid.accepted(nasty, model).columns == nasty.columns
    assert langid.identify(odd, model).count() == odd.count()
    assert langid.train(empty) is None and {r.lang_pred for r in langid.identify(nasty, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_kneser_ney_sums_to_one():
    texts = [langid.symbols(t) for t in ("the cat sat on the mat", "the hat", "a cat")]
    m = langid.KneserNey(texts, 30)
    symbols = np.unique(np.concatenate(texts))
    head = langid.symbols("th")[-4:-1]
    codes = np.array([(int(head[0]) << 48) | (int(head[1]) << 32) | (int(head[2]) << 16) | int(s) for s in symbols], np.uint64)
    total = m.prob(4, codes).sum()
    assert total <= 1 + 1e-9 and total > 0.5


# --- 3


def test_sentencepiece_is_the_library(nasty, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for table in (nasty, odd):
        got = sentencepiece_codec.encode_documents(table, PIECES).collect()
        want = []
        for i, t in pairs(table):
            ids = library.encode(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = sentencepiece_codec.encode_documents(nasty, PIECES, digests=False).filter("doc_id = 43").first()
    assert whole.ids == library.encode("one") and whole.decoded == "one"
    assert sentencepiece_codec.encode_documents(empty, PIECES).count() == 0


def test_sentencepiece_random_texts():
    import random

    import sentencepiece

    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.codec(PIECES), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abcdetnoirs  ▁\n\tAB12.,'é😀ü日本\r;(){}<>0x") for _ in range(rng.randint(0, 40)))
        ids, n, decoded = own.text(text)
        ids = [int(x) for x in ",".join(ids).split(",") if x]
        assert ids == library.encode(text) and n == len(ids) and decoded == library.decode(ids)


# --- 4


def test_language_model(nasty, odd, empty):
    for table in (nasty, odd):
        docs = pairs(table)
        count = Counter(w for i, t in docs if not brute.held(i, 7, 2) for w in brute.words(t))
        total, distinct = sum(count.values()), len(count)
        got = pitman_yor.score_documents(table).collect()
        assert len(got) == len(docs)
        want = sorted((str(i), len(w := brute.words(t)), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), 6)) for i, t in docs)
        assert [(a, b, c) for a, b, c, _ in sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)] == [x[:3] for x in want]
        assert sum(r.base_score for r in got) == pytest.approx(sum(x[3] for x in want), rel=1e-6)
        assert all(r.train_tokens == total and r.score <= 0 and r.held_out == brute.held(r.doc_id, 7, 2) for r in got)
    assert pitman_yor.score_documents(empty).count() == 0


def test_language_model_scores_are_a_plain_models(nasty):
    """The same model with dictionaries, one document after the other."""
    docs = [(i, brute.words(t)) for i, t in pairs(nasty)]
    d, one = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    count, pair, triple, contexts = Counter(), Counter(), Counter(), Counter()
    for i, w in docs:
        if not brute.held(i, 7, 2):
            count.update(w)
            pair.update(zip([None, *w], w))
            triple.update(zip([(), *zip([None, *w], w)], zip([None, *w], w)))
            contexts.update([(), *zip([None, *w], w)][:-1])
    n, v = sum(count.values()), len(count)
    seats = lambda c, m: float(pitman_yor.seat(np.array([c]), pitman_yor._rounded(np.array([m])), d)[0])
    above3 = lambda c: contexts[c]
    t3 = {k: seats(c, (one + d * above3(k[0]) ** 0.75) * min(max(pair[k[1]], 1) / max(count[k[1][0]], 1), 1)) for k, c in triple.items()}
    c2, big3, c1, big2, in2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for (u, p), t in t3.items():
        c2[p] += t
        big3[u] += t
    c2 = {p: max(round(t), 1) for p, t in c2.items()}
    t2 = {p: seats(c, (one + d * count[p[0]] ** 0.75) * max(count[p[1]], 1) / n) for p, c in c2.items()}
    for (u, w), t in t2.items():
        c1[w] += t
        big2[u] += t
        in2[u] += c2[u, w]
    c1 = {w: max(round(t), 1) for w, t in c1.items()}
    root = {w: float(pitman_yor.seat(np.array([c]), np.array([(1 + d * v) / (v + 1)]), d)[0]) for w, c in c1.items()}

    def prob(u, p):
        a = (c1.get(p[1], 0) - d * root.get(p[1], 0) + (1 + d * sum(root.values())) / (v + 1)) / (1 + sum(c1.values()))
        b = (c2.get(p, 0) - d * t2.get(p, 0) + (one + d * big2[p[0]]) * a) / (one + in2[p[0]])
        return (triple[u, p] - d * t3.get((u, p), 0) + (one + d * big3[u]) * b) / (one + above3(u))

    want = {i: sum(math.log10(prob(u, p)) for u, p in zip([(), *zip([None, *w], w)], zip([None, *w], w))) for i, w in docs}
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(nasty).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=2e-3, abs=0.02)
    # a context's probabilities sum to one at most
    for u, p in list(triple)[:5]:
        assert sum(prob(u, (p[0], w)) for w in count) <= 1 + 1e-9


def test_seating():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 50, 10_000])
    t = pitman_yor.seat(c, np.array([1.0, 1.0, 1.0, 1e-6, 50.0, 1.0]), 0.7, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and t[3] < 1.5 < 10 < t[4] < 50 and 1 < t[5] < 100


def test_seating_is_what_whole_sweeps_reach():
    def exact(c, m, d=0.7):
        # weights of 0 to c tables, customer by customer
        w = np.array([0.0, 1.0])
        for n in range(1, c):
            w = np.append(w * np.maximum(n - d * np.arange(len(w)), 0), 0) + np.append(0, w * m)
            w /= w.sum()
        return w @ np.arange(len(w))

    def sampled(c, m, rng, d=0.7, sweeps=300):
        table, size, total = np.zeros(c, int), {0: c}, 0
        for sweep in range(sweeps):
            for who in range(c):
                size[table[who]] -= 1
                size = {t: k for t, k in size.items() if k}
                names, weights = [*size, max(size, default=0) + 1], np.array([*(k - d for k in size.values()), m])
                table[who] = rng.choice(names, p=weights / weights.sum())
                size[table[who]] = size.get(table[who], 0) + 1
            total += len(size) * (sweep >= sweeps // 6)
        return total / (sweeps - sweeps // 6)

    cases = [(2, 1.0), (5, 0.01), (63, 3.0), (64, 3.0), (200, 2.0), (1000, 10.0), (4000, 50.0), (4000, 117.0), (4096, 117.0), (9000, 117.0), (9000, 1e-6)]
    got = pitman_yor.seat(*map(np.array, zip(*cases, strict=True)), 0.7)
    assert got == pytest.approx([exact(c, m) for c, m in cases], rel=1e-6)
    assert got[4] == pytest.approx(sampled(200, 2.0, np.random.default_rng(3)), rel=0.15)
    huge = pitman_yor.seat(np.array([10**9, 10**6]), np.array([5.0, 0.7]), 0.7)
    assert huge == pytest.approx([1 + 5 / 0.7, 2], rel=1e-3)


def test_seatings_are_drawn_from_their_law():
    luck = (np.arange(5000) + 0.5) / 5000
    for c, m in [(2, 1.0), (5, 0.01), (63, 3.0), (200, 2.0), (1000, 10.0), (9000, 100.0), (500, 200.0)]:
        w = np.array([0.0, 1.0])
        for n in range(1, c):
            w = np.append(w * np.maximum(n - 0.7 * np.arange(len(w)), 0), 0) + np.append(0, w * m)
            w /= w.sum()
        mean = w @ np.arange(len(w))
        t = pitman_yor.draw(np.full(5000, c), np.full(5000, m), 0.7, luck)
        assert t.mean() == pytest.approx(mean, rel=0.006)
        assert t.std() == pytest.approx(np.sqrt(w @ (np.arange(len(w)) - mean) ** 2), rel=0.02)
    # sweeps of a restaurant of two customers with strength 1, whose parent has the dish with 0.3
    n, rng, d = 20_000, np.random.default_rng(2), 0.7
    c, t, keys = np.full(n, 2), np.ones(n, np.int64), np.arange(n, dtype=np.uint64)
    for k in range(15):
        new = d * pitman_yor.rate(t, 1.0, d, keys, 100 + k)
        t = pitman_yor.move(c, t, new * 0.3, d, rng.random(n), rng.random(n))
    one, two = (1 - d) * 0.3, (1 + d) * 0.3**2
    assert t.mean() == pytest.approx((one + 2 * two) / (one + two), abs=0.012)


def test_language_model_samples_its_seating(spark, nasty, monkeypatch):
    """The query's scores come from sweeps; a dish is seated alike in all chunks, so that chunks don't matter."""
    scores = lambda **k: {r.doc_id: r.score for r in pitman_yor.score_documents(nasty, **k).collect()}
    start, swept = scores(), scores(sweeps=1)
    assert all(x <= 0 for x in swept.values()) and sum(abs(swept[i] - start[i]) for i in start) > 1
    monkeypatch.setattr(pitman_yor, "CHUNKS", 5)
    assert scores(sweeps=1) == pytest.approx(swept, rel=1e-9)
    asked = []
    monkeypatch.setattr(pitman_yor, "score_documents", lambda docs, **k: asked.append(k))
    queries.QUERIES["op4_language_model"](spark, "/root/testdata/sf0.001")
    assert asked[0]["sweeps"] >= 1


def test_language_model_passes_are_lean():
    """Passes over a chunk read tokens, not texts; a pair of many chunks is answered in the same few bits as one of two."""
    docs = pa.table({"doc_id": [7, 3, None], "text": ["a b a b", None, "B"], "chunk": pa.array([5] * 3, pa.int32()), "train": [True, False, True]})
    row = pitman_yor._tokenise(docs)
    own = pitman_yor._Chunk(row, 3)
    assert len(row) == 1 and own.chunk == 5 and own.doc_id.to_pylist() == [3, 7, None]
    assert own.sizes.tolist() == [1, 5, 2] and own.held_out.to_pylist() == [True, False, False]
    assert sorted(own.word_count.tolist()) == [2, 2, 3] and len(own.pair.keys) == 6 and own.pair_count.sum() == 7
    keys, counts = pitman_yor._pack_keys(np.array([5 << 16], np.uint64)), pitman_yor._pack_counts(np.array([2]))
    told = [pitman_yor._counts(x)[0] for x in pitman_yor._add_counts(pitman_yor._table([(k, pitman_yor._PAIR, 0, 0, 0.0, keys, counts) for k in range(300)]))["b"].to_pylist()]
    assert told == [5] + [4] * 299


def test_language_model_sweeps_read_only_what_occurs_again():
    """What occurs once has one customer and one table in every sweep, so sweeps are given the rest and sums of it."""
    docs = pa.table({"doc_id": [1, 2, 3], "text": ["a b c", "a b d", "x y"], "chunk": pa.array([5] * 3, pa.int32()), "train": [True] * 3})
    row = pitman_yor._tokenise(docs)
    counts = pitman_yor._add_counts(pitman_yor._send_counts(1)(row))
    kept = pitman_yor._keep(1)(row, counts).select(["chunk", "words", "kept", "first"])
    root = pitman_yor._Root(11, 7, 4)
    own = pitman_yor._Kept(kept, 1, root, 0)
    assert sorted(own.count.tolist()) == [2, 2, 3] and own.pair_count.tolist() == [2, 2] and own.c3.tolist() == [2, 2]
    assert own.pair_keys.tolist() == pitman_yor._pair_keys(own.word.keys, own.left, own.right).tolist()
    sent = pitman_yor._send_customers(1, root, 0)(kept)
    assert sent["x"].to_pylist()[-1] in (2.0, 3.0)  # tables before texts' first tokens: one or two of "a", one of "x"
    told = pitman_yor._send_tables(1, root, 0)(kept, pitman_yor._add_customers(0)(sent))
    assert len(told) == 2 and len(pitman_yor._keys(told["a"][0].as_py())) == 3



# --- 10 and the pipeline


def test_postings_meet_their_ngrams_once(nasty, monkeypatch):
    """Frequent and rare n-grams are told apart by a column, not by a join of all postings for each."""
    plans, stage = [], jaccard_join.stage

    def noted(df, *args, **kinds):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, *args, **kinds)

    monkeypatch.setattr(jaccard_join, "stage", noted)
    jaccard_join.join_documents(nasty)
    assert plans and not any("LeftSemi" in p for p in plans)


def test_training_gives_the_drivers_memory_back(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(1))
    assert langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet")) and given


# --- 5, 8


def test_quality(spark, nasty, odd, empty):
    marks = labels(spark, range(40), quality=lambda i: int(i < 30))
    for table in (nasty, odd):
        got = quality.score_documents(table, marks).collect()
        want = sorted(str((i, *brute.quality_counts(t))) for i, t in pairs(table))
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.score_documents(empty, marks).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.n_words, r.base_failed, r.kept) for r in quality.score_documents(blank, marks).collect()] == [(0, True, False)] * 3
    none = quality.score_documents(nasty, marks.limit(0)).collect()
    assert all(r.quality is None and r.kept != r.base_failed for r in none)


def test_quality_accuracy(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, marks).drop("kept").withColumnRenamed("quality", "p").join(marks, "doc_id").collect()
    assert np.mean([(r.p >= 0.5) == (r.quality == 1) for r in got]) > 0.9


def test_toxicity(spark, nasty, odd, empty):
    rng = np.random.default_rng(1)
    plain = ["sun", "rain", "tree", "house", "river", "stone", "cloud", "grass"]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[i % 5] += " vile"
        rows.append((i, ". ".join(sentences)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_documents(docs, labels(spark, range(400), toxic=lambda i: int(i % 4 == 0)), held_out=(3, 1)).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all("vile" in r.worst_text and r.worst == r.doc_id % 5 for r in got if r.predicted)
    assert toxicity.score_documents(odd, labels(spark, [], toxic=int)).filter("score > 0.01").count() == 0
    assert toxicity.score_documents(nasty, labels(spark, range(30), toxic=lambda i: i % 2)).count() == nasty.count()
    assert toxicity.score_documents(empty, labels(spark, [], toxic=int)).count() == 0


# --- 6


def test_token_files(spark, nasty, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    path, index = token_files.export(nasty, BYTES, 2, f"file://{tmp_path}/a")
    got, start = sorted(index.collect(), key=lambda r: r.start), 0
    for r, (i, t) in zip(got, sorted(pairs(nasty)), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # shuffled reads by the index
    one = got[20]
    name = next(p for p in (tmp_path / "a/shards").iterdir() if p.name.startswith(f"part-{one.shard:05d}"))
    raw = name.read_bytes()[one.offset : one.offset + one.length]
    (_, length, doc_id, ids), *more = token_files.frames(raw)
    assert (length, doc_id, len(ids) // 2, more) == (one.length, one.doc_id, one.n_tokens, [])
    torn = bytearray(raw)
    torn[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.frames(bytes(torn)))
    assert any(x >= 0x80 for x in raw)
    assert token_files.export(odd, BYTES, 2)[1].count() == odd.count()
    assert token_files.export(empty, BYTES, 2)[1].count() == 0


def test_added_tokens_are_the_librarys():
    import random

    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(BYTES), token_files.CachedTokenizer(BYTES), random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "b,", "é", "1", "\u3000"]) for _ in range(rng.randint(0, 12)))
        assert list(np.frombuffer(own.encode(text), own.type)) == library.encode(text, add_special_tokens=False).ids


# --- 7


def test_new_words_are_encoded_in_rows(monkeypatch):
    """Texts together give the library's ids, also when kept words are pushed out; few calls encode many new words."""
    own = token_files.CachedTokenizer(BYTES)
    texts = ["", " ", "one two", " one\n\n two  three ", "a<|endoftext|> b c", *(f"é{k} w{k}x, v{k}.  u{k}" for k in range(500))]
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, own.type).tolist() for x in own.encode_all(texts)] == want
    assert own.width is not None and " u7" not in own._in_rows([" u7", " u8", "x"])
    monkeypatch.setattr(token_files, "KEPT_WORDS", 700)
    monkeypatch.setattr(token_files, "TOGETHER", 300)
    assert [np.frombuffer(x, own.type).tolist() for x in own.encode_all(texts)] == want


def test_mixing(nasty, odd, empty):
    got = mixing.mix(nasty).collect()
    assert len(got) == nasty.count() and all(0 <= r.prob <= 1 for r in got)
    cells = {(r.mix_source, r.mix_lang, r.mix_topic): r.weight for r in got}
    assert sum(cells.values()) == pytest.approx(1, abs=0.05)
    assert {r.mix_source for r in got} >= {"(none)", "a"}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0


def test_mixing_to_given_targets(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice("ab"), rng.choice(["en", "de", "fr"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"mix_source": {"a": 3, "b": 1}, "mix_lang": {"en": 0.5, "de": 0.5}}
    cells = mixing.features(docs).groupBy(*mixing.MARGINS).agg(F.sum("mix_tokens").alias("tokens"))
    for r in mixing.margins(cells, targets=targets).collect():
        assert r.share == pytest.approx(r.target, abs=1e-6)
    # what can be kept without going beyond what there is: the plain ratios come out
    got = mixing.mix(docs, keep=0.3, targets=targets).filter("kept").groupBy("mix_source").agg(F.sum("mix_tokens").alias("n")).collect()
    share = {r.mix_source: r.n for r in got}
    assert share["a"] / sum(share.values()) == pytest.approx(0.75, abs=0.05)
    assert mixing.sample(docs, keep=0.3, targets=targets).filter("lang = 'fr'").count() == 0
    with pytest.raises(ValueError, match="no such margin"):
        mixing.mix(docs, targets={"language": {}})


def test_mixing_leaves_clashing_columns(spark):
    names = ["weight", "prob", "KEPT", "mix_topic", "chunk", "tokens", "row"]
    docs = spark.createDataFrame([(i, "a b", "s", "en", *range(len(names))) for i in range(9)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} int" for n in names))
    own = mixing.sample(docs, keep=1.0)
    assert own.columns == docs.columns and all(tuple(r)[4:] == tuple(range(len(names))) for r in own.collect())
    got = mixing.mix(docs)
    assert got.columns.count("weight") == 1 and {"chunk", "tokens", "row", "kept"} <= set(got.columns) and got.count() == 9


# --- 9


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 8)).round(2)
    v[300:420] = v[300]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, []), (None, [1.0] * 8), (800, [1.0] * 3), (801, [2.0] * 3), (5, [9.0] * 8)]
    own = topk.scaled(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string"))
    got = [tuple(r) for r in topk.search(own.filter("vec_id % 100 = 0"), own, 10, block=64, query_block=3).collect()]
    kept = [(i, np.floor(np.array(x, np.float32).astype(float) * 1024).astype(int)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    want = []
    for q, a in kept:
        if q % 100 == 0:
            found = sorted((-int(a @ b), i) for i, b in kept if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(got) == sorted(want)
    none = own.limit(0)
    assert topk.search(none, own, 10).count() == topk.search(own, none, 10).count() == 0


def test_nra_stops_early_where_it_can():
    rng = np.random.default_rng(7)
    v = np.abs(rng.normal(size=(400, 2))) * 1024 // 1
    v[7] = 9000
    found, read = topk.nra(np.array([[1.0, 1.0]]), np.array([-1]), v, np.arange(400), 1)
    assert found[0][1] == 7 and read < 0.2
    # signs, ties and fewer candidates than k
    v = rng.integers(-3, 4, (300, 5)).astype(float)
    for q in rng.integers(-3, 4, (30, 5)).astype(float):
        got, _ = topk.nra(q[None], np.array([4]), v, np.arange(300), 7)
        want = sorted((-int(x @ q), i) for i, x in enumerate(v) if i != 4)[:7]
        assert [(-s, i) for _, i, s in got] == want
    assert len(topk.nra(v[:1], np.array([0]), v[:5], np.arange(5), 7)[0]) == 4


def test_top_k_reads_less_than_the_lists(spark, sf_dir):
    own = topk.scaled(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet"))
    row = topk.counters(own.filter("vec_id % 100 = 0"), own, 10).first()
    assert 0 < row.entries_read < row.entries


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), *((i, [float(i), 1.0]) for i in range(1, 8)), (5, [5.0, 1.0])]
    own = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.rank, r.vec_id) for r in topk.search(own.filter("vec_id = 0"), own, 4).orderBy("rank").collect()]
    # one query, the vector that sorts first; the candidate that is there twice counts twice
    assert got[0] == (1, 7) and [r for r, _ in got] == [1, 2, 3, 4] and [i for _, i in got] == [7, 6, 5, 5]


# --- 10


def test_jaccard_join(nasty, odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(nasty).collect()}
    want = brute.jaccard_components(pairs(nasty))
    assert {i: (n, c) for i, (n, c) in want.items() if n} == {i: x for i, x in got.items() if x[0]}
    assert all(got[i] == (0, i) for i in (40, 41, 42))
    rows = jaccard_join.join_documents(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.n_shingles} == {0}
    assert jaccard_join.join_documents(empty).count() == 0


def test_jaccard_join_counts_every_link(spark, nasty, monkeypatch):
    docs = {i: t for i, t in pairs(nasty)}
    # near copies with a common passage: one family; small blocks make several cells
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(90)]
    for i in range(100, 160):
        w = list(base)
        for k in rng.integers(0, 90, 1 + i % 3):
            w[k] = f"own{i}"
        docs[i] = " ".join(w)
    docs[160] = docs[100]
    sets = {i: brute.shingles(t) for i, t in docs.items()}
    distinct = [s for s in set(sets.values()) if s]
    want = {s: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in distinct) for s in distinct}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for block in (jaccard_join.BLOCK, 8):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {r.doc_id: r.n_links for r in jaccard_join.join_documents(table).collect()}
        assert got == {i: want.get(s, 0) for i, s in sets.items()}
    assert max(want.values()) > 24


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.v: r.comp for r in components.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[102] == 100
    assert components.components(edges.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, nasty, tmp_path):
    import corpus_pipeline as p

    docs = nasty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in p.STAGES:
        docs = f(spark, docs, "")
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != p.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            accepted = pairs(docs)
            assert len(accepted) >= 45 and {40, 41, 42}.isdisjoint(i for i, _ in accepted)
        if name == "near_duplicates":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            want = brute.jaccard_components(accepted)
            assert ids == {i for i, (n, c) in want.items() if i == c}
            single = pairs(docs)
        if name == "repeated_strings":
            want = {r[0]: r[4] for r in brute.suffix_dedup(single) if r[2] == 0 or r[2] < r[1]}
            cleaned = {r.doc_id: r for r in docs.collect()}
            assert cleaned.keys() == want.keys() and all(r.n_chars == len(r.text) for r in cleaned.values())
            # a digest is of the remaining bytes; texts that were cut within a character are left out of the comparison
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[i] for i, r in cleaned.items() if i != 47)
        if name == "mixture":
            mixed = {r.doc_id: r for r in docs.collect()}
            probs = {r.doc_id: (r.prob, r.mix_luck) for r in mixing.mix(spark.createDataFrame(list(cleaned.values()))).collect()}
            assert mixed == {i: r for i, r in cleaned.items() if probs[i][1] < probs[i][0]}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.keys() == mixed.keys() and len(got) > 5
    for i, r in mixed.items():
        ids = library.encode(r.text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_every_operator_takes_odd_columns(spark):
    """Columns with the names that operators use, in texts that are all null or empty, and in plain ones."""
    names = ["weight", "prob", "kept", "mix_topic", "chunk", "tokens", "row", "grp", "score", "train", "n_bytes", "sign", "v", "seq", "h", "label"]
    for texts in ([None, "", None], ["one two three four five six", "uno dos tres", "one two three four five six"]):
        rows = [(i, t, "en", "s", *range(len(names))) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
        marks = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
        assert suffix_dedup.remove_repeats(docs).count() == 3
        assert langid.identify(docs, langid.train(langid.learnable(docs))).count() == 3
        assert langid.accepted(docs, langid.train(langid.learnable(docs))).columns == docs.columns
        assert sentencepiece_codec.encode_documents(docs, PIECES).count() == 3
        assert pitman_yor.score_documents(docs).count() == 3
        assert quality.score_documents(docs, marks).count() == 3
        assert token_files.export(docs, BYTES, 2)[1].count() == 3
        assert mixing.sample(docs, keep=1.0).columns == docs.columns
        assert toxicity.score_documents(docs, marks).count() == 3
        assert jaccard_join.join_documents(docs).count() == 3


def test_accuracy_on_rows_that_were_not_learnt_from(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda n, r: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == r
    got = langid.identify(docs, langid.train(langid.learnable(docs))).filter(held(4, 2)).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    scored = toxicity.score_documents(docs, marks, held_out=(3, 1)).filter(held(3, 1)).join(marks.filter("toxic is not null"), "doc_id").collect()
    assert len(scored) > 20 and np.mean([r.predicted == r.toxic for r in scored]) > 0.9
    even = marks.filter("doc_id % 2 = 0")
    rated = quality.score_documents(docs, even).withColumnRenamed("quality", "p").join(marks.filter("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    assert len(rated) > 20 and np.mean([(r.p >= 0.5) == (r.quality == 1) for r in rated]) > 0.85


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert F is not None
