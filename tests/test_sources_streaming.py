import datetime
import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import ids
from attesta.functions.rating import ONE
from attesta.operators import census, fold, graph, lexical, sequence
from attesta.sources import readers
from attesta.streaming import incremental


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def triples(df):
    return {(r.subject, r.relation, r.object) for r in df.collect()}


def test_concepts_and_triples(spark, put):
    path = put("a.csv", '/a/x\t/r/IsA\t/c/en/cat/n\t/c/en/animal\t{"weight": 2.5}\n/a/y\t/r/Synonym\t/c/fr/chat\t/c/en/cat\t{}\n')
    rows = {r.subject: r for r in readers.concept_assertions(spark, path).collect()}
    assert (rows["en:cat"].relation, rows["en:cat"].object, rows["en:cat"].weight) == ("IsA", "en:animal", 2.5) and rows["fr:chat"].weight == 1.0
    path = put("b.tsv", "X eats\txWant\tto rest\nX eats\txNeed\tnone\n")
    assert triples(readers.triples_tsv(spark, path)) == {("X eats", "xWant", "to rest")}


def test_tables_of_words(spark, put):
    path = put("w.tab", "# comment\n00001740-n\teng:lemma\tentity\n00001740-n\teng:def\tthat which is\n")
    assert triples(readers.wordnet_tab(spark, path)) == {("entity", "IN_SYNSET", "00001740-n"), ("that which is", "DEF", "00001740-n")}
    path = put("iso.tab", "Id\tPart1\tScope\tLanguage_Type\tRef_Name\ndeu\tde\tI\tL\tGerman\n")
    assert readers.language_codes(spark, path).first().code2 == "de"
    s = put("s.csv", "1\teng\tHello\n2\tdeu\tHallo\n")
    assert triples(readers.sentence_links(spark, s, put("l.csv", "1\t2\n"))) == {("Hello", "TRANSLATES", "Hallo")}
    assert triples(readers.mapping_text(spark, put("m.txt", "# x\nMotion run-51.3\n"))) == {("Motion", "CORRESPONDS_TO", "run-51.3")}
    assert triples(readers.turtle_pairs(spark, put("t.ttl", "<i1> owl:sameAs pwn30:00001740-n .\n"), "owl:sameAs", "SAME")) == {("<i1>", "SAME", "pwn30:00001740-n")}
    assert triples(readers.tabular(spark, put("c.csv", "id,a,b\n1,x,\n2,,y\n"), "id")) == {("1", "a", "x"), ("2", "b", "y")}


def test_dictionary_conllu_pgn(spark, put):
    entry = {"word": "dog", "lang_code": "en", "pos": "noun", "senses": [{"glosses": ["an animal"]}], "synonyms": [{"word": "hound"}], "translations": [{"word": "Hund", "code": "de"}]}
    got = triples(readers.dictionary_jsonl(spark, put("d.jsonl", json.dumps(entry) + "\n")))
    assert got == {("en:dog", "HAS_POS", "noun"), ("en:dog", "HAS_GLOSS", "an animal"), ("en:dog", "SYNONYM", "en:hound"), ("en:dog", "TRANSLATES", "de:Hund")}
    text = "# sent_id = s1\n1\tDogs\tdog\tNOUN\t_\tNumber=Plur\t2\tnsubj\t_\t_\n2\tbark\tbark\tVERB\t_\t_\t0\troot\t_\t_\n\n# sent_id = s2\n1\tYes\tyes\tINTJ\t_\t_\t0\troot\t_\t_\n"
    got = {(r.sent, r.id, r.lemma, r.head) for r in readers.conllu(spark, put("u.conllu", text)).collect()}
    assert got == {("s1", 1, "dog", 2), ("s1", 2, "bark", 0), ("s2", 1, "yes", 0)}
    games = '[Event "A"]\n[White "x"]\n[Black "y"]\n[Result "1-0"]\n\n1. e4 {good} e5 2. Nf3 $1 1-0\n\n[Event "B"]\n[White "z"]\n[Result "*"]\n\n1. d4 *\n'
    got = {r.event: list(r.moves) for r in readers.pgn(spark, put("g.pgn", games)).collect()}
    assert got == {"A": ["e4", "e5", "Nf3"], "B": ["d4"]}
    xml = readers.xml_records(spark, put("f.xml", '<x><e id="1"><n>a</n></e><e id="2"><n>b</n></e></x>'), "e", "_id string, n string")
    assert {(r._id, r.n) for r in xml.collect()} == {("1", "a"), ("2", "b")}


def test_stream_fold_is_the_batches_fold(spark, tmp_path):
    ts = datetime.datetime(2026, 1, 1)
    rows = [("a", "r", "b", "s", None, ONE, 30 * ONE, ts), ("a", "r", "b", "s", None, 0, 30 * ONE, ts), ("a", "r", "c", "t", None, ONE, 100 * ONE, ts)]
    named = spark.createDataFrame(rows, "s string, r string, o string, src string, c string, score_fp long, opponent_rd_fp long, ts timestamp")
    said = named.select(ids.canonical_id("s").alias("subject_id"), ids.canonical_id("r").alias("type_id"), ids.canonical_id("o").alias("object_id"), ids.source_id("src").alias("source_id"), ids.canonical_id("c").alias("context_id"), "score_fp", "opponent_rd_fp", "ts")
    said.coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    stream = spark.readStream.schema(said.schema).parquet(f"file://{tmp_path}/in/*")
    for _ in range(2):  # the second run has nothing new
        incremental.fold_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    state = lambda df: sorted((bytes(r.id), r.rating, r.rd, r.witness_count) for r in df.collect())
    once = state(incremental.current(spark, f"file://{tmp_path}/out"))
    assert once == state(fold.fold(fold.observe(said)))
    said.coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    incremental.fold_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(r.witness_count for r in incremental.current(spark, f"file://{tmp_path}/out").collect()) == [2, 4]


def test_stream_fold_of_many_deviations_and_a_failed_batch(spark, tmp_path):
    ts = datetime.datetime(2026, 1, 1)
    rows = [(f"s{i % 7}", "r", f"o{i % 3}", f"src{i % 5}", None, (i % 11) * ONE // 10, (30 + 40 * (i % 5)) * ONE, ts + datetime.timedelta(days=i)) for i in range(200)]
    named = spark.createDataFrame(rows, "s string, r string, o string, src string, c string, score_fp long, opponent_rd_fp long, ts timestamp")
    said = named.select(ids.canonical_id("s").alias("subject_id"), ids.canonical_id("r").alias("type_id"), ids.canonical_id("o").alias("object_id"), ids.source_id("src").alias("source_id"), ids.canonical_id("c").alias("context_id"), "score_fp", "opponent_rd_fp", "ts")
    said.coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    stream = spark.readStream.schema(said.schema).parquet(f"file://{tmp_path}/in/*")
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    incremental.fold_stream(stream, out, ck, parts=4).awaitTermination()
    state = lambda df: sorted((bytes(r.id), r.rating, r.rd, r.volatility, r.witness_count, r.last_observed_at) for r in df.collect())
    once = state(incremental.current(spark, out))
    assert once == state(fold.fold(fold.observe(said))) and len(once) == 21
    # the next batch folds its deltas onto that, one period for each deviation, whatever a failed try left behind
    (tmp_path / "out/data/batch=1/part=0").mkdir(parents=True)
    (tmp_path / "out/heads/batch=1").mkdir(parents=True)
    more = said.filter(F.col("subject_id") == ids.canonical_id(F.lit("s1")))
    more.coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    assert state(incremental.current(spark, out)) == once
    incremental.fold_stream(stream, out, ck, parts=4).awaitTermination()
    want = fold.fold(fold.observe(said))
    for phi in sorted({r.phi for r in fold.deltas(fold.observe(more)).select("phi").distinct().collect()}):
        want = fold.upsert(want, fold.deltas(fold.observe(more)).filter(F.col("phi") == phi))
    assert state(incremental.current(spark, out)) == state(want)
    incremental.vacuum(spark, out)
    assert state(incremental.current(spark, out)) == state(want)


def test_small_operators(spark):
    seqs = spark.createDataFrame([("d", i, x) for i, x in enumerate("aabca")], "seq string, pos int, item string")
    assert {(r.ordinal, r.item, r.run) for r in sequence.run_lengths(seqs).collect()} == {(0, "a", 2), (1, "b", 1), (2, "c", 1), (3, "a", 1)}
    vocab = spark.createDataFrame([("a",), ("c",)], "item string")
    assert {(r.x, r.y, r.w) for r in sequence.order_plane(seqs, 1, vocab).collect()} == {("a", "a", 1), ("c", "a", 1)}
    wanted = spark.createDataFrame([(0, "x", None), (1, "y", 0), (2, "z", 1), (3, "w", None)], "idx long, id string, parent long")
    stored = spark.createDataFrame([("x",)], "id string")
    assert sorted(r.idx for r in census.descent(wanted, stored).collect()) == [0, 1, 2]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    got = {(r.at, r.depth) for r in graph.closure(links, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    names = spark.createDataFrame([(bytearray(b"1"), "one")], "id binary, name string")
    some = spark.createDataFrame([(bytearray(b"1"),), (bytearray(b"2"),)], "id binary")
    assert {r.label for r in lexical.labels(some, names).collect()} == {"one", "32"}
