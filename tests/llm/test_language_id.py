import zlib

from pyspark.sql import functions as F

from tidemark.llm import language_id as li


def test_held_out_accuracy(spark, sf_dir):
    rows = li.query(spark, sf_dir.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] <= got[2] <= 1


def test_edges(documents):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    model = li.fit(documents(train))
    assert model.langs == ["de", "en"]
    odd = documents([(100, None), (101, ""), (102, "123 !!"), (103, "the dog"), (103, "die katze"), (104, "hundert katzen"), (None, "und " * 40_000)])
    got = sorted(((r.doc_id or -1, r.lang_pred) for r in li.predict(odd, model).collect()))
    assert got == [(-1, "de"), (100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "en"), (104, "de")]


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "some text", None), (2, None, "en")])
    assert [r.lang_pred for r in li.predict(docs, li.fit(docs)).collect()] == ["und", "und"]
    assert li.predict(documents([]), li.fit(documents([]))).collect() == []


def test_held_out_rule(documents):
    got = documents([(i, "x") for i in range(50)]).select("doc_id", li.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_numerals_are_no_letters(documents):
    model = li.fit(documents([(i, "the cat and the dog", "en") for i in range(5)]))
    rows = documents([(1, "½ ² Ⅷ ٣ 4"), (2, "²the ½dog"), (3, "Ⅷ")])
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in li.predict(rows, model).collect()) == [(1, "und", 0.0), (2, "en", 1.0), (3, "und", 0.0)]


def test_many_languages(documents):
    """No language is left out, however many there are."""
    rows = [(i, f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} common text", f"l{i % 1200:04}") for i in range(2400)]
    model = li.fit(documents(rows))
    assert len(model.langs) == 1200
