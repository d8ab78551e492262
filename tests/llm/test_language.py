import math

import zstandard

from mvspark.llm import language
from mvspark.llm.common import held_out
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, frame


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_the_language_column_is_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    a = language.identify(docs, model).collect()
    b = language.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()
    assert a == b
    assert language.train(docs.withColumn("lang", F.when(~held_out(F.col("doc_id")), F.col("lang")))) == model


def test_whole_texts_are_learnt_from(spark):
    # what tells the languages apart stands at the end of long texts only
    filler = "the same common words in every text of either language " * 2000
    texts = {"aa": "zorbel quentlu marvesh " * 2000, "bb": "plimto xanfrid gewotch " * 2000}
    rows = [(k, filler + texts[lang], lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    classify = language.classifier(model)
    assert classify("zorbel quentlu marvesh zorbel")[0] == "aa" and classify("xanfrid gewotch plimto xanfrid")[0] == "bb"
    assert all(len(d) <= language.DICT_BYTES for d in model.values())


def test_equals_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    for r in docs.collect():
        data = language.folded(r["text"] or "")
        if not any(map(str.isalpha, r["text"] or "")):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = {}
        for lang, content in model.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=language.LEVEL)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + language.PIECE])) for i in range(0, len(data), language.PIECE))
        best = min(sizes, key=lambda k: (sizes[k], k))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(math.exp(-100 * (s - sizes[best]) / sizes[best]) for s in sizes.values())) < 1e-9


def test_repeated_rows_give_the_same_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert language.train(docs) == language.train(docs.union(docs).repartition(7))


def test_awkward_rows(spark):
    docs = awkward(spark, [(9, "123 !!! ___ ²"), (10, "x" * 300_000)])
    model = {"aa": b"same words here again and a text without id", "bb": b"qqq zzz kkk vvv jjj"}
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for k in (1, 2, 3, 9):
        assert (by[k]["lang_pred"], by[k]["score"], by[k]["rejected"]) == ("und", 0.0, True)
    assert by[5]["lang_pred"] == "aa" and not by[5]["rejected"]
    assert language.train(frame(spark, [])) == {}
    assert language.identify(frame(spark, [(1, "text")]), {}).first()["lang_pred"] == "und"
    assert language.identify(frame(spark, []), model).count() == 0
