"""The pipeline's stages against their operators and brute force."""

import zlib

import corpus_pipeline
import numpy as np
from brute import classes, jaccard
from pyspark.sql import functions as F

from skarn.llm import common, quality, simhash, toxicity


LONG = " ".join(f"word{i % 977} and {i}" for i in range(20_000))


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "packing"]
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels")
    kept = {r["doc_id"] for r in quality.scored(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    toxic = {r["doc_id"] for r in toxicity.severity(docs, toxicity.train(docs, labels)).where("toxic = 1").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = sorted(kept - toxic)
    stays = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert stays <= set(left)
    similar = {(a, b): jaccard(text[a], text[b]) for k, a in enumerate(left) for b in left[k + 1 :]}
    near, far = (classes(left, lambda a, b, s=s: similar[min(a, b), max(a, b)] >= s) for s in (0.9, 0.7))
    for i in left:  # the tally stands for the similarity to some 0.03: of clear groups one stays, and whoever goes is in a group
        assert i not in stays or near[i] == i
        assert i in stays or far[i] != i
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns


def test_odd_rows_of_every_stage(spark, sf_dir):
    """Row by row: nulls in any column, empty and very long texts, ties, repeats, an empty table, extra columns with clashing names."""
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, None, "s", 9), (4, LONG + " end", "en", None, 9), (5, "a b c d e f g", "en", "s", 1), (5, "h i j k l m n", "en", "s", 1)]
    odd = spark.createDataFrame([(*r, i, i, "k", 0.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, sig int, component_id int, fp string, score double")
    docs, labels = (common.table(common.prepare(spark), sf_dir, n) for n in ("documents", "labels"))
    score = quality.scored(odd.withColumn("doc_id", F.col("sig")), quality.train(docs, labels)).where("predicted = 1")
    toxic = toxicity.severity(odd.withColumn("doc_id", F.col("sig")), toxicity.train(docs, labels)).where("toxic = 0")
    want = {"quality": {r["doc_id"] for r in score.collect()}, "toxicity": {r["doc_id"] for r in toxic.collect()}, "simhash": {0, 1, 4, 6}}  # of doc 5 the smaller text, of 3 and 4 the smaller id
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns and got.schema == odd.schema
        assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in odd.collect() if r["sig"] in want[name]), name
        assert stage(spark, odd.where("false"), sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(str(r[0]) for r in rows) and max(r["length"] for r in packed) == 2048
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), sf_dir).count() == 0


def test_labelled_documents_that_repeat_count_once(spark, sf_dir):
    """One labelled document 10,000 times: the same sample, the same models, no more rows than sample_rows."""
    docs, labels = (common.table(common.prepare(spark), sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    toxic, good = labels.where("toxic = 1").first()["doc_id"], labels.where(~quality.held_out(F.col("doc_id"))).first()["doc_id"]
    often = docs
    for i in (toxic, good):
        often = often.unionByName(docs.where(F.col("doc_id") == i).crossJoin(spark.range(10_000)).select("doc_id", "text"))
    picked = common.written(labels.select("doc_id", "quality"))
    assert common.labelled(often, picked).count() == common.labelled(docs, picked).count() == labels.join(docs, "doc_id").count()
    a, b = quality.train(docs, labels, sample_rows=60), quality.train(often, labels, sample_rows=60)
    assert all(np.allclose(a["net"][k], b["net"][k], atol=1e-6) for k in a["net"]) and abs(a["temperature"] - b["temperature"]) < 1e-6
    c, d = toxicity.train(docs, labels, sample_rows=60), toxicity.train(often, labels, sample_rows=60)
    assert c["columns"] == d["columns"] and np.allclose(c["w"], d["w"], atol=1e-6) and np.allclose(c["t"], d["t"], atol=1e-6)


def test_a_model_from_tasks_is_that_of_texts_at_hand(spark, sf_dir):
    docs, labels = (common.table(common.prepare(spark), sf_dir, t) for t in ("documents", "labels"))
    rows = sorted(docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").collect())
    own = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    a, b = quality.train(docs, labels), quality.fit([r.text for r in own], np.asarray([r.quality for r in own]))
    assert np.array_equal(a["context"], b["context"]) and all(np.allclose(a["net"][k], b["net"][k], atol=1e-4) for k in a["net"])
    of = toxicity._Terms(toxicity.terms)
    c, d = toxicity.train(docs, labels), toxicity.fit([(toxicity.features(r.text, of), None, r.toxic) for r in rows])
    assert c["columns"] == d["columns"] and np.allclose(c["w"], d["w"], atol=1e-4)


def test_stages_keep_columns_of_any_type_and_name(spark, sf_dir):
    rows = [(1, "one text here " * 9, {"k": 1}, (1, "x"), bytearray(b"\x00"), 2.0, "v", 7), (1, "one text here " * 9, {"k": 1}, (1, "x"), bytearray(b"\x00"), 2.0, "v", 7), (1, "another text of this id " * 9, None, None, None, None, None, None),
            (3, "one text here " * 9, {}, (2, None), None, 1.0, "w", 8), (None, None, {"z": 0}, (0, "0"), None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, s struct<doc_id: int, text: string>, raw binary, `a.b` double, `with blank` string, __n int")
    docs = docs.withColumn("nothing", F.lit(None)).withColumn("list", F.array(F.col("m")))
    found = simhash.similar(docs)
    got = simhash.keep_one(docs, found)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1]
    assert {r["a.b"] for r in got.where("doc_id is null").collect()} == {None} and got.where("doc_id is null").first()["m"] == {"z": 0}
    for stage in corpus_pipeline.STAGES[:-1]:
        assert stage[1](spark, docs.drop("nothing"), sf_dir).columns == docs.drop("nothing").columns
