import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_each_stage_takes_effect(spark, tmp_path):
    r = random.Random(11)
    clean = [words(r, r.randint(20, 80)) for _ in range(400)]
    rows, labels = list(enumerate(clean)), []
    for i in range(400, 500):
        rows.append((i, words(r, 30) + " zorgling " + words(r, 5)))
    labels = [(i, int(i >= 400)) for i in range(0, 500, 2)]
    item = words(r, 25)
    copy = clean[3].split()
    copy[10] = "other"
    rows += [(600, clean[0]), (601, " ".join(clean[3].split() * 6)), (602, words(r, 20) + " " + item), (603, words(r, 20) + " mail a.b@c.de"), (604, None), (605, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path)).cache()
        kept[k] = {x.doc_id for x in at.collect()}
        if k < 4:
            assert at.schema.names == docs.schema.names, name
    assert kept[0] == {i for i, _ in rows if not 400 <= i < 500}
    assert kept[0] - kept[1] == {600, 605} and kept[1] - kept[2] == {602} and kept[2] == kept[3] == kept[4]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]
