import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinspan.llm.fim import ORACLE_SQL, Units, fill_in_middle, op13_fill_in_middle, restored


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """One code point after the other."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    cut = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, digest(text), digest(text))
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), digest(out), digest(text))


def corpus():
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ab<PSM> \n\r é漢😀é\0") for _ in range(r.choice([0, 1, 2, 3, 10, 60, 400])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (1002, "漢" * 200_000), (-5, "x<M>y"), (1003, "<S"), (1004, "<P<S<M")]
    return rows


def test_equals_plain_cuts(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as output")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_fill_in_middle(spark, str(tmp_path)).collect()
    key = str
    assert sorted(map(tuple, found), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(f"select doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 from ({ORACLE_SQL}) q").fetchall()
    assert sorted(expected, key=key) == sorted(map(tuple, found), key=key)


def test_texts_come_back(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    back = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    expected = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert back.exceptAll(expected).count() == 0 and back.count() == docs.count()


def test_parts_of_long_texts_give_the_same_ends():
    r = random.Random(6)
    text = "".join(r.choice("ab \né") for _ in range(5000))
    assert list(Units(part=7).ends(text)) == list(Units().ends(text)) == list(range(1, 5001))
    words = r"\s*\S+\s*?(?=\s|\Z)|\s+\Z"
    assert list(Units(words, part=5).ends(text)) == list(Units(words).ends(text))
    assert "".join(text[a:b] for a, b in zip([0, *Units(words).ends(text)], Units(words).ends(text))) == text
    with pytest.raises(ValueError):
        Units("a").ends("aab")
    with pytest.raises(ValueError):
        Units("a", part=1).ends("aab")


def test_other_units(spark):
    docs = spark.createDataFrame([(i, "one two\nthree four\nfive six\n" * (i % 3)) for i in range(60)], "doc_id long, text string")
    out = fill_in_middle(docs, unit=r"[^\n]*\n")
    for r in out.where("form <> 'plain'").collect():
        assert r.n == 3 * (r.doc_id % 3)
        whole = "one two\nthree four\nfive six\n" * (r.doc_id % 3)
        assert not r.prefix_chars or whole[r.prefix_chars - 1] == "\n"
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert back.exceptAll(docs).count() == 0


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op13_fill_in_middle(spark, str(tmp_path)).collect() == []
