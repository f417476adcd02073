import duckdb

from kinspan.llm import chat, warc
from kinspan.llm.shared import shared_folder

DATA = "/root/testdata/sf0.001"


def same(spark_df, sql, table, name):
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{DATA}/{table}.parquet'")
    expected = con.sql(sql).df()
    found = spark_df.toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)

    def rows(frame):
        return sorted(tuple("" if str(v) in ("None", "nan", "<NA>") else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))

    assert rows(found) == rows(expected)


def test_chat_equals_sql(spark):
    same(chat.op4_perspective_rotation(spark, DATA), chat.ORACLE_SQL, "conversations", "conversations")


def test_chat_views_and_masks(spark, monkeypatch):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, "cat", "yo"), (1, 4, "ann", "bye"), (2, 0, "system", "alone"), (None, 1, None, "x"), (3, None, "ann", "t"), (3, 5000, "ann", "u"), (3, 5000, "ann", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "'p' as perspective")
    found = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate(df).collect()}
    assert {k[:2] for k in found} == {(1, "ann"), (1, "bob"), (1, "cat"), (None, "unknown"), (3, "ann")}
    ann = found[1, "ann", 0]
    assert [ann.rendered[int(a) : int(b)] for a, b in (m.split(":") for m in ann.mask.split(","))] == ["hi é<|im_end|>\n", "bye<|im_end|>\n"]
    assert "<|im_start|>user name=bob\n<|im_end|>\n" in ann.rendered and ann.rendered.startswith("<|im_start|>system\nbe kind")
    assert sum(r.n_turns for k, r in found.items() if k[0] == 3) == 3
    assert chat.rotate(df.limit(0)).count() == 0


def test_turns_without_number_and_rows_without_dialogue(spark):
    rows = [(1, None, "bob", "b"), (1, None, "ann", "a"), (1, None, "ann", "a"), (1, 2, "bob", "c"), (None, 1, "ann", "x"), (None, 1, "ann", "x"), (None, None, "system", "y"), (2, 1, "ann", "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.rotate(df).collect()
    ann = next(r for r in found if r.conv_id == 1 and r.segment == -1 and r.perspective == "ann")
    assert ann.n_turns == 3 and ann.rendered.index("user name=bob") > ann.rendered.rindex("assistant")
    assert [(r.n_turns, r.segment, r.mask) for r in found if r.conv_id is None] == [(1, 0, "22:34")] * 2
    assert next(len(r.rendered) for r in found if r.conv_id == 2) == 1_000_033
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    expected = con.sql(chat.ORACLE_SQL).fetchall()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found)


def test_warc_equals_sql(spark):
    same(warc.op8_warc_capture_index(spark, DATA), warc.ORACLE_SQL, "pages", "pages")


def test_warc_revisits_index_and_look_up(spark):
    big, rows = "é" * 700, []
    for i in range(700):
        rows.append((i, f"https://User@Host{i % 7}.Example.com:80/p/{i % 50}?q={i % 3}#f", f"page {i}" if i % 5 else big))
    rows += [(900, None, None), (901, "no scheme", ""), (902, "http://x.y/a\r\nb", "short"), (903, "http://x.y/", "short"), (None, "http://x.y/n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as size")
    folder = shared_folder(spark, "test-warc")
    catalogue = warc.write_archives(pages, folder)
    found = {r.page_id: r for r in warc.read_archives(catalogue, folder).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = html == big and i != 695
        assert (found[i].payload_bytes, found[i].record_type, found[i].refers_to) == (len(payload), "revisit" if revisit else "response", 695 if revisit else None), i
    urls = spark.createDataFrame([(u,) for _, u, _ in rows[:40]] + [("http://absent.org/",)], "url string")
    hits = {}
    for r in warc.look_up(catalogue, folder, urls).collect():
        hits.setdefault(r.url, set()).add(r.page_id)
    for url in {u for _, u, _ in rows[:40]}:
        assert hits[url] == {i for i, u, _ in rows if u and warc.url_key_of(u) == warc.url_key_of(url)}
    assert "http://absent.org/" not in hits
    keys = {r.url: r.key for r in urls.select("url", warc.url_key(urls.url).alias("key")).collect()}
    assert all(warc.url_key_of(u) == k for u, k in keys.items())
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_revisits_joined_by_shuffle_are_the_same(spark, monkeypatch):
    def records(name):
        folder = shared_folder(spark, name)
        return sorted(map(str, warc.read_archives(warc.write_archives(pages, folder), folder).collect()))

    rows = [(i, f"http://a.b/{i % 9}", ["x" * 1500, "y" * 999, None, "", "z" * 4000 + str(i)][i % 5]) for i in range(60)] + [(1, "http://a.b/1", "y" * 999), (None, None, "x" * 1500), (99, "http://a.b/long", "é" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = records("test-warc-broadcast")
    monkeypatch.setattr(warc, "MAX_BROADCAST_REVISITS", 0)
    assert records("test-warc-shuffle") == one and len(one) == len(rows)
