import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinspan.llm import prefix_counts
from kinspan.llm.bpe import ByteLevelBpe, Known, decode_ids, encode_texts, round_trips
from kinspan.llm.prefix_counts import PrefixCounter, prefix_tables, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b\n\n", "don't we'll 'S's", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x<|startoftext|>Y", "ΣΑΣ ÉÀ é ́x İ", "aaaaaaaaaaaaaaaaaaa", "1234567890 3.14", "日本語 テキスト", " x y　", "tab\tx", "\x1c a \x1f", "🙂🙃 👩‍👩‍👧", "!!!???...", "a" * 3000, "ab" * 1500 + " " + "9" * 500, "the.\nAnd x", "\r\n x"]


def some_texts(n=300, seed=3):
    r = random.Random(seed)
    parts = ["the", "ing", " ", " ", " ", "\n", "  ", "é", "ß", "ñ", "'s", "12", ".", ",", "!", "Th", "tion", "x", "Q", "日", "🙂", "́", "-", "ouea", "<|endoftext|>", "%%%", "\t", "aa", "e"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def bpe():
    return ByteLevelBpe(BYTE)


def test_ids_equal_the_librarys(bpe):
    library = Tokenizer.from_file(BYTE)
    for text in some_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text).tolist() == ids, text
        assert bpe.decimals(bpe.encode(text)) == ",".join(map(str, ids)).encode()
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_librarys_do(bpe):
    library, r = Tokenizer.from_file(BYTE), random.Random(5)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 30))]
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_ids_do_not_depend_on_what_was_encoded_before(bpe):
    library, texts = Tokenizer.from_file(BYTE), some_texts(1200, 12) + ["x\nbar", "foo \nbar", "foo\nbar", "\0. a \0. \0.\0", "a \0b"] * 3
    for limit in (1, 30_000, 10_000_000):
        known = Known(limit)
        random.Random(limit).shuffle(texts)
        for lo in range(0, len(texts), 31):
            for text, ids in zip(texts[lo : lo + 31], bpe.encode_texts(texts[lo : lo + 31], known), strict=True):
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert known.size <= 2 * limit + 100_000


def test_long_texts_are_taken_in_parts(bpe, monkeypatch):
    from kinspan.llm import bpe as module

    monkeypatch.setattr(module, "LONG_TEXT", 40)
    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    counter = PrefixCounter(WORD)
    texts = [t for t in some_texts(150, 21) if len(t) > 40] + ["a b " * 60, " x" * 50, "y" * 100, "z  " * 60, "ab\n cd " * 20]
    assert sum(len(module.parts_of(t)) > 1 for t in texts) > 50
    for text in texts:
        assert "".join(module.parts_of(text)) == text
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids), text
    for text in texts[:25]:
        assert counter.table_of(text).tolist() == prefixes_by_library(words, text), text


def test_long_pieces_are_encoded_as_short_ones_are(bpe):
    library, r = Tokenizer.from_file(BYTE), random.Random(2)
    for n in (150, 159, 160, 161, 600, 3000):
        text = "".join(r.choice(["a", "b", "the", "in", "é", "th"]) for _ in range(n))
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pairs_are_compatible_where_the_library_keeps_them_apart(bpe):
    library, r = Tokenizer.from_file(BYTE), np.random.default_rng(3)
    for _ in range(200):
        word = " " + "".join(r.choice(list("aetinhors"), 7))
        ids = np.array(library.encode(word, add_special_tokens=False).ids)
        assert bpe.table.compatible(ids[:-1], ids[1:]).all()
    a, b = r.integers(0, 50000, (2, 3000))
    both = bpe.table.compatible(a, b)
    assert (both == bpe.table._compatible(a, b)).all() and (both == bpe.table.compatible(a, b)).all() and 0 < both.sum() < len(both)


def test_round_trip_query_equals_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [(i, t) for i, t in enumerate(some_texts(80, 4))] + [(-1, None), (-2, "long " * 40000), (-2, "again"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as n_tokens", "'q' as known")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shas = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
        want.append((i, len(ids), *shas))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in round_trips(docs, BYTE).collect())


def prefixes_by_library(library, text):
    return [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_every_prefix_of_every_text():
    library, counter = Tokenizer.from_file(WORD), PrefixCounter(WORD)
    r = random.Random(8)
    parts = ["the", "ing", " ", "日本語", "テキスト", "\n", "\n\n", "é", "ß", "'re", "'", "!!", "<|endoftext|>", "\t", "aGVsbG8", "🙂", "e\u0301", "İ", "Σ", "12", "hello", "\u1100\u1161", "\xa0", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(250)] + ["thonderinging", "internationalisation", "x'll", "a'l", "the." * 30, "z" * 300]
    for text in texts + [t for t in some_texts(60, 6) if len(t) < 200]:
        assert counter.table_of(text).tolist() == prefixes_by_library(library, text), text


def test_prefix_table_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_counts, "TABLE_RUNS", 3)
    library, counter = Tokenizer.from_file(WORD), PrefixCounter(WORD)
    for text in ("one two  three four. Five\nsix seven eight ", " a b c", "a b c", ""):
        assert counter.table_of(text).tolist() == prefixes_by_library(library, text)
    rows = [(1, "the cat"), (None, None), (1, "the cat")]
    found = prefix_tables(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as counts"), WORD).collect()
    assert sorted(map(str, found)) == sorted(str(x.__class__(doc_id=i, counts=prefixes_by_library(library, t or ""))) for x, (i, t) in zip(found, rows, strict=True))


def test_counts_and_budget_equal_the_librarys(spark):
    library, limit = Tokenizer.from_file(WORD), 12
    rows = [(i, t) for i, t in enumerate(some_texts(120, 5))] + [(-1, None), (-2, "a " * 12), (-3, "a " * 12 + "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true as over_limit", "7 as n_bytes")
    found = {r.doc_id: r for r in token_counts(docs, WORD, limit).collect()}
    for i, t in rows:
        counts = prefixes_by_library(library, (t or "")[:400])
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        fits = len(t or "") if n <= limit else max(k for k, c in enumerate(counts) if c <= limit)
        assert tuple(found[i]) == (i, len((t or "").encode()), n, n > limit, fits), (t, found[i])


def test_texts_without_spaces_fit_in_part(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(1, "日本語のテキスト" * 900), (2, "\n".join(["thonder"] * 3000)), (3, "aGVsbG8gd29ybGQ" * 900), (4, "a b " + "日本" * 3000)]
    for x in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect():
        text = dict(rows)[x.doc_id]
        near = [len(library.encode(text[: x.fitting_chars + d], add_special_tokens=False).ids) for d in (0, 10)]
        assert x.over_limit and 2040 <= near[0] <= 2048 < near[1], (x, near)


def test_queries_on_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, None), (3, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as n_tokens", "2 as id")
    assert round_trips(docs, BYTE).count() == 5
    found = {r.doc_id: r for r in token_counts(docs, WORD).collect()}
    assert found[2].n_tokens == 0 and found[2].n_bytes == 0 and found[3].n_bytes == 5000
    encoded = encode_texts(docs, BYTE)
    assert {(r.doc_id, r.text) for r in decode_ids(encoded, BYTE).collect()} == {(i, t or "") for i, t in rows}
    assert round_trips(docs.limit(0), BYTE).count() == 0


def test_prefix_tables_of_unspaced_texts_with_marks_and_special_tokens():
    import time

    path = public_tokenizers.path("word_bpe_49k.json")
    counts, library = PrefixCounter(path), Tokenizer.from_file(path)
    r = random.Random(3)

    def han(n):
        return "".join(chr(0x4E00 + r.randint(0, 8000)) for _ in range(n))

    pool = ["'", "s", "re", "'ll", "ſ", "é", "́", "̣", "か", "゙", "ᄀ", "ᅡ", "ᆨ", "가", "İ", "Σ", "ς", "1", "２", "!", "<|endoftext|>", "<|", "|>", "<|end", "\t", "\n", " ", "\x1c", "漢", "😀", "‍", "̧", "न", "़", "ে", "া", "Ω", "Å", "̈́", "x", "Ab", "\x00"]
    for k in range(120):
        text = "".join(r.choice(pool) for _ in range(r.choice([1, 3, 8, 20, 60])))
        text = (han(60) if k % 5 == 0 else "x" * 70 if k % 7 == 0 else "") + text
        expected = [len(library.encode(text[:e], add_special_tokens=False).ids) for e in range(len(text) + 1)]
        assert counts.table_of(text).tolist() == expected
    text = "".join(r.choice([han(50), han(30), "ạ̈", "<|startoftext|>", "が"]) for _ in range(9000))
    began = time.process_time()
    table = counts.table_of(text)
    # In proportion to the text: minutes if every prefix were cut anew.
    assert time.process_time() - began < 30
    for e in [1, len(text), *r.sample(range(len(text)), 8)]:
        assert table[e] == len(library.encode(text[:e], add_special_tokens=False).ids)
