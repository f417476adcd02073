import random
import zlib

import numpy as np
import public_tokenizers
from test_bpe import BYTE, some_texts
from tokenizers import Tokenizer

from kinspan.llm import wavelet
from kinspan.llm.bpe import Known
from kinspan.llm.shared import shared_folder
from kinspan.llm.wavelet import LibraryEncoder, ShardReader, ShardWriter, WaveletMatrix, read_shards, write_shards

LIBRARY = Tokenizer.from_file(BYTE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_files_answer_as_the_ids_do(tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "FRAME_BITS", 512)
    r = np.random.default_rng(7)
    for n, top, bits in ((0, 1, 4), (1, 3, 2), (512, 5, 3), (5000, 300, 9), (3000, 90000, 17)):
        ids = r.integers(0, top, n)
        assert WaveletMatrix.of(ids, bits).ids().tolist() == ids.tolist()
        writer = ShardWriter(f"file://{tmp_path}", 0, 0, bits)
        writer.add(4, ids[: n // 3])
        writer.add(None, ids[n // 3 :])
        m = ShardReader(f"file://{tmp_path}", writer.close()["path"])
        assert m.ids().tolist() == ids.tolist() and m.docs == [4, None] and m.ends == [n // 3, n]
        for i in [0, n - 1, *r.integers(0, n, 20)] if n else []:
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert m.access(int(i)) == t
            assert m.count(t, int(i)) == (where < i).sum() and m.count(t) == len(where)
            assert [m.select(t, k) for k in range(len(where) + 1)] == [*where.tolist(), -1]
        assert m.count(1 << bits) == 0 and m.select(1 << bits, 0) == -1 and m.select(0, -1) == -1


def test_library_encoder_equals_whole_texts_whatever_came_before():
    texts = some_texts(1500, 9) + ["x\nbar", "foo \nbar", "foo\nbar", "\0. a \0. \0.\0", "x \0", "a \0b", "a\tb  c", "\x85 a\xa0b"] * 2
    for limit in (1, 20_000, 10_000_000):
        encoder, known = LibraryEncoder(BYTE), Known(limit)
        random.Random(limit).shuffle(texts)
        for lo in range(0, len(texts), 25):
            for text, ids in zip(texts[lo : lo + 25], encoder.encode_texts(texts[lo : lo + 25], known), strict=True):
                assert ids.tolist() == ids_of(text), text


def test_files_round_trip(spark, monkeypatch):
    texts = some_texts(60)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(3, None), (3, "again"), (3, "again"), (None, "no id"), (None, None), (5000, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as part", "1 as base", "2 as tie")
    folder = shared_folder(spark, "test-wavelet")
    index = write_shards(docs, BYTE, folder)
    found = sorted(read_shards(index, folder).collect(), key=lambda r: r.start)
    want = sorted((doc is not None, doc or 0, len(ids := ids_of(t) + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for doc, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.doc_id or -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    shards = index.orderBy("base").collect()
    for shard in shards[:3]:
        reader = ShardReader(folder, shard.path)
        whole = reader.ids()
        for i in range(0, len(whole), 97):
            assert reader.access(i) == whole[i]
        assert reader.count(2) == shard.n_docs == len(reader.docs)
    assert read_shards(write_shards(docs.limit(0), BYTE, folder), folder).count() == 0
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE


def test_parts_are_cut_into_shards(monkeypatch, tmp_path):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 10)
    encoder = LibraryEncoder(BYTE)
    assert encoder.apart and encoder.bits == 16 and encoder.spaced[220] and encoder.feed[198]


def test_runs_between_all_kinds_of_white_space_equal_the_library(monkeypatch):
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(wavelet, "KNOWN_RUNS", 256)  # forgets often
    monkeypatch.setattr(wavelet, "CHUNK_BYTES", 50)  # blocks within texts
    encoder = wavelet.LibraryEncoder(path)
    r = random.Random(9)
    white = [" ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", " ", " ", " ", " ", "　", "​", "’"]
    words = ["a", "word", "don't", "it's", "x,", "(y)", "12", "é", "é", "漢字", "😀", "<|endoftext|>", "<|end", "…", "\x00", "Â", "â€", "ã€"]
    texts = ["".join(r.choice(white) if r.random() < 0.5 else r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(600)]
    column = pa.array([*texts, None, " ", "a ", " a"])
    found = [x.tolist() for batch in encoder.encode_column(column) for x in batch]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
