import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinspan.llm.packing import WINDOW, BestFit, OpenWindows, cut_documents, op11_best_fit_packing, pack, sequences
from kinspan.llm.shared import written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, window):
    """Room left in each window, by looking at all open ones."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms[rooms.index(min(fitting))] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("window", [1, 7, 64, 100])
def test_segment_tree_finds_the_tightest_window(window):
    r = random.Random(window)
    for _ in range(30):
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 200))]
        best, fill = BestFit(window), {}
        for k, n in enumerate(sorted(lengths, reverse=True)):
            sequence, offset = best.place(k, n)
            assert offset == fill.get(sequence, 0)
            fill[sequence] = offset + n
        assert sorted(window - f for f in fill.values()) == plain_best_fit(lengths, window)


def test_open_windows_answer_as_a_scan():
    r, tree, held = random.Random(3), OpenWindows(50), []
    for k in range(3000):
        if r.random() < 0.5:
            room = r.randint(1, 50)
            tree.add(room, k)
            held.append(room)
        else:
            least = r.randint(1, 50)
            fitting = [x for x in held if x >= least]
            found = tree.take(least)
            assert (found is None) == (not fitting)
            if fitting:
                assert found[0] == min(fitting)
                held.remove(found[0])


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, found):
    """Every id in one piece, sequences gapless and within the window."""
    left = sorted((d is not None, d or 0, tuple(ids_of(t))) for d, t in rows)
    pieces = {}
    for p in found:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for known, doc, ids in left:
        own = pieces[doc if known else None, len(ids)]
        for start in range(0, len(ids), WINDOW):
            part = ids[start : start + WINDOW]
            hit = next(p for p in own if (p.start, p.length, p.ids_crc32) == (start, len(part), crc(part)))
            own.remove(hit)
    assert not any(pieces.values())
    fills = {}
    for p in found:
        fills.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW
    return [sum(n for _, n in parts) for parts in fills.values()]


def corpus():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé漢") for _ in range(r.randint(1, 9))) for _ in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 200, 700])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (502, "x" * 30000), (503, "a<|endoftext|>b")]
    return rows


def test_packs_all_documents(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "'x' as sequence_id", "3 as offset")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_best_fit_packing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = found.collect()
    totals = check(rows, found)
    # As good as best fit over all rests: one group packs them.
    rests = [p.length for p in found if p.length < WINDOW]
    assert sorted(WINDOW - t for t in totals if t < WINDOW) == [r for r in plain_best_fit(rests, WINDOW) if r]


def test_groups_and_sequences(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = written(cut_documents(docs, PATH), "pieces")
    packed = pack(pieces, group_pieces=20)
    check(rows, packed.collect())
    out = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in out.values():
        n = r.n_tokens
        assert len(r.ids) == (n if n & (n - 1) == 0 else WINDOW)
        assert not any(r.ids[n:])
    for p in packed.collect():
        assert out[p.sequence_id].ids[p.offset : p.offset + p.length] == p.ids
        assert crc(p.ids) == p.ids_crc32


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_best_fit_packing(spark, str(tmp_path)).collect() == []
    assert cut_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH, end_id=None).collect() == []
