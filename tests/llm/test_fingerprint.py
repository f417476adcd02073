import hashlib
import random

import pytest

from kinspan.llm.fingerprint import op3_oph_fingerprint


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), text[: len(text) - half] + after[:half])
    return out


def run(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as fingerprint", "1 as shard")
    docs.write.parquet(str(folder / "documents.parquet"))
    return op3_oph_fingerprint(spark, str(folder)).collect()


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edits_and_likeness(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdé") for _ in range(5)) for _ in range(300)]
    rows = [(3 * i + r.randint(0, 2), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 20, 80, 300])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, rows[0][1]), (1004, "w " * 3000), (1005, "\t\n ")]
    found, expected = run(spark, tmp_path, rows), brute(rows)
    assert len(found) == len(rows)
    texts, errors = dict(rows), []
    prints = {}
    for row in found:
        n, edited = expected[row.doc_id]
        assert (row.n_chars, row.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(texts[row.doc_id] or ""), shingles(edited)
        if a and b:
            errors.append(abs(row.near_edited - len(a & b) / len(a | b)))
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        prints.setdefault(texts[row.doc_id] or "", set()).add(row.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sum(errors) / len(errors) < 0.05


@pytest.mark.parametrize("rows", [[], [(5, "one text of its own here")], [(None, "no id"), (1, "a b"), (1, "a b"), (1, "c d")]])
def test_small_tables(spark, tmp_path, rows):
    found = run(spark, tmp_path, rows)
    assert len(found) == len(rows)
    if len(rows) == 1:
        assert found[0].near_next == 1.0


def plain_fingerprint(text):
    """Bins, least hashes, borrowed values and packing in plain Python."""
    import re
    import struct

    import xxhash

    def chained(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed=seed)
        return seed >> 1

    words = [struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[ \t\n\x0B\f\r]+", text) if w]
    found = [chained(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chained(words)] if words else []
    least = {}
    for v in found:
        least[v >> 56] = min(v, least.get(v >> 56, v))
    out = []
    for i in range(128):
        if i in least:
            out.append(least[i] & 255)
        else:
            ranks = [(chained([struct.pack("<i", i), struct.pack("<i", b)]) & ~255) | (v & 255) for b, v in least.items()]
            out.append(min(ranks) & 255 if ranks else 0)
    return "".join(f"{v:02X}" for v in out)


def test_fingerprints_equal_a_plain_version(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["aa", "bé", "c", "dd", "日本"]) + str(r.randrange(40)) for _ in range(r.choice([0, 1, 4, 5, 6, 12, 60, 400])))) for i in range(60)] + [(60, "x  y\t\nz" * 9), (61, None), (62, "w " * 50_000)]
    found, edited = {x.doc_id: x for x in run(spark, tmp_path, rows)}, brute(rows)
    order = sorted((i for i, _ in rows), reverse=True)
    prints = {i: plain_fingerprint(t or "") for i, t in rows}

    def alike(a, b):
        share = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128
        return max(0.0, (share - 1 / 256) / (1 - 1 / 256))

    for k, i in enumerate(order):
        assert found[i].fingerprint == prints[i] and found[i].edited_fingerprint == plain_fingerprint(edited[i][1])
        assert found[i].near_edited == pytest.approx(alike(prints[i], found[i].edited_fingerprint))
        assert found[i].near_next == pytest.approx(alike(prints[i], prints[order[(k + 1) % len(order)]]))
