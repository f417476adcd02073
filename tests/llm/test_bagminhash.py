import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinspan.llm import bagminhash
from kinspan.llm.bagminhash import Multisets, keep_first_of_each, near_duplicate_classes, signatures, weighted_shingles
from kinspan.llm.words import as_bytes


def multiset(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    """Least id of each id's class: links between different texts at 0.8, equal texts together."""
    texts = sorted({t or "" for _, t in rows})
    sets, up = [multiset(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                up[find(i)] = find(j)
    root = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[t or ""]
            least[r] = min(least.get(r, i), i)
    return sorted((-1 if i is None else i, least.get(root[t or ""], -1)) for i, t in rows)


def found_classes(docs):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id) for r in near_duplicate_classes(docs).collect())


def corpus(seed, groups=12):
    r, rows = random.Random(seed), []
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


def test_signatures_estimate_weighted_jaccard():
    a = "a b c d e f g h i j " * 6 + "k l m n o p q"
    b = "a b c d e f g h i j " * 3 + "k l m n o p q r s t u v"
    data, offsets = as_bytes(pa.array([a, b, "", None, "x"]))
    s = signatures(*weighted_shingles(data, offsets), 5, 4096)
    assert abs((s[0] == s[1]).mean() - jaccard(multiset(a), multiset(b))) < 0.03
    assert np.isinf(s[2]).all() and np.isinf(s[3]).all() and np.isfinite(s[4]).all()


def test_multisets_compare_as_counters_do():
    texts = [t for _, t in corpus(1, 6)] + ["", "one", "one two", "a a a a a a a a a a a a"]
    m, n = Multisets(pa.array(texts)), len(texts)
    one, two = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(n)))
    for i, j, x in zip(one, two, m.likeness(one, m, two), strict=True):
        assert x == pytest.approx(jaccard(multiset(texts[i]), multiset(texts[j])))


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK_BYTES", block)
    rows = corpus(2) + [(1000, None), (1001, ""), (1002, " "), (1003, "two words"), (1004, "two words"), (1004, "two words"), (None, "two words"), (None, "alone here"), (1005, "word " * 3000), (1006, "word " * 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as root", "2 as a")
    assert found_classes(docs) == brute_classes(rows)


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_classes(docs).count() == 0 and keep_first_of_each(docs).count() == 0


def test_one_of_each_class_stays(spark):
    rows = corpus(4, 4) + [(500, "same text here again"), (500, "same text here again"), (501, "same text here again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or -1) for r in keep_first_of_each(docs).collect())
    assert kept == sorted({c for _, c in brute_classes(rows) if c >= 0} | {-1}) or kept == sorted([-1 if c == 0 else c for c in {c for _, c in brute_classes(rows)}])


def test_every_candidate_verified_gives_the_same_classes(spark):
    docs = spark.createDataFrame(corpus(7, 8), "doc_id long, text string")

    def classes(**setting):
        return sorted(map(tuple, near_duplicate_classes(docs, **setting).collect()))

    assert classes() == classes(most_unequal=bagminhash.COMPONENTS)


def test_unlike_signatures_of_like_texts_are_out_of_reach():
    from math import comb

    # Bits of a pair at the least likeness differ with probability 0.1 each.
    beyond = sum(comb(256, k) * 0.1**k * 0.9 ** (256 - k) for k in range(bagminhash.MOST_UNEQUAL + 1, 257))
    assert beyond < 1e-14


def test_a_large_class_meets_few_centres(spark, monkeypatch):
    from kinspan.llm import bagminhash

    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[: 9 * k], f"own{k}", *words[9 * k + 1 :]])) for k in range(40)]
    made, agreeing = [], bagminhash._agreeing

    def counted(pairs, bits, most_unequal):
        made.append(pairs.count())
        return agreeing(pairs, bits, most_unequal)

    monkeypatch.setattr(bagminhash, "_agreeing", counted)
    found = bagminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.class_id, x.class_size) for x in found} == {(0, 40)}
    assert max(made) <= 10 * len(rows)
