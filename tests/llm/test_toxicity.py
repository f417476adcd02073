import random

import numpy as np

from kinspan.llm.toxicity import fit_non_negative_pu, op1_nnpu_toxicity, train


def test_positive_unlabelled_fit_separates():
    rng = np.random.default_rng(0)
    bad, rows, truth = rng.integers(1 << 60, size=5).astype(np.uint64), [], []
    for _ in range(3000):
        toxic = rng.random() < 0.2
        words = rng.integers(1 << 20, size=30).astype(np.uint64)
        rows.append(np.unique(np.concatenate([words, rng.choice(bad, rng.integers(1, 4))]) if toxic else words))
        truth.append(toxic)
    truth = np.array(truth)
    known = truth & (rng.random(3000) < 0.5)
    names, weights, bias = fit_non_negative_pu(rows, known, 0.2)
    weight = dict(zip(names.tolist(), weights, strict=True))
    g = np.array([bias + sum(weight.get(int(f), 0) for f in r) for r in rows])
    assert set(bad.tolist()) <= set(names.tolist())
    assert ((g > 0) == truth).mean() > 0.99


def corpus(n=1500, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.15
        words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.randint(5, 60))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["Vile", "zorgling", "zorglish", "vile,"])
        rows.append((i, " ".join(words)))
        if r.random() < 0.7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts_are_told_apart(spark, tmp_path):
    rows, labels = corpus()
    rows += [(2000, None), (2001, ""), (None, "vile"), (5, "vile again")]
    labels += [(7, None), (None, 1), (8, 0), (8, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = op1_nnpu_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    known, score = dict(labels[:-4]), {r.doc_id: r.score for r in found if r.held_out}
    pairs = [(known[i], s) for i, s in score.items() if i in known]
    good = sum(a[1] > b[1] for a in pairs if a[0] for b in pairs if not b[0])
    assert good / (sum(p[0] for p in pairs) * sum(1 - p[0] for p in pairs)) > 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    names, weights, _ = train(docs, labels)
    assert len(names) == len(weights) == 0
    train(docs.limit(0), labels)


def plain_risk(rows, toxic, prior, names, weights, bias, non_negative=True):
    """The risk text by text, as the module's docstring gives it."""
    weight = dict(zip(names.tolist(), weights, strict=True))
    g = [bias + sum(weight.get(int(f), 0.0) for f in r) for r in rows]
    loss = lambda z: float(np.log1p(np.exp(-abs(z))) + max(-z, 0))
    mean = lambda kind, sign: float(np.mean([loss(sign * x) for x, t in zip(g, toxic, strict=True) if t == kind]))
    rest = mean(False, -1) - prior * mean(True, -1)
    return prior * mean(True, 1) + (max(0.0, rest) if non_negative else rest), rest


def small_sample(seed, n=240, share=0.5):
    rng = np.random.default_rng(seed)
    bad = rng.integers(1 << 60, size=6).astype(np.uint64)
    common = rng.integers(1 << 60, size=40).astype(np.uint64)
    toxic = np.arange(n) < n * share
    rows = [np.unique(np.concatenate([rng.choice(common, 8), rng.choice(bad, 2)]) if t or rng.random() < 0.15 else rng.choice(common, 8)) for t in toxic]
    return rows, toxic


def test_training_lowers_the_risk():
    rows, toxic = small_sample(1)
    names, weights, bias = fit_non_negative_pu(rows, toxic, 0.2, least_purity=0.0)
    start = plain_risk(rows, toxic, 0.2, names, np.zeros(len(names)), float(np.log(0.25)))[0]
    end = plain_risk(rows, toxic, 0.2, names, weights, bias)[0]
    assert end < 0.5 * start
    # No step in any single direction lowers it much further.
    for k in range(len(names)):
        for step in (-0.3, 0.3):
            moved = weights.copy()
            moved[k] += step
            assert plain_risk(rows, toxic, 0.2, names, moved, bias)[0] > end - 0.02


def test_the_reversed_gradient_keeps_the_risk_of_clean_texts_from_falling_below_zero():
    rows, toxic = small_sample(2, n=60)
    fits = {kind: fit_non_negative_pu(rows, toxic, 0.5, least_purity=0.0, non_negative=kind) for kind in (True, False)}
    rest = {kind: plain_risk(rows, toxic, 0.5, *fits[kind])[1] for kind in fits}
    assert rest[False] < -0.05 and rest[True] > rest[False] + 0.04
    assert not np.allclose(fits[True][1], fits[False][1])


def test_columns_pass_and_very_long_texts_score(spark):
    from kinspan.llm.toxicity import drop_toxic

    rows, labels = corpus(800)
    rows = [*rows, (5000, "calm " * 400_000 + "zorgling"), (5001, None), (None, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'t' as text_", "1 as toxic", "0.5 as score")
    out = drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 5000 not in kept and 5001 in kept and None in kept
    assert drop_toxic(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
