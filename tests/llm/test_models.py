"""Fitted operators: odd inputs on a small table, held-out accuracy on the test tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crateflow.llm import common, language, quality, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()  # ties share their mean rank
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# Floors a little below what was measured; toxicity falls short of the 0.95 aimed at (see the README).
@pytest.mark.parametrize(("query", "column", "least"), [(queries.op1_toxicity, "toxic", 0.88), (queries.op3_quality, "quality", 0.85)])
def test_scores_tell_labels_apart_where_they_were_held_out(spark, query, column, least):
    out = query(spark, LARGER)
    assert out.count() == common.table(spark, LARGER, "documents").count()
    rows = out.join(common.table(spark, LARGER, "labels"), "doc_id").where(F.col("held_out") & F.col(column).isNotNull()).select("score", column).collect()
    assert auc(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) >= least


def test_languages_of_held_out_documents(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "lang")
    rows = queries.op8_language(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9


def test_scores_of_odd_rows(docs, labels, nothing, texts):
    for fit, score in ((toxicity.fit, toxicity.score_documents), (quality.fit, quality.score_documents)):
        out = score(docs, fit(docs, labels)).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        # Nothing to learn from.
        assert all(0 <= r.score <= 1 for r in score(docs, fit(nothing, labels.limit(0))).collect())
        assert score(nothing, fit(docs, labels)).count() == 0


def test_languages_of_odd_rows(docs, nothing, texts):
    out = language.identify(docs, language.fit(docs)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    blank = {k for k, t in enumerate(texts) if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == blank
    assert all(r.lang_pred == "und" for r in language.identify(docs, language.fit(nothing)).collect())


def test_label_model_trusts_voters_that_agree():
    rng = np.random.default_rng(1)
    truth = rng.random(600) < 0.3
    good = [np.where(truth & (rng.random(600) < 0.8), 1, 0) for _ in range(3)]
    votes = np.column_stack([*good, np.where(np.any(good, axis=0), 0, -1)])
    post, _, _ = toxicity.label_model(votes)
    assert auc(post, truth.astype(int)) > 0.95


def test_patterns_are_those_of_a_plain_search():
    rng = np.random.default_rng(9)
    parts = ["you", "You're a", "are such an", "idiot", "RAT", "kill", "Hate", "hurt", "them all", "yourself", "shut up", "GET LOST", "i will", "we'll", "find", "destroy", "you", "them", "nobody", "no one", "likes", "die in", "rot in", "hell", "a fire", "du", "bist", "ihr seid", "ein", "Versager", "tu es", "t'es", "VOUS ÊTES", "un", "nul",
             "eres", "una", "basura", "halt die fresse", "Cállate la boca", "!!", "!!!", "f**k", "a*", "b@tch", "sh0ck", "#unt", "10", "$", "k\u0130ll", "\u212aill you", "lo\u017fer", "\u0131diot", "die", "in"]
    for _ in range(6000):
        text = (" " if rng.random() < 0.8 else "").join(rng.choice(parts, rng.integers(1, 7)))
        assert toxicity.patterns_in(text, text.lower()) == [k for k, p in enumerate(toxicity.PATTERNS) if p.search(text)], text


def test_label_model_does_not_count_a_repeated_voter_twice():
    rng = np.random.default_rng(4)
    truth = rng.random(2000) < 0.3
    bad = np.where(rng.random(2000) < 0.25, 1, 0)  # votes at random, five times the same
    good = [np.where(truth & (rng.random(2000) < 0.7) | (rng.random(2000) < 0.02), 1, 0) for _ in range(3)]
    votes = np.column_stack([*good, *[bad] * 5, np.where(np.any(good, axis=0) | (bad > 0), 0, -1)])
    post, chance, relation = toxicity.label_model(votes)
    assert relation[3, 4] > 0.9 and abs(relation[0, 3]) < 0.5
    assert auc(post, truth.astype(int)) > 0.8 and (chance[1, :3] > chance[0, :3]).all()


def wide(x):
    return np.pad(x, ((0, 0), (0, quality.WIDTH - x.shape[1]))).astype(np.float32)


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
def test_risk_is_fitted_without_negatives(share):
    rng, n = np.random.default_rng(3), 3000
    p, good = rng.normal(0, 1, (n, 6)), rng.random(n) < share
    p[:, 0] += 2.5
    u = rng.normal(0, 1, (n, 6))
    u[good, 0] += 2.5
    model = quality.fit_arrays(wide(p), wide(u))
    assert abs(model.prior - share) < 0.1
    z = np.clip((wide(u) - model.mean) / model.scale, -5, 5) @ model.weights[:-1] + model.weights[-1]
    assert np.mean((z > 0) == good) > 0.87  # the best line between the two is right in 89 of a hundred


def test_a_risk_below_zero_goes_up_its_gradient(monkeypatch):
    """Unlabelled rows that are all positives, with a prior too high for them: the second term falls below
    zero, and from there the step goes against the unlabelled part instead of after it."""
    rng = np.random.default_rng(5)
    p = rng.normal(1, 0.1, (200, 3)).astype(np.float32)
    grads, plain = [], quality._adam
    monkeypatch.setattr(quality, "_adam", lambda grad, width, epochs, step: grads.append(grad) or plain(grad, width, epochs, step))
    quality.fit_risk(p, p, 0.9, epochs=5)
    (grad,) = grads
    w = np.array([2.0, 2.0, 2.0, 1.0])  # rates all rows positive, so R_u(-) = R_p(-) and 0.1 of it is left: above zero
    sp = 1 / (1 + np.exp(-(p @ w[:-1] + w[-1])))
    mean = lambda v: np.append(v @ p, v.sum()) / len(p)
    assert np.allclose(grad(w), -0.9 * mean(1 - sp) + mean(sp) - 0.9 * mean(sp) + quality.DECAY * w, atol=1e-4)
    far = rng.normal(-3, 0.1, (200, 3)).astype(np.float32)  # rated negative: R_u(-) is near 0 and less than 0.9 * R_p(-)
    grads.clear()
    quality.fit_risk(p, far, 0.9, epochs=1)
    su = 1 / (1 + np.exp(-(far @ w[:-1] + w[-1])))
    down = np.append(su @ far, su.sum()) / len(far) - 0.9 * mean(sp)
    assert np.mean(-np.log(1 - su + 1e-12)) < 0.9 * np.mean(-np.log(1 - sp + 1e-12))
    assert np.allclose(grads[0](w), -down + quality.DECAY * w, atol=1e-4)
