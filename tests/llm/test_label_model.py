"""The label model of toxicity against plain expectation maximisation, and with voters that repeat each other."""

import numpy as np
import pytest

from tallywork.llm import toxicity


def drawn(make, n, rates, prior):
    truth = make.random(n) < prior
    return truth, (make.random((n, rates.shape[1])) < rates[truth.astype(int)]).astype(np.uint8)


def patterns_of(spark, votes):
    packed, counts = np.unique(np.packbits(votes, axis=1), axis=0, return_counts=True)
    return spark.createDataFrame([(bytearray(p.tobytes()), int(c)) for p, c in zip(packed, counts, strict=True)], "votes binary, count long").repartition(3)


def plain_em(votes, start, rounds, strength=200.0):
    rates, prior = start.copy(), 0.1
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + np.where(votes == 1, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        total = np.array([(1 - p).sum(), p.sum()])
        one = np.vstack([(1 - p) @ votes, p @ votes])
        rates = np.clip((one + strength * start) / (total[:, None] + strength), 1e-6, 1 - 1e-6)
        prior = (total[1] + 1) / (total.sum() + 10)
    return prior, rates


RATES = np.array([[0.02, 0.05, 0.01, 0.2, 0.03], [0.6, 0.5, 0.4, 0.5, 0.7]])


def test_independent_voters_against_plain_em(spark):
    make = np.random.default_rng(1)
    truth, votes = drawn(make, 20_000, RATES, 0.15)
    _, seen = drawn(make, 400, RATES, 0.3)
    labels = (np.arange(400) % 3 == 0).astype(float)
    seen[labels == 1] = (make.random((int(labels.sum()), 5)) < RATES[1]).astype(np.uint8)
    model = toxicity.fit_label_model(patterns_of(spark, votes), seen, labels, 5, rounds=6, correlated=False)
    start = np.vstack([np.full(5, 0.01), np.full(5, 0.2)])
    for y in (0, 1):
        own = seen[labels == y]
        start[y] = (own.sum(axis=0) + start[y]) / (len(own) + 1)
    prior, rates = plain_em(votes, np.clip(start, 1e-4, 1 - 1e-4), 6)
    assert (model.parent == -1).all() and model.prior == pytest.approx(prior, abs=1e-9)
    assert model.rates[:, 0] == pytest.approx(rates, abs=1e-9) and model.rates[:, 1] == pytest.approx(rates, abs=1e-9)
    assert model.prior == pytest.approx(0.15, abs=0.02)


def test_a_repeated_voter_counts_once(spark):
    make = np.random.default_rng(2)
    truth, votes = drawn(make, 20_000, RATES, 0.15)
    none = np.zeros((0, 8), np.uint8), np.zeros(0)
    twice = np.hstack([votes, votes[:, [3, 3, 3]]])
    model = toxicity.fit_label_model(patterns_of(spark, twice), *none, 8)
    # The copies hang together, whichever of them comes first.
    assert sum(int(model.parent[k]) in (3, 5, 6, 7) for k in (3, 5, 6, 7)) == 3
    alone = toxicity.fit_label_model(patterns_of(spark, votes), none[0][:, :5], none[1], 5)
    right = lambda m, v: np.mean((m.posterior(v) > 0.5) == truth)
    assert right(model, twice) > right(alone, votes) - 0.01
    # Taken as independent, four votes of the weak voter outweigh the others.
    naive = toxicity.LabelModel(alone.prior, np.full(8, -1), np.concatenate([alone.rates, alone.rates[:, :, [3, 3, 3]]], axis=2))
    assert right(model, twice) > right(naive, twice) + 0.02


def test_the_tree_links_pairs_that_depend_on_each_other():
    make = np.random.default_rng(3)
    votes = (make.random((5000, 4)) < 0.3).astype(float)
    votes[:, 2] = np.where(make.random(5000) < 0.9, votes[:, 0], votes[:, 2])
    q = np.vstack([np.full(5000, 0.8), np.full(5000, 0.2)])
    total, one = q.sum(axis=1), q @ votes
    two = np.stack([(votes * w[:, None]).T @ votes for w in q])
    parent = toxicity.dependence_tree(total, one, two)
    assert {(k, int(p)) for k, p in enumerate(parent) if p >= 0} in ({(2, 0)}, {(0, 2)})
