"""The fit keeps its examples in arrays, which give the index that dictionaries give."""

from __future__ import annotations

import pickle

import numpy as np

from tilewright.llm.toxicity import Index, own_votes, relevance


def test_examples_in_arrays():
    rng = np.random.default_rng(3)
    named = [(d, d % 2, {int(t): int(n) for t, n in zip(rng.choice(30, 8, replace=False), rng.integers(1, 5, 8), strict=True)}) for d in range(80)]
    packed = [(d, y, (np.array(sorted(c), np.int32), np.array([c[t] for t in sorted(c)], np.int32))) for d, y, c in named]
    terms, weight = [f"t{i}" for i in range(30)], rng.random(30) + 0.1
    assert (relevance(30, named) == relevance(30, packed)).all()
    one, two = Index(terms, weight, named), Index(terms, weight, packed)
    assert (one.value == two.value).all() and (one.post == two.post).all() and (one.ids == two.ids).all()
    assert all(one.nearest(one.unit(a[2])) == two.nearest(two.unit(b[2])) for a, b in zip(named, packed, strict=True))


def test_votes_and_postings_stay_on_executors(spark):
    rng = np.random.default_rng(5)
    examples = [(d, d % 2, (np.sort(rng.choice(40, 9, replace=False)).astype(np.int32), rng.integers(1, 5, 9, np.int32))) for d in range(1100)]
    index = Index([f"t{i}" for i in range(40)], rng.random(40) + 0.1, examples)
    votes = own_votes(spark, index)
    assert not set(Index.MADE) & set(vars(index))  # the driver made no postings
    assert (votes == [index.vote(index.nearest(index.unit(c), without=d)) for d, _, c in examples]).all()
    index.slope = 3.0
    again = pickle.loads(pickle.dumps(index))
    assert not set(Index.MADE) & set(vars(again)) and again.slope == 3.0 and (again.post == index.post).all() and (again.value == index.value).all()
