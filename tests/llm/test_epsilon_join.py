"""The join inside a pair of blocks against all cosines, without Spark."""

import numpy as np
import pytest

from mailsift.llm import epsilon_grid as G


def _classes(n, links):
    label = list(range(n))
    for i, j in links:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("leaf, spread, centers", [(16, 0.02, 8), (64, 0.04, 30), (64, 0.3, 40), (256, 0.03, 2)])
def test_join_equals_all_cosines(monkeypatch, leaf, spread, centers):
    """Tight and loose clusters, few and many links in a leaf, weights, one block with
    itself and two blocks."""
    monkeypatch.setattr(G, "LEAF", leaf)
    rng = np.random.default_rng(11)
    n, d, cosine = 400, 24, 0.9
    middle = rng.normal(size=(centers, d)) / np.sqrt(d)
    x = middle[rng.integers(0, centers, n)] + rng.normal(size=(n, d)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    weight = rng.integers(1, 4, n)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    eps = float(np.sqrt(2 - 2 * cosine))
    for first in (n, 150):
        join = G._Join(x, x @ axes.T, weight, cosine, eps)
        left, right = slice(0, first), slice(first, n)
        join.run(left, right if first < n else left)
        wanted = near.copy()
        if first < n:
            wanted[:first, :first] = False
            wanted[first:, first:] = False
        assert (join.links == wanted @ weight).all()
        links = list(zip(*np.nonzero(wanted)))
        assert all(wanted[i, j] for i, j in join.forest) and len(join.forest) < n
        assert _classes(n, join.forest) == _classes(n, links)


def test_few_and_many_dimensions():
    """One axis has no rest; equal and opposite vectors."""
    x = np.array([[1.0], [-1.0], [1.0]])
    join = G._Join(x, x, np.array([1, 1, 1]), 0.9, float(np.sqrt(0.2)))
    join.run(slice(0, 3), slice(0, 3))
    assert join.links.tolist() == [1, 0, 1] and join.forest == [(0, 2)]
