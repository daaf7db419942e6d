import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.functions.grid import Grid
from tessel.functions.kernels import Tiling, closure, contact_weight, fold, lu, minplus, solve_lower, solve_upper, stub_weight, subtract

TILINGS = [Tiling(), Tiling(True, 2, 1), Tiling(True, 3, 2), Tiling(True, 4, 5)]


def serial_paths(d):
    d = d.copy()
    for k in range(len(d)):
        for i in range(len(d)):
            for j in range(len(d)):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


def serial_fold(n, weight):
    s = np.zeros((n, n))
    for k in range(n - 1, 2, -1):
        for j in range(min(k - 2, n - 3), 0, -1):
            for i in range(min(j - 1, n - 4), -1, -1):
                s[i, j] = max(s[i, j], s[j + 1, k] + weight(j + 1, min(k, 2 * j - i + 1)))
    return s


def slow_contact(h, j, k):
    return sum(h[2 * j - t - 1] == 1 and h[t] == 1 for t in range(j + 2, min(k, 2 * j) + 1) if 2 * j - t - 1 >= 0)


@pytest.mark.parametrize("how", TILINGS)
@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_closure(how, n):
    rng = np.random.default_rng(n)
    d = rng.integers(1, 50, (n, n)).astype(float)
    d[rng.random((n, n)) < 0.5] = np.inf
    np.fill_diagonal(d, 0)
    got = closure(d.copy(), how)
    assert (got == serial_paths(d)).all()
    assert (closure(got.copy(), how) == got).all()  # nothing left to shorten


@pytest.mark.parametrize("how", TILINGS)
def test_minplus_of_rectangles(how):
    rng = np.random.default_rng(0)
    x, u, v = (rng.integers(0, 99, s).astype(float) for s in ((3, 7), (3, 5), (5, 7)))
    want = np.minimum(x, (u[:, :, None] + v[None]).min(axis=1))
    assert (minplus(x, u, v, how) == want).all()


@pytest.mark.parametrize("how", TILINGS)
@pytest.mark.parametrize("n", [1, 2, 5, 11])
def test_factors_multiply_back(how, n):
    rng = np.random.default_rng(n)
    a = rng.random((n, n)) + n * np.eye(n)
    x = lu(a.copy(), how)
    low, up = np.tril(x, -1) + np.eye(n), np.triu(x)
    assert np.allclose(low @ up, a)
    b = rng.random((n, 3))
    assert np.allclose(low @ solve_lower(x, b.copy()), b)
    assert np.allclose(solve_upper(x, b.T.copy()) @ up, b.T)


def test_a_zero_pivot_is_an_error():
    with pytest.raises(ZeroDivisionError):
        lu(np.array([[0.0, 1.0], [1.0, 0.0]]))


def test_known_values():
    assert closure(np.array([[0, 5, 1], [5, 0, 9], [9, 2, 0.0]])).tolist() == [[0, 3, 1], [5, 0, 6], [7, 2, 0]]
    assert lu(np.array([[2, 4], [6, 5.0]])).tolist() == [[2, 4], [3, -7]]  # multipliers are read before they are zeroed
    s = fold(x := np.zeros((5, 5)), 0, 0, x, 0, 0, 5, stub_weight)
    assert (s[0, 1], s[0, 2], s[1, 2], s.sum()) == (5, 7, 7, 19)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=4, max_size=24))
def test_contacts_and_folding(h):
    n, weight = len(h), contact_weight(np.array(h))
    pairs = [(j, k) for j in range(1, n - 1) for k in range(j + 2, n)]
    if pairs:
        j, k = map(np.array, zip(*pairs, strict=True))
        assert weight(j, k).tolist() == [slow_contact(h, *p) for p in pairs]
    x = np.zeros((n, n))
    assert (fold(x, 0, 0, x, 0, 0, n, weight) == serial_fold(n, lambda j, k: slow_contact(h, j, k))).all()
    more = contact_weight(np.ones(n, dtype=int))
    y = np.zeros((n, n))
    assert (fold(y, 0, 0, y, 0, 0, n, more) >= x).all()  # more contacts never score less


@given(st.integers(1, 60), st.integers(1, 70))
def test_grids_cover_all_indices(n, r):
    grid = Grid(n, r)
    assert sum(grid.size(k) for k in range(grid.r)) == n
    assert all(grid.size(k) > 0 for k in range(grid.r))
    assert grid.r <= r


def test_bad_grids_and_tilings():
    for make in (lambda: Grid(0, 1), lambda: Grid(3, 0), lambda: Tiling(True, 1, 4)):
        with pytest.raises(ValueError):
            make()


@pytest.mark.parametrize(("r", "base"), [(2, 3), (3, 4), (4, 1)])
def test_tiled_solves_and_products(r, base):
    rng, how = np.random.default_rng(r), Tiling(True, r, base)
    factors = lu(rng.random((19, 19)) + 20 * np.eye(19))
    x, y, u, v = rng.random((19, 11)), rng.random((7, 19)), rng.random((13, 17)), rng.random((17, 9))
    assert np.allclose(solve_lower(factors, x.copy(), how), solve_lower(factors, x.copy()))
    assert np.allclose(solve_upper(factors, y.copy(), how), solve_upper(factors, y.copy()))
    z = rng.random((13, 9))
    assert np.allclose(subtract(z.copy(), u, v, how), z - u @ v)
    assert np.allclose(lu(np.eye(19) * 30 + np.arange(361).reshape(19, 19) / 361, how), lu(np.eye(19) * 30 + np.arange(361).reshape(19, 19) / 361))


@pytest.mark.parametrize(("r", "base"), [(2, 3), (3, 4), (5, 1)])
def test_tiled_folding(r, base):
    n, how = 26, Tiling(True, r, base)
    weight = contact_weight(np.random.default_rng(r).integers(0, 2, n))
    for w in (weight, stub_weight):
        one, two = np.zeros((n, n)), np.zeros((n, n))
        assert (fold(one, 0, 0, one, 0, 0, n, w) == fold(two, 0, 0, two, 0, 0, n, w, how)).all()
        x, u = np.random.default_rng(1).random((9, 8)), np.random.default_rng(2).random((9, 10))
        assert (fold(x.copy(), 3, 6, u, 7, 14, n, w) == fold(x.copy(), 3, 6, u, 7, 14, n, w, how)).all()
