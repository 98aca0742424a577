import numpy as np

from quern.llm import packing


def histogram(seed, n=4000, capacity=512):
    rnd = np.random.default_rng(seed)
    sizes = np.clip(rnd.lognormal(4.3, 0.8, n).astype(int), 1, capacity)
    return np.bincount(sizes, minlength=capacity + 1)


def test_patterns_take_most_and_lose_nothing():
    h = histogram(3)
    left = h.copy()
    groups = packing.fill_patterns(left, len(h) - 1, packing.FIT_ROUNDS)
    used = np.zeros_like(h)
    for own, n in groups:
        assert sum(own) == len(h) - 1
        for s in own:
            used[s] += n
    assert (left >= 0).all() and (used + left == h).all()
    tokens = np.arange(len(h))
    assert (used * tokens).sum() > 0.4 * (h * tokens).sum()


def test_plan_is_near_the_bound():
    for seed in (1, 2):
        h = histogram(seed)
        plan = packing.make_plan(h)
        bound = -(-int((h * np.arange(len(h))).sum()) // (len(h) - 1))
        assert bound <= plan.containers <= bound * 1.01 + 1
    assert packing.make_plan(np.zeros(9, dtype=int)).containers == 0
