from collections import Counter

import numpy as np

from keyloom.llm import packing


def lengths(seed, many):
    return Counter(np.minimum(4096, 1 + np.random.default_rng(seed).lognormal(6, 1, many).astype(int)).tolist())


def test_programs_of_many_lengths_cover_all_of_them():
    sizes, counts = np.arange(1, 513), np.maximum(1, 3000 // np.arange(1, 513))
    covered = np.zeros(len(sizes))
    for config, x in packing.solve(sizes, counts, 1024, 1.0):
        for k, n in config.items():
            covered[k] += n * x
    assert (covered >= counts - 1e-6).all() and (covered / counts).min() < 1 + 1e-6


def test_plans_take_no_more_than_best_fit():
    h = lengths(1, 300_000)
    alone = packing.Groups(4096)
    for n in sorted(h, reverse=True):
        alone.fit(n, h[n])
    got = packing.plan(h)
    assert Counter(n for contents, m in got for n in contents * m) == h and all(sum(c) <= 4096 for c, _ in got)
    assert sum(m for _, m in got) <= sum(n for *_, n in alone.open)


def test_the_program_is_solved_and_placed_where_best_fit_takes_a_few_more():
    h = lengths(1, 300_000)
    planned = packing.by_program(h)
    assert packing.plan(h) == planned
    alone = packing.Groups(4096)
    for n in sorted(h, reverse=True):
        alone.fit(n, h[n])
    assert sum(m for _, m in planned) < sum(n for *_, n in alone.open)


def test_lengths_are_priced_as_they_are():
    # Each configuration is full to the token; best fit alone takes 1100.
    h = {2149: 600, 1226: 600, 1125: 600, 822: 1200}
    got = packing.plan(h)
    assert Counter(n for contents, m in got for n in contents * m) == Counter(h)
    assert sum(m for _, m in got) == 900


def test_weights_fall_where_lengths_are_covered_many_times():
    sizes, counts = np.array([90, 110, 210, 260]), np.array([7, 5, 9, 3])
    used, bound = packing.cover(sizes, counts, 512, 4, 0.5)
    covered = Counter()
    for config, x in used.items():
        assert sum(n * m for n, m in config) <= 512
        covered.update({n: m * x for n, m in config})
    assert covered == Counter(dict(zip(sizes.tolist(), (4 * counts).tolist())))
    assert bound <= sum(used.values()) / 4 + 1e-9
