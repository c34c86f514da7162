import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from tests.llm.test_corpus_operators import least_sequences
from tidewell.llm import packing


def served(plan, capacity):
    out = Counter()
    for config, times in plan:
        assert sum(k * c for k, c in config.items()) <= capacity and times > 0
        for k, c in config.items():
            out[k] += c * times
    return out


def fewest(pieces: tuple[int, ...], capacity: int) -> int:
    """The least number of sequences, by trying all ways to fill the one that takes the longest piece left."""

    @lru_cache(maxsize=None)
    def count(left: tuple[int, ...]) -> int:
        if not left:
            return 0

        def fills(room: int, at: int, used: tuple[int, ...]):
            yield used
            for k in range(at, len(left)):
                if left[k] <= room and (k == at or left[k] != left[k - 1] or k - 1 in used):
                    yield from fills(room - left[k], k + 1, (*used, k))

        return 1 + min(count(tuple(x for k, x in enumerate(left) if k not in used)) for used in fills(capacity - left[0], 1, (0,)))

    return count(tuple(sorted(pieces, reverse=True)))


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_are_near_the_exact_optimum(seed):
    rnd = random.Random(seed)
    pieces = tuple(rnd.randint(2, 12) for _ in range(9))
    plan = packing.solve(Counter(pieces), 20)
    assert served(plan, 20) == Counter(pieces)
    best = fewest(pieces, 20)
    assert least_sequences(Counter(pieces), 20) <= best <= packing.sequences(plan) <= best + 1


@pytest.mark.parametrize("seed", range(50))
def test_never_more_than_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([40, 100, 256])
    histogram = {rnd.randint(1, capacity): rnd.randint(1, 500) for _ in range(rnd.randint(1, 60))}
    plan = packing.solve(histogram, capacity)
    assert served(plan, capacity) == Counter(histogram)
    assert packing.sequences(plan) <= packing.sequences(packing.best_fit(dict(histogram), capacity))


def test_many_lengths():
    rnd = random.Random(3)
    histogram = {k: rnd.randint(1, 40) for k in rnd.sample(range(1, 2049), 1500)}
    plan = packing.solve(histogram, 2048)
    assert served(plan, 2048) == Counter(histogram)
    assert packing.sequences(plan) <= packing.sequences(packing.best_fit(dict(histogram), 2048))


def test_the_program_beats_best_fit_where_pieces_go_in_threes():
    rnd = random.Random(9)
    histogram = Counter(rnd.randint(600, 800) for _ in range(20_000))
    assert packing.sequences(packing.solve(histogram, 2048)) < 0.95 * packing.sequences(packing.best_fit(dict(histogram), 2048))


def test_bound_is_under_the_shares():
    lengths, needs = np.array([3, 7, 9, 11]), np.array([50.0, 20.0, 30.0, 10.0])
    shares, lower, _ = packing.cover(lengths, needs, 20, 0.05, lengths / 20)
    got = Counter()
    for key, share in shares.items():
        for k, c in key:
            got[k] += c * share
    assert all(abs(got[int(k)] - n) < 1e-6 * n for k, n in zip(lengths, needs, strict=True))
    assert sum(lengths * needs) / 20 <= lower + 1e-9 and lower <= sum(shares.values()) + 1e-9
