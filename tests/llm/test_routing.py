"""Routing keys of a set are those of the set alone."""

import numpy as np
import pytest

from stripweave.llm import jaccard

U = np.uint64


def keys_of(values, num, den):
    return set(jaccard.routing_keys(values, np.array([0, len(values)]), num, den)[0].tolist())


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_keys_do_not_depend_on_rows_beside(num, den):
    rng = np.random.default_rng(4)
    sizes = [1, 2, 9, 40, 500, 530, 3000]
    sets = [np.sort(rng.integers(0, 2**63, n).astype(U)) for n in sizes]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    together = jaccard.routing_keys(np.concatenate(sets), bounds, num, den)
    assert [keys_of(s, num, den) for s in sets] == [set(k.tolist()) for k in together]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_linked_sets_of_neighbouring_classes_share_a_key_in_calls_of_their_own(num, den):
    rng = np.random.default_rng(5)
    for first in jaccard.size_classes(num, den, 12_000):
        low, high = first - 1, first  # the last size of a class and the first one of the next
        if low * den < high * num:
            continue
        large = np.sort(rng.integers(0, 2**63, high).astype(U))
        assert keys_of(large[:low], num, den) & keys_of(large, num, den), (low, high)
        wide = min(low * den // num, high + high // 25)
        large = np.sort(rng.integers(0, 2**63, wide).astype(U))
        assert keys_of(np.delete(large, rng.choice(wide, wide - low, replace=False)), num, den) & keys_of(large, num, den), (low, wide)
