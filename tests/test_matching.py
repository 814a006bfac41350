"""Matching blocks against the standard library's matcher and on texts that repeat."""

import random
from difflib import SequenceMatcher

import pytest

from turnwise.functions import matching


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_blocks_equal_the_standard_matcher(letters):
    rng = random.Random(letters)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(0, 40))) for _ in range(2))
        plain = SequenceMatcher(None, a, b, autojunk=False)
        assert [tuple(x) for x in matching.blocks(a, b)] == [tuple(x) for x in plain.get_matching_blocks()[:-1]]
        assert matching.blocks(list(a), list(b)) == matching.blocks(a, b)
        assert matching.ratio(a, b) == plain.ratio()


def test_longest_block_is_the_first_of_equals():
    assert matching.Automaton("xabyab").longest("abzab") == (0, 1, 2)
    assert matching.Automaton("").longest("ab") == (0, 0, 0)


def test_repeating_texts_are_matched():
    a, b = "the cat sat on the mat and then " * 60, "then the mat sat on a cat and so on " * 60
    assert 0.7 < matching.ratio(a, b) < 0.9
    assert matching.ratio("a" * 50_000, "a" * 50_000) == 1.0
    assert matching.blocks("a" * 20_000, "a" * 10_000) == [(0, 0, 10_000)]


def test_contained_counts_repeats():
    assert matching.contained(["a", "a"], ["a", "b", "a"]) and not matching.contained(["a", "a"], ["a", "b"])
