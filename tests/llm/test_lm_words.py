"""Words by Arrow against the plain pattern."""

import re

import pyarrow as pa
import pytest

from quillspan.llm import lm_scores

TEXTS = [None, "", " ", "One  two\tTHREE\n", "\x0bÄB\x0cC\r\n", "no\xa0break x\x1cY\x85z", "a" * 70_000, "x " * 9000, "tail ", "ÀÉ i̇ İ K"]


@pytest.mark.parametrize("most", [None, 1, 3, 10_000])
def test_word_runs_are_the_contracts_words(most):
    rows = []
    for k, words, own in lm_scores.word_runs(pa.array(TEXTS, pa.string()), most):
        left = words.to_pylist()
        assert len(own) == k and sum(own) == len(left)
        for n in own:
            rows.append(left[:n])
            left = left[n:]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert rows == [re.findall("[^\x20\x09-\x0d]+", lower(t)) for t in TEXTS]


def test_no_texts_no_runs():
    assert list(lm_scores.word_runs(pa.array([], pa.string()), 5)) == []
