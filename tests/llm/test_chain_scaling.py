"""Scaling products of a chain only now and then leaves the posteriors as they are, also at the extremes of potentials."""

import numpy as np
import pytest

from quillspan.llm import language_id


@pytest.mark.parametrize("states", [2, 4, 9])
def test_seldom_scaled_sums_are_the_same(monkeypatch, states):
    rng = np.random.default_rng(states)
    counts = np.array([0, 1, 127, 128, 129, 700, 3, 256])
    rows = np.hstack([np.exp(np.maximum(-30.0, -rng.exponential(40, (counts.sum(), states)))), rng.integers(0, 2, (counts.sum(), 1))])
    crf = language_id.ChainCRF([str(k) for k in range(states)])
    crf.transitions = rng.normal(0, 12, (states, states))
    got = crf.document_sums(rows, counts)
    monkeypatch.setattr(language_id, "SCALED", 1)
    want = crf.document_sums(rows, counts)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert np.allclose(got.sum(1), [rows[a : a + n, -1].sum() for a, n in zip(np.cumsum(counts) - counts, counts, strict=True)])
