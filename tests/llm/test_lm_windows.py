"""How many earlier ids a scored id sees."""

import numpy as np

from quillspan.llm import lm_scores
from tests.llm.test_methods import small_model


def test_windows_are_half_overlapping():
    """After the first window of a long text, each scored id has half a window of earlier ids at least."""
    m, texts = small_model()
    codes = m.coded(" ".join(texts * 4).split())[0]
    assert len(codes) > 2 * lm_scores.WINDOW
    seen = []
    inner = m.log_probability
    m.log_probability = lambda x, rows, y, at, skip=0: seen.append((x.shape[1], at, skip)) or inner(x, rows, y, at, skip)
    m.scores(codes, np.array([len(codes)]))
    assert lm_scores.WINDOW >= 64 and lm_scores.OVERLAP * 2 >= lm_scores.WINDOW
    for _, at, skip in seen[1:]:
        assert skip * 2 >= lm_scores.WINDOW and len(at)
    assert sum(len(at) for _, at, _ in seen) == len(codes) + 1
