"""The potentials of new words are looked up for all of them at once."""

import numpy as np

from quillspan.llm import language_id
from quillspan.llm.language_id import ChainCRF, features

WORDS = ["", "a", "ab", "abc", "abcd", "The", "x<ab>c", "a=b", "<b", "==", "12", "(Haus)", "l'eau", "Été", "日本語", "\U0001d11ex\U0001d11e", "İzmir", "straße", "a" * 300, "b\x00c", "1a2b3"]


def test_word_rows_are_the_sums_of_all_features(monkeypatch):
    """Against one word at a time; also where signs of affixes stand inside words, and for words that repeat a feature."""
    rng = np.random.default_rng(4)
    every = sorted({f for w in WORDS + ["abab", "<ab", "=a"] for f in features(w)} | {"<a", ">b", "=a", "zz", "zzzz"})
    for kept in (every, every[::2], every[:1]):
        crf = ChainCRF(["x", "y", "z"], {f: i for i, f in enumerate(kept)}, rng.normal(size=(len(kept), 3)), np.eye(3))
        want = np.zeros((len(WORDS), 4))
        for k, w in enumerate(WORDS):
            own = [crf.vocabulary[f] for f in features(w) if f in crf.vocabulary]
            s = crf.weights[own].sum(0) if own else np.zeros(3)
            want[k] = [*np.exp(np.maximum(s - s.max(), -30.0)), bool(features(w))]
        with monkeypatch.context() as p:
            p.setattr(language_id, "features", None)  # not word by word
            got = crf.word_rows(WORDS)
            assert not len(crf.word_rows([]))
        assert np.allclose(got, want, rtol=1e-12, atol=1e-15)
