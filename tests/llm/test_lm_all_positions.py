"""attention learns from every position of every training text."""

import numpy as np

from quillspan.llm import lm_scores
from tests.llm.test_methods import small_model


def test_every_window_has_each_target_once():
    m, _ = small_model()
    own = [[], ["the"], ["cat", "sat"] * 31 + ["a"], ["zebra", "mat", "dog"] * 90, []]
    coded = [m.coded(words)[0].astype(np.int64).reshape(-1, 2) for words in own]
    counts = np.array([len(c) for c in coded])
    w = m.every_window(np.concatenate(coded), counts)
    assert w.shape[1:] == (3, lm_scores.WINDOW) and len(w) == sum(-(-(n + 1) // lm_scores.WINDOW) for n in counts)
    on = w[:, 2].reshape(-1) >= 0
    ids, rows, targets = (w[:, k].reshape(-1)[on].tolist() for k in range(3))
    assert targets == [t for c in coded for t in [*c[:, 0].tolist(), 0]]
    assert ids == [t for c in coded for t in [0, *c[:, 0].tolist()]]
    assert rows == [t for c in coded for t in [0, *c[:, 1].tolist()]]


def test_every_place_of_a_text_is_learned_from(spark):
    """Another word anywhere, or in the one text of another round, gives other weights."""

    def weights(texts, **options):
        m, _ = small_model()
        return lm_scores.trained(m, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), least_windows=1, **options).packed()

    words = ["the", "cat", "sat", "on", "a", "mat"] * 500
    want = weights([" ".join(words)], rounds=1)
    assert np.array_equal(want, weights([" ".join(words)], rounds=1))
    for at in (3, 700, 1501, 2222, 2998):
        changed = words.copy()
        changed[at] = "zebra"
        assert not np.array_equal(want, weights([" ".join(changed)], rounds=1))
    some = [f"{w} cat and dog" for w in ("the", "a", "on", "sat") * 60]
    want = weights(some, rounds=2)
    for k in range(0, 240, 80):
        assert not np.array_equal(want, weights([*some[:k], "zebra crossing", *some[k + 1 :]], rounds=2))
