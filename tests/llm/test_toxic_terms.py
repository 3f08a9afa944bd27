"""Terms that stand in toxic texts alone pass the screen."""

import numpy as np
from regioscope.llm import toxicity


def test_terms_of_toxic_texts_alone_are_kept():
    y = np.array([1.0] * 352 + [0.0] * 2803)
    bins = [[77] for _ in y]
    for k in range(5):
        bins[k].append(1000)  # in five toxic texts and no clean one
    for k in range(20, 38):
        bins[k].append(2000)  # in eighteen
    for k in [*range(40, 52), *range(400, 403)]:
        bins[k].append(3000)  # in twelve toxic texts and three clean ones
    for k in [60, *range(500, 508)]:
        bins[k].append(4000)  # as common in both
    m = toxicity.fit([np.array(b, np.int64) for b in bins], y)
    assert [bool(m.at[b] >= 0) for b in (1000, 2000, 3000, 4000)] == [True, True, True, False]
    score = lambda *b: m.score(np.array(b, np.int64), np.array([0, len(b)]))[0]
    assert score(77, 2000) > 0.5 > score(77)


def test_ratio_root_against_plain_sums():
    n1, n0 = 352, 2803
    for a, c in ((5, 0), (0, 9), (12, 3), (352, 2803), (0, 0)):
        cells = ((a, a + c, n1), (c, a + c, n0), (n1 - a, n1 + n0 - a - c, n1), (n0 - c, n1 + n0 - a - c, n0))
        want = 2 * sum(k * np.log(k * (n1 + n0) / (n * m)) for k, n, m in cells if k)
        got = toxicity.ratio_root(np.array([float(a)]), np.array([float(c)]), n1, n0)[0]
        assert abs(got**2 - want) < 1e-6


def test_level_is_read_off_unseen_clean_rows():
    rng = np.random.default_rng(0)
    bins, y = [], []
    for k in range(1200):
        toxic = k % 6 == 0
        words = rng.integers(100, 2000, 30).tolist() + ([int(rng.integers(1, 12))] if toxic and k % 4 else [])
        bins.append(np.unique(np.array(words, np.int64)))
        y.append(float(toxic))
    counts = [np.ones(len(b)) for b in bins]
    plain, m = toxicity.fit(bins, np.array(y), counts=counts), toxicity.levelled(bins, np.array(y), counts)
    assert plain.bias <= m.bias <= max(plain.bias, -0.5)
    score = lambda m, k: m.score(bins[k], np.array([0, len(bins[k])]))[0]
    clean = [k for k in range(1200) if not y[k]]
    assert np.mean([score(m, k) >= 0.5 for k in clean]) <= 0.02
    assert sum(score(m, k) >= 0.5 for k in range(1200) if y[k]) >= sum(score(plain, k) >= 0.5 for k in range(1200) if y[k])
    few = toxicity.levelled(bins[:100], np.array(y[:100]), counts[:100])
    assert few.bias == toxicity.fit(bins[:100], np.array(y[:100]), counts=counts[:100]).bias
