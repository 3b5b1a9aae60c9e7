"""The fit of op2's index keeps no table of all trials by the whole sample."""

import tracemalloc

import numpy as np

from lyceum.llm import ann


def test_fit_holds_few_trials_at_once():
    sample = np.random.default_rng(3).normal(size=(20_000, 16))
    tracemalloc.start()
    index = ann.fit(sample, len(sample))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One table of 400 trials by the sample takes 64 MB; the fit held several at once.
    assert peak < 64e6
    assert 0 < index.error <= 1.0 and 1 <= index.probes <= len(index.centroids)
