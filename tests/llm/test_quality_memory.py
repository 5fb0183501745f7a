"""The driver holds the matrix of the labelled sample once while it trains."""

import tracemalloc

import numpy as np

from vicinia.llm import quality


def test_training_takes_no_second_matrix():
    rng = np.random.default_rng(3)
    rows = np.log1p(rng.poisson(0.3, (3000, quality.TERMS + quality.SHAPES))).astype(np.float32)
    first = rows[:500].copy()
    tracemalloc.start()
    model = quality.train(rows, rng.integers(0, 2, 3000), rank=8, reuse=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes / 2 and model.vectors.shape == (3000, 8)
    assert np.allclose(quality.unit(model.projected(first)), model.vectors[:500], atol=1e-6)
