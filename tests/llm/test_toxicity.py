"""Training of toxicity scores: what it holds in memory."""

import tracemalloc

import numpy as np

from pagemill.llm import toxicity


def test_training_holds_distinct_words_only(monkeypatch):
    """Memory of training grows with the distinct words of texts, not with their lengths; sums by blocks are those of all at once."""
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(20_000)) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)], float)
    tracemalloc.start()
    model = toxicity.train(texts, labels, 0.5, epochs=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    monkeypatch.setattr(toxicity, "AT_ONCE", 64)
    again = toxicity.train(texts, labels, 0.5, epochs=3)
    assert (again.margins == model.margins).all() and again.bias == model.bias
