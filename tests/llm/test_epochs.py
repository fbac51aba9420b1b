import numpy as np
from turfline.llm import toxicity_ftrl


def test_as_many_epochs_at_every_size():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 50, 5)).astype(np.uint32), int(rng.random() < 0.3)) for _ in range(4_000)]
    want = toxicity_ftrl.train(rows, toxicity_ftrl.EPOCHS)
    for a, b in zip(toxicity_ftrl.train(rows), want, strict=True):
        assert np.array_equal(a, b)
    other = toxicity_ftrl.train(rows, 16)
    assert any(not np.array_equal(a, b) for a, b in zip(other, want, strict=True))
