import random

import numpy as np
import pyarrow as pa

from tramline.llm import minhash


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    short = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 4, 5, 9, 14, 30, 60)] + ["a " * 70]
    long = [" ".join(rng.choice(words) for _ in range(900)) for _ in range(60)]
    mixed = [t for k, t in enumerate(long) for t in ([t, short[k]] if k < len(short) else [t])]
    rows, keys = minhash.bands(pa.array(mixed))
    together = dict(zip((mixed[r] for r in rows), keys, strict=True))
    for t in short:
        assert np.array_equal(minhash.bands(pa.array([t]))[1][0], together[t])
    few = dict(zip(short, minhash.bands(pa.array(short))[1], strict=True))
    assert all(np.array_equal(few[t], together[t]) for t in short)
