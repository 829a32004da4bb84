"""What the language model writes to disk."""

import random

import numpy as np
import pytest

pytest.importorskip("tapeflow.llm")
from tapeflow.llm import lm  # noqa: E402


def _ranges(rows, column, n):
    return [rows.filter(lm.pa.compute.equal(rows[column], i)) for i in range(n)]


def test_lm_sends_shared_grams_only():
    """N-grams of one block only are not sent, and all counts are those of sending everything."""
    r = random.Random(6)
    texts = [" ".join(r.choice(("a", "b", f"own{k}x{r.randint(0, 900)}")) for _ in range(40)) for k in range(3) for _ in range(50)]
    left = [lm.pa.table({"text": texts[k * 50:k * 50 + 50], "block": np.full(50, k)}) for k in range(3)]
    met = lm.pa.concat_tables([lm._met(x) for x in _ranges(lm.pa.concat_tables([lm._outlined(4, 40)(t) for t in left]), "range", 4)])
    sent = [lm.pa.concat_tables(x) for x in ([lm._sent(4)(t) for t in left], [lm._sent(4)(t, m) for t, m in zip(left, _ranges(met, "block", 3), strict=True)])]
    few, every = (sum(s["size"].to_pylist()) for s in sent[::-1])
    assert 0 < few < every / 3
    for k, t in enumerate(left):
        own = lm._Block(t)
        full, short = (lm._counts(own, _ranges(lm.pa.concat_tables([lm._summed(x) for x in _ranges(s, "range", 4)]), "block", 3)[k]) for s in sent)
        assert all((a == b).all() for a, b in zip(full, short, strict=True))


@pytest.mark.parametrize(("n", "bits"), [(0, 63), (1, 63), (5, 63), (20000, 63), (20000, 33), (1000, 9)])
def test_lm_gaps(n, bits):
    x = np.sort(np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64))
    width, data = lm._gaps(x)
    assert np.array_equal(lm._ungapped(data, n, width), x)
    assert n < 100 or len(data) < 8 * n
