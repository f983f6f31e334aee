"""What a Python worker holds at a time in the pipeline's first two stages."""

import tracemalloc

import numpy as np
import pandas as pd

from palisade.llm import langid, neardup


def test_met_part_lays_out_only_shared_shingles():
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 48, (4000, 100)).astype("<u8")
    low[1::2, :50] = low[::2, :50]  # pairs share half
    prefix = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in low]
    pdf = pd.DataFrame({"id": range(4000), "grp": range(4000), "n": 500, "prefix": prefix, "early": [b"\x01" * 100] * 4000})
    for shared in (True, False):
        if not shared:
            pdf["prefix"] = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in rng.integers(0, 1 << 48, (4000, 100)).astype("<u8")]
        dealt = pd.concat(neardup.deal(iter([pdf]), 1))
        tracemalloc.start()
        met = pd.concat(neardup.meet(iter([dealt]), 0.8))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert met[["a", "b"]].sort_values("a").values.tolist() == ([[i, i + 1] for i in range(0, 4000, 2)] if shared else [])
    assert most < 70 * 400_000 // 2  # 35 bytes a shingle that no other text has; before, over 100


def test_unknown_words_kept_are_bounded_and_rows_are_not_arrays():
    table = np.array([[-1.0, -2.0], [-2.0, -1.0]], np.float32)
    model = langid.Model(["a", "b"], np.zeros(2), langid._Rows(["x", "y"], table), langid._Rows(["^", "$"], table))
    assert model.predict("x x y")[0] == "a" and model.predict("y y x")[0] == "b"
    for i in range(langid.SEEN + 100):
        model.vector(f"w{i}")
    assert len(model.seen) == langid.SEEN <= 20_000
