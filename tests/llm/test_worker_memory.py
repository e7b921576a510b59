"""What a Python worker of the line and near-duplicate steps holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from helixlake.llm import lines, minhash


class _Held:
    value = np.zeros(lines.SLOTS, np.uint8)


def test_steps_hold_little_beside_their_tables():
    text = "\n".join(" ".join(f"w{(i * j) % 9973}" for j in range(12)) for i in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(range(150)), pa.array([text] * 150)], names=["doc_id", "t", "text"])
    assert batch.nbytes > 2 << 20
    for step in (lines._read(3, 80, False), lines._place(3, 80, _Held), lines._short_lines(3), minhash._sign(5)):
        list(step([batch.slice(0, 1)]))  # tables that are made once
        tracemalloc.start()
        for _ in step([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45 << 20


def test_tables_of_tries_are_small_and_the_same():
    assert minhash._MANY.nbytes <= 4 << 20
    with np.errstate(over="ignore"):
        x = minhash.mix(np.arange(4096 * minhash.BINS, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03))
    assert np.array_equal(minhash._MANY.ravel(), x % np.uint64(minhash.BINS))
    for n in (1, 3, 40, 700):
        s = np.unique(minhash.mix(np.arange(n, dtype=np.uint64)))
        got, at = minhash.signature(s), np.searchsorted(s, minhash._EDGES)
        filled = np.append(at[1:], len(s)) > at
        want = np.where(filled, s[np.minimum(at, len(s) - 1)], 0)
        for i in np.flatnonzero(~filled):
            j = next((t[i] for t in (*minhash._FEW, *minhash._MANY) if filled[t[i]]), None)
            want[i] = s[0] if j is None else s[at[j]]
        assert np.array_equal(got, want)
