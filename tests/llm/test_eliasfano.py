import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm.eliasfano import EliasFano, dequantise, quantise


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60) | st.sets(st.integers(0, 300), max_size=120), st.lists(st.integers(0, 2**64 - 1), max_size=10))
def test_find_and_access(values, others):
    rising = np.array(sorted(values), np.uint64)
    bits = 64 if not len(rising) else max(1, int(rising[-1]).bit_length())
    sequence = EliasFano.build(rising, bits)
    if len(rising):
        assert sequence.access(np.arange(len(rising))).tolist() == rising.tolist()
    index = {v: i for i, v in enumerate(rising.tolist())}
    probes = [*values, *others, *(min(v + 1, 2**64 - 1) for v in values)]
    assert sequence.find(np.array(probes, np.uint64)).tolist() == [index.get(p, -1) for p in probes]


def test_repeated_values_of_pointers():
    pointers = np.array([0, 0, 3, 3, 3, 10, 1000, 1000], np.int64)
    sequence = EliasFano.build(pointers, 11)
    assert sequence.access(np.arange(8)).tolist() == pointers.tolist()


def test_it_is_compact():
    rising = np.sort(np.random.default_rng(1).integers(0, 2**40, 100_000, np.uint64))
    sequence = EliasFano.build(rising, 40)
    stored = sequence.low.nbytes + sequence.high.nbytes
    assert stored * 8 / len(rising) < 40 - np.log2(len(rising)) + 4


def test_codes_keep_four_digits():
    values = 10 ** np.random.default_rng(2).uniform(-8, 12, 10_000)
    assert np.abs(dequantise(quantise(values)) / values - 1).max() < 5e-4
    assert dequantise(quantise(np.zeros(3))).tolist() == [0, 0, 0]
