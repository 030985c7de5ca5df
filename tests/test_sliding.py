import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from nightjar.operators.sliding import SlidingMedian


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-20, 20).map(lambda v: v / 4), min_size=1, max_size=60), st.integers(1, 12))
def test_median_and_deviation_of_every_window(values, keep):
    window = SlidingMedian(keep)
    for i, v in enumerate(values):
        window.push(v)
        past = np.array(values[max(0, i + 1 - keep):i + 1])
        m = float(np.median(past))
        assert len(window) == len(past) and window.median() == m
        assert window.deviation(m) == pytest.approx(float(np.median(np.abs(past - m))), abs=1e-12)


def test_a_long_window_costs_little():
    rng, window = np.random.default_rng(1), SlidingMedian(2_000)
    values = rng.standard_normal(6_000).tolist()
    for v in values:
        window.push(v)
        window.deviation(window.median())
    past = np.array(values[-2_000:])
    assert window.deviation(window.median()) == pytest.approx(np.median(np.abs(past - np.median(past))))
