import math

import numpy as np
import pytest

from terrasample.functions.numeric import MonotoneSpline, largest_remainder, normal_quantile, signif, t_quantile


def test_largest_remainder_sums_and_floor():
    assert largest_remainder([1.5, 1.5, 2.0], 5) == [2, 1, 2]
    assert largest_remainder([0.1, 0.2, 9.7], 10) == [1, 1, 8]
    with pytest.raises(ValueError):
        largest_remainder([1, 1, 1], 2)


def test_quantiles():
    assert t_quantile(0.975, 3) == pytest.approx(3.182446305284263, abs=1e-9)
    assert t_quantile(0.025, 9) == pytest.approx(-2.2621571627409915, abs=1e-9)
    assert t_quantile(0.975, math.inf) == pytest.approx(normal_quantile(0.975))


def test_spline_is_monotone_and_exact_at_points():
    x, y = [0, 1, 2, 5], [0, 1, 1, 4]
    f = MonotoneSpline(x, y)
    assert [f(v) for v in x] == pytest.approx(y)
    assert (np.diff([f(v) for v in np.linspace(0, 5, 200)]) >= -1e-12).all()


def test_signif():
    assert signif(0) == 0 and signif(22635, 4) == 22640
