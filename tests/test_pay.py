"""Pay texts of more than two figures."""

import pytest

from tidewell.functions.pay import parse_pay


@pytest.mark.parametrize("text, low, high", [("$70k / $80k / $90k", 70_000, 90_000), ("$90,000, $70,000 or $80,000 a year", 70_000, 90_000)])
def test_lowest_and_highest_of_all_figures(text, low, high):
    pay = parse_pay(text)
    assert (pay.low, pay.high) == (low, high)
