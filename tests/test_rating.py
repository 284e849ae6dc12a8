import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from attesta.functions import fixed
from attesta.functions.rating import INITIAL_RD, NEUTRAL, ONE, Rating, belief_logit, period, trust_rd, uniform_period


def test_glickman_example():
    was = Rating(1500 * ONE, 200 * ONE, 60_000_000)
    games = [(1400 * ONE, 30 * ONE, ONE), (1550 * ONE, 100 * ONE, 0), (1700 * ONE, 300 * ONE, 0)]
    got = period(was, games)
    assert got.rating / ONE == pytest.approx(1464.06, abs=0.05)
    assert got.rd / ONE == pytest.approx(151.52, abs=0.05)
    assert got.volatility / ONE == pytest.approx(0.05999, abs=0.00005)
    for _ in range(5):
        random.shuffle(games)
        assert period(was, games) == got


def test_no_games_widen():
    was = Rating(1500 * ONE, 200 * ONE, 60_000_000)
    got = period(was, [])
    assert got.rating == was.rating and was.rd < got.rd < INITIAL_RD


def test_uniform_is_the_same_games_one_by_one():
    got = uniform_period(Rating(), 30 * ONE, 8, 8 * 900_000_000)
    assert got == period(Rating(), [(NEUTRAL, 30 * ONE, 900_000_000)] * 8)


def test_signed_evidence():
    f = lambda phi, games, total: uniform_period(Rating(), phi, games, total)
    confirm, refute, draw = f(30 * ONE, 1, 900_000_000), f(30 * ONE, 1, 100_000_000), f(30 * ONE, 1, 500_000_000)
    assert confirm.rating > NEUTRAL > refute.rating and abs(draw.rating - NEUTRAL) <= 5 * ONE
    assert f(30 * ONE, 1, 900_000_000).rating > f(350 * ONE, 1, 900_000_000).rating
    assert f(30 * ONE, 8, 8 * 900_000_000).rating > confirm.rating
    with pytest.raises(ValueError):
        f(30 * ONE, 0, 0)


def test_trust():
    assert trust_rd(1) == 30 * ONE and trust_rd(0) == 350 * ONE and trust_rd(7) == 30 * ONE


@given(st.integers(-(10**15), 10**15), st.integers(-(10**15), 10**15))
def test_products_and_quotients_round_half_away(a, b):
    assert abs(fixed.mul(a, b) * ONE - a * b) * 2 <= ONE
    assert fixed.mul(-a, b) == -fixed.mul(a, b)
    if b:
        assert abs(fixed.div(a, b) * b - a * ONE) * 2 <= abs(b)


@given(st.integers(-20 * ONE, 20 * ONE))
def test_exponential_and_logarithm(x):
    import math

    assert fixed.exp(x) == pytest.approx(math.exp(x / ONE) * ONE, rel=1e-7, abs=2)
    y = abs(x) + 1000
    assert fixed.log(y) == pytest.approx(math.log(y / ONE) * ONE, rel=1e-5, abs=2000 if y < ONE else 50)


def test_logit_scale(spark):
    rows = spark.createDataFrame([(1900 * ONE, 0), (1100 * ONE, 0), (1500 * ONE, 0), (1900 * ONE, 200 * ONE)], "rating long, rd long")
    got = [r[0] for r in rows.select(belief_logit()).collect()]
    assert got[0] == pytest.approx(2.302585093) and got[1] == pytest.approx(-2.302585093) and got[2] == 0
    assert got[3] == pytest.approx(0)
