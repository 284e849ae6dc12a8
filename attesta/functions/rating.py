"""Glicko-2 in fixed point, and the column expressions that read a rating.

A rating period follows Glickman's paper: variance and improvement from the period's games, the new volatility by the
Illinois method, then deviation and rating. All games of one period count together, so their order doesn't matter;
periods do not commute.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from math import log as ln
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import INT64_MAX, INT64_MIN, ONE, PI_SQUARED, div, exp, log, mul, sqrt, toward_zero

# Fixed values that results depend on (nine decimals).
NEUTRAL = 1500 * ONE
SCALE = 173_717_800_000
INITIAL_RD = MAX_RD = 350 * ONE
INITIAL_VOLATILITY = 60_000_000
TAU = ONE // 2
STEP = 1000
LIMIT = 100
TRUSTED_RD = 30 * ONE


class Rating(NamedTuple):
    rating: int = NEUTRAL
    rd: int = INITIAL_RD
    volatility: int = INITIAL_VOLATILITY
    games: int = 0


def impact(phi: int) -> int:
    """How much a game against an opponent of deviation phi tells."""
    return div(ONE, sqrt(ONE + div(3 * mul(phi, phi), PI_SQUARED)))


def expected(mu: int, other: int, weight: int) -> int:
    return div(ONE, ONE + exp(-mul(weight, mu - other)))


def _volatility(sigma: int, phi2: int, v: int, delta2: int, tau: int) -> int:
    start, tau2 = log(mul(sigma, sigma)), mul(tau, tau)

    def slope(x: int) -> int:
        e = exp(x)
        whole = phi2 + v + e
        return div(mul(e, delta2 - whole), 2 * mul(whole, whole)) - div(x - start, tau2)

    low = start
    if delta2 > phi2 + v:
        high = log(delta2 - phi2 - v)
    else:
        k = 1
        while k <= LIMIT and slope(start - k * tau) < 0:
            k += 1
        high = start - k * tau
    at_low, at_high = slope(low), slope(high)
    for _ in range(LIMIT):
        width = high - low
        if abs(width) <= STEP:
            break
        new = low + div(mul(width, at_low), at_low - at_high)
        at_new = slope(new)
        if mul(at_new, at_high) <= 0:
            low, at_low = high, at_high
        else:
            at_low = toward_zero(at_low, 2)
        high, at_high = new, at_new
    return exp(toward_zero(low, 2))


def _period(was: Rating, information: int, gain: int, games: int, tau: int) -> Rating:
    """information: sum of g^2 E (1 - E); gain: sum of g (score - E)."""
    mu, phi = div(was.rating - NEUTRAL, SCALE), div(was.rd, SCALE)
    phi2, v = mul(phi, phi), div(ONE, max(information, 1))
    delta = mul(v, gain)
    sigma = _volatility(was.volatility, phi2, v, mul(delta, delta), tau)
    new2 = div(ONE, div(ONE, phi2 + mul(sigma, sigma)) + div(ONE, v))
    rd = mul(sqrt(new2), SCALE)
    return Rating(mul(mu + mul(new2, gain), SCALE) + NEUTRAL, min(max(rd, 0), MAX_RD), sigma, was.games + games)


def period(was: Rating, games: Iterable[tuple[int, int, int]], tau: int = TAU) -> Rating:
    """One period of games (opponent's rating, opponent's rd, score); without games only the deviation grows."""
    mu = div(was.rating - NEUTRAL, SCALE)
    information = gain = n = 0
    for rating, rd, score in games:
        g = impact(div(rd, SCALE))
        e = expected(mu, div(rating - NEUTRAL, SCALE), g)
        information += mul(mul(g, g), mul(e, ONE - e))
        gain += mul(g, score - e)
        n += 1
    if not n:
        phi = div(was.rd, SCALE)
        wider = mul(sqrt(mul(phi, phi) + mul(was.volatility, was.volatility)), SCALE)
        return was._replace(rd=min(wider, MAX_RD))
    return _period(was, information, gain, n, tau)


@lru_cache(200_000)
def uniform_period(was: Rating, opponent_rd: int, games: int, sum_score: int, tau: int = TAU) -> Rating:
    """One period of games against the neutral rating with one deviation: equal scores, the remainder in the last."""
    if games <= 0 or was.games + games > INT64_MAX:
        raise ValueError(f"a period needs games, and not too many: {games}")
    mu, g = div(was.rating - NEUTRAL, SCALE), impact(div(opponent_rd, SCALE))
    e = expected(mu, 0, g)
    each = toward_zero(sum_score, games)
    last = sum_score - each * (games - 1)
    information = games * mul(mul(g, g), mul(e, ONE - e))
    gain = (games - 1) * mul(g, each - e) + mul(g, last - e)
    if not (INT64_MIN <= last <= INT64_MAX and information <= INT64_MAX and INT64_MIN <= gain <= INT64_MAX):
        raise OverflowError("the period's sums exceed 64 bits")
    return _period(was, information, gain, games, tau)


def trust_rd(weight: float) -> int:
    """The deviation of a source trusted with a weight between 0 and 1."""
    return round(INITIAL_RD + (TRUSTED_RD - INITIAL_RD) * min(max(weight, 0.0), 1.0))


# --- columns ------------------------------------------------------------------------------------------------------


def eff_mu(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    """The conservative rating, two deviations down."""
    return _col(rating) - 2 * _col(rd)


def eff_mu_display(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    return F.round(eff_mu(rating, rd) / F.lit(1e9), 3)


def refuted(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    """Whether even two deviations up the rating is below neutral."""
    return _col(rating) + 2 * _col(rd) < NEUTRAL


def belief_logit(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    return (eff_mu(rating, rd) - NEUTRAL) / F.lit(1e9) / F.lit(400.0 / ln(10.0))


def edge_strength(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    """Expected score against neutral; the other side's certainty is this one's."""
    phi = _col(rd) / F.lit(float(SCALE))
    g = 1 / F.sqrt(1 + 3 * phi * phi / F.lit(PI_SQUARED / 1e9))
    return 1 / (1 + F.exp(-g * (_col(rating) - NEUTRAL) / F.lit(float(SCALE))))


def walk_edge_weight(rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    return 2 * edge_strength(rating, rd) - 1


def edge_rank(rank: str | Column = "rank", rating: str | Column = "rating", rd: str | Column = "rd") -> Column:
    return F.coalesce(_col(rank), F.lit(0.0)) * eff_mu(rating, rd) / F.lit(1e9)


def weight(mode: str, rating: str = "rating", rd: str = "rd", rank: str = "rank") -> Column:
    """conservative, salience, complete or strength; another mode is an error."""
    modes = {
        "conservative": lambda: eff_mu(rating, rd) / F.lit(1e9),
        "salience": lambda: edge_rank(rank, rating, rd),
        "complete": lambda: walk_edge_weight(rating, rd),
        "strength": lambda: edge_strength(rating, rd),
    }
    return modes[mode]()


def score(value: str | Column, middle: float) -> Column:
    """A signed value squashed to a score of 0 to 1 (nine decimals); 0 is a draw."""
    v = _col(value).cast("double")
    return F.round(0.5 * (1 + v / (F.lit(middle) + F.abs(v))) * 1e9).cast("long")


def score_inverse(score_fp: str | Column, middle: float) -> Column:
    u = 2 * _col(score_fp) / F.lit(1e9) - 1
    return F.lit(middle) * u / (1 - F.abs(u))


def outcome(games: str | Column, sum_score: str | Column) -> Column:
    """2 confirmed, 1 drawn, 0 refuted, by the mean score."""
    twice, whole = 2 * _col(sum_score), _col(games) * ONE
    return F.when(twice > whole, 2).when(twice < whole, 0).otherwise(1).cast("short")


def verdict(rating: str = "rating", rd: str = "rd", volatility: str = "volatility") -> Column:
    return F.when(refuted(rating, rd), "refuted").when(eff_mu(rating, rd) > NEUTRAL, "confirmed").when(_col(volatility) > F.lit(1.5 * INITIAL_VOLATILITY), "contested").otherwise("thin")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
