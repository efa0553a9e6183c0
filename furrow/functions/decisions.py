"""Signals, probabilities, votes and confidence of buy/hold/sell decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean buy or sell.
BUY_WORDS = ["BUY", "UP", "LONG", "상승", "매수"]
SELL_WORDS = ["SELL", "DOWN", "SHORT", "하락", "매도"]


def recommendation_signal(recommendation: Column) -> Column:
    word = F.upper(F.trim(recommendation))
    return F.when(word.isin(*BUY_WORDS), 1).when(word.isin(*SELL_WORDS), -1).otherwise(0)


def signal_with_fallback(recommendation: Column, p_buy: Column, p_hold: Column, p_sell: Column) -> Column:
    """The recommendation's signal, or the likeliest outcome's where it has none; ties go buy, hold, sell."""
    top = F.greatest(p_buy, p_hold, p_sell)
    likeliest = F.when(p_buy == top, 1).when(p_hold == top, 0).when(p_sell == top, -1).otherwise(0)
    stated = recommendation_signal(recommendation)
    return F.when(stated == 0, likeliest).otherwise(stated)


def synthetic_forecast(price: Column, signal: Column, step: float = 0.01) -> Column:
    return price * (1 + signal * step)


def normalised_probabilities(p_buy: Column, p_hold: Column, p_sell: Column) -> dict[str, Column]:
    """Non-negative and summing to one; nothing to go by gives .34 / .33 / .33."""
    floor = lambda p: F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0))
    total = floor(p_buy) + floor(p_hold) + floor(p_sell)
    even = {"p_buy": 0.34, "p_hold": 0.33, "p_sell": 0.33}
    given = {"p_buy": p_buy, "p_hold": p_hold, "p_sell": p_sell}
    return {name: F.when(total > 0, floor(p) / total).otherwise(even[name]) for name, p in given.items()}


def net_signal(p_buy: Column, p_sell: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(p_buy, zero) - F.coalesce(p_sell, zero)))


def trade_intensity(net: Column, gamma: float = 2.0, smallest: float = 0.06) -> Column:
    size = smallest + (1 - smallest) * F.pow(F.abs(net), F.lit(gamma))
    return F.least(F.lit(1.0), F.greatest(F.lit(smallest), size))


def intraday_volatility(high: Column, low: Column, close: Column) -> Column:
    return F.coalesce((high - low) / F.nullif(close, F.lit(0.0)), F.lit(0.0))


def evidence_scores(impact: Column) -> dict[str, Column]:
    """Scores an evidence article is shown with; absent sides get a token value."""
    return {
        "positive": F.when(impact > 0, impact).otherwise(0.1),
        "negative": F.when(impact < 0, F.abs(impact)).otherwise(0.1),
        "neutral": F.lit(0.5),
        "sentiment": F.when(impact > 0, "positive").when(impact < 0, "negative").otherwise("neutral"),
    }


# --- three-model vote ------------------------------------------------------------------------------------------------

# Class codes of the three-way model and their names.
TRI_NAMES = {0: "하락", 1: "상승", 2: "유지"}
# What the vote gives as its reason, by what the rise and drop models say and the three-way class.
VOTE_REASONS = {
    "rise only, 1": "3개 모델 모두 상승 예측 (강한 합의)",
    "drop only, 0": "3개 모델 모두 하락 예측 (강한 합의)",
    "neither, 1": "Bi 모델들 중립, Tri 모델 상승 예측",
    "neither, 0": "Bi 모델들 중립, Tri 모델 하락 예측",
    "neither, 2": "모든 모델이 중립적 신호",
    "both, 1": "Negative와 Tri 모델 상승 예측하나 Positive는 하락 예측 (부분 충돌)",
    "both, 0": "Positive와 Tri 모델 하락 예측하나 Negative는 상승 예측 (부분 충돌)",
    "both, 2": "모델 간 강한 충돌 (Negative 상승, Positive 하락, Tri 유지)",
}
OTHER_REASON = "모델 간 불일치, Tri 모델 예측 우선 적용"
AGREEMENT_WEIGHT = {"high": 1.0, "medium": 0.85, "low": 0.7}


def vote(says_up: Column, says_down: Column, tri: Column) -> dict[str, Column]:
    """Direction, agreement and reason from a rise model, a drop model and a three-way model (0 down, 1 up, 2 stable).

    The rule is a table of four cases: both specialists can agree with the three-way model, be silent, or clash.
    """
    up, down = says_up.cast("boolean"), says_down.cast("boolean")
    one_sided_up, one_sided_down = up & ~down & (tri == 1), down & ~up & (tri == 0)
    clash = up & down
    tri_name = F.element_at(F.create_map(*[F.lit(x) for pair in TRI_NAMES.items() for x in pair]), tri.cast("int"))
    direction = F.when(clash & (tri == 2), F.lit(TRI_NAMES[2])).otherwise(tri_name)
    agreement = (
        F.when(one_sided_up | one_sided_down, "high")
        .when((~up & ~down) | (clash & (tri != 2)), "medium")
        .otherwise("low")
    )
    backed = F.when(clash, "both").when(up, "rise only").when(down, "drop only").otherwise("neither")
    known = F.create_map(*[F.lit(x) for pair in VOTE_REASONS.items() for x in pair])
    reason = F.coalesce(F.try_element_at(known, F.concat_ws(", ", backed, tri.cast("int").cast("string"))), F.lit(OTHER_REASON))
    return {"direction": direction, "agreement": agreement, "vote_reason": reason}


def vote_probabilities(p_down: Column, p_up: Column, p_stable: Column, says_up: Column, up_confidence: Column,
                       says_down: Column, down_confidence: Column) -> dict[str, Column]:
    """Three-way probabilities, raised where a confident specialist backs a side, then summing to one."""
    raised = lambda p, on: F.when(on, F.least(p * 1.2, F.lit(0.95))).otherwise(p)
    up = raised(p_up, says_up.cast("boolean") & (up_confidence > 0.8))
    down = raised(p_down, says_down.cast("boolean") & (down_confidence > 0.8))
    total = up + down + p_stable
    return {"p_up": up / total, "p_down": down / total, "p_stable": p_stable / total}


def ensemble_confidence(agreement: Column, *confidences: Column) -> Column:
    """Mean confidence scaled by agreement, lower when the models' confidences spread, at most .95."""
    n = len(confidences)
    mean = sum(confidences[1:], confidences[0]) / n
    squares = [(c - mean) * (c - mean) for c in confidences]
    spread = F.sqrt(sum(squares[1:], squares[0]) / n)
    weight = F.when(agreement == "high", AGREEMENT_WEIGHT["high"]).when(agreement == "medium", AGREEMENT_WEIGHT["medium"])
    weight = weight.otherwise(AGREEMENT_WEIGHT["low"]) * F.when(spread > 0.2, 0.9).otherwise(1.0)
    return F.least(mean * weight, F.lit(0.95))
