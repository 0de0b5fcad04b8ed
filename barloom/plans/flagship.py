"""First question answered end to end.

Which securities closed above their 10-session average after being at or below
it, while their last completed weekly close was above its 13-week EMA, ranked
per day by 20-session return?
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators import features as FT, signals as SG
from barloom.plans import grid


def weekly_trend_crosses(bars: DataFrame, calendar: DataFrame, tie_domain: str = "barloom/tie-break/v1") -> DataFrame:
    from barloom.functions.canonical import tie_break

    rule = next(r for r in grid.rules() if r.name == "weekly-ema13-above__close-cross-sma10")
    names = {*rule.facts}
    matrix = FT.feature_matrix(bars, calendar, [f for f in grid.FEATURES if f.name in names])
    matrix = matrix.withColumn("adv", FT.average_dollar_volume(grid.ADV_LOOKBACK))
    hits = SG.with_entry_session(SG.rule_hits(matrix, [rule], grid.PRIORITY, "adv"), calendar)
    tied = hits.withColumn(
        "tie", tie_break(tie_domain, F.sha2(F.col("rule"), 256), F.col("signal_session"), F.col("security_id"))
    )
    return SG.priority_order(tied, ["signal_session"], grid.PRIORITY, "tie").select(
        "security_id", "signal_session", "entry_session", "daily_close", "daily_sma10", "weekly_close",
        "weekly_ema13", "daily_return20", "priority_rank",
    )
