"""The six-rule baseline score."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from paywarden.functions.columns import flag

# --- fixed values: amount above 5x the habit, burst of 4 in an hour ---------------------------------
HABIT_RATIO, BURST = math.log1p(5), 4
# ----------------------------------------------------------------------------------------------------


def rule_score() -> Column:
    """Number of rules a raw feature row fulfils, 0 to 6."""
    return (flag(F.col("amount_ratio_user_mean") > HABIT_RATIO) + F.col("is_new_device") + F.col("is_night")
            + F.col("is_near_full_drain") + F.col("is_foreign_ip") + flag(F.col("tx_count_1h") >= BURST))
