"""Calendar windows, recency and the criticality formula as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendlist import fixed


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def recency_weight(day: Column, until: Column, half_life_days=fixed.HALF_LIFE_DAYS) -> Column:
    """Halves every ``half_life_days`` before ``until``; 1 for no date or later dates."""
    age = F.greatest(F.datediff(until, day), F.lit(0))
    return F.when(day.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / F.lit(float(half_life_days))))


def negative_ratio(sentiment: Column) -> Column:
    """Share of negative rows (aggregate); 0 over no rows."""
    return F.coalesce(F.avg(F.when(sentiment == "negative", 1.0).otherwise(0.0)), F.lit(0.0))


def criticality(ratio: Column, mentions: Column, mean_weight: Column) -> Column:
    return ratio * F.log1p(mentions) * mean_weight


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where ``whole`` is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def priority_tier(negative: Column, mentions: Column) -> Column:
    share = safe_ratio(negative, mentions)
    tier = F.lit(fixed.LOWEST_TIER)
    for name, least, least_share in reversed(fixed.TIERS):
        tier = F.when((negative >= least) & (share >= least_share), name).otherwise(tier)
    return tier
