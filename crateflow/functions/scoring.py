"""Signals that a score of discovered tracks is made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, plays: Column) -> Column:
    """part / plays, 0 where nothing was played."""
    return F.when(plays > 0, part / plays).otherwise(0.0)


def velocity(likes: Column, created_at: Column, as_of: Column, least_hours: float = 1.0) -> Column:
    """Likes an hour since ``created_at``; 0 without likes or a time; what is younger than
    ``least_hours``, or from the future, counts as that old."""
    hours = F.timestamp_diff("MICROSECOND", created_at, as_of) / 3.6e9
    return F.when((likes > 0) & created_at.isNotNull(), likes / F.greatest(hours, F.lit(least_hours))).otherwise(0.0)


def recency(created_at: Column, as_of: Column, most_days: int = 14) -> Column:
    """1 for today down to 0 for ``most_days`` whole days ago or an unknown time; above 1 for the future."""
    days = F.floor(F.timestamp_diff("MICROSECOND", created_at, as_of) / 8.64e10)
    return F.greatest(F.lit(0.0), 1.0 - F.coalesce(days, F.lit(most_days)) / most_days)


def spam_reasons(reposts: Column, likes: Column, comments: Column, texts: Column, phrases: list[str]) -> Column:
    """Reasons to take a track for promotion, in a fixed order: many reposts for its likes, many
    reposts without comments, the first phrase that one of ``texts`` holds."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    lower = F.transform(F.filter(texts, lambda t: t.isNotNull()), F.lower)
    promo = F.when(F.lit(False), F.lit(""))

    def held(phrase: str) -> Column:
        return F.exists(lower, lambda t: F.contains(t, F.lit(phrase)))

    for phrase in [q for p in phrases if (q := p.strip().lower())]:
        promo = promo.when(held(phrase), f"promo: {phrase}")
    return F.array_compact(F.array(
        F.when((zero(reposts) >= 10) & (zero(reposts) > 3 * zero(likes)), "reposts over 3x likes"),
        F.when((zero(reposts) >= 50) & (zero(comments) <= 1), "reposts without comments"),
        promo,
    ))


def reputation_delta(likes: Column, downloads: Column, dislikes: Column, stars: Column, a_like: float = 5.0, a_download: float = 2.0, a_star: float = 2.0, most: float = 20.0, least_dislikes: int = 3, penalty: float = 15.0) -> Column:
    """What an artist's record adds to a score: a capped boost, or a penalty for dislikes alone."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    likes, downloads, dislikes, stars = map(zero, (likes, downloads, dislikes, stars))
    boost = a_like * likes + a_download * downloads + a_star * stars
    return F.when((likes == 0) & (downloads == 0) & (stars == 0) & (dislikes >= least_dislikes), -penalty).when(boost > 0, F.least(F.lit(most), boost)).otherwise(0.0)


def percent_change(current: Column, before: Column) -> Column:
    """Whole per cent of change, rounded half to even; null where there was nothing before."""
    return F.when(before > 0, F.bround(100.0 * (current - before) / before).cast("long"))


def rejection_reason(measured_ok: Column, report_reason: Column, download_error: Column, notes: Column, failed_note: str = "Download failed") -> Column:
    """Why a track goes to quarantine: the report's reason, the download's error, the last note of a
    failure; null where it does not."""
    failed = F.filter(notes, lambda n: n.startswith(failed_note) | F.contains(n, F.lit("quality check failed")))
    return F.when(~F.coalesce(measured_ok, F.lit(True)), F.coalesce(F.when(report_reason != "", report_reason), F.lit("quality check not passed"))).otherwise(
        F.coalesce(F.when(download_error != "", download_error), F.try_element_at(failed, F.lit(-1)))
    )
