"""Progress figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """65 as 1м 05с, 3700 as 1ч 01м, null as a dash. Halves are rounded to even."""
    s = F.bround(seconds, 0).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("м "), two(s % 60), F.lit("с"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("ч "), two(F.floor(s % 3600 / 60)), F.lit("м"))
    return F.when(s.isNull(), "—").when(s < 60, F.concat(s.cast("string"), F.lit("с"))).when(s < 3600, minutes).otherwise(hours)


def fraction(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(done, total))))


def make_bar(done: Column, total: Column, width: int = 20) -> Column:
    f = fraction(done, total)
    filled = F.bround(f * width, 0).cast("int")
    percent = F.lpad(F.bround(f * 100, 0).cast("int").cast("string"), 3, " ")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("] "), percent, F.lit("%"))


def estimate_eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the speed so far; 0 when done, null while nothing is known."""
    idle = (done <= 0) | (elapsed <= 0) | (total <= done)
    return F.when(idle, F.when((total != 0) & (done >= total), F.lit(0.0))).otherwise(F.try_divide((total - done) * elapsed, done))


def format_progress(done: Column, total: Column, elapsed: Column, active: Column, failed: Column) -> Column:
    speed = F.when(elapsed > 0, F.try_divide(done, elapsed)).otherwise(F.lit(0.0))
    return F.concat(make_bar(done, total), F.format_string(" %d/%d | %.1f стр/с | осталось ~%s | активных: %d | ошибок: %d", done, total, speed, format_duration(estimate_eta(done, total, elapsed)), active, failed))
