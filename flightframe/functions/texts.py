"""Texts of rates, durations, segments, modes, winds and parameter values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flight-mode names by number, fixed-wing and multi-rotor.
# fmt: off
PLANE_MODES = {
    0: "MANUAL", 1: "CIRCLE", 2: "STABILIZE", 3: "TRAINING", 4: "ACRO", 5: "FBWA", 6: "FBWB", 7: "CRUISE", 8: "AUTOTUNE", 10: "AUTO",
    11: "RTL", 12: "LOITER", 13: "TAKEOFF", 14: "AVOID_ADSB", 15: "GUIDED", 16: "INITIALISING", 17: "QSTABILIZE", 18: "QHOVER",
    19: "QLOITER", 20: "QLAND", 21: "QRTL", 22: "QAUTOTUNE", 23: "QACRO", 24: "THERMAL",
}
COPTER_MODES = {
    0: "STABILIZE", 1: "ACRO", 2: "ALT_HOLD", 3: "AUTO", 4: "GUIDED", 5: "LOITER", 6: "RTL", 7: "CIRCLE", 9: "LAND", 11: "DRIFT",
    13: "SPORT", 14: "FLIP", 15: "AUTOTUNE", 16: "POSHOLD", 17: "BRAKE", 18: "THROW", 19: "AVOID_ADSB", 20: "GUIDED_NOGPS",
    21: "SMART_RTL", 22: "FLOWHOLD", 23: "FOLLOW", 24: "ZIGZAG", 25: "SYSTEMID", 26: "AUTOROTATE",
}
# fmt: on


def rate_text(rate: Column) -> Column:
    """0 Hz; no decimals from 100, one from 1, else two."""
    return F.when(rate <= 0, "0 Hz").when(rate >= 100, F.format_string("%.0f Hz", rate)).when(rate >= 1, F.format_string("%.1f Hz", rate)).otherwise(F.format_string("%.2f Hz", rate))


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s (3723.0 s), leading zero parts left out; whole seconds are rounded half to even."""
    whole = F.bround(seconds, 0).cast("long")
    h, m, s = (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60
    head = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.concat(head, F.format_string(" (%.1f s)", seconds))


def flight_time_text(longest: Column, flights: Column, total: Column) -> Column:
    """The longest flight, else the whole log, else N/A."""
    several = F.when(flights > 1, F.format_string(" (Longest of %d flights)", flights)).otherwise("")
    whole = F.bround(total, 0).cast("long")
    full = F.format_string("%dm %ds (%.1f s) [Full Log]", (whole / 60).cast("long"), whole % 60, total)
    return F.when(longest > 0, F.concat(duration_text(longest), several)).when(total > 0, full).otherwise("N/A")


def wind_text(mean: Column, most: Column) -> Column:
    both = F.format_string("Avg: %.1f m/s (%.1f km/h) | Max: %.1f m/s (%.1f km/h)", mean, mean * 3.6, most, most * 3.6)
    return F.when(mean.isNotNull() & most.isNotNull(), both).otherwise("N/A (No wind data)")


def short_number(x: Column) -> Column:
    """One decimal, without a trailing .0."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def segment_text(idx: Column, start: Column, end: Column, duration: Column, longest: Column) -> Column:
    text = F.concat(F.lit("Segment "), (idx + 1).cast("string"), F.lit(" ("), short_number(start), F.lit("s ~ "), short_number(end), F.lit("s, dt="), short_number(duration), F.lit("s)"))
    return F.concat(text, F.when(longest, " *").otherwise(""))


def mode_name(mode: Column, copter: Column) -> Column:
    """Digits by table (MODE_n if unknown), A/B as A, upper case."""
    text = F.trim(mode)
    tables = (F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) for names in (PLANE_MODES, COPTER_MODES))
    digits, number = text.rlike("^[0-9]+$"), text.try_cast("int")
    plane, rotor = (F.try_element_at(t, number) for t in tables)
    unknown = F.concat(F.lit("MODE_"), F.regexp_replace(text, "^0+(?=.)", ""))
    return F.when(digits, F.coalesce(F.when(copter, rotor).otherwise(plane), unknown)).otherwise(F.upper(F.trim(F.split(text, "/")[0])))


def clean_text(text: Column) -> Column:
    """Without a literal b'..' wrapper, NULs (also written out) and outer blanks."""
    inner = F.regexp_replace(F.trim(text), r"""^b(?:'(.*)'|"(.*)")$""", "$1$2")
    return F.trim(F.regexp_replace(inner, r"\x00|\\x00", ""))


def value_text(value: Column) -> Column:
    """Whole numbers without decimals, other numbers with 6 significant digits (trailing zeros cut), texts cleaned."""
    number = value.try_cast("double")
    six = F.regexp_replace(F.format_string("%.6g", number), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    six = F.regexp_replace(six, r"\.(e|$)", "$1")
    return F.when(number.isNull(), clean_text(value)).when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(six)
