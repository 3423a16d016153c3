"""Formatting epoch seconds with % codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that are a date pattern, and codes that are plain text.
PATTERNS = {"Y": "y", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "m": "MM", "d": "dd", "a": "EEE", "A": "EEEE", "H": "HH", "M": "mm", "S": "ss"}
TEXTS = {"%": "%", "n": "\n", "t": "\t"}


def strftime(format: str, seconds: Column) -> Column:
    """Text of a time in the session's time zone. Fixed rules of a few codes: %j counts days from 0 without zeros,
    %u has Sunday as 1, %I is the hour modulo 12, %p is a.m. or p.m., %XS has hundredths, %Xs is the number itself.
    Codes are replaced from left to right; unknown ones stay.
    """
    ts = F.timestamp_micros(F.floor(seconds.cast("double") * 1e6).cast("long"))
    pad = lambda n, w, c="0": F.lpad(n.cast("string"), w, c)
    parts: list[Column] = []
    i = 0
    while i < len(format):
        c = format[i]
        if c != "%" or i + 1 >= len(format):
            parts.append(F.lit(c))
            i += 1
            continue
        code = format[i + 1]
        i += 2
        if code == "X" and i < len(format) and format[i] in "Ss":
            fraction = F.format_string("%05.2f", F.second(ts) + F.pmod(seconds.cast("double"), F.lit(1.0)))
            parts.append(fraction if format[i] == "S" else seconds.cast("double").cast("string"))
            i += 1
        elif code in TEXTS:
            parts.append(F.lit(TEXTS[code]))
        elif code in PATTERNS:
            parts.append(F.date_format(ts, PATTERNS[code]))
        elif code == "C":
            parts.append(pad(F.floor(F.year(ts) / 100) % 100, 2))
        elif code == "j":
            parts.append((F.dayofyear(ts) - 1).cast("string"))
        elif code == "e":
            parts.append(pad(F.dayofmonth(ts), 2, " "))
        elif code in "wu":
            parts.append((F.dayofweek(ts) - (1 if code == "w" else 0)).cast("string"))
        elif code == "I":
            parts.append(pad(F.hour(ts) % 12, 2))
        elif code == "p":
            parts.append(F.when(F.hour(ts) < 12, "a.m.").otherwise("p.m."))
        else:
            parts.append(F.lit("%" + code))
    return F.concat(*parts) if parts else F.lit("")
