"""Dates from text: the first value's spelling, taken apart into tokens, is the format of all; without one, each value is read by itself."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}"
# English names as dates are written with.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SHORT, SHORT_DAYS = [m[:3] for m in MONTHS], [d[:3] for d in DAYS]
ANY = "|".join(SHORT)


@dataclass
class Format:
    """How dates are written: what a value must match, and the pattern that reads it once ``drop`` is taken out."""

    match: str
    pattern: str
    drop: str | None = None

    def read(self, c: Column) -> Column:
        bare = F.regexp_replace(c, self.drop, "") if self.drop else c
        return F.when(c.rlike(self.match), F.try_to_timestamp(bare, F.lit(self.pattern)))


#: Field -> what a value has there, and the pattern's letters.
FIELDS = {
    "year": (r"\d{4}", "yyyy"), "month": (r"\d{1,2}", "M"), "day": (r"\d{1,2}", "d"), "hour": (r"\d{1,2}", "H"), "minute": (r"\d{1,2}", "m"), "second": (r"\d{1,2}", "s"), "fraction": (r"\d{1,9}", "SSSSSSSSS"),
    "month name": (f"(?:{'|'.join(MONTHS)})", "MMMM"), "short month": (f"(?:{ANY})", "MMM"), "offset": (r"(?:Z|[+-]\d{2}:\d{2})", "XXX"), "plain offset": (r"[+-]\d{4}", "XX"),
    "date": (r"\d{8}", "yyyyMMdd"), "clock": (r"\d{6}", "HHmmss"), "half": ("(?:AM|PM)", "a"), "short clock": (r"\d{4}", "HHmm"), "moment": (r"\d{14}", "yyyyMMddHHmmss"), "short moment": (r"\d{12}", "yyyyMMddHHmm"),
}
TOKEN = re.compile(r"\d+|[^\W\d_]+|.", re.S)


def fields_of(tokens: list[str], dayfirst: bool) -> list[str | None] | None:
    """The field of each token, None for one that stands for itself; None at all where the spelling is not one that tells a format."""
    fields: list[str | None] = [None] * len(tokens)
    number = [t.isdecimal() and t.isascii() for t in tokens]
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else ""
    named = False
    for i, t in enumerate(tokens):
        if fields[i] or not number[i]:
            continue
        # Times: numbers between colons; what follows the seconds after a point is their fraction.
        if at(i + 1) == ":" and len(t) <= 2 and i + 2 < len(tokens) and number[i + 2] and at(i - 1) not in ("+", "-", ":"):
            fields[i], fields[i + 2] = "hour", "minute"
            if at(i + 3) == ":" and i + 4 < len(tokens) and number[i + 4]:
                fields[i + 4] = "second"
                if at(i + 5) == "." and i + 6 < len(tokens) and number[i + 6]:
                    fields[i + 6] = "fraction"
        elif at(i - 1) == "T":
            fields[i] = {1: "hour", 2: "hour", 4: "short clock", 6: "clock"}.get(len(t))
        elif at(i - 1) in ("+", "-") and any(f == "minute" for f in fields[:i]):
            if len(t) == 4:
                fields[i - 1] = "plain offset"
            elif len(t) == 2 and at(i + 1) == ":" and len(at(i + 2)) == 2:
                fields[i - 1] = "offset"
                tokens[i + 1], fields[i + 1], fields[i + 2] = "", "", ""
            else:
                return None
            fields[i] = ""
        elif len(t) in (8, 12, 14):
            fields[i] = {8: "date", 12: "short moment", 14: "moment"}[len(t)]
    for i, t in enumerate(tokens):
        if not t.isalpha() or not t.isascii():
            continue
        if t in MONTHS:
            fields[i], named = "month name", True
        elif t in SHORT:
            fields[i], named = "short month", True
        elif t in DAYS or t in SHORT_DAYS:
            fields[i] = "weekday" if t in DAYS else "short weekday"
        elif t == "Z" and i == len(tokens) - 1:
            fields[i] = "offset"
        elif t in ("UTC", "GMT") and i == len(tokens) - 1:
            fields[i] = "zone"
        elif t in ("AM", "PM") and i > 1:
            hour = next((tokens[k] for k in range(i) if fields[k] == "hour"), "0")
            if (int(hour) == 12) != (t == "PM"):
                return None  # the hour stands for another one
            fields[i] = "half"
        elif not (t == "T" and i and number[i - 1] or t in ("st", "nd", "rd", "th") and number[i - 1]):
            return None
    rest = [i for i, t in enumerate(tokens) if number[i] and fields[i] is None]
    long = [len(tokens[i]) == 4 for i in rest]
    if any(len(tokens[i]) not in (1, 2, 4) for i in rest):
        return None
    if named:
        names = {(True, False): ("year", "day"), (False, True): ("day", "year")}.get(tuple(long))
    elif any(f in ("date", "moment", "short moment") for f in fields):
        names = () if not rest else None
    elif long == [True]:
        names = ("year",)
    elif long == [True, False]:
        names = ("year", "month")
    elif long == [True, False, False]:
        names = ("year", "month", "day")
    elif long == [False, False, True]:
        a, b = int(tokens[rest[0]]), int(tokens[rest[1]])
        names = ("day", "month", "year") if a > 12 or dayfirst and b <= 12 else ("month", "day", "year")
    else:
        names = None
    if names is None:
        return None
    for i, name in zip(rest, names, strict=True):
        fields[i] = name
    return fields if sum(f == "hour" for f in fields) <= 1 else None


def valid(fields: list, tokens: list[str]) -> bool:
    bounds = {"month": (1, 12), "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59)}
    return all(bounds[f][0] <= int(t) <= bounds[f][1] for f, t in zip(fields, tokens, strict=True) if f in bounds)


def format_of(value: str, dayfirst: bool = False) -> Format | None:
    """The format that this value is written in. None where it has a two-digit year, an afternoon's hour, names in
    other cases, no day beside a month's name, or is no date."""
    tokens = TOKEN.findall(value.strip())
    fields = fields_of(tokens, dayfirst)
    if fields is None or not valid(fields, tokens):
        return None
    match, pattern, drop = "", "", []
    for field, token in zip(fields, tokens, strict=True):
        if field in ("weekday", "short weekday"):
            many = "|".join(DAYS if field == "weekday" else SHORT_DAYS)
            match += f"(?:{many})"
            drop.append(f"(?:{many})(?![a-z])")
        elif field == "hour" and "half" in fields:
            match, pattern = match + r"(?:0?[1-9]|1[0-2])", pattern + "h"
        elif field == "zone":
            match, pattern = match + token, pattern + "VV"
        elif field:
            match, pattern = match + FIELDS[field][0], pattern + FIELDS[field][1]
        elif field is None:
            match += re.escape(token)
            pattern += "''" if token == "'" else f"'{token}'" if token.isalpha() or token in "[]{}#" else token
    return Format(rf"(?i)^\s*{match}\s*$", pattern, f"(?i){'|'.join(drop)}" if drop else None)


def loose(c: Column, dayfirst: bool = False) -> Column:
    """Each value by itself: numbers with any separators, names of months in any case and length, two-digit years
    within fifty years of today, clocks of twelve or twenty-four hours, offsets."""
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAYS) + r")[,. ]+", "")
    t = F.regexp_replace(t, r"(?<=\d)[T ]+(?=\d{1,2}:)", " ")
    t = F.regexp_replace(t, r"(?i)(?<=\d) *([ap])\.?m\.?$", " $1M")
    t = F.regexp_replace(t, r"(?<=\d)T(\d{1,2})$", " $1:00")
    t = F.regexp_replace(t, r"^(\d{8})T(\d{6})$", "$1$2")
    t = F.regexp_replace(t, r"(:\d\d(?:\.\d+)?) *(Z|[+-]\d\d:\d\d)$", "$1 $2")
    t = F.regexp_replace(t, r"^(\d{1,4})[-/. ](\d{1,2})[-/. ](\d{1,4})(?![\d:])", "$1-$2-$3")
    t = F.regexp_replace(t, rf"(?i)(?<=\d)(?:st|nd|rd|th)?[-/., ]*({ANY})[a-z]*[-/., ]*(?=\d)", " $1 ")
    t = F.regexp_replace(t, rf"(?i)^({ANY})[a-z]*[-/., ]+(\d{{1,4}})(?:st|nd|rd|th)?,? *", "$1 $2 ")
    t = F.trim(t)
    clock, half, zone = r"(?: \d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)?", r" \d{1,2}(?::\d{1,2}(?::\d{1,2})?)? [ap]M", r"(?: (?:Z|[+-]\d\d:\d\d))?"
    year, two, name = r"\d{4}", r"\d{1,2}", f"(?:{ANY})"
    first, second = (("d-M", "M-d") if dayfirst else ("M-d", "d-M"))
    forms = [(f"{year}-{two}-{two}", "yyyy-M-d"), (f"{two}-{two}-{year}", f"{first}-yyyy"), (f"{two}-{two}-{year}", f"{second}-yyyy"), (f"{two} {name} {year}", "d MMM yyyy"), (f"{name} {two} {year}", "MMM d yyyy"), (f"{year} {name} {two}", "yyyy MMM d"), (f"{name} {year}", "MMM yyyy"), (r"\d{8}", "yyyyMMdd"), (r"\d{14}", "yyyyMMddHHmmss"), (year, "yyyy"), (f"{year}-{two}", "yyyy-M")]
    short = [(r"(?:3[2-9]|[4-9]\d)-\d{1,2}-\d{1,2}", "yy-M-d"), (rf"{two}-{two}-\d{{2}}", f"{first}-yy"), (rf"{two}-{two}-\d{{2}}", f"{second}-yy")]
    both = lambda m, p: [Format(f"(?i)^{m}{clock}{zone}$", f"{p}[ H:m[:s[.SSSSSSSSS]]][ XXX]").read(t), F.coalesce(*[Format(f"(?i)^{m}{half}$", f"{p} {h}").read(F.upper(t)) for h in ("h:m[:s] a", "h a")])]
    whole = [x for f in forms for x in both(*f)]
    far = lambda x: F.when(F.year(x) >= F.year(F.current_date()) + 50, x - F.expr("interval 100 years")).otherwise(x)
    return F.coalesce(*whole, *[far(x) for f in short for x in both(*f)])


def to_date(c: Column, all_iso: Column | bool, dayfirst: bool = False, first: str | None = None) -> Column:
    """A text as timestamp, null where it cannot be read. With ``all_iso`` a time part makes it unreadable.

    The format of the column's ``first`` value is the format of all, and values in another one are null; where that
    value tells no format, each is read by itself.
    """
    strict = F.when(c.rlike(ISO + r"\s*$"), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")))
    known = format_of(first, dayfirst) if first is not None and all_iso is not True else None
    other = known.read(F.trim(c)) if known else loose(c, dayfirst)
    if isinstance(all_iso, bool):
        return strict if all_iso else other
    return F.when(all_iso, strict).otherwise(other)
