"""Text functions: timestamps, the comma-separated reading list, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlane.config import LOCATION_UNKNOWN, SEQUENCE_LENGTH

# the numeric prefix a browser's parseFloat accepts, at the start of each
# comma-separated item (after leading white space)
_ITEM_PREFIX = (r"(?:^|,)\s*([+-]?(?:Infinity|(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)"
                r"(?:[eE][+-]?[0-9]+)?))")


#: English month names and weekday names; three letters stand for them, too.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_WEEKDAY = r"(?i)^\s*(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + r")[.,]?\s+"
_MONTH = r"(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r"|sept)"
#: What may follow a date: nothing, or a time behind a space or T.
_REST = r"([ T].*)?$"
#: Date spellings beside ISO, in the order in which they are tried: pattern, and its parts as year|month|day|rest.
_SPELLINGS = [
    (r"^(\d{4})(\d{2})(\d{2})" + _REST, "$1|$2|$3|$4"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _REST, "$1|$2|$3|$4"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _REST, "$3|$1|$2|$4|either"),
    (r"(?i)^" + _MONTH + r"\.?[ -](\d{1,2})(?:st|nd|rd|th)?,?[ -](\d{4})" + _REST, "$3|$1|$2|$4"),
    (r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[ -]" + _MONTH + r"\.?,?[ -](\d{4})" + _REST, "$3|$2|$1|$4"),
    (r"(?i)^(\d{4})[ -]" + _MONTH + r"\.?[ -](\d{1,2})" + _REST, "$1|$2|$3|$4"),
]
_TWELVE_HOURS = r"(?i)^[ T]+(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}(?:\.\d+)?))?\s*([ap])\.?m\.?$"
_COMPACT_TIME = r"^[ T](\d{2})(\d{2})(\d{2})?$"


def one_json_value(text: Column) -> Column:
    """Whether the whole text is one JSON value: text behind it could pass as the end of an array or of an object around it, not of both."""
    return (F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))), F.lit(0)) == 1) & (
        F.coalesce(F.size(F.json_object_keys(F.concat(F.lit('{"a":'), text, F.lit("}")))), F.lit(0)) == 1)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _month_number(c: Column) -> Column:
    """The number of a month given by digits or by name."""
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    return F.coalesce(c.try_cast("int"), F.nullif(F.array_position(short, F.lower(F.left(c, F.lit(3)))), F.lit(0)).cast("int"))


def _time(rest: Column) -> Column:
    """A time of day in the form a cast reads."""
    def clock(t: Column) -> Column:  # hour|minute|second|a or p
        hour = F.get(t, F.lit(0)).try_cast("int")
        minute, second = (F.coalesce(F.nullif(F.get(t, F.lit(k)), F.lit("")), F.lit("00")) for k in (1, 2))
        text = F.concat(F.lit(" "), (hour % 12 + F.when(F.lower(F.get(t, F.lit(3))) == "p", 12).otherwise(0)).cast("string"), F.lit(":"), minute, F.lit(":"), second)
        return F.when(hour.between(1, 12), text).otherwise(" no time")

    return (F.when(rest.rlike(_TWELVE_HOURS), _let(F.split(F.regexp_replace(rest, _TWELVE_HOURS, "$1|$2|$3|$4"), r"\|"), clock))
            .when(rest.rlike(_COMPACT_TIME), F.regexp_replace(F.regexp_replace(rest, _COMPACT_TIME, "T$1:$2:$3"), ":$", ""))
            .otherwise(F.regexp_replace(rest, r"^([ T]\d{1,2}:\d{1,2})( ?Z| ?[+-]\d.*)$", "$1:00$2")))  # a zone needs seconds before it


def iso_text(text: Column) -> Column:
    """Dates in other spellings as ISO text, NULL where no spelling fits: ``2024/01/05 10:00``, ``01/05/2024`` (the month
    first, unless it cannot be one), ``Jan 5, 2024 10 pm``, ``5 January 2024``, ``20240105T1000``, a weekday in front."""
    def parts(bare: Column) -> Column:
        found = F.lit(None).cast("string")
        for pattern, order in reversed(_SPELLINGS):
            found = F.when(bare.rlike(pattern), F.regexp_replace(bare, pattern, order)).otherwise(found)
        return F.split(found, r"\|")

    def numbers(p: Column) -> Column:
        part = [F.get(p, F.lit(k)) for k in range(4)]
        return F.struct(part[0].alias("y"), _month_number(part[1]).alias("m"), part[2].try_cast("int").alias("d"), part[3].alias("rest"), (F.size(p) > 4).alias("either"))

    def written(v: Column) -> Column:
        m, d = v["m"], v["d"]
        swapped = v["either"] & (m > 12) & (d <= 12)
        date = [F.lpad(F.when(swapped, b).otherwise(a).cast("string"), 2, "0") for a, b in ((m, d), (d, m))]
        return F.concat(v["y"], F.lit("-"), date[0], F.lit("-"), date[1], _time(v["rest"]))

    bare = F.regexp_replace(F.btrim(text, F.lit(" \t\n\r")), _WEEKDAY, "")
    return _let(bare, lambda b: _let(parts(b), lambda p: _let(numbers(p), written)))


def parse_timestamp(c: Column, as_of: Column | None = None) -> Column:
    """Each value parsed on its own: ISO (with ``Z``, offsets or no zone), then the spellings of ``iso_text``;
    junk, and text without a date (which a cast would complete with today's),
    becomes NULL, or the caller's ``as_of`` when given (no wall clock)."""
    text = c.cast("string")
    iso = F.when(text.rlike(r"^\s*[+-]?\d{4,7}(-\d|\s*$)"), text).otherwise(iso_text(text))
    parsed = F.try_to_timestamp(iso)
    return parsed if as_of is None else F.coalesce(parsed, as_of)


def parse_reading_list(text: Column) -> Column:
    """Comma-separated text → ARRAY<DOUBLE> with prefix parsing.

    ``12abc`` → 12, `` 1e3`` → 1000, ``.5`` → 0.5, ``7.`` → 7; an item with
    no numeric prefix is dropped.  ``Infinity`` is kept as an infinite value
    (it is not NaN); it cannot be sent as JSON and later counts as missing.
    One regular expression over the whole text and one array cast: no
    per-element lambda, so it stays a plain JVM expression.
    """
    return F.regexp_extract_all(text, F.lit(_ITEM_PREFIX), 1).try_cast("array<double>")


def last_n_values(values: Column, n: int = SEQUENCE_LENGTH) -> Column:
    """The last ``n`` items, or NULL when fewer than ``n`` are present.
    The list is bound once (as the only element of an array): size and slice do not parse the text again."""
    return F.get(F.transform(F.array(values), lambda v: F.when(F.size(v) >= n, F.slice(v, -n, n))), F.lit(0))


def hourly_stamp(as_of: Column, pos: Column, n: Column | int) -> Column:
    """Stamp of item ``pos`` of ``n``: ``as_of - (n - 1 - pos)`` hours."""
    n_col = F.lit(n) if isinstance(n, int) else n
    hours_back = (n_col - F.lit(1) - pos).cast("int")
    return as_of - F.make_dt_interval(hours=hours_back)


def first_non_null_name(*names: Column, default: str = LOCATION_UNKNOWN) -> Column:
    """First name that is neither NULL nor empty, else the default."""
    return F.coalesce(*[F.when(n != "", n) for n in names], F.lit(default))
