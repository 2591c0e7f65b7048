"""Column expressions for the two syslog line formats.

One regular expression runs once per line. It rewrites an accepted line to its header fields,
separated by single blanks (no header field can hold a blank), followed by the free text; the
fields are then cut with a limited ``split``. A leading line feed marks a match: lines are trimmed,
so no input starts with one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtables.functions.text import with_value

# Line grammars, severity names, time format. Possessive quantifiers, because a field
# once read is never given back.
STRUCTURED_FORMAT = r"^[^>]*>[0-9]"
PRIORITY = r"^<([0-9]++)>"
RFC5424_HEADER = (
    r"(?Us)^<([0-9]++)>([0-9]++)[ \t]++(\S*+)[ \t]++(\S*+)[ \t]++(\S*+)[ \t]++(\S*+)[ \t]++(\S*+)[ \t]++"
)
RFC5424_LINE = RFC5424_HEADER + r"(-|\[[^\]]*+\])[ \t]*+(.*)$"
RFC3164_LINE = r"(?s)^<([0-9]++)>([^ ]*+)[ \t]++([^ ]*+)[ \t]++([^ ]*+)[ \t]++([^ ]*+)[ \t]++(.*)$"
RFC3339_PLAIN = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:[0-5]\d(\.\d+)?([Zz]|[+-](0\d|1[0-7]):[0-5]\d)$"
RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}):(\d{2})(\.\d+)?(?:[Zz]|([+\-\u2212])(\d{2}):([0-5]\d))$"
SEVERITIES = ["emerg", "alert", "crit", "err", "warn", "notice", "info", "debug"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MAX_OCTET = 255
NIL = "-"
MATCHED = "\n"


def is_structured(line: Column) -> Column:
    """True where the first ``>`` is followed by a digit: the line is read as RFC 5424."""
    return line.rlike(STRUCTURED_FORMAT)


def fields_5424(line: Column) -> Column:
    """[pri, version, time, host, app, procid, msgid, structured data + message]."""
    cut = F.regexp_replace(line, F.lit(RFC5424_LINE), F.lit(MATCHED + "$1 $2 $3 $4 $5 $6 $7 $8$9"))
    return F.split(cut, " ", 8)


def fields_3164(line: Column) -> Column:
    """[pri, host, message]; month, day and time carry no year and are dropped."""
    cut = F.regexp_replace(line, F.lit(RFC3164_LINE), F.lit(MATCHED + "$1 $5 $6"))
    return F.split(cut, " ", 3)


def fits_octet(digits: Column) -> Column:
    """True where a digit string is at most 255; long strings overflow to null, hence the coalesce."""
    return F.coalesce(digits.try_cast("int") <= MAX_OCTET, F.lit(False))


def nil_to_null(field: Column) -> Column:
    return F.nullif(field, F.lit(NIL))


def severity_name(severity: Column) -> Column:
    names = F.array(*[F.lit(name) for name in SEVERITIES])
    return F.coalesce(F.get(names, severity), F.lit("unknown"))


def rfc3339_time(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, null if it is not one.

    Plain times are cast. The rest goes the long way: second 60 counts as the second after 59, and
    offsets are applied by arithmetic, since a cast stops at 18 hours.
    """

    def from_parts(part: Column) -> Column:
        leap = part[1] == "60"
        seconds = F.when(leap, "59").otherwise(part[1])
        local = F.concat(part[0], F.lit(":"), seconds, part[2], F.lit("Z")).try_cast("timestamp")
        hours, minutes = part[4].try_cast("bigint"), part[5].try_cast("bigint")
        sign = F.when(part[3] == "+", 1).otherwise(-1)
        offset = F.when(part[3] == "", 0).otherwise(F.when(hours < 24, sign * (hours * 3600 + minutes * 60)))
        shift = F.when(leap, 1).otherwise(0) - offset
        return F.timestamp_micros(F.unix_micros(local) + shift * 1_000_000)

    parts = F.split(F.regexp_replace(text, F.lit(RFC3339), F.lit("$1T$2 $3 $4 $5 $6 $7")), " ")
    return F.when(text.rlike(RFC3339_PLAIN), F.upper(text).try_cast("timestamp")).when(
        text.rlike(RFC3339), with_value(parts, from_parts)
    )


def iso_time(ts: Column) -> Column:
    """``2023-10-11T22:14:15.003`` in UTC whatever the session's zone; the fraction has 0, 3 or 6 digits."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    whole = F.translate(utc_text(ts), " ", "T")
    millis = F.concat(whole, F.lit("."), F.lpad((micros / 1000).cast("bigint").cast("string"), 3, "0"))
    full = F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    return F.when(micros == 0, whole).when(micros % 1000 == 0, millis).otherwise(full)


def utc_text(ts: Column) -> Column:
    """``2023-10-11 22:14:15`` in UTC. A time without zone is formatted, as no session zone moves it."""
    seconds = F.floor(F.unix_micros(ts) / F.lit(1_000_000))
    since = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return since.cast("string")


def utc_date(ts: Column) -> Column:
    """The day in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def short_time(ts: Column) -> Column:
    """``Oct 11 22:14:15`` in UTC."""
    text = utc_text(ts)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(text, 6, 2).cast("int"))
    return F.concat(month, F.lit(" "), F.substring(text, 9, 11))
