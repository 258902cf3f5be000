"""File names as column expressions: cleaning, checking, splitting, labelling.

Lengths count code points; a name is cut at 180 of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may not occur in a stored name (and runs of dots), what is cut from its end, and names a desktop reserves for devices.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1F]'
DOT_RUN = r"\.\.+"
CUT_AT_END = ". "
MAX_NAME = 180
DEVICE_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"

# Extensions that run code when opened.
RISKY_EXTENSIONS = (
    ".exe", ".msi", ".bat", ".cmd", ".com", ".scr", ".pif", ".ps1", ".vbs", ".vbe", ".js", ".jse",
    ".wsf", ".wsh", ".hta", ".lnk", ".reg", ".cpl", ".jar", ".msc",
)

# Prefix of files still being received; a deployment passes its own.
IN_FLIGHT_PREFIX = ".incoming-"


def _trim(name: Column) -> Column:
    """Strip white space of any script from both ends. The end is stripped as the start of the reversed name: a pattern tied to
    the end would be tried at every blank of a long text."""
    led = F.regexp_replace(name, r"(?U)^\s+", "")
    return F.reverse(F.regexp_replace(F.reverse(led), r"(?U)^\s+", ""))


def sanitize_server(name: Column, instant_ms: Column) -> Column:
    """The name a receiver stores. Empty, ``.`` and ``..`` become ``upload-<instant_ms>``.

    The cut at 180 comes last and is not trimmed again, see :func:`is_landable`.
    """
    cleaned = F.regexp_replace(name, FORBIDDEN, "_")
    cleaned = F.regexp_replace(cleaned, DOT_RUN, "_")
    cleaned = F.rtrim(cleaned, F.lit(CUT_AT_END))
    cleaned = F.substring(_trim(cleaned), 1, MAX_NAME)
    fallback = F.concat(F.lit("upload-"), instant_ms.cast("string"))
    return F.when(F.coalesce(cleaned, F.lit("")).isin("", ".", ".."), fallback).otherwise(cleaned)


def sanitize_desktop(name: Column, in_flight_prefix: str = IN_FLIGHT_PREFIX) -> Column:
    """The name a desktop rename accepts; empty means "reject"."""
    cleaned = F.regexp_replace(_trim(F.coalesce(name, F.lit(""))), FORBIDDEN, "_")
    cleaned = F.rtrim(F.substring(cleaned, 1, MAX_NAME), F.lit(CUT_AT_END))
    guard = cleaned.startswith(in_flight_prefix) | stem_before_dot(cleaned).rlike(DEVICE_NAMES)
    return F.concat(F.when(guard, "_").otherwise(""), cleaned)


def is_landable(name: Column) -> Column:
    """True where cleaning the name again changes nothing."""
    return name == sanitize_server(name, F.lit(0))


def scan_name(captured: Column) -> Column:
    """Default name of a scan taken at ``captured`` (session time zone)."""
    return F.date_format(captured, "'Scan 'yyyy-MM-dd' at 'HH.mm.ss'.jpg'")


def decode_name(encoded: Column) -> Column:
    """Percent-decode a header value; ``+`` stays, a stray ``%`` stays, missing becomes empty."""
    literal = F.regexp_replace(F.replace(encoded, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(literal), F.lit(""))


def extension(name: Column) -> Column:
    """From the last dot on; empty when there is none or nothing follows it."""
    return F.regexp_extract(name, r"\.[^.]+$", 0)


def stem(name: Column) -> Column:
    """The name without :func:`extension` (a bare trailing dot stays)."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def stem_before_dot(name: Column) -> Column:
    """Everything before the last dot (a bare trailing dot is dropped too)."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension_badge(name: Column) -> Column:
    """Up to four upper-case characters of the extension, ``FILE`` without one."""
    letters = F.upper(F.substring(F.ltrim(extension(name), F.lit(".")), 1, 4))
    return F.when(letters == "", "FILE").otherwise(letters)


def is_risky(name: Column, extensions: tuple[str, ...] = RISKY_EXTENSIONS) -> Column:
    """True where the extension is in the list, whatever its letter case."""
    return F.lower(extension(name)).isin(*extensions)
