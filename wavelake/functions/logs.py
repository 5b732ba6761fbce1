"""Expressions over log lines. Patterns have no look-around, so that Java's and RE2's engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line formats, level flags, masks and volatile patterns, each in order.
SIM_LINE = r"^(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+\[\s*(\d+)ms\]\s+<(\w+)\s*>\s+(\S+?)\s*:\s+(.*)$"
UNIFIED_LINE = r"^(\d{4}-\d{2}-\d{2} [\d:.]+)\s+(\S+)\s+([A-Za-z0-9_.-]+)(?:\[[\d:]+\])?\s*(?:\[([^\]]*)\]\s*)?(.*)$"
LEVEL_FLAGS = {"Df": "DEBUG", "I": "INFO", "Nt": "NOTICE", "Er": "ERROR", "Wn": "WARN", "Ft": "ERROR", "<Notice>": "NOTICE"}
KEY_VALUE = r'(\w+)=("[^"]*"|\S+)'
MAC = r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b"
ADDRESS = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
MOMENT = r"\b\d{4}-\d{2}-\d{2}T[\d:.]+Z?\b"
MASKS = (
    (MAC, "<MAC>"),
    (ADDRESS, "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (MOMENT, "<TIME>"),
    (r"\b\d+\.\d+\b", "<FLOAT>"),
    (r"\b\d+\b", "<NUM>"),
)
VOLATILE = (MAC, ADDRESS, MOMENT, r"elapsed_ms=\d+", r"timeout_ms=\d+", r"total_ms=\d+", r"\bseed=\d+", r"\baid=\d+", r"\breplay=\d+", r"\brssi=-?\d+")
ERRORS = ("ERROR", "WARN")


def sim_part(raw: Column, i: int) -> Column:
    """Group i of the fixed-width format, null if the line has another."""
    return F.when(raw.rlike(SIM_LINE), F.regexp_extract(raw, SIM_LINE, i))


def unified_part(raw: Column, i: int) -> Column:
    return F.when(raw.rlike(UNIFIED_LINE), F.regexp_extract(raw, UNIFIED_LINE, i))


def flag_level(flag: Column) -> Column:
    out = F.lit("INFO")
    for k, v in LEVEL_FLAGS.items():
        out = F.when(flag == k, v).otherwise(out)
    return out


def extract_fields(message: Column) -> Column:
    """key=value pairs as a map; the last of a key counts, quotes go."""
    pairs = F.regexp_extract_all(message, F.lit(KEY_VALUE), F.lit(0))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(F.substr(x, F.instr(x, "=") + 1), r'^"+|"+$', "").alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def int_field(fields: Column, key: str, default: int | None = None) -> Column:
    """The integer of a field, or the default."""
    return F.coalesce(F.element_at(fields, key).try_cast("int"), F.lit(default).cast("int"))


def mask(message: Column) -> Column:
    for pattern, sign in MASKS:
        message = F.regexp_replace(message, pattern, sign)
    return message


def tokens(message: Column) -> Column:
    return F.filter(F.split(mask(message), r"\s+"), lambda x: x != "")


def scrub(text: Column) -> Column:
    """Without what differs between runs of one bug."""
    for pattern in VOLATILE:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def severity(level: Column) -> Column:
    return F.when(level == "ERROR", "error").when(level == "WARN", "warning").otherwise("info")
