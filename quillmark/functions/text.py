"""Text expressions: sanitising, names, labels, topics. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s ]+"


def squeezed(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def sanitised(text: Column) -> Column:
    """Dotted answer lines (three or more dots) become a space, then ``squeezed``."""
    return squeezed(F.regexp_replace(text, r"\.{3,}", " "))


def diagnostic_text(text: Column) -> Column:
    """Also drops underscore lines and page footers such as '[Turn over'."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"\.{3,}|_{3,}", " "), r"(?i)\[turn over\]?", " "))


def search_form(text: Column) -> Column:
    """Lower case without ASCII spaces; other white space stays."""
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def year_of(name: Column) -> Column:
    """From the first s, m or w and two digits; 50 and more are of the 1900s; 2024 without."""
    two = _extract(name, r"[smw](\d{2})").cast("int")
    return F.coalesce(F.when(two >= 50, 1900 + two).otherwise(2000 + two), F.lit(2024))


def paper_of(name: Column) -> Column:
    return F.coalesce(_extract(name, r"qp_(\d)").cast("int"), F.lit(1))


def variant_of(name: Column) -> Column:
    return F.coalesce(_extract(name, r"qp_\d(\d)").cast("int"), F.lit(1))


def exam_code_of(name: Column) -> Column:
    """Three to five digits before an underscore; else the digits of what stands before one; else that in lower case."""
    head = F.substring_index(name, "_", 1)
    return F.coalesce(_extract(name, r"^(\d{3,5})_"), F.nullif(F.regexp_replace(head, "[^0-9]", ""), F.lit("")), F.lower(head))


def paper_prefix(name: Column) -> Column:
    """What stands before the first _qp_ or _ms_; else the name without its extension."""
    return F.coalesce(_extract(name, r"^(.*?)_(?:qp|ms)_"), F.regexp_replace(name, r"\.[^.]*$", ""))


def label_depth(label: Column) -> Column:
    return F.regexp_count(label, F.lit(r"\("))


def label_kind(label: Column) -> Column:
    d = label_depth(label)
    return F.when(d == 0, "question").when(d == 1, "letter").otherwise("roman")


def parent_label(label: Column) -> Column:
    """The label up to its last '('; null for a root."""
    return _extract(label, r"^(.*)\([^(]*$")


def label_segments(label: Column) -> Column:
    return F.regexp_extract_all(label, F.lit(r"\(([^)]+)\)"), 1)


def roman_value(segment: Column) -> Column:
    """i, v and x by the subtractive rule; other characters count as 0."""
    value = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).otherwise(0)
    digits = F.transform(F.reverse(F.split(F.lower(segment), "")), value)
    step = lambda acc, v: F.struct(
        F.when(v < acc["high"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), F.greatest(acc["high"], v).alias("high")
    )
    return F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("high")), step, lambda acc: acc["sum"])


def label_sort_key(label: Column) -> Column:
    """Array of (class, value) by segment: letters first by place in the alphabet, then romans by value.

    A segment of i, v and x alone is roman, a single i, v or x too.
    """
    return F.transform(
        label_segments(label),
        lambda s: F.when(s.rlike("^[ivxIVX]+$"), F.struct(F.lit(1).alias("k"), roman_value(s).alias("v"))).otherwise(F.struct(F.lit(0).alias("k"), F.ascii(F.lower(s)).alias("v"))),
    )


def label_tokens(label: Column) -> Column:
    """'q1(a)(ii)' -> ['1', 'a', 'ii'], lower case."""
    return F.transform(F.regexp_extract_all(label, F.lit(r"(\d+|[A-Za-z]+)(?=[()\s]|$)"), 1), F.lower)


def canonical_topic(value: Column) -> Column:
    """'1) foo' -> '01. foo'; empty -> '00. Unknown'; without a number trimmed."""
    trimmed = F.trim(value)
    number, rest = F.regexp_extract(trimmed, r"^(\d+)\s*[.):-]\s*(.*)$", 1), F.regexp_extract(trimmed, r"^(\d+)\s*[.):-]\s*(.*)$", 2)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "00. Unknown").when(number != "", F.concat(F.lpad(F.regexp_replace(number, r"^0+(?=\d)", ""), F.greatest(F.lit(2), F.length(F.regexp_replace(number, r"^0+(?=\d)", ""))), F.lit("0")), F.lit(". "), rest)).otherwise(trimmed)


def topic_slug(value: Column) -> Column:
    """Without numeric prefix, lower case, spaces squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s*\d+\s*[.):-]\s*", "")), r"\s+", " "))


def phrase_pattern(phrase: Column) -> Column:
    """A whole-word pattern for a phrase, with an optional plural."""
    return F.concat(F.lit(r"\b"), F.regexp_replace(F.lower(squeezed(phrase)), r"([\\.^$|?*+()\[\]{}-])", r"\\$1"), F.lit(r"s?\b"))


def human_size(size: Column) -> Column:
    """Bytes with one decimal in steps of 1024."""
    out, unit = None, ["B", "KB", "MB", "GB", "TB"]
    for k, name in enumerate(unit):
        text = F.concat(F.format_string("%.1f", size / float(1024**k)), F.lit(f" {name}"))
        if k == len(unit) - 1:
            return out.otherwise(text)
        out = F.when(size < 1024 ** (k + 1), text) if out is None else out.when(size < 1024 ** (k + 1), text)
    return out


#: Fixed values of the model's tokens: units of quantities, signs of operations, command words, signs of powers.
UNITS = r"m/s|kg|j|v|cm\^3|mb|gb|kb|hz|ghz|bit|byte|ms|s|%"
OPERATORS = "[+\\-*/^=\u2265\u2264<>]"
COMMANDS = ("calculate", "describe", "explain", "state", "determine")
POWERS = "[\u00b2\u00b3]"


def token_text(text: Column) -> Column:
    """What the topic model reads: lower case, UNIT_VALUE, OPERATOR and RATE for quantities, signs and "per", then CMD_ tokens of the command words and NOTATION_POWER.

    White space is squeezed before tokens are put in, and not behind them.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\u00a0\\x00-\\x1f]+", " "), r"\s+", " ")
    out = F.lower(F.trim(clean))
    out = F.regexp_replace(out, r"\b\d+(?:\.\d+)?\s*(?:" + UNITS + r")\b", " UNIT_VALUE ")
    out = F.regexp_replace(F.regexp_replace(out, OPERATORS, " OPERATOR "), r"\bper\b", " RATE ")
    tags = [F.when(out.rlike(rf"\b{c}\b"), F.lit(f" CMD_{c.upper()} ")).otherwise("") for c in COMMANDS]
    return F.concat(out, *tags, F.when(out.rlike(POWERS), F.lit(" NOTATION_POWER ")).otherwise(""))


def model_text(text: Column) -> Column:
    """Lower case, control characters and no-break spaces as spaces, quantities with units as tokens."""
    out = F.lower(F.regexp_replace(text, r"[ \x00-\x1f]+", " "))
    out = F.regexp_replace(out, r"\b\d+(?:\.\d+)?\s*(?:mm|cm|km|kg|mg|ml|g|m|l|s|n|v|a|w|j)\b", " unit ")
    out = F.regexp_replace(out, r"[+*/=<>^]", " operator ")
    return F.trim(F.regexp_replace(out, " +", " "))
