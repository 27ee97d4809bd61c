"""Text and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date whole, else a number with thousands marks, else a plain one.
NUMBER = r"(\d{4}-\d{2}-\d{2}|-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)"


def clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_code(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit("."), F.lit(1))


def scrub_number(text: Column, suffix: str = "") -> Column:
    """A number of a table cell: nothing and ``-`` are null, thousands marks, percent signs and the suffix go; others fail."""
    bare = F.regexp_replace(F.trim(text), f"[,%]|{suffix}$" if suffix else "[,%]", "")
    return F.when(~F.trim(text).isin("", "-"), bare.cast("double"))


def trimmed_number(x: Column) -> Column:
    """At most four decimals, no trailing zeros, no negative zero."""
    bare = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    return F.when(x.isNotNull(), F.when(bare == "-0", "0").otherwise(bare))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def viewer_url(doc_id: Column, base: str = "https://viewer.example/doc?id=%s") -> Column:
    return F.when(doc_id.rlike("^[A-Za-z0-9]+$"), F.format_string(base, doc_id))


def mask_secrets(text: Column) -> Column:
    """Values of key-like parameters, whatever their case."""
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password|subscription-key)\s*[=:]\s*\"?)[^\"&\s]+", "$1***")


def first_four(text: Column) -> Column:
    return F.when(F.length(text) > 4, F.concat(F.left(text, F.lit(4)), F.repeat(F.lit("*"), F.length(text) - 4))).otherwise(F.repeat(F.lit("*"), F.length(text)))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def with_unit(value: Column, unit: Column) -> Column:
    """Money in millions, per share with two decimals, percent and times with one."""
    return (
        F.when(unit == "JPY", F.concat(F.format_number(value / 1e6, 0), F.lit(" M")))
        .when(unit == "JPY/share", F.format_number(value, 2))
        .when(unit == "%", F.concat(F.format_number(value, 1), F.lit("%")))
        .when(unit == "times", F.concat(F.format_number(value, 1), F.lit("x")))
        .otherwise(F.format_number(value, 0))
    )


def scale(largest: Column) -> Column:
    """The unit a series is shown in."""
    a = F.abs(largest)
    return F.when(a >= 1e12, 1e12).when(a >= 1e8, 1e8).when(a >= 1e6, 1e6).otherwise(1.0)


def thin(n: Column, k: int) -> Column:
    """About k indices of 0..n-1, evenly, both ends; ties to even."""
    step = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(k - 1)).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array_distinct(step))


def axis(low: Column, high: Column, zero: bool = False, pad: float = 0.08) -> Column:
    """Bounds of an axis: zero if asked, a flat range widened, padded."""
    a, b = (F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))) if zero else (low, high)
    flat = a == b
    wide = F.when(F.abs(a) > 0, F.abs(a) * 0.05).otherwise(F.lit(1.0))
    lo, hi = F.when(flat, a - wide).otherwise(a), F.when(flat, b + wide).otherwise(b)
    return F.struct((lo - (hi - lo) * pad).alias("lo"), (hi + (hi - lo) * pad).alias("hi"))


#: Exchange codes and names, a domestic code, notes that are known.
EXCHANGES = {
    "JPX": "東証",
    "TYO": "東証",
    "NMS": "NASDAQ",
    "NGM": "NASDAQ",
    "NCM": "NASDAQ",
    "NYQ": "NYSE",
    "PCX": "NYSE Arca",
    "ASE": "NYSE American",
}
DOMESTIC = r"^\d{3}[0-9A-Z]$"
KNOWN_NOTES = ("報告義務消失", "ポジション解消")
KNOWN_NOTE = r"^再IN（前回\d{4}-\d{2}-\d{2}）$"


def exchange_name(code: Column, shown: Column) -> Column:
    """By code, else as shown, else the code."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair]), code), shown, code)


def is_domestic_code(text: Column) -> Column:
    return F.coalesce(text.rlike(DOMESTIC), F.lit(False))


def is_domestic(symbol: Column) -> Column:
    return F.coalesce(symbol.endswith(".T"), F.lit(False))


def unknown_note(note: Column) -> Column:
    """A note to be warned of: there is one, and it isn't known."""
    return F.coalesce((note != "") & ~note.isin(*KNOWN_NOTES) & ~note.rlike(KNOWN_NOTE), F.lit(False))


def compact_volume(x: Column) -> Column:
    """In units of 100 million or ten thousand."""
    large, some = F.concat(F.format_number(x / 1e8, 2), F.lit("億")), F.concat(F.format_number(x / 1e4, 1), F.lit("万"))
    return F.when(x.isNull(), "—").when(F.abs(x) >= 1e8, large).when(F.abs(x) >= 1e4, some).otherwise(F.format_number(x, 0))


def delta_mark(now: Column, before: Column) -> Column:
    """``text, direction`` of a change: an arrow and percent; no percent over a zero, nothing where a value is missing."""
    change = now - before
    direction = F.when(change.isNull() | F.isnan(change.cast("double")), "na").when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    size = F.when(change == 0, F.lit(0.0)).when(before != 0, F.abs(change) / F.abs(before))
    shown = F.coalesce(F.concat(F.when(change > 0, "+").when(change < 0, "-").otherwise(""), F.format_number(size * 100, 1), F.lit("%")), F.lit("—"))
    arrow = F.when(direction == "up", "↑").when(direction == "down", "↓").otherwise("→")
    return F.struct(F.when(direction == "na", "—").otherwise(F.concat(arrow, shown)).alias("text"), direction.alias("direction"))


def range_place(low: Column, high: Column, now: Column, pad: float = 0.08) -> Column:
    """Where a value and its range stand on a track from 0 to 1 that holds both and some room; a flat track is widened."""
    a, b = F.least(low, high), F.greatest(high, low)
    bottom, top = F.least(a, now), F.greatest(b, now)
    wide = F.when(bottom == top, F.lit(1.0)).otherwise(F.lit(0.0))
    lo, hi = bottom - wide, top + wide
    lo, hi = lo - (hi - lo) * pad, hi + (hi - lo) * pad
    place = lambda x: (x - lo) / (hi - lo)
    there = low.isNotNull() & high.isNotNull() & now.isNotNull()
    return F.when(there, F.struct(place(a).alias("start"), place(b).alias("end"), place(now).alias("at")))


def in_millions(series: Column) -> Column:
    """Amounts of a series in millions; what is missing stays so."""
    return F.transform(series, lambda x: x.cast("double") / 1e6)


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
