r"""Text, time and severity expressions.

Trimming strips all Unicode white space, unlike Spark's ``trim``, which strips blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.schema import SEVERITIES

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
NAIVE_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"
#: Whole numbers above this are epoch milliseconds, others epoch seconds.
MILLIS_FROM = 1_000_000_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def present(c: Column | str) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def utc(c: Column) -> Column:
    """A timestamp as UTC wall-clock time without zone, in any session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def rfc3339(c: Column | str) -> Column:
    """UTC time of an RFC 3339 text; null for anything else."""
    c = col(c)
    return F.when(c.rlike(RFC3339), utc(F.try_to_timestamp(F.regexp_replace(F.upper(c), " ", "T"))))


def flexible_time(c: Column | str) -> Column:
    """RFC 3339, ISO without zone (UTC), or an epoch in seconds or milliseconds, as text."""
    c = col(c)
    whole = F.when(c.rlike(r"^[+-]?\d{1,18}$"), c.cast("long"))
    epoch = F.when(whole > MILLIS_FROM, F.timestamp_millis(whole)).otherwise(F.timestamp_seconds(F.when(F.abs(whole) <= MILLIS_FROM, whole)))
    return F.coalesce(rfc3339(c), F.when(c.rlike(NAIVE_ISO), utc(F.try_to_timestamp(F.concat(c, F.lit("Z"))))), utc(epoch))


def rfc3339_text(c: Column | str) -> Column:
    """How a UTC time is written in exports: no trailing zeros in the fraction, +00:00."""
    c = col(c)
    micros = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1")
    return F.concat(F.regexp_replace(micros, r"\.$", ""), F.lit("+00:00"))


def severity_of_name(c: Column | str) -> Column:
    """0..4 of a name in any case; unknown or null is 0."""
    low = F.lower(trimmed(c))
    out = F.when(low == SEVERITIES[1].lower(), 1)
    for k, name in enumerate(SEVERITIES[2:], 2):
        out = out.when(low == name.lower(), k)
    return out.otherwise(0)


def severity_label(c: Column | str) -> Column:
    """The name of 0..4; anything else is Info."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.when(col(c).between(0, 4), col(c) + 1)), F.lit(SEVERITIES[0]))


def severity_of_priority(pri: Column) -> Column:
    level = pri.bitwiseAND(7)
    return F.when(level <= 2, 4).when(level == 3, 3).when(level == 4, 2).when(level <= 6, 1).otherwise(0)


def severity_of_words(c: Column) -> Column:
    has = lambda *words: F.greatest(*(F.contains(c, F.lit(w)) for w in words), F.lit(False))
    return F.when(has("error", "fail"), 3).when(has("warn", "delete", "remove"), 2).when(has("login", "auth"), 1).otherwise(0)


def lexemes(*cols: Column | str, split_punct: bool = False) -> Column:
    """Distinct lower-case tokens of several columns, split at white space (or at all but letters and digits)."""
    cut = r"(?U)[^\p{L}\p{N}]+" if split_punct else r"(?U)\s+"
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *cols)), cut), lambda t: t != ""))


def search_text(query: str, max_bytes: int) -> str:
    """A query trimmed and cut to ``max_bytes`` at a character boundary."""
    return query.strip().encode("utf-8")[:max_bytes].decode("utf-8", "ignore")


def search_text_of(c: Column | str, max_bytes: int) -> Column:
    """`search_text` as a column."""
    trimmed = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    raw = F.encode(trimmed, "UTF-8")
    # bytes as characters: what stands behind the cut tells whether it is in the middle of a character
    cut, behind = (F.decode(F.substring(raw, at, n), "ISO-8859-1") for at, n in ((1, max_bytes), (max_bytes + 1, 1)))
    whole = F.when(behind.rlike("[\x80-\xbf]"), F.regexp_replace(cut, "[\xc0-\xff][\x80-\xbf]*$", "")).otherwise(cut)
    return F.when(F.octet_length(trimmed) <= max_bytes, trimmed).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def comma_list(c: Column | str) -> Column:
    """The items of a comma list, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(col(c), ","), trimmed), lambda x: x != "")


def comma_items(text: str) -> list[str]:
    """`comma_list` of one text on the driver."""
    return [x.strip() for x in text.split(",") if x.strip()]


def globbed(c: Column | str, pattern: str) -> Column:
    """``*`` stands for any text, everything else for itself."""
    return col(c).like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))


def glob_matches(pattern: str, value: str) -> bool:
    """`globbed` for one value on the driver."""
    import re

    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), value, re.S) is not None


def csv_field(c: Column | str) -> Column:
    """Quoted only if it holds a comma, a quote or a line end."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def md_field(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("|"), F.lit("\\|"))


def _ipv4(t: Column) -> Column:
    """Four numbers, or null."""
    numbers = F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.transform(F.split(t, "\\."), lambda p: p.cast("int")))
    return F.when(F.forall(numbers, lambda p: p <= 255), numbers)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands once in the plan, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ipv6(t: Column) -> Column:
    def of_tail(tail: Column) -> Column:
        two = lambda k: F.lower(F.hex(tail[k] * 256 + tail[k + 1]))
        return F.when(tail.isNotNull(), F.concat(F.regexp_replace(t, r"\d+\.\d+\.\d+\.\d+$", ""), two(0), F.lit(":"), two(2))).otherwise(t)

    def of_sides(sides: Column) -> Column:
        given = F.aggregate(sides, F.lit(0), lambda n, s: n + F.size(s))
        gap = F.when(F.size(sides) == 1, 0).otherwise(F.when(given < 8, 8 - given))
        return F.concat(sides[0], F.array_repeat(F.lit("0"), gap), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>")))

    def of_groups(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":"))

    plain = let(let(F.nullif(F.regexp_extract(t, r":(\d+\.\d+\.\d+\.\d+)$", 1), F.lit("")), _ipv4), of_tail)
    sides = F.transform(F.split(plain, "::", -1), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1)))
    return let(let(sides, lambda x: F.when(F.size(x) <= 2, of_sides(x))), of_groups)


def canonical_ip(c: Column | str) -> Column:
    """IPv4 without leading zeros; IPv6 as eight groups of four lower-case digits; null if it is neither."""

    def of(t: Column) -> Column:
        v4 = let(_ipv4(t), lambda n: F.array_join(F.transform(n, lambda p: p.cast("string")), "."))
        return F.when(F.contains(t, F.lit(":")), _ipv6(t)).otherwise(v4)

    return let(F.lower(present(c)), of)


def json_merged(a: Column | str, b: Column | str) -> Column:
    """Shallow merge of two JSON objects, the second's values first; keys in order. Anything else counts as empty."""
    fields = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(col(c)), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    own, over = fields(a), fields(b)
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(over, k))
    entries = F.array_sort(F.transform(F.concat(F.map_entries(kept), F.map_entries(over)), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
