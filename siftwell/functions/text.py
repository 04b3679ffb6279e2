"""Text and time columns: trimming, excerpts, HTML to text, ISO and epoch times."""

from __future__ import annotations

import html
import html.entities
import json
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ERROR_CHARS, EVIDENCE_CONTEXT, FLAGS, QUOTE_CHARS


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def filled(c: Column) -> Column:
    """The string, null where it is empty."""
    return F.nullif(c, F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first non-empty string, else the empty one."""
    return F.coalesce(*(filled(c) for c in columns), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at either end (``trim`` takes the plain space only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cap(c: Column, most: int = QUOTE_CHARS) -> Column:
    """Collapsed, and cut with an ellipsis beyond ``most`` characters."""
    flat = collapse(or_empty(c))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The value as a column that the optimizer does not copy into the filters and generators above it.

    It takes a condition on a random number, which always holds, for a reason to evaluate the expression in one place. A sum is compared, as the
    optimizer knows the bounds of a random number alone and would drop the condition.
    """
    return F.when(F.rand(0) + 1 >= 1, value)


def has(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Whether the pattern occurs; false for null."""
    return F.coalesce(text.rlike(flags + pattern), F.lit(False))


def any_of(text: Column, parts) -> Column:
    """Whether the text contains one of the strings."""
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts), F.lit(False))


def classify(text: Column, rules, otherwise: str) -> Column:
    """The label of the first pattern that occurs: ``rules`` is an ordered list of (pattern, label)."""
    return reduce(lambda rest, rule: F.when(has(text, rule[0]), F.lit(rule[1])).otherwise(rest), reversed(list(rules)), F.lit(otherwise))


def matches(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """All matches in order as ``array<struct<start:int,text:string>>``; start counts from 1.

    Built from the pieces between matches and the matches themselves, folded with a running position. The pieces come from
    replacing matches by a mark (of the same length elsewhere in the text: another one) and splitting at it; splitting by
    the pattern itself would compile it anew for every row.
    """
    p = flags + pattern
    marked = F.regexp_replace(F.translate(text, "\uffff", "\ufffe"), p, "\uffff")
    pieces = F.zip_with(F.split(marked, "\uffff", -1), F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda a, b: F.struct(a.alias("gap"), b.alias("hit")))
    none = F.array().cast("array<struct<start:int,text:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        hit = F.array(F.struct(start.cast("int").alias("start"), x["hit"].alias("text")))
        found = F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], hit))
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int").alias("at"), found.alias("found"))

    return F.aggregate(pieces, F.struct(F.lit(1).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def first_start(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Where (from 1, in code points) the first match of a pattern that occurs begins: behind the shortest text before it."""
    return F.length(F.regexp_extract(text, flags + r"\A(?s:(.*?))(?:" + pattern + ")", 1)) + 1


def around(text: Column, start: Column, size: Column, context: int) -> Column:
    """The substring at ``start`` (from 1) of ``size`` characters and ``context`` more on either side."""
    low = F.greatest(start - context, F.lit(1))
    return F.substring(text, low, start - low + size + context)


def evidence(text: Column, pattern: str, context: int = EVIDENCE_CONTEXT) -> Column:
    """The first match with its surroundings, collapsed; empty without a match. A text without a match is scanned once."""
    p = FLAGS + pattern

    def shown(hit: Column) -> Column:
        quote = let(first_start(text, pattern), lambda start: collapse(around(text, start, F.length(hit), context)))
        return F.when(hit != "", quote).otherwise("")

    return or_empty(let(F.regexp_extract(text, p, 0), shown))


def iso_time(c: Column) -> Column:
    """ISO-8601 with Z, offset or none (read as UTC), or a bare date; null where it isn't one."""
    t = strip(c)
    shaped = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 as a timestamp, fractions kept; null outside of what a timestamp holds."""
    value = c.cast("double")
    return F.when(value.between(-62_135_596_800_000, 253_402_300_799_999), F.timestamp_micros(F.round(value * 1000).cast("long")))


def stamp(c: Column) -> Column:
    """The name of a generation: ``YYYYMMDDTHHMMSS.ffffffZ``."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss.SSSSSS'Z'")


def sort_stamp(c: Column) -> Column:
    """A timestamp as text that sorts like it, undated first."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit("0000-00-00T00:00:00.000000Z"))


def from_stamp(c: Column) -> Column:
    """A sort stamp as timestamp; null for the undated one and for what isn't a stamp."""
    return F.when(~c.startswith("0000-"), iso_time(c))


def cut_at_word(c: Column, most: int) -> Column:
    """``struct(text, cut)``: cut at the last space if that leaves over 60 % of ``most``, with an ellipsis."""
    head = F.substring(c, 1, most)
    space = most - F.instr(F.reverse(head), " ")  # characters before the last space
    worded = F.when(head.contains(" ") & (space > most * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    long = F.length(c) > most
    return F.struct(F.when(long, F.concat(F.regexp_replace(worded, r"(?U)\s+$", ""), F.lit("…"))).otherwise(c).alias("text"), long.alias("cut"))


def display_name(sender: Column) -> Column:
    return F.coalesce(filled(strip(F.substring_index(sender, "<", 1))), sender)


def error_label(kind: Column, message: Column) -> Column:
    """``Type: message``, bounded, never empty."""
    return F.substring(F.concat_ws(": ", F.coalesce(filled(kind), F.lit("Error")), filled(strip(or_empty(message)))), 1, ERROR_CHARS)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_CLOSED = _ENTITY.replace(";?", ";")
_BUCKETS = 4096


def _named(name: Column) -> Column:
    """The characters of an entity's name (with its semicolon, or without where that is allowed), null for others: a constant table by hash."""
    by_hash: list[list[dict[str, str]]] = [[] for _ in range(_BUCKETS)]
    for known, characters in sorted(html.entities.html5.items()):
        by_hash[zlib.crc32(known.encode()) % _BUCKETS].append({"n": known, "c": characters})
    table = F.from_json(F.lit(json.dumps(by_hash)), "array<array<struct<n:string,c:string>>>")
    return F.get(F.filter(F.get(table, (F.crc32(name) % _BUCKETS).cast("int")), lambda x: x["n"] == name), F.lit(0))["c"]


def _numbered(reference: Column) -> Column:
    """The character of ``#123`` or ``#x7B``: numbers that mean another character give that, those that are no character give nothing or the replacement character."""
    # the few references with a meaning of their own, as the standard library has them
    special = {n: html.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))}
    codes = F.from_json(F.lit(json.dumps([special.get(n) for n in range(0xA0)])), "array<string>")
    digits = F.regexp_replace(F.regexp_extract(reference, r"([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    read = F.when(F.lower(F.substring(reference, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    number = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).otherwise(read.cast("long"))

    def character(n: Column) -> Column:
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(
            F.when(n < 0xA0, F.get(codes, n.cast("int"))), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd"), F.when(none, ""), own
        )

    return let(number, character)


def _decoded(entity: Column, open_ended: bool = True) -> Column:
    """What an entity (from its ``&``) stands for; a name that is none gives its longest beginning that is one (if ``open_ended``), or stays."""
    name = F.substring(entity, 2, 1 << 30)
    if not open_ended:
        return F.when(name.startswith("#"), _numbered(name)).otherwise(F.coalesce(_named(name), entity))
    sizes = F.when(F.length(name) > 2, F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1)))
    begun = F.filter(F.transform(sizes, lambda n: F.concat(_named(F.substring(name, F.lit(1), n)), F.substring(name, n + 1, F.lit(1 << 30)))), lambda x: x.isNotNull())
    return F.when(name.startswith("#"), _numbered(name)).otherwise(F.coalesce(_named(name), F.get(begun, F.lit(0)), entity))


def unescape(text: Column, open_ended: bool = True) -> Column:
    """HTML entities as characters, as the standard library's ``html.unescape`` has them. Texts without ``&`` are passed as they are.

    Without ``open_ended`` only entities that end in a semicolon count: the ``&amp`` of a text cut within ``&amp;`` stays.
    """
    entity = _ENTITY if open_ended else _CLOSED
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(f"({entity})"), F.lit(1)), lambda e: _decoded(e, open_ended)), F.array(F.lit("")))
    parts = F.zip_with(F.split(text, entity, -1), found, lambda a, b: F.concat(a, b))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def html_to_text(c: Column, open_ended: bool = True) -> Column:
    """Readable text of HTML that may be escaped up to three times. Never truncates; null gives the empty text. ``open_ended`` as in :func:`unescape`."""
    plain = lambda text: unescape(text, open_ended)
    t = let(let(let(or_empty(c), plain), plain), plain)
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|hr)\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|ul|ol|h[1-6]|tr|table|section)\s*>", "\n")
    t = let(F.regexp_replace(t, r"<[^>]+>", " "), plain)
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
