"""Cleaning of codes and joined values, as Column expressions. Null, blank and placeholder values say nothing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINER = " / "


def strip(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")


def said(value: Column) -> Column:
    """The stripped text, or null if it says nothing."""
    return F.nullif(strip(value), F.lit(""))


def code(value: Column) -> Column:
    """Codes as text: whole numbers lose their decimals."""
    text = value.cast("string")
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_extract(text, r"^(-?\d+)", 1)).otherwise(F.nullif(text, F.lit("")))


def parts_of(value: Column) -> Column:
    """The parts of a joined value, stripped, without blanks; none of null."""
    return F.coalesce(F.filter(F.transform(F.split(value.cast("string"), JOINER), strip), lambda p: p != ""), F.array().cast("array<string>"))


def combine(parts: Column) -> Column:
    """Distinct parts, sorted and joined; null of none."""
    flat = F.array_sort(F.array_distinct(parts))
    return F.when(F.size(flat) > 0, F.array_join(flat, JOINER))


def translate_joined(value: Column, labels: dict[str, str]) -> Column:
    """Every part's label (itself, if it has none), the first of equals kept, in the order seen."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.array_distinct(F.transform(parts_of(value), lambda p: F.coalesce(F.try_element_at(table, p), p)))
    return F.when(F.size(found) > 0, F.array_join(found, JOINER))


def label(value: Column, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code is its own."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code(value)), code(value))


def _accents() -> tuple[str, str]:
    """Letters that are a plain one with marks, and the plain ones: by canonical decomposition, over the Latin blocks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    kept = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def fold(value: Column) -> Column:
    """Lower case without accents, for searching; ø, æ and å by their usual spelling, marks that stand alone left out."""
    plain = F.regexp_replace(F.translate(F.lower(value), "øå", "oa"), "æ", "ae")
    return F.regexp_replace(F.translate(plain, *_accents()), "[\u0300-\u036f]", "")


def thousands(metres: Column) -> Column:
    """Whole metres, halves upwards, with thousands commas."""
    return F.format_number(F.floor(metres + 0.5), 0)


def zigzag(value: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    v = value.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_bytes(value: Column) -> Column:
    """Bytes of the value as a varint of seven-bit groups."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + (value >= F.lit(1 << (7 * k))).cast("int")
    return out


def identities(value: Column, placeholders: tuple[str, ...] = ()) -> Column:
    """The distinct parts of an identity, without placeholders that stand for none."""
    return F.array_except(F.array_distinct(parts_of(value)), F.array(*[F.lit(p) for p in placeholders]).cast("array<string>"))


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in an order of importance, from 0; anything else comes last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(place > 0, place - 1).otherwise(len(order)).cast("int")


def capture_date(value: Column) -> Column:
    """A point in time as its date in text; what can't be read is null."""
    return F.date_format(F.try_to_timestamp(value.cast("string")), "yyyy-MM-dd")


def described(parts: list[tuple[str, Column]]) -> Column:
    """"12.3 km marked · 0.4 km unmarked": metres of each class that has any, in the order given; null of none."""
    said = [F.when(F.coalesce(m, F.lit(0.0)) >= 50, F.concat(F.format_number(m / 1000, 1), F.lit(f" km {name}"))) for name, m in parts]
    return F.nullif(F.concat_ws(" · ", *said), F.lit(""))


def climb_text(ascent: Column, descent: Column, towards: Column) -> Column:
    """"+120 / −80 m towards X"; null where nothing was read."""
    return F.concat(F.lit("+"), thousands(ascent), F.lit(" / −"), thousands(descent), F.lit(" m"), F.coalesce(F.concat(F.lit(" towards "), towards), F.lit("")))


def escaped(value: Column) -> Column:
    """Text that may stand in XML or HTML, in attributes too."""
    out = value.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.regexp_replace(out, mark, name)
    return out


def popup(fields: dict[str, Column], links: dict[str, Column] | None = None) -> Column:
    """An HTML table of the fields that say something; a link only of http and https addresses."""
    rows = [F.when(said(v).isNotNull(), F.concat(F.lit(f"<tr><th>{name}</th><td>"), escaped(said(v)), F.lit("</td></tr>"))) for name, v in fields.items()]
    rows += [F.when(v.rlike("^https?://"), F.concat(F.lit('<tr><td colspan="2"><a href="'), escaped(v), F.lit(f'">{name}</a></td></tr>'))) for name, v in (links or {}).items()]
    return F.concat(F.lit("<table>"), F.concat_ws("", *rows), F.lit("</table>"))


def osm_tags(fields: dict[str, tuple[Column, dict[str, str] | None]], inferred: list[tuple[str, Column, str, str]], constants: dict[str, str]) -> Column:
    """A map of tags: each field's value (by its table, where it has one; a value without entry gives no tag), then tags
    inferred from a pattern where they are absent (key, text, pattern, value), then constants. Values that say nothing
    give no tag."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    own = [entry(k, said(v) if table is None else F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), said(v))) for k, (v, table) in fields.items()]
    have = F.map_from_entries(F.filter(F.array(*own), lambda e: e["value"].isNotNull()))
    guesses = F.array(*[entry(k, F.when(text.rlike(pattern), F.lit(v))) for k, text, pattern, v in inferred]) if inferred else F.array().cast("array<struct<key:string,value:string>>")
    new = F.filter(guesses, lambda e: e["value"].isNotNull() & ~F.map_contains_key(have, e["key"]))
    first = F.filter(new, lambda e, i: ~F.exists(F.slice(new, F.lit(1), i), lambda b: b["key"] == e["key"]))
    fixed = F.array(*[entry(k, F.lit(v)) for k, v in constants.items()])
    free = F.filter(F.concat(first, fixed), lambda e: ~F.map_contains_key(have, e["key"]))
    return F.map_concat(have, F.map_from_entries(free))
