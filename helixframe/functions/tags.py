"""Auxiliary tags: map<string, struct<type, i, f, s, a>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AUX, AUX_VALUE


def sam_tags(fields: Column) -> Column:
    """The map of SAM fields TAG:TYPE:VALUE.  Fields under five characters or with misplaced colons are skipped; the first of equal tags counts.

    A letter that is no type is kept as text (Z); a number that does not parse is null.
    """
    sound = F.filter(fields, lambda f: (F.length(f) >= 5) & (F.substring(f, 3, 1) == ":") & (F.substring(f, 5, 1) == ":"))
    first = F.filter(sound, lambda f, i: F.coalesce(F.array_position(F.transform(sound, lambda g: F.substring(g, 1, 2)), F.substring(f, 1, 2)) == i + 1, F.lit(False)))

    def value(f):
        kind = F.substring(f, 4, 1)
        text = F.regexp_extract(f, r"(?s)^.{5}(.*)$", 1)
        parts = F.split(text, ",")
        numbers = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
        known = kind.isin("A", "i", "f", "Z", "H", "B", "d")
        return F.struct(
            F.when(known, kind).otherwise("Z").alias("type"),
            F.when(kind == "i", text.try_cast("long")).alias("i"),
            F.when(kind.isin("f", "d"), text.try_cast("double")).alias("f"),
            F.when(kind.isin("A", "Z", "H") | ~known, text).when(kind == "B", F.substring(text, 1, 1)).alias("s"),
            F.when(kind == "B", numbers).alias("a"),
        )

    return F.map_from_entries(F.transform(first, lambda f: F.struct(F.substring(f, 1, 2).alias("key"), value(f).alias("value")))).cast(AUX)


def sam_field(key: Column, v: Column) -> Column:
    """TAG:TYPE:VALUE of one entry."""
    number = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    text = F.when(v["type"] == "i", v["i"].cast("string")).when(v["type"].isin("f", "d"), number(v["f"])).when(
        v["type"] == "B", F.concat(v["s"], F.lit(","), F.array_join(F.transform(v["a"], number), ","))).otherwise(v["s"])
    return F.concat(key, F.lit(":"), v["type"], F.lit(":"), text)


def tag(aux: Column, key: str) -> Column:
    return F.try_element_at(aux, F.lit(key))


def tag_int(aux: Column, key: str, low: int = -(2**63), high: int = 2**63 - 1) -> Column:
    """The integer; null if missing, of another type or out of range."""
    v = tag(aux, key)["i"]
    return F.when(v.between(low, high), v)


def tag_int_state(aux: Column, key: str, low: int, high: int) -> Column:
    """ok, missing, mismatch or out_of_range."""
    v = tag(aux, key)
    return F.when(v.isNull(), "missing").when(v["i"].isNull(), "mismatch").when(v["i"].between(low, high), "ok").otherwise("out_of_range")


def tag_float(aux: Column, key: str) -> Column:
    return tag(aux, key)["f"]


def tag_text(aux: Column, key: str) -> Column:
    return tag(aux, key)["s"]


def hex_bytes(text: Column) -> Column:
    """The bytes of hexadecimal digits; null for an odd number of digits or other letters."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def tag_hex(aux: Column, key: str) -> Column:
    """Bytes of an H tag; null for an odd number of digits or other letters."""
    v = tag(aux, key)
    return F.when(v["type"] == "H", hex_bytes(v["s"]))


def tag_value(kind: str, i: Column | None = None, f: Column | None = None, s: Column | None = None, a: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), *(F.coalesce(v, null).cast(t).alias(n) if v is not None else null.cast(t).alias(n) for v, t, n in ((i, "long", "i"), (f, "double", "f"), (s, "string", "s"), (a, "array<double>", "a"))))


def set_tag(aux: Column, key: str, value: Column) -> Column:
    """aux with key set; an old value is replaced."""
    kept = F.map_filter(F.coalesce(aux, F.create_map().cast(AUX)), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value.cast(AUX_VALUE)))


def remove_tag(aux: Column, key: str) -> Column:
    return F.map_filter(aux, lambda k, _: k != key)


def integer_type(value: Column) -> Column:
    """Narrowest binary type of an integer, unsigned ones first; null outside 32 bits."""
    return (
        F.when(value.between(0, 255), "C").when(value.between(0, 65535), "S").when(value.between(0, 2**32 - 1), "I")
        .when(value.between(-128, -1), "c").when(value.between(-32768, -1), "s").when(value.between(-(2**31), -1), "i")
    )
