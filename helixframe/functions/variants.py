"""Variant text: alleles, genotypes, numbers, escapes and whole VCF lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref_text(kind: Column, ref: Column, change: Column) -> Column:
    """REF by kind: reference and snv the base, insertion the anchor, deletion the anchor and the deleted bases, complex as given."""
    return F.when(kind == "deletion", F.concat(ref, change)).otherwise(ref)


def alt_text(kind: Column, ref: Column, change: Column, alts: Column) -> Column:
    """ALT by kind; alts (array) for snv and complex, change for the inserted bases."""
    return (
        F.when(kind == "reference", ".").when(kind == "insertion", F.concat(ref, change)).when(kind == "deletion", ref)
        .otherwise(F.array_join(alts, ","))
    )


def allele_is_valid(kind: Column, ref: Column, change: Column, alts: Column) -> Column:
    snv = (F.size(alts) > 0) & ~F.array_contains(alts, ref) & (F.size(F.array_distinct(alts)) == F.size(alts))
    return F.coalesce(F.when(kind == "snv", snv).when(kind.isin("insertion", "deletion"), F.length(change) > 0).otherwise(F.lit(True)), F.lit(False))


def record_length(kind: Column, ref: Column, change: Column) -> Column:
    return F.when(kind == "deletion", 1 + F.length(change)).when(kind == "complex", F.length(ref)).otherwise(1)


def allele_count(kind: Column, alts: Column) -> Column:
    return F.when(kind == "reference", 1).when(kind.isin("insertion", "deletion"), 2).otherwise(1 + F.size(alts))


def genotype_text(alleles: Column, phased: Column) -> Column:
    """Allele numbers joined by / or |; a null allele is a dot."""
    parts = F.transform(alleles, lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    return F.when(phased, F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _product_less(a: Column, b: Column, c: Column) -> Column:
    """a * b - c with the sign that the exact value has, for a product near c: the product's rounding error is added back."""

    def halves(x):
        big = x * 134217729.0
        high = big - (big - x)
        return high, x - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    return (p - c) + (((ah * bh - p) + ah * bl + al * bh) + al * bl)


def _exact_digits(v: Column) -> Column:
    """The six digits and the power of v (size, number, power), whose number is the shortest decimal's, rounded half up: one too many where the value is below the middle, or in it and the digit odd."""
    carried = v["number"] == 100_000
    scale, middle = 5 - v["power"] + carried.cast("int"), F.when(carried, 999_999.5).otherwise(v["number"] - 0.5)
    over = F.when(scale.between(0, 22), _product_less(v["size"], F.pow(F.lit(10.0), scale), middle))

    def rounded(over):
        less = F.coalesce((over < 0) | ((over == 0) & ~carried & (v["number"] % 2 == 1)), F.lit(False))
        digits = F.when(less & carried, 999_999).when(less, v["number"] - 1).otherwise(v["number"])
        return F.struct(digits.cast("string").alias("digits"), (v["power"] - (less & carried).cast("int")).alias("power"))

    return _let(over, rounded)


def float_text(x: Column) -> Column:
    """Six significant digits in fixed notation without trailing zeros; never an exponent.

    Rounded by the exact value, ties to the even digit (below 1e-17 by the shortest decimal, ties up).
    """
    size = F.abs(x)
    # The six digits and the exponent of the scientific notation, the digits then shifted to their place.
    parts = lambda s: F.struct(
        size.alias("size"), F.replace(F.substring_index(s, "e", 1), F.lit("."), F.lit("")).try_cast("int").alias("number"), F.substring_index(s, "e", -1).try_cast("int").alias("power"))

    def placed(v):
        digits, power = v["digits"], v["power"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        middle = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
        return F.when(power < 0, small).when(power < 5, middle).otherwise(F.format_string("%.0f", F.rint(size)))

    def signed(text):
        text = F.concat(F.when(x < 0, "-").otherwise(""), text)
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)

    text = _let(_let(_let(_let(F.format_string("%.5e", size), parts), _exact_digits), placed), signed)
    return F.when(x.isNull(), ".").when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").otherwise(text)


def percent_encode(text: Column) -> Column:
    """% first, then : ; = , tab, line feed and carriage return."""
    for plain, code in (("%", "%25"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def info_text(*fields: tuple[str, Column | None]) -> Column:
    """key=value of the fields in order, a bare key for flags (value: boolean Column), nothing for null; ``.`` if none is left."""
    parts = []
    for key, value, *kind in fields:
        if kind and kind[0] == "flag":
            parts.append(F.when(value, F.lit(key)))
        else:
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value.cast("string"))))
    text = F.concat_ws(";", *parts)
    return F.when(text == "", ".").otherwise(text)


def list_text(values: Column) -> Column:
    """Elements joined by commas, null ones as dots."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("."))), ",")


def vcf_line(contig: Column, pos1: Column, ref: Column, alt: Column, qual: Column, filters: Column, info: Column, keys: str | None = None, samples: list[Column] = ()) -> Column:
    """CHROM POS . REF ALT QUAL FILTER INFO [FORMAT samples]."""
    fields = [contig, pos1.cast("string"), F.lit("."), ref, alt, float_text(qual), F.coalesce(F.array_join(filters, ";"), F.lit(".")), info]
    if keys:
        fields += [F.lit(keys), *samples]
    return F.concat_ws("\t", *fields)


def header_text(contigs: list[tuple[str, int]], filters: list[tuple[str, str]] = (), infos: list[tuple[str, str, str, str]] = (), formats: list[tuple[str, str, str, str]] = (), samples: list[str] = (), others: list[str] = (), version: str = "VCFv4.3") -> list[str]:
    """Header lines in order: file format, PASS, other lines, filters, INFO, FORMAT, contigs, #CHROM."""
    field = lambda kind, x: f'##{kind}=<ID={x[0]},Number={x[1]},Type={x[2]},Description="{x[3]}">'
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [
        f"##fileformat={version}", '##FILTER=<ID=PASS,Description="All filters passed">', *(f"##{x}" for x in others),
        *(f'##FILTER=<ID={i},Description="{d}">' for i, d in filters), *(field("INFO", x) for x in infos), *(field("FORMAT", x) for x in formats),
        *(f"##contig=<ID={n},length={size}>" for n, size in contigs), "\t".join(columns),
    ]
