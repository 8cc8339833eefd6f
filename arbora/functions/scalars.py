"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that count as "no annotation" in purity evaluation.
UNKNOWN_LABELS = ("unknown", "unkown", "unassigned")
# Strings that the annotation table reader treats as missing.
MISSING_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                   "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def general_number(value: Column) -> Column:
    """Short text of a number with six significant digits (the %g style)."""
    size = F.abs(value)
    power = F.when(size == 0, 0).otherwise(F.floor(F.log10(F.greatest(size, F.lit(1e-300)))))
    digits = F.greatest(F.lit(0), F.least(F.lit(18), 5 - power)).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    plain = F.regexp_replace(F.format_string("%.12f", F.round(value * scale) / scale), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.format_string("%.5f", value / F.pow(F.lit(10.0), power)), r"\.?0+$", "")
    sign = F.when(power < 0, "-").otherwise("+")
    exponent = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    text = F.when((size != 0) & ((power < -4) | (power >= 6)), exponent).otherwise(plain)
    return F.when(text == "-0", "0").otherwise(text)


def interval_label(left: Column, right: Column) -> Column:
    return F.concat(F.lit("["), general_number(left), F.lit(","), general_number(right), F.lit(")"))


def stage_bin(stage: Column, width: float, origin: float = 0.0) -> Column:
    """Left-closed, right-open bin number."""
    return F.floor((stage - F.lit(float(origin))) / F.lit(float(width)))


def file_stem(text: Column) -> Column:
    """Lower-case name safe for files."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def weight_label(weight: Column) -> Column:
    """Number as part of a file name: '.' becomes 'p' and '-' becomes 'm'."""
    return F.replace(F.replace(general_number(weight), F.lit("."), F.lit("p")), F.lit("-"), F.lit("m"))


def is_unknown(label: Column, unknown=UNKNOWN_LABELS) -> Column:
    names = sorted({u.strip().lower() for u in unknown} | {""})
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(names)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def display_label(label: Column, purity: Column, threshold: float) -> Column:
    """Label for drawing: groups below the purity threshold are shown as mixed."""
    return F.when(purity < threshold, "Mixed").otherwise(label)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
