"""Text and naming functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_CHARS = 40


def strip_text(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_name(text: Column, most: int = NAME_CHARS) -> Column:
    """File-name stem: runs of other characters become one underscore, none of ._- at the ends, "img" if nothing is left."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
    ends = F.regexp_replace(plain, "^[._-]+|[._-]+$", "")
    return F.substring(F.when(ends == "", F.lit("img")).otherwise(ends), 1, most)


def safe_filename(text: Column) -> Column:
    """Every character but letters and digits of any script and -_. becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def is_prefix_label(label: Column) -> Column:
    return label.endswith("_PREFIX")


def base_label(label: Column) -> Column:
    return F.regexp_replace(label, "_PREFIX$", "")


def record_id(split: Column, class_name: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%06d", split, class_name, index)


def document_id(number: Column) -> Column:
    return F.format_string("doc_%06d", number)


# Characters that LaTeX reserves and what is written for them.
LATEX = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))


def latex_escape(text: Column) -> Column:
    """One sign after the other in this order: braces come before the escapes that bring in braces."""
    for sign, written in LATEX:
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def percent(probability: Column) -> Column:
    return (probability * 100).cast("int")


# The colour in which each label is drawn.
LABEL_COLOURS = {
    "SHOP_NAME": "#1f77b4", "ADDR": "#17becf", "PHONE": "#2ca02c",
    "BILLID": "#9467bd", "DATETIME": "#8c564b", "CASHIER": "#e377c2",
    "TITLE": "#7f7f7f", "PRODUCT_NAME": "#ff7f0e", "AMOUNT": "#bcbd22",
    "UNIT": "#7f7f7f", "UPRICE": "#d62728", "FPRICE": "#ff9896",
    "TPRICE": "#c49c94", "SUB_TPRICE": "#e377c2", "TAMOUNT": "#d62728",
    "TDISCOUNT": "#9467bd", "UDISCOUNT": "#8c564b", "RECEMONEY": "#2ca02c",
    "REMAMONEY": "#ff7f0e",
}
DEFAULT_COLOUR = "#333333"


def label_colour(label: Column) -> Column:
    """Colour of a label or of its prefix form; other labels have the default."""
    colours = F.create_map(*(F.lit(x) for pair in LABEL_COLOURS.items() for x in pair))
    return F.coalesce(F.element_at(colours, base_label(label)), F.lit(DEFAULT_COLOUR))


def colour_parts(hex_colour: Column) -> Column:
    """Red, green and blue of #rrggbb."""
    part = lambda i: F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))
