"""What a font's name and flags say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hints by which faces are known.
BOLD = "bold|black|heavy|cmbx|sfbx|cmssbx|cmbsy|cmmib|txb|pxb"
ITALIC = "italic|oblique|ital$|-ital|-it$|-bi$"
MATHS = "CMMI|CMSY|CMEX|CMR|MSAM|MSBM|EUFM|RSFS|MATH|SYMBOL|STIX|XITS"
SMALL_CAPS = "smallcaps|small-caps|-sc$|caps$"
#: Codes of symbol fonts and the marks that they show.
MARKS = {"ü": "✓", "û": "✗", "¨": "☐", "þ": "☑", "ý": "☒", "à": "→", "Ø": "➢", "§": "▪", "n": "■", "l": "●", "·": "•"}


def bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) > 0) | F.lower(font).rlike(BOLD)


def italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) > 0) | F.lower(font).rlike(ITALIC)


def superscript(flags: Column) -> Column:
    return flags.bitwiseAND(1) > 0


def maths(font: Column) -> Column:
    return F.upper(font).rlike(MATHS)


def small_caps(font: Column, text: Column) -> Column:
    """Lower case of a small-caps face as the capitals it shows."""
    return F.when(F.lower(font).rlike(SMALL_CAPS), F.upper(text)).otherwise(text)


def family(font: Column) -> Column:
    """The face without its subset's prefix and its style."""
    name = F.regexp_replace(F.regexp_replace(font, r"^[^+]*\+", ""), ",.*$", "")
    return F.lower(F.regexp_replace(name, r"(?i)[-,_ ]?(?:bold|italic|oblique|regular|roman|medium|light|black|heavy|semibold|demibold|bd|it|mt|psmt)+$", ""))


def symbol_mark(font: Column, text: Column) -> Column:
    """The mark that a symbol font's code shows; other text as it is."""
    known = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    return F.when(F.lower(font).rlike("wingding|webding|dingbat|marlett|monotypesorts"), F.coalesce(F.try_element_at(known, text), text)).otherwise(text)


def central_european(font: Column, text: Column) -> Column:
    """Letters of a face that was set in the Central European order but is mapped in the Roman one."""
    return F.when(F.upper(font).rlike("CE$|CE-|CE,"), F.translate(text, "ÃÈÏÒØÝãèïòøý", "ĂČĎŇŘÝăčďňřý")).otherwise(text)


def epsilon_by_width(font: Column, ratio: Column) -> Column:
    """The wider of a maths face's epsilons is the curled one."""
    return F.when(maths(font) & (ratio < 0.45), "\\epsilon").otherwise("\\varepsilon")


def math_alphanumeric(code: Column) -> Column:
    """The plain letter of a code point in the mathematical alphanumeric block; null elsewhere."""
    at = code - 0x1D400
    letter = F.pmod(at, F.lit(52))
    plain = F.when(letter < 26, letter + 65).otherwise(letter + 71)
    digit = F.pmod(code - 0x1D7CE, F.lit(10)) + 48
    return F.when((code >= 0x1D400) & (code <= 0x1D6A3), F.char(plain)).when((code >= 0x1D7CE) & (code <= 0x1D7FF), F.char(digit))
