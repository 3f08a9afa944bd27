"""Label and number normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def unaccent(x: Column) -> Column:
    return F.translate(F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), ACCENTED, PLAIN)


def fold(x: Column) -> Column:
    """Plain lower-case letters a to z only."""
    return F.regexp_replace(F.lower(unaccent(x)), "[^a-z]", "")


def latin_title(x: Column) -> Column:
    """Anything that is not Latin becomes a blank; blanks collapse; lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Za-zÀ-ÿ0-9]+", " "), " +", " ")))


def stem(x: Column) -> Column:
    """A title without its trailing numbers, folded to plain lower case."""
    return F.trim(F.lower(unaccent(F.regexp_replace(x, r"\s+[\d.]+$", ""))))


def latin_tokens(x: Column) -> Column:
    """Tokens that hold a Latin letter or digit; the rendering in another script is dropped."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(x, "[؀-ۿ]+", " ")), r"\s+"), lambda t: t.rlike("[A-Za-zÀ-ÿ0-9]"))
    return F.array_join(kept, " ")


def is_arabic(x: Column) -> Column:
    return x.rlike("[؀-ۿ]")


def undouble(x: Column) -> Column:
    """A token whose every glyph is printed twice, told by its doubled point."""
    return F.when(x.contains("..") & x.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(x, r"(.)\1", "$1")).otherwise(x)


def number(x: Column) -> Column:
    """Number of a printed token: doubled glyphs, blank thousands and a decimal comma are understood; else null."""
    return F.replace(F.replace(undouble(x), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def rejoin_decimal(x: Column) -> Column:
    """"4 526 .2" as "4 526.2": one or two blanks before a decimal point are closed."""
    return F.regexp_replace(x, r"(?<=\d)\s{1,2}\.(?=\d)", ".")


def age_band(x: Column) -> Column:
    """"24-20" as "20-24"; an open band as "80+"; else null."""
    hi, lo = F.regexp_extract(x, r"^(\d{1,2})-(\d{1,2})$", 1), F.regexp_extract(x, r"^(\d{1,2})-(\d{1,2})$", 2)
    return F.when(hi != "", F.concat_ws("-", F.least(hi, lo), F.greatest(hi, lo))).when(x.rlike(r"^80\s*(\+|et plus)"), F.lit("80+"))


def head_and_last(x: Column) -> tuple[Column, Column]:
    """Split on the last " / "; a label without it yields itself twice."""
    last = F.substring_index(x, " / ", -1)
    return F.when(x.contains(" / "), F.substring(x, F.lit(1), F.char_length(x) - F.char_length(last) - 3)).otherwise(x), last
