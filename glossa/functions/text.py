"""Text normalisation and codecs as Column functions.

White space is what JavaScript's trim() and \\s take, which includes the no-break space
and the byte order mark; lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters, and the punctuation that meanings are compared without.
SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PUNCTUATION = ".,;:!?()[]{}\"'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value found once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def _folded(c: Column, dropped: str) -> Column:
    """In lower case, ё as е, without the dropped characters, white space runs as one space, trimmed; null is empty. One pass but for the runs."""
    one = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё" + SPACE + dropped, "е" + " " * len(SPACE))
    return F.trim(F.regexp_replace(one, " {2,}", " "))


def normalize_graphic(c: Column) -> Column:
    """Trimmed, in lower case; null stays null."""
    return F.lower(js_trim(c))


def normalize_text(c: Column) -> Column:
    """Trimmed, in lower case, ё as е, white space runs as one space; null is empty."""
    return _folded(c, "")


def normalize_semantic(c: Column) -> Column:
    """In lower case, ё as е, without . , ; : ! ? ( ) [ ] { } " ', white space runs as one space, trimmed; null is empty."""
    return _folded(c, PUNCTUATION)


def semantic_tokens(c: Column) -> Column:
    """The words of the semantically normalised text."""
    return F.filter(F.split(normalize_semantic(c), " "), lambda x: x != "")


def has_value(c: Column) -> Column:
    return F.length(normalize_text(c)) > 0


def fixed3(x: Column) -> Column:
    """Three decimals as text, ties of the exact binary value away from zero; no grouping."""
    def text(x: Column) -> Column:
        thousandths = x * 1000
        tie = ((thousandths - F.floor(thousandths)) == 0.5) & (x * 8192 == F.floor(x * 8192))
        return F.regexp_replace(F.format_number(F.when(tie, (F.floor(thousandths) + 1) / 1000).otherwise(x), 3), ",", "")

    return let(x, text)


def escape_html(c: Column) -> Column:
    """& < > " ' as character references."""
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(reference))
    return c


def base64url(c: Column) -> Column:
    """URL-safe base64 of the UTF-8 text, without padding or line breaks."""
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    """Inverse of base64url(); null where the text isn't base64."""
    return F.decode(F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64")), "UTF-8")
