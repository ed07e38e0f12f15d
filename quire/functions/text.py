"""Column functions over text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the data format: markers, glyphs, label words and font hints.
MARKER = r"^(?U:\s)*([-•◦▪*–—]|[0-9]+[.):]|[A-Za-z][.):]|[ivxlcdmIVXLCDM]+\.)(?U:\s)+"
MISREAD_BULLET = r"^(?U:\s)*[«»‹›·°] +(?=[A-Z0-9])"
SYMBOL_BULLET = r"^(?U:\s)*[-•◦▪*–—](?U:\s)+"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
LABEL_WORDS = [("initials", "initials?"), ("date", "date"), ("signature", "sign(?:ature|ed)?")]
STANDARD_FAMILIES = ["Helvetica", "Times", "Courier"]
FONT_HINTS = [("Times", "times|serif|georgia|roman|minion|garamond"), ("Courier", "courier|mono|consol")]
CONVERTIBLE = ["docx", "xlsx", "xls", "csv", "png", "jpg", "jpeg"]


def js_trim(c: Column) -> Column:
    """Trims all Unicode white space and byte-order marks."""
    return F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def clean(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(js_trim(c), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_list_marker(c: Column) -> Column:
    return c.rlike(MARKER)


def is_misread_bullet(c: Column) -> Column:
    return c.rlike(MISREAD_BULLET)


def canonical_bullet(c: Column) -> Column:
    return F.regexp_replace(c, MISREAD_BULLET, "• ")


def strip_bullet(c: Column) -> Column:
    """Drops a leading bullet symbol; numbers stay."""
    return F.regexp_replace(F.regexp_replace(c, SYMBOL_BULLET, ""), r"(?U)^\s+", "")


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves e and U+0301 apart, so Python's tables are asked
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition; ASCII text never leaves the engine."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(c)).otherwise(c)


def normalize_ligatures(c: Column, compose: bool = True) -> Column:
    out = nfc(c) if compose else c
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def sanitize(c: Column) -> Column:
    """Tabs to four spaces, other control characters dropped."""
    return F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"[\x00-\x1F\x7F]", "")


def _whole_word(pattern: str) -> str:
    """The pattern between ASCII word boundaries, whatever the letters around it."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def label_kind(c: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The first kind whose words the label holds, or null."""
    out, text = F.lit(None).cast("string"), js_trim(c)
    for kind, pattern in reversed(patterns or LABEL_WORDS):
        out = F.when(text.rlike(_whole_word(pattern)), F.lit(kind)).otherwise(out)
    return out


def infer_font(name: Column) -> Column:
    """struct(family, bold, italic) guessed from a font's name."""
    low, family = F.lower(name), F.lit("Helvetica")
    for guess, pattern in reversed(FONT_HINTS):
        family = F.when(low.rlike(pattern), F.lit(guess)).otherwise(family)
    return F.struct(family.alias("family"), low.rlike("bold|black|heavy|semibold").alias("bold"), low.rlike("italic|oblique").alias("italic"))


def is_standard_font(family: Column) -> Column:
    return family.isin(STANDARD_FAMILIES)


def standard_font_key(family: Column, bold: Column, italic: Column) -> Column:
    variant = F.when(bold & italic, "bi").when(bold, "b").when(italic, "i").otherwise("r")
    return F.concat(family, F.lit("-"), variant)


def is_truncated(decoded: Column) -> Column:
    """True unless the decoded text ends, but for white space, in the end mark."""
    return ~decoded.rlike(r"</s>(?U:\s)*$")


def hex_to_rgb(c: Column) -> Column:
    """struct(r, g, b) of 0..255 from a 3- or 6-digit colour."""
    h = F.replace(c, F.lit("#"), F.lit(""))
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).when(h == "", F.lit("000000")).otherwise(h)
    n = F.conv(full, 16, 10).cast("int")
    return F.struct(*(F.shiftright(n, s).bitwiseAND(255).alias(k) for k, s in (("r", 16), ("g", 8), ("b", 0))))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(v.cast("int")), 2, "0")) for v in (r, g, b)))


def data_url_bytes(c: Column) -> Column:
    return F.unbase64(F.split_part(c, F.lit(","), F.lit(2)))


def format_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 20 MB."""
    v, unit = n / 1024.0, F.lit("KB")
    big = F.when(n >= 1024.0**3, n / 1024.0**3).when(n >= 1024.0**2, n / 1024.0**2).otherwise(v)
    unit = F.when(n >= 1024.0**3, "GB").when(n >= 1024.0**2, "MB").otherwise("KB")
    shown = F.when(big < 10, F.format_string("%.1f", big)).otherwise(F.format_string("%.0f", big))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), unit))


def safe_date(c: Column) -> Column:
    return F.try_to_timestamp(c)


def ext_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def base_name(name: Column, suffix: str = "") -> Column:
    """A file's name without its last ending."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(suffix))


def export_name(name: Column, suffix: str = ".edited.pdf") -> Column:
    """The name of an exported file: only a .pdf ending goes."""
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(suffix))


def url_filename(url: Column) -> Column:
    """Last path segment without query or fragment, with a .pdf ending."""
    last = F.element_at(F.split(F.element_at(F.split(url, "[?#]"), 1), "/"), -1)
    name = F.when(last == "", F.lit("document.pdf")).otherwise(last)
    return F.when(name.rlike(r"(?i)\.pdf$"), name).otherwise(F.concat(name, F.lit(".pdf")))


def accept_pdf(url: Column, mime: Column) -> Column:
    return (mime == "application/pdf") | url.rlike(r"(?i)\.pdf(\?|#|$)") | (mime == "")


def join_wrapped(left: Column, right: Column) -> Column:
    """Two lines of a paragraph as one: a hyphen before a small letter goes."""
    soft = left.rlike("[A-Za-z]-$") & right.rlike("^[a-z]")
    return F.when(soft, F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


#: White space as the wrapped texts' own format counts it.
_BLANK, _INK = r"[\s\uFEFF]", r"[^\s\uFEFF]"


def wrap_text(c: Column, width: int = 70) -> Column:
    """Greedy wrap into lines of at most ``width`` characters (a longer word stays
    whole): an array of lines, with one empty line for blank text. White space between
    two words of a line stays, at the ends of a line it goes, but for the text's own indent.

    A line is the longest run of at most ``width`` characters that ends with a word, so
    that one regular expression, which never looks further than a line, finds all lines."""
    fits = rf"\A[\s\S]{{0,{width - 1}}}{_INK}(?={_BLANK}|\z)|\A{_BLANK}*{_INK}+"
    later = rf"{_INK}(?:[\s\S]{{0,{width - 2}}}{_INK})?(?={_BLANK}|\z)|{_INK}+" if width > 1 else rf"{_INK}+"
    lines = F.regexp_extract_all(c, F.lit(f"(?U){fits}|{later}"), F.lit(0))
    return F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)
