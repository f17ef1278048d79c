"""Text functions, Column to Column; built-ins but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
ENTITIES = (("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
BULLETS_FROM, BULLETS_TO = "○●•＊※（）－–—“”‘’", "ㅇㅇㅇ**()---\"\"''"
BULLET_HEAD = r"^[ㅇoO0*\-–—·・•○●■□㉠①\s]+"
REASON_KEYS = ("길이", "반복", "표")


def norm_space(c: Column) -> Column:
    """White space runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def strip_fence(c: Column) -> Column:
    """Without a code fence around the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z]*[ \t]*\n?", ""), r"\n?```\s*$", ""))


def strip_tags(c: Column) -> Column:
    """Plain text of HTML: a line for each row, a space for each cell, no tags."""
    t = F.regexp_replace(c, r"(?i)</tr\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n"))


def compact_html(c: Column) -> Column:
    """Without white space between tags."""
    return F.trim(F.regexp_replace(c, r">\s+<", "><"))


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _span_attributes(tag: str, to: str, c: Column) -> Column:
    """Opening `tag`s (a pattern) as `to`, with rowspan and colspan alone, in that order.  Tags
    without either go first, so that the others are looked for among what is left."""
    row, col = r'\browspan\s*=\s*"(\d+)"', r'\bcolspan\s*=\s*"(\d+)"'
    no_row, no_col = row.replace("(", "").replace(")", ""), col.replace("(", "").replace(")", "")
    both = rf"(?i)<{tag}\s(?:(?=[^>]*{row})(?=[^>]*{col}))[^>]*>"
    c = F.regexp_replace(c, rf"(?i)<{tag}(?:\s(?![^>]*\b(?:row|col)span\s*=)[^>]*)?>", f"<{to}>")
    c = F.regexp_replace(c, both, f'<{to} rowspan="$1" colspan="$2">')
    c = F.regexp_replace(c, rf"(?i)<{tag}\s(?![^>]*{no_col})(?=[^>]*{row})[^>]*>", f'<{to} rowspan="$1">')
    return F.regexp_replace(c, rf"(?i)<{tag}\s(?![^>]*{no_row})(?=[^>]*{col})[^>]*>", f'<{to} colspan="$1">')


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def canon(c: Column) -> Column:
    """One spelling for texts that differ in markup only: a fence around the text and
    table sections dropped, header cells as cells, span attributes alone kept."""
    c = F.coalesce(c, F.lit(""))
    # Texts without a fence, an entity or a line break are spared the search for them.
    t = _stripped(F.when(c.contains("```"), F.regexp_replace(c, r"\A\s*```[a-zA-Z]*\s*|\s*```\s*\z", "")).otherwise(c))
    t = F.when(c.contains("&"), unescape(t)).otherwise(t)
    h = F.when(t.contains("<b") | t.contains("<B"), F.regexp_replace(t, r"(?i)<br\s*/?>", "<br/>")).otherwise(t)
    h = F.regexp_replace(h, r"(?i)</?(?:thead|tbody|tfoot)[^>]*>", "")
    h = F.regexp_replace(_span_attributes("t[hd]", "td", h), r"(?i)</th>", "</td>")
    h = F.regexp_replace(F.regexp_replace(h, r"(?i)<tr(?:\s[^>]*)?>", "<tr>"), r"(?i)<table(?:\s[^>]*)?>", "<table>")
    h = F.regexp_replace(F.regexp_replace(h, r">\s+<", "><"), r"[\t\n\x0b\f\r]\s*| \s+", " ")
    return _stripped(F.when(t.contains("<"), h).otherwise(t))


def compare_key(c: Column) -> Column:
    """canon without tags, white space and bullets, for comparison alone."""
    t = F.regexp_replace(canon(c), r"<[^>]+>", "")
    t = F.when(F.octet_length(c) == F.char_length(c), t).otherwise(F.translate(t, BULLETS_FROM, BULLETS_TO))  # all of them beyond ASCII
    return F.regexp_replace(F.regexp_replace(t, r"\s+", ""), BULLET_HEAD, "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def norm_key(c: Column) -> Column:
    """NFKC, one spelling of the company mark, letters and digits alone, lower case."""
    t = nfkc(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"\(주\)|㈜", "주")
    return F.lower(F.regexp_replace(t, "[^0-9A-Za-z가-힣]", ""))


def detect_language(c: Column) -> Column:
    """kor, eng or mix by the share of Hangul among Hangul and Latin letters; other without any."""
    kor, lat = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = kor / (kor + lat)
    return F.when(kor + lat == 0, "other").when(share > 0.8, "kor").when(share < 0.2, "eng").otherwise("mix")


def hangul_ratio(c: Column) -> Column:
    """Share of Hangul syllables among letters; 0 without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(c, F.lit("[가-힣]")) / letters)


def drop_unprintable(c: Column) -> Column:
    """Without U+FFFD and control or format characters other than line ends and tabs."""
    return F.regexp_replace(c, r"[\x{FFFD}[\p{C}&&[^\n\r\t]]]", "")


def safe_table(c: Column) -> Column:
    """Table tags stay, script and style go, everything else is escaped."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<(/?(?:table|thead|tbody|tr|td|th|br)\b[^<>]*)>", "\x01$1\x02")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return F.translate(t, "\x01\x02", "<>")


def reason_key(c: Column, prefixes: tuple[str, ...] = REASON_KEYS) -> Column:
    """Reasons that differ in a count only, under their common beginning."""
    out = c
    for p in reversed(prefixes):
        out = F.when(c.startswith(p), F.lit(p)).otherwise(out)
    return out


def stem(c: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
