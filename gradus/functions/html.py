"""Light extraction from regular pages with JVM regular expressions.

For pages whose tags of interest do not nest. Where nesting or document scope
matters use ``gradus.operators.extract``, which parses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions import text as T

# Named entities decoded here, ``&amp;`` last. Numbered ones are
# decoded by their number.
ENTITIES = (
    ("&nbsp;", "\xa0"),
    ("&apos;", "'"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&le;", "≤"),
    ("&ge;", "≥"),
    ("&ne;", "≠"),
    ("&times;", "×"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities decoded. Behind the last ``>`` there is no tag to
    look for, so that ``<`` without an end does not search the rest each time."""
    rest = F.substring_index(markup, ">", -1)
    tagged = F.left(markup, F.length(markup) - F.length(rest))
    out = _numbered(F.concat(F.regexp_replace(tagged, "<[^>]*>", ""), rest))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _numbered(text: Column) -> Column:
    """Numbered entities as their characters; each distinct one is replaced once."""
    found = F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1))

    def char(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
        decimal = ~F.lower(entity).startswith("&#x")
        code = F.when(decimal, F.conv(digits, 10, 16)).otherwise(digits)
        legal = F.conv(code, 16, 10).cast("int").between(1, 0x10FFFF)
        return F.when(
            legal, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        ).otherwise(entity)

    decoded = F.aggregate(
        F.array_distinct(found), text, lambda acc, e: F.replace(acc, e, char(e))
    )
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def _content(tag: str) -> str:
    """A tag in any case, with or without attributes. A tag ends before the next ``<``."""
    return rf"(?is)<{tag}(?:\s[^<>]*)?>(.*?)</{tag}\s*>"


def _up_to_last(html: Column, tag: str) -> Column:
    """Text up to the last end of ``tag``. Within it every opening tag has an end to
    find, so that unclosed ones do not each search the rest of the page."""
    return F.regexp_extract(html, rf"(?is)\A(.*</{tag}\s*>)", 1)


def page_title(html: Column, tag: str = "title") -> Column:
    """Stripped text of the first ``tag``; null if absent or empty."""
    found = F.regexp_extract(_up_to_last(html, tag), _content(tag), 1)
    return F.nullif(T.strip(plain_text(found)), F.lit(""))


def page_language(html: Column) -> Column:
    """Language of the first ``lang`` attribute, without its region, in lower case;
    '' if absent."""
    pattern = r"""(?is)<[a-z][^<>]*\slang\s*=\s*["']?([a-z]+)"""
    return F.lower(F.regexp_extract(html, pattern, 1))


def paragraphs(html: Column) -> Column:
    """Stripped texts of all ``p``, in order, empty ones kept."""
    found = F.regexp_extract_all(
        _up_to_last(html, "p"), F.lit(_content("p")), F.lit(1)
    )
    return F.transform(found, lambda p: T.strip(plain_text(p)))


def link_targets(html: Column) -> Column:
    """Targets of all links, in order."""
    pattern = r"""(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    double = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    single = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    # Of the two kinds of quotes one is empty; entities stay as they are.
    return F.zip_with(double, single, lambda a, b: F.concat(a, b))
