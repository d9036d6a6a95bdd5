"""Link text: wikilinks ``[[Target#heading|Text]]`` and Markdown links ``[Text](Target.md)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKILINK = r'^"?\[\[.+\]\]"?$'
MARKDOWN_LINK = r'^"?\[.+\]\(.+\.md\)"?$'


def is_wikilink(c: Column) -> Column:
    return F.coalesce(c.rlike(WIKILINK), F.lit(False))


def is_markdown_link(c: Column) -> Column:
    return F.coalesce(c.rlike(MARKDOWN_LINK), F.lit(False))


def link_target(c: Column) -> Column:
    """Target of a link without display text, heading and brackets; null when not a link."""
    wiki = F.regexp_extract(c, r'^"?\[\[([^\]|#]+)', 1)
    mark = F.regexp_extract(c, r'^"?\[.+\]\((.+)\.md\)"?$', 1)
    return F.when(is_wikilink(c) & (wiki != ""), F.trim(wiki)).when(mark != "", mark)


def target_path(c: Column) -> Column:
    """Path-qualified target of a link or of bare target text."""
    inner = F.coalesce(link_target(c), c)
    return F.trim(F.regexp_extract(inner, r"^([^|#]*)", 1))


def target_base(c: Column) -> Column:
    return F.trim(F.element_at(F.split(target_path(c), "/"), -1))


def to_wikilink(c: Column) -> Column:
    return F.when(is_wikilink(c), c).otherwise(
        F.concat(F.lit("[["), F.coalesce(link_target(c), c), F.lit("]]")))


def to_markdown_link(c: Column) -> Column:
    inner = F.coalesce(link_target(c), c)
    return F.when(is_markdown_link(c), c).otherwise(
        F.concat(F.lit("["), inner, F.lit("]("), inner, F.lit(".md)")))


def link_format(c: Column, style: str) -> Column:
    if style not in ("wikilink", "markdown"):
        raise ValueError(f"unknown link style: {style}")
    return to_wikilink(c) if style == "wikilink" else to_markdown_link(c)
