"""Reading HTML with expressions: tags, attributes, text and entities.

Everything here works on one string at a time, so the jobs that use it need no
shuffle and no Python worker.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from litscore.functions.bind import let

# One attribute: name, then optionally = and a quoted or bare value.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s\"'>]+"
_ATTRIBUTE = rf"\s+[^\s=>\"']+(?:\s*=\s*(?:{_VALUE}))?"
# What may stand between the name of a tag and its closing bracket.
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"

# All names of HTML 5, with the semicolon where they need one.
_NAMED = json.dumps(html5)
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# What references to control characters of Windows-1252 stand for, from 128 on.
_WINDOWS = bytes(range(128, 160)).decode("cp1252", "replace")


def strip_noise(html: Column) -> Column:
    """Drop comments, scripts and style sheets: neither their tags nor text count."""
    return F.regexp_replace(html, r"(?is)<(?:!--.*?-->|(script|style)\b.*?</\1\s*>)", "")


def _character(code: Column) -> Column:
    """The character of a numeric reference; U+FFFD for those that name none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.substring(F.lit(_WINDOWS), code - 127, F.lit(1))
    return F.when(code.between(128, 159), windows).when(valid, character).otherwise("\ufffd")


def _decode_entity(token: Column) -> Column:
    def digits(pattern: str) -> Column:
        # without leading zeros; more digits than any character has are cut to too many
        return F.substring(F.regexp_extract(token, pattern, 1), 1, 8)

    hexadecimal = F.conv(F.nullif(digits(r"^&#[xX]0*([0-9a-fA-F]+);?$"), F.lit("")), 16, 10)
    decimal = F.nullif(digits(r"^&#0*([0-9]+);?$"), F.lit(""))
    code = F.coalesce(hexadecimal, decimal).cast("bigint")
    numeric = F.when(token.rlike(r"^&#([xX][0-9a-fA-F]+|[0-9]+);?$"), let(code, _character))

    names = F.from_json(F.lit(_NAMED), "map<string,string>")
    start = F.regexp_extract(token, rf"^&({_OPEN_NAMES})", 1)
    longest = F.when(start != "", F.concat(names[start], F.substring(token, F.length(start) + 2, F.length(token))))
    named = F.coalesce(names[F.substring(token, F.lit(2), F.length(token))], longest)
    return F.coalesce(F.when(token.startswith("&#"), numeric).otherwise(named), token)


def unescape(text: Column) -> Column:
    """Replace character references, each once: ``&amp;lt;`` becomes ``&lt;``."""

    def replaced(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+)|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&"), F.lit(0))
        decoded = F.transform(
            tokens, lambda x: F.when(x.startswith("&"), _decode_entity(x)).otherwise(x)
        )
        return F.when(F.contains(t, F.lit("&")), F.array_join(decoded, "")).otherwise(t)

    return let(text, replaced)


def text_of(html: Column) -> Column:
    """The text of a fragment: tags dropped, entities replaced."""
    return unescape(F.regexp_replace(strip_noise(html), rf"<[a-zA-Z!/?]{_INSIDE}>", ""))


def raw_attribute(tag: Column, name: str) -> Column:
    """The value of one attribute of an opening tag as it is written, null if absent."""

    def value(raw: Column) -> Column:
        bare = F.substring(raw, F.lit(2), F.length(raw) - 2)
        return F.when(raw != "", F.when(raw.rlike("^[\"']"), bare).otherwise(raw))

    pattern = rf"(?is)^<\w+(?:{_ATTRIBUTE})*?\s+{name}\s*=\s*({_VALUE})"
    return let(F.regexp_extract(tag, pattern, 1), value)


def attribute(tag: Column, name: str) -> Column:
    """The value of one attribute of an opening tag, null where it is absent."""
    return unescape(raw_attribute(tag, name))


def has_class(tag_class: Column, name: str) -> Column:
    """Whether a class attribute holds the class ``name``."""
    return F.coalesce(F.array_contains(F.split(tag_class, r"\s+"), name), F.lit(False))


def open_tags(html: Column, *names: str) -> Column:
    """All opening tags with one of these names, in order."""
    pattern = rf"(?i)<(?:{'|'.join(names)})(?=[\s/>]){_INSIDE}>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


_SINGLE = (
    rf"(?is)^<a{_INSIDE}>(?:<(?!(?:br|hr|img|input|wbr)[\s/>])[a-z]{_INSIDE}>)*[^<]*(?:</[a-z]{_INSIDE}>)*$"
)


def anchors(html: Column) -> Column:
    """All anchors of a page as ``array<struct<href, class, ref, text, single>>``, in order.

    ``single``: all an anchor holds is one string, maybe inside elements that hold nothing else.
    """
    pattern = rf"(?is)<a(?=[\s/>]){_INSIDE}>.*?(?=</a\s*>|<a[\s/>]|$)"
    found = F.regexp_extract_all(strip_noise(html), F.lit(pattern), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(
            attribute(a, "href").alias("href"),
            attribute(a, "class").alias("class"),
            attribute(a, "ref").alias("ref"),
            text_of(a).alias("text"),
            a.rlike(_SINGLE).alias("single"),
        ),
    )


def _opening(tag: str, attr: str | None, value: str | None) -> str:
    """A pattern for the opening tag of ``tag``, with an attribute of that value."""
    has = ""
    if attr is not None:
        word = re.escape(value)
        if attr == "class":  # one of the classes
            quoted = [rf"{q}(?:[^{q}]*\s)?{word}(?:\s[^{q}]*)?{q}" for q in "\"'"]
        else:
            quoted = [rf"{q}{word}{q}" for q in "\"'"]
        options = "|".join([*quoted, rf"{word}(?=[\s/>])"])
        has = rf"(?=(?:{_ATTRIBUTE})*?\s+(?i:{attr})\s*=\s*(?:{options}))"
    return rf"<(?i:{tag})(?=[\s/>]){has}{_INSIDE}>"


def element_bodies(html: Column, tag: str, attr: str, value: str) -> Column:
    """The inner HTML of all leaf elements ``tag`` whose attribute has ``value``."""
    pattern = rf"(?s){_opening(tag, attr, value)}(.*?)</(?i:{tag})\s*>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def element_body(
    html: Column, tag: str, attr: str | None = None, value: str | None = None
) -> Column:
    """The inner HTML of the first ``tag`` whose attribute has ``value``; null if none.

    Nested elements of the same name are balanced: the element ends at the closing
    tag that brings the depth back to zero, or else at the end of the page.
    """
    opening, closing = rf"^<(?i:{tag})[\s/>]", rf"^</(?i:{tag})\s*>"
    rest = F.regexp_extract(html, rf"(?s){_opening(tag, attr, value)}.*", 0)
    pieces = F.regexp_extract_all(
        rest, F.lit(rf"(?s)<(?i:{tag})(?=[\s/>]){_INSIDE}>|</(?i:{tag})\s*>|.[^<]*+"), F.lit(0)
    )

    def step(state: Column, token: Column) -> Column:
        depth, ended = state["depth"], (state["depth"] == 0) & (state["taken"] > 0)
        moved = (
            F.when(ended, 0)
            .when(token.rlike(opening), depth + 1)
            .when(token.rlike(closing), depth - 1)
            .otherwise(depth)
        )
        taken = state["taken"] + F.when(moved > 0, 1).otherwise(0)
        return F.struct(moved.cast("int").alias("depth"), taken.cast("int").alias("taken"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"))

    def inner(tokens: Column) -> Column:
        # the first token taken is the opening tag itself
        taken = F.aggregate(tokens, start, step, lambda s: s["taken"])
        body = F.array_join(F.slice(tokens, F.lit(2), taken - 1), "")
        return F.when(F.size(tokens) > 0, body)

    return let(pieces, inner)
