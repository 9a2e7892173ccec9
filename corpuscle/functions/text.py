"""Text functions: columns in, columns out. Null in, null out, unless said otherwise."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in every script, with the four separators that Java's class leaves out.
WS = r"(?U)[\s\x1c-\x1f]+"
#: Characters after which a sentence may end.
ENDS = ".!?。！？…"
#: Letters, numbers, the underline, and everything from U+00C0 to U+1EF9.
WORD = r"[\p{L}\p{N}_À-ỹ]+"
#: Named entities that are decoded, the ampersand last.
ENTITIES = (("nbsp", " "), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def normalise(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return strip(F.lower(c))


def tokens(c: Column) -> Column:
    """Words between white space, as they stand."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def words(c: Column) -> Column:
    """Words of letters, numbers and underlines."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences of the collapsed text: it is cut at white space after a sentence's end."""
    return F.filter(F.split(collapse(c), rf"(?<=[{ENDS}])\s+"), lambda s: s != "")


def characters(c: Column) -> Column:
    """Code points of a text."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


#: Markup that patterns do not see as a parser does: numeric, other and unended entities, `>` inside quotes, a `<` that
#: begins no tag, processing instructions, declarations, comments, scripts and styles without an end.
ODD_HTML = (
    r"(?is)&(?!(?:" + "|".join(n for n, _ in ENTITIES) + r");)|<[a-z][^<>]*=\s*(?:\"[^\"<>]*[<>]|'[^'<>]*[<>])|<(?![a-z/!])|</(?![a-z])|<!(?!--|doctype)"
    r"|<!-->|<!--->|<!--(?!.*?-->)|--!>|<(script|style)\b(?!.*?</\1\s*>)|<[a-z/][^<>]*(?:<|$)"
)


class _Reader(HTMLParser):
    """Collects the texts between markup, outside of scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.open, self.inside = [], [], ""

    def cut(self, *_) -> None:
        self.parts.append("".join(self.open))
        self.open.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.cut()
        if tag in ("script", "style"):
            self.inside = tag

    def handle_endtag(self, tag: str) -> None:
        self.cut()
        if tag == self.inside:
            self.inside = ""

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.open.append(data)

    handle_comment = handle_decl = handle_pi = unknown_decl = cut


def read_html(page: str) -> str:
    """The text of a page as a parser reads it, its parts joined by spaces."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return " ".join(reader.parts)


def parsed_html(c: Column) -> Column:
    """read_html() of each text, in Arrow batches; null stays null."""

    @F.pandas_udf(T.StringType())
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(read_html, na_action="ignore")

    return read(c)


def clean_html(c: Column) -> Column:
    """What a reader sees: no comments, doctype, scripts or styles; tags become spaces, entities characters.

    Patterns do this for usual pages; a page with `ODD_HTML` goes through a parser.
    """
    own = c
    for pattern in (r"(?s)<!--.*?-->", r"(?i)<!doctype[^>]*>", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        own = F.regexp_replace(own, pattern, " ")
    for name, char in ENTITIES:
        own = F.regexp_replace(own, f"&{name};?", char)
    odd = F.regexp_like(c, F.lit(ODD_HTML))
    return collapse(F.coalesce(parsed_html(F.when(odd, c)), own))


def answer(c: Column) -> Column:
    """What follows the last `Answer:`; the whole text if there is none."""
    return strip(F.substring_index(c, "Answer:", -1))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def suffix(c: Column) -> Column:
    """The last extension in lower case, without the dot; empty for names like `.wav` and `a.`."""
    return F.lower(F.regexp_extract(basename(c), r"(?<=[^/.])[^/]*?\.([^./]+)$", 1))


def stem(c: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]+$", "")
