"""Text functions as column expressions: they stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is.
TOKEN = r"([0-9a-z]+(?:[.,][0-9]+)*)"
MIN_TOKEN = 2
LEAD_LIMIT, LEAD_LEAST, TITLE_LIMIT = 140, 24, 120


def plain(c: str) -> str:
    """A character case-folded, decomposed, without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that become one character, those then dropped (no counterpart), and expansions."""
    one, gone, more = [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF or 0x3400 <= code < 0xF900 or (code >= 0x20000 and code < 0xE0000):
            continue
        c = chr(code)
        to = plain(c)
        # far planes matter only where they hide ASCII letters or digits
        if to == c or (code >= 0x3000 and not any(x.isascii() and x.isalnum() for x in to)):
            continue
        if len(to) == 1:
            one.append((c, to))
        elif to:
            more[c] = to
        else:
            gone.append(c)
    return "".join(c for c, _ in one) + "".join(gone), "".join(t for _, t in one), more


def normalize(text: Column) -> Column:
    """Case-folded text without accents; one-to-many cases take a slower path, only where they occur."""
    source, target, more = _tables()
    text = F.coalesce(text, F.lit(""))
    # one literal that the optimizer turns into a map: a map of thousands of literals is slow to plan
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{to}" for c, to in more.items())), F.lit("\x01"), F.lit("\x02"))
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), F.translate(c, source, target))), "")
    has_wide = text.rlike("[" + "".join(f"\\x{{{ord(c):X}}}" for c in more) + "]")
    # Latin-1 letters, the common case, take plain byte replacements
    latin = F.lower(text)
    for c in map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)]):
        if plain(c) != c:
            latin = F.replace(latin, F.lit(c), F.lit(plain(c)))
    simple = ~text.rlike(r"[^\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]")
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(text)).when(simple, latin).when(has_wide, wide).otherwise(F.translate(text, source, target))


def fold(token: Column) -> Column:
    """Collapses common inflections of English and French; tokens with digits stay."""
    short = (F.length(token) <= 3) | token.rlike("[0-9]")
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    stem = (
        F.when(token.endswith("aux"), F.concat(cut(3), F.lit("al")))
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.rlike("(?:ch|sh|ss|x|z)es$"), cut(2))
        .when(token.endswith("ss"), token)
        .when(token.endswith("s") | (token.endswith("x") & (F.length(token) > 4)), cut(1))
        .otherwise(token)
    )
    inflected = token.endswith("s") | token.endswith("x") | token.endswith("l")
    return F.when(~inflected | short, token).otherwise(F.regexp_replace(stem, "ail$", "al"))


def tokenize(text: Column) -> Column:
    """Folded tokens in order, repeats included."""
    found = F.regexp_extract_all(normalize(text), F.lit(TOKEN), 1)
    return F.transform(F.filter(found, lambda t: (F.length(t) >= MIN_TOKEN) | t.rlike("^[0-9]+$")), fold)


def collapse(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def flatten(text: Column) -> Column:
    """The form in which quotes are compared with texts."""
    return collapse(normalize(text))


def grounded(text: Column, quote: Column) -> Column:
    """Whether a quote that is not blank really occurs in the text."""
    return F.contains(flatten(text), flatten(quote)) & (flatten(quote) != "")


def clip(text: Column, limit: int = TITLE_LIMIT) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def opening(text: Column, limit: int = LEAD_LIMIT) -> Column:
    """Whole sentences from the start, up to limit characters; a clip if the first is longer."""
    flat = collapse(text)
    window = F.substring(flat, 1, limit + 1)
    last = F.length(F.regexp_extract(window, r"(?s)^(.*[.?!]) ", 1))  # characters up to the last sentence end
    whole = F.when(last - 1 >= LEAD_LEAST, F.substring(window, F.lit(1), last)).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
    return F.when(F.length(flat) <= limit, flat).otherwise(whole)


def human_size(n: Column) -> Column:
    """``999 chars`` or ``1.2k chars``, rounded as the binary value of n / 1000 is (not as its shortest decimal)."""
    n = n.cast("long")
    tenths, rest, q = F.floor(n / 100), n % 100, n / F.lit(1000.0)
    # on a decimal tie the quotient's error decides: q * 1000 against n, both scaled to whole numbers
    scale = F.pow(F.lit(2.0), 52 - F.floor(F.log2(q)))
    error = (q * scale).cast("long") * 1000 - (n * scale).cast("long")
    up = F.when(rest == 50, (error > 0) | ((error == 0) & (tenths % 2 == 1))).otherwise(rest > 50)
    rounded = tenths + up.cast("long")
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" chars"))).otherwise(F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("k chars")))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
