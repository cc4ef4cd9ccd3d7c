"""Title and markup text functions. White space and letters are those of Unicode throughout."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends and starts of ASCII words (Java's own boundary looks at Unicode letters).
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SPACES = r"(?U)\s+"
#: Dashes and tildes that set off a decorated subtitle. Fixed values.
TITLE_DASHES = "\\-\u2013\u2014~\uff5e\u301c"
#: Named references that catalogues use. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—",
            "&ndash;": "–", "&copy;": "©", "&middot;": "·", "&eacute;": "é", "&amp;": "&"}


def single_spaced(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, _SPACES, " "), "^ | $", "")


def strip_title(t: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return single_spaced(F.regexp_replace(F.lower(t), r"(?U)[^\p{L}\p{N}\s]", ""))


def normalize_title(t: Column) -> Column:
    """strip_title without the English articles."""
    return single_spaced(F.regexp_replace(strip_title(t), f"{START}(?:the|an?){END}", " "))


def has_letter(t: Column) -> Column:
    return t.rlike(r"\p{L}")


def trailing_number(t: Column) -> Column:
    """(stem, value): the number at the end, null if there is none."""
    form = r"^(.*?)(?U:\s*)([0-9]+)$"
    yes = t.rlike(form)
    return F.struct(F.when(yes, F.regexp_extract(t, form, 1)).otherwise(t).alias("stem"), F.when(yes, F.regexp_extract(t, form, 2).cast("decimal(38,0)")).alias("value"))


def differ_only_by_trailing_number(a: Column, b: Column) -> Column:
    x, y = trailing_number(a), trailing_number(b)
    return (x.stem == y.stem) & ~x.value.eqNullSafe(y.value)


#: How titles spell a season, a part or a cour. Fixed values.
_ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
_SEASONS = "|".join((
    rf"(?i:{START}(?:(?:season|part|cour)\s*[0-9]{{1,3}}|[0-9]{{1,3}}(?:st|nd|rd|th)\s+(?:season|part|cour)|(?:{_ORDINALS})\s+(?:season|part|cour)){END})",
    r"シーズン(?U:\s*)[0-9]{1,3}", r"第(?U:\s*)[0-9〇零一二三四五六七八九十]{1,4}(?U:\s*)[期季]"))
#: What a catalogue may leave out of a title, and what then stands in its place, in the order in which it is left out. Fixed values.
SHORTENINGS = (
    (rf"(?:^|(?U:\s))([{TITLE_DASHES}])(?U:\s*)[^{TITLE_DASHES}]{{2,}}(?U:\s*)\1(?U:\s*)$", ""),
    (rf"(?U:\s*)(?:{_SEASONS})", " "),
    (rf"(?i){START}(?:the|an?){END}", " "),
    (r"(?s)^([^:]{3,}):.*$", "$1"),
)
LEAST_LETTERS = 3


def simplify_title(t: Column) -> Column:
    """Shorter queries for a title, most specific first: each leaves out one thing more, and each is a new one of 3 letters or more."""
    shorter = accumulate(SHORTENINGS, lambda now, rule: single_spaced(F.regexp_replace(now, *map(F.lit, rule))), initial=t)
    return F.filter(F.array_except(F.array(*shorter), F.array(t)), lambda q: F.length(q) >= LEAST_LETTERS)


def strip_tags(t: Column) -> Column:
    return F.regexp_replace(t, r"<[^>]*>", " ")


def decode_entities(t: Column) -> Column:
    """Named references of the table and decimal and hexadecimal ones below U+10000, ampersands last."""
    numeric = F.regexp_extract_all(t, F.lit(r"&#(x?[0-9A-Fa-f]+);"), F.lit(1))
    one = lambda n: F.when(n.startswith("x"), F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).try_cast("int")
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(one(n)), 4, "0")), "UTF-16BE")
    t = F.aggregate(F.array_distinct(numeric), t, lambda s, n: F.when(one(n).between(1, 0xFFFF), F.replace(s, F.concat(F.lit("&#"), n, F.lit(";")), point(n))).otherwise(s))
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), t)


def clean_text(t: Column) -> Column:
    """Markup out, references decoded, spaces squeezed; null if nothing is left."""
    return F.nullif(single_spaced(decode_entities(strip_tags(t))), F.lit(""))


def number(t: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    return F.regexp_replace(F.trim(t), ",", "").try_cast("double")


def rendered_text(markdown: Column) -> Column:
    """Plain text of a description in Markdown or HTML."""
    links = F.regexp_replace(markdown, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    marks = F.regexp_replace(F.regexp_replace(links, r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+])\s+", ""), r"(\*\*|__|~~|`)", "")
    return clean_text(marks)


def ellipsis(t: Column, n: int) -> Column:
    """Cut at the first space from position n on, without a comma or full stop before it."""
    cut = F.regexp_extract(t, rf"(?s)^(.{{{n}}}[^ ]*) ", 1)
    return F.when(cut == "", t).otherwise(F.concat(F.regexp_replace(cut, "[,.]$", ""), F.lit("...")))


def na(t: Column, *missing: str) -> Column:
    """Null where the text is one of a source's words for a missing value."""
    return F.when(~t.isin(*(missing or ("N/A",))), t)
