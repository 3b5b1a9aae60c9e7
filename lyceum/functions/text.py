"""Text functions: normal forms, tokens, furniture, headings, classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions import words


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once: what stands inside functions of higher order isn't shared by Spark."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def latin_only(text: Column) -> Column:
    """Whether a text has ASCII only: as many bytes as letters."""
    return F.octet_length(text) == F.length(text)


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside groups."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        parts = [*parts, ""] if c == "|" and not depth else [*parts[:-1], parts[-1] + c]
    return parts


def latin(pattern: str) -> str:
    """What of a pattern a text of ASCII can match: without alternatives in other letters, which cost a look at every letter, and Unicode classes."""
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))?", pattern)[0]
    kept = [a for a in alternatives(pattern[len(flags):]) if a.isascii()]
    # A start of words that all alternatives ask for is looked for once.
    kept = rf"\b(?:{'|'.join(a[2:] for a in kept)})" if all(a.startswith(r"\b") for a in kept) else "|".join(kept)
    return flags.replace("U", "").replace("(?)", "") + kept


def found(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), where texts of ASCII are asked for what they can match alone."""
    return F.when(latin_only(text), text.rlike(latin(pattern))).otherwise(text.rlike(pattern))


def normal_arabic(text: Column, strip_marks: bool = True) -> Column:
    """One spelling per word. The stricter form takes the diacritics out as well."""
    bare = F.regexp_replace(text, "[\u064b-\u065f\u0670\u0640]", "") if strip_marks else text
    # All that is changed stands between U+0621 and U+0670; a text of as many bytes as letters has none of it.
    concerned = (F.octet_length(text) > F.length(text)) & text.rlike("[\u0621-\u0670]")
    return F.when(concerned, F.translate(bare, "أإآىئؤةء", "اااييوه")).otherwise(text)


def normal(text: Column, strip_marks: bool = True) -> Column:
    """Lower case, one Arabic spelling, all but letters, digits and _ as blanks, blanks collapsed."""
    plain = F.lower(normal_arabic(F.coalesce(text, F.lit("")), strip_marks))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9_\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return _tokens_of(normal(text))


def _tokens_of(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(r"[a-z0-9][a-z0-9']*|[\u0600-\u06FF\u0750-\u077F]{2,}"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens that carry content, each by the first word of its group of synonyms, in order, repeats included."""
    return content_of(normal(text))


def content_of(plain: Column) -> Column:
    """content_tokens of a text in normal form."""
    names = {w: group.split()[0] for group in words.SYNONYMS for w in group.split()}
    names = {w: first for w, first in names.items() if w != first}
    same = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    empty = {*words.STOP, *words.STOP_AR, *words.SCAFFOLD, *words.SCAFFOLD_AR}
    kept = F.filter(_tokens_of(plain), lambda w: ~w.isin(sorted(empty)))
    return F.transform(kept, lambda w: F.when(w.isin(sorted(names)), F.try_element_at(same, w)).otherwise(w))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def furniture(text: Column) -> Column:
    """The kinds of document furniture that a text shows, distinct, in order."""
    raw = [F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in words.RAW_FURNITURE]
    found = once(normal(text, strip_marks=False), lambda plain: F.array(*raw, *[F.when(plain.rlike(p), F.lit(k)) for k, p in words.FURNITURE]))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def furniture_line(line: Column) -> Column:
    """Whether a line is furniture, empty or noise."""
    def told(x: Column) -> Column:
        s, plain = x["s"], x["plain"]
        raw = reduce(lambda a, b: a | b, [s.rlike(p) for _, p in words.RAW_FURNITURE])
        return (
            (s == "") | s.rlike(r"^[^\p{L}\p{N}_]+$") | raw | s.rlike(r"^\d{1,5}\s*$") | s.rlike(words.FOLIO_LINE) | (plain == "")
            | s.rlike(words.STRONG_LINE) | plain.rlike(words.STRONG_LINE) | s.rlike(words.STARTING_LINE) | plain.rlike(words.STARTING_LINE) | s.rlike(words.PRESS_LINE)
        )

    return once(F.struct(F.trim(line).alias("s"), normal(line, strip_marks=False).alias("plain")), told)


def without_bullet(line: Column) -> Column:
    """Up to four leading list marks taken off, but never so that nothing is left."""
    bullet = "^\\s*(?:[\u2022\u2023\u25aa\u25ab\u25cf\u25cb\u25e6\u2043\u2219\u00b7\u25a0\u273b\u27a2\u2794]|[*\u2217](?=\\s)|[-\u2010-\u2015](?=\\s))\\s*"
    number = r"^\s*\(?(?:\d{1,2}|[a-z])[.)]\s+"

    def once(x: Column, _: Column) -> Column:
        first = F.regexp_replace(x, bullet, "")
        cut = F.when(first != x, first).otherwise(F.regexp_replace(x, number, ""))
        return F.when(F.trim(cut) == "", x).otherwise(cut)

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), line, once)


def clean_line(line: Column) -> Column:
    """The line without its furniture: fragments between sentence and furniture marks that are furniture go."""
    edge = r"(?i)(?<=[.!?؟])\s+|(?=\b(?:copyright|all rights reserved|isbn|issn|doi|published by|printed by|page\s+\d+\s+of\s+\d+)\b)|(?=[©®™])"
    parts = lambda source: F.filter(F.transform(F.split(source, edge), lambda p: F.trim(p)), lambda p: (p != "") & ~furniture_line(p))
    return once(F.trim(without_bullet(F.trim(line))), lambda source: F.when(furniture_line(source), F.trim(F.array_join(parts(source), " "))).otherwise(source))


def line_key(line: Column) -> Column:
    """Lower case, single blanks, runs of digits as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), r"\d+", "#"))


def heading_like(line: Column) -> Column:
    """Whether a line names a topic and states nothing.

    At most twelve words, no verb (one after a determiner counts as a noun), and numbered, named, short
    with an open end, or all capitals.
    """
    s = F.trim(line)
    parts = F.split(s, r"\s+")
    low = F.transform(parts, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
    verbs, nouns = sorted(set(words.PREDICATES)), words.DETERMINERS
    before = F.concat(F.array(F.lit("")), F.slice(low, 1, F.greatest(F.size(low) - 1, F.lit(0))))
    states = F.exists(F.arrays_zip(low.alias("w"), before.alias("b")), lambda z: z["w"].isin(verbs) & ~z["b"].isin(nouns))
    named = s.rlike(r"^\s*\d{1,3}(?:\.\d{1,3})*\s*[-.–:)]?\s+\S") | s.rlike(words.NAMED_HEADING)
    shaped = named | ((F.size(parts) <= 9) & ~s.rlike(r"[.!?؟:;]$")) | s.rlike(r"^[A-Z][A-Z0-9&'’\-\s]{3,60}$")
    return F.when(s == "", True).otherwise((F.size(parts) <= 12) & ~states & shaped)


def without_inline_heading(text: Column) -> Column:
    """The text without a numbered heading fused to its front, trimmed; the whole text if nothing else would stay."""
    rest = F.trim(F.regexp_replace(text, words.INLINE_HEADING, ""))
    return F.when(rest != "", rest).otherwise(F.trim(text))


def generic_label(name: Column) -> Column:
    key = normal(name)
    return (key == "") | key.isin(words.GENERIC_LABELS) | (F.size(content_tokens(key)) == 0)


def _meets(text: Column, phrases: list[str]) -> Column:
    latin = [p for p in phrases if p.isascii()]
    other = [F.contains(text, F.lit(p)) for p in phrases if not p.isascii()]
    found = [text.rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(latin) + r")(?:$|[^\p{L}\p{N}_])")] if latin else []
    return reduce(lambda a, b: a | b, [*found, *other])


def classified(text: Column, rules) -> Column:
    """The first rule of which a phrase stands in the text (whole words, but for Arabic); the last if none does."""
    plain, out = normal(text), F.lit(rules[-1][0])
    for name, phrases in reversed(rules[:-1]):
        out = F.when(_meets(plain, phrases), name).otherwise(out)
    return out


def knowledge_type(text: Column) -> Column:
    def first(shape: Callable[[str], str]) -> Column:
        out = F.lit("fact")
        for name, pattern in reversed(words.KNOWLEDGE):
            out = F.when(text.rlike(shape("(?i)" + pattern)), name).otherwise(out)
        return out

    # Most texts have none of the words that markers begin with: one pass tells.
    none = F.coalesce(~text.rlike(words.KNOWLEDGE_BEGUN), F.lit(False))
    return F.when(none, "fact").when(latin_only(text), first(latin)).otherwise(first(str))


def trivial_question(text: Column) -> Column:
    return normal(text).rlike(words.TRIVIAL)


def language(text: Column, default: str = "en") -> Column:
    """ar where Arabic letters are at least half as many as Latin ones, en where there are Latin ones, else the default."""
    arabic, latin = F.regexp_count(text, F.lit(r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.coalesce(F.when((arabic > 0) & (arabic * 2 >= latin), "ar").when(latin > 0, "en"), F.lit(default))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def mentions(text: Column, name: Column) -> Column:
    """Occurrences of name in text that don't overlap, whatever the case."""
    low, key = F.lower(text), F.lower(name)
    return F.when(F.length(key) > 0, ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("long")).otherwise(F.lit(0).cast("long"))


def sentences(text: Column) -> Column:
    """Sentences of more than twelve characters: cut after . ! ? before a capital or a digit."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 12)


def page_references(text: Column, pages: Column, most: int = 10) -> Column:
    """Pages named as `page N`, `p. N` or in Arabic that the document has, distinct, in order of mention, at most ten."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:page|p\.|صفحة|ص)\s*[:.]?\s*(\d{1,9})"), F.lit(1))
    numbers = F.filter(F.transform(found, lambda x: x.cast("int")), lambda p: (p >= 1) & (p <= pages))
    return F.slice(F.array_distinct(numbers), 1, most)
