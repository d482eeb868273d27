"""Expressions over HTML text.

An "element" is its outer HTML as a string. Selectors are patterns for a start tag; an element ends at
its balanced end tag. Nothing here leaves the JVM.

These expressions nest deeply, so the helpers take and return SQL text (a column name is the simplest
case); `F.expr` turns the result into a column in one step.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from postloom.functions.text import BLANKS

VOID_TAGS = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
INLINE_TAGS = "a|abbr|b|code|em|font|i|label|mark|s|small|span|strong|sub|sup|time|u"
# Named entities; the ampersand comes last so that nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")] + [
    (f"&{name};", char) for name, char in (
        ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("laquo", "«"), ("raquo", "»"), ("ndash", "–"),
        ("mdash", "—"), ("hellip", "…"), ("bull", "•"), ("middot", "·"), ("copy", "©"), ("reg", "®"), ("trade", "™"),
        ("euro", "€"), ("pound", "£"), ("deg", "°"), ("aacute", "á"), ("agrave", "à"), ("acirc", "â"), ("auml", "ä"),
        ("aring", "å"), ("atilde", "ã"), ("ccedil", "ç"), ("eacute", "é"), ("egrave", "è"), ("ecirc", "ê"), ("euml", "ë"),
        ("iacute", "í"), ("ntilde", "ñ"), ("oacute", "ó"), ("ocirc", "ô"), ("ouml", "ö"), ("otilde", "õ"),
        ("oslash", "ø"), ("uacute", "ú"), ("ugrave", "ù"), ("ucirc", "û"), ("uuml", "ü"), ("szlig", "ß"),
        ("Auml", "Ä"), ("Ouml", "Ö"), ("Uuml", "Ü"), ("Eacute", "É"))] + [("&amp;", "&")]

_names = itertools.count()


# --- SQL text ---

def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and use it several times in `body`."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def unless(value: str, *unwanted: str) -> str:
    """The text, or null where it equals one of the unwanted texts."""
    listed = ", ".join(quoted(u) for u in unwanted)
    return let(value, lambda v: f"if({v} in ({listed}), null, {v})")


def each(items: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"transform({items}, {name} -> {body(name)})"


def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)})"


def stripped(text: str) -> str:
    return f"btrim({text}, {quoted(BLANKS)})"


# --- selectors: patterns of a start tag ---

# Names of tags and attributes match in any case, values in either kind of quotes.

def by_tag(name: str) -> str:
    return rf"<(?i:{name})(?:\s[^>]*)?>"


def by_class(css_class: str, tag: str = r"[a-zA-Z][\w-]*") -> str:
    double, single = (rf"{q}(?:[^{q}]*\s)?{css_class}(?:\s[^{q}]*)?{q}" for q in ('"', "'"))
    return rf"<(?i:{tag})(?=\s)[^>]*?\s(?i:class)=(?:{double}|{single})[^>]*>"


def by_attr(name: str, part: str, tag: str = r"[a-zA-Z][\w-]*") -> str:
    """Start tag whose attribute contains a text."""
    double, single = (rf"{q}[^{q}]*{part}[^{q}]*{q}" for q in ('"', "'"))
    return rf"<(?i:{tag})(?=\s)[^>]*?\s(?i:{name})=(?:{double}|{single})[^>]*>"


# --- elements ---

def start_tag(element: str) -> str:
    return f"regexp_extract({element}, {quoted('(?s)^<[^>]*>')}, 0)"


def tags_only(html: str) -> str:
    """The start tags alone: a short text to search when the visible text does not matter."""
    return f"array_join(regexp_extract_all({html}, {quoted('<[a-zA-Z][^>]*>')}, 0), '')"


def balanced(tail: str, strict: bool = False) -> str:
    """The first element of a text that begins with its start tag, up to the matching end tag.

    Without an end tag it is the whole text, or null if `strict`.
    """
    def body(text: str) -> str:
        name = f"lower(regexp_extract({text}, {quoted(r'^<([a-zA-Z][\w-]*)')}, 1))"
        return let(name, lambda n: cut(text, n))

    def cut(text: str, name: str) -> str:
        tag = start_tag(text)
        pieces = f"split({text}, concat('(?i)(?=</?', {name}, {quoted(r'[\s/>])')}))"
        alone = f"{name} in ({', '.join(quoted(t) for t in VOID_TAGS.split('|'))}) or endswith({tag}, '/>')"
        return f"if({alone}, {tag}, {let(pieces, lambda p: close(text, name, p))})"

    def close(text: str, name: str, pieces: str) -> str:
        # Walk over the open and close tags of this name; `end` is the piece where the depth returns to 0.
        s, p = f"s{next(_names)}", f"p{next(_names)}"
        depth = f"({s}.depth + case when startswith({p}, '</') then -1 when startswith({p}, '<') then 1 else 0 end)"
        end = (f"aggregate({pieces}, named_struct('depth', 0, 'at', 0, 'end', 0), ({s}, {p}) -> named_struct("
               f"'depth', {depth}, 'at', {s}.at + 1, "
               f"'end', if({s}.end = 0 and {depth} = 0, {s}.at + 1, {s}.end)), {s} -> {s}.end)")
        unclosed = "cast(null as string)" if strict else text
        return let(end, lambda e: f"if({e} = 0, {unclosed}, "
                                  f"concat(array_join(slice({pieces}, 1, {e} - 1), ''), '</', {name}, '>'))")

    return let(tail, lambda t: f"if(startswith({t}, '<'), {body(t)}, null)")


def select_first(html: str, *path: str) -> str:
    """First element, in page order, reached by a path of start-tag patterns; null if none.

    Each pattern is searched inside the elements of the one before. The first element of every step is tried
    first; only where that leads nowhere are all of them searched.
    """
    def first(scope: str, pattern: str) -> str:
        def element(text: str) -> str:
            return let(f"regexp_instr({text}, {quoted(pattern)})",
                       lambda at: f"if({at} > 0, {balanced(f'substring({text}, {at})')}, null)")

        return let(scope, element)

    current = first(html, path[0])
    for pattern in path[1:]:
        # Below the first step the search must not find the container itself again.
        current = first(inside(current), pattern)
    if len(path) == 1:
        return current
    found = select_all(html, path[0])
    for pattern in path[1:]:
        found = f"flatten({each(found, lambda e, p=pattern: select_all(inside(e), p))})"
    return f"coalesce({current}, get({found}, 0))"


def inside(element: str) -> str:
    """The element without its own start tag."""
    return replaced(element, "(?s)^<[^>]*>", "")


def select_all(html: str, pattern: str) -> str:
    """All elements whose start tag matches, in page order (nested ones included)."""
    def outer(pieces: str) -> str:
        piece, at = f"p{next(_names)}", f"i{next(_names)}"
        # A piece ends where the next match starts; only an element that reaches further needs the rest.
        rest = f"array_join(slice({pieces}, {at} + 1, size({pieces})), '')"
        found = (f"if(regexp_like({piece}, {quoted(f'^{pattern}')}), "
                 f"coalesce({balanced(piece, strict=True)}, {balanced(rest)}), null)")
        return f"filter(transform({pieces}, ({piece}, {at}) -> {found}), e -> e is not null)"

    return let(f"split({html}, {quoted(f'(?={pattern})')})", outer)


def decode_entities(text: str) -> str:
    def named(value: str) -> str:
        for entity, char in ENTITIES:
            value = f"replace({value}, {quoted(entity)}, {quoted(char)})"
        return value

    def character(piece: str) -> str:
        """A text that follows `&#`: its number as a character, or the text with the mark put back."""
        digits = let(f"regexp_extract({piece}, {quoted('^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});')}, 1)", lambda d: (
            f"if({d} = '', -1, if(lower(left({d}, 1)) = 'x', cast(conv(substring({d}, 2), 16, 10) as int), "
            f"cast({d} as int)))"))
        valid = "{0} between 1 and 55295 or {0} between 57344 and 1114111"
        shown = "concat(decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32'), substring({1}, instr({1}, ';') + 1))"
        return let(digits, lambda n: f"if({valid.format(n)}, {shown.format(n, piece)}, concat('&#', {piece}))")

    def numbered(value: str) -> str:
        p = f"p{next(_names)}"
        pieces = let(f"split({value}, '&#')", lambda s: (
            f"concat({s}[0], array_join(transform(slice({s}, 2, size({s})), {p} -> {character(p)}), ''))"))
        return f"if(contains({value}, '&#'), {pieces}, {value})"

    return let(text, lambda t: f"if(contains({t}, '&'), {named(let(t, numbered))}, {t})")


def squeezed(text: str) -> str:
    """Runs of blanks as one space; single spaces are passed over."""
    return replaced(text, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")


def attr(element: str, name: str, default: str = "") -> str:
    """Attribute of the element's start tag, or the default where it is absent or empty."""
    def value(tag: str) -> str:
        double = rf'^<[^>]*?\s(?i:{name})="([^"]*)"'
        single = rf"^<[^>]*?\s(?i:{name})='([^']*)'"
        return decode_entities(
            f"concat(regexp_extract({tag}, {quoted(double)}, 1), regexp_extract({tag}, {quoted(single)}, 1))")

    return f"coalesce({unless(let(start_tag(element), value), '')}, {quoted(default)})"


def inner_text(html: str) -> str:
    """Visible text: no scripts, styles, comments or tags; entities decoded; blanks squeezed."""
    # Every pattern starts with a literal <, so that text without tags is passed over quickly.
    text = replaced(html, r"(?is)<(?:script\b.*?</script|style\b.*?</style|!--.*?--)>", " ")
    text = replaced(text, rf"(?i)</?(?:{INLINE_TAGS})(?:\s[^>]*)?>", "")
    text = decode_entities(replaced(text, r"<[^>]*>", " "))
    return stripped(squeezed(text))


def first_text(html: str, paths: list[list[str]], default: str = "",
               clean: Callable[[str], str] | None = None, skip: tuple[str, ...] = ()) -> str:
    """First text of an ordered selector list that is not empty (after `clean`) and not one of `skip`."""
    texts = [inner_text(select_first(html, *path)) for path in paths]
    candidates = [unless(clean(text) if clean else text, "", *skip) for text in texts]
    return f"coalesce({', '.join(candidates)}, {quoted(default)})"


def longest_text(html: str, patterns: list[str]) -> str:
    """Longest text among all matches of several patterns; the first one wins a tie."""
    found = ", ".join(each(select_all(html, pattern), inner_text) for pattern in patterns)
    return f"aggregate(concat({found}), '', (best, t) -> if(length(t) > length(best), t, best))"


def first_matching(html: str, patterns: list[str], keep: Callable[[str], str]) -> str:
    """Elements of the first selector that has any element passing `keep`; an empty array if none has."""
    found = []
    for pattern in patterns:
        name = f"e{next(_names)}"
        kept = f"filter({select_all(html, pattern)}, {name} -> {keep(name)})"
        found.append(let(kept, lambda k: f"if(size({k}) > 0, {k}, null)"))
    return f"coalesce({', '.join(found)}, cast(array() as array<string>))"
