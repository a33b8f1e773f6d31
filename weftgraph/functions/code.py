"""Scalar functions on code: what a call writes to, the names in a declarator, objects made and deleted, the focus of a slice, casts of properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions whose first argument is written, and those that write all arguments from a place on (counted from 0).
WRITES_FIRST = ["strcpy", "strncpy", "strcat", "strncat", "memcpy", "memmove", "memset", "sprintf", "snprintf", "vsprintf", "gets", "fgets", "wcscpy", "wcsncpy", "wcscat", "swprintf", "bcopy"]
WRITES_FROM = {"scanf": 1, "fscanf": 2, "sscanf": 2}


# Fixed value: all blanks that Unicode has, as SQL's trim takes them away; line feeds and tabs are none.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(x: Column) -> Column:
    """A text without blanks of any kind at its ends."""
    return F.btrim(x, F.lit(BLANKS))


def arguments(code: Column, name: str) -> Column:
    """The arguments of the first call of a function, cut at commas outside nested brackets; null without such a call.

    Brackets may be nested three deep.
    """
    nested = r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
    inside = F.regexp_extract(code, rf"(?:^|[^A-Za-z0-9_]){name} ?\(({nested})\)", 1)
    parts = F.regexp_extract_all(inside, F.lit(r"(?:[^,()]|\([^()]*(?:\([^()]*\)[^()]*)*\))+"), F.lit(0))
    return F.when(code.rlike(rf"(?:^|[^A-Za-z0-9_]){name} ?\("), F.transform(parts, trimmed))


def base_name(argument: Column) -> Column:
    """The variable an argument is about: without casts, stars, ampersands, offsets and subscripts; a member path stays."""
    bare = F.regexp_replace(argument, r"^(?:\( [A-Za-z_][A-Za-z0-9_ *]* \) )?[&* ]*", "")
    return F.regexp_extract(bare, r"^([A-Za-z_][A-Za-z0-9_]*(?: (?:->|\.) [A-Za-z_][A-Za-z0-9_]*)*)", 1)


def with_prefixes(path: Column) -> Column:
    """A member path and the paths it goes through: ``a -> b . c`` is ``a``, ``a -> b``, ``a -> b . c``."""
    parts = F.split(path, " ")
    return F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(2)), lambda n: F.array_join(F.slice(parts, 1, n), " "))


def written_by_call(code: Column) -> Column:
    """The variables that copying and scanning functions write in a statement, each once, with the paths they go through."""
    none = F.array().cast("array<string>")
    found = []
    # Most statements name none of them: a plain search of the text spares the patterns.
    for n in WRITES_FIRST:
        found.append(F.when(F.contains(code, F.lit(n)), F.slice(F.coalesce(arguments(code, n), none), 1, 1)).otherwise(none))
    for n, k in WRITES_FROM.items():
        rest = F.filter(F.coalesce(arguments(code, n), none), lambda x, i: i >= k)  # noqa: B023
        found.append(F.when(F.contains(code, F.lit(n)), rest).otherwise(none))
    names = F.filter(F.transform(F.flatten(F.array(*found)), base_name), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(names, with_prefixes)))


def declared_names(code: Column) -> Column:
    """The names that a declaration introduces, one for each declarator; initialisers don't count."""
    bare = F.regexp_replace(F.regexp_replace(code, r" = [^,;]*", ""), r"\[[^\]]*\]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_extract(x, r"([A-Za-z_][A-Za-z0-9_]*)\s*;?\s*$", 1)), lambda x: x != "")


def object_calls(code: Column) -> Column:
    """``C :: C`` for each ``new C``, and for each ``delete`` of a name ``C :: ~C`` if the same text makes or declares it as a ``C *``, else ``delete``
    and the name."""
    made = F.transform(F.regexp_extract_all(code, F.lit(r"\bnew ([A-Za-z_]\w*)"), F.lit(1)), lambda c: F.concat(c, F.lit(" :: "), c))
    declared = r"\b([A-Za-z_]\w*) \* (?:const )?([A-Za-z_]\w*)(?= [=;,)]|$)"
    names = F.concat(F.regexp_extract_all(code, F.lit(declared), F.lit(2)), F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*) = new ([A-Za-z_]\w*)"), F.lit(1)))
    kinds = F.concat(F.regexp_extract_all(code, F.lit(declared), F.lit(1)), F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*) = new ([A-Za-z_]\w*)"), F.lit(2)))

    def one(v: Column) -> Column:
        kind = F.get(kinds, (F.array_position(names, v) - 1).cast("int"))
        return F.when(F.array_contains(names, v), F.concat(kind, F.lit(" :: ~"), kind)).otherwise(F.concat(F.lit("delete "), v))

    gone = F.transform(F.regexp_extract_all(code, F.lit(r"\bdelete (?:\[ \] )?([A-Za-z_]\w*)"), F.lit(1)), one)
    return F.concat(made, gone)


# Tokens that are no symbols.
MARKS = ["*", "+", "-", "->", "(", ")", "[", "]", "&", ".", "::", ";", ","]


def _symbols(tokens: Column) -> Column:
    bare = F.transform(tokens, lambda t: trimmed(F.regexp_replace(t, "[*&]", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def defined_in_text(code: Column) -> Column:
    """What a statement that no parser reads defines: the tokens before the first `` = ``, of an element of an array those before the first bracket. The
    first ``a -> b`` is one symbol, and beside an element ``a`` is one too."""
    left = trimmed(F.get(F.split(code, " = "), F.lit(0)))
    is_element = F.endswith(left, F.lit("]"))
    tokens = F.when(is_element, F.split(trimmed(F.get(F.split(code, r" \[ "), F.lit(0))), " ")).otherwise(F.split(left, " "))

    def joined(t: Column) -> Column:
        at = F.array_position(t, "->").cast("int")
        member = F.array(F.concat_ws(" ", F.get(t, at - 2), F.lit("->"), F.get(t, at)))
        whole = F.concat(F.slice(t, 1, F.greatest(at - 2, F.lit(0))), member, F.slice(t, at + 2, F.size(t)))
        whole = F.when(is_element, whole).otherwise(F.concat(whole, F.array(F.get(t, at - 2))))
        return F.when((at > 1) & (at < F.size(t)), whole).otherwise(t)

    found = F.get(F.transform(F.array(tokens), joined), F.lit(0))
    return F.when(F.contains(code, F.lit(" = ")), _symbols(found)).otherwise(F.array().cast("array<string>"))


def used_in_text(code: Column) -> Column:
    """What such a statement uses: the tokens behind the first `` = ``, up to the next, or all of them, without marks."""
    right = F.when(F.contains(code, F.lit(" = ")), trimmed(F.get(F.split(code, " = "), F.lit(1)))).otherwise(code)
    return _symbols(F.filter(F.split(right, " "), lambda t: ~t.isin(MARKS)))


def focus_index(tokens: Column, focus: Column, expression: bool = False) -> Column:
    """The place from 1 of the token a slice is about, the middle one for expressions and where it doesn't occur."""
    middle = (F.size(tokens) / 2).cast("int") + 1
    if expression:
        return middle
    at = F.array_position(tokens, focus)
    return F.when(at > 0, at).otherwise(middle)


def good_or_bad(names: Column) -> Column:
    """The functions of a test case whose name holds ``good`` or ``bad``; ``main`` if none does."""
    found = F.filter(names, lambda x: F.lower(x).rlike("good|bad"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("main")))


def two_classes(label: Column) -> Column:
    """1 for any label above 0, else 0; null stays."""
    return (label > 0).cast("int")


def noisy(label: Column, key: Column, percent: int) -> Column:
    """Labels of which about so many in a hundred are turned round, always the same ones."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(100)) < percent, 1 - label).otherwise(label)


def property_value(value: Column, kind: str) -> Column:
    """A property given as text as one of the kinds a graph stores; what doesn't read as such is null."""
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    return value.try_cast({"integer": "bigint", "float": "double", "string": "string", "datetime": "timestamp", "decimal": "double"}[kind])


def within_box(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1])


def distance_km(lat: Column, lon: Column, to: tuple[float, float]) -> Column:
    """The distance on a sphere from a point given in degrees."""
    a, b = F.radians(lat), F.radians(F.lit(float(to[0])))
    half = F.pow(F.sin((a - b) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(F.lit(float(to[1])))) / 2), F.lit(2.0))
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def calendar_path(day: Column) -> Column:
    """A day's year, month and day as a path of three keys."""
    return F.concat_ws("/", F.year(day), F.lpad(F.month(day), 2, "0"), F.lpad(F.dayofmonth(day), 2, "0"))
