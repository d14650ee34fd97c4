"""Text, regex and HTML functions. Missing text is the empty string throughout, as in delimited files."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def _constant(value: object, kind: str) -> Column:
    """A value as a literal of a nested type: Spark works it out when it plans."""
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x: {kind}>")["x"]


#: An entity behind its "&": a number, or up to 32 characters of a name.
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Entities by their first two characters, so that a look-up reads few of them; and those that need no semicolon.
_OPEN = {name: sign for name, sign in html5.items() if not name.endswith(";")}
_LOW = 160


def _by_start() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for name, sign in html5.items():
        out.setdefault(name[:2], {})[name] = sign
    return out


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number reference, as browsers read it: old code pages, no surrogates, no non-characters."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(bare) <= 8, F.conv(bare, base, 10).cast("long")).otherwise(1 << 32)

    def sign(n: Column) -> Column:
        other = F.when(n == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))  # a decoder skips that one
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE) | (n == 0xB)
        low = _constant([html.unescape(f"&#{k};") for k in range(_LOW)], "array<string>")
        return F.when(n < _LOW, F.get(low, n.cast("int"))).when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(none, F.lit("")).otherwise(other)

    return _let(number, sign)


def _named(name: Column, closed: bool = False) -> Column:
    """The characters of a name, else, unless closed, of its longest beginning that needs no semicolon and what follows it,
    else "&" and the name."""
    known, open_ = _constant(_by_start(), "map<string, map<string, string>>"), _constant(_OPEN, "map<string, string>")
    whole = F.try_element_at(F.try_element_at(known, F.substring(name, 1, 2)), name)
    begun = lambda k: F.when(F.length(name) > k, F.concat(F.try_element_at(open_, F.substring(name, 1, k)), F.substring(name, F.lit(k + 1), F.length(name))))
    starts = [] if closed else [begun(k) for k in range(max(map(len, _OPEN)), 1, -1)]
    return F.coalesce(whole, *starts, F.concat(F.lit("&"), name))


def unescaped(text: Column, closed: bool = False) -> Column:
    """Text with HTML entities decoded, those without a semicolon too where that is allowed; null stays null.
    closed: only those with a semicolon.

    The text is split at "&", and an entity is what stands in front of a part."""

    def part(x: Column) -> Column:
        def decoded(found: Column) -> Column:
            rest = F.substring(x, F.length(found) + 1, F.length(x))
            hexed = F.substring(found, 1, 2).isin("#x", "#X")
            digits = F.regexp_replace(found, "^#[xX]?|;$", "")
            sign = F.when(found == "", F.lit("&")).when(hexed, _numbered(digits, 16)).when(found.startswith("#"), _numbered(digits, 10)).otherwise(_named(found, closed))
            return F.concat(sign, rest)

        return _let(F.regexp_extract(x, _ENTITY.replace(";?", ";") if closed else _ENTITY, 1), decoded)

    parts = F.split(text, "&")
    whole = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _regex(literal: str) -> str:
    """The literal as a regular expression."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def clean_text(text: Column, entities: bool = True, closed: bool = False) -> Column:
    """Text without scripts, styles and tags; entities decoded (closed: only those with a semicolon), white space collapsed.
    Null is empty."""
    bare = F.coalesce(text, F.lit(""))
    for element in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)<{element}\b.*?</{element}>", " ")
    bare = F.regexp_replace(bare, "<[^>]+>", " ")
    if entities:
        bare = unescaped(bare, closed)
    return F.btrim(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f\x85 ]+", " "))


def clean_text_as_sql(text: Column, entities: Mapping[str, str]) -> Column:
    """clean_text as engines with RE2 work it out: only the given entities are decoded, "&amp;" last, of white space only
    that of ASCII and x1c to x1f, x85 and xa0 collapses, spaces of any kind are trimmed. Null stays null."""
    bare = text
    for element in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?isu)<{element}(?-iu:(?![0-9A-Za-z_])).*?</{element}>", " ")
    bare = F.regexp_replace(bare, "<[^>]+>", " ")
    for name in sorted(entities, key=lambda name: name == "&amp;"):
        bare = F.replace(bare, F.lit(name), F.lit(entities[name]))
    bare = F.regexp_replace(bare, r"[\t\n\f\r \x1c-\x1f\x85\xa0]+", " ")
    return F.regexp_replace(bare, r"^\p{Zs}+|\p{Zs}+\z", "")


def labelled_value(page: Column, label: str) -> Column:
    """The cleaned table cell behind the header cell `label`; empty if there is none."""
    return clean_text(F.regexp_extract(page, rf"(?is)<th>\s*{_regex(label)}\s*</th>\s*<td[^>]*>(.*?)</td>", 1))


def labelled_link_id(page: Column, label: str, prefix: str, reach: int = 1500) -> Column:
    """The path segment behind `prefix` within `reach` characters of the header cell `label`; empty if there is none."""
    at = F.regexp_instr(page, F.lit(rf"(?i)<th>\s*{_regex(label)}\s*</th>"))
    near = F.when(at > 0, F.substring(page, at, F.lit(reach))).otherwise("")
    return F.btrim(F.regexp_extract(near, rf'{_regex(prefix)}/([^"/]+)', 1))


def section(page: Column, start: str, inner: str, end: str, fallback: str) -> Column:
    """The page from `inner`, behind `start`, up to `end`, else up to the next `fallback`, else to the end of the page.

    Empty if start or inner is missing.
    """
    a = F.locate(start, page)
    b = F.when(a > 0, F.call_function("locate", F.lit(inner), page, a))
    c = F.call_function("locate", F.lit(end), page, b)
    d = F.call_function("locate", F.lit(fallback), page, b + 1)
    stop = F.when(c > 0, c).when(d > 0, d).otherwise(F.length(page) + 1)
    return F.when(b > 0, F.substring(page, b, stop - b)).otherwise("")


#: Cells of one measurement in a section, in order (a format's fixed pattern): type with an optional anchor id, value,
#: units, subject, condition.
RECORD = (
    r'(?is)<td class="pad-20">(.*?)(?:<a href="#([^"]+)".*?)?</td>.*?'
    r'<td class="h-center">\s*<div>\s*(.*?)\s*</div>\s*</td>.*?'
    r'<td class="h-center">\s*<div>\s*(.*?)\s*</div>\s*</td>.*?'
    r'<td class="pad-20">\s*<div>\s*(.*?)\s*</div>\s*</td>.*?'
    r'<td class="pad-20">\s*<div>\s*(.*?)\s*</div>\s*</td>'
)
RECORD_FIELDS = ("standard_type", "activity_id", "value_raw", "units", "cell_line", "disease_model")


#: Stand between the fields and around the records of a rewritten block; in a text they become U+FFFD.
_FIELD, _RECORD = "\ufdd0", "\ufdd1"


def record_table(block: Column, pattern: str = RECORD, fields: Sequence[str] = RECORD_FIELDS) -> Column:
    """All matches of a pattern, in order: an array of structs with its groups as fields, blank where one took no part.

    The pattern runs once: it rewrites each match into its groups, and the block is split at what stands between them.
    """
    bare = F.translate(block, _FIELD + _RECORD, "\ufffd\ufffd")
    groups = _FIELD.join(f"${k}" for k in range(1, len(fields) + 1))
    parts = F.split(F.regexp_replace(bare, pattern, _RECORD + groups + _RECORD), _RECORD)
    found = F.filter(parts, lambda _, k: k % 2 == 1)
    cut = lambda x: _let(F.split(x, _FIELD), lambda own: F.struct(*[own[k].alias(name) for k, name in enumerate(fields)]))
    return F.transform(found, cut)


def records(block: Column, pattern: str = RECORD) -> Column:
    """All matches of a pattern, in order: an array to explode. Groups are then taken from each by record_field."""
    return F.regexp_extract_all(block, F.lit(pattern), 0)


def record_field(match: Column, group: int, pattern: str = RECORD) -> Column:
    return F.regexp_extract(match, pattern, group)


def relation_of(raw: Column) -> Column:
    """The relation at the front of a measured value; "=" if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.btrim(raw), "^(>=|<=|>|<|=)?", 1), F.lit("")), F.lit("="))


def value_of(raw: Column) -> Column:
    """What stands behind the relation."""
    return F.btrim(F.regexp_extract(F.btrim(raw), "(?s)^(?:>=|<=|>|<|=)?(.*)$", 1))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def first_number(text: Column) -> Column:
    """The first decimal number in a text; null without one. A number begins with a digit: ".5" gives 5."""
    return _finite(F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0).try_cast("double"))


def strict_number(text: Column) -> Column:
    """The whole text as a finite number, else null."""
    return _finite(F.btrim(text).try_cast("double"))


#: Endpoints of potency.
POTENCY = ("ic50", "lc50", "ec50", "gi50")


def contains_any(text: Column, parts: Sequence[str] = POTENCY) -> Column:
    """Does the text hold one of the parts, apart from case and spaces?"""
    bare = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))
    return bare.rlike("|".join(_regex(p) for p in parts))


#: Units of amount by volume, with both code points of the micro sign.
MOLAR = ("pm", "nm", "um", "µm", "μm")


def is_molar(units: Column) -> Column:
    return F.lower(F.btrim(units)).isin(*MOLAR)


def first_filled(*columns: Column, otherwise: str = "<missing payload>") -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(otherwise))


@dataclass(frozen=True)
class Rule:
    """A class is hit by any pattern; by a term only if no excluding term occurs."""

    patterns: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


#: Which words name which mechanism.
MECHANISMS: Mapping[str, Rule] = {
    "Topo-I inhibitor": Rule(patterns=(r"\btop(?:o|\s)?(?:isomerase)?\s*[- ]?i\b", r"\btopoisomerase\s*1\b|\btop1\b")),
    "microtubule-disrupting": Rule(
        terms=(
            "microtubule", "tubulin", "auristatin", "monomethyl auristatin", "maytansinoid", "mertansine", "ansamitocin", "emtansine",
            "mmae", "mmaf", "dm1", "dm3", "dm4", "tubulysin", "dolastatin", "cryptophycin",
        )
    ),
    "DNA-damaging": Rule(
        terms=(
            "dna", "calicheamicin", "duocarmycin", "duostatin", "pbd", "pyrrolobenzodiazepine", "tesirine", "indolinobenzodiazepine",
            "alkylator", "alkylating", "topoisomerase ii", "top2", "doxorubicin", "pnu-159682", "sg3199",
        ),
        unless=("topoisomerase 1", "topoisomerase i", "top1"),
    ),
}
MAJOR = ("DNA-damaging", "Topo-I inhibitor", "microtubule-disrupting")
#: Spellings put right before rules are tried.
SPELLINGS = {"topo-isomerase": "topoisomerase"}


def class_by_rules(*texts: Column, rules: Mapping[str, Rule] = MECHANISMS, spellings: Mapping[str, str] = SPELLINGS, otherwise: str = "Other") -> Column:
    """The class whose rule alone is hit by the texts; `otherwise` if none or several are."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    for old, new in spellings.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    any_of = lambda parts: text.rlike("|".join(parts)) if parts else F.lit(False)
    hit = {name: any_of(r.patterns) | (any_of([_regex(t) for t in r.terms]) & ~any_of([_regex(t) for t in r.unless])) for name, r in rules.items()}
    n = sum((h.cast("int") for h in hit.values()), F.lit(0))
    named = F.coalesce(*[F.when(h, F.lit(name)) for name, h in hit.items()])
    return F.when(n == 1, named).otherwise(otherwise)


def joined_values(column: Column, separator: str = ";") -> Column:
    """An aggregate: the distinct values that are neither null nor empty, in code-point order."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(column, F.lit("")))), separator)


def split_values(column: Column, separator: str = ";") -> Column:
    """The parts of a delimited text; none of an empty one."""
    return F.filter(F.split(column, _regex(separator)), lambda x: x != "")


def letters_index(letters: Column) -> Column:
    """Spreadsheet column letters as a number from 0; other characters are skipped."""
    digits = F.filter(F.split(F.upper(letters), ""), lambda c: c.rlike("^[A-Z]$"))
    return (F.aggregate(digits, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1).cast("int")


def display_key(*columns: Column) -> Column:
    """A key for people to read; group by the columns themselves."""
    return F.concat_ws(" || ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
