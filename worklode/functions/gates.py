"""The gate: which sentences are chrome, talk about work, or fragments."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklode.functions import rules
from worklode.functions.text import col, fields, fold, strip_chars, strip_left, trim

_QUOTES = "\"“”'`"


def _any(phrases) -> str:
    return "(?:" + "|".join(re.sub(r"([^0-9A-Za-z ])", r"\\\1", p) for p in phrases) + ")"


class Text(NamedTuple):
    """A text whose forms are columns already: in a chain of conditions each use of a form would make it again."""

    raw: Column
    low: Column
    trimmed: Column
    trimmed_low: Column


class Said(NamedTuple):
    """A trimmed text, and it without quotes in front."""

    s: Text
    t: Text


def held(df: DataFrame, x: str) -> tuple[DataFrame, Said]:
    """``df`` with the forms of ``x`` that the gates read."""
    n = [f"_{x}_{k}" for k in range(6)]
    df = df.withColumn(n[0], trim(x)).withColumn(n[1], fold(n[0])).withColumn(n[2], strip_left(n[0], _QUOTES))
    df = df.withColumns({n[3]: fold(n[2]), n[4]: trim(n[2])}).withColumn(n[5], fold(n[4]))
    c = [F.col(k) for k in n]
    return df, Said(Text(c[0], c[1], c[0], c[1]), Text(c[2], c[3], c[4], c[5]))


def raw(x) -> Column:
    return x.raw if isinstance(x, Text) else col(x)


def low(x) -> Column:
    return x.low if isinstance(x, Text) else fold(x)


def trimmed(x) -> Column:
    return x.trimmed if isinstance(x, Text) else trim(x)


def trimmed_low(x) -> Column:
    return x.trimmed_low if isinstance(x, Text) else fold(trim(x))


def _tree(phrases) -> str:
    """A pattern of any of the phrases, in which common beginnings are tried once and only where a first character fits."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for ch in p:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:  # a shorter phrase ends here
            return ""
        ways = [_any((ch,))[3:-1] + pattern(rest) for ch, rest in at.items()]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"(?=[{''.join(_any((ch,))[3:-1] for ch in tree)}]){pattern(tree)}"


def has_any(x, phrases) -> Column:
    """One scan of ``x`` for any of the phrases."""
    return col(x).rlike(_tree(phrases))


def contains_any(x, phrases) -> Column:
    """Has the folded text any of the phrases (G30)?"""
    return has_any(low(x), phrases)


def starts_any(x, prefixes) -> Column:
    return trimmed_low(x).rlike(r"\A" + _any(prefixes))


def _count(x, what: str) -> Column:
    return F.regexp_count(col(x), F.lit(what))


def planning(x) -> Column:
    return contains_any(x, rules.PLANNING)


def session_op(x) -> Column:
    return contains_any(x, rules.SESSION_OP)


def narrative_decision(x) -> Column:
    return contains_any(x, rules.NARRATIVE)


def agent_prompt(x) -> Column:
    folded = low(x)
    return contains_any(x, ("why don't you", "why do not you", "why dont you")) | folded.startswith("can you ") | folded.startswith("could you ")


def status_failed(x) -> Column:
    return contains_any(x, rules.STATUS_FAILED)


def failed_as_object(x) -> Column:
    return contains_any(x, rules.FAILED_OBJECT)


def _unlisted(x) -> Column:
    return F.regexp_replace(trimmed_low(x), r"\A- ", "")


def _recap(folded: Column) -> Column:
    return has_any(folded, rules.RECAP)


def inspect_status(x) -> Column:
    folded = _unlisted(x)
    clock = raw(x).rlike(r"(?<![0-9A-Za-z_])\d{1,2}:\d{2}(?![0-9A-Za-z_])")
    where = has_any(folded, ("recent window", "live store", "live export"))
    return (
        F.contains(folded, F.lit("recent_noise="))
        | F.contains(folded, F.lit("`recent_noise"))
        | folded.rlike(r"\Alive recent \d+ are(?![0-9A-Za-z_])")
        | folded.rlike(r"\Ainspect recent on(?![0-9A-Za-z_])")
        | (_recap(folded) & (clock | where))
        | (F.contains(folded, F.lit("remaining active failed")) & F.contains(folded, F.lit("recap")))
    )


def found_review_list(x) -> Column:
    rest = F.regexp_extract(low(x), r"(?s)\A.*?they found[^:]*:(.*)\z", 1)
    return F.contains(rest, F.lit(",")) & F.contains(rest, F.lit(" and "))


def found_hyphen_list(x) -> Column:
    folded = _unlisted(x)
    return folded.startswith("they-found") & F.contains(folded, F.lit(",")) & F.contains(folded, F.lit(" and "))


def still_no_object(x) -> Column:
    return contains_any(x, rules.NO_OBJECT)


def first_mash(x) -> Column:
    return F.contains(low(x), F.lit("go-first,"))


def meta_failed_talk(x) -> Column:
    return contains_any(x, rules.META_FAILED) | first_mash(x) | still_no_object(x) | inspect_status(x) | found_review_list(x) | found_hyphen_list(x)


def process_state(x) -> Column:
    return contains_any(x, rules.PROCESS_STATE) | trimmed_low(x).rlike(r" next\.?\z")


def constraint_fragment(x) -> Column:
    return starts_any(x, ("so ", "and ", "but "))


def remembered_prose(x) -> Column:
    return starts_any(x, ("remembered:", "remembered "))


def next_i(x) -> Column:
    return starts_any(x, ("next i ", "next i'", "next i'll"))


def yaml_chrome(x) -> Column:
    return _unlisted(x).rlike(r"\A" + _any(rules.YAML_CHROME))


def quoted_attribution(x) -> Column:
    folded = low(x)
    return F.contains(folded, F.lit("said")) & (F.contains(folded, F.lit("said:")) | raw(x).rlike('["“”]'))


def leading_file_fragment(x) -> Column:
    first = strip_chars(F.coalesce(F.get(fields(raw(x)), F.lit(0)), F.lit("")), "\"“”'`.,;:()[]")
    base = F.lower(F.regexp_extract(first, r"(?s)\A(.+)\.[A-Za-z]{1,4}\z", 1))
    at = F.char_length(F.regexp_extract(base, r"(?s)\A(.*)_test", 1))
    return ~first.rlike(r"[/\\]") & F.contains(base, F.lit("_test")) & (at <= 1)


def tree_dump(x) -> Column:
    return _unlisted(x).startswith("tree:")


def trailing_short_version(x) -> Column:
    s = trimmed(x)
    return s.rlike(r"(?:\A|[^0-9.])0\.\d+\.\z") & ~s.rlike(r"\d+\.\d+\.\d+\.\z")


def truncated(x) -> Column:
    s = trimmed(x)
    own = Text(s, x.trimmed_low, s, x.trimmed_low) if isinstance(x, Text) else s
    first = F.coalesce(F.get(fields(s), F.lit(0)), F.lit(""))
    return (
        s.rlike(r"(?:\(|`\.|do not|\|)\z")
        | F.contains(s, F.lit("path (`."))
        | F.contains(s, F.lit("…)"))
        | F.contains(s, F.lit("...)"))
        | F.contains(first, F.lit("`"))
        | ((_count(s, "`") % 2 == 1) & s.endswith("."))
        | (constraint_fragment(own) & s.rlike("[`|…]"))
        | leading_file_fragment(own)
        | tree_dump(own)
        | trailing_short_version(own)
        | (_count(s, r"\(") > _count(s, r"\)"))
    )


def fixture_talk(x) -> Column:
    return contains_any(x, ("fixture", "quoted the", "quoting the"))


def chrome_prefix(x) -> Column:
    return trimmed(x).rlike(r"\A" + _any(rules.CHROME_PREFIX))


def list_item(x) -> Column:
    """The rest of a list item's line, or null."""
    s = trimmed(x)
    return F.when(s.rlike(r"\A[-*] "), trim(F.substring(s, 3, 1 << 30))).when(s.rlike(r"\A\d+[.)]\s+"), trim(F.regexp_replace(s, r"\A\d+[.)]\s+", "")))


def list_chrome(x, short_no_path) -> Column:
    rest = list_item(x)
    return rest.isNotNull() & (F.contains(raw(x), F.lit("**")) | rest.rlike(r"\A[`>]") | short_no_path)


def example_drop(x) -> Column:
    t = trimmed(x)
    return F.contains(trimmed_low(x), F.lit("example drop:")) & starts_any(strip_left(F.coalesce(list_item(x), t), _QUOTES), ("example drop:",))


def product_copy(x) -> Column:
    return contains_any(x, rules.PRODUCT_COPY)


def skill_talk(x) -> Column:
    return contains_any(x, rules.SKILL_TALK)


def skip_prose(x) -> Column:
    """The master gate (G1)."""
    s, t = x if isinstance(x, Said) else (trim(x), strip_left(trim(x), _QUOTES))
    text = raw(t)
    bold = _count(text, r"\*\*")
    heading = text.startswith("**") & ((text.endswith("**") & ~F.contains(text, F.lit("."))) | (bold % 2 == 1))
    return (
        (raw(s) == "")
        | example_drop(s)
        | (text == "")
        | chrome_prefix(t)
        | F.contains(text, F.lit(" | "))
        | heading
        | starts_any(t, ("**what was wrong", "**what you do next"))
        | reduce(lambda a, g: a | g(t), (fixture_talk, next_i, meta_failed_talk, session_op, agent_prompt, planning, narrative_decision, status_failed, failed_as_object, quoted_attribution, remembered_prose, yaml_chrome, truncated, skill_talk, product_copy), F.lit(False))
    )


ALL = {f.__name__: f for f in (planning, session_op, narrative_decision, agent_prompt, status_failed, failed_as_object, meta_failed_talk, process_state, constraint_fragment, remembered_prose, next_i, yaml_chrome, quoted_attribution, truncated, leading_file_fragment, tree_dump, trailing_short_version, still_no_object, first_mash, inspect_status, found_review_list, found_hyphen_list, fixture_talk, chrome_prefix, example_drop, product_copy, skill_talk, skip_prose)}
