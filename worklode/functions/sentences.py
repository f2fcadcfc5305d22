"""Sentences and their claim type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklode.functions import gates, rules
from worklode.functions.paths import filter_paths, find_paths, strip_paths
from worklode.functions.text import col, fields, fold, strip_chars, strip_left, strings, trim


def split_sentences(x) -> Column:
    """One split at sentence ends, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(col(x), rules.SENTENCE_END), trim), lambda s: s != "")


def skip_sentence(x) -> Column:
    t = x.t if isinstance(x, gates.Said) else strip_left(trim(x), "\"“”'`")
    return gates.skip_prose(x) | gates.list_chrome(t, F.size(find_paths(gates.raw(t))) == 0)


def strip_failed_noise(x) -> Column:
    """C9."""
    s = F.regexp_replace(col(x), "`[^`]*`", " ")
    # the first characters of the phrases, looked at before the phrases are
    return F.regexp_replace(F.regexp_replace(s, "(?=[FfSsTtPpCcAa])" + rules.TYPE_TALK, " "), rules.EXCEPTION_TO, " ")


def failed_only_in_ticks(x) -> Column:
    """The failure words stand only inside back-ticks."""
    return col(x).rlike(rules.HARD_FAILED) & ~F.regexp_replace(col(x), "`[^`]*`", " ").rlike(rules.HARD_FAILED)


def is_question(x) -> Column:
    """C7."""
    s = x if isinstance(x, gates.Text) else trim(x)
    return gates.raw(s).endswith("?") | gates.contains_any(s, ("why don't you", "why dont you")) | gates.low(s).rlike(rules.QUESTION)


#: What no match of the pattern is without.
_HARD = ("reject", "work", "compil", "failed", "failure", "pass", "threw", "dead end")
_SOFT = ("revert", "abort")
_CONSTRAINT = ("always", "never", "don't", "do not", "must", "we use")
_HEDGE = ("think", "not sure", "maybe", "probably", "might", "we")
_STATE = ("working on", "current plan", "next step", "now implementing")
_DECISION = ("decided", "going with", "we'll use", "we will use", "picked ", "chose", "instead of", "prefer ", "stick with")


def _said(x, pattern: str, parts) -> Column:
    """The pattern in folded text, searched only where one of its parts stands."""
    return gates.has_any(x, parts) & col(x).rlike(pattern)


def is_decision(folded) -> Column:
    """C6."""
    first = F.lower(F.regexp_extract(col(folded), rules.USE_NOT, 1))
    used = F.contains(col(folded), F.lit("use")) & F.contains(col(folded), F.lit("not"))
    return _said(folded, rules.DECISION, _DECISION) | (used & (first != "") & ~first.isin(*rules.USE_NOT_STOP))


_EDGE = ".,;:()[]\"'"


def grounded_failed(x, paths) -> Column:
    """Has a path, a tick or bold mark, a capitalised name, or says what failed."""
    s = gates.raw(x)
    words = F.transform(fields(s), lambda w: strip_chars(w, _EDGE))
    fail = lambda w: F.lower(w).isin(*rules.FAIL_WORDS)
    follows = lambda i: F.lower(F.coalesce(F.get(words, i + 1), F.lit(""))).isin("to", "during", "again", "on")
    capital = lambda w: w.rlike(r"\A[A-Z]")

    def grounded(w, i):
        starter = (i == 0) & w.isin(*rules.SENTENCE_STARTERS)
        name = capital(w) & (((F.octet_length(w) >= 3) & w.rlike("[a-z]")) | F.contains(w, F.lit("-")))
        return F.when(w == "", False).when(fail(w), follows(i)).when(starter, False).otherwise(name)

    named = F.exists(F.transform(words, grounded), lambda b: b)
    own = F.size(filter_paths(find_paths(s))) > 0
    return (F.size(col(paths)) > 0) | own | (~gates.status_failed(x) & ~gates.failed_as_object(x) & (s.rlike(r"`|\*\*") | named))


def probe(folded) -> Column:
    """Folded text without paths and talk about types."""
    return strip_failed_noise(strip_paths(folded))


def classify(x, error, role, probed=None) -> Column:
    """C4: failed, decision, constraint, state, or null; the first that holds. ``probed``: ``probe`` of the folded text, where it is a column."""
    s = x if isinstance(x, gates.Text) else col(x)
    folded = gates.low(s)
    bare = probe(folded) if probed is None else col(probed)
    meta, decision, planning = gates.meta_failed_talk(s), is_decision(folded), gates.planning(s)
    soft = _said(bare, rules.SOFT_FAILED, _SOFT) & ~meta
    constraint = (col(role) == "user") & _said(folded, rules.CONSTRAINT, _CONSTRAINT) & ~_said(folded, rules.HEDGE, _HEDGE) & ~gates.session_op(s) & ~gates.agent_prompt(s) & ~gates.constraint_fragment(s)
    return (
        F.when(is_question(s), F.lit(None).cast("string"))
        .when(_said(bare, rules.HARD_FAILED, _HARD) & ~meta, "failed")
        .when(decision & ~planning & ~gates.narrative_decision(s), "decision")
        .when((col(error) | soft) & ~(decision & ~planning), "failed")
        .when(constraint, "constraint")
        .when(_said(folded, rules.STATE, _STATE), "state")
    )


def no_paths() -> Column:
    return strings(())
