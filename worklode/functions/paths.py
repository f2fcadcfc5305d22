"""File paths, secrets and project keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklode.functions import rules
from worklode.functions.text import base_name, col, strings, trim, uniq


def slashes(x) -> Column:
    return F.translate(col(x), "\\", "/")


def find_paths(x) -> Column:
    """Paths with a directory and an extension (P5)."""
    return F.when(~_slashed(x), strings(())).otherwise(F.regexp_extract_all(slashes(x), F.lit(f"({rules.PATH})"), F.lit(1)))


def strip_paths(x) -> Column:
    return F.when(~_slashed(x), col(x)).otherwise(F.regexp_replace(slashes(x), rules.PATH, " "))


def _slashed(x) -> Column:
    return F.contains(col(x), F.lit("/")) | F.contains(col(x), F.lit("\\"))


def path_keys(x) -> Column:
    """Each path and its base name, first seen."""
    return uniq(F.flatten(F.transform(col(x), lambda p: F.array(p, base_name(p)))))


def cluster(x) -> Column:
    """Lower-cased base names."""
    return uniq(F.transform(col(x), lambda p: F.lower(base_name(p))))


def primary_dir(x) -> Column:
    """Directory of the first path; the path itself without one."""
    first = F.get(col(x), F.lit(0))
    return F.coalesce(F.when(first.rlike(r"\A.+/"), F.regexp_extract(first, r"(?s)\A(.+)/[^/]*\z", 1)).otherwise(first), F.lit(""))


def normal_path(x) -> Column:
    p = F.regexp_replace(F.regexp_replace(slashes(trim(x)), r"\A(?:\./)+", ""), r"/\z", "")
    return F.when(p.isin(".", ".."), "").otherwise(p)


def is_traversal(x) -> Column:
    """Absolute, home, drive, escaped or upward paths."""
    n = slashes(trim(x))
    low = F.lower(n)
    first = F.get(F.split(low, "/"), F.lit(0))
    return (n == "") | n.rlike(r"\x00") | low.rlike("%2e|%2f|%00") | n.rlike(r"\A[/~]") | n.rlike(r"\A[\x00-\x7f]:") | first.isin(*rules.ABSOLUTE_ROOTS) | F.array_contains(F.split(n, "/"), "..")


def is_remote(x) -> Column:
    """URLs, repositories, hosts (P10)."""
    n = F.lower(slashes(trim(x)))
    host = F.get(F.split(n, "/"), F.lit(0))
    return F.contains(n, F.lit("://")) | n.endswith(".git") | ((host != "") & ~host.startswith(".") & F.contains(host, F.lit(".")))


def in_git_dir(x) -> Column:
    return F.array_contains(F.split(slashes(trim(x)), "/"), ".git")


def in_dependency_dir(x) -> Column:
    """P11."""
    return F.arrays_overlap(F.split(slashes(trim(x)), "/"), strings(rules.DEPENDENCY_DIRS))


def is_sensitive(x) -> Column:
    return col(x).rlike(rules.SENSITIVE_PATH)


def filter_paths(x) -> Column:
    """Relative, local, own source paths only."""
    bad = lambda p: (p == "") | is_traversal(p) | is_remote(p) | in_git_dir(p) | in_dependency_dir(p) | is_sensitive(p)
    return F.filter(F.transform(col(x), normal_path), lambda p: ~bad(p))


def has_secret(x) -> Column:
    """P12."""
    return col(x).rlike("|".join(rules.SECRETS[:-1])) | col(x).rlike(rules.SECRETS[-1])


def redact_line(x) -> Column:
    """A line for the tape: secrets become a marker; lines end in a line break, blank ones stay."""
    line = col(x)
    return F.when(trim(line) == "", line).when(has_secret(line), F.lit('{"_redacted":true}\n')).when(line.endswith("\n"), line).otherwise(F.concat(line, F.lit("\n")))


def drop_claim(text, paths) -> Column:
    """P14."""
    t = col(text)
    return has_secret(t) | (F.exists(col(paths), is_sensitive) & (F.contains(t, F.lit("=")) | F.contains(F.upper(t), F.lit("SECRET"))))


def from_origin(x) -> Column:
    """owner/repo of a remote, or an empty string."""
    raw = F.regexp_replace(trim(x), r"\Agit\+", "")
    owner, repo = F.lower(F.regexp_extract(raw, rules.ORIGIN, 1)), F.lower(F.regexp_extract(raw, rules.ORIGIN, 2))
    return F.when(raw.rlike(rules.ORIGIN), F.concat_ws("/", owner, F.regexp_replace(repo, r"\.git\z", ""))).otherwise(F.lit(""))


def project_key(x) -> Column:
    """One key for the spellings of a project."""
    s = F.regexp_replace(F.lower(trim(x)), r"\.git\z", "")
    parts = F.filter(F.split(s, "/"), lambda p: p != "")
    origin = from_origin(s)
    last_two = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    plain = F.when(F.contains(s, F.lit("__")), F.regexp_replace(s, r"(?s)\A(.*?)__", "$1/")).otherwise(s)
    return F.when(F.contains(s, F.lit("/")), F.when(origin != "", origin).when(F.size(parts) >= 2, last_two).otherwise(plain)).otherwise(plain)


def encode_key(x) -> Column:
    """A key as a directory name."""
    s = F.regexp_replace(F.replace(project_key(x), F.lit("/"), F.lit("__")), r"\A[. ]+|[. ]+\z", "")
    return F.when((s == "") | F.contains(s, F.lit("..")), "unknown").otherwise(s)


def decode_key(x) -> Column:
    s = trim(x)
    return F.when(s == "", "").otherwise(project_key(F.regexp_replace(s, r"(?s)\A(.*?)__", "$1/")))


def path_project(x) -> Column:
    """Key of a workspace without a remote."""
    return F.concat(F.lit("path-"), F.substring(F.sha2(col(x), 256), 1, 16))
