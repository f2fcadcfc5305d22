"""Tokenising, folding, identifiers, clipping: string functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklode.functions import rules


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def trim(x) -> Column:
    """Without white space at either end (all of Unicode's, as the tape writers mean it)."""
    return F.regexp_replace(col(x), r"\A[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z", "")


def fields(x) -> Column:
    """The parts between white space."""
    return F.filter(F.split(col(x), r"[\s\x85\p{Z}]+"), lambda w: w != "")


def strip_chars(x, chars: str) -> Column:
    """``x`` without any of ``chars`` at either end."""
    c = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(col(x), f"\\A[{c}]+|[{c}]+\\z", "")


def strip_left(x, chars: str) -> Column:
    c = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(col(x), f"\\A[{c}]+", "")


def tokens(x) -> Column:
    """Lower-cased runs of letters and numbers, longer than one character."""
    found = F.regexp_extract_all(col(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: F.char_length(t) > 1)


def index_terms(x) -> Column:
    """Terms of the full-text index: as tokens, with one-character ones, without accents."""
    return F.transform(F.regexp_extract_all(strip_accents(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(x) -> Column:
    return F.regexp_replace(F.translate(col(x), _ACCENTED, _PLAIN), r"\p{M}+", "")


def normalise(x) -> Column:
    """Letters and numbers, lower-cased, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]+", " "))


def fold(x) -> Column:
    """Lower case, curly apostrophes straightened."""
    return F.translate(F.lower(col(x)), "’‘", "''")


def fold_ident(x) -> Column:
    """X4."""
    return F.lower(F.translate(col(x), "_-", ""))


def expand_ident(x) -> Column:
    """The identifier, its folded form, and the one package alias."""
    s = trim(x)
    low, folded = F.lower(s), fold_ident(s)
    out = F.array(s, F.when((folded != "") & (folded != low), folded), F.when(low == "jsonwebtoken", "jwt").when(low == "jwt", "jsonwebtoken"))
    return F.when(s != "", F.filter(out, lambda v: v.isNotNull())).otherwise(strings(()))


def is_identifier(x) -> Column:
    """X6."""
    t = col(x)
    return t.rlike(r"\A[A-Za-z_][A-Za-z0-9_]{2,}\z") | (t.rlike("[/.]") & t.rlike(r"\.[A-Za-z][A-Za-z0-9]*\z"))


def is_lower_identifier(x) -> Column:
    """X7."""
    return col(x).rlike(r"\A[_\p{L}][_\p{L}\p{N}]*\z") & (F.octet_length(col(x)) >= 3)


def uniq(x) -> Column:
    """First-seen, non-empty."""
    return F.array_distinct(F.filter(col(x), lambda v: v.isNotNull() & (v != "")))


def base_name(x) -> Column:
    """P2."""
    return F.element_at(F.split(F.translate(col(x), "\\", "/"), "/"), -1)


def stem(x) -> Column:
    """The base name without its extension; a leading dot is none."""
    return F.regexp_replace(base_name(x), r"(?s)\A(.+)\.[^.]*\z", "$1")


def symbols(text, paths) -> Column:
    """Identifiers of a text with their aliases, then base names and stems of its paths."""
    found = F.regexp_extract_all(col(text), F.lit(f"({rules.IDENTIFIER})"), F.lit(1))
    named = F.flatten(F.transform(col(paths), lambda p: F.array(base_name(p), stem(p))))
    return uniq(F.transform(F.concat(F.flatten(F.transform(found, expand_ident)), named), F.trim))


def _valid(b) -> Column:
    """Bytes as a string; a character cut in two becomes a replacement sign."""
    return F.make_valid_utf8(b.cast("string"))


def clip(x, at: int = 2000, head: int = 400, tail: int = 400) -> Column:
    """Over ``at`` bytes: the first and last bytes around an ellipsis."""
    b = F.encode(col(x), "utf-8")
    cut = F.concat(_valid(F.substring(b, 1, head)), F.lit("\n…\n"), _valid(F.substring(b, -tail, tail)))
    return F.when(F.octet_length(col(x)) <= at, col(x)).otherwise(cut)


def clip_display(x, n: int = 120) -> Column:
    """One line of at most ``n`` bytes, with an ellipsis where cut."""
    s = F.trim(F.regexp_replace(col(x), "\n", " "))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(_valid(F.substring(F.encode(s, "utf-8"), 1, n)), F.lit("…")))


def byte_size(x) -> Column:
    """Human size."""
    n = col(x).cast("long")

    def shown(unit: int, name: str) -> Column:
        tenths, rest = F.floor(n * 10 / unit).cast("long"), (n * 10) % unit
        tenths = tenths + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1)), 1).otherwise(0)  # a tie goes to the even digit
        return F.format_string(f"%d.%d {name}", F.floor(tenths / 10).cast("long"), tenths % 10)

    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, shown(1024, "KB")).otherwise(shown(1024 * 1024, "MB"))


def sanitise(x) -> Column:
    """An id as a file name."""
    return F.regexp_replace(col(x), r"[^A-Za-z0-9._-]", "_")


def is_safe_id(x) -> Column:
    """X18."""
    return col(x).rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~F.contains(col(x), F.lit(".."))


def estimate_tokens(x) -> Column:
    """A quarter of the bytes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(col(x)) + 3) / 4)).cast("int")


def jaccard(a, b) -> Column:
    """Shared over united distinct non-empty values; 0 if either side is empty (U4)."""
    x, y = uniq(a), uniq(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def same_set(a, b) -> Column:
    """Equal sets; never for empty ones."""
    return (F.size(col(a)) > 0) & (F.array_sort(F.array_distinct(col(a))) == F.array_sort(F.array_distinct(col(b))))
