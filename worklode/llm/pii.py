"""Personal data: exact base patterns, and a semi-Markov conditional random field for the rest.

Base patterns (email, ip, card, phone) are searched over the whole text in time
linear in its length. The model looks at stretches of atoms (alphanumeric runs
and single signs) around digits, ``@`` and values assigned to a word for a
secret; whole-span features score every candidate segment of at most
``MAX_ATOMS`` atoms, and dynamic programming picks boundaries and types jointly.
Its weights are trained by the conditional likelihood of generated sentences
(seeded generator, forward-backward gradients). Base spans always stay; a model
span is added where it overlaps none of them. It knows the four base kinds and
``secret``: hex, base64 and prefixed keys, signed tokens, passwords.

Defined results: null and empty texts have no spans; spans are code points, end
exclusive; rows are judged one by one, so repeated rows and null ids agree; an
empty table gives no rows; a very long text is read in stretches around its
triggers; texts without a trigger cost one search; other columns are kept by
``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, text_slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
MAX_ATOMS = 16
#: A digit run that begins inside a run cannot match where the whole run did not, so runs are tried from their start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT, _TRIGGER = re.compile(r"[0-9@]"), re.compile(r"[0-9@=:]")
#: What stands before the sign that assigns a secret.
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|key)[\"']?\s?$")
_ATOM = re.compile(r"[^\W_]+|[^\s\w]|_")
#: Atoms before and after a trigger that the model sees; characters that end its stretch.
_AROUND = 4
_SIDE = 160


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        # an @ ends any run of local characters, so the next search needs nothing before it
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's spans, by start, then kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- the semi-Markov model ---------------------------------------------------

_CUES = {"token", "key", "secret", "password", "passwd", "pwd", "bearer", "api", "auth", "phone", "tel", "call", "fax", "mail", "email", "e-mail", "card", "visa", "ip", "host", "addr", "address"}


@lru_cache(maxsize=1 << 16)
def _shape(span: str, cue: str, before: str = "", after: str = "") -> tuple[str, ...]:
    """Features of a whole candidate span and the signs at its sides, told apart by kind when scored."""
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    signs = "".join(sorted({c for c in span if not c.isalnum()}))
    f = [f"signs={signs[:6]}", f"digits={min(digits, 20)}", f"cue={cue}", f"first={'d' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}", f"last={'d' if span[-1].isdigit() else 'a' if span[-1].isalpha() else 'x'}"]
    if "@" in span:
        local, _, host = span.partition("@")
        f.append(f"at={bool(local)},{min(host.count('.'), 2)},{' ' in span}")
    if span.count(".") == 3 and digits and not letters and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in span.split(".")):
        f.append("quad")
    if 12 <= digits <= 19 and not letters:
        f.append(f"luhn={luhn(''.join(c for c in span if '0' <= c <= '9'))}")
    if span[0] == "+" and not letters:
        f.append(f"plus={9 <= digits <= 15}")
    if span.isalnum() and len(span) >= 16 and digits and letters:
        f.append(f"mixed={min(len(span) // 8, 5)},{all(c in '0123456789abcdefABCDEF' for c in span)}")
    solid = " " not in span and "@" not in span
    cases = any(c.islower() for c in span) + any(c.isupper() for c in span)
    if solid and letters and len(span) >= 16:
        f.append(f"key={min(len(span) // 8, 8)},{cases},{bool(digits)},{bool(signs.strip('+/=_-.'))}")
        f.append(f"sides={before},{after}")
    if solid and letters and 6 <= len(span) < 40:
        f.append(f"word={min(len(span) // 6, 3)},{cases},{bool(digits)},{cue in _ASSIGNED}")
    if m := _PREFIX.match(span):
        f.append(f"prefix={m[0]},{len(span) >= 20},{min(span.count('.'), 3)}")
    return tuple(f)


_ASSIGNED = {f"{w}=" for w in ("token", "key", "secret", "password", "passwd", "pwd")}
#: Signs inside keys: a span beside one may be a part.
_JOINS = frozenset("+/=_-.")
#: Beginnings of widely used key formats (fixed values).
_PREFIX = re.compile(r"AKIA|ghp_|sk-|eyJ|xox[bp]-|AIza")


def _hot(text: str, atoms: list[tuple[int, int]]) -> list[bool]:
    """Has an atom a digit or @, or is it the beginning of a value assigned to a word for a secret?"""
    out, named = [], False
    for a, b in atoms:
        c = text[a]
        out.append(named and c.isalpha() or bool(_DIGIT.search(text, a, b)))
        if c in "=:":
            named = bool(_NAMED.search(text, max(0, a - 12), a))
        elif c not in "\"'":
            named = False
    return out


def _candidates(text: str, atoms: list[tuple[int, int]]):
    """For each end: [(start, features)] of spans that may be an entity: with a hot atom, no line break, no wide gap."""
    n, out = len(atoms), []
    has = _hot(text, atoms)
    low = [text[a:b].lower() for a, b in atoms]
    for j in range(n):
        here, seen = [], False
        for i in range(j, max(-1, j - MAX_ATOMS), -1):
            seen = seen or has[i]
            if i < j and atoms[i + 1][0] - atoms[i][1] > 1:
                break
            if i < j and atoms[i + 1][0] > atoms[i][1] and text[atoms[i][1]] != " ":
                break
            if seen and not (text[atoms[j][0]] in ".,;:!?" and i < j):
                cue = next((w for w in reversed(low[max(0, i - 3) : i]) if w in _CUES), "") + ("=" if {"=", ":"} & set(low[max(0, i - 2) : i]) else "")
                a, b = atoms[i][0], atoms[j][1]
                here.append((i, _shape(text[a:b], cue, *(c if c in _JOINS else "" for c in (text[a - 1 : a], text[b : b + 1])))))
        out.append(here)
    return out


class SemiCrf:
    def __init__(self, weights: dict | None = None):
        self.w: dict[str, float] = weights or {}

    def score(self, kind: str, feats) -> float:
        get = self.w.get
        return get(kind, 0.0) + sum(get(f"{kind}|{f}", 0.0) for f in feats)

    def decode(self, text: str, atoms) -> list[tuple[int, int, str]]:
        """The best segmentation: entities as (start, end, kind)."""
        cand = _candidates(text, atoms)
        best, back = [0.0], [None]
        for j, here in enumerate(cand):
            top, arg = best[j], None  # one atom outside
            for i, feats in here:
                for kind in ALL_KINDS:
                    s = best[i] + self.score(kind, feats)
                    if s > top:
                        top, arg = s, (i, kind)
            best.append(top)
            back.append(arg)
        out, j = [], len(atoms)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((atoms[i][0], atoms[j - 1][1], kind))
                j = i
        return out[::-1]

    def gradient(self, text: str, gold: set[tuple[int, int, str]]):
        """Expected minus observed feature counts, by forward and backward sums over segmentations."""
        atoms = [m.span() for m in _ATOM.finditer(text)]
        cand = _candidates(text, atoms)
        n = len(atoms)
        segs = [[(i, feats, kind, self.score(kind, feats)) for i, feats in here for kind in ALL_KINDS] for here in cand]

        def add(a, b):
            if a == -math.inf:
                return b
            return max(a, b) + math.log1p(math.exp(-abs(a - b))) if b != -math.inf else a

        alpha = [0.0] + [-math.inf] * n
        for j in range(n):
            t = alpha[j]
            for i, _, _, s in segs[j]:
                t = add(t, alpha[i] + s)
            alpha[j + 1] = t
        beta = [-math.inf] * n + [0.0]
        for j in range(n - 1, -1, -1):
            beta[j] = add(beta[j], beta[j + 1])
            for i, _, _, s in segs[j]:
                beta[i] = add(beta[i], beta[j + 1] + s)
        g = defaultdict(float)
        for j in range(n):
            for i, feats, kind, s in segs[j]:
                p = math.exp(min(0.0, alpha[i] + s + beta[j + 1] - alpha[n]))
                p -= (atoms[i][0], atoms[j][1], kind) in gold
                if abs(p) > 1e-6:
                    g[kind] += p
                    for f in feats:
                        g[f"{kind}|{f}"] += p
        return g


def _sentences(seed: int, n: int):
    """Generated training sentences: fillers, entities of each kind and look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(1, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = r.choice("3456") + num(r.randint(10, 17))
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))))

    make = {
        "email": lambda: f"{word()}{r.choice(('', '.' + word(), num(2), '.' + num(2)))}@{word()}{r.choice(('', num(1)))}.{r.choice(('example.com', 'com', 'org', 'net', 'co.uk'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+1 ({num(3)}) 555-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{num(11)}", f"+{num(2)}-{num(3)}-{num(7)}")),
    }
    hexa, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    alnum = letters + letters.upper() + "0123456789"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    #: Secrets that show by themselves, and those that only an assignment shows.
    plain = (lambda: of(hexa, r.choice((32, 40, 64))), lambda: "AKIA" + of(letters.upper() + "234567", 16), lambda: "ghp_" + of(alnum, 36), lambda: "sk-" + of(alnum, r.choice((32, 48))), lambda: of(alnum + "+/", r.choice((40, 64))) + r.choice(("", "=", "==")), lambda: f"xoxb-{num(11)}-{of(alnum, 24)}", lambda: "AIza" + of(alnum + "_-", 35), lambda: f"eyJ{of(alnum, r.randint(15, 30))}.eyJ{of(alnum, r.randint(20, 60))}.{of(alnum + '_-', 43)}".rstrip("-_"))
    told = (lambda: of(hexa, 24), lambda: of(alnum, r.randint(10, 20)), lambda: of(letters, r.randint(9, 20)), lambda: word() + of("!#$%&*", 1) + word() + num(2), lambda: of(letters + letters.upper(), r.randint(12, 24)))
    make["secret"] = lambda: r.choice(plain)()
    fake = (lambda: num(r.randint(1, 8)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: word() + num(2), lambda: f"@{word()}", lambda: num(16) if r.random() < 0.2 else num(4) + " " + num(4), lambda: f"{num(3)}.{num(1)}%", lambda: ".".join(num(1) for _ in range(5)), lambda: f"{r.choice(('key', 'Token', 'secret', 'password'))}: {r.choice(('the', 'a', 'see', 'it', 'no', 'none', word()[:5]))}", lambda: f"{word()}: {word()}", lambda: f"{word()}-{word()}-{num(2)}", lambda: f"{word()}_{word()}{num(1)}", lambda: f"https://{word()}.org/{word()}/{num(3)}", lambda: of(letters, r.randint(16, 26)) + num(1))
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(3, 7)):
            x = r.random()
            if x < 0.5:
                part, kind = word(), None
            elif x < 0.72:
                part, kind = r.choice(fake)(), None
            else:
                kind = r.choice(ALL_KINDS)
                part = make[kind]()
            lead = ""
            if kind == "secret" and r.random() < 0.6:
                part = r.choice((*plain, *told, *told, *told))()
                lead = f'{r.choice(("token", "key", "secret", "password"))}{r.choice((" = ", ": ", "="))}' + r.choice(('"', ""))
            elif kind in KINDS and r.random() < 0.2:
                lead = {"email": "mail ", "ip": "host ", "card": "card ", "phone": "tel "}[kind]
            text += (" " if text else "") + lead
            if kind:
                gold.add((len(text), len(text) + len(part), kind))
            text += part + ('"' if lead.endswith('"') else r.choice(("", "", ".", ",")))
        yield text, gold


@lru_cache(maxsize=2)
def train(seed: int = 4, sentences: int = 700, epochs: int = 4, rate: float = 0.5, l2: float = 1e-4) -> SemiCrf:
    """Adaptive gradient ascent of the conditional likelihood."""
    model, square = SemiCrf({k: -3.0 for k in ALL_KINDS}), defaultdict(float)
    data = list(_sentences(seed, sentences))
    for _ in range(epochs):
        for text, gold in data:
            for f, g in model.gradient(text, gold).items():
                g += l2 * model.w.get(f, 0.0)
                square[f] += g * g
                model.w[f] = model.w.get(f, 0.0) - rate * g / (1e-6 + math.sqrt(square[f]))
    return model


def stretches(text: str):
    """Character ranges around digits and @, merged; whole atoms, at most _SIDE characters beyond a trigger."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if text[at] in "=:" and not _NAMED.search(text, max(0, at - 12), at):
            continue
        a, b = max(0, at - _SIDE), min(len(text), at + 1 + _SIDE)
        if lo >= 0 and a <= hi:
            hi = b
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = a, b
    if lo >= 0:
        yield lo, hi


def model_spans(text: str, model: SemiCrf) -> list[tuple[int, int, str]]:
    out = []
    for lo, hi in stretches(text):
        while lo > 0 and text[lo - 1].isalnum():
            lo -= 1
        while hi < len(text) and text[hi].isalnum():
            hi += 1
        atoms = [m.span() for m in _ATOM.finditer(text, lo, hi)]
        hot = [i for i, h in enumerate(_hot(text, atoms)) if h]
        i = 0
        while i < len(hot):
            a = max(0, hot[i] - _AROUND - MAX_ATOMS)
            j = i
            while j + 1 < len(hot) and hot[j + 1] - hot[j] <= 2 * MAX_ATOMS:
                j += 1
            out += model.decode(text, atoms[a : hot[j] + MAX_ATOMS + _AROUND])
            i = j + 1
    return out


def all_spans(text: str, base, model: SemiCrf) -> list[tuple[int, int, str]]:
    """Base spans, and the model's where they overlap none."""
    if not base and not _TRIGGER.search(text):
        return []
    taken = sorted((a, b) for a, b, _ in base)
    added = [s for s in set(model_spans(text, model)) if not any(a < s[1] and s[0] < b for a, b in taken)]
    return sorted([*base, *added], key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans of each document."""
    weights = train().w  # a few hundred features
    schema = T.StructType([docs.schema[id_col], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        model = SemiCrf(weights)
        for b, _, _ in text_slices(batches, text_col):
            rows = []
            for t in column(b, text_col).to_pylist():
                base = base_spans(t or "")
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(all_spans(t or "", base, model))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([column(b, id_col), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], schema.names)

    return bounded(docs.select(id_col, text_col)).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    weights, schema = train().w, docs.schema

    def clean(t, model):
        if not t:
            return t
        out, done = [], 0
        for a, b, k in all_spans(t, base_spans(t), model):
            if a >= done:
                out += [t[done:a], f"[{k.upper()}]"]
            done = max(done, b)
        return "".join([*out, t[done:]]) if out else t

    def run(batches):
        model = SemiCrf(weights)
        for b, _, _ in text_slices(batches, text_col):
            texts = pa.array([clean(t, model) for t in column(b, text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == text_col else column(b, n) for n in schema.names], schema.names)

    return bounded(docs).mapInArrow(run, schema)
