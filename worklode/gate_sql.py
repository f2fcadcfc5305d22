"""The text rules as SQL expressions for the comparison engine, made from the same fixed values."""

from __future__ import annotations


from worklode.functions import rules

_SPACE = r"[\s\x0B\x{85}\p{Z}]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern without look-arounds as a literal: this engine's word boundaries are ASCII as they are."""
    return quote(pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b"))


def trim(x: str) -> str:
    return f"regexp_replace({x}, '\\A{_SPACE}+|{_SPACE}+\\z', '', 'g')"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), '’', ''''), '‘', '''')"


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(p)})" for p in phrases) + ")"


def starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quote(p)})" for p in prefixes) + ")"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {re2(pattern)})"


def count(x: str, sign: str) -> str:
    return f"((length({x}) - length(replace({x}, {quote(sign)}, ''))) // {len(sign)})"


def sentence_list(x: str) -> str:
    """Trimmed sentences: dots that end none are hidden first, and the others, !, ? and line breaks cut."""
    dot = r"""([A-Za-z0-9])\.([A-Za-z0-9]{1,8}(?:\z|[ \t,;:)\]'".!?\x02-]))"""
    y = f"regexp_replace({x}, '((?:\\A|\\n)[0-9]{{1,9}})\\.([ \\t])', '\\1' || chr(2) || '\\2', 'g')"
    for _ in range(3):
        y = f"regexp_replace({y}, {quote(dot)}, '\\1' || chr(2) || '\\2', 'g')"
    y = f"replace(regexp_replace({y}, '([.\\n!?])', '\\1' || chr(1), 'g'), chr(2), '.')"
    return f"list_filter(list_transform(string_split({y}, chr(1)), lambda z: {trim('z')}), lambda z: z <> '')"


def clip(x: str) -> str:
    """Over 2000 bytes: 400 at either end, a cut character as replacement signs."""
    k = f"list_max(list_filter(range(100, 401), lambda k: strlen(left({x}, k)) <= 400))"
    j = f"list_max(list_filter(range(100, 401), lambda k: strlen(right({x}, k)) <= 400))"
    head = f"left({x}, {k}) || CASE WHEN strlen(left({x}, {k})) < 400 THEN '�' ELSE '' END"
    tail = f"repeat('�', CAST(400 - strlen(right({x}, {j})) AS BIGINT)) || right({x}, {j})"
    return f"(CASE WHEN strlen({x}) <= 2000 THEN {x} ELSE {head} || chr(10) || '…' || chr(10) || {tail} END)"


_FIRST = r"""regexp_replace(coalesce(regexp_extract({x}, '\A{s}*([^\s\x0B\x{{85}}\p{{Z}}]+)', 1), ''), '\A["“”''`.,;:()\[\]]+|["“”''`.,;:()\[\]]+\z', '', 'g')"""


def gate_columns() -> dict[str, str]:
    """Each gate over columns v (the text), t (trimmed), low (folded), lt (folded and trimmed), u (lt without a list mark)."""
    first = _FIRST.format(x="v", s=_SPACE)
    base = f"lower(regexp_extract({first}, '(?s)\\A(.+)\\.[A-Za-z]{{1,4}}\\z', 1))"
    at = f"length(regexp_extract({base}, '(?s)\\A(.*)_test', 1))"
    word = f"coalesce(regexp_extract(t, '\\A{_SPACE}*([^\\s\\x0B\\x{{85}}\\p{{Z}}]+)', 1), '')"
    found = "regexp_extract(low, '(?s)\\A.*?they found[^:]*:(.*)\\z', 1)"
    clock = has("v", r"(?<![0-9A-Za-z_])\d{1,2}:\d{2}(?![0-9A-Za-z_])")
    inspect = (
        f"(contains(u, 'recent_noise=') OR contains(u, '`recent_noise') OR {has('u', r'\Alive recent \d+ are(?![0-9A-Za-z_])')} OR {has('u', r'\Ainspect recent on(?![0-9A-Za-z_])')} "
        f"OR ({any_of('u', rules.RECAP)} AND ({clock} OR {any_of('u', ('recent window', 'live store', 'live export'))})) OR (contains(u, 'remaining active failed') AND contains(u, 'recap')))"
    )
    review = f"(contains({found}, ',') AND contains({found}, ' and '))"
    hyphen = "(starts_with(u, 'they-found') AND contains(u, ',') AND contains(u, ' and '))"
    fragment = starts("lt", ("so ", "and ", "but "))
    leading = f"(NOT {has(first, r'[/\\]')} AND contains({base}, '_test') AND {at} <= 1)"
    version = f"({has('t', r'(?:\A|[^0-9.])0\.\d+\.\z')} AND NOT {has('t', r'\d+\.\d+\.\d+\.\z')})"
    item = f"CASE WHEN {has('t', r'\A[-*] ')} THEN {trim('substr(t, 3)')} WHEN {has('t', r'\A\d+[.)]\s+')} THEN {trim(f"regexp_replace(t, {quote(r'\A\d+[.)]\s+')}, '')")} ELSE t END"
    return {
        "planning": any_of("low", rules.PLANNING),
        "session_op": any_of("low", rules.SESSION_OP),
        "narrative_decision": any_of("low", rules.NARRATIVE),
        "agent_prompt": f"({any_of('low', (chr(39).join(('why don', 't you')), 'why do not you', 'why dont you'))} OR starts_with(low, 'can you ') OR starts_with(low, 'could you '))",
        "status_failed": any_of("low", rules.STATUS_FAILED),
        "failed_as_object": any_of("low", rules.FAILED_OBJECT),
        "meta_failed_talk": f"({any_of('low', rules.META_FAILED)} OR contains(low, 'go-first,') OR {any_of('low', rules.NO_OBJECT)} OR {inspect} OR {review} OR {hyphen})",
        "process_state": f"({any_of('low', rules.PROCESS_STATE)} OR {has('lt', r' next\.?\z')})",
        "constraint_fragment": fragment,
        "remembered_prose": starts("lt", ("remembered:", "remembered ")),
        "next_i": starts("lt", ("next i ", "next i'", "next i'll")),
        "yaml_chrome": starts("u", rules.YAML_CHROME),
        "quoted_attribution": f"(contains(low, 'said') AND (contains(low, 'said:') OR {has('v', '[' + chr(34) + '“”]')}))",
        "truncated": f"({has('t', r'(?:\(|`\.|do not|\|)\z')} OR contains(t, 'path (`.') OR contains(t, '…)') OR contains(t, '...)') OR contains({word}, '`') OR ({count('t', '`')} % 2 = 1 AND ends_with(t, '.')) OR ({fragment} AND {has('t', '[`|…]')}) OR {leading} OR starts_with(u, 'tree:') OR {version} OR {count('t', '(')} > {count('t', ')')})",
        "leading_file_fragment": leading,
        "tree_dump": "starts_with(u, 'tree:')",
        "trailing_short_version": version,
        "still_no_object": any_of("low", rules.NO_OBJECT),
        "first_mash": "contains(low, 'go-first,')",
        "inspect_status": inspect,
        "found_review_list": review,
        "found_hyphen_list": hyphen,
        "fixture_talk": any_of("low", ("fixture", "quoted the", "quoting the")),
        "chrome_prefix": starts("t", rules.CHROME_PREFIX),
        "example_drop": "starts_with(" + fold(trim(f"regexp_replace({item}, '\\A[\"“”''`]+', '')")) + ", 'example drop:')",
        "product_copy": any_of("low", rules.PRODUCT_COPY),
        "skill_talk": any_of("low", rules.SKILL_TALK),
    }


_MASTER = ("fixture_talk", "next_i", "meta_failed_talk", "session_op", "agent_prompt", "planning", "narrative_decision", "status_failed", "failed_as_object", "quoted_attribution", "remembered_prose", "yaml_chrome", "truncated", "skill_talk", "product_copy")


def gate_ctes(source: str) -> str:
    """CTEs from ``source`` (text): ``gated`` (text, every gate, skip_prose), a row for each distinct text."""
    left = r"""regexp_replace({x}, '\A["“”''`]+', '')"""
    stripped = left.format(x=trim("text"))
    bold = count("v", "**")
    heading = f"(starts_with(v, '**') AND ((ends_with(v, '**') AND NOT contains(v, '.')) OR {bold} % 2 = 1))"
    columns = ", ".join(f"{sql} AS {name}" for name, sql in gate_columns().items())
    master = f"(v = '' OR chrome_prefix OR contains(v, ' | ') OR {heading} OR {starts('lt', ('**what was wrong', '**what you do next'))} OR " + " OR ".join(_MASTER) + ")"
    return f"""texts AS (SELECT DISTINCT text, {trim('text')} AS s, {stripped} AS q FROM {source}),
  strs AS (SELECT DISTINCT v FROM (SELECT text AS v FROM texts UNION ALL SELECT s FROM texts UNION ALL SELECT q FROM texts)),
  forms AS (SELECT v, {trim('v')} AS t, {fold('v')} AS low, {fold(trim('v'))} AS lt FROM strs),
  forms2 AS (SELECT *, regexp_replace(lt, '\\A- ', '') AS u FROM forms),
  each AS MATERIALIZED (SELECT v, t, low, lt, {columns} FROM forms2),
  gated AS MATERIALIZED (SELECT x.text, e.t, e.low, {", ".join("e." + n for n in gate_columns())}, x.s = '' OR d.example_drop OR g.m AS skip_prose FROM texts x
    JOIN each e ON e.v = x.text JOIN each d ON d.v = x.s JOIN (SELECT v, {master} AS m FROM each) g ON g.v = x.q)"""


def classified(error: str = "false", role: str = "role") -> str:
    """The type of a sentence in a row of ``gated`` with a role."""
    probe = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(low, '\\', '/'), {re2(rules.PATH)}, ' ', 'g'), '`[^`]*`', ' ', 'g'), {re2(rules.TYPE_TALK)}, ' ', 'g'), {re2(rules.EXCEPTION_TO)}, ' ', 'g')"
    used = f"lower(regexp_extract(low, {re2(rules.USE_NOT)}, 1))"
    decision = f"({has('low', rules.DECISION)} OR ({used} <> '' AND {used} NOT IN ({', '.join(map(quote, rules.USE_NOT_STOP))})))"
    question = f"(ends_with(t, '?') OR {any_of(fold('t'), (chr(39).join(('why don', 't you')), 'why dont you'))} OR {has(fold('t'), rules.QUESTION)})"
    soft = f"({has(probe, rules.SOFT_FAILED)} AND NOT meta_failed_talk)"
    constraint = f"({has('low', rules.CONSTRAINT)} AND {role} = 'user' AND NOT {has('low', rules.HEDGE)} AND NOT session_op AND NOT agent_prompt AND NOT constraint_fragment)"
    return (
        f"CASE WHEN {question} THEN NULL WHEN {has(probe, rules.HARD_FAILED)} AND NOT meta_failed_talk THEN 'failed' WHEN {decision} AND NOT planning AND NOT narrative_decision THEN 'decision' "
        f"WHEN ({error} OR {soft}) AND NOT ({decision} AND NOT planning) THEN 'failed' WHEN {constraint} THEN 'constraint' WHEN {has('low', rules.STATE)} THEN 'state' END"
    )




def slashes(x: str) -> str:
    return f"replace({x}, '\\', '/')"


def base_name(x: str) -> str:
    return f"string_split({slashes(x)}, '/')[-1]"


def stem(x: str) -> str:
    return f"regexp_replace({base_name(x)}, '(?s)\\A(.+)\\.[^.]*\\z', '\\1')"


def normal_path(x: str) -> str:
    p = f"regexp_replace(regexp_replace({slashes(trim(x))}, '\\A(?:\\./)+', ''), '/\\z', '')"
    return f"CASE WHEN {p} IN ('.', '..') THEN '' ELSE {p} END"


def path_tests(x: str) -> dict[str, str]:
    n = slashes(trim(x))
    low, parts = f"lower({n})", f"string_split({n}, '/')"
    host = f"string_split({low}, '/')[1]"
    listed = lambda words: ", ".join(map(quote, words))
    return {
        "traversal": f"({n} = '' OR contains({n}, chr(0)) OR {has(low, '%2e|%2f|%00')} OR {has(n, r'\A[/~]')} OR {has(n, r'\A[\x00-\x7f]:')} OR {host} IN ({listed(rules.ABSOLUTE_ROOTS)}) OR list_contains({parts}, '..'))",
        "remote": f"(contains({low}, '://') OR ends_with({low}, '.git') OR ({host} <> '' AND NOT starts_with({host}, '.') AND contains({host}, '.')))",
        "git_dir": f"list_contains({parts}, '.git')",
        "dependency": f"list_has_any({parts}, [{listed(rules.DEPENDENCY_DIRS)}])",
        "sensitive": has(x, rules.SENSITIVE_PATH),
    }


def source_path(p: str) -> str:
    """Is a normalised path one of the project's own sources?"""
    return f"({p} <> '' AND NOT ({' OR '.join(path_tests(p).values())}))"


def origin(x: str) -> str:
    raw = f"regexp_replace({trim(x)}, '\\Agit\\+', '')"
    part = lambda i: f"lower(regexp_extract({raw}, {re2(rules.ORIGIN)}, {i}))"
    return f"CASE WHEN {has(raw, rules.ORIGIN)} THEN {part(1)} || '/' || regexp_replace({part(2)}, '\\.git\\z', '') ELSE '' END"


def project_key(x: str) -> str:
    s = f"regexp_replace(lower({trim(x)}), '\\.git\\z', '')"
    parts = f"list_filter(string_split({s}, '/'), lambda q: q <> '')"
    plain = f"CASE WHEN contains({s}, '__') THEN regexp_replace({s}, '(?s)\\A(.*?)__', '\\1/') ELSE {s} END"
    return f"CASE WHEN contains({s}, '/') THEN CASE WHEN {origin(s)} <> '' THEN {origin(s)} WHEN len({parts}) >= 2 THEN {parts}[-2] || '/' || {parts}[-1] ELSE {plain} END ELSE {plain} END"


def grounded(paths: str) -> str:
    """Does a sentence in a row of ``gated`` (text, t) say what failed, with a list of its own paths?"""
    words = f"list_transform(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> ''), lambda w: regexp_replace(w, '\\A[.,;:()\\[\\]\"'']+|[.,;:()\\[\\]\"'']+\\z', '', 'g'))"
    listed = lambda words_: ", ".join(map(quote, words_))
    name = "(regexp_matches(w, '\\A[A-Z]') AND ((strlen(w) >= 3 AND regexp_matches(w, '[a-z]')) OR contains(w, '-')))"
    one = f"CASE WHEN w = '' THEN false WHEN lower(w) IN ({listed(rules.FAIL_WORDS)}) THEN lower(coalesce(ws[i + 1], '')) IN ('to', 'during', 'again', 'on') WHEN i = 1 AND w IN ({listed(rules.SENTENCE_STARTERS)}) THEN false ELSE {name} END"
    named = f"coalesce((SELECT bool_or({one}) FROM (SELECT ws, i, ws[i] AS w FROM (SELECT {words} AS ws), unnest(range(1, len(ws) + 1)) AS r(i))), false)"
    return f"(len({paths}) > 0 OR len(list_filter(list_transform({paths}, lambda p: {normal_path('p')}), lambda p: {source_path('p')})) > 0 OR (NOT status_failed AND NOT failed_as_object AND (regexp_matches(text, '`|\\*\\*') OR {named})))"
