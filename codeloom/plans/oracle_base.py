"""Building blocks of the DuckDB oracles: literals, hashes and shared table expressions."""

from __future__ import annotations

from codeloom.plans import oracle_values as V
from codeloom.plans.corpus import corpus_oracle

SEED = 42


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h32(*parts: str, salt: str, seed: int = SEED) -> str:
    key = ", ".join([*parts, lit(salt), lit(str(seed))])
    return f"(('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT)"


def unit(*parts: str, salt: str, seed: int = SEED) -> str:
    return f"({h32(*parts, salt=salt, seed=seed)} / 4294967296)"


def rx(text: str, pattern: str, new: str) -> str:
    """Global replace; ``new`` uses $1 and is turned to \\1."""
    return f"regexp_replace({text}, {lit(pattern)}, {lit(new.replace('$', chr(92)))}, 'g')"


def group(text: str, pattern: str, n: int) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {n})"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def join(tokens: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({tokens}, {lit(sep)}), '')"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def by_lang(token: str, lang: str, lists: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {token} IN {in_list(v)}" for k, v in lists.items() if v)
    return f"(CASE {lang} {whens} ELSE false END)"


def is_reserved(token: str, lang: str = "lang") -> str:
    return by_lang(token, lang, V.RESERVED)


def is_keyword(token: str, lang: str = "lang") -> str:
    return by_lang(token, lang, V.KEYWORDS)


def _lexed(code: str, pattern: str, starts: tuple[str, ...]) -> str:
    keep = " AND ".join(f"NOT starts_with(t, {lit(s)})" for s in starts)
    return f"list_filter(regexp_extract_all({code}, {lit(pattern)}), lambda t: {keep})"


def lexed(code: str, lang: str = "lang") -> str:
    """Tokens of code that is not laid out by indentation."""
    return f"""CASE WHEN {lang} = 'ruby' THEN {_lexed(code, V.LEX_RUBY, ('#',))}
      WHEN {lang} = 'php' THEN {_lexed(code, V.LEX_PHP, ('//', '/*', '#'))}
      WHEN {lang} IN ('java', 'javascript') THEN {_lexed(code, V.LEX_DOLLAR, ('//', '/*'))}
      ELSE {_lexed(code, V.LEX_C, ('//', '/*'))} END"""


def normal_lexed(code: str, lang: str = "lang") -> str:
    """Tokens of normalised code, which has no comments."""
    all_of = lambda pattern: f"regexp_extract_all({code}, {lit(pattern)})"
    return f"""CASE WHEN {lang} = 'ruby' THEN {all_of(V.NORMAL_RUBY)} WHEN {lang} = 'php' THEN {all_of(V.NORMAL_PHP)}
      WHEN {lang} IN ('java', 'javascript') THEN {all_of(V.NORMAL_DOLLAR)} ELSE {all_of(V.NORMAL_C)} END"""


def line_ends(tokens: str) -> str:
    """A token list with line breaks: those that end a statement as NEWLINE, the others gone."""
    kept = f"list_filter({tokens}, lambda t, i: t <> chr(10) OR (i > 1 AND regexp_matches({tokens}[i - 1], {lit(V.LINE_ENDING)})))"
    return f"list_transform({kept}, lambda t: CASE WHEN t = chr(10) THEN 'NEWLINE' ELSE t END)"


def masked(toks: str) -> str:
    return join(f"""list_transform({toks}, lambda t, i: CASE WHEN regexp_matches(t, '^["''`]') THEN '"' || (i - 1) || '"' ELSE t END)""")


def normal_ws(text: str) -> str:
    return rx(text, "[ \\t\\n]+", " ")


def finish(code: str, toks: str = "toks") -> str:
    """Masked rewrite result to normalised code."""
    unmasked = join(
        f"""list_transform(string_split(trim(regexp_replace({code}, ' +', ' ', 'g')), ' '), lambda t:
          CASE WHEN regexp_full_match(t, '"[0-9]+"') THEN {toks}[TRY_CAST(replace(t, '"', '') AS INTEGER) + 1] ELSE t END)"""
    )
    return f"CASE WHEN {code} IS NOT NULL THEN {normal_ws(unmasked)} END"


PY_PIECES = "|".join([V.TRIPLE, V.STRING, V.NAME, V.NUMBER, V.OPERATOR, r"\S"])

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def query(select: str, *needs: str) -> str:
    """WITH all needed table expressions, in order, then the select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {body}\n{select}"


cte("corpus", corpus_oracle())
# Python lines with their indentation level: the number of distinct enclosing widths.
cte(
    "pylines",
    """SELECT id, ln, line, w FROM (
         SELECT id, ln, regexp_replace(raw, '#.*$', '') AS line, length(raw) - length(ltrim(raw)) AS w
         FROM (SELECT id, unnest(string_split(code, chr(10))) AS raw,
                      generate_subscripts(string_split(code, chr(10)), 1) AS ln
               FROM corpus WHERE lang = 'python') AS l) AS m
       WHERE trim(line) <> ''""",
    "corpus",
)


def _layout(name: str, source: str) -> None:
    """Layout tokens per id from the lines of ``source``."""
    cte(
        f"{name}_levels",
        f"""SELECT b.id, b.ln, any_value(b.line) AS line, count(DISTINCT a.w) AS level
            FROM {source} b LEFT JOIN {source} a ON a.id = b.id AND a.ln < b.ln AND a.w < b.w
              AND NOT EXISTS (SELECT 1 FROM {source} c WHERE c.id = b.id AND c.ln > a.ln AND c.ln < b.ln AND c.w < a.w)
            GROUP BY b.id, b.ln""",
        source,
    )
    cte(
        name,
        f"""SELECT id, list_concat(flatten(list(piece ORDER BY ln)),
                     list_transform(range(arg_max(level, ln)), lambda x: 'DEDENT')) AS toks
            FROM (SELECT id, ln, level, list_concat(
                    CASE WHEN d > 0 THEN ['INDENT'] ELSE list_transform(range(-d), lambda x: 'DEDENT') END,
                    regexp_extract_all(line, {lit(PY_PIECES)}), ['NEWLINE']) AS piece
                  FROM (SELECT *, level - coalesce(lag(level) OVER (PARTITION BY id ORDER BY ln), 0) AS d
                        FROM {name}_levels) AS t) AS u
            GROUP BY id""",
        f"{name}_levels",
    )


_layout("pylayout", "pylines")
cte("pylines_nodoc", """SELECT * FROM pylines WHERE NOT starts_with(ltrim(line), '"')""", "pylines")
_layout("pytoks", "pylines_nodoc")
cte(
    "tok",
    f"""SELECT id, lang, code, {lexed('code')} AS toks FROM corpus WHERE lang <> 'python'
        UNION ALL SELECT c.id, c.lang, c.code, p.toks FROM corpus c JOIN pytoks p ON p.id = c.id""",
    "corpus", "pytoks",
)
# The same with the line breaks that end a statement of go, javascript and ruby.
cte(
    "statements",
    f"""SELECT id, lang, CASE WHEN l IS NULL THEN toks ELSE {line_ends('l')} END AS toks FROM (
          SELECT id, lang, toks, CASE lang WHEN 'go' THEN {_lexed('code', V.LINES_GO, ('//', '/*'))}
            WHEN 'javascript' THEN {_lexed('code', V.LINES_DOLLAR, ('//', '/*'))} WHEN 'ruby' THEN {_lexed('code', V.LINES_RUBY, ('#',))} END AS l
          FROM tok) AS t""",
    "tok",
)
# Line breaks that end a statement of go, javascript and ruby, as tokens of their own; nulls elsewhere.
cte(
    "broken",
    f"""SELECT id, CASE lang WHEN 'go' THEN {_lexed('code', V.LINES_GO, ('//', '/*'))}
          WHEN 'javascript' THEN {_lexed('code', V.LINES_DOLLAR, ('//', '/*'))} WHEN 'ruby' THEN {_lexed('code', V.LINES_RUBY, ('#',))} END AS l
        FROM corpus WHERE lang <> 'python' UNION ALL SELECT id, NULL FROM corpus WHERE lang = 'python'""",
    "corpus",
)


def _context(toks: str, source: str) -> str:
    breaks = f"list_filter(range(1, len(l) + 1), lambda i: l[i] <> chr(10))"
    ends = f"list_transform({breaks}, lambda i: l[i + 1] = chr(10) AND regexp_matches(l[i], {lit(V.LINE_ENDING)}))"
    lined = f"array_to_string(list_transform(string_split(masked, ' '), lambda t, i: CASE WHEN coalesce(e[i], false) THEN t || {lit(' ' + V.LINE)} ELSE t END), ' ')"
    return f"""SELECT *, {lined} AS lined FROM (
        SELECT c.id, c.lang, c.code, c.toks, {normal_ws(join('c.toks'))} AS norm, {masked('c.toks')} AS masked, {ends} AS e
        FROM ({source.replace('TOKS', toks)}) AS c JOIN broken b ON b.id = c.id) AS t"""


cte("ctx", _context("toks", "SELECT id, lang, code, TOKS AS toks FROM tok"), "tok", "broken")
# The same for php functions wrapped in page tags, as the preparation job reads them.
cte(
    "prep",
    _context("CASE WHEN lang = 'php' THEN list_concat(['<?php'], toks, ['?>']) ELSE toks END", "SELECT id, lang, code, TOKS AS toks FROM tok"),
    "tok", "broken",
)


def noise_mask(toks: str, seed: int = SEED, key: str = "id") -> str:
    return f"list_transform({toks}, lambda t, i: CASE WHEN {unit(key, 'i - 1', salt='mask', seed=seed)} < 0.15 THEN '<mask>' ELSE t END)"


def noise_delete(toks: str, seed: int = SEED, key: str = "id") -> str:
    return f"list_filter({toks}, lambda t, i: {unit(key, 'i - 1', salt='delete', seed=seed)} >= 0.15)"


def noise_infill(toks: str, seed: int = SEED, key: str = "id") -> str:
    longest = f"(round_even(floor(0.15::DOUBLE * len({toks})) / 2, 0)::INT)"
    length = f"(1 + floor({unit(key, salt='infill_length', seed=seed)} * ({longest} - 1))::INT)"
    begin = f"({unit(key, salt='infill_start', seed=seed)} * (len({toks}) - {length}))"
    return f"CASE WHEN {longest} > 1 THEN list_filter({toks}, lambda t, i: (i - 1) < {begin} OR (i - 1) > {begin} + {length}) END"


cte("words", "SELECT id, lang, norm, string_split(norm, ' ') AS w FROM ctx", "ctx")
cte("pairs", f"SELECT id, lang, norm AS gold, {join(noise_mask('w'))} AS pred FROM words", "words")


# --- rewrites ------------------------------------------------------------------------------


def _case(value: str, mapping: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in mapping.items()) + f" ELSE {value} END"


def replace_one(source: str, text: str, pattern: str, valid: str, new: str, salt: str, where: str) -> str:
    """(id, out): one match m (before b, after a) replaced by ``new``, picked by hash."""
    return f"""SELECT id, array_to_string(list_transform(parts, lambda m, i: CASE WHEN i = k THEN {new} ELSE m END), '') AS out
      FROM (SELECT *, cand[1 + ({h32('id', salt=salt)} % len(cand))::INT] AS k FROM (
        SELECT *, list_filter(range(2, len(parts) + 1, 2), lambda j: ({valid})) AS cand FROM (
          SELECT id, lang, string_split({rx(text, '(' + pattern + ')', V.CUT + '$1' + V.CUT)}, {lit(V.CUT)}) AS parts
          FROM {source} WHERE {where}) AS p) AS c WHERE len(cand) > 0) AS r"""


M, B, A = "parts[j]", "parts[j - 1]", "parts[j + 1]"


def rewrite_ctes(src: str) -> None:
    """Table expressions ``{src}_<rewrite>`` with (id, out) over the context ``src``."""
    pat = V.COMPARISON
    op = group(M, pat, 2)
    allowed = (
        f"({op} IN {in_list(list(V.RELATIONAL))} OR (lang = 'javascript' AND {op} IN ('===', '!=='))"
        f" OR (lang = 'php' AND {op} IN ('<>', '===', '!==')) OR (lang = 'ruby' AND {op} = '==='))"
    )
    swapped = f"{group('m', pat, 3)} || ' ' || {_case(group('m', pat, 2), V.MIRROR)} || ' ' || {group('m', pat, 1)}"
    cte(
        f"{src}_op",
        replace_one(src, "masked", pat, f"{allowed} AND {has(B, V.BEFORE_COMPARISON)} AND {has(A, V.AFTER_COMPARISON)}",
                    swapped, "operand_swap", "true"),
        src,
    )

    # Tokens of the three kinds of layout, with the depth of blocks and parentheses behind each.
    opener, closer = "(tok = '{' OR tok = 'INDENT' OR ruby_open)", "(tok = '}' OR tok = 'DEDENT' OR ruby_close)"
    cte(
        f"{src}_words",
        f"""SELECT *, coalesce(before NOT IN ('.', ':'), true) AS plain FROM (
              SELECT id, lang, pos, tok, lag(tok) OVER w AS before, lead(tok) OVER w AS behind FROM (
                SELECT id, lang, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
                  SELECT id, lang, string_split(CASE WHEN lang = 'ruby' THEN lined ELSE masked END, ' ') AS t FROM {src}) AS a) AS b
              WINDOW w AS (PARTITION BY id ORDER BY pos)) AS c""",
        src,
    )
    starts = f"coalesce(before IN (';', {lit(V.LINE)}, '(', '{{', '|', '=', 'then', 'do', 'else', 'begin', 'ensure'), true)"
    cte(
        f"{src}_ruby",
        f"""SELECT id, pos, tok = 'end' AND plain AS ruby_close,
              plain AND (tok IN ('def', 'class', 'module', 'begin') OR starter OR (tok = 'do' AND NOT coalesce(loop_at > coalesce(cut_at, 0), false))) AS ruby_open
            FROM (SELECT *, max(CASE WHEN starter AND tok IN ('while', 'until', 'for') THEN pos END) OVER w AS loop_at,
                    max(CASE WHEN tok IN (';', {lit(V.LINE)}, 'do') THEN pos END) OVER w AS cut_at
                  FROM (SELECT *, plain AND {starts} AND tok IN ('if', 'unless', 'while', 'until', 'for', 'case') AS starter
                        FROM {src}_words WHERE lang = 'ruby') AS a
                  WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b""",
        f"{src}_words",
    )
    cte(
        f"{src}_pos",
        f"""SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER w AS depth,
              sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER w AS parens,
              min(CASE WHEN tok IN (';', '{{', '}}', 'NEWLINE', 'INDENT', 'DEDENT') THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
              max(CASE WHEN tok IN ('NEWLINE', 'INDENT', 'DEDENT') THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS line
            FROM (SELECT w.*, CASE lang WHEN 'ruby' THEN ruby_open WHEN 'python' THEN tok = 'INDENT' ELSE tok = '{{' END AS opens,
                    CASE lang WHEN 'ruby' THEN ruby_close WHEN 'python' THEN tok = 'DEDENT' ELSE tok = '}}' END AS closes
                  FROM {src}_words w LEFT JOIN {src}_ruby r ON r.id = w.id AND r.pos = w.pos) AS t
            WINDOW w AS (PARTITION BY id ORDER BY pos)""",
        f"{src}_words", f"{src}_ruby",
    )

    def pairs(opens: str, closes: str, depth: str) -> str:
        """(id, a, b): the n-th end of a depth belongs to the n-th beginning."""
        return f"""SELECT o.id, o.pos AS a, c.pos AS b FROM
          (SELECT id, pos, {depth} AS d, row_number() OVER (PARTITION BY id, {depth} ORDER BY pos) AS n FROM {src}_pos WHERE {opens}) AS o JOIN
          (SELECT id, pos, {depth} + 1 AS d, row_number() OVER (PARTITION BY id, {depth} ORDER BY pos) AS n FROM {src}_pos WHERE {closes}) AS c USING (id, d, n)"""

    cte(f"{src}_lists", f"SELECT id, list(tok ORDER BY pos) AS w FROM {src}_words GROUP BY id", f"{src}_words")
    # Blocks with the word that heads them: what stands before the parentheses, else the word before, else the line's first.
    cte(
        f"{src}_blocks",
        f"""SELECT p.id, p.a, p.b, o.lang, CASE WHEN o.lang = 'python' THEN w[coalesce(o.line, 0) + 1] WHEN q.a IS NOT NULL THEN w[q.a - 1] ELSE w[p.a - 1] END AS head
            FROM ({pairs('opens', 'closes', 'depth')}) AS p JOIN {src}_pos o ON o.id = p.id AND o.pos = p.a
            JOIN {src}_lists l ON l.id = p.id
            LEFT JOIN ({pairs("tok = '('", "tok = ')'", 'parens')}) AS q ON q.id = p.id AND q.b = p.a - 1""",
        f"{src}_pos", f"{src}_lists",
    )


    def ops(cond: str, ops: tuple[str, ...]) -> str:
        return f"len(list_filter({cond}, lambda o: o IN {in_list(list(ops))}))"

    def fits(cond: str, lang: str) -> str:
        logic = f"len(list_filter({cond}, lambda o: o IN ('&&', '&', '||', '|') OR ({lang} IN ('javascript', 'ruby') AND o IN ('and', 'or'))))"
        return f"{ops(cond, V.RELATIONAL)} = 1 AND {logic} = 0"

    def flip(cond: str) -> str:
        return f"list_transform({cond}, lambda o: {_case('o', V.NEGATE)})"

    def text(*lists: str) -> str:
        return f"array_to_string({' || '.join(lists)}, ' ')"

    def pick(cands: str, salt: str) -> str:
        """(id, out) of one candidate (id, p, out) per id."""
        return f"SELECT id, list(out ORDER BY p)[1 + ({h32('id', salt=salt)} % count(*))::INT] AS out FROM ({cands}) AS c WHERE out IS NOT NULL GROUP BY id"

    # s is the if, x its block, y the block behind else
    brace_swap = text("w[:s.pos]", flip("w[s.pos + 1:s.stop - 1]"), "['{']", "w[y.a + 1:y.b - 1]", "w[x.b:y.a]", "w[x.a + 1:x.b - 1]", "w[y.b:]")
    brace_if = f"""SELECT s.id, s.pos AS p, CASE WHEN {fits('w[s.pos + 1:s.stop - 1]', 's.lang')} THEN {brace_swap} END AS out
      FROM {src}_pos s JOIN {src}_lists l ON l.id = s.id JOIN {src}_blocks x ON x.id = s.id AND x.a = s.stop
      JOIN {src}_blocks y ON y.id = s.id AND y.a = x.b + 2 AND w[x.b + 1] = 'else'
      WHERE s.tok = 'if' AND coalesce(s.before, '') <> 'else' AND s.lang NOT IN ('python', 'ruby')"""
    python_swap = text("w[:s.pos]", flip("w[s.pos + 1:s.stop - 2]"), "w[s.stop - 1:x.a]", "w[y.a + 1:y.b - 1]", "w[x.b:y.a]", "w[x.a + 1:x.b - 1]", "w[y.b:]")
    python_if = f"""SELECT s.id, s.pos AS p, CASE WHEN {fits('w[s.pos + 1:s.stop - 2]', 's.lang')} THEN {python_swap} END AS out
      FROM {src}_pos s JOIN {src}_lists l ON l.id = s.id JOIN {src}_blocks x ON x.id = s.id AND x.a = s.stop + 1 AND w[s.stop] = 'NEWLINE' AND w[s.stop - 1] = ':'
      JOIN {src}_blocks y ON y.id = s.id AND y.a = x.b + 4 AND w[x.b + 1:x.b + 3] = ['else', ':', 'NEWLINE']
      WHERE s.tok = 'if' AND coalesce(s.before, '') <> 'else' AND s.lang = 'python'"""
    # Words of a ruby if that stand in no block inside of it.
    cte(
        f"{src}_own",
        f"""SELECT x.id, x.a, x.b, t.pos, t.tok FROM {src}_blocks x JOIN {src}_words t ON t.id = x.id AND t.pos > x.a AND t.pos < x.b
            WHERE x.lang = 'ruby' AND t.tok IN ('then', 'else', 'elsif', ';', {lit(V.LINE)})
              AND NOT EXISTS (SELECT 1 FROM {src}_blocks y WHERE y.id = x.id AND y.a > x.a AND y.a < t.pos AND y.b > t.pos)""",
        f"{src}_blocks", f"{src}_words",
    )
    ruby_swap = text("w[:p]", flip("w[p + 1:o - 1]"), "[w[o]]", "w[e + 1:b - 1]", "['else']", "w[o + 1:e - 1]", "w[b:]")
    ruby_if = f"""SELECT id, p, CASE WHEN {fits('w[p + 1:o - 1]', 'lang')} THEN {ruby_swap} END AS out FROM (
        SELECT k.id, 'ruby' AS lang, k.a AS p, k.b, min(k.pos) AS o, any_value(l.w) AS w, max(CASE WHEN k.tok = 'else' THEN k.pos END) AS e
        FROM {src}_own k JOIN {src}_lists l ON l.id = k.id WHERE l.w[k.a] IN ('if', 'unless')
        GROUP BY k.id, k.a, k.b HAVING count(*) FILTER (k.tok = 'else') = 1 AND count(*) FILTER (k.tok = 'elsif') = 0) AS t
      WHERE w[o] IN ('then', {lit(V.LINE)}) AND NOT EXISTS (SELECT 1 FROM {src}_blocks y WHERE y.id = t.id AND y.a > t.p AND y.a < t.o)"""
    cte(
        f"{src}_bs",
        f"SELECT id, replace(out, {lit(V.LINE)}, '') AS out FROM ({pick(f'{brace_if} UNION ALL {python_if} UNION ALL {ruby_if}', 'block_swap')}) AS t",
        f"{src}_blocks", f"{src}_own", f"{src}_lists",
    )

    # Jumps of a loop at a: those of inner loops belong to them, a break also to an inner switch.
    cte(
        f"{src}_jumps",
        f"""SELECT x.id, x.a, list(t.pos) AS js FROM {src}_blocks x JOIN {src}_words t ON t.id = x.id AND t.pos > x.a AND t.pos < x.b
            WHERE x.head = 'for' AND t.tok IN ('continue', 'break', 'return') AND NOT EXISTS (
              SELECT 1 FROM {src}_blocks y WHERE y.id = x.id AND y.a > x.a AND y.a < t.pos AND y.b > t.pos AND t.tok <> 'return'
                AND (y.head IN ('for', 'foreach', 'while', 'do') OR (y.head = 'switch' AND t.tok = 'break')))
            GROUP BY x.id, x.a""",
        f"{src}_blocks", f"{src}_words",
    )

    def body(step: str) -> str:
        """The block at x with a list of tokens before each of its jumps and at its end."""
        flat = f"flatten(list_transform(w[x.a + 1:x.b - 1], lambda t, i: CASE WHEN list_contains(js, x.a + i) THEN {step} || [t] ELSE [t] END))"
        return f"{flat} || {step}"

    part = lambda a, b: f"w[{a}:{b}]"
    init, cond, upd = part("s.pos + 2", "s1.pos - 1"), part("s1.pos + 1", "s2.pos - 1"), part("s2.pos + 1", "x.a - 2")
    given = lambda part: f"CASE WHEN len({part}) = 0 THEN [] ELSE {part} || [';'] END"
    for_brace = f"""SELECT s.id, s.pos AS p, {text('w[:s.pos - 1]', given(init), "['while', '(']", f"CASE WHEN len({cond}) = 0 THEN ['true'] ELSE {cond} END", "[')', '{']", body('(' + given(upd) + ')'), 'w[x.b:]')} AS out
      FROM {src}_pos s JOIN {src}_lists l ON l.id = s.id JOIN {src}_pos s1 ON s1.id = s.id AND s1.pos = s.stop JOIN {src}_pos s2 ON s2.id = s.id AND s2.pos = s1.stop
      JOIN {src}_blocks x ON x.id = s.id AND x.a = s2.stop LEFT JOIN {src}_jumps j ON j.id = s.id AND j.a = x.a
      WHERE s.tok = 'for' AND s.behind = '(' AND s1.tok = ';' AND s2.tok = ';' AND w[x.a - 1] = ')' AND s.lang IN {in_list(list(V.BRACE_LANGS))}
        AND (s.lang IN ('java', 'c') OR len({cond}) > 0)"""
    args = "string_split(array_to_string(w[s.pos + 5:s.stop - 3], ' '), ' , ')"
    bump = f"[w[s.pos + 1], '+=', coalesce({args}[3], '1'), 'NEWLINE']"
    for_py = f"""SELECT s.id, s.pos AS p, {text('w[:s.pos - 1]', f"[w[s.pos + 1], '=', CASE WHEN len({args}) > 1 THEN {args}[1] ELSE '0' END, 'NEWLINE', 'while', w[s.pos + 1], 'in', 'list', '(', 'range', '(', CASE WHEN len({args}) > 1 THEN {args}[2] ELSE {args}[1] END, ')', ')', ':', 'NEWLINE', 'INDENT']", body(bump), 'w[x.b:]')} AS out
      FROM {src}_pos s JOIN {src}_lists l ON l.id = s.id JOIN {src}_blocks x ON x.id = s.id AND x.a = s.stop + 1 LEFT JOIN {src}_jumps j ON j.id = s.id AND j.a = x.a
      WHERE s.tok = 'for' AND s.lang = 'python' AND w[s.pos + 2:s.pos + 4] = ['in', 'range', '('] AND w[s.stop - 2:s.stop - 1] = [')', ':']"""
    cte(f"{src}_fw", pick(f"{for_brace} UNION ALL {for_py}", "for_to_while"), f"{src}_blocks", f"{src}_jumps", f"{src}_lists")

    inner = rx("array_to_string(w[s.pos + 2:s.stop - 2], ' ') || ' '", r"\( [^()]*\)", "x")
    binary = has("' ' || " + inner, V.BINARY_OPERATOR)
    while_brace = f"""SELECT s.id, s.pos AS p, {text('w[:s.pos - 1]', "['for', '(', ';']", 'w[s.pos + 2:s.stop - 2]', "[';', ')']", 'w[s.stop:]')} AS out
      FROM {src}_pos s JOIN {src}_lists l ON l.id = s.id JOIN {src}_blocks x ON x.id = s.id AND x.a = s.stop
      WHERE s.tok = 'while' AND s.behind = '(' AND w[s.stop - 1] = ')' AND s.lang IN {in_list(list(V.BRACE_LANGS))} AND (s.lang <> 'c_sharp' OR {binary})"""
    cte(f"{src}_wf", pick(while_brace, "while_to_for"), f"{src}_blocks", f"{src}_lists")

    py_text = rx(rx(rx("masked", r"\bNEWLINE INDENT\b", V.OPEN), r"\bDEDENT\b", V.CLOSE), r"\bNEWLINE\b", V.LINE)

    def py_unmark(t: str) -> str:
        return f"replace(replace(replace({t}, {lit(V.OPEN)}, 'NEWLINE INDENT'), {lit(V.CLOSE)}, 'DEDENT'), {lit(V.LINE)}, 'NEWLINE')"

    cte(
        f"{src}_forwhile",
        f"""SELECT c.id, CASE WHEN {unit('c.id', salt='for_while')} < 0.5 THEN coalesce(a.out, b.out) ELSE coalesce(b.out, a.out) END AS out
            FROM {src} c LEFT JOIN {src}_fw a ON a.id = c.id LEFT JOIN {src}_wf b ON b.id = c.id""",
        src, f"{src}_fw", f"{src}_wf",
    )

    def twice(text: str, pattern: str, new: str) -> str:
        return rx(rx(text, pattern, new), pattern, new)

    inc = twice(twice("masked", V.PRE_STEP, "$1$4 $3= 1 ; $2 = $4 ;"), V.POST_STEP, "$1$2 = $3 ; $3 $4= 1 ;")
    confusing = f"lang IN {in_list(list(V.CONFUSION_LANGUAGES))}"
    cte(f"{src}_inc", f"SELECT id, out FROM (SELECT id, masked, {inc} AS out FROM {src} WHERE {confusing}) AS t WHERE out <> masked", src)
    ter = twice("masked", V.TERNARY_ASSIGN, "$1if ( $3$4 ) { $2 = $5 ; } else { $2 = $6 ; }")
    ter = twice(ter, V.TERNARY_DECLARE, "$1$2$3 ; if ( $4$5 ) { $3 = $6 ; } else { $3 = $7 ; }")
    ter = rx(ter, V.TERNARY_RETURN, "$1if ( $2$3 ) { return $4 ; } else { return $5 ; }")
    cte(
        f"{src}_ter",
        f"""SELECT id, CASE WHEN lang = 'java' THEN {rx('out', V.IMPORT_TOKENS, '')} ELSE out END AS out
            FROM (SELECT id, lang, masked, {ter} AS out FROM {src} WHERE {confusing}) AS t WHERE out <> masked""",
        src,
    )
    cte(
        f"{src}_conf",
        f"""SELECT c.id, CASE WHEN {unit('c.id', salt='confusion')} < 0.5 THEN coalesce(a.out, b.out) ELSE coalesce(b.out, a.out) END AS out
            FROM {src} c LEFT JOIN {src}_inc a ON a.id = c.id LEFT JOIN {src}_ter b ON b.id = c.id""",
        src, f"{src}_inc", f"{src}_ter",
    )

    rows = ", ".join(f"({lit(a)}, {lit(b)}, {lo}, {hi}, {lit(t)})" for a, b, lo, hi, t in V.DEAD_TEMPLATES)
    cut = V.CUT + "$1" + V.CUT
    py_marked = rx(py_text, "(" + V.STATEMENT_PYTHON + ")", cut)
    rb_marked = rx(rx("lined", V.RUBY_HEADS, f"$1 {V.LINE}"), "(" + V.STATEMENT_LINES + ")", cut)
    lines_marked = rx(rx("lined", V.FOR_HEADER, f"for $1{V.SEMI} $2{V.SEMI} $3"), "(" + V.STATEMENT_LINES + ")", cut)
    marked = rx(rx("masked", V.FOR_HEADER, f"for $1{V.SEMI} $2{V.SEMI} $3"), "(" + V.STATEMENT + ")", cut)
    ok = (
        f"len(string_split({M}, ' ')) > 1 AND len(string_split({M}, ' ')) * 2 < n AND "
        f"length(replace({M}, '(', '')) = length(replace({M}, ')', '')) AND NOT (lang = 'ruby' AND {has(M, V.RUBY_CONTROL)})"
    )
    cte(
        f"{src}_statements",
        f"""SELECT *, parts[cand[1 + ({h32('id', salt='dead_body')} % len(cand))::INT]] AS picked,
              cand[1 + ({h32('id', salt='dead_target')} % len(cand))::INT] AS k,
              {unit('id', salt='dead_variant')} AS u, ['for', 'while', 'if'][1 + ({h32('id', salt='dead_kind')} % 3)::INT] AS kind,
              CASE WHEN lang = 'php' THEN '$_i_' ELSE '_i_' END || ({h32('id', salt='dead_variable')} % 10) AS v
            FROM (SELECT *, list_filter(range(2, len(parts) + 1, 2), lambda j: ({ok})) AS cand FROM (
              SELECT id, lang, len(string_split(masked, ' ')) AS n,
                string_split(CASE lang WHEN 'python' THEN {py_marked} WHEN 'ruby' THEN {rb_marked} WHEN 'go' THEN {lines_marked} WHEN 'javascript' THEN {lines_marked} ELSE {marked} END, {lit(V.CUT)}) AS parts
              FROM {src}) AS p) AS q WHERE len(cand) > 0""",
        src,
    )
    stmt = f"replace(regexp_replace(picked, {lit(f' {V.LINE}$')}, ''), {lit(V.SEMI)}, ';')"
    cte(
        f"{src}_deadblock",
        f"""SELECT s.*, {stmt} AS body, replace(replace(t.template, '{{v}}', s.v), '{{b}}', {stmt}) AS dead
            FROM {src}_statements s JOIN (VALUES {rows}) AS t(tlang, tkind, lo, hi, template)
              ON t.tlang = s.lang AND t.tkind = s.kind AND s.u >= t.lo AND s.u < t.hi""",
        f"{src}_statements",
    )
    cte(
        f"{src}_dead",
        f"""SELECT id, CASE WHEN lang = 'python' THEN {py_unmark('out')} ELSE replace(replace(out, {lit(V.LINE)}, ''), {lit(V.SEMI)}, ';') END AS out
            FROM (SELECT id, lang, array_to_string(list_transform(parts, lambda m, i: CASE WHEN i = k THEN dead || ' ' || m ELSE m END), '') AS out
                  FROM {src}_deadblock) AS t""",
        f"{src}_deadblock",
    )

    name = f"^{V.NAME_DOLLAR}$"
    cte(
        f"{src}_tokens",
        f"""SELECT id, lang, pos, tok, {has('tok', name)} AND NOT {is_reserved('tok')} AS is_name FROM (
              SELECT id, lang, unnest(string_split(masked, ' ')) AS tok, generate_subscripts(string_split(masked, ' '), 1) - 1 AS pos
              FROM {src}) AS t""",
        src,
    )
    cte(
        f"{src}_names",
        f"""SELECT id, tok, {h32('id', 'tok', salt='rename')} AS h, row_number() OVER (PARTITION BY id ORDER BY {h32('id', 'tok', salt='rename')}, tok) - 1 AS i,
              count(*) OVER (PARTITION BY id) AS n
            FROM (SELECT DISTINCT id, tok FROM (
              SELECT *, lead(tok) OVER w AS nt, lead(is_name) OVER w AS nn FROM {src}_tokens WINDOW w AS (PARTITION BY id ORDER BY pos)) AS t
              WHERE is_name AND coalesce(nt <> '(', true) AND NOT coalesce(nn, false) AND (lang <> 'php' OR starts_with(tok, '$'))) AS d""",
        f"{src}_tokens",
    )
    cte(f"{src}_renamed", f"SELECT id, tok, i FROM {src}_names WHERE i < ceil(0.2::DOUBLE * n)", f"{src}_names")
    cte(
        f"{src}_ren",
        f"""SELECT id, out FROM (SELECT c.id, c.masked, string_agg(coalesce('VAR_' || r.i, t.tok), ' ' ORDER BY t.pos) AS out
              FROM {src} c JOIN {src}_tokens t ON t.id = c.id LEFT JOIN {src}_renamed r ON r.id = t.id AND r.tok = t.tok
              GROUP BY c.id, c.masked) AS x WHERE out <> masked""",
        src, f"{src}_tokens", f"{src}_renamed",
    )
    outs = {"BlockSwap": "bs", "ConfusionRemover": "conf", "ForWhileTransformer": "forwhile", "OperandSwap": "op",
            "DeadCodeInserter": "dead", "VarRenamer": "ren"}
    tries = " UNION ALL ".join(
        f"SELECT id, {lit(n)} AS name, out, -ln(({h32('id', lit(n), salt='race')} + 0.5) / 4294967296) / {V.REWRITE_WEIGHTS[n]} AS race FROM {src}_{s} WHERE out IS NOT NULL"
        for n, s in outs.items()
    )
    cte(
        f"{src}_chosen",
        f"SELECT id, arg_min(name, race) AS name, arg_min(out, race) AS out FROM ({tries}) AS t GROUP BY id",
        *[f"{src}_{s}" for s in outs.values()],
    )
    cte(
        f"{src}_changed",
        f"""SELECT c.id, c.lang, c.norm, x.name AS transformer, {finish('x.out', 'c.toks')} AS changed
            FROM {src} c LEFT JOIN {src}_chosen x ON x.id = c.id WHERE len({words('c.norm')}) <= {V.MAX_FUNCTION_LENGTH}""",
        src, f"{src}_chosen",
    )


rewrite_ctes("ctx")
rewrite_ctes("prep")
