"""The SQL of the chunkers: folds over lists of one string each, the last of a state being its buffer.

Lookahead isn't known to DuckDB's expressions, so a mark is put before each place to cut at."""

from __future__ import annotations

from itertools import count

W = r"[\s\p{Z}\x0b\x{85}]"
_n = count()


def _v() -> str:
    return f"v{next(_n)}"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{W}+|{W}+$', '', 'g')"


def transform(xs: str, body) -> str:
    v = _v()
    return f"list_transform({xs}, lambda {v}: {body(v)})"


def keep(xs: str, test) -> str:
    v = _v()
    return f"list_filter({xs}, lambda {v}: {test(v)})"


def some(xs: str) -> str:
    return keep(transform(xs, strip), lambda v: f"{v} <> ''")


def fold(xs: str, step) -> str:
    """step(state, item): the state is a list whose last element is the buffer."""
    a, x = _v(), _v()
    return f"list_reduce({transform(xs, lambda v: f'[{v}]')}, lambda {a}, {x}: {step(a, f'{x}[1]')}, [''])"


def let(e: str, body) -> str:
    return f"({transform(f'[{e}]', body)})[1]"


def cut(e: str, pattern: str, flags: str = "g") -> str:
    return some(f"string_split(regexp_replace({e}, '({pattern})', chr(1) || '\\1', '{flags}'), chr(1))")


def sentences(t: str) -> str:
    lines = some(f"string_split({t}, chr(10))")
    return some(f"flatten({transform(lines, lambda c: f'''string_split(regexp_replace({c}, '([다요음함][.!?]){W}+', '\\1' || chr(1), 'g'), chr(1))''')})")


def done(a: str) -> str:
    return f"{a}[1:len({a}) - 1]"


def by_length(t: str, target: str = "500", longest: str = "900", shortest: str = "100") -> str:
    def forced(s: str) -> str:
        steps = transform(f"range(0, (length({s}) - 1) // {target} + 1)", lambda i: strip(f"substr({s}, ({i} * {target} + 1)::BIGINT, ({target})::BIGINT)"))
        return keep(steps, lambda p: f"length({p}) >= {shortest}")

    def step(a: str, s: str) -> str:
        buf = f"{a}[-1]"
        return f"""CASE WHEN length({s}) > {longest} THEN list_concat(list_concat(CASE WHEN {buf} <> '' THEN {a} ELSE {done(a)} END, {forced(s)}), [''])
            WHEN length({buf}) + length({s}) > {target} AND {buf} <> '' THEN list_append({a}, {strip(f"right({buf}, 80) || ' ' || {s}")})
            ELSE list_append({done(a)}, CASE WHEN {buf} <> '' THEN {buf} || ' ' || {s} ELSE {s} END) END"""

    return f"CASE WHEN length({t}) <= {longest} THEN CASE WHEN length({t}) >= {shortest} THEN [{t}] ELSE [] END ELSE {keep(fold(sentences(t), step), lambda p: f'length({p}) >= {shortest}')} END"


def pack(xs: str) -> str:
    def step(a: str, p: str) -> str:
        buf = f"{a}[-1]"
        return f"CASE WHEN {buf} = '' THEN list_append({done(a)}, {p}) WHEN length({buf}) + length({p}) > 500 THEN list_append({a}, {p}) ELSE list_append({done(a)}, {buf} || chr(10) || {p}) END"

    return keep(fold(xs, step), lambda v: f"{v} <> ''")


def merged(xs: str) -> str:
    def step(a: str, p: str) -> str:
        last = f"{a}[-1]"
        return f"CASE WHEN {last} = '' THEN [{p}] WHEN length({p}) < 60 OR length({last}) < 60 THEN list_append({done(a)}, {last} || chr(10) || {p}) ELSE list_append({a}, {p}) END"

    return keep(fold(xs, step), lambda v: f"{v} <> ''")


def within(p: str) -> str:
    return f"CASE WHEN length({p}) <= 900 THEN [{p}] ELSE {by_length(p)} END"


def oversized(t: str) -> str:
    many = lambda subs: f"CASE WHEN len({subs}) > 1 THEN flatten({transform(pack(subs), within)}) ELSE {by_length(t)} END"
    return let(let(cut(t, "[①-⑮]"), many), lambda o: f"CASE WHEN len({o}) > 0 THEN {o} ELSE [substr({t}, 1, 900)] END")


def labelled(xs: str, label: str) -> str:
    return transform(xs, lambda v: f"{{'text': {v}, 'label': {label}}}")


_ARTICLE = f"^제{W}*(\\p{{Nd}}+){W}*조{W}*[(（]?{W}*([^)）\\n]{{0,24}})?"


def article_label(p: str) -> str:
    title = strip(f"regexp_extract({p}, '{_ARTICLE}', 2)")
    return f"CASE WHEN regexp_matches({p}, '{_ARTICLE}') THEN '제' || regexp_extract({p}, '{_ARTICLE}', 1) || '조' || {let(title, lambda x: f'''CASE WHEN length({x}) > 20 OR {x} = '' OR regexp_matches({x}, '(다|다\\.|함|음)$') THEN '' ELSE '(' || {x} || ')' END''')} ELSE '' END"


def articles(t: str) -> str:
    one = lambda p: let(article_label(p), lambda label: labelled(f"CASE WHEN length({p}) <= 900 THEN [{p}] ELSE {oversized(p)} END", label))
    return f"flatten({transform(merged(cut(t, f'제{W}*' + chr(92) + 'p{Nd}+' + f'{W}*조')), one)})"


def packed(t: str, pattern: str, label, flags: str = "g") -> str:
    many = lambda raw: f"CASE WHEN len({raw}) < 2 THEN {labelled(by_length(t), chr(39) * 2)} ELSE flatten({transform(pack(raw), lambda p: labelled(within(p), label(p)))}) END"
    return let(cut(t, pattern, flags), many)


def number_label(p: str) -> str:
    return f"regexp_replace(regexp_extract({p}, '^{W}*(\\p{{Nd}}{{1,2}}[.)]|[가-힣][.)])', 1), '[.)]+$', '')"


def structural(t: str, pieces: str) -> str:
    flat = labelled(by_length(t), "''")
    tidy = lambda xs: keep(transform(xs, lambda p: f"{{'text': {strip(f'{p}.text')}, 'label': {p}.label}}"), lambda p: f"length({p}.text) >= 20")
    kept = tidy(let(pieces, lambda p: f"CASE WHEN len({p}) < 2 THEN {flat} ELSE {p} END"))
    return let(kept, lambda k: f"CASE WHEN len({k}) > 0 THEN {k} ELSE {flat} END")


def faq(text: str) -> str:
    def long(t: str) -> str:
        at = f"instr({t}, chr(10) || 'A. ')"
        qa = f"(starts_with({t}, 'Q. ') AND {at} > 0)"
        question, answer = f"CASE WHEN {qa} THEN {strip(f'substr({t}, 4, {at} - 4)')} ELSE '' END", f"CASE WHEN {qa} THEN {strip(f'substr({t}, {at} + 4)')} ELSE {t} END"
        prefix = let(question, lambda q: f"CASE WHEN {q} <> '' THEN 'Q. ' || {q} || chr(10) || 'A. ' ELSE '' END")
        got = lambda a, p, b: let(by_length(a, b, b, "100"), lambda x: f"CASE WHEN len({x}) > 0 THEN {x} ELSE [{a}] END")
        cuts = lambda a, p: let(f"greatest(500 - length({p}), 100)", lambda b: transform(got(a, p, b), lambda x: strip(f"{p} || {x}")))
        return let(answer, lambda a: let(prefix, lambda p: cuts(a, p)))

    return labelled(let(strip(text), lambda t: f"CASE WHEN {t} = '' THEN [] WHEN length({t}) <= 700 THEN [{t}] ELSE {long(t)} END"), "'FAQ'")


def chunks(by_structure: bool, name: str) -> str:
    flat = labelled(transform(by_length("text"), strip), "''")
    marks = f"(?m)^{W}*(?:\\p{{Nd}}{{1,2}}[.)]|[가-힣][.)]){W}"
    ways = f"WHEN s = 'qa_pair' THEN {faq('text')}"
    if by_structure:
        ways += f""" WHEN s = 'article' THEN {structural('text', articles('text'))}
        WHEN s = 'clause' THEN {structural('text', packed('text', '[①-⑮]', lambda p: f"regexp_extract({p}, '^([①-⑮])', 1)"))}
        WHEN s = 'numbered' THEN {structural('text', packed('text', marks, number_label))}"""
    return f"""WITH d AS (SELECT *, lower(coalesce(structure, 'flat')) AS s FROM bank_documents WHERE is_parsable AND text IS NOT NULL),
    p AS (SELECT *, CASE {ways} ELSE {flat} END AS pieces FROM d),
    e AS (SELECT *, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM p)
    SELECT format('{{}}_c{{:03d}}', doc_id, pos) AS chunk_id, doc_id, pos::INT AS chunk_order, piece.text AS text, piece.label AS section, length(piece.text)::INT AS char_count, {name} AS doc_display_name, doc_type, category,
      coalesce(strftime(effective_date, '%Y-%m-%d'), '') AS effective_date, source_url, s AS structure, compliance_no, is_latest FROM e"""
