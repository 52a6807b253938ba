"""The same queries in DuckDB's SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from glossa.functions.edit import PHONETIC_PAIRS
from glossa.functions.semantic import PROMPT
from glossa.operators.classify import MODEL, REASONS, URL
from glossa.sources import lexicon, phonology


def _quoted(x) -> str:
    if x is None:
        return "null"
    return str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + ")"


def _lines(text: str) -> list[list[str | None]]:
    return [[x or None for x in line.split("\t")] for line in text.splitlines()]


WORD = "word as (select distinct lower(trim(p_name)) as word from part where trim(p_name) <> '')"
_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_NORMAL = r"regexp_replace(replace(lower(" + _TRIM + r"), 'ё', 'е'), '\s+', ' ', 'g')"
_SEMANTIC = r"trim(regexp_replace(regexp_replace(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[.,;:!?()\[\]{{}}\"'']', '', 'g'), '\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _SEMANTIC + ", ' '), lambda x: x <> '')"
_MEANINGS = """meaning as (
  select conv_id, u.turn, u.text as asked, s.text as answered
  from conversations u join conversations s using (conv_id) where u.role = 'user' and s.role = 'assistant' and s.turn = u.turn + 1)"""


def _letter_words(table: str) -> str:
    return f"voc as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from {table})"


VOC = _letter_words("documents")


def _table_sql(items: str, cost: str, other: str = "") -> str:
    """CTEs to distance(a, b, n, m, d): the edit table of every pair, cell by cell; x and y are the items' lists. other: a CTE voc of words for the pairs' first side."""
    first = f"{other}, mine as (select word, {items} as u from voc)," if other else ""
    return f"""with recursive {WORD}, {first}
unit as (select word, {items} as u from word),
cell(a, b, x, y, i, j, above, here) as (
  select p.word, q.word, p.u, q.u, 1, 1, list_transform(range(0, len(q.u) + 1), lambda k: cast(k as double)), [cast(1 as double)] from {'mine' if other else 'unit'} p, unit q
  union all
  select a, b, x, y, case when j <= len(y) then i else i + 1 end, case when j <= len(y) then j + 1 else 1 end,
    case when j <= len(y) then above else here end,
    case when j <= len(y) then list_append(here, least(above[j + 1] + 1, here[j] + 1, above[j] + {cost})) else [cast(i + 1 as double)] end
  from cell where i <= len(x)),
distance as (select a, b, len(x) as n, len(y) as m, above[len(y) + 1] as d from cell where i = len(x) + 1)"""


_LETTERS = "string_split(word, '')"
_GRAPHIC_COST = "case when x[i] = y[j] then 0.0 when (j > 1 and x[i] = y[j - 1]) or (i > 1 and x[i - 1] = y[j]) then 0.5 else 1.0 end"
_GRAPHIC = _table_sql(_LETTERS, _GRAPHIC_COST)
_SIMILAR = "[" + ", ".join(_quoted(f"{a}|{b}") for p in PHONETIC_PAIRS for a, b in (p, p[::-1])) + "]"
_PHONETIC = _table_sql(_LETTERS, f"case when x[i] = y[j] then 0.0 when list_contains({_SIMILAR}, x[i] || '|' || y[j]) then 0.5 else 1.0 end")

_SYMBOLS = _values([(s, *(float(f[n]) for n in phonology.FEATURES)) for s, f in phonology.INVENTORY.items()])
_FEATURE_COLUMNS = ", ".join(f"f_{n}" for n in phonology.FEATURES)
_GAPS = " + ".join(f"least(1.0, abs(p.f_{n} - q.f_{n}) / {float(r)}) * {float(w)}" for n, (w, r) in phonology.FEATURES.items())


def _segment_sql(changed: str = "") -> str:
    """CTEs to symbol (features of each symbol) and sim(a, b, d); changed: what replaces some of the given symbols."""
    return f"""given(s, {_FEATURE_COLUMNS}) as {_SYMBOLS},
symbol as (select * from given{changed}),
sim as (select p.s as a, q.s as b, case when p.s = q.s then 0.0 else ({_GAPS}) / {float(sum(w for w, _ in phonology.FEATURES.values()))} end as d from symbol p, symbol q)"""


_SEGMENT = _segment_sql()
#: q as a sound of one's own, and w as another spelling of v.
_OWN_SOUNDS = f""" where s not in ('q', 'w') union all select 'w', {_FEATURE_COLUMNS} from given where s = 'v'
  union all select 'q', {", ".join(str(float({"place": 50, "manner": 2, "voice": 1}.get(n, 0))) for n in phonology.FEATURES)}"""
#: Of ASCII words the five affricates are the only segments of two letters.
_ALINE_TOKENS = "regexp_extract_all(word, '(ts|dz|pf|bv|kx|[^ ./()\\[\\]{}|])')"


def _aline_sql(gap: float = -0.65, expansion: float = -0.18, changed: str = "", other: str = "") -> str:
    """CTEs to score(a, b, x, y, n, m, t, raw, longest): each pair's segments x and y (texts) and whole table t, row after row from (0, 0)."""
    both = f"{other}, every as (select word, true as mine from voc union all select word, false from word)," if other else "every as (select word, true as mine from word union all select word, false from word),"
    return f"""with recursive {WORD}, {both} {_segment_sql(changed)},
unit as (select word, mine, {_ALINE_TOKENS} as u from every),
tok as (select distinct unnest(u) as t from unit),
inv as (select list(t order by t) as names from tok),
flat as (select list(coalesce(1 - d, case when p.t = q.t then 1.0 else 0.0 end) order by p.t, q.t) as sims from tok p cross join tok q left join sim on a = p.t and b = q.t),
num as (select word, mine, u as own, list_transform(u, lambda t: list_position(names, t) - 1) as u from unit, inv),
cell(a, b, xs, ys, x, y, i, j, top, above, here, t) as (
  select p.word, q.word, p.own, q.own, p.u, q.u, 1, 1, cast(null as double[]), list_transform(range(0, len(q.u) + 1), lambda k: k * {gap}::double), [{gap}::double],
    list_transform(range(0, len(q.u) + 1), lambda k: k * {gap}::double) from num p, num q where p.mine and not q.mine
  union all
  select a, b, xs, ys, x, y, case when j <= len(y) then i else i + 1 end, case when j <= len(y) then j + 1 else 1 end,
    case when j <= len(y) then top else above end, case when j <= len(y) then above else here end,
    case when j <= len(y) then list_append(here, greatest(
      above[j] + 2 * sims[x[i] * len(names) + y[j] + 1] - 1, above[j + 1] + {gap}, here[j] + {gap},
      above[j - 1] + sims[x[i] * len(names) + y[j - 1] + 1] + sims[x[i] * len(names) + y[j] + 1] - 1 + {expansion},
      top[j] + sims[y[j] * len(names) + x[i - 1] + 1] + sims[y[j] * len(names) + x[i] + 1] - 1 + {expansion})) else [(i + 1) * {gap}::double] end,
    case when j <= len(y) then t else list_concat(t, here) end
  from cell, inv, flat where i <= len(x)),
score as (select a, b, xs as x, ys as y, len(x) as n, len(y) as m, t, above[len(y) + 1] as raw, greatest(len(x), len(y)) as longest from cell where i = len(x) + 1)"""


_ALINE = _aline_sql()
_ALINE_SIMILARITY = "greatest(0.0, least(1.0, (raw + longest) / (2 * longest)))"
_USED = f"used as (select t, count(*) as n_words from (select unnest(list_distinct({_ALINE_TOKENS})) as t from voc) group by t)"
#: The walk from the words' ends: moves (name, segments of a, of b, score), tried in the order of their names.
_SIM = "coalesce((select 1 - d from sim where sim.a = {0} and sim.b = {1}), case when {0} = {1} then 1.0 else 0.0 end)"


def _walk_sql(most: int) -> str:
    """CTEs to path(a, b, nth, moves, parts): the first `most` optimal ways through the table, parts being (segment, segment) in order."""
    return f"""{_ALINE},
pairsim as (select p.t as p, q.t as q, {_SIM.format('p.t', 'q.t')} as s from tok p cross join tok q),
step(a, b, x, y, m, t, i, j, moves, parts) as (
  select a, b, x, y, m, t, n, m, '', cast([] as struct(p varchar, q varchar)[]) from score
  union all
  select w.a, w.b, x, y, m, t, i - di, j - dj, moves || move,
    list_prepend({{'p': coalesce(nullif(array_to_string(x[i - di + 1 : i], ''), ''), '-'), 'q': coalesce(nullif(array_to_string(y[j - dj + 1 : j], ''), ''), '-')}}, parts)
  from step w
  cross join (values ('1', 1, 1), ('2', 1, 0), ('3', 0, 1), ('4', 1, 2), ('5', 2, 1)) v(move, di, dj)
  left join pairsim s1 on di > 0 and dj > 0 and s1.p = x[i] and s1.q = y[j]
  left join pairsim s2 on dj = 2 and s2.p = x[i] and s2.q = y[j - 1]
  left join pairsim s3 on di = 2 and s3.p = x[i - 1] and s3.q = y[j]
  where i >= di and j >= dj and (i > 0 or j > 0)
    and abs(t[(i - di) * (m + 1) + j - dj + 1] + case move when '1' then 2 * s1.s - 1 when '2' then -0.65 when '3' then -0.65 when '4' then s1.s + s2.s - 1.18 else s1.s + s3.s - 1.18 end
      - t[i * (m + 1) + j + 1]) <= 1e-10),
path as (select * from (select a, b, parts, row_number() over (partition by a, b order by moves) as nth from step where i = 0 and j = 0) where nth <= {most})"""


def _aligned_sql(most: int, gaps: bool) -> str:
    kept = "parts" if gaps else "list_filter(parts, lambda p: p.p <> '-' and p.q <> '-')"
    return f"""{_walk_sql(most)}
      select a, b, round(any_value(raw), 9) as raw, count(*) as n, string_agg(array_to_string(list_transform({kept}, lambda p: p.p || ':' || p.q), ' '), ' / ' order by nth) as alignments
      from path join score using (a, b) group by a, b"""


#: A joined segment's features are those of its first base: an affricate or a letter.
_BASE = "regexp_extract({0}, '^(ts|dz|pf|bv|kx|.)')"
_FEATURE_LIST = "array_to_string(list_transform([{0}], lambda x: cast(cast(x as decimal(9, 3)) as varchar)), ' ')"
_UNKNOWN = "coalesce((select string_agg(u.t, '|' order by nth) from (select t, min(nth) as nth from (select unnest(unit.u) as t, generate_subscripts(unit.u, 1) as nth from unit where word = {0}) group by t) u where u.t not in (select s from symbol)), '')"

#: The marks once more, written out for SQL: mark, when, feature, the new value from v.
_MARKED = [
    ("ː", "true", "long", "1"), ("ˑ", "true", "long", "greatest(v, 0.5)"), ("ʰ", "true", "aspirated", "1"), ("ʱ", "true", "aspirated", "1"), ("ʱ", "true", "voice", "1"),
    ("ʲ", "syl = 0", "place", "v * 0.65 + 55 * 0.35"), ("ʲ", "syl = 0", "height", "greatest(v, 0.6)"), ("ʲ", "true", "back", "v * 0.65"), ("ʲ", "syl <> 0", "height", "least(1, v + 0.1)"),
    ("ʷ", "true", "round", "1"), ("ʷ", "true", "back", "greatest(v, 0.6)"), ("ˠ", "syl = 0", "place", "v * 0.7 + 21"), ("ˠ", "syl = 0", "back", "greatest(v, 0.65)"), ("ˠ", "syl <> 0", "back", "v * 0.7 + 0.3"),
    ("ˤ", "syl = 0", "place", "v * 0.7 + 28.5"), ("ˤ", "syl = 0", "back", "greatest(v, 0.75)"), ("ˤ", "syl <> 0", "back", "v * 0.7 + 0.3"), ("̃", "true", "nasal", "greatest(v, 0.8)"),
    ("˞", "true", "rhotic", "1"), ("̥", "true", "voice", "0"), ("̬", "true", "voice", "1"), ("̪", "true", "place", "v * 0.45 + 13.75"), ("̺", "true", "place", "v * 0.75 + 7.5"), ("̻", "true", "place", "v * 0.75 + 7.5"),
    ("̟", "true", "place", "v * 0.92"), ("̠", "true", "place", "v * 0.92 + 8"), ("̩", "true", "syllabic", "1"), ("̩", "true", "sonorant", "1"), ("̯", "true", "syllabic", "0"), ("̚", "true", "manner", "1"),
    ("̝", "syl = 1", "height", "least(1, v + 0.1)"), ("̝", "syl <> 1", "manner", "greatest(1, v - 0.15)"), ("̞", "syl = 1", "height", "greatest(0, v - 0.1)"), ("̞", "syl <> 1", "manner", "least(4.5, v + 0.15)"),
    ("̈", "syl = 1", "back", "v * 0.5 + 0.25"), ("̹", "true", "round", "least(1, v + 0.3)"), ("̜", "true", "round", "greatest(0, v - 0.3)"),
]


def _marked_column(feature: str) -> str:
    rules = [f"when mark = '{m}' and {w.replace('syl', 'f_syllabic')} then {x.replace('v', f'f_{feature}')}" for m, w, f, x in _MARKED if f == feature]
    value = f"case {' '.join(rules)} else f_{feature} end" if rules else f"f_{feature}"
    return f'round(cast({value} as double), 9) as "{feature}"'


_JACCARD = f"""jac as (
  select conv_id, turn, len(list_intersect(x, y)) as common, greatest(len(list_distinct(list_concat(x, y))), 1) as uni
  from (select conv_id, turn, {_TOKENS.format('asked')} as x, {_TOKENS.format('answered')} as y from meaning))"""
_COSINE = """cos as (
  select a.vec_id, case when na = 0 or nb = 0 then 0.0 else dot / (sqrt(na) * sqrt(nb)) end as c
  from (select vec_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i])) as dot,
          list_sum(list_transform(x, lambda v: v * v)) as na, list_sum(list_transform(y, lambda v: v * v)) as nb
        from (select p.vec_id, cast(p.embedding as double[]) as x, cast(q.embedding as double[]) as y
              from embeddings p join embeddings q on q.vec_id = p.vec_id + 1)) a)"""
_MOVED = "greatest(0.0, least(1.0, (c + 1) / 2))"

#: Words as the aligner reads them.
_IPA = "nfc_normalize(lower(word))"
for _from, _to in (("͜", "͡"), ("ɡ", "g"), ("ʧ", "t͡ʃ"), ("ʤ", "d͡ʒ"), ("ʦ", "t͡s"), ("ʣ", "d͡z"), ("ꭧ", "t͡s"), ("ꭦ", "d͡z"), (":", "ː"), ("''", "ˈ"), ("ˁ", "ˤ")):
    _IPA = f"replace({_IPA}, '{_from}', '{_to}')"
_AFFRICATES = "ts dz tʃ dʒ tɕ dʑ ʈʂ ɖʐ pf bv kx gɣ".split()
_MULTI = "|".join([a[0] + tie + a[1] for tie in "͜͡" for a in _AFFRICATES] + _AFFRICATES)
_APART = r"ˈˌ. \t\n\r/\[\](){}‖|"
_MODIFIERS = "".join(dict.fromkeys(m for m, *_ in _MARKED))

_PARTS = _lines(lexicon.COMPONENTS)
_RULES = _lines(lexicon.ASSIMILATIONS)
_VARIANTS = _lines(lexicon.PREFIX_VARIANTS)
_COMPONENT_SQL = f"part_of(id, category, form, meaning, meaning_en) as {_values(_PARTS)}"

#: Of sets bag(id, w): every pair that has a word in common.
_SET_PAIRS = """word as (select id, len(w) as n, unnest(w) as w from bag),
  pair as (select x.id as a, y.id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as common from word x join word y on x.w = y.w and x.id < y.id group by x.id, y.id)
  select a, b, common, n + m - common as "union" from pair"""
#: How many of voc's words have each form of a table: begin with it, end with it, or are it.
_COUNTED = """counted as (
  select f.form, count(word) as n_words from (select distinct form from {0}) f left join voc on
    case when f.form like '-%' then ends_with(word, replace(f.form, '-', '')) when f.form like '%-' then starts_with(word, replace(f.form, '-', '')) else word = f.form end
  group by f.form)"""

_RECORD = f"""{_MEANINGS},
record as (
  select conv_id, turn, case when conv_id % 7 = 0 then '' else 're/vis/ion' end as regular, {_TRIM.format('asked')} as logical,
    case when conv_id % 7 = 1 then {_TRIM.format('asked')} when conv_id % 7 = 2 then '' else {_TRIM.format('answered')} end as international,
    case when conv_id % 7 >= 4 then 're/vis/ion/u' else '' end as naturalistic, conv_id % 7 = 5 as no_parts, conv_id % 7 = 6 as use_llm,
    case when conv_id % 7 = 3 then turn % 10 * 10 end as manual
  from meaning),
judged as (
  select *, not (regular = '' or logical = '' or international = '') as enough, {_NORMAL.format('logical')} = {_NORMAL.format('international')} as same,
    1 - len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) as rule
  from (select *, {_TOKENS.format('logical')} as x, {_TOKENS.format('international')} as y from record)),
final as (
  select *, case when manual is null then rule else greatest(0.0, least(1.0, 0.7 * rule + 0.3 * (case when manual > 1 then manual / 100 else manual end))) end as final from judged)"""


def _say(key: str) -> str:
    return _quoted(REASONS[key][1])


_REASON_LIST = ", ".join(
    f"case when {when} then {_say(key)} end"
    for when, key in (
        ("regular = ''", "regular"), ("logical = ''", "logical"), ("international = ''", "international"), ("naturalistic = ''", "naturalistic"), ("no_parts", "components"),
        ("enough and same", "same"), ("enough and not same and naturalistic <> ''", "differs"), ("enough and not same and naturalistic <> ''", "provided"),
        ("enough and not same and naturalistic = ''", "no_form"),
    )
)
_PROMPT_SQL = " || chr(10) || ".join(
    _quoted(line.split("{")[0]) + " || coalesce(nullif(" + ("logical" if "{logical}" in line else "international") + ", ''), '—') || " + _quoted(line.split("}")[1]) if "{logical}" in line or "{international}" in line else _quoted(line)
    for line in PROMPT
)
#: Exact ties go up, which printf rounds to even.
_SHOWN = "printf('%.3f', 1 - d / greatest(n, m) + case when 16 * (1 - d / greatest(n, m)) in (1, 5, 9, 13) then 0.0001 else 0 end)"
_NUMBER = "regexp_replace(cast(d as varchar), '\\.0$', '')"

ORACLE_SQL = {
    "normalize_graphic": r"select p_partkey, lower(regexp_replace(p_name, '^\s+|\s+$', '', 'g')) as word from part",
    "normalize_text": f"select doc_id, {_NORMAL.format('text')} as normal from documents",
    "normalize_semantic": f"select doc_id, {_SEMANTIC.format('text')} as normal from documents",
    "tokens_semantic": f"""select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, array_to_string(t, '|') as tokens
      from (select doc_id, {_TOKENS.format('text')} as t from documents)""",
    "escape_html": "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') as escaped from pages",
    "graphic_distance": f"{_GRAPHIC} select a, b, d as distance from distance",
    "graphic_similarity": f"{_GRAPHIC} select a, b, round(1 - d / greatest(n, m), 9) as similarity from distance",
    "graphic_topk": f"{_GRAPHIC} select a, b, round(1 - d / greatest(n, m), 9) as similarity from distance where a < b order by similarity desc, a, b limit 20",
    "graphic_blocked_join": f"{_GRAPHIC} select a, b, d as distance, round(1 - d / greatest(n, m), 9) as similarity from distance where 1 - d / greatest(n, m) >= 0.6",
    "graphic_explained": f"""{_GRAPHIC} select a, b, {_SHOWN} as shown,
      concat_ws(chr(10), 'Graphic similarity', '', 'Formula:', '1 − (Levenshtein distance / max length)', '', 'Word A: ' || a, 'Word B: ' || b, '',
        'Levenshtein distance: ' || {_NUMBER}, 'Max length: ' || greatest(n, m), '', 'Result:', {_SHOWN}, '') as explanation from distance""",
    "phonetic_explained": f"""{_PHONETIC} select a, b, {_SHOWN} as shown,
      concat_ws(chr(10), 'Фонетическая похожесть', '', 'Формула:', '1 − (Psycho-Levenshtein / max token length)', '', 'IPA A: ' || a, 'IPA B: ' || b,
        'Tokens A: ' || array_to_string(string_split(a, ''), ' '), 'Tokens B: ' || array_to_string(string_split(b, ''), ' '), '', 'Similar sounds used:',
        {_quoted(", ".join(f"{p} ↔ {q}" for p, q in PHONETIC_PAIRS))}, '', 'Distance: ' || {_NUMBER}, '', 'Результат:', {_SHOWN}, '') as explanation from distance""",
    "phonetic_tokens": f"with {WORD} select word, length(word) as n, array_to_string(string_split(word, ''), '|') as tokens from word",
    "phonetic_distance": f"{_PHONETIC} select a, b, d as distance from distance",
    "phonetic_similarity": f"{_PHONETIC} select a, b, round(1 - d / greatest(n, m), 9) as similarity from distance",
    "phonetic_pairs": f"""with {VOC}, sound as (select distinct unnest(string_split(word, '')) as s from voc),
      pair as (select x, y from {_values(PHONETIC_PAIRS)} t(x, y) union select y, x from {_values(PHONETIC_PAIRS)} t(x, y))
      select x, y from pair where x in (select s from sound) and y in (select s from sound)""",
    "shift_similarity": f"""with {WORD} select a.word as a, b.word as b, cast(greatest({", ".join(
        f"case when length({x}.word) >= {s + 3} and length({y}.word) >= 3 and substr({x}.word, {s + 1}, 3) = substr({y}.word, 1, 3) then {score} else 0.0 end"
        for s, score in enumerate((1.0, 0.5, 0.4, 0.3)) for x, y in (("a", "b"), ("b", "a")))}) as double) as similarity from word a, word b""",
    "segment_distance": f"""with {VOC}, {_SEGMENT}, own as (select distinct unnest({_ALINE_TOKENS}) as t from voc)
      select a, b, round(d, 9) as distance, round(1 - d, 9) as similarity from sim where a in (select t from own)""",
    # Where a mark composes with the last letter, the first letter of what comes out is the base, without marks.
    "marked_segments": f"""with {VOC}, {_USED}, symbol(s, {_FEATURE_COLUMNS}) as {_SYMBOLS}, mark as (select unnest([{", ".join(_quoted(m) for m in dict.fromkeys(m for m, *_ in _MARKED))}]) as mark),
      token as (select s as symbol, mark, nfc_normalize(s || mark) as t from symbol cross join mark),
      based as (select token.symbol, case when token.t = token.symbol || mark then mark else '' end as mark, mark as given, case when token.t = token.symbol || mark then token.symbol else left(token.t, 1) end as base from token)
      select b.symbol, given as mark, {", ".join(map(_marked_column, phonology.FEATURES))}, coalesce(n_words, 0) as n_words
      from based b left join symbol on s = base left join used on t = b.symbol""",
    "segment_inventory": f"""with {VOC}, {_USED}
      select s as symbol, {', '.join(f'cast(f_{n} as double) as {chr(34)}{n}{chr(34)}' for n in phonology.FEATURES)}, coalesce(n_words, 0) as n_words from {_SYMBOLS} v(s, {_FEATURE_COLUMNS}) left join used on t = s""",
    "feature_weights": f"""with {VOC}, {_USED}, seen as (select * from {_SYMBOLS} v(s, {_FEATURE_COLUMNS}) join used on t = s),
      mean as ({" union all ".join(f"select '{n}' as name, round(sum(f_{n} * n_words) / sum(n_words), 6)::double as mean from seen" for n in phonology.FEATURES)})
      select name, cast(weight as double) as weight, cast(r as double) as "range", mean from {_values([(n, float(w), float(r)) for n, (w, r) in phonology.FEATURES.items()])} t(name, weight, r) join mean using (name)""",
    "aline_tokens": f"with {WORD} select word, array_to_string({_ALINE_TOKENS}, '|') as tokens from word",
    "unknown_segments": f"""with symbol(s, {_FEATURE_COLUMNS}) as {_SYMBOLS},
      word as (select distinct unnest(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' ')) as word from documents),
      ipa as (select word, regexp_extract_all({_IPA}, '((?:{_MULTI}|[^{_APART}])[{_MODIFIERS}]*)') as u from word where word <> ''),
      each as (select word, unnest(u) as t, generate_subscripts(u, 1) as nth from ipa),
      odd as (select word, t, min(nth) as nth from each where regexp_extract(t, '^({_MULTI}|.)', 1) not in (select s from symbol) group by word, t)
      select word, coalesce(string_agg(t, '|' order by nth), '') as unknown from ipa left join odd using (word) group by word""",
    "aline_scores": f"{_ALINE} select a, b, round(raw, 9) as raw, round({_ALINE_SIMILARITY}, 9) as similarity, round(1 - {_ALINE_SIMILARITY}, 9) as distance from score",
    "aline_options": f"{_aline_sql(-0.4, -0.3, _OWN_SOUNDS)} select a, b, round(raw, 9) as raw, round({_ALINE_SIMILARITY}, 9) as similarity, round(1 - {_ALINE_SIMILARITY}, 9) as distance from score",
    "aline_align": _aligned_sql(20, True),
    "aline_matches": _aligned_sql(2, False),
    "aline_explain": f"""{_walk_sql(1)},
      place as (select a, b, unnest(parts) as p, generate_subscripts(parts, 1) - 1 as place from path),
      seg as (select a, b, place, p.p as seg_a, p.q as seg_b, p.p = '-' or p.q = '-' as gap from place),
      know as (
        select seg.*, case when gap then 0.0 when seg_a = seg_b then 1.0 else coalesce(1 - d, case when fa.s is not null and fa.s = fb.s then 1.0 else 0.0 end) end as similarity,
          case when not gap and fa.s is not null then {_FEATURE_LIST.format(", ".join(f"fa.f_{n}" for n in phonology.FEATURES))} end as features_a,
          case when not gap and fb.s is not null then {_FEATURE_LIST.format(", ".join(f"fb.f_{n}" for n in phonology.FEATURES))} end as features_b
        from seg left join symbol fa on fa.s = {_BASE.format("seg_a")} left join symbol fb on fb.s = {_BASE.format("seg_b")} left join sim on sim.a = fa.s and sim.b = fb.s),
      odd as (select word, {_UNKNOWN.format("w.word")} as unknown from word w)
      select k.a, k.b, place, seg_a, seg_b, round(similarity, 9) as similarity, round(1 - similarity, 9) as distance, case when gap then 'gap' end as note, features_a, features_b,
        x.unknown as unknown_a, y.unknown as unknown_b from know k join odd x on x.word = k.a join odd y on y.word = k.b""",
    "jaccard_distance": f"with {_MEANINGS}, {_JACCARD} select conv_id, turn, round(common / uni, 9) as similarity, round(1 - common / uni, 9) as distance, common as intersection, uni as \"union\" from jac",
    "cosine_similarity": f"with {_COSINE} select vec_id, round(c, 9) as cosine from cos",
    "embedding_distance": f"with {_COSINE} select vec_id, round({_MOVED}, 9) as similarity, round(1 - {_MOVED}, 9) as distance from cos",
    "combined_distance": f"""with {_MEANINGS}, {_JACCARD}, {_COSINE},
      r as (select conv_id, turn, (conv_id * 31 + turn) % (select count(*) from embeddings) as vec_id, 1 - common / uni as rule from jac),
      c2 as (select conv_id, turn, rule, 1 - {_MOVED} as other from r left join cos using (vec_id)),
      d as (select conv_id, turn, other, coalesce(0.7 * rule + 0.3 * other, rule) as d from c2)
      select conv_id, turn, round(d, 9) as distance, round(1 - d, 9) as similarity, case when other is null then 1.0::double else 0.7::double end as rule_weight,
        case when other is null then 0.0::double else 0.3::double end as embedding_weight from d""",
    "parse_manual_response": r"""with answer as (
        select conv_id, turn, conv_id % 7 as k, length(text) % 100 as given, case when length(text) % 100 > 1 then length(text) % 100 / 100.0 else length(text) % 100 end as x,
          trim(regexp_replace(text, '[0-9\s]', '', 'g')) = '' as nothing from conversations)
      select conv_id, turn, round(case when k in (0, 2) then x when k in (1, 3) then 1 - x end, 9)::double as similarity, round(case when k in (0, 2) then 1 - x when k in (1, 3) then x end, 9)::double as distance,
        case k when 0 then 'r' || turn when 1 then '' when 2 then '' when 3 then '' end as reason, case when k <= 3 then false when k = 4 and not nothing then true end as error from answer""",
    "build_prompt": f"with {_MEANINGS} select conv_id, turn, {_PROMPT_SQL} as prompt from (select conv_id, turn, case when turn % 4 = 0 then '' else asked end as logical, answered as international from meaning)",
    "classify_words": f"""with {_RECORD}
      select conv_id, turn,
        case when not enough then 'insufficient_data' when same then 'regular_only' when naturalistic <> '' then 'double_meaning_with_modification' else 'double_meaning_modification_missing' end as classification,
        case when not enough then 'low' when same then 'high' when naturalistic <> '' then case when final >= 0.5 then 'high' else 'medium' end else case when final >= 0.5 then 'medium' else 'low' end end as confidence,
        array_to_string(list_filter([{_REASON_LIST}], lambda x: x is not null), ' ') as reasons,
        case when enough then case when manual is not null then 'rule_plus_manual_embedding' when use_llm then 'rule_fallback' else 'rule_only' end end as method
      from final""",
    "semantic_method": f"""with {_RECORD},
      vec as (select vec_id, cast(embedding as double[]) as v from embeddings),
      asked as (
        select f.*, manual is null and use_llm as asks, p.v as vx, q.v as vy from final f
        left join vec p on p.vec_id = length(f.logical) % (select count(*) from embeddings)
        left join vec q on q.vec_id = length(f.international) % (select count(*) from embeddings)),
      near as (
        select *, case when asks then list_sum(list_transform(range(1, len(vx) + 1), lambda i: vx[i] * vy[i]))
          / (sqrt(list_sum(list_transform(vx, lambda v: v * v))) * sqrt(list_sum(list_transform(vy, lambda v: v * v)))) end as c from asked),
      blended as (select *, case when c is null then final else 0.7 * rule + 0.3 * (1 - {_MOVED}) end as d from near)
      select conv_id, turn, case when manual is not null then 'rule_plus_manual_embedding' when use_llm then 'rule_plus_embedding' else 'rule_only' end as method,
        round(d, 9) as distance, round(1 - d, 9) as similarity, cast(null as varchar) as error from blended""",
    "lexicon_components": f"with {VOC}, {_COMPONENT_SQL}, {_COUNTED.format('part_of')} select id, category, form, meaning, meaning_en, n_words from part_of join counted using (form)",
    "components_by_category": f"""with {VOC}, {_COMPONENT_SQL}, {_COUNTED.format('part_of')}
      select category, count(*) as n, string_agg(form, ' ' order by o) as forms, sum(n_words)::bigint as n_words from (select *, row_number() over () as o from part_of) join counted using (form) group by category""",
    "prefix_variants": f"""with {VOC}, {_COMPONENT_SQL}, v(prefix_id, form, note, note_en) as {_values(_VARIANTS)}, {_COUNTED.format('v')}
      select id, p.form as base_form, v.form, note, note_en, n_words from part_of p join v on id = prefix_id join counted c on c.form = v.form where category like 'Приставки%'""",
    "root_assimilations": f"""with {VOC}, rule(value, label, auto_form, root_form, root_meaning, f, label_en, root_meaning_en) as {_values(_RULES)}
      select value, label, coalesce(auto_form, '') as auto_form, root_form, root_meaning, f is not null as fixed, label_en, root_meaning_en,
        case when root_form is null then 0 else (select count(*) from voc where starts_with(word, replace(root_form, '-', ''))) end as n_words from rule""",
    "localize_components": f"""with {_COMPONENT_SQL}, rule(value, label, auto_form, root_form, root_meaning, f, label_en, root_meaning_en) as {_values(_RULES)},
      v(prefix_id, form, note, note_en) as {_values(_VARIANTS)}, cat(category, category_en) as {_values(_lines(lexicon.CATEGORIES))},
      rules as (select *, row_number() over () - 1 as o from rule), parts as (select *, row_number() over () - 1 as o from part_of), notes as (select *, row_number() over () - 1 as o from v),
      made as (
        select 'u' || p_partkey as id, p_partkey % 3 = 0 as root, p_type as meaning, case when p_partkey % 3 = 0 then rules.value end as assimilation, case when p_partkey % 5 > 0 then parts.id end as source_id,
          case when p_partkey % 4 = 0 then p_brand end as category, case when p_partkey % 2 = 0 then notes.note end as note
        from part left join rules on rules.o = p_partkey % {len(_RULES)} left join parts on parts.o = p_partkey % {len(_PARTS) + 5} left join notes on notes.o = p_partkey % {len(_VARIANTS)}),
      named as (select made.*, s.id is not null as known, s.meaning as s_meaning, s.meaning_en as s_meaning_en, coalesce(nullif(s.category, ''), nullif(made.category, ''), case when root then 'root' else 'old' end) as label
        from made left join part_of s on s.id = made.source_id)
      select n.id, case when root then 'Primary root word' else coalesce(category_en, n.label) end as shown_label,
        case when root then coalesce(root_meaning_en, n.meaning, '') when known then coalesce(s_meaning_en, s_meaning) else n.meaning end as shown_meaning,
        coalesce(label_en, '') as shown_assimilation, coalesce(x.note_en, n.note, '') as shown_note
      from named n left join cat on cat.category = n.label left join rule on rule.value = n.assimilation left join (select distinct note, note_en from v) x on x.note = n.note""",
    "add_affixes": f"""with {VOC}, {_COMPONENT_SQL}, v(prefix_id, form, note, note_en) as {_values(_VARIANTS)},
      choice as (select distinct id as component_id, null as variant, form from part_of where form like '%-' union select distinct prefix_id, form, form from v)
      select word, component_id, variant, case when p.id is null then null when not two then p.form when v.form is not null then v.form end as form, case when not two or v.form is not null then p.id end as source_id,
        case when two and v.form is not null then p.form end as base_form, case when two and p.id is not null then v.note end as assimilation_note
      from (select word, c.component_id, c.variant, c.component_id in (select prefix_id from v) and q.category like 'Приставки%' as two
            from voc join choice c on starts_with(word, replace(c.form, '-', '')) left join part_of q on q.id = c.component_id)
      left join part_of p on p.id = component_id left join v on v.prefix_id = component_id and v.form = variant""",
    "add_roots": f"""with {VOC}, rule(value, label, auto_form, root_form, root_meaning, f, label_en, root_meaning_en) as {_values(_RULES)}, rules as (select *, row_number() over () - 1 as o from rule),
      made as (select word, value, case when f is not null then coalesce(root_meaning, '') when length(word) % 4 > 0 then upper(word) else '' end as meaning from voc join rules on o = length(word) * 7 % {len(_RULES)})
      select word, value as assimilation, case when meaning <> '' then word end as form, nullif(meaning, '') as meaning from made""",
    "component_summary": "select p_partkey, case when p_size % 5 = 0 then '—' else p_brand || ' / ' || p_type end as summary, case when p_size % 5 = 0 then '—' else p_type end as rest from part",
    "state_roundtrip": "select doc_id, text, '1' as box, true as plain from documents",
    "session_roundtrip": f"""with {_MEANINGS}
      select conv_id, turn, case when conv_id % 7 = 0 then '' else 're/vis/ion' end as regular_word, asked as logical_meaning,
        case when conv_id % 7 >= 4 then 're/vis/ion/u' else '' end as naturalistic_word, conv_id % 7 = 6 as use_llm, '{URL}' as ollama_url, '{MODEL}' as embedding_model,
        case when conv_id % 7 = 3 then 'distance: ' || turn % 10 || '0' else '' end as manual_response from meaning""",
    "migrated_components": f"""with {_MEANINGS}
      select conv_id, turn, 0::bigint as place, '1' as id, 'root' as type, 'root' as label, substr(asked, 1, 5) as form, cast(null as varchar) as category, 'n' as assimilation_note from meaning
      union all select conv_id, turn, 1, '2', 'component', case when turn % 3 = 0 then 'C' else 'old' end, '-er', case turn % 3 when 0 then 'C' when 1 then '' end, case when turn % 3 = 2 then 'raw' else 'n' end from meaning""",
    "has_value": r"select doc_id, regexp_matches(coalesce(text, ''), '\S') as has_value, regexp_matches(coalesce(substr(text, 1, 1), ''), '\S') as starts_with_value from documents",
    "blank_words": "select p_partkey, case when p_size % 3 = 2 then 1.0::double end as similarity, case when p_size % 3 = 2 then '1.000' else 'Please fill in both words' end as shown from part",
    "number_helpers": """select p_partkey, round(case when p_size % 7 in (0, 1) then 0.0 else greatest(0.0, least(1.0, (p_size - 25) / 20)) end, 9)::double as clamped,
      round(case when p_size % 7 in (0, 1) then 0.0 else p_size * 0.65 + 19.25 end, 9)::double as moved, true as equal, false as apart from part""",
    "sound_matches": f"{_aline_sql(other=_letter_words('benchmark'))} select a, b, round(raw, 9) as raw, round({_ALINE_SIMILARITY}, 9) as similarity from score where {_ALINE_SIMILARITY} >= 0.8",
    "aligned_rows": f"{_walk_sql(20)} select a, b, nth - 1 as nth, unnest(generate_series(0, len(parts) - 1)) as place, unnest(list_transform(parts, lambda p: p.p)) as seg_a, unnest(list_transform(parts, lambda p: p.q)) as seg_b from path",
    "graphic_lookup": f"{_table_sql(_LETTERS, _GRAPHIC_COST, _letter_words('benchmark'))} select a, b, d as distance from distance where d <= 5.5",
    "graphic_within": f"{_GRAPHIC} select a, b, case when d <= 2 then d end as distance from distance",
    "similar_turns": f"with bag as (select conv_id * 1000 + turn as id, list_distinct({_TOKENS.format('text')}) as w from conversations), {_SET_PAIRS} where 6 * common >= n + m - common",
    "similar_documents": f"with bag as (select min(doc_id) as id, list_distinct({_TOKENS.format('text')}) as w from documents group by text), {_SET_PAIRS} where 2 * common >= n + m - common",
    "nearest_vectors": """with v as (select vec_id, cast(embedding as double[]) as x from embeddings),
      unit as (select vec_id, list_transform(x, lambda k: k / sqrt(list_sum(list_transform(x, lambda k: k * k)))) as x from v),
      near as (select p.vec_id as id, q.vec_id as other, round(list_dot_product(p.x, q.x), 9) as cosine from unit p join unit q on p.vec_id <> q.vec_id)
      select id, row_number() over (partition by id order by cosine desc, other) as rank, other, cosine from near qualify rank <= 5""",
    "translated_parts": """select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 4 = 0 then p_type when p_partkey % 5 < 3 then p_brand else cast(p_partkey as varchar) end as shown,
      case when p_partkey % 3 = 0 then 'eo' when p_partkey % 4 = 0 then 'de' when p_partkey % 5 < 3 then 'ru' end as lang from part""",
    "embedding_requests": """select conv_id, turn, case when length(text) % 10 < 9 then concat_ws(' ', length(text), length(text) - length(replace(text, ' ', '')), 1) end as vector,
      case when length(text) % 10 = 9 then 'Embedding request failed: 400 Bad Request — ' || left('too odd: ' || text, 200) end as error from conversations""",
}
