"""Retrieval: expansion, scoring, and packing under a budget of characters.

The query of a conversation is its last user turn; its memory is what came before. Scores are compared as whole millionths, so both
engines break ties alike.
"""

from __future__ import annotations

from ..config import DEFAULT as C
from ..functions import text as T
from ..functions import vocab as V
from ..sources.tables import shared
from . import fixtures as X
from .catalog import PLANS, Plan, plan
from .store import ctes, idf, lexicon, parts, real, scaled, store


def asking(d):
    last = f"SELECT conv_id, max(turn) AS last_turn FROM {X.turns(d)} t WHERE role = 'user' GROUP BY conv_id"
    return f"SELECT c.conv_id, c.text AS query, c.turn AS query_turn FROM {X.turns(d)} c JOIN ({last}) l ON c.conv_id = l.conv_id AND c.turn = l.last_turn WHERE c.role = 'user'"


def queries(d): return f"queries AS ({asking(d)})"


def synonyms(d):
    rows = ", ".join(f"('{k}', '{s}')" for k, ss in V.SYNONYMS.items() for s in ss)
    return f"synonyms AS (SELECT {T.stem(d, 'k')} AS token, {T.stem(d, 's')} AS synonym FROM {d.values(rows, 'k, s')} v)"


def remembered(d):
    """The facts that live when the query comes."""
    return """SELECT i.conv_id, i.n AS seq, i.turn, i.role, i.text, i.w FROM killers k JOIN info i ON k.conv_id = i.conv_id AND k.n = i.n JOIN queries q ON i.conv_id = q.conv_id
LEFT JOIN occ o ON k.conv_id = o.conv_id AND k.killer = o.n WHERE i.turn < q.query_turn AND (k.killer IS NULL OR o.turn >= q.query_turn)"""


def memory(d) -> list[tuple[str, str]]:
    return [*parts(d)[:-1], ("queries", asking(d)), ("memory", remembered(d))]


def searching(d, weight="1.0"):
    """scored(conv_id, seq, turn, text, w, query, score, subject, total, r, best): facts that share a token with their query, best first."""
    about = d.has("lower(query)", "'user'")
    party = f"({d.has('lower(text)', chr(39) + 'the user' + chr(39))} OR {d.has('lower(text)', chr(39) + 'the team' + chr(39))}) AND NOT {d.re_test('lower(text)', r'the (user|team)\x27s [^\s]+\x27s')}"
    focus = f"CASE WHEN {about} AND NOT ({party}) THEN {1 - C.subject_focus} ELSE 1.0 END"
    length = f"sqrt({C.reference_length}.0 / greatest(length(text), {C.reference_length}))"
    if d.name == "spark":
        return looking(d, weight, about, focus, length)
    return real(d, f"""WITH {synonyms(d)}, {ctes(lexicon(d, 'memory'))}, {ctes(wanted(d))},
hits AS (SELECT p.conv_id, p.seq, total, {d.sum_sorted(idf())} AS overlap FROM postings p JOIN asked a ON p.conv_id = a.conv_id AND p.token = a.token
         JOIN df f ON p.conv_id = f.conv_id AND p.token = f.token JOIN sizes s ON p.conv_id = s.conv_id GROUP BY p.conv_id, p.seq, total),
valued AS (SELECT k.conv_id, k.seq, k.turn, k.text, k.w, query, total, {scaled(f'overlap * {weight} * ({focus}) * {length}')} AS score,
           CASE WHEN {about} AND {d.has('lower(text)', chr(39) + 'user' + chr(39))} THEN 1 ELSE 0 END AS subject FROM hits h JOIN memory k ON h.conv_id = k.conv_id AND h.seq = k.seq JOIN queries q ON h.conv_id = q.conv_id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, subject DESC, seq DESC) AS r, max(score) OVER (PARTITION BY conv_id) AS best FROM valued""")


def looking(d, weight, about, focus, length):
    """searching for Spark: a conversation's facts go to its query once. Only words that both have are counted; a fact has no word twice, so their df is the one of all postings."""
    lists = "SELECT conv_id, collect_set(token) AS tokens FROM asked GROUP BY conv_id"
    facts = "SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT /*+ REPARTITION(conv_id) */ conv_id, seq, turn, text, w FROM memory) m"
    common = f"SELECT f.conv_id, seq, total, {d.explode(d.common('w', 'tokens'), 'token')} FROM facts f JOIN lists l ON f.conv_id = l.conv_id"
    counted = f"SELECT *, count(*) OVER (PARTITION BY conv_id, token) AS df FROM ({common}) c"
    return f"""WITH {synonyms(d)}, {ctes(wanted(d))}, lists AS ({lists}), facts AS ({facts}),
hits AS (SELECT conv_id, seq, {d.sum_sorted(idf())} AS overlap FROM ({counted}) c GROUP BY conv_id, seq),
valued AS (SELECT k.conv_id, k.seq, k.turn, k.text, k.w, query, total, {scaled(f'overlap * {weight} * ({focus}) * {length}')} AS score,
           CASE WHEN {about} AND {d.has('lower(text)', chr(39) + 'user' + chr(39))} THEN 1 ELSE 0 END AS subject FROM hits h JOIN facts k ON h.conv_id = k.conv_id AND h.seq = k.seq JOIN queries q ON h.conv_id = q.conv_id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, subject DESC, seq DESC) AS r, max(score) OVER (PARTITION BY conv_id) AS best FROM valued"""


def wanted(d) -> list[tuple[str, str]]:
    return [("typed", f"SELECT conv_id, {d.explode(T.words(d, 'query'), 'token')} FROM queries"), ("asked", "SELECT conv_id, token FROM typed UNION SELECT t.conv_id, s.synonym FROM typed t JOIN synonyms s ON t.token = s.token")]


def expanded(d):
    """queries, knots (the facts that live when the query comes), postings, df, sizes, and asked(conv_id, token)."""
    return f"WITH {shared(d, *memory(d))}, knots AS (SELECT * FROM memory),\n{synonyms(d)}, {ctes(lexicon(d))}, {ctes(wanted(d))}"


def scores(d):
    """queries, knots, sizes, scored, and anchors(conv_id, anchor): each conversation's most important fact, and the newest of such."""
    best = f"SELECT conv_id, {d.max_by('text', 'imp', 'seq')} AS anchor FROM (SELECT conv_id, seq, text, {scaled(T.importance(d, 'text'), 1000)} AS imp FROM memory) i GROUP BY conv_id"
    return f"WITH {shared(d, *memory(d), ('scored', searching(d)), ('anchors', best))}, knots AS (SELECT * FROM memory), {ctes(lexicon(d)[-1:])}"


def fold(d, items, budget, start=None):
    """Greedy filling: items in order, each costs its length and a line end after the first; what doesn't fit is skipped."""
    cost = "length(x) + CASE WHEN acc.used > 0 THEN 1 ELSE 0 END"
    body = f"CASE WHEN acc.used + {cost} <= {budget} THEN {d.struct(used=d.long(f'acc.used + {cost}'), lines=d.append('acc.lines', 'x'))} ELSE acc END"
    return d.fold(items, start or d.struct(used=d.long(0), lines=d.empty()), "acc", "x", body)


def kept(floor=C.floor): return f"(total > {C.floor_max_knots} OR score >= {floor} * best)" if floor else "TRUE"


def packed(d, budget=C.budget, floor=C.floor, condition="TRUE", base=None, source="scored"):
    """packs(conv_id, query, lines): the pack of each conversation, or its newest knot where nothing matches."""
    lines = f"SELECT conv_id, {d.collect('text', 'r')} AS items FROM {source} o WHERE {kept(floor)} AND {condition} AND length(text) <= {budget} GROUP BY conv_id"
    newest = f"SELECT conv_id, {d.max_by('text', 'seq')} AS text FROM knots GROUP BY conv_id"
    return f"""{base or scores(d)},
packs AS (SELECT q.conv_id, q.query, CASE WHEN items IS NULL THEN CASE WHEN length(n.text) <= {budget} THEN {d.array('n.text')} ELSE {d.empty()} END ELSE ({fold(d, 'items', budget)}).lines END AS lines
          FROM queries q LEFT JOIN ({lines}) l ON q.conv_id = l.conv_id LEFT JOIN ({newest}) n ON q.conv_id = n.conv_id)"""


def joined(d, lines="lines"): return d.join(lines, d.chr(10))


@plan("conversations")
def q_pack(d): return f"{packed(d)} SELECT conv_id, {joined(d)} AS pack, {d.size('lines')} AS n_lines FROM packs"


@plan("conversations")
def q_expand(d): return f"{expanded(d)} SELECT conv_id, token FROM asked"


PLANS["join_synonyms"] = Plan("join_synonyms", ("conversations",), q_expand)


@plan("conversations")
def flt_candidates_lexical(d): return f"{expanded(d)} SELECT DISTINCT p.conv_id, p.seq FROM postings p JOIN asked a ON p.conv_id = a.conv_id AND p.token = a.token"


PLANS["join_postings"] = Plan("join_postings", ("conversations",), flt_candidates_lexical)


@plan("conversations")
def q_score(d): return f"{scores(d)} SELECT conv_id, seq, score, subject FROM scored"


@plan("conversations")
def win_rank(d): return f"{scores(d)} SELECT conv_id, seq, r FROM scored"


@plan("conversations")
def q_about_user(d): return f"WITH {queries(d)} SELECT conv_id, {d.has('lower(query)', chr(39) + 'user' + chr(39))} AS about_user FROM queries"


@plan("conversations")
def q_floor(d): return f"{scores(d)} SELECT conv_id, seq FROM scored WHERE score >= {C.floor} * best"


@plan("conversations")
def q_pack_fallback(d): return f"{packed(d, condition='score < 0')} SELECT conv_id, {joined(d)} AS pack FROM packs"


PLANS["win_newest"] = Plan("win_newest", ("conversations",), q_pack_fallback)


@plan("conversations")
def q_explain(d):
    inside = f"SELECT conv_id, {d.explode('lines', 'text')} FROM packs"
    return f"{packed(d)} SELECT k.conv_id, k.seq, coalesce(s.score, 0) AS score, i.text IS NOT NULL AS in_pack FROM knots k LEFT JOIN scored s ON k.conv_id = s.conv_id AND k.seq = s.seq LEFT JOIN ({inside}) i ON k.conv_id = i.conv_id AND k.text = i.text"


@plan("conversations")
def q_hits(d):
    """Reads count: each packed knot is hit once by its conversation's query."""
    inside = f"SELECT conv_id, {d.explode('lines', 'text')} FROM packs"
    return f"{packed(d)} SELECT k.conv_id, k.seq, count(*) AS hits FROM knots k JOIN ({inside}) i ON k.conv_id = i.conv_id AND k.text = i.text GROUP BY k.conv_id, k.seq"


def importances(d): return f"imps AS (SELECT conv_id, seq, text, {scaled(T.importance(d, 'text'), 1000)} AS imp FROM knots)"


@plan("conversations")
def win_candidates(d): return f"{expanded(d)}, {importances(d)} SELECT conv_id, seq, imp FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY imp DESC, seq DESC) AS r FROM imps) x WHERE r <= 5"


@plan("conversations")
def win_anchor(d): return f"{scores(d)} SELECT conv_id, anchor FROM anchors"


RESERVE = 0.3


def reserve(d, room):
    """(conv_id, res): the most important facts within a room, which end at 90 % of it; what doesn't fit is skipped."""
    cost = "length(x) + CASE WHEN acc.used > 0 THEN 1 ELSE 0 END"
    body = f"CASE WHEN acc.used * 10 < {room * 9} AND acc.used + {cost} <= {room} THEN {d.struct(used=d.long(f'acc.used + {cost}'), lines=d.append('acc.lines', 'x'))} ELSE acc END"
    return f"SELECT conv_id, {d.fold(d.collect('text', '-imp', '-seq'), d.struct(used=d.long(0), lines=d.empty()), 'acc', 'x', body)} AS res FROM imps WHERE length(text) <= {room} GROUP BY conv_id"


def blank(d): return d.struct(used=d.long(0), lines=d.empty())


@plan("conversations")
def q_reserve(d):
    """A share of the budget goes to the most important facts first, up to 90 % of it; then the ranked ones. Without a match the newest fact is the pack."""
    ranked = f"SELECT conv_id, {d.collect('text', 'r')} AS items FROM scored WHERE {kept()} AND length(text) <= {C.budget} GROUP BY conv_id"
    newest = f"SELECT conv_id, {d.max_by('text', 'seq')} AS text FROM knots GROUP BY conv_id"
    start = f"coalesce(res, {blank(d)})"
    fresh = d.filter("items", "y", f"NOT {d.contains(start + '.lines', 'y')}")
    out = f"CASE WHEN items IS NULL THEN CASE WHEN length(n.text) <= {C.budget} THEN n.text ELSE '' END ELSE {joined(d, '(' + fold(d, fresh, C.budget, start) + ').lines')} END"
    return f"{scores(d)}, {importances(d)} SELECT q.conv_id, coalesce({out}, '') AS pack FROM queries q LEFT JOIN ({ranked}) i ON q.conv_id = i.conv_id LEFT JOIN ({reserve(d, int(C.budget * RESERVE))}) f ON q.conv_id = f.conv_id LEFT JOIN ({newest}) n ON q.conv_id = n.conv_id"


@plan("conversations")
def q_adaptive(d):
    """The pack, then a bridge's proposals. Queries that need wide retrieval get the wide net's, more of them, and a larger budget.

    The plain net's proposals are the newest facts, the wide one's the most important ones among the candidates.
    """
    wide = T.needs_wide(d, "query")
    budget = f"(CASE WHEN wide THEN {int(C.budget * C.bridge_multiplier)} ELSE {C.budget} END)"
    ranked = f"SELECT conv_id, {d.collect('text', 'r')} AS items FROM scored WHERE {kept()} GROUP BY conv_id"
    newest = f"SELECT conv_id, {d.max_by('text', 'seq')} AS text FROM knots GROUP BY conv_id"
    place = "CASE WHEN wide THEN important ELSE latest END"
    ordered = "SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY imp DESC, seq DESC) AS important, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS latest FROM imps"
    nets = f"SELECT q.conv_id, {d.collect('text', place)} AS extra FROM (SELECT conv_id, {wide} AS wide FROM queries) q JOIN ({ordered}) p ON q.conv_id = p.conv_id WHERE {place} <= CASE WHEN wide THEN {C.bridge_k_wide} ELSE {C.bridge_k} END GROUP BY q.conv_id"
    lexical = f"CASE WHEN items IS NULL THEN {fold(d, d.array('n.text'), budget)} ELSE {fold(d, 'items', budget)} END"
    first = f"SELECT q.conv_id, {wide} AS wide, items, n.text FROM queries q LEFT JOIN ({ranked}) r ON q.conv_id = r.conv_id LEFT JOIN ({newest}) n ON q.conv_id = n.conv_id"
    base = f"SELECT conv_id, wide, CASE WHEN items IS NULL AND n.text IS NULL THEN {blank(d)} ELSE {lexical} END AS acc0 FROM ({first}) n"
    fresh = d.filter(f"coalesce(extra, {d.empty()})", "y", f"NOT {d.contains('acc0.lines', 'y')}")
    return f"{scores(d)}, {importances(d)}, first_part AS ({base}), nets AS ({nets}) SELECT b.conv_id, b.wide, CASE WHEN b.wide THEN {C.bridge_k_wide} ELSE {C.bridge_k} END AS k, {joined(d, '(' + fold(d, fresh, budget, 'acc0') + ').lines')} AS pack FROM first_part b LEFT JOIN nets e ON b.conv_id = e.conv_id"


PLANS["br_adaptive_packer"] = Plan("br_adaptive_packer", ("conversations",), q_adaptive)


def bridge(d): return f"SELECT conv_id, {d.collect('text', 'imp_r')} AS extra FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY imp DESC, seq DESC) AS imp_r FROM imps) x WHERE imp_r <= {C.bridge_k} GROUP BY conv_id"


@plan("conversations")
def q_bridge_fill(d):
    """A bridge's proposals (here: the most important knots) fill what the pack left, without repeats."""
    fresh = d.filter(f"coalesce(extra, {d.empty()})", "y", f"NOT {d.contains('lines', 'y')}")
    start = d.struct(used=d.long(f"length({joined(d)})"), lines="lines")
    return f"{packed(d)}, {importances(d)} SELECT p.conv_id, {joined(d, '(' + fold(d, fresh, C.budget, start) + ').lines')} AS pack FROM packs p LEFT JOIN ({bridge(d)}) b ON p.conv_id = b.conv_id"


PLANS["br_packer"] = Plan("br_packer", ("conversations",), q_bridge_fill)


@plan("conversations")
def q_slots(d):
    """Two slots for knots that only the bridge proposes, before the lexical ones."""
    only = f"SELECT i.conv_id, i.text, row_number() OVER (PARTITION BY i.conv_id ORDER BY imp DESC, i.seq DESC) AS r FROM imps i LEFT JOIN scored s ON i.conv_id = s.conv_id AND i.seq = s.seq WHERE s.seq IS NULL"
    slots = f"SELECT conv_id, {d.collect('text', 'r')} AS slots FROM ({only}) o WHERE r <= 2 GROUP BY conv_id"
    ranked = f"SELECT conv_id, {d.collect('text', 'r')} AS items FROM scored GROUP BY conv_id"
    both = f"SELECT q.conv_id, coalesce(items, {d.empty()}) AS items, coalesce(slots, {d.empty()}) AS slots FROM queries q LEFT JOIN ({ranked}) r ON q.conv_id = r.conv_id LEFT JOIN ({slots}) s ON q.conv_id = s.conv_id"
    return f"{scores(d)}, {importances(d)} SELECT conv_id, {joined(d, '(' + fold(d, 'items', C.budget, fold(d, 'slots', C.budget)) + ').lines')} AS pack FROM ({both}) b"


@plan("conversations")
def join_anti_lexical(d): return f"{scores(d)} SELECT k.conv_id, k.seq FROM knots k JOIN queries q ON k.conv_id = q.conv_id LEFT JOIN scored s ON k.conv_id = s.conv_id AND k.seq = s.seq WHERE s.seq IS NULL"


@plan("conversations")
def q_coverage(d):
    """Knots by words new to the pack so far, ties to shorter ones: a fold that adds the best knot of those left, until nothing fits."""
    items = f"SELECT conv_id, {d.collect(d.struct(text='text', w='w'), 'seq')} AS ks FROM knots GROUP BY conv_id"
    steps = d.array(*(d.long(k) for k in range(-(-(C.budget + 1) // (C.min_chars + 1)))))
    # one number orders candidates: new words, then shorter texts, then the earlier knot
    gain = f"({d.size(d.minus('k.w', 'acc.seen'))}) * 1000 - length(k.text)"
    left = d.filter("ks", "k", f"NOT {d.contains('acc.lines', 'k.text')} AND acc.used + length(k.text) + 1 <= {C.budget + 1}")
    best = d.fold(left, d.struct(g=d.long(-(10**9)), text="''", w=d.empty()), "m", "k", f"CASE WHEN {gain.replace('acc.', 'acc.')} > m.g THEN {d.struct(g=d.long(gain), text='k.text', w='k.w')} ELSE m END")
    take = d.transform(d.array(best), "b", f"CASE WHEN b.text = '' THEN acc ELSE {d.struct(used=d.long('acc.used + length(b.text) + 1'), lines=d.append('acc.lines', 'b.text'), seen=('array_union(acc.seen, b.w)' if d.name == 'spark' else 'list_distinct(list_concat(acc.seen, b.w))'))} END")
    out = d.fold(steps, d.struct(used=d.long(0), lines=d.empty(), seen=d.empty()), "acc", "i", f"({take})[{0 if d.name == 'spark' else 1}]")
    return f"{expanded(d)} SELECT conv_id, {joined(d, '(' + out + ').lines')} AS pack FROM ({items}) x"


# prompts

@plan("conversations")
def win_recency(d): return f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {X.turns(d)} t) x WHERE r <= 6"


@plan("conversations")
def q_prompt(d):
    recent = f"SELECT conv_id, {d.collect('concat(role, chr(58), text)' if d.name == 'duckdb' else 'concat(role, char(58), text)', 'turn')} AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {X.turns(d)} t) x WHERE r <= 6 GROUP BY conv_id"
    whole = f"SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM {X.turns(d)} t GROUP BY conv_id"
    prompt = f"concat('Known facts:', {d.chr(10)}, {joined(d)}, {d.chr(10)}, {d.join('recent', d.chr(10))})"
    return f"{packed(d)} SELECT p.conv_id, {prompt} AS prompt, CAST(floor(length({prompt}) / 4) AS BIGINT) AS tokens, CAST(floor(chars / 4) AS BIGINT) AS full_tokens FROM packs p JOIN ({recent}) r ON p.conv_id = r.conv_id JOIN ({whole}) w ON p.conv_id = w.conv_id"


@plan("conversations")
def q_modes(d):
    modes = d.values("('regular'), ('augment'), ('replace')", "mode")
    return f"{packed(d)} SELECT conv_id, mode, CASE WHEN mode = 'regular' THEN query WHEN mode = 'augment' THEN concat({joined(d)}, {d.chr(10)}, query) ELSE {joined(d)} END AS context FROM packs CROSS JOIN {modes} m"


@plan("conversations")
def win_prefix_scaling(d):
    """Knots of each conversation's first 2, 4 and 8 turns."""
    steps = d.values("(2), (4), (8)", "n")
    return f"{expanded(d)} SELECT k.conv_id, n, count(*) AS knots, CAST(sum(length(text)) AS BIGINT) AS chars FROM knots k CROSS JOIN {steps} s WHERE k.turn < n GROUP BY k.conv_id, n"
