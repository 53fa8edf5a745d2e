"""Sources, tokenising, normalising and predicates: one row per text."""

from __future__ import annotations

from ..config import DEFAULT as C
from ..functions import text as T
from ..functions import vocab as V
from ..functions.dialect import quoted
from . import fixtures as X
from .catalog import PLANS, Plan, plan


def per_text(name: str, **columns):
    """A plan that gives columns of each text."""
    def sql(d):
        return f"SELECT id, {', '.join(f'{f(d, chr(116) + chr(101) + chr(120) + chr(116))} AS {c}' for c, f in columns.items())} FROM {X.texts(d)} t"

    PLANS[name] = Plan(name, ("conversations",), sql)


per_text("str_tokenize", tokens=T.tokens, words=T.words)
per_text("str_quote_depth", depth=T.quote_depth)
per_text("str_sentences", sentences=T.sentences)
per_text("flt_question", question=T.is_question)
per_text("flt_addresses_other", addressed=T.addresses_other)
per_text("str_strip_openers", stripped=T.strip_openers)
per_text("flt_has_payload", payload=T.has_payload)
per_text("flt_is_fact", fact=T.is_fact, core_fact=lambda d, t: T.is_fact(d, t, V.CORE))
per_text("str_frame", frame=T.frame, ids=lambda d, t: T.identifiers(d, T.frame(d, t)))
per_text("str_importance", importance=lambda d, t: f"CAST(floor({T.importance(d, t)} * 1000 + 0.5) AS BIGINT)")
per_text("str_third_person", knot=T.third_person, knot_of_speaker=lambda d, t: T.third_person(d, t, "Carmen"))
per_text("str_bridge_needs_wide", wide=T.needs_wide)
per_text("str_clip_words", clipped=T.clip_words)
per_text("str_weave_tokens", tokens=T.weave_tokens)
per_text("str_attribute", attributed=lambda d, t: f"CASE WHEN left({T.trim(d, t)}, 1) IN ('\"', '“') THEN concat('the user says ', {T.trim(d, t)}) ELSE {t} END")


@plan("conversations")
def str_stem(d):
    return f"SELECT token, {T.stem(d, 'token')} AS stem, count(*) AS n FROM (SELECT {d.explode(T.tokens(d, 'text'), 'token')} FROM {X.texts(d)} t) x GROUP BY token"


@plan()
def str_vocab_norm(d):
    rows = ", ".join(f"('{k}', '{w}')" for k, ws in V.CATEGORIES.items() for w in ws.split())
    return f"SELECT kind, {d.collect('stem', 'stem')} AS stems FROM (SELECT DISTINCT kind, {T.stem(d, 'word')} AS stem FROM {d.values(rows, 'kind, word')} v) x GROUP BY kind"


@plan("conversations")
def src_turns(d):
    who = "lower(trim(role))"
    return f"SELECT conv_id, turn, CASE WHEN {who} IN ('user', 'you', '') THEN 'the user' ELSE trim(role) END AS subject, {who} = 'user' AS kept, length(text) AS observed FROM conversations"


@plan("conversations")
def src_add(d):
    return f"SELECT * FROM (SELECT conv_id, turn, left({T.trim(d, 'text')}, {C.max_chars}) AS knot FROM conversations) k WHERE length(knot) >= {C.min_chars}"


@plan("labels")
def src_coerce(d):
    return "SELECT doc_id, coalesce(CAST(quality AS STRING), '') AS text FROM labels UNION ALL SELECT CAST(-1 AS BIGINT), coalesce(CAST(NULL AS STRING), '')"


@plan("pages")
def src_markup_clean(d):
    return f"SELECT page_id, {T.clean_markup(d, 'html')} AS cleaned FROM pages"


@plan("conversations")
def src_dialog_pairs(d):
    p = f"SELECT conv_id, turn, text AS utterance, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations"
    return f"SELECT conv_id, turn, utterance, reply, {d.hash('utterance')} AS shuffled FROM ({p}) p WHERE turn % 2 = 0 AND length(utterance) >= 15 AND length(reply) >= 10 AND NOT {d.has('utterance', d.chr(9))}"


@plan("conversations")
def src_daily_clean(d):
    claim = d.re_test("text", r"(?i)(^|[^a-z])(i am a|my name is|i live in)($|[^a-z])")
    return f"SELECT id, text FROM {X.texts(d)} t WHERE NOT {claim}"


@plan("documents")
def src_corpus(d):
    """Documents in order until a cap on characters is reached: sums of blocks of ids, then sums within a block."""
    blocks = "SELECT CAST(floor(doc_id / 1000) AS BIGINT) AS block, sum(length(text)) AS size FROM documents GROUP BY 1"
    skips = f"SELECT block, coalesce(CAST(sum(size) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS skip FROM ({blocks}) b"
    rows = "SELECT doc_id, CAST(floor(doc_id / 1000) AS BIGINT) AS block, coalesce(CAST(sum(length(text)) OVER (PARTITION BY CAST(floor(doc_id / 1000) AS BIGINT) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS here FROM documents"
    return f"SELECT doc_id, skip + here AS before FROM ({rows}) r JOIN ({skips}) s ON r.block = s.block WHERE skip + here < 1000000"


@plan("conversations")
def str_classify_gap(d):
    low = T.tokens(d, "text")
    return f"""SELECT id, CASE WHEN {T.has_payload(d, 'text')} THEN 'direct' WHEN {d.any(low, 'x', f"x IN ({quoted(V.PRONOUNS)})")} THEN 'pronoun' WHEN {d.any(low, 'x', f"x IN ({quoted(V.HYPERNYMS)})")} THEN 'hypernym'
        WHEN {d.any(low, 'x', f"x IN ({quoted(V.CONSEQUENCE)})")} THEN 'consequence' WHEN {d.any(low, 'x', ' OR '.join(d.starts('x', f"'{v}'") for v in V.SCRIPT_VERBS))} THEN 'script' ELSE 'other' END AS gap FROM {X.texts(d)} t"""


@plan("conversations")
def ev_gap_helpers(d):
    raw = T.raw_tokens(d, "text")
    return f"""SELECT id, {d.size(d.filter(d.after_first(raw), 'x', d.re_test('x', '^[A-Z][a-z]')))} AS proper, {d.has('text', T.possessive(d))} AS possessive,
        {d.re_test('text', '["“”]')} AS quoted, {d.re_test('text', '[0-9]')} AS numbered, {d.size(d.filter(T.tokens(d, 'text'), 'x', f'length(x) >= 6 AND x NOT IN ({quoted(V.STOP)})'))} AS long_words FROM {X.texts(d)} t"""


ANSWERS = ["dog, cat\nhorse; Running boats, the, ox, dog", "", "one two, three", "cats, cats, CATS, bird"]


@plan()
def str_parse_csv_answer(d):
    parts = d.transform(d.split("answer", r"[,;\n]"), "x", f"lower({T.trim(d, 'x')})")
    ok = d.filter(parts, "x", f"{d.re_test('x', r'^[a-z-]+$')} AND length(x) >= 3 AND x NOT IN ({quoted(V.STOP)})")
    return f"SELECT id, {d.slice(d.distinct(d.transform(ok, 'x', T.stem(d, 'x'))), 1, 12)} AS stems FROM {d.values(X.rows(d, list(enumerate(ANSWERS))), 'id, answer')} a"


PICKS = ["3, 1, 3, 99", "none", "2 then 5 and 1", "0 7"]


@plan()
def str_parse_picks(d):
    n = d.transform(d.re_all("answer", "[0-9]+"), "x", d.int_of("x"))
    return f"SELECT id, {d.slice(d.distinct(d.filter(n, 'x', 'x BETWEEN 1 AND 6')), 1, 3)} AS picks FROM {d.values(X.rows(d, list(enumerate(PICKS))), 'id, answer')} a"


# roleplay

RP = {"place": r"(?i)(^|[^a-z])(in|at|near|inside) the [a-z]", "holds": r"(?i)(^|[^a-z])(has|holds|carries|wears|owns) ", "kin": r"(?i)(^|[^a-z])(sister|brother|mother|father|wife|husband|son|daughter|neighbour)s?($|[^a-z])",
      "condition": r"(?i)(^|[^a-z])(hurt|sick|tired|wounded|allergic|late)($|[^a-z])", "promise": r"(?i)(^|[^a-z])(promise|swear|will never|vow)"}


def rp_fact(d, t): return "(" + " OR ".join([*(d.re_test(t, p) for p in RP.values()), d.re_test(t, "[0-9]"), T.marked(d, t, V.MARKERS)]) + ")"


def rp_capitals_of(d, t):
    """Capitalised words of 3 letters or more, neither at the start nor after . ! ? or a quotation mark."""
    found = d.re_all(t, r"[^.!?\"“\s][,;:]?\s+[A-Z][\p{L}]{2,}")
    return d.transform(found, "x", d.re_sub("x", r"^[^\s]+\s+", ""))


per_text("rp_is_fact", fact=rp_fact, **{k: (lambda p: lambda d, t: d.re_test(t, p))(p) for k, p in RP.items()})
per_text("rp_capitals", capitals=rp_capitals_of)


@plan("conversations")
def rp_dialogue(d):
    spans = d.re_all("text", '["“][^"“”]{20,400}["”]')
    q = d.re_sub("span", '^["“]|["”]$', "")
    return f"SELECT id, concat('Carmen says ', lower(left(q, 1)), substring(q, 2)) AS knot, {rp_fact(d, 'q')} AS fact FROM (SELECT id, {q} AS q FROM (SELECT id, {d.explode(spans, 'span')} FROM {X.texts(d)} t) s) x"


@plan("conversations")
def rp_extract(d):
    bare = T.trim(d, d.re_sub(d.re_sub("s", '["“][^"“”]*["”]?', " "), r"[*_]", ""))
    rows = f"SELECT id, pos, {bare} AS bare FROM (SELECT id, {d.pos_explode(T.sentences(d, 'text'), 'pos', 's')} FROM {X.texts(d)} t) x WHERE NOT {T.is_question(d, 's')}"
    return f"SELECT id, CAST(pos AS BIGINT) AS pos, left({T.third_person(d, 'bare', 'Carmen')}, {C.max_chars}) AS knot FROM ({rows}) y WHERE length(bare) >= 12 AND {rp_fact(d, 'bare')}"


def counted_names(d):
    """names(conv_id, turn, name, n, known): how often each name occurred in its conversation up to and with this turn; known by the second time, or if it is a speaker's who was heard."""
    caps = f"SELECT conv_id, turn, {d.explode(rp_capitals_of(d, 'text'), 'name')} FROM {X.turns(d)} t"
    running = f"SELECT conv_id, turn, name, CAST(sum(n) OVER (PARTITION BY conv_id, name ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM (SELECT conv_id, turn, name, count(*) AS n FROM ({caps}) c GROUP BY conv_id, turn, name) g"
    heard = f"SELECT conv_id, role, min(turn) AS since FROM {X.turns(d)} t GROUP BY conv_id, role"
    return f"names AS (SELECT r.conv_id, r.turn, r.name, r.n, r.n >= 2 OR coalesce(h.since <= r.turn, FALSE) AS known FROM ({running}) r LEFT JOIN ({heard}) h ON r.conv_id = h.conv_id AND r.name = h.role)"


@plan("conversations")
def rp_gazetteer(d): return f"WITH {counted_names(d)} SELECT conv_id, turn, name, n FROM names"


PLANS["win_gazetteer"] = Plan("win_gazetteer", ("conversations",), rp_gazetteer)


@plan("conversations")
def rp_known(d): return f"WITH {counted_names(d)} SELECT conv_id, turn, name, known FROM names"


@plan("conversations")
def agg_entities(d):
    """The ten most frequent known names of each conversation."""
    ranked = "SELECT conv_id, name, max(n) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY max(n) DESC, name) AS r FROM names WHERE known GROUP BY conv_id, name"
    return f"WITH {counted_names(d)} SELECT conv_id, name, n FROM ({ranked}) x WHERE r <= 10"


@plan("conversations")
def agg_cast(d):
    return f"SELECT conv_id, {d.collect('role', 'role')} AS speakers FROM (SELECT DISTINCT conv_id, role FROM {X.turns(d)} t) r GROUP BY conv_id"
