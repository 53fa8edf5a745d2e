"""The fact store: knots, postings, supersession, eviction, statistics."""

from __future__ import annotations

from ..config import DEFAULT as C
from ..functions import text as T
from ..functions.dialect import SPARK
from ..operators.extract import extract_knots
from ..sources.tables import SHARED, shared
from . import fixtures as X
from .catalog import PLANS, Plan, plan


def scaled(x, by=1_000_000): return f"CAST(floor(({x}) * {by} + 0.5) AS BIGINT)"


def parts(d) -> list[tuple[str, str]]:
    """The fact store as statements, each over those before it.

    occ(conv_id, n, turn, role, text): what was said to be kept, in order: of observed conversations the extracted facts, of the table's conversations, whose
    prose holds no fact, every sentence as it is. info: its words and frames. pairs(conv_id, a, b): which correct each other. added, killers: what a
    sequential store would have done. knots: the facts that live at the end; seq is the number of the text's last addition.
    """
    s = f"SELECT conv_id, turn, role, pos, left({T.trim(d, 's')}, {C.max_chars}) AS text FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, {d.pos_explode(T.sentences(d, 'text'), 'pos', 's')} FROM conversations) x"
    known = "(SELECT conv_id, turn, pos, knot AS text FROM skeinflow_s_observed)" if d.name == "spark" else d.values(X.rows(d, X.FACTS), "conv_id, turn, pos, text")
    facts = f"(SELECT f.conv_id, f.turn, t.role, f.pos, f.text FROM {known} f JOIN {X.own_turns(d)} t ON f.conv_id = t.conv_id AND f.turn = t.turn)"
    occ = f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n, turn, role, text FROM ({s} UNION ALL SELECT * FROM {facts} f) y WHERE length(text) >= {C.min_chars}"
    info = f"""SELECT conv_id, n, turn, role, text, w, {d.size('w')} AS size_w, {d.join('f', chr(39) + '|' + chr(39))} AS frame_key, {d.join(T.identifiers(d, 'f'), chr(39) + '|' + chr(39))} AS ids
         FROM (SELECT o.*, {T.words(d, 'text')} AS w, {T.frame(d, 'text')} AS f FROM occ o) x"""
    # sets of n words that overlap by 0.6 share one of the n - ceil(0.6 n) + 1 rarest words of each, so only those are joined on
    least = "CAST(ceil(0.6 * size_w - 0.000001) AS BIGINT)"
    both = d.size(d.common("x.w", "y.w"))
    pairs = f"""WITH posted AS (SELECT conv_id, n, size_w, {d.explode('w', 'token')} FROM info),
counted AS (SELECT p.*, df FROM posted p JOIN (SELECT conv_id, token, count(*) AS df FROM posted GROUP BY conv_id, token) c ON p.conv_id = c.conv_id AND p.token = c.token),
rare AS (SELECT conv_id, n, token FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY df, token) AS r FROM counted) c WHERE r <= size_w - {least} + 1),
near AS (SELECT DISTINCT x.conv_id, x.n AS a, y.n AS b FROM rare x JOIN rare y ON x.conv_id = y.conv_id AND x.token = y.token AND x.n < y.n),
alike AS (SELECT p.conv_id, p.a, p.b, 'words' AS kind FROM near p JOIN info x ON p.conv_id = x.conv_id AND p.a = x.n JOIN info y ON p.conv_id = y.conv_id AND p.b = y.n
          WHERE x.ids = y.ids AND x.text <> y.text AND 10 * {both} >= 6 * (x.size_w + y.size_w - {both})),
framed AS (SELECT x.conv_id, x.n AS a, y.n AS b, 'frame' AS kind FROM info x JOIN info y ON x.conv_id = y.conv_id AND x.frame_key = y.frame_key AND x.frame_key <> '' AND x.n < y.n AND x.text <> y.text)
SELECT * FROM alike UNION ALL SELECT * FROM framed"""
    added = """WITH earlier AS (SELECT conv_id, n, text, lag(n) OVER (PARTITION BY conv_id, text ORDER BY n) AS p FROM occ)
SELECT DISTINCT e.conv_id, e.n FROM earlier e LEFT JOIN (SELECT conv_id, a, b FROM pairs UNION ALL SELECT conv_id, b, a FROM pairs) m ON e.conv_id = m.conv_id AND e.n = m.a AND m.b > e.p AND m.b < e.n WHERE e.p IS NULL OR m.b IS NOT NULL"""
    killers = "SELECT x.conv_id, x.n, min(y.n) AS killer FROM added x LEFT JOIN pairs m ON x.conv_id = m.conv_id AND x.n = m.a LEFT JOIN added y ON m.conv_id = y.conv_id AND m.b = y.n GROUP BY x.conv_id, x.n"
    knots = "SELECT i.conv_id, i.n AS seq, i.turn, i.role, i.text, i.w FROM killers k JOIN info i ON k.conv_id = i.conv_id AND k.n = i.n WHERE killer IS NULL"
    if d.name == "spark":
        occ, info, pairs, added = f"SELECT *, min(n) OVER (PARTITION BY conv_id, text) AS t FROM ({occ}) p", info.replace("n, turn, role, text, w,", "n, turn, role, text, t, w,", 1), paired(d, least), added.replace("text ORDER BY", "t ORDER BY").replace("n, text, lag", "n, lag")
    return [("occ", occ), ("info", info), ("pairs", pairs), ("added", added), ("killers", killers), ("knots", knots)]


def paired(d, least):
    """pairs for Spark, where occ and info have t, the number of the text's first addition, which stands for the text. Rows go to their conversation once, and all
    that is done with them there, joins too (see sources/tables.py), is done in that place.
    """
    both = d.size(d.common("x.w", "y.w"))
    return f"""WITH posted AS (SELECT conv_id, n, size_w, {d.explode('w', 'token')} FROM (SELECT /*+ REPARTITION(conv_id) */ conv_id, n, size_w, w FROM info) i),
rare AS (SELECT conv_id, n, token FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY df, token) AS r FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, token) AS df FROM posted) c) c WHERE r <= size_w - {least} + 1),
near AS (SELECT DISTINCT x.conv_id, x.n AS a, y.n AS b FROM rare x JOIN rare y ON x.conv_id = y.conv_id AND x.token = y.token AND x.n < y.n),
sets AS (SELECT /*+ REPARTITION(conv_id) */ conv_id, n, t, ids, size_w, w FROM info),
alike AS (SELECT p.conv_id, p.a, p.b, 'words' AS kind FROM near p JOIN sets x ON p.conv_id = x.conv_id AND p.a = x.n JOIN sets y ON p.conv_id = y.conv_id AND p.b = y.n
          WHERE x.ids = y.ids AND x.t <> y.t AND 10 * {both} >= 6 * (x.size_w + y.size_w - {both})),
frames AS (SELECT /*+ REPARTITION(conv_id) */ conv_id, n, t, frame_key FROM info WHERE frame_key <> ''),
framed AS (SELECT x.conv_id, x.n AS a, y.n AS b, 'frame' AS kind FROM frames x JOIN frames y ON x.conv_id = y.conv_id AND x.frame_key = y.frame_key AND x.n < y.n AND x.t <> y.t)
SELECT * FROM alike UNION ALL SELECT * FROM framed"""


def store(d) -> str:
    return shared(d, *parts(d))


knots = store


def observed(spark, sf_dir):
    """The facts of the observed conversations, extracted in Arrow batches."""
    return extract_knots(spark.sql(f"SELECT * FROM {X.own_turns(SPARK)} t"))


SHARED["skeinflow_s_observed"] = observed


def lexicon(d, of="knots") -> list[tuple[str, str]]:
    """postings(conv_id, seq, token), df(conv_id, token, df), sizes(conv_id, total) of knots."""
    return [("postings", f"SELECT conv_id, seq, {d.explode('w', 'token')} FROM {of}"), ("df", "SELECT conv_id, token, count(*) AS df FROM postings GROUP BY conv_id, token"),
            ("sizes", f"SELECT conv_id, count(*) AS total FROM {of} GROUP BY conv_id")]


def ctes(statements) -> str:
    return ",\n".join(f"{name} AS ({statement})" for name, statement in statements)


def index(d): return f"{store(d)},\n{ctes(lexicon(d))}"


def idf(): return "ln(1 + total / (1.0D + df))"


def real(d, s): return s.replace("1.0D", "1.0D" if d.name == "spark" else "1.0::DOUBLE")


@plan("conversations")
def flt_entries(d): return f"WITH {knots(d)} SELECT conv_id, seq, text FROM knots"


@plan("conversations")
def flt_forget(d): return f"WITH {knots(d)} SELECT conv_id, seq, text FROM knots WHERE NOT {d.has('lower(text)', chr(39) + 'the' + chr(39))}"


@plan("conversations")
def flt_contains(d): return f"WITH {knots(d)} SELECT conv_id, count(*) AS n FROM knots WHERE text IN (SELECT text FROM knots WHERE seq = 1) GROUP BY conv_id"


CLEARED = 2


@plan("conversations")
def flt_clear(d):
    """Each memory emptied at its third turn: what is added from then on, numbered from one."""
    later = f"SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY n) AS again FROM occ WHERE turn >= {CLEARED}"
    return f"WITH {store(d)} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS seq, text FROM ({later}) l WHERE again = 1"


def dropped(d):
    """forgotten(conv_id, seq): the facts that hold the first word of their conversation's first fact, as forget() would take them."""
    return f"""firsts AS (SELECT conv_id, {d.at('w', 1)} AS word FROM (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS r FROM knots) f WHERE r = 1),
forgotten AS (SELECT k.conv_id, k.seq FROM knots k JOIN firsts f ON k.conv_id = f.conv_id WHERE {d.has('lower(k.text)', 'f.word')}),
left_over AS (SELECT k.* FROM knots k LEFT JOIN forgotten f ON k.conv_id = f.conv_id AND k.seq = f.seq WHERE f.seq IS NULL)"""


@plan("conversations")
def st_drop(d):
    """The index after facts were dropped: postings and document frequencies of those that are left."""
    return f"WITH {store(d)}, {dropped(d)}, {ctes(lexicon(d, 'left_over'))} SELECT p.conv_id, p.seq, p.token, f.df, s.total FROM postings p JOIN df f ON p.conv_id = f.conv_id AND p.token = f.token JOIN sizes s ON p.conv_id = s.conv_id"


@plan("conversations")
def agg_df(d): return f"WITH {index(d)} SELECT conv_id, token, df FROM df"


@plan("conversations")
def agg_idf(d): return real(d, f"WITH {index(d)} SELECT f.conv_id, token, {scaled(idf())} AS idf FROM df f JOIN sizes s ON f.conv_id = s.conv_id")


def rarity(d):
    return real(d, f"rarity AS (SELECT p.conv_id, seq, {d.sum_sorted(idf())} / count(*) AS rarity FROM postings p JOIN df f ON p.conv_id = f.conv_id AND p.token = f.token JOIN sizes s ON p.conv_id = s.conv_id GROUP BY p.conv_id, seq)")


@plan("conversations")
def st_rarity(d): return f"WITH {index(d)}, {rarity(d)} SELECT k.conv_id, k.seq, {scaled('coalesce(rarity, 0)')} AS rarity FROM knots k LEFT JOIN rarity r ON k.conv_id = r.conv_id AND k.seq = r.seq"


@plan("conversations")
def st_evict(d):
    """The knots that stay when each memory is cut to 10: least valuable go first."""
    imp = T.importance(d, "text")
    if d.name == "spark":
        return evicting(d, imp)
    value = f"SELECT k.conv_id, k.seq, {scaled(f'coalesce(rarity, 0) * (1 + {imp} / 5)')} AS value FROM knots k LEFT JOIN rarity r ON k.conv_id = r.conv_id AND k.seq = r.seq"
    return f"WITH {index(d)}, {rarity(d)} SELECT conv_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY value DESC, seq DESC) AS r FROM ({value}) v) x WHERE r <= 10"


def evicting(d, imp):
    """st_evict for Spark: a knot's words, but not its text, go to its conversation once; sizes, df and ranks are counted there."""
    words = f"SELECT conv_id, seq, imp, count(*) OVER (PARTITION BY conv_id) AS total, w FROM (SELECT /*+ REPARTITION(conv_id) */ conv_id, seq, w, {imp} AS imp FROM knots) k"
    each = f"SELECT conv_id, seq, imp, total, token, count(token) OVER (PARTITION BY conv_id, token) AS df FROM (SELECT conv_id, seq, imp, total, explode_outer(w) AS token FROM ({words}) w) e"
    rarity = f"SELECT conv_id, seq, first(imp) AS imp, CASE WHEN count(token) > 0 THEN {d.sum_sorted(f'CASE WHEN token IS NOT NULL THEN {idf()} END')} / count(token) ELSE 0D END AS rarity FROM ({each}) t GROUP BY conv_id, seq"
    value = f"SELECT conv_id, seq, {scaled('rarity * (1 + imp / 5)')} AS value FROM ({rarity}) r"
    return f"WITH {store(d)} SELECT conv_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY value DESC, seq DESC) AS r FROM ({value}) v) x WHERE r <= 10"


def hidden_terms(d):
    """(conv_id, seq, ts) for Spark: each knot's first ten hidden terms. A turn's rare stems are listed once, by df, and each of its knots leaves its own words out.
    Knots and turns are dealt out by conversation, and all else is done in place.
    """
    own = "SELECT /*+ REPARTITION(conv_id) */ conv_id, seq, turn, w FROM knots"
    df = f"SELECT conv_id, token, count(*) AS df FROM (SELECT conv_id, {d.explode('w', 'token')} FROM own) p GROUP BY conv_id, token"
    said = f"SELECT conv_id, turn, {d.explode(T.words(d, 'text'), 'token')} FROM (SELECT /*+ REPARTITION(conv_id) */ conv_id, turn, text FROM {X.turns(d)} t) t"
    rare = "SELECT o.conv_id, turn, struct(coalesce(df, 0) AS df, o.token AS token) AS x FROM said o JOIN (SELECT conv_id, count(*) AS total FROM own GROUP BY conv_id) s ON o.conv_id = s.conv_id LEFT JOIN df f ON o.conv_id = f.conv_id AND o.token = f.token WHERE length(o.token) >= 4 AND coalesce(df, 0) <= greatest(3, CAST(floor(0.02 * total) AS BIGINT))"
    listed = f"SELECT conv_id, turn, sort_array(collect_list(x)) AS xs FROM ({rare}) r GROUP BY conv_id, turn"
    return f"WITH own AS ({own}), df AS ({df}), said AS ({said}) SELECT k.conv_id, k.seq, transform(slice(filter(xs, x -> NOT {d.contains('k.w', 'x.token')}), 1, 10), x -> x.token) AS ts FROM own k JOIN ({listed}) l ON k.conv_id = l.conv_id AND k.turn = l.turn"


@plan("conversations")
def st_index_terms(d):
    """Hidden terms of each knot: rare stems of its turn that it doesn't hold itself."""
    if d.name == "spark":
        return f"WITH {shared(d, *parts(d), ('hidden', hidden_terms(d)))} SELECT conv_id, seq, token, pos + 1 AS r FROM (SELECT conv_id, seq, posexplode_outer(ts) AS (pos, token) FROM hidden) x WHERE token IS NOT NULL"
    own = f"SELECT k.conv_id, k.seq, k.turn, token FROM (SELECT k.conv_id, k.seq, k.turn, k.w, {d.explode(T.words(d, 't.text'), 'token')} FROM knots k JOIN {X.turns(d)} t ON k.conv_id = t.conv_id AND k.turn = t.turn) k WHERE NOT {d.contains('w', 'token')} AND length(token) >= 4"
    ranked = f"SELECT o.conv_id, o.seq, o.token, row_number() OVER (PARTITION BY o.conv_id, o.seq ORDER BY coalesce(df, 0), o.token) AS r FROM ({own}) o JOIN sizes s ON o.conv_id = s.conv_id LEFT JOIN df f ON o.conv_id = f.conv_id AND o.token = f.token WHERE coalesce(df, 0) <= greatest(3, CAST(floor(0.02 * total) AS BIGINT))"
    return f"WITH {index(d)} SELECT conv_id, seq, token, r FROM ({ranked}) x WHERE r <= 10"


@plan("conversations")
def agg_stats(d):
    """Observed characters count all turns; stored ones the knots."""
    seen = "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS observed FROM TURNS t GROUP BY conv_id".replace("TURNS", X.turns(d))
    kept = f"SELECT conv_id, count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS stored, {scaled('avg(imp)', 1000)} AS importance FROM (SELECT conv_id, text, {scaled(T.importance(d, 'text'), 1000)} / 1000.0 AS imp FROM knots) k GROUP BY conv_id"
    return f"WITH {knots(d)} SELECT o.conv_id, observed, coalesce(entries, 0) AS entries, coalesce(stored, 0) AS stored, importance, {C.max_entries} AS most FROM ({seen}) o LEFT JOIN ({kept}) k ON o.conv_id = k.conv_id"


# supersession

@plan("conversations")
def st_dedupe(d): return f"WITH {store(d)} SELECT conv_id, n FROM added"


@plan("conversations")
def st_supersede(d): return f"WITH {store(d)} SELECT k.conv_id, k.n, killer, killer IS NULL AS live, text FROM killers k JOIN occ o ON k.conv_id = o.conv_id AND k.n = o.n"


def descendants(d, killers="killers"):
    """reinforced: how many facts each added fact has replaced, directly or through others."""
    return f"""up AS (SELECT conv_id, n AS node, killer AS anc FROM {killers} WHERE killer IS NOT NULL UNION ALL SELECT u.conv_id, u.node, k.killer FROM up u JOIN {killers} k ON u.conv_id = k.conv_id AND u.anc = k.n WHERE k.killer IS NOT NULL)
SELECT a.conv_id, a.n, count(u.node) AS reinforced FROM {killers} a LEFT JOIN up u ON a.conv_id = u.conv_id AND a.n = u.anc GROUP BY a.conv_id, a.n"""


@plan("conversations")
def g_history(d): return f"WITH {store(d)} SELECT k.conv_id, killer AS n, {d.collect('text', 'k.n')} AS replaced FROM killers k JOIN occ o ON k.conv_id = o.conv_id AND k.n = o.n WHERE killer IS NOT NULL GROUP BY k.conv_id, killer"


PLANS["g_revisions"] = Plan("g_revisions", ("conversations",), g_history)


@plan("conversations")
def join_overlap(d): return f"WITH {store(d)} SELECT conv_id, a, b FROM pairs WHERE kind = 'words'"


@plan("conversations")
def join_frame(d): return f"WITH {store(d)} SELECT conv_id, a, b FROM pairs WHERE kind = 'frame'"


def judged(d):
    pairs = d.values(X.rows(d, [(k, a, b, c) for k, (a, b, c) in enumerate(X.PAIRS)]), "id, first, second, corrects")
    same = f"10 * {d.size(d.common('wa', 'wb'))} >= 6 * ({d.size('wa')} + {d.size('wb')} - {d.size(d.common('wa', 'wb'))})"
    ids = lambda f: d.join(T.identifiers(d, f), "'|'")
    parts = f"SELECT id, corrects, {T.words(d, 'first')} AS wa, {T.words(d, 'second')} AS wb, {T.frame(d, 'first')} AS fa, {T.frame(d, 'second')} AS fb FROM {pairs} p"
    return f"(SELECT id, corrects, (({d.join('fa', chr(39) + '|' + chr(39))} = {d.join('fb', chr(39) + '|' + chr(39))} AND {d.size('fa')} > 0) OR ({same} AND {ids('fa')} = {ids('fb')})) AS replaced FROM ({parts}) q)"


@plan()
def agg_corrections(d): return f"SELECT count(*) AS pairs, CAST(sum(CASE WHEN replaced THEN 1 ELSE 0 END) AS BIGINT) AS corrected FROM {judged(d)} j WHERE corrects = 1"


@plan()
def agg_safety(d): return f"SELECT count(*) AS pairs, CAST(sum(CASE WHEN replaced THEN 0 ELSE 1 END) AS BIGINT) AS survive FROM {judged(d)} j WHERE corrects = 0"


@plan("conversations")
def agg_invariant(d):
    """Live facts of one memory that share a frame: there are none."""
    live = "SELECT k.conv_id, frame_key FROM killers k JOIN info i ON k.conv_id = i.conv_id AND k.n = i.n WHERE killer IS NULL AND frame_key <> ''"
    return f"WITH {store(d)} SELECT count(*) AS collapsed FROM (SELECT conv_id, frame_key FROM ({live}) l GROUP BY conv_id, frame_key HAVING count(*) > 1) x"


# time

@plan("events")
def win_burst(d):
    us = d.micros("ts")
    return f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {us} RANGE BETWEEN {C.burst_seconds}000000 PRECEDING AND {C.burst_seconds}000000 FOLLOWING) - 1 AS burst FROM events"


PLANS["agg_burst_meta"] = Plan("agg_burst_meta", ("events",), win_burst)
PLANS["join_range_burst"] = Plan("join_range_burst", ("events",), win_burst)


@plan("events")
def win_burst_factor(d): return f"SELECT event_id, {scaled('CASE WHEN burst = 0 THEN 1 ELSE 1 + 0.25 * ln(1 + burst) END')} AS factor FROM ({win_burst(d)}) b"


@plan("events")
def ss_tumbling(d):
    hour = "date_trunc('hour', ts)"
    return f"SELECT CAST({hour} AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"
