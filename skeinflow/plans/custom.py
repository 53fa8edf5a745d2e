"""Plans that need Python or a stream, and the memory file formats."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT as C
from ..functions.dialect import DUCK, SPARK
from ..operators import rules
from ..operators.extract import extract_knots, per_text
from ..sources.tables import SHARED, run_sql, work_dir
from ..streaming.observe import drain, keyed, previous_turn, run_once, running_names, stream_of
from . import fixtures as X
from .catalog import PLANS, plan
from .projection import rp_gazetteer
from .retrieve import q_hits
from .store import descendants, st_index_terms, store, win_burst


@dataclass(frozen=True)
class Custom:
    """A plan with its own way to run; expected: DuckDB SQL, or none."""

    name: str
    run: object
    expected: str = ""

    def oracle(self) -> str:
        return self.expected


def own_texts(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def golden(rows, kind="list") -> str:
    """DuckDB SQL of rows written down by hand."""
    return f"SELECT CAST(id AS BIGINT) AS id, value FROM {DUCK.values(X.rows(DUCK, rows), 'id, value')} g"


TAILS = ["I work as a nurse, which is fine", "My sister lives in Ghent and it rains", "I own a boat, and my brother is a teacher", 'He said "well, no" on Monday, obviously']
TRIMMED = ["I work as a nurse", "My sister lives in Ghent", "I own a boat, and my brother is a teacher", 'He said "well, no" on Monday']
JOINED = ["I like tea, but you know; so we wait", "one and two", 'a "b, c" d, e', "plain"]
PARTS = [["I like tea", "but you know", "so we wait"], ["one", "two"], ['a "b, c" d', "e"], ["plain"]]
LONG = ["short one", "x" * 130, "we walked along the river for hours and hours without any aim at all, the meeting is on Monday at 10, then everyone went home rather late and quite tired",
        " ".join(["word"] * 30)]
FITTED = ["short one", "x" * 120, "hours without any aim at all, the meeting is on Monday at 10, then everyone went home rather late, quite tired", " ".join(["word"] * 24)]
FACTS = [(0, ["the user lives in Antwerp"]), (2, ["the user's sister Marta has a dog named Rex", "the user works as a nurse"]), (3, ["the user lives in Ghent now"]), (5, ["The project deadline is on Friday"]), (6, ["the user lives in Antwerp"]),
         (7, ["The project deadline is on Monday"]), (8, ["the user's email account is marta-7"]), (9, ["the user plays chess with the user's sister"])]

for _name, _texts, _rule, _kind, _want in (("str_trim_tail", TAILS, rules.trim_tail, "string", TRIMMED), ("str_clauses", JOINED, rules.clauses, "array<string>", PARTS), ("str_fit", LONG, rules.fit, "string", FITTED),
                                           ("ext_extract", [t for r, t in X.CONVERSATION], rules.extract, "array<string>", [dict(FACTS).get(k, []) for k in range(len(X.CONVERSATION))])):
    PLANS[_name] = Custom(_name, (lambda texts, rule, kind: lambda spark, sf_dir: per_text(own_texts(spark, texts), rule, kind))(_texts, _rule, _kind),
                          golden([(k, v) for k, v in enumerate(_want) if v != []]) + "".join(f" UNION ALL SELECT {k}, []" for k, v in enumerate(_want) if v == []))



#: The table's prose holds no fact, so what is extracted from all turns is what was written down by hand.
PLANS["ext_extract_turns"] = Custom("ext_extract_turns", lambda spark, sf_dir: extract_knots(run_sql(spark, sf_dir, f"SELECT * FROM {X.turns(SPARK)} t")),
                                    f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, pos::BIGINT AS pos, text AS knot FROM {DUCK.values(X.rows(DUCK, X.FACTS), 'conv_id, turn, pos, text')} f")


def own_folder(spark: SparkSession) -> str:
    folder = f"{work_dir(spark)}/turns-{uuid.uuid4().hex}"
    spark.sql(f"SELECT * FROM {X.own_turns(SPARK)} t").write.parquet(folder)
    return folder


def live(spark: SparkSession, sf_dir: str, most: int = C.max_entries) -> DataFrame:
    """The live facts of two streams: the table's conversations, added to, and the observed ones, whose facts are extracted."""
    added, seen = run_once(spark, f"{sf_dir}/conversations.parquet", most), run_once(spark, own_folder(spark), most, extracting=True)
    return added.unionByName(seen).select("conv_id", "text")


def stepped(make, schema):
    """A query that runs a keyed step over both streams; make(extracting) gives the step."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = ((f"{sf_dir}/conversations.parquet", False), (own_folder(spark), True))
        one, two = (drain(keyed(stream_of(spark, at), make(extracting), schema)).drop("batch") for at, extracting in sources)
        return one.unionByName(two)

    return run


#: The streams' live facts are those of the batch form, as long as no memory is full.
PLANS["ss_observe"] = Custom("ss_observe", live, f"WITH {store(DUCK)} SELECT conv_id, text FROM knots")
#: Memories of ten facts; what goes depends on what was there at each addition, so tests compare with a plain loop.
PLANS["ss_bounded"] = Custom("ss_bounded", lambda spark, sf_dir: live(spark, sf_dir, 10))
PLANS["ss_last_turn"] = Custom("ss_last_turn", stepped(previous_turn, "before bigint"), f"WITH {store(DUCK)} SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM occ) t")
PLANS["ss_gazetteer"] = Custom("ss_gazetteer", stepped(lambda extracting: running_names, "name string, n bigint"), rp_gazetteer(DUCK))


def streamed_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as a stream; how many are near each is worked out when the store is read, as later ones count too."""
    rows = drain(stream_of(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"))
    rows.createOrReplaceTempView("skeinflow_arrived")
    return spark.sql(win_burst(SPARK).replace("FROM events", "FROM skeinflow_arrived"))


PLANS["ss_burst"] = Custom("ss_burst", streamed_burst, win_burst(DUCK))


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursion runs over the written table of who replaced whom, so that its steps don't work that out again."""
    return run_sql(spark, sf_dir, f"WITH RECURSIVE {descendants(SPARK, 'skeinflow_s_killers')}")


PLANS["st_inherit"] = Custom("st_inherit", inherited, f"WITH RECURSIVE {store(DUCK)}, {descendants(DUCK)}")

FILES = ['{"v":3,"max":500,"o":90,"seq":3,"k":[["the user has a dog",1,0,12.5,["walk"],2],["bad"],["the user lives in Ghent",3,1,13.25,[],0]]}', '{"v":2,"max":60,"o":40,"seq":2,"k":[["old format fact",1,4,1.5],["old format fact",2,0,1.75]]}', '{"e":["first fact here","second fact here"],"o":7}', "not a memory"]


@plan()
def src_json(d):
    """Facts of memory files of versions 1 to 3; missing fields get defaults, bad entries and repeats are left out."""
    files = d.values(X.rows(d, list(enumerate(FILES))), "file, doc")
    if d.name == "spark":
        parsed = f"SELECT file, from_json(doc, 'v INT, e ARRAY<STRING>, k ARRAY<ARRAY<STRING>>') AS m FROM {files} f"
        rows = f"SELECT file, 1 AS v, pos, x AS text, pos + 1 AS seq, 0 AS hits, 0 AS reinforced FROM (SELECT file, posexplode(m.e) AS (pos, x) FROM ({parsed}) p) a UNION ALL SELECT file, v, pos, x[0], try_cast(try_element_at(x, 2) AS INT), coalesce(try_cast(try_element_at(x, 3) AS INT), 0), coalesce(try_cast(try_element_at(x, 6) AS INT), 0) FROM (SELECT file, m.v, posexplode(m.k) AS (pos, x) FROM ({parsed}) p) b"
    else:
        ok = f"(SELECT file, doc::JSON AS m FROM {files} f WHERE json_valid(doc))"
        e = f"(SELECT file, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT file, from_json(m->'$.e', '[\"VARCHAR\"]') AS l FROM {ok} p WHERE (m->'$.e') IS NOT NULL) a)"
        k = f"(SELECT file, v, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT file, (m->>'$.v')::INT AS v, from_json(m->'$.k', '[\"JSON\"]') AS l FROM {ok} p WHERE (m->'$.k') IS NOT NULL) a)"
        rows = f"SELECT file, 1 AS v, pos, x AS text, pos + 1 AS seq, 0 AS hits, 0 AS reinforced FROM {e} a UNION ALL SELECT file, v, pos, x->>'$[0]', TRY_CAST(x->>'$[1]' AS INT), coalesce(TRY_CAST(x->>'$[2]' AS INT), 0), coalesce(TRY_CAST(x->>'$[5]' AS INT), 0) FROM {k} b"
    return f"SELECT CAST(file AS BIGINT) AS file, CAST(v AS BIGINT) AS v, text, CAST(seq AS BIGINT) AS seq, CAST(hits AS BIGINT) AS hits, CAST(reinforced AS BIGINT) AS reinforced FROM (SELECT *, row_number() OVER (PARTITION BY file, text ORDER BY pos) AS r FROM ({rows}) x WHERE seq IS NOT NULL) y WHERE r = 1"


def entries(d):
    """The store's CTEs, and entries(conv_id, seq, hits, ts, idx, reinforced, text): what a memory file has of each live fact. ts is the turn, as the table has no clock."""
    up = "SELECT conv_id, n AS node, killer AS anc FROM killers WHERE killer IS NOT NULL UNION ALL SELECT u.conv_id, u.node, k.killer FROM up u JOIN killers k ON u.conv_id = k.conv_id AND u.anc = k.n WHERE k.killer IS NOT NULL"
    ties = f"up AS ({up}), gained AS (SELECT conv_id, anc AS n, count(*) AS reinforced FROM up GROUP BY conv_id, anc)" if d.name == "duckdb" else "gained AS (SELECT conv_id, n, reinforced FROM skeinflow_s_reinforced)"
    hidden = f"SELECT conv_id, seq, {d.collect('token', 'token')} AS idx FROM ({st_index_terms(d)}) i GROUP BY conv_id, seq"
    if d.name == "spark":
        hidden = "SELECT conv_id, seq, sort_array(ts) AS idx FROM skeinflow_s_hidden"
    all_ = "(SELECT /*+ REPARTITION(conv_id) */ conv_id, seq, turn, text FROM knots)" if d.name == "spark" else "knots"
    read = f"SELECT conv_id, seq, hits FROM ({q_hits(d)}) h"
    rows = f"SELECT k.conv_id, k.seq, coalesce(h.hits, 0) AS hits, CAST(k.turn AS DOUBLE) AS ts, coalesce(i.idx, {d.empty()}) AS idx, coalesce(g.reinforced, 0) AS reinforced, k.text FROM {all_} k LEFT JOIN ({read}) h ON k.conv_id = h.conv_id AND k.seq = h.seq LEFT JOIN ({hidden}) i ON k.conv_id = i.conv_id AND k.seq = i.seq LEFT JOIN gained g ON k.conv_id = g.conv_id AND k.seq = g.n"
    return f"{store(d)}, {ties}, entries AS ({rows})"


SHARED["skeinflow_s_reinforced"] = inherited


def serialized(d):
    """Each conversation's memory as one JSON document of version 3."""
    quoted = "substring(to_json(array(X)), 2, length(to_json(array(X))) - 2)" if d.name == "spark" else "to_json(X)::VARCHAR"
    words = f"concat('[', {d.join(d.transform('idx', 'z', quoted.replace('X', 'z')), chr(39) + ',' + chr(39))}, ']')"
    entry = f"concat('[', {quoted.replace('X', 'text')}, ',', CAST(seq AS STRING), ',', CAST(hits AS STRING), ',', CAST(CAST(ts AS BIGINT) AS STRING), '.0,', {words}, ',', CAST(reinforced AS STRING), ']')"
    seen = f"SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS observed FROM {X.turns(d)} t GROUP BY conv_id"
    docs = f"SELECT conv_id, max(seq) AS last, {d.collect(entry, 'seq')} AS items FROM entries GROUP BY conv_id"
    return f"SELECT e.conv_id, concat('{{\"v\":3,\"max\":{C.max_entries},\"o\":', CAST(observed AS STRING), ',\"seq\":', CAST(last AS STRING), ',\"k\":[', {d.join('items', chr(39) + ',' + chr(39))}, ']}}') AS doc FROM ({docs}) e JOIN ({seen}) o ON e.conv_id = o.conv_id"


#: Written, as its joins are done where a conversation's facts are; files of memories are made of it too.
SHARED["skeinflow_s_memories"] = f"WITH {entries(SPARK)} {serialized(SPARK)}"
PLANS["snk_serialize"] = Custom("snk_serialize", lambda spark, sf_dir: run_sql(spark, sf_dir, "SELECT * FROM skeinflow_s_memories"), f"WITH RECURSIVE {entries(DUCK)} {serialized(DUCK)}")
