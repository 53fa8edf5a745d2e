"""Files, generated conversations, late data, and small evaluation plans."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions.dialect import DUCK, SPARK
from ..operators import rules
from ..operators.duel import duel
from ..operators.judge import judge
from ..sources import memory
from ..sources.tables import run_sql, table, work_dir
from . import fixtures as X
from .catalog import PLANS, Plan, plan
from .custom import FILES, Custom, entries, src_json
from .graph import answers, win_related, worded
from .retrieve import q_pack
from .store import scaled, ss_tumbling

for _v in (1, 2, 3):
    PLANS[f"src_json_v{_v}"] = Plan(f"src_json_v{_v}", (), (lambda v: lambda d: f"SELECT * FROM ({src_json(d)}) j WHERE v = {v}")(_v))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{work_dir(spark)}/memory-{uuid.uuid4().hex}"
    memory.save(PLANS["snk_serialize"].run(spark, sf_dir), at)
    return memory.load(spark, at)


SAVED = "SELECT conv_id, seq, hits, ts, idx, reinforced, text FROM entries"
PLANS["snk_save"] = Custom("snk_save", round_trip, f"WITH RECURSIVE {entries(DUCK)} {SAVED}")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all three versions, one of which isn't a memory, and a path that isn't there."""
    at = f"{work_dir(spark)}/memory-{uuid.uuid4().hex}"
    memory.save(spark.createDataFrame(list(enumerate(FILES)), "conv_id bigint, doc string"), at)
    return memory.load(spark, at).unionByName(memory.load(spark, f"{at}-missing"))


LOADED = [(0, 1, 0, 12.5, ["walk"], 2, "the user has a dog"), (0, 3, 1, 13.25, [], 0, "the user lives in Ghent"), (1, 1, 4, 1.5, [], 0, "old format fact"), (2, 1, 0, 0.0, [], 0, "first fact here"), (2, 2, 0, 0.0, [], 0, "second fact here")]
PLANS["src_load"] = Custom("src_load", loaded, f"SELECT conv_id::BIGINT AS conv_id, seq::BIGINT AS seq, hits::BIGINT AS hits, ts::DOUBLE AS ts, idx, reinforced::BIGINT AS reinforced, text FROM {DUCK.values(X.rows(DUCK, LOADED), 'conv_id, seq, hits, ts, idx, reinforced, text')} g")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{work_dir(spark)}/capture-{uuid.uuid4().hex}"
    PLANS["q_pack"].run(spark, sf_dir).write.mode("append").json(at)
    return spark.read.schema("conv_id BIGINT, pack STRING, n_lines BIGINT").json(at)


PLANS["snk_capture"] = Custom("snk_capture", captured, q_pack(DUCK))


SEEDS, TURNS = (7, 11, 19), 800


@plan()
def src_synth_conv(d):
    """Planted facts among decoys and filler: a conversation of 800 turns for each seed."""
    kinds = {"fact": ["the boat is named Aurora", "the code is 4417", "Priya moved to Oslo"], "decoy": ["the boat was nearly named Borealis", "an old code was 1234", "Priya once thought of Lima"],
             "filler": ["it was a slow day", "we talked for a while", "the kettle boiled", "nothing much happened", "someone laughed"]}
    said = d.values(", ".join(f"('{kind}', {k}, {len(ts)}, '{t}')" for kind, ts in kinds.items() for k, t in enumerate(ts)), "kind, i, n, t")
    seeds = d.values(", ".join(f"({s})" for s in SEEDS), "seed")
    mixed = "((k * 7919 + seed * 104729) % 10007)"
    turns = f"SELECT CAST(seed AS BIGINT) AS seed, CAST(k AS BIGINT) AS turn, {mixed} AS m, CASE WHEN {mixed} % 100 < 3 THEN 'fact' WHEN {mixed} % 100 < 13 THEN 'decoy' ELSE 'filler' END AS kind FROM {d.numbers(TURNS)} a CROSS JOIN {seeds} s"
    return f"SELECT seed, turn, g.kind, t AS text FROM ({turns}) x JOIN {said} g ON x.kind = g.kind AND (x.m + x.turn) % g.n = g.i"


@plan()
def agg_summary_seeds(d):
    """By kind of turn: mean, least and most over the seeds, and each seed's number."""
    per_seed = f"SELECT kind, seed, count(*) AS n FROM ({src_synth_conv(d)}) c GROUP BY kind, seed"
    return f"SELECT kind, {scaled('avg(n)', 1000)} AS mean, min(n) AS low, max(n) AS high, {d.collect('n', 'seed')} AS by_seed FROM ({per_seed}) p GROUP BY kind"


WEBS = ['{"links":{"dog":["walk","bark"],"sea":["boat"]}}', '{"cat":["purr"]}', "not a web"]


@plan()
def src_web_load(d):
    """Webs of words, with or without the outer key; what isn't one is left out."""
    docs = d.values(X.rows(d, list(enumerate(WEBS))), "file, doc")
    if d.name == "spark":
        maps = f"SELECT file, coalesce(from_json(doc, 'links MAP<STRING, ARRAY<STRING>>').links, from_json(doc, 'MAP<STRING, ARRAY<STRING>>')) AS m FROM {docs} w"
        return f"SELECT CAST(file AS BIGINT) AS file, word, CAST(pos AS BIGINT) AS pos, other FROM (SELECT file, word, posexplode(others) AS (pos, other) FROM (SELECT file, explode(m) AS (word, others) FROM ({maps}) a) b) c"
    maps = f"SELECT file, CASE WHEN json_exists(doc::JSON, '$.links') THEN (doc::JSON)->'$.links' ELSE doc::JSON END AS m FROM {docs} w WHERE json_valid(doc)"
    return f"SELECT file::BIGINT AS file, word, unnest(range(len(others))) AS pos, unnest(others) AS other FROM (SELECT file, word, from_json(m->word, '[\"VARCHAR\"]') AS others FROM (SELECT file, m, unnest(json_keys(m)) AS word FROM ({maps}) a) b) c"


def weave_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as weave files and read back."""
    at = f"{work_dir(spark)}/weave-{uuid.uuid4().hex}"
    memory.save_weave(PLANS["win_related"].run(spark, sf_dir), at)
    return memory.load_weave(spark, at)


PLANS["snk_weave_save"] = Custom("snk_weave_save", weave_saved, win_related(DUCK))
WEAVE = ['{"v":1,"r":{"dog":[["walk",0.75],["bark",0.5]]}}', "broken", '{"v":1,"r":{"sea":[["boat",0.25]],"sun":[]}}']


def weave_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{work_dir(spark)}/weave-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in WEAVE], "value string").write.text(at)
    return memory.load_weave(spark, at)


PLANS["src_weave_load"] = Custom("src_weave_load", weave_loaded, "SELECT * FROM (VALUES ('dog', 'walk', 7500::BIGINT, 1::BIGINT), ('dog', 'bark', 5000, 2), ('sea', 'boat', 2500, 1)) v(word, other, strength, k)")


def web_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web of each word's three nearest, written in two goes: the second one does only the words that the first hasn't."""
    at = f"{work_dir(spark)}/web-{uuid.uuid4().hex}"
    links = PLANS["win_related"].run(spark, sf_dir).where("k <= 3").select("word", (F.col("k") - 1).cast("bigint").alias("pos"), "other")
    memory.extend_web(links.where("length(word) % 2 = 0"), at)
    memory.extend_web(links, at)
    return memory.load_web(spark, at)


PLANS["snk_web_save"] = Custom("snk_web_save", web_saved, f"SELECT word, (k - 1)::BIGINT AS pos, other FROM ({win_related(DUCK)}) r WHERE k <= 3")


@plan()
def agg_noise(d):
    """Characters of packed facts that hold none of the question's keys."""
    facts = f"SELECT a.id, length(f.fact) AS size, {d.any('a.keys', 'k', d.has('lower(f.fact)', 'k'))} AS wanted FROM asked a JOIN packs p ON a.id = p.id JOIN facts f ON {d.has('p.pack', 'lower(f.fact)')}"
    return f"WITH {answers(d)} SELECT id, CAST(sum(size) AS BIGINT) AS chars, CAST(sum(CASE WHEN wanted THEN 0 ELSE size END) AS BIGINT) AS noise FROM ({facts}) x GROUP BY id"


@plan()
def ev_target_idx(d): return f"WITH {answers(d)} SELECT a.id, f.seq FROM asked a JOIN facts f ON {d.any('a.keys', 'k', d.has('lower(f.fact)', 'k'))}"


@plan("embeddings", "documents")
def ev_run_score(d):
    """Same-label neighbours among the first six, for five weights of the words in common."""
    steps = d.values("(0), (25), (50), (100), (200)", "lambda_pct")
    ranked = f"SELECT lambda_pct, q, ql = vl AS hit, row_number() OVER (PARTITION BY lambda_pct, q ORDER BY cosine + CAST(floor(lambda_pct * jaccard / 100) AS BIGINT) DESC, v) AS k FROM near CROSS JOIN {steps} s"
    return f"WITH {worded(d, 30)} SELECT lambda_pct, {d.count_if('hit')} AS hits, count(*) AS n FROM ({ranked}) r WHERE k <= {C.bridge_k} GROUP BY lambda_pct"


@plan()
def ev_measure(d):
    """Hits of each budget's packs, or VOID where every call failed (an empty pack)."""
    def one(b): return f"SELECT {b} AS budget, CASE WHEN sum(failed) = count(*) THEN 'VOID' ELSE concat(CAST(sum(hits) AS STRING), '/', CAST(count(*) AS STRING)) END AS score FROM (WITH {answers(d, b)} SELECT CASE WHEN coalesce(p.pack, '') = '' THEN 1 ELSE 0 END AS failed, CASE WHEN hit THEN 1 ELSE 0 END AS hits FROM judged j LEFT JOIN packs p ON j.id = p.id WHERE j.id = j.j) m{b}"

    return " UNION ALL ".join(map(one, (0, 30, 60, 300)))


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as a stream with a watermark; with all data there they are those of the batch form."""
    at = f"{work_dir(spark)}/late-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 hour"), "event_type").count()

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("hour"), "event_type", F.col("count").alias("n")).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # a batch that is tried again replaces what it wrote

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))


PLANS["ss_late"] = Custom("ss_late", late, ss_tumbling(DUCK))


def overlap_client(text: str) -> str:
    """A stand-in for a model: names the facts that share a word with the question."""
    lines = text.split("\n")
    asked = set(re.findall(r"[a-z]{4,}", lines[0].lower())) - {"question", "what", "does", "user"}
    return ", ".join(x.split(".")[0] for x in lines[1:-1] if asked & set(re.findall(r"[a-z]{4,}", x.lower())))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = [t for _, t in X.CONVERSATION]
    asked = spark.createDataFrame([(q, facts) for _, q, _, _ in X.QUESTIONS] * 2, "query string, facts array<string>")
    return judge(asked, overlap_client)


PLANS["br_llm_judge"] = PLANS["src_llm"] = Custom("br_llm_judge", judged)


def word_client(text: str) -> str:
    """A stand-in for a model: answers with the context's line that shares most words with the question, and prefers the answer that shares more."""
    kind, question, *lines = text.split("\n")

    def shared(line: str) -> int:
        return len(set(rules.words(question)) & set(rules.words(line)))

    if kind == "answer":
        return max(lines, key=shared) if any(map(shared, lines)) else "I don't know"
    return "1" if shared(lines[0]) >= shared(lines[1]) else "2"


def interrogated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of 300 against packs of 30 characters."""
    packs = [run_sql(spark, sf_dir, f"WITH {answers(SPARK, b)} SELECT a.id, question, pack AS {name} FROM asked a LEFT JOIN packs p ON a.id = p.id") for b, name in ((300, "one"), (30, "two"))]
    return duel(packs[0].join(packs[1].drop("question"), "id"), word_client)


#: By hand: the small pack has an answer only where a fact has at most 30 characters, so the judge prefers the large one, or its order decides.
PLANS["ev_interrogate"] = Custom("ev_interrogate", interrogated)
PLANS["ev_imitation"] = Custom("ev_imitation", lambda spark, sf_dir: interrogated(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("grounded").alias("grounded")))
