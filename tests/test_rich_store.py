"""The store's queries on conversations that repeat and correct themselves all the time, against their SQL; and how often rows change places for that."""

import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import rows_of

from skeinflow.plans import PLANS
from skeinflow.sources import tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(8)
    who, what, when = ["Marta", "the team", "our boss", "Rui"], ["meeting", "boat", "deadline", "flight KL1234", "locker 7", "locker 9"], ["Monday", "Friday", "March 3rd", "April 9th", "the weekend"]
    say = lambda: rng.choice([f"{rng.choice(who)} has a {rng.choice(what)} on {rng.choice(when)}", f"the {rng.choice(what)} is {rng.choice(['red', 'late', 'cancelled', 'on ' + rng.choice(when)])}", " ".join(rng.choice("river stone boat plan code house red late sister walked working".split()) for _ in range(rng.randint(1, 9)))])
    rows = [(c, t, rng.choice(["user", "assistant"]), ". ".join(say() for _ in range(rng.randint(0, 12))) + ".") for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(20, 0, "user", None), (20, 1, "user", "the boat is red. the boat is red. the boat is late"), (None, 0, "user", "the boat is red. the boat is late"), (21, 0, "user", "on the of a it is"), (21, 1, "user", "of on the at it is")]
    at = tmp_path_factory.mktemp("rich")
    pq.write_table(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), at / "conversations.parquet")
    pq.write_table(pa.table({"doc_id": [1], "text": ["river stone boat plan"]}), at / "documents.parquet")
    return str(at)


NAMES = ["g_history", "join_overlap", "join_frame", "st_dedupe", "st_supersede", "flt_entries", "g_tie_max", "win_prefix_scaling", "st_index_terms", "st_evict", "st_rarity", "ev_needed", "ev_overlap", "q_pack", "q_score", "q_hits", "snk_capture", "snk_serialize", "snk_save", "str_frame"]


@pytest.mark.parametrize("name", NAMES)
def test_rich_store_is_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(PLANS[name].oracle())
    df = PLANS[name].run(spark, folder)
    got = df.collect()
    assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of([c[0] for c in want.description], want.fetchall())
    assert len(got) > 1


def moves(spark, folder, statement):
    """Exchanges of a statement's plan when joins by broadcast are off, as they are on large tables."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("-1", "false")):
            spark.conf.set(k, v)
        with tables.in_place(spark):
            plan = tables.run_sql(spark, folder, statement)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return len(re.findall(r"[-+] Exchange ", plan)), plan


def test_pairs_go_to_their_conversation_once(spark, folder):
    n, plan = moves(spark, folder, tables.SHARED["skeinflow_s_pairs"])
    assert n <= 3, plan  # words, sets, frames: it was a dozen


def test_tables_that_nothing_reads_are_not_made(spark, folder, tmp_path):
    assert "skeinflow_s_b" not in tables.needed("WITH a AS (SELECT * FROM skeinflow_s_a), b AS (SELECT * FROM skeinflow_s_b) SELECT * FROM a")
    assert "skeinflow_s_knots" not in tables.needed(PLANS["g_history"].sql(tables_dialect()))


def tables_dialect():
    from skeinflow.functions.dialect import SPARK

    return SPARK


def test_hidden_terms_go_to_their_conversation_once(spark, folder):
    """Facts, their words, their numbers, and turns; before, each join and count was a move."""
    PLANS["st_index_terms"].sql(tables_dialect())
    n, plan = moves(spark, folder, tables.SHARED["skeinflow_s_hidden"])
    assert n <= 4, plan


def test_a_search_counts_only_words_that_a_query_has(spark, folder):
    PLANS["q_pack"].sql(tables_dialect())
    assert "postings" not in tables.SHARED["skeinflow_s_scored"]
    assert "postings p JOIN" not in PLANS["ev_needed"].sql(tables_dialect()) + PLANS["st_evict"].sql(tables_dialect())
