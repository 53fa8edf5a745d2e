"""Counts of pairs in blocks, and the weave's queries: what they make, and the same rows as SQL on odd lines."""

import collections
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import rows_of

from skeinflow.functions import text as T
from skeinflow.functions.dialect import SPARK
from skeinflow.operators import weave
from skeinflow.plans import PLANS
from skeinflow.sources import tables


@pytest.fixture
def folder(tmp_path):
    """Documents that repeat words near and far, in marks or with marks that don't close, empty ones, and one long line; no conversations that match them but two."""
    rng = random.Random(5)
    common, rare = ["river", "stone", "boat", "plan", "zoë-anne", "o'hara"], [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    say = lambda n: " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n))
    texts = [f"{say(rng.randint(0, 9))}. {say(rng.randint(1, 30))}!\n{say(3)}" for _ in range(150)]
    texts += ["", None, "twin twin twin twin lone lone. twin lone twin", f"“{say(5)}. {say(4)}” {say(6)}. {say(2)}", f'say "{say(3)}. {say(3)}', say(3000)]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    said = [(0, 0, "user", f"{say(8)}. {say(5)}"), (0, 1, "assistant", say(9)), (0, 2, "user", "river stone?"), (1, 0, "user", say(4))]
    pq.write_table(pa.table({c: pa.array([r[k] for r in said], t) for k, (c, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), tmp_path / "conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["agg_unigram", "agg_vocab_topn", "agg_pairs", "agg_npmi", "win_related", "snk_weave_save", "snk_web_save", "join_assoc", "join_resume", "br_weave"])
def test_weave_is_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(PLANS[name].oracle())
    df = PLANS[name].run(spark, folder)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())


def made(spark, folder, name):
    PLANS[name].run(spark, folder).collect()
    return {key[-1].removeprefix("skeinflow_s_") for key in tables._WRITTEN if key[1] == folder}


@pytest.mark.parametrize("name", ["agg_unigram", "agg_vocab_topn"])
def test_counts_of_words_make_no_pairs(spark, folder, name):
    assert made(spark, folder, name) == {"long_lines", "unigrams"}


@pytest.mark.parametrize("name", ["agg_pairs", "agg_npmi", "win_related", "snk_weave_save", "snk_web_save", "join_assoc", "join_resume"])
def test_pairs_are_not_rows(spark, folder, name):
    """Only pairs that occur often enough are written; what goes between tasks are blocks."""
    assert "word_pairs" not in made(spark, folder, name)
    rows = spark.read.parquet(tables.written(spark, folder, "skeinflow_s_counted"))
    assert rows.where("n < 3").count() == 0 < rows.count()


def test_a_quotation_is_looked_for_only_where_a_mark_is(spark):
    plan = spark.sql(f"SELECT {T.sentences(SPARK, 'text')} AS s FROM VALUES ('a. b'), ('x \"y. z\" w'), (''), (NULL) AS v(text)")
    assert [r.s for r in plan.collect()] == [["a.", "b"], ['x "y. z" w'], [], None]
    assert "ELSE filter(array(text)" in T.sentences(SPARK, "text")


def counts(lines, window):
    return collections.Counter(tuple(sorted((a, b))) for ws in lines for i, a in enumerate(ws) for b in ws[i + 1 : i + 1 + window] if a != b)


def test_chunks_add_up(monkeypatch):
    """Pairs of several chunks, in several parts, with counts that don't fit beside their keys, against a plain loop."""
    rng = random.Random(1)
    lines = [[rng.randint(0, 4) if rng.random() < 0.8 else rng.randint(0, 99) for _ in range(rng.randint(2, 30))] for _ in range(400)]
    hashes = np.array([(k * 7919) % 101 for k in range(100)])
    order = np.argsort(hashes)
    monkeypatch.setattr(weave, "words_at", lambda path, column: (hashes[order], order.astype(np.int32)) if column == "h" else np.arange(100))
    monkeypatch.setattr(weave, "AT_ONCE", 1000)
    for bits in (7, 29):
        batches = [pa.record_batch([pa.array([[int(hashes[w]) for w in ws] for ws in lines[k : k + 20]], pa.list_(pa.int64()))], ["hs"]) for k in range(0, 400, 20)]
        cut = list(weave.count_in_chunks("", 12, bits, 32)(iter(batches)))
        got = {}
        for part in range(32):
            own = [b.filter(pa.array([p == part for p in b.column(0).to_pylist()])) for b in cut]
            for b in weave.add_up("", 3, bits)(iter(own)):
                rows = b.to_pydict()
                got |= {(x, y): n for x, y, n in zip(rows["a"], rows["b"], rows["n"])}
                assert rows["x"] == rows["a"] and rows["y"] == rows["b"]
        assert got == {p: n for p, n in counts(lines, 12).items() if n >= 3}


def test_blocks_keep_keys_of_all_bits():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64))
    n = np.arange(len(keys)) * 700_001 % (1 << 32)
    out = [weave.unpack(r["n"], r["keys"], True) for b in weave.blocks(keys, n, 64, 64) for r in b.to_pylist()]
    assert (np.concatenate([k for k, _ in out]) == keys).all() and (np.concatenate([c for _, c in out]) == n).all()


def test_the_nearest_of_each_word():
    rng = random.Random(3)
    rows = [(a, b, rng.randint(0, 20)) for a, b in itertools.combinations(range(40), 2)]
    batch = pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["a", "b", "strength"])
    cut = list(weave.best_in_chunks(12, 6, 32)(iter([batch])))
    keys = np.concatenate([k for k, _ in weave.opened(iter(cut), False)])
    first, number = weave.first_of(keys, 12, 6)
    got = [(int(k) >> 20, 63 - (int(k) & 63), (1 << 14) - 1 - (int(k) >> 6 & ((1 << 14) - 1)), int(n)) for k, n in zip(first, number)]
    both = rows + [(b, a, s) for a, b, s in rows]
    want = [(w, o, s, k + 1) for w in range(40) for k, (s, o) in enumerate(sorted(((s, o) for x, o, s in both if x == w), reverse=True)[:12])]
    assert got == want


def test_facts_and_words_make_no_rows_of_their_own():
    """br_weave: a fact looks through its conversation's list of words."""
    assert "JOIN wanted" not in PLANS["br_weave"].sql(SPARK) and "filter(others" in PLANS["br_weave"].sql(SPARK)
