"""Memories of the observed conversations, written down by hand, and the streaming store against a plain loop."""

import random

import pytest

from skeinflow.__main__ import main
from skeinflow.operators import rules
from skeinflow.plans import PLANS
from skeinflow.plans.fixtures import OBSERVED
from skeinflow.sources import memory
from skeinflow.sources.tables import work_dir
from skeinflow.streaming.observe import Memory

SF = "/root/testdata/sf0.001"
GHENT, REX, NURSE, MONDAY, EMAIL, CHESS = "the user lives in Antwerp", "the user's sister Marta has a dog named Rex", "the user works as a nurse", "The project deadline is on Monday", "the user's email account is marta-7", "the user plays chess with the user's sister"
PEANUTS, FLIGHT = "the user is allergic to peanuts", "the user's flight KL1234 leaves on Monday; the user's boss is Priya"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r for r in PLANS[name].run(spark, SF).collect() if r.conv_id is not None and r.conv_id < 0]


def test_facts_live_until_they_are_corrected(run):
    live = {(r.conv_id, r.seq): r.text for r in run("flt_entries")}
    assert [live[k] for k in sorted(live) if k[0] == -1] == [REX, NURSE, GHENT, MONDAY, EMAIL, CHESS]
    assert not any(c == -4 for c, _ in live)  # questions aren't facts
    killers = {(r.conv_id, r.n): r.killer for r in run("st_supersede")}
    assert killers[-1, 1] == 4 and killers[-1, 4] == 6 and killers[-1, 5] == 7 and killers[-1, 6] is None
    assert {(r.conv_id, r.n): r.reinforced for r in run("st_inherit")}[-1, 6] == 2
    assert {r.b for r in run("g_revision") if r.conv_id == -1} == {4, 6, 7}
    assert {r.n: r.replaced for r in run("g_history") if r.conv_id == -1}[6] == ["the user lives in Ghent now"]


def test_packs_of_observed_conversations(run):
    packs = {r.conv_id: r.pack for r in run("q_pack")}
    assert packs[-1].split("\n")[0] == REX and packs[-3] == FLIGHT and packs[-4] == ""
    assert packs[-2] == "Carmen grew up in Lisbon"


def test_weave_starts_from_every_seed_and_from_the_anchor(run):
    packs = {r.conv_id: r.pack.split("\n") for r in run("q_pack_weave")}
    assert packs[-3] == [PEANUTS, FLIGHT]  # nothing matches: the most important fact, and what hangs on it
    assert REX in packs[-1] and NURSE in packs[-1] and packs[-4] == [""]
    assert {r.conv_id for r in run("q_scene")} == {r.conv_id for r in run("q_adaptive")} == {r.conv_id for r in run("q_slots")} == {r.conv_id for r in run("q_reserve")} == set(OBSERVED)
    gated = {r.conv_id: r.gated for r in run("q_gated_weave")}
    assert gated[-3] and set(gated) == set(OBSERVED)


def test_names_are_known_from_the_second_time(run):
    known = {(r.turn, r.name): r.known for r in run("rp_known") if r.conv_id == -2}
    assert known[1, "Lisbon"] and known[5, "Carmen"] and not known[2, "Friday"]
    assert {r.name for r in run("agg_entities") if r.conv_id == -2} == {"Lisbon", "Carmen"}


def test_dropping_cuts_cords_and_index(run):
    first = {r.conv_id: r.text for r in sorted(run("flt_entries"), key=lambda r: -r.seq)}
    left = {(r.conv_id, r.seq) for r in run("st_drop")}
    gone = {(r.conv_id, r.seq) for r in run("flt_entries")} - left
    assert gone and all(c in first for c, _ in gone)
    assert not any((r.conv_id, x) in gone for r in run("g_cut") for x in (r.a, r.b))


def test_bounded_stream_is_a_plain_loop(spark):
    want = set()
    for c, turns in OBSERVED.items():
        m = Memory()
        for role, text in turns:
            for f in rules.said(role, text):
                m.add(f, 10)
        want |= {(c, f[1]) for f in m.facts}
    assert {(r.conv_id, r.text) for r in PLANS["ss_bounded"].run(spark, SF).where("conv_id < 0").collect()} == want
    assert PLANS["ss_bounded"].run(spark, SF).groupBy("conv_id").count().where("count > 10").count() == 0


def test_the_least_valuable_fact_goes():
    m = Memory()
    for text in [PEANUTS, *(f"it rained on day {k} again" for k in range(40))]:
        m.add(text, 5)
    assert len(m.facts) == 5 and PEANUTS in [f[1] for f in m.facts]
    rng = random.Random(3)
    words = "boat river stone code team sister plan house".split()
    m = Memory()
    for _ in range(300):
        m.add(" ".join(rng.choice(words) for _ in range(6)), 20)
    assert len(m.facts) <= 20 and [f[0] for f in m.facts] == sorted(f[0] for f in m.facts)


def test_memory_files(spark):
    at = f"{work_dir(spark)}/memory-test-{random.random()}"
    docs = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "conv_id bigint, doc string")
    assert memory.load(spark, at).count() == 0
    memory.save(docs('{"e":["one fact","one fact","two"]}'), at)
    before = memory.load(spark, at)
    memory.save(docs('{"v":3,"max":9,"o":1,"seq":4,"k":[["kept",4,2,1.5,["b"],3]]}', "broken"), at)
    assert [r.text for r in before.orderBy("seq").collect()] == ["one fact", "two"]  # a reader keeps what it began with
    assert [tuple(r) for r in memory.load(spark, at).collect()] == [(0, 4, 2, 1.5, ["b"], 3, "kept")]
    with pytest.raises(Exception, match="not a memory"):
        memory.load(spark, at, strict=True).collect()


def test_outcomes(spark):
    rows = {r.id: r for r in PLANS["ev_interrogate"].run(spark, SF).collect()}
    assert len(rows) == 6 and rows[4].outcome == "tie" and not rows[4].grounded and rows[3].outcome in ("one", "tie")
    assert sum(r.n for r in PLANS["ev_imitation"].run(spark, SF).collect()) == 6


def test_command_line(capsys):
    assert main([]) == 2 and main(["forget", SF]) == 2
    assert main(["demo"]) == 0 and REX in capsys.readouterr().out
    assert main(["pack", SF, "-1"]) == 0 and REX in capsys.readouterr().out
    assert main(["show", SF, "-4"]) == 1
