"""Extraction rules, the streaming store and memory files."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.operators import rules
from skeinflow.operators.judge import judge, picks
from skeinflow.plans import PLANS
from skeinflow.sources import memory
from skeinflow.streaming.observe import Memory

ANY = st.lists(st.sampled_from(list("abcI' \"“”‘.,!?:;\n\t-7éZ中") + ["and ", "team ", "Monday ", "lives "]), max_size=200).map("".join)


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_rules_never_raise_and_stay_bounded(text):
    facts = rules.extract(text)
    assert all(8 <= len(f) <= 120 for f in facts)
    assert "".join("".join(rules.sentences(text)).split()) == "".join(text.split())
    assert len(rules.inside(text)) == len(text)
    assert len(rules.fit(text)) <= max(120, 0) or len(text) <= 120


def test_extract_by_hand():
    assert rules.extract("Do you like tea? You look tired. I live in Ghent.") == ["the user lives in Ghent"]
    assert rules.extract("I live in Ghent.", "Carmen") == ["Carmen lives in Ghent"]
    assert rules.extract(None) == [] and rules.extract("ok") == []
    assert rules.extract('"I was born in Ghent in 1980"')[0].startswith("the user says ")


def test_memory_keeps_one_fact_per_frame_and_is_bounded():
    m = Memory()
    for t in ["the user lives in Antwerp", "the user lives in Ghent", "the user lives in Antwerp", "team 5 has a deadline", "team 7 has a deadline"]:
        m.add(t, 500)
    assert [f[1] for f in m.facts] == ["the user lives in Antwerp", "team 5 has a deadline", "team 7 has a deadline"]
    assert m.facts[0][2] == 2
    rng = random.Random(0)
    for _ in range(300):
        m.add(" ".join(rng.choice("stone river paper lamp wind glass".split()) + str(rng.randrange(99)) for _ in range(5)), 20)
    assert len(m.facts) == 20


def test_stream_equals_batch(spark):
    from compare import compare

    for name in ("ss_observe", "ss_late", "snk_save", "ext_extract", "str_fit"):
        said, ok = compare(spark, name, PLANS[name].run, PLANS[name].oracle(), "/root/testdata/sf0.001")
        assert ok, said


def test_judge(spark):
    assert picks("3, 1, 3, 99 and 2", 3, 2) == [3, 1]
    asked = spark.createDataFrame([("q", ["a", "b"]), ("q", ["a", "b"]), ("bad", ["a"])], "query string, facts array<string>")

    def client(text):
        if "bad" in text:
            raise OSError("no answer")
        return "2"

    assert sorted((r.query, r.fact, r.failed) for r in judge(asked, client).where("rank >= 0").collect()) == [("q", "b", False)]


def test_load_of_nothing(spark, tmp_path):
    assert memory.load(spark, f"file://{tmp_path}/none").count() == 0
