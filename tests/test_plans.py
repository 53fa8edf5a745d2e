"""Plans against their oracle, and against results written down by hand."""

import pytest
from compare import compare

from skeinflow.functions import vocab
from skeinflow.plans import PLANS

SF = "/root/testdata/sf0.001"
SOME = ["str_tokenize", "str_stem", "str_quote_depth", "str_sentences", "str_frame", "str_importance", "str_third_person", "flt_is_fact", "rp_extract", "src_corpus", "agg_idf", "st_evict", "st_dedupe", "st_supersede", "join_overlap", "win_burst", "q_pack", "q_reserve",
        "q_bridge_fill", "q_coverage", "q_pack_weave", "g_tie_max", "agg_npmi", "br_embed_topk", "agg_separation"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_oracle(spark, name):
    said, ok = compare(spark, name, PLANS[name].run, PLANS[name].oracle(), SF)
    assert ok, said


@pytest.mark.parametrize("word, stem", [("sing", "sing"), ("noted", "noted"), ("running", "run"), ("planned", "plan"), ("stopped", "stop"), ("formatted", "format"), ("class", "class"), ("bus", "bus"), ("cats", "cat"), ("user", "user"), ("using", "using"), ("eds", "eds")])
def test_stem(word, stem):
    assert vocab.stem(word) == stem


def fixture(spark, name, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in PLANS[name].run(spark, SF).where("id < 0").collect()}


def test_sentences_by_hand(spark):
    got = fixture(spark, "str_sentences", "sentences")
    assert got[-1][0] == ["I work as a nurse in Antwerp.", "My shift starts at 7:30 on Monday!"]
    assert got[-5][0] == ['She said "Go home. Now, please." and left the meeting at 10:00.']
    assert got[-9][0] == ["note:", "my flight KL1234 leaves on Friday"]
    assert got[-13][0] == ["we have two projects", "our manager is Priya"]
    assert got[-12][0] == []


def test_predicates_by_hand(spark):
    asked = fixture(spark, "flt_question", "question")
    assert asked[-16][0] and not asked[-3][0]
    other = fixture(spark, "flt_addresses_other", "addressed")
    assert not other[-4][0] and other[-1][0] is False  # both persons, and none
    payload = fixture(spark, "flt_has_payload", "payload")
    assert payload[-6][0] and payload[-19][0] and not payload[-10][0] and not payload[-15][0]


def test_third_person_by_hand(spark):
    got = fixture(spark, "str_third_person", "knot", "knot_of_speaker")
    assert got[-1] == ("the user works as a nurse in Antwerp. the user's shift starts at 7:30 on Monday!", "Carmen works as a nurse in Antwerp. Carmen's shift starts at 7:30 on Monday!")
    assert got[-7][0] == "the user is allergic to peanuts and the user has a dog named Rex."


def test_frame_by_hand(spark):
    got = fixture(spark, "str_frame", "frame", "ids")
    assert set(got[-6][1]) == {"ID:team#5", "ID:team#7"}
    assert got[-9][1] == ["ID:flight#kl1234"]


def test_supersession_by_hand(spark):
    rows = PLANS["agg_corrections"].run(spark, SF).collect()[0]
    assert rows.corrected == rows.pairs == 3
    rows = PLANS["agg_safety"].run(spark, SF).collect()[0]
    assert rows.survive == rows.pairs
    assert PLANS["agg_invariant"].run(spark, SF).collect()[0].collapsed == 0


def test_packs_fit_the_budget(spark):
    for r in PLANS["q_pack"].run(spark, SF).collect():
        assert len(r.pack) <= 300 and len(set(r.pack.split("\n"))) == r.n_lines or not r.pack
