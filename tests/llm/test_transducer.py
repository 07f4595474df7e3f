import unicodedata

import pytest

pytest.importorskip("reelspan.llm")

from hypothesis import given, settings
from hypothesis import strategies as st

from reelspan.llm.transducer import MappingConflict, Transducer, default_transducer, fold, touched, with_consistent_text

CASES = [
    ("ｃầ­ｕ νượｔ", "cầu vượt"), ("ngưо̛̀i đi xе máy", "người đi xe máy"), ("BÁC SĨ　KHOA", "BÁC SĨ KHOA"), ("ÐÍCH", "ĐÍCH"), (unicodedata.normalize("NFD", "Nguyễn"), "Nguyễn"),
    ("А НЕАТ-RЕSISТАNТ", "A HEAT-RESISTANT"), ("ὸ x", "ò x"), ("𝐁𝐨𝐥𝐝", "Bold"), ("（６８９５）", "(6895)"),
]
KEPT = ["НОВОСТИ ДНЯ 8443", "ΚΑΙΡΟΥ 933", "CNN НОВОСТИ НА", "ニュース速報", "5627½ km", "M³/S", "№ 12", "“x” – y", "Xin Chào", "", "plain"]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert default_transducer()(text) == want and default_transducer().needed(text)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert default_transducer()(text) == text and not default_transducer().needed(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aАοдЯ́̂ ​　Ａéế1-Ðｶﾞ½"), max_size=12))
def test_the_form_is_a_fixed_point(text):
    once = default_transducer()(text)
    assert default_transducer()(once) == once


def test_conflicts_are_refused():
    with pytest.raises(MappingConflict):
        Transducer(lookalikes={"　": "x"})
    with pytest.raises(MappingConflict):
        Transducer(lookalikes={"а": "a", "a": "b"}, invisible="b")


def test_fold():
    assert fold("Đường Ｎguyễn-Huệ_12") == "duongnguyenhue12" and fold(None) == "" and fold(unicodedata.normalize("NFD", "ế")) == "e"


def test_columns(spark):
    df = spark.createDataFrame([("ａ",), (None,), ("",), ("x" * 50_000 + "　",)], "t string")
    rows = with_consistent_text(df, "t").collect()
    assert [r.t_changed for r in rows] == [True, False, False, True] and rows[1].t_consistent is None
    with pytest.raises(ValueError):
        with_consistent_text(df.withColumn("t_changed", df.t), "t")
    assert with_consistent_text(df.limit(0), "t").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeouAdiyêớbｅｶﾊб" + "\u0301\u0302\u0323\u031b\u0303\u0306\u0327\uff9e\uff9f"), max_size=10))
def test_accents_of_every_stack_are_canonical(text):
    wide = text.translate({0xFF45: "e", 0xFF76: "\u30ab", 0xFF8A: "\u30cf", 0xFF9E: "\u3099", 0xFF9F: "\u309a"})
    assert default_transducer()(text) == unicodedata.normalize("NFC", wide)


@pytest.mark.parametrize(
    ("source", "want"),
    [("e\u0302\u0323", "ệ"), ("e\u0323\u0302", "ệ"), ("ê\u0323", "ệ"), ("ẹ\u0302", "ệ"), ("ｅ\u0302\u200b\u0323", "ệ"), ("xе\u0302\u0323", "xệ"), ("ｶﾞ", "ガ"), ("o\u031b\u0301", "ớ"), ("𝐞\u0301", "é")],
)
def test_a_source_of_several_characters_is_taken_whole(source, want):
    change = default_transducer()
    assert change(source) == want
    # the transitions lead from state to state to one target, and were there before any text
    if source[0] != "x":
        fresh = Transducer()
        state = fresh.begin[source[0]]
        for char in source[1:].replace("\u200b", ""):
            state = fresh.after[state][char]
        assert fresh.latin[state] == want


def test_states_made_on_the_way_are_forgotten():
    change = Transducer()
    change.LIMIT = len(change.plain) + 5
    stack = "\u0301\u0302\u0303\u0304\u0306"
    for letter in "bcdfgh":
        want = unicodedata.normalize("NFC", letter + stack + "\u0323")
        assert change(letter + stack + "\u0323") == want
    assert len(change.plain) <= change.LIMIT + 10


def test_the_filter_lets_every_text_that_changes_pass(spark):
    texts = [t for t, _ in CASES] + KEPT + ["a\u0301", "\u212b x", "x\u00a0y", "\U0001d400", "ок", "ế"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    passed = {r.k for r in df.where(touched(df.t)).collect()}
    assert {k for k, t in enumerate(texts) if default_transducer().needed(t)} <= passed
    assert {k for k, t in enumerate(texts) if default_transducer()._touched.search(t)} <= passed
    assert not {k for k, t in enumerate(texts) if t in ("ế", "plain", "“x” – y", "Xin Chào", "M³/S", "№ 12", "5627½ km")} & passed


def test_the_filter_of_the_jvm_holds_every_character_that_changes(spark):
    change = default_transducer()
    every = [c for c in [*change.begin, *change.joins] if change._touched.search(c)]
    df = spark.createDataFrame([(c,) for c in every], "t string")
    assert df.where(~touched(df.t)).count() == 0 and len(every) > 500
