import math
import random

import pytest

pytest.importorskip("reelspan.llm")

from reelspan.llm.borda import SCORES, borda, heads
from reelspan.llm.runs import runs
from reelspan.llm.topn import top_n

OCR = "video_id string, frame_id long, raw_text string, received_at timestamp, entity string, part int"


def readings(spark, rows):
    return spark.createDataFrame([(v, f, t, None, "clash", 1) for v, f, t in rows], OCR)


CAPTION = "Cầu vượt thép tại Yên Giao"
ROWS = [
    ("v", 1, CAPTION), ("v", 2, "CẦU VƯỢT THÉP TẠI YÊN GIAO"), ("v", 3, None), ("v", 4, "  "), ("v", 5, "cau vuot thpp tai yen giaa"), ("v", 5, "cau vuot thpp tai yen giaa"),
    ("v", 6, "other caption"), ("v", 7, CAPTION), ("v", 8, CAPTION), ("v", 9, CAPTION + " 12"), ("v", 10, CAPTION + " 13"), ("v", 11, CAPTION + " 13"),
    ("w", 1, CAPTION), (None, 1, CAPTION), ("w", None, CAPTION), ("x", 1, "..."), ("x", 2, "...") ,
]


def test_runs(spark):
    found = {(r.entity, r.first_at, r.last_at, r.n) for r in runs(readings(spark, ROWS)).collect()}
    assert found == {("v", 1, 5, 3), ("v", 6, 6, 1), ("v", 7, 8, 2), ("v", 9, 9, 1), ("v", 10, 11, 2), ("w", 1, 1, 1), ("x", 1, 2, 2)}
    assert runs(readings(spark, [])).count() == 0


def test_place_names_of_few_letters_are_captions_of_their_own(spark):
    # three edits apart; the last of each with two faults
    texts = ["Yên Hải: mưa lớn"] * 3 + ["Yên Hải: mxa lxn"] + ["Lũng Hải: mưa lớn"] * 3 + ["Lũng Hải: mxa lxn"] + ["Yên Hải: mưa lớn"] * 2
    found = {(r.first_at, r.last_at, r.n) for r in runs(readings(spark, [("v", k, t) for k, t in enumerate(texts)])).collect()}
    assert found == {(0, 3, 4), (4, 7, 4), (8, 9, 2)}
    cut = {(r.first_at, r.last_at, r.n) for r in runs(readings(spark, [("v", k, t) for k, t in enumerate(texts)]), part_span=3).collect()}
    assert cut == found
    # a text held twice has a fault itself, and the third lies three edits from it
    texts = ["Hạ Luận: trang nht ký lỗi", "Hạ Lun: tranq nhật ký lỗi", "Hạ Luận: trang nht ký lỗi"]
    assert [r.n for r in runs(readings(spark, [("v", k, t) for k, t in enumerate(texts)])).collect()] == [3]


def misread(rng, text):
    """With up to two letters misread, lost or doubled."""
    letters = list(text)
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        at = rng.randrange(len(letters))
        if letters[at].isalpha():
            letters[at] = rng.choice(["", "q", letters[at] * 2])
    return "".join(letters)


def test_the_size_of_the_parts_changes_nothing(spark):
    rng = random.Random(5)
    rows, at = [], -40
    names = ["Yên Hải", "Lũng Hải", "Hà Nội", "Đà Lạt"]
    for k in range(40):
        caption = f"{rng.choice(names)}: mưa lớn trên đường {k // 9}"
        for _ in range(rng.randrange(1, 14)):
            at += rng.randrange(1, 4)
            rows.append(("hot", at, misread(rng, caption)))
    rows += [("one", k, misread(rng, "the same caption all along")) for k in range(200)] + ROWS
    df = readings(spark, rows)
    plain, *cut = [sorted((r.entity, r.caption, r.first_at, r.last_at, r.n) for r in runs(df, part_span=span).collect()) for span in (10**9, 1, 7, 60)]
    assert all(one == plain for one in cut)
    assert len([r for r in plain if r[0] == "one"]) == 1 and sum(r[4] for r in plain if r[0] == "hot") == sum(r[0] == "hot" for r in rows)


def test_top_n_light_and_heavy_agree_with_sorting(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), f"q{rng.randrange(9)}", rng.randrange(40), rng.choice([0.5, 0.5, 0.7, None, math.nan, rng.random()])) for _ in range(600)]
    df = spark.createDataFrame(rows, "video_id string, query_id string, index_row long, score double")
    best = {}
    for v, q, r, s in rows:
        if v is not None and s is not None and s == s:
            best[(v, q, r)] = max(s, best.get((v, q, r), -1))
    want = set()
    for v in ("hot", "a"):
        mine = sorted((k for k in best if k[0] == v), key=lambda k: (-best[k], k[2], k[1]))[:10]
        want |= {(*k, n + 1) for n, k in enumerate(mine)}
    for bound in (10_000, 50):
        got = {(r.video_id, r.query_id, r.index_row, r["rank"]) for r in top_n(df, heavy_rows=bound, salts=4).collect()}
        assert got == want
    assert top_n(df.limit(0)).count() == 0


def test_borda_light_and_heavy_agree(spark):
    rng = random.Random(9)
    value = lambda: rng.choice([None, math.nan, 0.0, 1.0, 1.0, rng.random() * 100])
    rows = [(rng.choice(["q", "r", None]), rng.randrange(60), value(), value(), value(), value()) for _ in range(160)]
    df = spark.createDataFrame(rows, "query_id string, hypothesis_id long, " + ", ".join(f"{s} double" for s in SCORES))
    items = {}
    for q, h, *s in rows:
        if q is not None:
            old = items.setdefault((q, h), [None] * 4)
            for k, x in enumerate(s):
                if x is not None and x == x:
                    old[k] = x if old[k] is None else max(old[k], x)
    points = {}
    for q in ("q", "r"):
        mine = {h: s for (g, h), s in items.items() if g == q}
        m = len(mine)
        for h, s in mine.items():
            total = 0.0
            for k in range(4):
                known = [x[k] for x in mine.values() if x[k] is not None]
                place = (m + 1) / 2 if s[k] is None else 1 + sum(x > s[k] for x in known) + (sum(x == s[k] for x in known) - 1) / 2
                total += m - place
            points[(q, h)] = total
    for bound in (10_000, 20):
        got = borda(df, heavy_rows=bound, ranges=4).collect()
        assert {(r.query_id, r.hypothesis_id): r.points for r in got} == pytest.approx(points)
        for q in ("q", "r"):
            order = [r.hypothesis_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
            assert order == [h for _, h in sorted((k for k in points if k[0] == q), key=lambda k: (-points[k], k[1]))]
    assert borda(df.limit(0)).count() == 0


def test_head_must_be_among_the_best_tenth(spark):
    rows = [("q", k, float(k), float(k), float(k), float(k)) for k in range(20)] + [("few", 1, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_id string, hypothesis_id long, " + ", ".join(f"{s} double" for s in SCORES))
    assert [tuple(r) for r in heads(borda(df)).collect()] == [("q", 19)]
    with pytest.raises(ValueError):
        borda(df, weights={"no": 1.0})


def test_the_sure_item_need_not_be_first_by_points(spark):
    # 0 is first by three scores and just outside the best tenth by the fourth, 1 is second by all
    rows = [("q", k, float(-k), float(-k), float(-k), -0.5 if k == 2 else -2.5 if k == 0 else float(-k)) for k in range(20)]
    df = spark.createDataFrame(rows, "query_id string, hypothesis_id long, " + ", ".join(f"{s} double" for s in SCORES))
    ranking = borda(df)
    assert ranking.where("rank = 1").collect()[0].hypothesis_id == 0
    assert [tuple(r) for r in heads(ranking).collect()] == [("q", 1)]
