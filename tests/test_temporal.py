import itertools
import random

import pytest

from reelspan.operators import temporal

SCHEMA = "query_id string, event long, rank long, index_row long, video_id string, frame long, score double"


def worth(chain, events, max_gap, penalty, bonus):
    score = sum(r[4] for r in chain) - sum(penalty * (b[1] - a[1]) / max_gap for a, b in itertools.pairwise(chain))
    whole = len(chain) == events
    return (not whole, -len(chain), -(score + (bonus if whole else 0)), min(r[2] for r in chain), tuple(r[3] for r in chain)), score


def dynamic(rows, events, max_gap, penalty, bonus):
    """Of each hit the best chain that ends in it, by trying all that end in the event before."""
    ends, best = {}, None
    for event in range(events):
        here = {}
        for r in (x for x in rows if x[0] == event):
            options = [((*ends[q], r) if q is not None else (r,)) for q in [None, *[q for q in ends if 0 < r[1] - q[1] <= max_gap]]]
            here[r] = min(options, key=lambda c: worth(c, events, max_gap, penalty, bonus)[0])
            best = min([here[r], *([best] if best else [])], key=lambda c: worth(c, events, max_gap, penalty, bonus)[0])
        ends = here
    return best


def test_chains_are_those_of_a_walk_over_all_hits(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(60):
        cells = [(rng.randrange(3), rng.randrange(13)) for _ in range(rng.randrange(1, 9))]
        hits_of = [(e, f, k + 1, k, 1 / (61 + k)) for k, (e, f) in enumerate(cells)]
        rows += [(f"q{q}", e, k, r, "v", f, 0.0) for e, f, k, r, _ in hits_of]
        want[f"q{q}"] = dynamic(hits_of, 3, 6, 0.25, 1.0)
    found = temporal.event_chains(spark.createDataFrame(rows, SCHEMA), 3, max_gap=6).collect()
    got = {r.query_id: r for r in found}
    assert {q: list(r.rows) for q, r in got.items()} == {q: [h[3] for h in chain] for q, chain in want.items()}
    for q, chain in want.items():
        key, score = worth(chain, 3, 6, 0.25, 1.0)
        assert abs(got[q].score - (score + (len(chain) == 3))) < 1e-8 and got[q].best_rank == min(h[2] for h in chain)


def test_chains_of_nothing_and_too_many_events(spark):
    assert temporal.event_chains(hits(spark, []), 2).count() == 0
    with pytest.raises(ValueError):
        temporal.event_chains(hits(spark, []), 5)


def hits(spark, rows):
    return spark.createDataFrame([("q", e, k, r, v, f, s) for e, k, r, v, f, s in rows], SCHEMA)


def test_chains_cannot_skip_the_middle_event(spark):
    df = hits(spark, [(0, 1, 1, "v", 10, 0.9), (2, 1, 2, "v", 20, 0.9), (0, 2, 3, "w", 10, 0.5), (1, 1, 4, "w", 20, 0.5), (2, 2, 5, "w", 30, 0.5), (1, 2, 6, None, 5, 0.1)])
    out = temporal.event_chains(df, 3, prefer_final=True).orderBy("rank").collect()
    assert [(r.video_id, r.coverage, r.whole, r.shown_row) for r in out] == [("w", 3, True, 5), ("v", 1, False, 1)]
    fused = spark.createDataFrame([("q", 1, 1, "v", 10, 0.5), ("q", 2, 5, "w", 30, 0.1)], "query_id string, rank long, index_row long, video_id string, frame long, score double")
    boosted = temporal.boosted_by_chains(fused, temporal.event_chains(df, 3, prefer_final=True)).orderBy("rank").collect()
    assert [r.index_row for r in boosted] == [5, 1]


def test_paths_against_all_combinations(spark):


    rng = random.Random(3)
    rows = [(e, k + 1, 100 * e + k, rng.choice("ab"), rng.randrange(30), round(rng.random(), 3)) for e in range(3) for k in range(10)]
    out = temporal.event_paths(hits(spark, rows), 3).collect()
    best = {}
    for v in "ab":
        for c in itertools.product(*[[r for r in rows if r[0] == e and r[3] == v] for e in range(3)]):
            if c[0][4] < c[1][4] < c[2][4]:
                score = sum(r[5] for r in c) - 0.01 * (c[2][4] - c[0][4])
                key = (v, c[2][2])
                best[key] = max(best.get(key, -9), score)
    assert abs(max(r.score for r in out) - max(best.values())) < 1e-6
    assert len(out) <= len(best) and all(a < b for r in out for a, b in itertools.pairwise(r.frames))


def test_equal_paths_prefer_the_later_video_name(spark):
    df = hits(spark, [(0, 1, 1, "v1", 10, 0.5), (0, 2, 2, "v2", 10, 0.5), (1, 1, 3, "v1", 20, 0.5), (1, 2, 4, "v2", 20, 0.5)])
    assert temporal.event_paths(df, 2).orderBy("rank").first().video_id == "v2"
    assert temporal.event_paths(hits(spark, [(0, 1, 1, "v1", 10, 0.5)]), 2).count() == 0
