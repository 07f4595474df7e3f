import random
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("reelspan.llm")

from hypothesis import given, settings
from hypothesis import strategies as st

from reelspan.llm.leaks import Pieces, _blocks, leaks, myers, piece_length
from reelspan.llm.packing import TokenCounter, Windows, pack, vocabulary_path
from reelspan.llm.subjects import Bounds, Growth, Rules, Scorer, assign, fit, sentence_items
from reelspan.llm.words import Tokens, split_words

DOCS = "doc_id long, text string, item_id long, subject_id string"


def distance_within(pattern, text):
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != t)))
        before = row
    return min(before)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=14))
def test_myers_is_the_edit_distance_to_the_best_stretch(pattern, text):
    bits = {}
    for k, p in enumerate(pattern):
        bits[p] = bits.get(p, 0) | 1 << k
    assert myers(bits, len(pattern), text) == distance_within(pattern, text)


def test_pieces():
    assert piece_length(16, 8) == 5


def brute_leak(item, text):
    for n in range(16, len(item) + 1):
        for s in range(len(item) - n + 1):
            if distance_within(item[s : s + n], text) <= n // 8:
                return True
    return False


def test_search_against_all_windows():
    rng = random.Random(1)
    names = [f"w{k}" for k in range(60)]
    items = [[rng.choice(names) for _ in range(rng.randrange(16, 34))] for _ in range(12)]
    texts = []
    for _ in range(150):
        item = rng.choice(items)
        n = rng.randrange(8, len(item) + 1)
        s = rng.randrange(len(item) - n + 1)
        part = list(item[s : s + n])
        for _ in range(rng.randrange(0, 5)):
            at, what = rng.randrange(len(part)), rng.randrange(3)
            if what == 0:
                part[at] = "zz"
            elif what == 1 and len(part) > 2:
                del part[at]
            else:
                part.insert(at, "yy")
        texts.append([rng.choice(names) for _ in range(rng.randrange(6))] + part + [rng.choice(names) for _ in range(rng.randrange(6))])
    index = Pieces([(k, " ".join(i)) for k, i in enumerate(items)], 16, 8)
    coded = [[index.vocabulary.get(w, 0) for w in t] for t in texts]
    got = set(index.search(np.array([w for t in coded for w in t]), np.array([len(t) for t in coded])))
    want = {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if brute_leak(item, text)}
    assert got == want


@pytest.mark.parametrize("lines", [1, 7, 100])
def test_pieces_that_many_items_share_are_looked_at_in_turn(monkeypatch, lines):
    rng = random.Random(2)
    common = [f"c{k}" for k in range(18)]
    items = [common + [f"i{k}w{j}" for j in range(rng.randrange(0, 12))] for k in range(25)]
    texts = [common + ["x"], ["y"] * 3 + items[4], common[:10], items[7][5:], []]
    index = Pieces([(k, " ".join(i)) for k, i in enumerate(items)], 16, 8)
    coded = [[index.vocabulary.get(w, 0) for w in t] for t in texts]
    flat, lengths = np.array([w for t in coded for w in t]), np.array([len(t) for t in coded])
    whole = set(index.search(flat, lengths))
    monkeypatch.setattr("reelspan.llm.leaks.LINES", lines)
    assert set(index.search(flat, lengths)) == whole == {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if brute_leak(item, text)}


def test_blocks_of_items_are_bounded(monkeypatch):
    monkeypatch.setattr("reelspan.llm.leaks.BLOCK_CHARS", 10)
    items = [(1, "aaaa"), (2, "bbbb"), (3, "cccc"), (4, "d" * 30), (5, "e")]
    assert [[k for k, _ in b] for b in _blocks(iter(items), 2)] == [[1, 2], [3], [4], [5]] and list(_blocks(iter([]), 2)) == []


@pytest.mark.parametrize("budget", [3, 4, 6])
@pytest.mark.parametrize("added", [True, False])
def test_longer_quotations_may_have_their_errors_in_one_place(budget, added):
    half = 4 * budget
    item = [f"w{k}" for k in range(2 * half + (0 if added else budget))]
    gap = [f"x{k}" for k in range(budget)] if added else []
    text = ["zz"] * 3 + item[:half] + gap + item[len(item) - half :] + ["zz"] * 3
    over = ["zz"] * 3 + item[:half] + [*gap, "yy"] + item[len(item) - half + (0 if added else 1) :] + ["zz"] * 3
    index = Pieces([(0, "a b"), (1, " ".join(item)), (2, " ".join(f"v{k}" for k in range(90)))], 16, 8)
    coded = [[index.vocabulary.get(w, 0) for w in t] for t in (text, over)]
    got = set(index.search(np.array([w for t in coded for w in t]), np.array([len(t) for t in coded])))
    assert got == {(t, 0) for t, one in enumerate((text, over)) if brute_leak(item, one)}
    assert (0, 0) in got


def test_leaks(spark):
    item = " ".join(f"word{k} số{k}" for k in range(12))
    words = item.split()
    marked = "<p> " + " ".join(f"<b>{w.upper()}</b>" for w in words[:16]) + " </p>"
    docs = [(1, "before " + item + " after"), (2, marked), (3, " ".join(words[:10])), (4, " ".join(reversed(words))), (5, None), (6, ""), (7, " ".join(words[2:12] + ["new"] + words[12:20])), (7, "x"), (8, "long " * 60_000 + item)]
    df = spark.createDataFrame([(d, t, 0, "clash") for d, t in docs], DOCS)
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (9, item), (12, " ".join(reversed(words)))], "item_id long, text string")
    want = {(9, 1), (9, 2), (9, 7), (9, 8), (12, 4)}
    assert {tuple(r) for r in leaks(df, items).collect()} == want
    assert {tuple(r) for r in leaks(df, items, block_items=1).collect()} == want
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def test_words():
    assert split_words("Đi_XE, [00:12] 12.5​km") == ("di", "xe", "12", "5km")
    tokens = Tokens()
    assert tokens.of("<b>Một</b> hai,ba") == ["mot", "hai", "ba"] and tokens.of(None) == []


def test_token_counts_are_those_of_the_encoding():
    counter = TokenCounter(Path(vocabulary_path()).read_bytes())
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Đường ", " ", "\n", "  ", "12", "'s", ".", " ", "👍", "x\n\n y", "\t"]) for _ in range(rng.randrange(1, 12)))
        assert counter.count(text) == len(counter.encoding.encode_ordinary(text)), repr(text)


def test_windows_are_bounded_and_best_fit():
    windows = Windows(10, 2)
    a, b = windows.place(4), windows.place(8)
    assert windows.place(2) == b and windows.place(6) == a
    assert windows.room == []
    for size in (9, 8, 7):
        windows.place(size)
    assert len(windows.room) == 2


def test_packing_is_whole(spark):
    rng = random.Random(3)
    rows = [(k, "chữ số 12 " * rng.randrange(1, 60)) for k in range(120)] + [(900, None), (901, "  \n"), (902, "x " * 5_000)]
    df = spark.createDataFrame([(d, t, 0, "clash") for d, t in rows], DOCS).repartition(3)
    out = pack(df, capacity=256, open_windows=4, merge_group=20).collect()
    fills, lengths = {}, {}
    for r in out:
        fills[r.container] = fills.get(r.container, 0) + r.n_tokens
        lengths.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    assert max(fills.values()) <= 256
    counter = TokenCounter(Path(vocabulary_path()).read_bytes())
    for d, t in rows:
        if t and not t.isspace():
            n = counter.count(t)
            pieces = sorted(lengths[d])
            assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == list(range(0, n, 256))
            assert len(pieces) == 1 or n > 256
        else:
            assert d not in lengths
    assert sum(fills.values()) / (256 * len(fills)) > 0.85
    assert pack(df.limit(0)).count() == 0


def test_subjects_are_learnt_and_shared_out(spark):
    rng = random.Random(4)
    terms = {a: [f"{a}noun{k} {a}tail{k}" for k in range(4)] for a in ("sport", "law")}
    say = lambda a: f"today {rng.choice(terms[a])} is in the news"
    docs, labels, truth = [], [], {}
    for d in range(240):
        a, b = rng.choice(["sport", "law"]), rng.choice(["sport", "law"])
        parts = [a] * 6 + [b] * (6 if d % 3 == 0 else 1)
        text = ". ".join(say(p) for p in parts) + ". nothing to see here.\n- the end"
        docs.append((d, text))
        truth[d] = {p for p in parts if parts.count(p) / len(parts) >= 0.25}
        if d < 150:
            labels += [(d, {"sport": 1, "law": 2}[p], "x") for p in truth[d]]
    docs += [(500, None), (501, " "), (502, "nothing to see here"), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, 0, "clash") for d, t in docs], DOCS).drop("subject_id")
    marked = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], "doc_id long, subject_id long, annotator string")
    got = {}
    for r in assign(df, fit(df, marked)).collect():
        got.setdefault(r.doc_id, set()).add({1: "sport", 2: "law"}[r.subject_id])
    right = sum(got.get(d) == t for d, t in truth.items())
    assert right >= 0.97 * len(truth) and not {500, 501, 502} & set(got)
    assert assign(df, fit(df, marked.limit(0))).count() == 0
    assert assign(df.limit(0), fit(df, marked)).count() == 0


def test_growth_finds_every_pair_that_holds():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(14, size=rng.integers(1, 8), replace=False)) for _ in range(400)]
    document = rng.integers(0, 150, size=400)
    of = [[int(a)] if rng.random() < 0.8 else [0, 1] for a in rng.integers(0, 2, size=150)]
    has = {i: {int(d) for r, d in zip(rows, document) if i in r} for i in range(14)}
    share = np.array([0.5, 0.5])
    bounds = Bounds(share, np.array([0.4, 0.4]), 3, 1.0, 1.0)
    n = np.array([len(has[i]) for i in range(14)])
    k = np.array([[sum(a in of[d] for d in has[i]) for a in (0, 1)] for i in range(14)])
    found = set()
    for group in range(3):  # dealt to groups, the same comes out
        growth = Growth(rows, document, of, n, k, bounds, 2)
        found |= {(*sorted(i), a, both, s) for i, a, both, s in growth.of_items(np.arange(group, 14, 3))}
    want = set()
    for i in range(14):
        for j in range(i):
            docs = {int(d) for r, d in zip(rows, document) if i in r and j in r}
            if len(docs) < bounds.joint_support or len(docs) in (n[i], n[j]):
                continue
            for a in (0, 1):
                both = np.array([[sum(b in of[d] for d in docs) for b in (0, 1)]])
                smooth = bounds.smooth(both, np.array([len(docs)]))[0, a]
                if bounds.holds(both, np.array([len(docs)]), True)[0, a] and smooth > max(bounds.smooth(k, n)[[i, j], a]) + bounds.margin:
                    want.add((j, i, a, int(both[0, a]), len(docs)))
    assert found == want and want


def test_items_have_every_length():
    assert sentence_items(["a", "b", "a", "b"]) == ["a", "b", "a b", "b a"]


def test_rules_of_several_items_need_all_of_them():
    rules = Rules(["x", "y"], {("a",): [(0, 1.0)], ("b", "c d"): [(1, 3.0)]})
    scorer = Scorer(rules)
    code = lambda text: [1 if w == "." else scorer.number.get(w, 0) for w in text.split()]
    texts = [code("a b . b c d a . c d"), code("b . c d"), code("c d z b"), []]
    counts, sums = scorer.shares(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    assert counts.tolist() == [[1, 1], [0, 0], [0, 1], [0, 0]] and sums.tolist() == [2, 0, 1, 0]


def test_areas_that_only_two_words_together_tell(spark):
    rng = random.Random(6)
    docs, labels, truth = [], [], {}
    for d in range(600):
        area = d % 2
        # either word alone stands in texts of both areas; which go together tells the area
        pairs = [("red", "ball"), ("blue", "court")] if area else [("red", "court"), ("blue", "ball")]
        a, b = rng.choice(pairs)
        docs.append((d, f"{a} {rng.choice('pqrs')} {rng.choice('tuvw')} {b}. nothing {rng.choice('xyz')} here"))
        truth[d] = area + 1
        if d < 400:
            labels.append((d, area + 1, "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rules = fit(df, spark.createDataFrame(labels, "doc_id long, subject_id long, annotator string"))
    assert all(len(items) == 2 for items in rules.evidence) and ("ball", "red") in rules.evidence
    got = {r.doc_id: r.subject_id for r in assign(df, rules).collect()}
    assert got == truth
    assert assign(df, fit(df, spark.createDataFrame(labels, "doc_id long, subject_id long, annotator string"), rule_items=1)).count() == 0


def test_full_pieces_need_no_window_and_names_repeat(spark):
    windows = Windows(10, 2, "p-")
    assert [windows.place(n) for n in (8, 7)] == ["p-00000001", "p-00000002"] and windows.place(10) == "p-00000003"
    assert [room for room, _ in windows.room] == [2, 3]
    df = spark.createDataFrame([(k, "word " * (k * 37 % 900)) for k in range(60)], "doc_id long, text string").repartition(3, "doc_id")
    first, second = (sorted(map(tuple, pack(df, capacity=300, open_windows=4).collect())) for _ in range(2))
    assert first == second and first
