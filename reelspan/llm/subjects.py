"""Problem 9: the subject areas of each document.

Method: class-association rules. Labelled documents are cut into sentences; a
sentence's items are its words and its pairs of neighbouring words, whatever
their length, and it carries the areas of its document. Rules ``items -> area``
are mined by parallel pattern growth over whole sentences: the items are ordered
by frequency and dealt to groups; every sentence goes to the groups of its items
as the stretch up to the group's last item; each group grows the patterns that
end in its items from their conditional sentences. Support is the number of
documents with a sentence that has all the items, and is counted for every area
beside. No item is left out for what it tells by itself: all with the least
support are mined, alone and together, up to ``rule_items`` in a rule.

A rule holds if the lower bound of its confidence (Wilson, ``certainty`` standard
errors, for rules of several items ``joint_certainty``, as far more are tried)
lies far enough above the area's share of the labels. A rule that a more
general one makes redundant is pruned afterwards. What is left is calibrated: a
rule's evidence is the log odds of its smoothed confidence over those of the
area's share. Every sentence of every document is scored by the evidence of all
rules it matches. A document has each area of which at least ``share`` of its
sentences with an area speak.

The rules are fitted on at most ``fit_documents`` labelled documents, the first
in the order of a hash of their ids; that bound is the only one on the data, all
documents are scored, whole, where they lie.

Defined results: null and blank texts have no area; documents without any
matching sentence have none; repeated rows of one id count once; without labels
or documents there are no rules and no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.words import Tokens
from reelspan.session import materialise, ship

#: What may end a sentence or a clause of a prompt, at the end of a token.
ENDS = re.compile(r"[.!?;\u2026\u3002\uff01\uff1f\uff1b][\"'\u201d\u2019)\]]*$")
#: The mark of an event in a prompt.
EVENT = re.compile(r"E\d+[:\uff1a]", re.IGNORECASE)
#: Stands for the end of a line.
LINE = "\x02"
#: So many documents are scored together.
PART_DOCUMENTS = 500


class SentenceTokens(Tokens):
    """Tokens that also yield ``stop`` wherever a sentence, a line, a list item or a clause of a prompt ends."""

    def __init__(self, stop: object, code=None) -> None:
        super().__init__(code)
        self.stop = stop

    def coded(self, raw: str) -> tuple:
        if raw == LINE or EVENT.fullmatch(raw):
            return (self.stop,)
        found = super().coded(raw)
        return (*found, self.stop) if ENDS.search(raw) else found

    def of(self, text: str | None) -> list:
        return super().of(text.replace("\n", f" {LINE} ") if text else text)


def sentence_items(words: list[str]) -> list[str]:
    """What a sentence is known by: its words, and its pairs of neighbouring words; each once."""
    return list(dict.fromkeys([*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]))


@dataclass
class Rules:
    """Rules ``items -> area`` with calibrated evidence in log odds."""

    areas: list[object]
    evidence: dict[tuple[str, ...], list[tuple[int, float]]] = field(default_factory=dict)


def _transactions(documents: DataFrame, document_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = SentenceTokens(None)
        for batch in batches:
            keys, items = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for stop, sentence in groupby(tokens.of(body), lambda word: word is None):
                    if not stop and (found := sentence_items(list(sentence))):
                        keys.append(key)
                        items.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=batch.schema.field(0).type), pa.array(items, type=pa.list_(pa.string()))], names=["d", "items"])

    kind = documents.schema[document_id].dataType.simpleString()
    return documents.select(document_id, text).mapInArrow(run, f"d {kind}, items array<string>")


@dataclass
class Bounds:
    """What a rule must reach, for each area; ``share``: the area's share of the labels."""

    share: np.ndarray
    least: np.ndarray
    support: int
    certainty: float
    joint_certainty: float
    margin: float = 0.05

    @property
    def joint_support(self) -> int:
        """Fewer documents than these can't lift the lower bound of a rule of several items to the least confidence."""
        least = float(self.least.min())
        return max(self.support, math.ceil(self.joint_certainty**2 * least / (1 - least) - 1e-9)) if least < 1 else self.support

    def smooth(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Confidences (patterns x areas) drawn towards the share."""
        return np.minimum(0.999, (k + 2 * self.share) / (n[:, None] + 2))

    def holds(self, k: np.ndarray, n: np.ndarray, joint: bool = False) -> np.ndarray:
        """Where the lower bound of the confidence reaches the least one. ``joint``: of patterns of several items, of which far more are tried."""
        n = n[:, None].astype(np.float64)
        errors = self.joint_certainty if joint else self.certainty
        p, z = k / n, errors**2
        low = (p + z / (2 * n) - errors * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
        return low >= self.least


class Growth:
    """Sentences as rows of item numbers, most frequent first, and the patterns that grow from them."""

    def __init__(self, rows: list[np.ndarray], document: np.ndarray, areas: list[list[int]], n: np.ndarray, k: np.ndarray, bounds: Bounds, rule_items: int) -> None:
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.length = np.array([len(r) for r in rows], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.document = document
        self.many = np.array([len(a) for a in areas], dtype=np.int64)
        self.of = np.zeros((len(areas), max(1, self.many.max(initial=1))), dtype=np.int64)
        for row, a in enumerate(areas):
            self.of[row, : len(a)] = a
        #: of every single item: support, counts of the areas, smoothed confidence
        self.n, self.k, self.alone = n, k, bounds.smooth(k, n)
        self.bounds, self.rule_items = bounds, rule_items
        self.found: list[tuple[list[int], int, int, int]] = []

    def of_items(self, last: np.ndarray) -> list[tuple[list[int], int, int, int]]:
        """(items, area, support with the area, support) of the patterns of several items that end in one of these."""
        owner = np.repeat(np.arange(len(self.start)), self.length)
        order = np.argsort(self.flat, kind="stable")
        low, high = np.searchsorted(self.flat[order], last), np.searchsorted(self.flat[order], last, side="right")
        for item, a, b in zip(last.tolist(), low.tolist(), high.tolist(), strict=True):
            at = order[a:b]
            rows = owner[at]
            self._grow([item], self.n[item], self.k[item], self.alone[item][None], rows, at - self.start[rows])
        return self.found

    def _can_grow(self, k: np.ndarray, smooth: np.ndarray) -> np.ndarray:
        """Areas that a longer pattern could have a rule for that isn't redundant."""
        return (smooth < 1 - self.bounds.margin) & (k >= self.bounds.least * self.bounds.joint_support)

    def _grow(self, items: list[int], n: int, k: np.ndarray, general: np.ndarray, rows: np.ndarray, length: np.ndarray) -> None:
        """Grow one pattern by the items before it. ``rows``: its sentences; ``length``: how much of each lies before."""
        if len(items) >= self.rule_items or not self._can_grow(k, general[-1]).any():
            return
        total, areas = int(length.sum()), self.k.shape[1]
        if not total:
            return
        owner = np.repeat(rows, length)
        place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        item = self.flat[self.start[owner] + place]
        # a document counts once for a pattern, however many of its sentences have it
        once = np.unique(item * len(self.many) + self.document[owner], return_index=True)[1]
        single, of = item[once], self.document[owner[once]]
        support = np.bincount(single)
        counts = np.zeros(len(support) * areas, dtype=np.int64)
        for m in range(self.of.shape[1]):
            use = self.many[of] > m
            counts += np.bincount(single[use] * areas + self.of[of[use], m], minlength=len(counts))
        # an item that always comes with the pattern, or the pattern with it, adds nothing to what is known
        able = np.nonzero((support >= self.bounds.joint_support) & (support < n) & (support < self.n[: len(support)]))[0]
        counts = counts.reshape(-1, areas)[able]
        smooth = self.bounds.smooth(counts, support[able])
        known = np.maximum(self.alone[able], general.max(axis=0))
        good = self.bounds.holds(counts, support[able], True) & (smooth > known + self.bounds.margin)
        for which, area in zip(*np.nonzero(good), strict=True):
            self.found.append(([*items, int(able[which])], int(area), int(counts[which, area]), int(support[able[which]])))
        if len(items) + 1 < self.rule_items:
            for which in np.nonzero(self._can_grow(counts, smooth).any(axis=1))[0].tolist():
                at = np.nonzero(item == able[which])[0]
                self._grow([*items, int(able[which])], int(support[able[which]]), counts[which], np.vstack([general, self.alone[able[which]], smooth[which]]), owner[at], place[at])


_CANDIDATES = "items array<bigint>, area bigint, k bigint, n bigint"


def mined(sentences: DataFrame, areas: list[object], bounds: Bounds, rule_items: int) -> list[tuple[tuple[str, ...], int, int, int]]:
    """(items, area, documents with the area, documents) of all rules that hold, by parallel pattern growth.

    ``sentences``: (d, areas, items), those of the fitted sample, which bounds
    everything here that reaches the driver.
    """
    spark = sentences.sparkSession
    number = {a: k for k, a in enumerate(areas)}
    each = sentences.select("d", "areas", F.explode("items").alias("item")).dropDuplicates(["d", "item"])
    with_area = [F.count(F.when(F.array_contains("areas", a), 1)).alias(f"k{k}") for k, a in enumerate(areas)]
    frequent = each.groupBy("item").agg(F.count("*").alias("n"), *with_area).where(F.col("n") >= bounds.support)
    listed = frequent.orderBy(F.col("n").desc(), "item").collect()
    if not listed:
        return []
    names = [r["item"] for r in listed]
    n = np.array([r["n"] for r in listed], dtype=np.int64)
    k = np.array([[r[f"k{j}"] for j in range(len(areas))] for r in listed], dtype=np.int64)
    found = [((names[i],), int(a), int(k[i, a]), int(n[i])) for i, a in zip(*np.nonzero(bounds.holds(k, n)), strict=True)]
    if rule_items < 2:
        return found
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(names)}, n, k))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            group, rows, document, of = [], [], [], []
            for items, d, marks in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                codes = sorted(known[i] for i in items if i in known)
                ends = {code % groups: at for at, code in enumerate(codes)}
                for g, at in ends.items():
                    group.append(g)
                    rows.append(codes[: at + 1])
                    document.append(d)
                    of.append([number[m] for m in marks])
            lists = [pa.array(group, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(document, pa.int64()), pa.array(of, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(lists, names=["g", "row", "d", "areas"])

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        _, n, k = shared.value
        _, first, document = np.unique(table.column("d").to_numpy(), return_index=True, return_inverse=True)
        of = table.column("areas").take(pa.array(first)).to_pylist()
        growth = Growth([np.array(r, dtype=np.int64) for r in table.column("row").to_pylist()], document, of, n, k, bounds, rule_items)
        out = growth.of_items(np.arange(key[0].as_py(), len(n), groups))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.list_(pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["items", "area", "k", "n"])

    rows = sentences.select("items", F.xxhash64("d").alias("d"), "areas").mapInArrow(dealt, "g bigint, row array<bigint>, d bigint, areas array<bigint>")
    grouped = rows.groupBy("g").applyInArrow(grown, _CANDIDATES).collect()
    return found + [(tuple(sorted(names[i] for i in r["items"])), r["area"], r["k"], r["n"]) for r in grouped]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    document_id: str = "doc_id",
    text: str = "text",
    area: str = "subject_id",
    fit_documents: int = 3_000,
    least_documents: int = 4,
    least_gain: float = 0.5,
    certainty: float = 1.0,
    joint_certainty: float = 4.5,
    rule_items: int = 2,
) -> Rules:
    """Mine, prune and calibrate the rules."""
    ship(documents.sparkSession)
    marked = labels.where(F.col(document_id).isNotNull() & F.col(area).isNotNull()).groupBy(F.col(document_id).alias("d")).agg(F.array_sort(F.collect_set(area)).alias("areas"))
    chosen = materialise(marked.orderBy(F.xxhash64("d"), "d").limit(fit_documents))
    prior = {r["a"]: r["n"] for r in chosen.select(F.explode("areas").alias("a")).groupBy("a").agg(F.count("*").alias("n")).collect()}
    areas = sorted(prior)
    if not areas:
        return Rules([])
    bodies = documents.where(F.col(text).isNotNull()).select(F.col(document_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen.select("d")), "d", "left_semi")
    once = bodies.groupBy("d").agg(F.max("t").alias("t"))
    sentences = materialise(_transactions(once, "d", "t").join(F.broadcast(chosen), "d"))
    share = np.array([prior[a] for a in areas]) / chosen.count()
    # part of what there is to gain over guessing by the labels alone
    bounds = Bounds(share, share + (1 - share) * least_gain, least_documents, certainty, joint_certainty)
    return _calibrated(mined(sentences, areas, bounds, rule_items), areas, bounds)


def _calibrated(rules: list[tuple[tuple[str, ...], int, int, int]], areas: list[object], bounds: Bounds) -> Rules:
    """Prune redundant rules, the general ones first, and turn confidence into log odds over the area's share."""
    best: dict[tuple[tuple[str, ...], int], float] = {}
    kept = Rules(areas)
    for items, where, both, support in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        smooth = min(0.999, (both + 2 * bounds.share[where]) / (support + 2))
        general = [best[(sub, where)] for n in range(1, len(items)) for sub in combinations(items, n) if (sub, where) in best]
        if general and max(general) >= smooth - bounds.margin:
            continue
        best[(items, where)] = smooth
        base = min(bounds.share[where], 0.99)
        gain = math.log(smooth / (1 - smooth)) - math.log(base / (1 - base))
        if gain > 0:
            kept.evidence.setdefault(items, []).append((where, gain))
    return kept


class Scorer:
    """The rules as tables over word numbers."""

    def __init__(self, rules: Rules) -> None:
        self.count = len(rules.areas)
        vocabulary = sorted({w for items in rules.evidence for item in items for w in item.split(" ")})
        self.number = {w: k + 2 for k, w in enumerate(vocabulary)}  # 0: no word of a rule, 1: break
        self.base = len(self.number) + 2
        coded = {tuple(sorted(self._code(i) for i in items)): gains for items, gains in rules.evidence.items()}
        self.codes = np.array(sorted({c for codes in coded for c in codes}), dtype=np.int64)
        at = {c: k for k, c in enumerate(self.codes.tolist())}
        #: whether a word is an item by itself
        self.alone = np.zeros(self.base, dtype=bool)
        self.alone[[c // self.base for c in self.codes.tolist() if c % self.base == 0]] = True
        # rules of one item: the areas and gains of each item, one after the other
        lists = [coded.get((c,), []) for c in self.codes.tolist()]
        self.first, self.of_area, self.of_gain = _rows(lists)
        # rules of several items: by the one that comes with the fewest of them the others, each group one after the other
        joint = [(tuple(at[c] for c in codes), gains) for codes, gains in coded.items() if len(codes) > 1]
        self.joint: list[tuple[tuple[int, ...], list[tuple[int, float]]]] = joint
        degree = np.bincount([i for items, _ in joint for i in items], minlength=len(self.codes))
        by: list[list[tuple[int, float]]] = [[] for _ in self.codes]
        for rule, (items, _) in enumerate(joint):
            by[min(items, key=lambda i: (degree[i], i))].append((rule, 0.0))
        self.rule_first, self.rule_of, _ = _rows(by)
        most = max((len(items) for items, _ in joint), default=1)
        self.rule_items = np.array([list(items) + [items[0]] * (most - len(items)) for items, _ in joint], dtype=np.int64).reshape(-1, most)
        self.gain_first, self.gain_area, self.gain = _rows([gains for _, gains in joint])
        self.in_joint = degree > 0

    def _code(self, item: str) -> int:
        a, _, b = item.partition(" ")
        return self.number[a] * self.base + (self.number[b] if b else 0)

    def shares(self, flat: np.ndarray, lengths: np.ndarray, joint: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of sentences that speak of each area. ``joint``: by rules of several items too."""
        texts = len(lengths)
        counts = np.zeros((texts, self.count), dtype=np.int64)
        if not len(flat) or not len(self.codes):
            return counts, counts.sum(axis=1)
        owner = np.repeat(np.arange(texts), lengths)
        starts = np.concatenate([[1], (owner[1:] != owner[:-1]).astype(np.int64)])
        sentence = np.cumsum((flat == 1) | (starts == 1)) - 1
        known = flat >= 2
        pairs = np.nonzero(known[:-1] & known[1:] & (sentence[1:] == sentence[:-1]))[0]
        lone = np.nonzero(self.alone[flat])[0]
        code = np.concatenate([flat[pairs] * self.base + flat[pairs + 1], flat[lone] * self.base])
        at = np.concatenate([sentence[pairs], sentence[lone]])
        slot = np.searchsorted(self.codes, code)
        slot[slot == len(self.codes)] = 0
        hit = self.codes[slot] == code
        # each item of a sentence once
        items = len(self.codes)
        held = np.unique(at[hit] * items + slot[hit])
        where, which = held // items, held % items
        total = int(sentence[-1]) + 1
        line, entry = _spread(self.first, which)
        cell, gain = where[line] * self.count + self.of_area[entry], self.of_gain[entry]
        if joint and len(self.rule_items):
            some = np.nonzero(self.in_joint[which])[0]
            line, entry = _spread(self.rule_first, which[some])
            rule, at = self.rule_of[entry], where[some][line]
            present = held[some]
            for k in range(self.rule_items.shape[1]):
                wanted = at * items + self.rule_items[rule, k]
                there = np.searchsorted(present, wanted)
                there[there == len(present)] = 0
                good = present[there] == wanted
                rule, at = rule[good], at[good]
            line, entry = _spread(self.gain_first, rule)
            cell = np.concatenate([cell, at[line] * self.count + self.gain_area[entry]])
            gain = np.concatenate([gain, self.gain[entry]])
        score = np.bincount(cell, weights=gain, minlength=total * self.count).reshape(total, self.count)
        best = score.argmax(axis=1)
        speaks = score[np.arange(total), best] > 0
        first = np.zeros(total, dtype=np.int64)
        first[sentence] = owner
        np.add.at(counts, (first[speaks], best[speaks]), 1)
        return counts, counts.sum(axis=1)


def _rows(lists: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (number, value) one after the other: where each begins, the numbers, the values."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return first, np.array([k for x in lists for k, _ in x], dtype=np.int64), np.array([v for x in lists for _, v in x], dtype=np.float64)


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the lists of ``which``: the place in ``which``, and that of the entry."""
    many = first[which + 1] - first[which]
    line = np.repeat(np.arange(len(which)), many)
    return line, np.repeat(first[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def assign(documents: DataFrame, rules: Rules, document_id: str = "doc_id", text: str = "text", area: str = "subject_id", area_type: str = "bigint", share: float = 0.25) -> DataFrame:
    """(area, document, n_sentences, n_with_area): the areas of every document."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(rules)
    kind = documents.schema[document_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        areas = shared.value.areas
        number = scorer.number
        tokens = SentenceTokens(1, lambda word: number.get(word, 0))
        for whole in batches:
            # a part at a time: what a part needs is small beside the batch
            for low in range(0, whole.num_rows, PART_DOCUMENTS):
                batch = whole.slice(low, PART_DOCUMENTS)
                flat, lengths = [], []
                for body in batch.column(1).to_pylist():
                    found = tokens.of(body)
                    flat += found
                    lengths.append(len(found))
                counts, sums = scorer.shares(np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64))
                where, which = np.nonzero((counts > 0) & (counts >= share * sums[:, None]))
                if len(where):
                    columns = [pa.array([areas[k] for k in which.tolist()]), batch.column(0).take(pa.array(where)), pa.array(counts[where, which]), pa.array(sums[where])]
                    yield pa.RecordBatch.from_arrays(columns, names=[area, document_id, "n_sentences", "n_with_area"])

    usable = documents.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(document_id, text)
    return usable.mapInArrow(run, f"`{area}` {area_type}, `{document_id}` {kind}, n_sentences bigint, n_with_area bigint")
