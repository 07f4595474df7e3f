"""Problem 8: evaluation texts inside training texts.

Method: pigeonhole edit matching. A quotation of ``least`` words with an error
budget of one word in ``one_in`` is split into budget + 1 pieces; one of them is
left without error. Every place of a test item at which such a piece can begin
gives a piece; a document is searched for exact hits of the pieces, and each hit
is verified with Myers' bit-parallel edit distance, over words instead of
characters.

With n words and a budget of floor(n / one_in), n - budget words stand in at
most budget + 1 unbroken stretches, so some stretch has at least
``ceil((n - budget) / (budget + 1))`` words; for the shortest quotation that is
the piece length, and it is not less for longer ones. Of the longer ones those
of ``one_in`` words for each error are tried: any other holds one of them. Each
budget an item can have has its own filter of hits before verification.

The documents are read where they lie; nothing is shuffled but the found pairs.
The items are a stated query set: they come to the driver in blocks of at most
``block_items`` items and ``BLOCK_CHARS`` characters, one block at a time, and
every block is searched against all rows. What a block finds is written before
the next one is fetched, so the driver never holds more than one. A worker builds
a block's index once for all its tasks.

A piece that many items share is hit often; such hits are looked at for some items
after the other, at most ``LINES`` at once, so that neither it nor a long text
can fill a worker.

Defined results: null and blank texts and items shorter than the least
quotation are in no pair; repeated rows of one id count once; an empty table on
either side gives no pairs; other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.words import Tokens
from reelspan.session import materialise, ship

#: A block's text may have so many characters.
BLOCK_CHARS = 4_000_000
#: So many places of items are looked at together, or those of one item.
LINES = 2_000_000


def piece_length(least: int, one_in: int) -> int:
    budget = least // one_in
    return -(-(least - budget) // (budget + 1))


def myers(pattern_bits: dict[int, int], length: int, text: list[int]) -> int:
    """Smallest edit distance of the pattern to any stretch of the text.

    ``pattern_bits`` has, for each symbol, the bits of its places in the pattern.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score, best = full, 0, length, length
    for symbol in text:
        eq = pattern_bits.get(symbol, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d0 | plus)
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        # free start: no carry into the lowest bit
        up = (up << 1) & full
        down = (down << 1) & full
        plus = (down | ~(d0 | up)) & full
        minus = up & d0
        if score < best:
            best = score
    return best


class Pieces:
    """The items, the index of their pieces, and the search in one batch of documents."""

    def __init__(self, items: list[tuple[object, str]], least: int, one_in: int) -> None:
        self.least, self.one_in, self.size = least, one_in, piece_length(least, one_in)
        cache = Tokens()
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[object, list[int]]] = []
        for key, text in items:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in cache.of(text)]
            if len(tokens) >= least:
                self.items.append((key, tokens))
        places = defaultdict(list)
        for number, (_, tokens) in enumerate(self.items):
            for at, value in enumerate(self._hashes(np.array(tokens, dtype=np.uint64))):
                places[int(value)].append((number, at))
        self.values = np.array(sorted(places), dtype=np.uint64)
        # places of each piece, one after the other
        self.first = np.concatenate([[0], np.cumsum([len(places[int(v)]) for v in self.values])]).astype(np.int64)
        every = [x for v in self.values for x in places[int(v)]]
        self.of_item = np.array([i for i, _ in every], dtype=np.int64)
        self.of_place = np.array([p for _, p in every], dtype=np.int64)
        self.of_piece = np.repeat(np.arange(len(self.values)), np.diff(self.first))
        self.words = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.budgets = range(least // one_in, max([least, *self.words.tolist()]) // one_in + 1)
        # all items in one row, apart by more than a look around a piece reaches; -1 matches nothing
        self.margin = max(self.length(b) + 2 * b for b in self.budgets) + self.size
        self.begin, row = [], [np.full(self.margin, -1, dtype=np.int64)]
        at = self.margin
        for _, tokens in self.items:
            self.begin.append(at)
            row += [np.array(tokens, dtype=np.int64), np.full(self.margin, -1, dtype=np.int64)]
            at += len(tokens) + self.margin
        self.row = np.concatenate(row).astype(np.int32)
        self.begin = np.array(self.begin, dtype=np.int64)
        self.bits: dict[tuple[int, int, int], dict[int, int]] = {}

    def length(self, budget: int) -> int:
        """Words of the shortest quotation with this budget."""
        return max(self.least, budget * self.one_in)

    def _hashes(self, tokens: np.ndarray) -> np.ndarray:
        """A number for each stretch of ``size`` words."""
        count = len(tokens) - self.size + 1
        if count <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(count, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.size):
                out = (out ^ tokens[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out

    def search(self, flat: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (number of the text, number of an item it carries).

        ``flat`` has the words of all texts as numbers, 0 for a word of no item.
        """
        flat = flat.astype(np.int32)
        values = self._hashes(flat.astype(np.uint64))
        if not len(self.values) or not len(values):
            return []
        slot = np.searchsorted(self.values, values)
        slot[slot == len(self.values)] = 0
        hits = np.nonzero(self.values[slot] == values)[0]
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, hits, side="right")
        inside = hits + self.size <= ends[owner]  # not over the end of a text
        hits, owner = hits[inside], owner[inside]
        slot = slot[hits]
        found: list[tuple[int, int]] = []
        for low, high in self._item_ranges(slot):
            found += self._search_items(flat, lengths, ends, hits, owner, slot, low, high)
        return found

    def _item_ranges(self, slot: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of items whose places in all hits are no more than ``LINES``, or of one item."""
        hits = np.bincount(slot, minlength=len(self.values))
        each = np.bincount(self.of_item, weights=np.repeat(hits, np.diff(self.first)), minlength=len(self.items))
        ranges, low, total = [], 0, 0.0
        for item, lines in enumerate(each.tolist()):
            if item > low and total + lines > LINES:
                ranges.append((low, item))
                low, total = item, 0.0
            total += lines
        return [*ranges, (low, len(self.items))]

    def _search_items(self, flat: np.ndarray, lengths: np.ndarray, ends: np.ndarray, hits: np.ndarray, owner: np.ndarray, slot: np.ndarray, low_item: int, high_item: int) -> list[tuple[int, int]]:
        """The pairs of the items of a range."""
        # one line for each place of the piece; the places of a piece are in the order of their items
        first, last = self.first[slot], self.first[slot + 1]
        if (low_item, high_item) != (0, len(self.items)):
            of = self.of_piece * (len(self.items) + 1) + self.of_item
            first = np.searchsorted(of, slot * (len(self.items) + 1) + low_item)
            last = np.searchsorted(of, slot * (len(self.items) + 1) + high_item)
        many = last - first
        if not many.any():
            return []
        line = np.repeat(np.arange(len(hits)), many)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
        entry = first[line] + nth
        item, place = self.of_item[entry], self.of_place[entry]
        hits, owner = hits[line], owner[line]
        # of pieces that follow each other in text and item, the first stands for all
        stretch = np.lexsort((hits, hits - place, item))
        h, d, i = hits[stretch], (hits - place)[stretch], item[stretch]
        follows = np.concatenate([[False], (h[1:] == h[:-1] + 1) & (d[1:] == d[:-1]) & (i[1:] == i[:-1])])
        keep = stretch[~follows]
        unbroken = self.size - 1 + np.bincount(np.cumsum(~follows) - 1)  # words of the stretch that a hit stands for
        hits, owner, item, place = hits[keep], owner[keep], item[keep], place[keep]
        near: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        # what the stretches of a text and an item have beyond those too short for a piece
        _, pair = np.unique(owner * len(self.items) + item, return_inverse=True)
        beyond = np.bincount(pair, weights=unbroken - self.size + 1)[pair]
        left = np.arange(len(hits))
        for budget in self.budgets:
            length = self.length(budget)
            left = left[self.words[item[left]] >= length]
            # the longest stretch of such a quotation has so many words
            able = unbroken[left] >= -(-(length - budget) // (budget + 1))
            # and its budget + 1 stretches so many words together
            able &= beyond[left] >= length - budget - (self.size - 1) * (budget + 1)
            full, shared = self._near(flat, hits, item, place, left[able], budget)
            for k, n in zip(full.tolist(), shared.tolist(), strict=True):
                near[(int(owner[k]), int(item[k]))].append((-n, int(hits[k]), int(place[k])))
            left = np.setdiff1d(left, full, assume_unique=True)
        found = []
        for (text, item_number), pairs in near.items():
            end = int(ends[text])
            start = end - int(lengths[text])
            if self._verified(item_number, flat[start:end], [(at - start, p) for _, at, p in sorted(pairs)]):
                found.append((text, item_number))
        return found

    def _near(self, flat: np.ndarray, hits: np.ndarray, item: np.ndarray, place: np.ndarray, which: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the hits around which a quotation with this budget can lie, and their upper bounds of the matches."""
        length = self.length(budget)
        # close by first: a quotation goes on at one side of the piece at least
        side = min(self.size, -(-(length - self.size) // 2))
        beside = np.r_[-side:0, self.size : self.size + side]
        reach = length - self.size + budget
        wide = np.arange(-reach, self.size + reach)
        full, counts = [which[:0]], [which[:0]]
        step = max(1, 1_600_000 // len(wide))
        for low in range(0, len(which), step):
            part = which[low : low + step]
            if side > budget:
                part = part[self._shared(flat, hits[part], item[part], place[part], beside, budget) >= side - budget]
            shared = self._shared(flat, hits[part], item[part], place[part], wide, budget)
            enough = shared >= length - budget
            full.append(part[enough])
            counts.append(shared[enough])
        return np.concatenate(full), np.concatenate(counts)

    def _shared(self, flat: np.ndarray, hits: np.ndarray, item: np.ndarray, place: np.ndarray, around: np.ndarray, budget: int) -> np.ndarray:
        """How many words around each hit stand, shifted by no more than the budget, in the item: an upper bound of the matches."""
        own = flat.take(hits[:, None] + around[None, :], mode="clip")
        base = (self.begin[item] + place)[:, None] + around[None, :]
        same = np.zeros(own.shape, dtype=bool)
        for shift in range(-budget, budget + 1):
            same |= own == self.row.take(base + shift)
        same &= own != 0
        return same.sum(axis=1)

    def _verified(self, item: int, text: np.ndarray, hits: list[tuple[int, int]]) -> bool:
        """Whether some stretch of the item lies in the text within its budget."""
        tokens = self.items[item][1]
        total = len(tokens)
        own = np.array(tokens, dtype=text.dtype)
        # the shortest quotation first; longer ones can have their errors closer together
        for budget in range(self.least // self.one_in, total // self.one_in + 1):
            length = max(self.least, budget * self.one_in)
            done = set()
            for at, place in hits:
                first, last = max(0, place + self.size - length), min(total, place + length)
                if last - first < length:
                    continue
                around = np.arange(first, last)
                matched = np.zeros(len(around), dtype=bool)
                for shift in range(-budget, budget + 1):
                    there = around + (at - place + shift)
                    matched |= (there >= 0) & (there < len(text)) & (own[first:last] == text.take(there, mode="clip"))
                sums = np.convolve(matched, np.ones(length, dtype=np.int64), "valid")
                good = np.nonzero(sums >= length - budget)[0]
                for start in (good[np.argsort(-sums[good], kind="stable")] + first).tolist():
                    if start > place:
                        continue
                    low = max(0, at - (place - start) - budget)
                    if (start, low) in done:
                        continue
                    done.add((start, low))
                    region = text[low : at + (start + length - place) + budget].tolist()
                    if myers(self._bits(item, start, length), length, region) <= budget:
                        return True
        return False

    def _bits(self, item: int, start: int, length: int) -> dict[int, int]:
        key = (item, start, length)
        bits = self.bits.get(key)
        if bits is None:
            bits = defaultdict(int)
            for k, w in enumerate(self.items[item][1][start : start + length]):
                bits[w] |= 1 << k
            bits = dict(bits)
            if len(self.bits) < 50_000:
                self.bits[key] = bits
        return bits


def _blocks(items: Iterator, most: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded number and text; an item longer than the bound is a block by itself."""
    block, chars = [], 0
    for key, text in items:
        if block and (len(block) == most or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((key, text))
        chars += len(text)
    if block:
        yield block


def leaks(
    documents: DataFrame,
    items: DataFrame,
    document_id: str = "doc_id",
    document_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 16,
    one_in: int = 8,
    block_items: int = 5_000,
) -> DataFrame:
    """Distinct (item_id, document_id): the document carries at least ``least`` successive words of the item."""
    spark = documents.sparkSession
    ship(spark)
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(item_id).agg(F.max(item_text).alias("t"))
    texts = documents.where(F.col(document_id).isNotNull() & F.col(document_text).isNotNull()).select(F.col(document_id).alias("d"), F.col(document_text).alias("t"))
    kinds = f"`{item_id}` {items.schema[item_id].dataType.simpleString()}, `{document_id}` {documents.schema[document_id].dataType.simpleString()}"
    found, block = [], None
    for following in _blocks(wanted.toLocalIterator(), block_items):
        if block is not None:
            found.append(materialise(_searched(texts, block, kinds, item_id, document_id, least, one_in)))
        block = following
    if block is None:
        return spark.createDataFrame([], kinds)
    found.append(_searched(texts, block, kinds, item_id, document_id, least, one_in))
    return reduce(DataFrame.unionByName, found).distinct()


#: The index of the block a worker searches, by the block's name; one at a time.
_INDEX: dict[str, Pieces] = {}


def _index(name: str, block: list, least: int, one_in: int) -> Pieces:
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Pieces(block, least, one_in)
    return _INDEX[name]


def _searched(texts: DataFrame, block: list, kinds: str, item_id: str, document_id: str, least: int, one_in: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((uuid.uuid4().hex, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = shared.value
        index = _index(name, block, least, one_in)
        number = index.vocabulary
        tokens = Tokens(lambda word: number.get(word, 0))
        for batch in batches:
            flat, lengths = [], []
            for text in batch.column(1).to_pylist():
                found = tokens.of(text)
                flat += found
                lengths.append(len(found))
            pairs = index.search(np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64))
            if pairs:
                keys = batch.column(0).to_pylist()
                columns = [pa.array([index.items[i][0] for _, i in pairs]), pa.array([keys[d] for d, _ in pairs], type=batch.schema.field(0).type)]
                yield pa.RecordBatch.from_arrays(columns, names=[item_id, document_id])

    return texts.mapInArrow(run, kinds)
