"""Problem 7: texts packed into containers of a fixed number of tokens.

Method: bounded-space online packing. Every partition keeps at most
``open_windows`` containers open; a text goes into the open one it fits best; if
none fits and all are open, the fullest is emitted. What is still open at the
end of the partitions is merged: those fills are items again, packed the same
way, largest first, in groups of a bounded number.

A text is split only if it alone exceeds the capacity, into full pieces and a
rest; pieces are given as token ranges.

Tokens are those of a public byte-level BPE vocabulary.

Defined results: null and blank texts and rows without id are in no container;
repeated rows are packed as they come; an empty table gives no containers; other
columns don't matter.
"""

from __future__ import annotations

import base64
import importlib.util
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.session import materialise, ship

CAPACITY = 2_048
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: as given, or that of the installed public tokenizers."""
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / VOCABULARY)


class TokenCounter(dict):
    """What follows a space, up to the next one, to its number of tokens with that space.

    No pre-token reaches over a space that stands alone, as a space can only
    begin one; so a text is counted chunk by chunk, and each distinct chunk is
    encoded once. Texts with two spaces together or with space at their end are
    encoded whole.
    """

    LIMIT = 300_000

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        import tiktoken

        lines = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encoding = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self[chunk] = len(self.encoding.encode_ordinary(" " + chunk))
        return n

    def count(self, text: str) -> int:
        if "  " in text or text[-1:].isspace():
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.__getitem__, rest))


class Windows:
    """At most ``most`` open containers; sorted by room left. New ones are named ``prefix`` and a running number."""

    def __init__(self, capacity: int, most: int, prefix: str = "") -> None:
        self.capacity, self.most, self.prefix, self.opened = capacity, most, prefix, 0
        self.room: list[tuple[int, str]] = []

    def _named(self, new: str | None) -> str:
        self.opened += 1
        return new or f"{self.prefix}{self.opened:08d}"

    def place(self, size: int, new: str | None = None) -> str:
        """The container of an item of this size; ``new`` names it if it must be opened."""
        if size == self.capacity:
            return self._named(new)  # full at once, no window is needed
        at = bisect_left(self.room, (size, ""))
        if at < len(self.room):
            left, name = self.room.pop(at)  # best fit: the least room that suffices
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # emit the fullest
            left, name = self.capacity, self._named(new)
        if left > size:
            insort(self.room, (left - size, name))
        return name


def token_counts(documents: DataFrame, document_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(document, n_tokens) of every text that isn't blank.

    The vocabulary, a file of bounded size, is read on the driver and sent out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary_path(vocabulary)).read_bytes())
    kind = documents.schema[document_id].dataType.simpleString()
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            keep, counts = [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                if body and not body.isspace():
                    keep.append(k)
                    counts.append(counter.count(body))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(counts, pa.int64())], names=[document_id, "n_tokens"])

    usable = documents.where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).select(document_id, text)
    return usable.mapInArrow(run, f"`{document_id}` {kind}, n_tokens bigint")


def pack(
    documents: DataFrame,
    document_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    open_windows: int = 64,
    merge_group: int = 20_000,
    vocabulary: str | None = None,
) -> DataFrame:
    """(container, document, piece, first_token, n_tokens): where every piece of every text lies."""
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be positive")
    kind = documents.schema[document_id].dataType.simpleString()
    sizes = token_counts(documents, document_id, text, vocabulary)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # named by the partition: the same when a task is run again
        windows = Windows(capacity, open_windows, f"{TaskContext.get().partitionId():06d}-")
        for batch in batches:
            names, take, piece, first, many = [], [], [], [], []
            for k, size in enumerate(batch.column(1).to_pylist()):
                for n, at in enumerate(range(0, size, capacity)):
                    part = min(capacity, size - at)
                    names.append(windows.place(part))
                    take.append(k)
                    piece.append(n)
                    first.append(at)
                    many.append(part)
            columns = [pa.array(names, pa.string()), batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int64()), pa.array(first, pa.int64()), pa.array(many, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["container", document_id, "piece", "first_token", "n_tokens"])

    placed = materialise(sizes.mapInArrow(place, f"container string, `{document_id}` {kind}, piece bigint, first_token bigint, n_tokens bigint"))
    merged = _merged(placed, capacity, merge_group)
    moved = placed.join(merged, "container", "left").withColumn("container", F.coalesce("into", "container"))
    return moved.select("container", document_id, "piece", "first_token", "n_tokens")


def _merged(placed: DataFrame, capacity: int, group: int) -> DataFrame:
    """(container, into): containers with room, packed again, largest first, in groups of about ``group``."""
    fills = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).where(F.col("fill") < capacity)
    fills = materialise(fills)
    parts = max(1, -(-fills.count() // group))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(fill, name) for batch in batches for name, fill in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda row: (-row[0], row[1]))
        windows = Windows(capacity, len(rows) + 1)
        names = [name for _, name in rows]
        into = [windows.place(fill, name) for fill, name in rows]  # named by its first: the same when run again
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(into, pa.string())], names=["container", "into"])

    return fills.repartition(parts, F.xxhash64("container")).mapInArrow(merge, "container string, into string")
