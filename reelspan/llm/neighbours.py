"""Problem 2: the k most similar vectors of every vector.

Method: learned partitions. On a bounded sample the graph of nearest neighbours
is cut into balanced partitions; a small classifier (multinomial logistic
regression) learns to tell a vector's partition. Every vector lies in its most
probable partition and is searched for in several of the next probable ones:
those whose border with the home, where the classifier finds both equally
probable, is no further than ``reach``. The candidates are reranked by exact
cosine. With ``probes`` as many as there are partitions and an infinite ``reach``
every vector meets every other: that is the exact way.

No task holds a whole partition: by the sample's share of each partition its
entries are dealt to blocks of about ``block_rows`` and so are its searches; each
block of entries meets each block of searches. The blocks change the work of a
task, never the result.

Copies (also stretched ones) are one entry with a count and its ``k + 1`` lowest
rows, so a group of copies of any size costs no more than one vector; the rows
of large groups get the group's neighbours by a join afterwards.

The sample is at most ``sample_rows`` rows, the first in the order of a hash;
every row is indexed and searched for. Partitions have about ``partition_rows``
rows each until ``most_partitions`` of them; beyond that they grow, and with them
the number of their blocks.

Defined results: rows whose vector is null, of another length, all zero, or holds
a null or a number that isn't finite take no part; similarity is the cosine in
double precision, rounded to 6 decimals; equal similarities go to the lower row;
repeated rows of one id count once; rows may have fewer than k neighbours or
none; an empty table gives no pairs; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.session import materialise, ship

#: Members of large groups of copies are dealt to so many parts.
SALTS = 32

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one in double precision, and which can be."""
    matrix = matrix.astype(np.float64)
    with np.errstate(invalid="ignore"):
        good = np.isfinite(matrix).all(axis=1)
        largest = np.abs(matrix).max(axis=1, initial=0)
        good &= largest > 0
        matrix /= np.where(good, largest, 1)[:, None]  # no square can overflow or vanish
        return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None], good


def usable(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors and vectors as given of the usable rows of a batch (id, list of float)."""
    ids, lists = batch.column(0), batch.column(1)
    offsets = lists.offsets.to_numpy()
    sizes = offsets[1:] - offsets[:-1]
    fit = (sizes == dimension) & ~lists.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
    values = lists.values.to_numpy(zero_copy_only=False)  # a null is NaN
    rows = np.nonzero(fit)[0]
    matrix = values[(offsets[:-1][rows][:, None] + np.arange(dimension)[None, :])]
    unit, good = _units(matrix)
    return ids.to_numpy(zero_copy_only=False)[rows[good]].astype(np.int64), unit[good], matrix[good].astype(np.float32)


def copy_keys(unit: np.ndarray) -> np.ndarray:
    """Two numbers for each unit vector, the same for copies up to stretching."""
    cells = np.rint(unit * 1e5).astype(np.int64).astype(np.uint64)
    keys = np.empty((len(unit), 2), dtype=np.uint64)
    place = np.arange(1, unit.shape[1] + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, mix in enumerate(_MIX):
            mixed = (cells + place * mix) * (mix ^ (place << np.uint64(17)))
            mixed ^= mixed >> np.uint64(31)
            keys[:, k] = (mixed * mix).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


class Router:
    """The classifier: weights of each partition."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)
        squares = (self.weights**2).sum(axis=0)
        between = squares[:, None] + squares[None, :] - 2 * self.weights.T @ self.weights
        self.apart = np.sqrt(np.maximum(between, 1e-9))

    @property
    def partitions(self) -> int:
        return len(self.bias)

    def route(self, unit: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` partitions to search for each vector, home first, and which of them are near enough.

        The most probable partition is the home. Of the others those count whose
        border with it, where both are equally probable, is no further than
        ``reach``: a neighbour of the vector is likely to lie beyond it.
        """
        logits = unit.astype(np.float32) @ self.weights + self.bias
        home = logits.argmax(axis=1)
        away = (logits[np.arange(len(unit)), home][:, None] - logits) / self.apart[home]
        away[np.arange(len(unit)), home] = -1
        probes = min(probes, self.partitions)
        top = np.argpartition(away, probes - 1, axis=1)[:, :probes] if probes < self.partitions else np.tile(np.arange(self.partitions), (len(unit), 1))
        picked = np.take_along_axis(away, top, axis=1)
        order = np.argsort(picked, axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1), np.take_along_axis(picked, order, axis=1) <= reach


def balanced_partition(unit: np.ndarray, parts: int, neighbours: int = 8, rounds: int = 6, slack: float = 1.15) -> np.ndarray:
    """Cut the graph of nearest neighbours of the rows into ``parts`` balanced partitions.

    It begins with halving along the direction of greatest spread and goes on by
    moving vertices to the partition most of their neighbours are in, while there
    is room.
    """
    n = len(unit)
    label = np.zeros(n, dtype=np.int64)
    stack, made = [(np.arange(n), parts)], 0
    rng = np.random.default_rng(7)
    while stack:
        rows, share = stack.pop()
        if share == 1 or len(rows) < 2:
            label[rows] = made
            made += 1
            continue
        centred = unit[rows] - unit[rows].mean(axis=0)
        direction = rng.standard_normal(unit.shape[1])
        for _ in range(12):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        left = share // 2
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * left // share
        stack += [(order[:cut], left), (order[cut:], share - left)]
    parts = made
    k = min(neighbours, n - 1)
    if parts == 1 or k < 1:
        return label
    near, like = np.empty((n, k), dtype=np.int64), np.empty((n, k), dtype=np.float32)
    small = unit.astype(np.float32)
    for low in range(0, n, 2048):
        block = small[low : low + 2048] @ small.T
        block[np.arange(len(block)), np.arange(low, low + len(block))] = -2
        near[low : low + 2048] = np.argpartition(-block, k - 1, axis=1)[:, :k]
        like[low : low + 2048] = np.take_along_axis(block, near[low : low + 2048], axis=1)
    weight = np.maximum(like, 0) ** 4
    room = int(np.ceil(n / parts * slack))
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n).tolist():
            where = label[near[v]]
            pull = np.bincount(where, weights=weight[v])
            here = label[v]
            best = int(pull.argmax())
            if best != here and size[best] < room and pull[best] > (pull[here] if here < len(pull) else 0):
                label[v] = best
                size[here] -= 1
                size[best] += 1
                moved += 1
        if moved < n // 100:
            break
    return label


def fit_router(unit: np.ndarray, parts: int, epochs: int = 40) -> Router:
    """Partition the sample's graph and train the classifier on it."""
    parts = max(1, min(parts, len(unit) // 8))
    dimension = unit.shape[1]
    if parts == 1:
        return Router(np.zeros((dimension, 1)), np.zeros(1))
    label = balanced_partition(unit, parts)
    parts = int(label.max()) + 1
    x = unit.astype(np.float32)
    counts = np.maximum(np.bincount(label, minlength=parts), 1).astype(np.float32)
    centres = np.zeros((parts, dimension), dtype=np.float32)
    np.add.at(centres, label, x)
    weights = (12 * centres / counts[:, None]).T.copy()  # begin at the centres
    bias = np.zeros(parts, dtype=np.float32)
    m, v = [np.zeros_like(weights), np.zeros_like(bias)], [np.zeros_like(weights), np.zeros_like(bias)]
    rng, step = np.random.default_rng(11), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 1024):
            rows = order[low : low + 1024]
            logits = x[rows] @ weights + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            step += 1
            for k, (value, grad) in enumerate(((weights, x[rows].T @ p + 1e-5 * weights), (bias, p.sum(axis=0)))):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                value -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Router(weights, bias)


def _sample(vectors: DataFrame, dimension: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``most`` unit vectors, the first in the order of a hash of the id: copies once, and all; and the number of rows."""
    total = vectors.count()
    picked = vectors
    if total > most:
        cut = int(2**63 * min(1.0, 1.5 * most / total))
        picked = vectors.where(F.abs(F.xxhash64("id")) < F.lit(min(cut, 2**63 - 1)))
    rows = picked.select("id", F.col("v")).orderBy(F.abs(F.xxhash64("id")), "id").limit(most).toArrow()
    units = [usable(b, dimension)[1] for b in rows.to_batches()]
    every = np.concatenate(units) if units else np.empty((0, dimension))
    once = every[np.unique(copy_keys(every), axis=0, return_index=True)[1]] if len(every) else every
    return once, every, total


def blocks(router: Router, sample: np.ndarray, total: int, probes: int, reach: float, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each partition the number of blocks its entries, and its searches, are dealt to, as the sample has it."""
    entries, searches = np.zeros(router.partitions, np.int64), np.zeros(router.partitions, np.int64)
    if len(sample):
        top, wanted = router.route(sample, probes, reach)
        entries += np.bincount(top[:, 0], minlength=router.partitions)
        searches += np.bincount(top[wanted], minlength=router.partitions)
    rows = max(1.0, total / max(1, len(sample)))
    return tuple(np.maximum(1, np.ceil(x * rows / block_rows)).astype(np.int64) for x in (entries, searches))


def _entries(ids: np.ndarray, unit: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Copies together: the keys, the first of each, the number, and the ``keep`` lowest ids of each."""
    keys = copy_keys(unit)
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    sorted_keys = keys[order]
    new = np.concatenate([[True], (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)])
    starts = np.nonzero(new)[0]
    ends = np.concatenate([starts[1:], [len(order)]])
    ids = ids[order]
    lowest = [np.unique(ids[s:e])[:keep] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return sorted_keys[starts], order[starts], ends - starts, lowest


def nearest(
    vectors: DataFrame,
    row: str = "index_row",
    vector: str = "embedding",
    k: int = 5,
    least: float = 0.85,
    dimension: int = 64,
    sample_rows: int = 8_192,
    partition_rows: int = 4_000,
    most_partitions: int = 1_024,
    probes: int = 8,
    reach: float = 0.06,
    block_rows: int = 20_000,
) -> DataFrame:
    """(row, neighbour, similarity, rank): at most ``k`` neighbours of every row, at least ``least`` similar."""
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(F.col(row).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    unit, sample, total = _sample(source, dimension, sample_rows)
    router = fit_router(unit, min(most_partitions, max(1, round(total / partition_rows))))
    of_entries, of_searches = blocks(router, sample, total, probes, reach, block_rows)
    shared = spark.sparkContext.broadcast((router, of_entries, of_searches))
    keep = k + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit, given = usable(batch, dimension)
            if not len(ids):
                continue
            keys, first, count, lowest = _entries(ids, unit, keep)
            unit, given = unit[first], given[first]
            router, of_entries, of_searches = shared.value
            top, wanted = router.route(unit, probes, reach)
            # the home first, then each further partition it is searched for in
            where, nth = np.nonzero(wanted)
            part, home = top[where, nth], nth == 0
            mixed = keys[:, 0].view(np.uint64) >> np.uint64(3)
            own = (mixed % of_entries[top[:, 0]].astype(np.uint64)).astype(np.int64)  # the block of entries it lies in
            asks = (mixed[where] % of_searches[part].astype(np.uint64)).astype(np.int64)  # the block of searches it asks in
            # a search meets every block of entries
            line, entry = _counted(of_entries[part])
            at_home = home[line] & (entry == own[where[line]])
            rows = [(where[line], part[line], entry, asks[line], at_home, np.ones(len(line), dtype=bool))]
            # and an entry every other block of searches
            mine = np.nonzero(home)[0]
            line, search = _counted(of_searches[part[mine]])
            other = search != asks[mine[line]]
            line, search = mine[line[other]], search[other]
            rows.append((where[line], part[line], own[where[line]], search, np.ones(len(line), dtype=bool), np.zeros(len(line), dtype=bool)))
            where, part, entry, search, home, asking = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(search.astype(np.int32)),
                    pa.array(home),
                    pa.array(asking),
                    pa.array(keys[where, 0]),
                    pa.array(keys[where, 1]),
                    pa.array(count[where].astype(np.int64)),
                    pa.array([lowest[w].tolist() if h else [] for w, h in zip(where.tolist(), home.tolist(), strict=True)], type=pa.list_(pa.int64())),
                    pa.array([given[w].tobytes() for w in where.tolist()], type=pa.binary()),
                ],
                names=["part", "entry", "search", "home", "asks", "key0", "key1", "n", "rows", "vector"],
            )

    routed = source.mapInArrow(route, "part int, entry int, search int, home boolean, asks boolean, key0 long, key1 long, n long, rows array<long>, vector binary")
    # as many tasks as there are groups: a task has about one, however many rows there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, int((of_entries * of_searches).sum())))
    found = routed.repartition(tasks, "part", "entry", "search").groupBy("part", "entry", "search").applyInArrow(
        lambda group: pa.Table.from_batches(list(_reranked(group, dimension, keep, least)), schema=_FOUND),
        "key0 long, key1 long, n long, own array<long>, near array<struct<s:double,r:long>>",
    )
    # of each group of copies, what its partitions found
    lists = found.groupBy("key0", "key1").agg(F.max("n").alias("n"), F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("near")).alias("near"))
    ordered = F.array_sort(F.transform("near", lambda c: F.struct((-c["s"]).alias("d"), c["r"].alias("r"))))
    lists = materialise(lists.select("key0", "key1", "n", F.slice(F.array_sort(F.array_distinct("own")), 1, keep).alias("own"), F.slice(F.array_distinct(ordered), 1, keep).alias("best")))
    small = lists.select(F.explode("own").alias("a"), "best")
    # rows of large groups that are not among its lowest
    large = lists.where(F.col("n") > keep).select("key0", "key1", "own", "best")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit, _ = usable(batch, dimension)
            if len(ids):
                keys = copy_keys(unit)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(ids)], names=["key0", "key1", "a"])

    # a group of copies may hold a third of all rows: its members are dealt out, its one row to every part
    salted = source.mapInArrow(members, "key0 long, key1 long, a long").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rest = salted.join(large, ["key0", "key1", "salt"]).where(~F.array_contains("own", F.col("a"))).select("a", "best")
    every = small.unionByName(rest)
    others = F.slice(F.filter("best", lambda c: c["r"] != F.col("a")), 1, k)
    return every.select("a", F.posexplode(others).alias("p", "c")).select(
        F.col("a").alias(row), F.col("c.r").alias("neighbour"), (-F.col("c.d")).alias("similarity"), (F.col("p") + 1).cast("long").alias("rank")
    ).distinct()


def _counted(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places 0 .. ``many`` - 1 of every line the line, and the place."""
    line = np.repeat(np.arange(len(many)), many)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)


_FOUND = pa.schema(
    [("key0", pa.int64()), ("key1", pa.int64()), ("n", pa.int64()), ("own", pa.list_(pa.int64())), ("near", pa.list_(pa.struct([("s", pa.float64()), ("r", pa.int64())])))]
)


def _reranked(group: pa.Table, dimension: int, keep: int, least: float) -> Iterator[pa.RecordBatch]:
    """Exact cosines of one partition's searches against its entries."""
    group = group.combine_chunks()
    home, asks = group.column("home").to_numpy(), group.column("asks").to_numpy()
    keys = np.stack([group.column("key0").to_numpy(), group.column("key1").to_numpy()], axis=1)
    counts = group.column("n").to_numpy()
    unit = np.frombuffer(b"".join(group.column("vector").to_pylist()), dtype=np.float32).reshape(-1, dimension)
    lists = group.column("rows").to_pylist()
    # entries of one key that come from several batches are one
    distinct, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    at_home = np.zeros(len(distinct), dtype=bool)
    np.logical_or.at(at_home, inverse, home)
    asking = np.zeros(len(distinct), dtype=bool)
    np.logical_or.at(asking, inverse, asks)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, inverse[home], counts[home])
    rows: list[list[int]] = [[] for _ in distinct]
    for k in np.nonzero(home)[0].tolist():
        rows[inverse[k]] += lists[k]
    rows = [sorted(set(r))[:keep] for r in rows]
    exact, _ = _units(unit[first])
    unit = exact.astype(np.float32)
    base = np.nonzero(at_home)[0]
    entries = unit[base]
    flat, owner = [], []
    asked = np.nonzero(asking)[0]
    for low in range(0, len(asked), 1024):
        block = unit[asked[low : low + 1024]] @ entries.T
        q, e = np.nonzero(block > least - 1e-4)
        # beyond the k + 1 most similar entries only equal similarities can matter
        if len(q):
            s = block[q, e]
            order = np.lexsort((-s, q))
            q, e, s = q[order], e[order], s[order]
            begin = np.concatenate([[0], np.nonzero(q[1:] != q[:-1])[0] + 1])
            nth = np.arange(len(q)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(q)]])))
            bound = np.full(len(block), -1.0, dtype=np.float32)
            bound[q[nth == keep]] = s[nth == keep]
            use = s >= bound[q] - 3e-6
            owner.append(asked[q[use] + low])
            flat.append(base[e[use]])
    out_near: list[list[dict]] = [[] for _ in distinct]
    if flat:
        q, e = np.concatenate(owner), np.concatenate(flat)
        sims = np.round(np.einsum("ij,ij->i", exact[q], exact[e]), 6)
        good = sims >= least
        for a, b, s in zip(q[good].tolist(), e[good].tolist(), sims[good].tolist(), strict=True):
            out_near[a] += [(s, r) for r in rows[b]]
    picks = []
    for a, found in enumerate(out_near):
        if len(found) > 1 or (found and not at_home[a]):
            found.sort(key=lambda c: (-c[0], c[1]))
            picks.append((a, found[:keep]))
        elif at_home[a] and found:
            picks.append((a, found))
    if picks:
        which = np.array([a for a, _ in picks])
        lengths = np.concatenate([[0], np.cumsum([len(f) for _, f in picks])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([s for _, f in picks for s, _ in f], pa.float64()), pa.array([r for _, f in picks for _, r in f], pa.int64())], names=["s", "r"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(distinct[which, 0]),
                pa.array(distinct[which, 1]),
                pa.array(total[which]),
                pa.array([rows[a] for a in which.tolist()], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(lengths), values),
            ],
            schema=_FOUND,
        )
