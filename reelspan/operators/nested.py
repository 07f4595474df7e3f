"""Problem 3: deeply nested records as flat, linked tables.

Method: higher-order SQL projection. A payload is parsed once into a variant;
nested ``transform`` calls walk its lists and attach the record's key and the
place in every list passed, ``flatten`` joins the lists of one depth, and one
``inline`` for each target table emits its rows. Nothing is shuffled but the
choice of the latest row of each record.

Detections lie (a) at the places of a ``detection_class_names`` list, or (b) as
objects in a list: the container itself, or its ``detections``, ``objects`` or
``results``; sub-detections under ``parts`` or ``children`` of a detection. A
container is the payload, its ``data``, or an element of a ``frames`` list.

Defined results: a payload that is null, blank or not valid JSON is a record
without detections; a byte order mark is ignored; a JSON string that holds JSON
is read as that JSON, however often it is wrapped; of the rows of one record the
latest received counts, of equal times the one whose payload has the greatest
hash; rows without key are dropped; lists shorter than the class names leave nulls;
numbers given as strings are numbers; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields of the layouts.
LISTS = ("detections", "objects", "results")
KIDS = ("parts", "children")
NAMES = ("category", "label", "class_name", "name", "class_id")
SCORES = ("confidence", "score")
BOXES = ("box", "bbox")

_PLACE = "struct<det_path:string,label:string,node:variant>"
_DETECTION = "struct<det_path:string,parent_path:string,label:string,score:double,box:variant,node:variant>"


def _list(value: Column, field: str = "") -> Column:
    """The list at a field, or the value itself as a list; empty if it is none."""
    return F.coalesce(F.try_variant_get(value, "$" + (f".{field}" if field else ""), "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _text(value: Column, field: str = "") -> Column:
    """The scalar at a field as text; null if it is null or blank."""
    found = F.try_variant_get(value, "$" + (f".{field}" if field else ""), "string")
    return F.when(found.rlike("(?U)\\S"), found)


def _detection(path: Column, parent: Column, label: Column, score: Column, box: Column, node: Column) -> Column:
    return F.struct(
        path.alias("det_path"), parent.alias("parent_path"), label.alias("label"), score.alias("score"), box.alias("box"), node.alias("node")
    ).cast(_DETECTION)


def _objects(items: Column, prefix: Column, parent: Column, slim: bool) -> Column:
    """Detections of layout (b): the objects of a list that say what they are. ``slim``: only their places."""

    def one(item: Column, place: Column) -> Column:
        path, label = F.concat(prefix, place.cast("string")), F.coalesce(*[_text(item, n) for n in NAMES])
        if slim:
            return F.struct(path.alias("det_path"), label.alias("label"), item.alias("node")).cast(_PLACE)
        score = F.coalesce(*[F.try_variant_get(item, f"$.{s}", "string") for s in SCORES]).try_cast("double")
        box = F.coalesce(*[F.try_variant_get(item, f"$.{b}", "variant") for b in BOXES])
        return _detection(path, parent, label, score, box, item)

    return F.filter(F.transform(items, one), lambda d: d["label"].isNotNull())


def _named_places(container: Column, prefix: Column, slim: bool) -> Column:
    """Detections of layout (a): the places of parallel lists whose class name isn't blank."""
    scores, boxes = _list(container, "detection_scores"), _list(container, "detection_boxes")
    no_node = F.lit(None).cast("variant")

    def one(name: Column, place: Column) -> Column:
        path = F.concat(prefix, place.cast("string"))
        if slim:
            return F.struct(path.alias("det_path"), _text(name).alias("label"), no_node.alias("node")).cast(_PLACE)
        score = F.try_variant_get(F.get(scores, place), "$", "string").try_cast("double")
        return _detection(path, F.lit(None).cast("string"), _text(name), score, F.get(boxes, place), no_node)

    return F.filter(F.transform(_list(container, "detection_class_names"), one), lambda d: d["label"].isNotNull())


def _json(text: Column) -> Column:
    """A text as a variant; null if it isn't valid JSON from end to end."""
    # as the one element of a list, so that nothing may follow the value
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(text, "^\\s*\\ufeff+", ""), F.lit("]"))), "$", "array<variant>")
    return F.get(F.filter(F.array(whole), lambda values: F.size(values) == 1), F.lit(0))[0]


#: Only a payload that begins with a quotation mark can be JSON in a string.
_QUOTED = '^[\\s\ufeff]*"'


def _wraps(payload: Column) -> Column:
    """No less than how often a payload wraps JSON in strings.

    Each wrapping doubles the backslashes before a quotation mark and adds one, or
    writes them as ``u005c``; the innermost text may have none.
    """
    runs = F.regexp_extract_all(payload, F.lit(r"(?:\\|u005[cC])+"), F.lit(0))
    each = F.transform(runs, lambda r: F.floor(F.log2(F.length(r) + 1)) + F.regexp_count(r, F.lit("u005[cC]")))
    return F.when(payload.rlike(_QUOTED), F.coalesce(F.array_max(each), F.lit(0)) + 2).otherwise(0)


def _unwrapped(value: Column) -> Column:
    """The JSON that a JSON string holds; any other value as it is."""
    holds = F.try_variant_get(value, "$", "array<variant>").isNull() & F.try_variant_get(value, "$", "map<string,variant>").isNull()
    return F.when(holds, _json(F.try_variant_get(value, "$", "string"))).otherwise(value)


def parsed(df: DataFrame, payload: str) -> DataFrame:
    """Add ``root``: the payload as a variant, null if it isn't valid JSON. Of repeated keys the last counts.

    JSON in strings is unwrapped in a fold, as often as the payload at hand may
    need. Sets ``spark.sql.variant.allowDuplicateKeys``, without which repeated
    keys are no JSON.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col(payload)
    steps = F.sequence(F.lit(1), _wraps(text).cast("int"))
    inner = F.aggregate(steps, _json(text), lambda value, _: _unwrapped(value))
    return df.withColumn("root", F.when(text.rlike(_QUOTED), inner).otherwise(_json(text)))


def latest_records(df: DataFrame, key: str, payload: str, received: str) -> DataFrame:
    """(record, received, payload, root): the latest row of each record."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("record"), F.col(received).alias("received"), F.col(payload).alias("payload"))
    latest = Window.partitionBy("record").orderBy(F.col("received").desc_nulls_last(), F.xxhash64("payload").desc())
    once = rows.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") == 1).drop("_n")
    return parsed(once, "payload")


def _levels(records: DataFrame, depth: int, slim: bool = False) -> DataFrame:
    """Add ``level0`` .. ``level<depth>``: the detections of each depth of nesting."""
    root = F.col("root")
    place = lambda f, i: F.struct(F.concat(i.cast("string"), F.lit(".")).alias("prefix"), f.alias("v"))
    bare = lambda v: F.array(F.struct(F.lit("").alias("prefix"), v.alias("v")))
    data = F.try_variant_get(root, "$.data", "variant")
    containers = F.concat(bare(root), bare(data), F.transform(_list(root, "frames"), place), F.transform(_list(data, "frames"), place))
    records = records.withColumn("containers", F.filter(containers, lambda c: c["v"].isNotNull()))

    def top(c: Column) -> Column:
        none = F.lit(None).cast("string")
        found = [_objects(_list(c["v"], name), c["prefix"], none, slim) for name in ("", *LISTS)]
        return F.concat(_named_places(c["v"], c["prefix"], slim), *found)

    records = records.withColumn("level0", F.flatten(F.transform("containers", top)))
    for k in range(1, depth + 1):

        def below(d: Column) -> Column:
            return F.concat(*[_objects(_list(d["node"], name), F.concat(d["det_path"], F.lit(".")), d["det_path"], slim) for name in KIDS])

        records = records.withColumn(f"level{k}", F.flatten(F.transform(f"level{k - 1}", below)))
    return records


def unnested(df: DataFrame, key: str = "object_id", payload: str = "payload", received: str = "received_at", depth: int = 4, slim: bool = False) -> tuple[DataFrame, int]:
    """The latest records with their detections by depth, and the depth there is.

    ``depth`` is a first guess; it is doubled until no payload nests deeper. Only
    payloads that name as many lists of sub-detections are parsed for that, where
    they lie: a payload that is not the latest of its record can only make it
    greater.
    """
    names = F.regexp_count(F.col(payload), F.lit("(?:" + "|".join(KIDS) + ")[\\\\]*\""))
    most = int(df.agg(F.max(names)).first()[0] or 0)
    records = latest_records(df, key, payload, received)
    while most > depth:
        # every level is asked for: were only the last one, the optimizer would fold all of them into one expression
        deep = _levels(parsed(df.where(names > depth).select(F.col(payload).alias("payload")), "payload"), depth + 1, True)
        sizes = deep.agg(*[F.max(F.size(f"level{k}")).alias(f"n{k}") for k in range(depth + 2)]).first()
        if not sizes[f"n{depth + 1}"]:
            break
        depth *= 2
    depth = max(1, min(depth, most))
    return _levels(records, depth, slim), depth


def _coordinates(box: Column) -> Column:
    """xmin, ymin, xmax, ymax of a box given as object, as four numbers or as corner points; null if it is none of these."""
    number = lambda v: F.try_variant_get(v, "$", "string").try_cast("double")
    field = [F.try_variant_get(box, f"$.{n}", "string").try_cast("double") for n in ("xmin", "ymin", "xmax", "ymax")]
    items = _list(box)
    flat = F.transform(items, number)
    points = F.transform(items, lambda p: F.transform(_list(p), number))
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    corners = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return (
        F.when(field[0].isNotNull() & field[1].isNotNull() & field[2].isNotNull() & field[3].isNotNull(), F.array(*field))
        .when((F.size(flat) == 4) & F.forall(flat, lambda x: x.isNotNull()), flat)
        .when((F.size(points) > 0) & F.forall(points, lambda p: F.size(p) == 2), corners)
    )


def record_table(df: DataFrame, **names: str) -> DataFrame:
    """record, received, n_detections, n_sub_detections, valid: one row for each record."""
    records, depth = unnested(df, slim=True, **names)
    subs = sum((F.size(f"level{k}") for k in range(1, depth + 1)), F.lit(0))
    return records.select("record", "received", F.coalesce(F.size("level0"), F.lit(0)).cast("long").alias("n_detections"), F.coalesce(subs, F.lit(0)).cast("long").alias("n_sub_detections"), F.col("root").isNotNull().alias("valid"))


def _emitted(records: DataFrame, levels: list[str]) -> DataFrame:
    rows = records.select("record", F.inline(F.concat(*[F.coalesce(F.col(x), F.expr(f"cast(array() as array<{_DETECTION}>)")) for x in levels])))
    return rows.withColumn("corners", _coordinates(F.col("box"))).select(
        "record", "det_path", "parent_path", "label", "score", *[F.get("corners", F.lit(k)).alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    )


def detection_table(df: DataFrame, **names: str) -> DataFrame:
    """record, det_path, parent_path (null), label, score and box of every detection that is part of no other."""
    records, _ = unnested(df, **names)
    return _emitted(records, ["level0"])


def sub_detection_table(df: DataFrame, **names: str) -> DataFrame:
    """The same for sub-detections; parent_path is the detection they are part of."""
    records, depth = unnested(df, **names)
    return _emitted(records, [f"level{k}" for k in range(1, depth + 1)])


def detection_paths(df: DataFrame, **names: str) -> DataFrame:
    """Distinct (record, det_path) of all detections."""
    records, depth = unnested(df, slim=True, **names)
    paths = F.concat(*[F.transform(f"level{k}", lambda d: F.struct(d["det_path"].alias("det_path"))) for k in range(depth + 1)])
    return records.select("record", F.inline(F.array_distinct(paths)))
