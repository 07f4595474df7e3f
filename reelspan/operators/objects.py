"""Object payloads of the two plain layouts: checks, detections, and what shapes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.operators.nested import LISTS, NAMES, _list, latest_records

# The parallel lists of one layout; all must be there.
PARALLEL = ("detection_scores", "detection_class_names", "detection_class_entities", "detection_boxes", "detection_class_labels")
MAX_DETECTIONS = 100


def _kind(value: Column) -> Column:
    return F.split(F.schema_of_variant(value), "[<(]")[0]


def _number(value: Column) -> Column:
    """A number, or text that is one; null for anything else."""
    return F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING"), F.try_variant_get(value, "$", "string").try_cast("double"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def _good_score(value: Column) -> Column:
    return F.coalesce(_finite(_number(value)) & _number(value).between(0, 1), F.lit(False))


def _good_box(value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce((F.size(items) == 4) & F.forall(items, lambda x: F.coalesce(_finite(_number(x)) & (_number(x) >= 0), F.lit(False))), F.lit(False))


def _warn(bad: Column, text: Column) -> Column:
    return F.when(bad, text)


def _at(place: Column, what: str) -> Column:
    return F.concat(F.lit("detection "), place.cast("string"), F.lit(" " + what))


def schema_warnings(df: DataFrame, key: str = "object_id", payload: str = "payload", received: str = "received_at") -> DataFrame:
    """(record, place, warning): what a payload breaks of its layout; place is null for the payload as a whole.

    A payload that isn't valid JSON has the warning ``not JSON``.
    """
    return _warned(latest_records(df, key, payload, received)).select("record", F.inline("warnings"))


def _warned(records: DataFrame) -> DataFrame:
    """Add ``warnings``: (place, warning) of each record."""
    root = F.col("root")
    has = {f: F.try_variant_get(root, f"$.{f}", "variant").isNotNull() for f in PARALLEL}
    any_parallel = F.coalesce(sum((h.cast("int") for h in has.values()), F.lit(0)) > 0, F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~h, f) for f, h in has.items()]))
    lists = {f: F.try_variant_get(root, f"$.{f}", "array<variant>") for f in PARALLEL}
    whole = F.coalesce(sum((x.isNotNull().cast("int") for x in lists.values()), F.lit(0)) == len(PARALLEL), F.lit(False))
    sizes = F.array_distinct(F.array(*[F.size(x) for x in lists.values()]))
    own = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), *[F.try_variant_get(root, f"$.{n}", "array<variant>") for n in LISTS])
    count = F.when(any_parallel, F.size(lists["detection_scores"])).otherwise(F.size(own))
    general = (
        F.when(root.isNull(), "not JSON")
        .when(any_parallel & (F.size(missing) > 0), F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(any_parallel & ~whole, "parallel fields must be lists")
        .when(any_parallel & (F.size(sizes) > 1), "parallel lists differ in length")
        .when(~any_parallel & own.isNull() & ~_kind(root).isin("OBJECT", "ARRAY"), "the root is no list and no object")
        .when(~any_parallel & own.isNull(), "unknown layout")
        .when(count > MAX_DETECTIONS, "too many detections")
    )
    records = records.select("record", "root", general.alias("general"), (any_parallel & whole & (F.size(sizes) == 1)).alias("parallel"), *[lists[f].alias(f) for f in PARALLEL], F.when(~any_parallel, own).alias("own"))

    def parallel(score: Column, i: Column) -> Column:
        text = lambda f: _kind(F.get(f, i)) == "STRING"
        label = _kind(F.get("detection_class_labels", i)).isin("STRING", "BIGINT")
        faults = [
            _warn(~_good_score(score), F.lit("invalid score")), _warn(~F.coalesce(text("detection_class_names"), F.lit(False)), F.lit("invalid class name")),
            _warn(~F.coalesce(text("detection_class_entities"), F.lit(False)), F.lit("invalid class entity")), _warn(~F.coalesce(label, F.lit(False)), F.lit("invalid class label")),
            _warn(~_good_box(F.get("detection_boxes", i)), F.lit("invalid box")),
        ]
        return F.transform(F.array_compact(F.array(*faults)), lambda w: F.struct(i.cast("long").alias("place"), w.alias("warning")))

    def listed(item: Column, i: Column) -> Column:
        get = lambda *names: F.coalesce(*[F.try_variant_get(item, f"$.{n}", "variant") for n in names])
        score, name, box = get("score", "confidence"), get(*NAMES), get("bbox", "box")
        there = lambda v: v.isNotNull() & (_kind(v) != "VOID")
        faults = [
            _warn(there(score) & ~_good_score(score), F.lit("invalid score")), _warn(there(name) & ~_kind(name).isin("STRING", "BIGINT", "BOOLEAN"), F.lit("invalid category")),
            _warn(there(box) & ~_good_box(box), F.lit("invalid box")),
        ]
        found = F.when(_kind(item) != "OBJECT", F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*faults)))
        return F.transform(found, lambda w: F.struct(i.cast("long").alias("place"), w.alias("warning")))

    nothing = F.expr("cast(array() as array<struct<place:bigint,warning:string>>)")
    each = F.when(F.col("parallel"), F.flatten(F.transform("detection_scores", parallel))).when(F.col("own").isNotNull(), F.flatten(F.transform("own", listed)))
    overall = F.when(F.col("general").isNotNull(), F.array(F.struct(F.lit(None).cast("long").alias("place"), F.col("general").alias("warning"))))
    return records.select("record", "root", F.concat(F.coalesce(overall, nothing), F.coalesce(each, nothing)).alias("warnings"))


def plain_detections(df: DataFrame, key: str = "object_id", payload: str = "payload", received: str = "received_at") -> DataFrame:
    """(record, place, score, labels) of payloads without warnings: labels folded, distinct, in order; score 1 where a listed detection has none.

    Detections without label are left out; payloads with any warning have none.
    """
    records = _warned(latest_records(df, key, payload, received))
    root = F.col("root")
    text = lambda v: F.lower(F.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), "(?U)\\s+", " ")))
    named = _list(root, "detection_class_names")
    tidy = lambda xs: F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (F.length(x) > 0)))

    def parallel(score: Column, i: Column) -> Column:
        labels = F.array(text(F.get(named, i)), text(F.get(_list(root, "detection_class_entities"), i)), text(F.get(_list(root, "detection_class_labels"), i)))
        return F.struct(i.cast("long").alias("place"), _number(score).alias("score"), tidy(labels).alias("labels"))

    own = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), *[F.try_variant_get(root, f"$.{n}", "array<variant>") for n in LISTS])

    def listed(item: Column, i: Column) -> Column:
        get = lambda *ns: F.coalesce(*[F.try_variant_get(item, f"$.{n}", "variant") for n in ns])
        return F.struct(i.cast("long").alias("place"), F.coalesce(_number(get("score", "confidence")), F.lit(1.0)).alias("score"), tidy(F.array(text(get(*NAMES)))).alias("labels"))

    scores = F.try_variant_get(root, "$.detection_scores", "array<variant>")
    found = F.when(scores.isNotNull(), F.transform(scores, parallel)).otherwise(F.transform(own, listed))
    # no filter: pushed below the projections it would have the warnings, and all they are made of, worked out twice
    found = F.when(F.size("warnings") == 0, found)
    return records.select("record", F.inline(found)).where(F.size("labels") > 0)


def payload_shapes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """How many payloads there are of each kind of root and set of top-level fields."""
    from reelspan.operators.nested import parsed

    rows = parsed(df.select(payload), payload)
    kind = F.when(F.col(payload).isNull(), "null").when(F.col("root").isNull(), "invalid").otherwise(F.lower(_kind(F.col("root"))))
    fields = F.when(kind == "object", F.array_join(F.array_sort(F.json_object_keys(F.to_json("root"))), ","))
    return rows.groupBy(kind.alias("kind"), fields.alias("fields")).agg(F.count("*").alias("n"))
