"""Filters, lists and lookups."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_filters(mem: DataFrame, user_id=None, status="active", project_id=None, memory_types=None, scopes=None, min_confidence=None, min_importance=None) -> DataFrame:
    """The search filter with constants, which reach the scan (F1)."""
    tests = [
        None if user_id is None else F.col("user_id") == user_id,
        None if status is None else F.col("status") == status,
        None if project_id is None else F.col("project_id") == project_id,
        None if memory_types is None else F.col("memory_type").isin(*memory_types),
        None if scopes is None else F.col("scope").isin(*scopes),
        None if min_confidence is None else F.col("confidence") >= min_confidence,
        None if min_importance is None else F.col("importance_score") >= min_importance,
    ]
    return reduce(lambda df, t: df.where(t), (t for t in tests if t is not None), mem)


def is_valid(as_of: Column) -> Column:
    open_ = lambda c: F.col(c).isNull() | (F.col(c) > as_of)
    return open_("expires_at") & open_("valid_to")


def valid_at(mem: DataFrame, as_of: Column) -> DataFrame:
    """Rows that are neither expired nor past their validity (F2)."""
    return mem.where(is_valid(as_of))


def list_memories(mem: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    """A page of memories, the latest update first."""
    return apply_filters(mem, **filters).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def list_newest(df: DataFrame, created: str, ident: str, limit: int, **equal) -> DataFrame:
    """A page of tasks or masking logs, newest first, with equality filters."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df.orderBy(F.desc(created), ident).limit(limit)


def lookup(mem: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of many keys at once; a null in a key column equals a null."""
    k = keys.select(*(F.col(c).alias(f"_k_{c}") for c in on)).distinct()
    return mem.join(k, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on))).select(*mem.columns)


def _holder(wanted):
    return lambda value: _holds(value, wanted)


def _holds(value: Column, wanted) -> Column:
    """Whether a VARIANT holds a Python value: objects its fields, lists each of its elements somewhere,
    other values by type and equality (1 equals 1.0, but not "1" or true)."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        fields = (_holds(F.try_variant_get(value, "$[" + json.dumps(str(k)) + "]", "variant"), w) for k, w in wanted.items())
        found = reduce(lambda a, b: a & b, fields, kind.startswith("OBJECT"))
    elif isinstance(wanted, (list, tuple)):
        held = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        tests = (F.exists(held, _holder(w)) for w in wanted)
        found = reduce(lambda a, b: a & b, tests, kind.startswith("ARRAY"))
    elif wanted is None:
        found = F.is_variant_null(value)
    elif isinstance(wanted, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        exact = isinstance(wanted, int)
        same = F.try_variant_get(value, "$", "decimal(38,10)" if exact else "double") == (F.lit(str(wanted)).cast("decimal(38,10)") if exact else F.lit(wanted))
        found = number & same
    else:
        found = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(wanted))
    return F.coalesce(found, F.lit(False))


def metadata_contains(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose JSON text holds all of `wanted` (F7): objects by their fields at any depth, lists by
    elements (each wanted one equals or, an object or list, is held by one of the list), other values
    by type and equality.  Text that isn't JSON holds nothing."""
    return df.where(_holds(F.try_parse_json(column), wanted))


def metadata_matches(df: DataFrame, column: str, wanted: dict, name: str) -> DataFrame:
    """A row, with the name, for each of the named `wanted` that the JSON text holds (F7); each text is
    read and parsed once."""
    parsed = df.withColumn("_v", F.try_parse_json(column))
    held = F.array_compact(F.array(*(F.when(_holds(F.col("_v"), w), n) for n, w in wanted.items())))
    return parsed.withColumn(name, F.explode(held)).drop("_v")


def tenant_view(df: DataFrame, tenants: DataFrame, memories: DataFrame | None = None, column: str = "user_id") -> DataFrame:
    """Rows of the tenants (user_id); links and access logs: those whose memory is theirs (F8)."""
    if memories is None:
        return df.join(tenants.select(F.col("user_id").alias("_t")), F.col(column) == F.col("_t"), "left_semi")
    own = memories.join(tenants, "user_id", "left_semi").select(F.col("id").alias("_t"))
    return df.join(own, F.col(column) == F.col("_t"), "left_semi")


def key_prefix(mem: DataFrame, prefix: str, exclude_suffix: str | None = None) -> DataFrame:
    """Rows whose key begins with a prefix."""
    found = mem.where(F.col("memory_key").startswith(prefix))
    return found if exclude_suffix is None else found.where(~F.col("memory_key").endswith(exclude_suffix))


def namespaced(df: DataFrame, namespace: Column) -> DataFrame:
    """Keys as `namespace:key`."""
    return df.withColumn("memory_key", F.concat_ws(":", namespace, "memory_key"))


def as_of_view(versions: DataFrame, at: Column) -> DataFrame:
    """Of each key's version chain (user_id, memory_key, version, effective_from, ...) the version
    that was current at a time (F12)."""
    past = versions.where(F.col("effective_from") <= at)
    columns = [c for c in versions.columns if c not in ("user_id", "memory_key")]
    return past.groupBy("user_id", "memory_key").agg(F.max_by(F.struct(*columns), "version").alias("_v")).select("user_id", "memory_key", "_v.*")


def history(state: DataFrame, snapshots: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Current rows and superseded versions of upsert() as one table of versions with effective_from."""
    current = state.select(*key, "version", F.col("changed_at").alias("effective_from"), *columns)
    return current.unionByName(snapshots.select(*key, "version", "effective_from", *columns))


def as_of_join(versions: DataFrame, asked: DataFrame, key: list[str], at: str = "at", slice_: str = "day") -> DataFrame:
    """Each row of asked (key, `at`, ...) with the version of its key that was current at that time
    (F12): columns of versions beside the key, and `valid`, whether that version's row was valid then
    (valid_from, valid_to and expires_at, as far as versions have them).  Times before the first
    version give null and false.

    Versions and times stand in one sorted union, in which the last version before each time is
    carried on; there is no range join.  Time is cut into slices (of date_trunc), each of which starts
    with the version that slices before it end with, so a key of any length lies in many tasks."""
    fields = [c for c in versions.columns if c not in key]
    others = [c for c in asked.columns if c not in key]
    some = F.struct(*fields).alias("_v")
    rows = versions.select(*key, F.col("effective_from").alias("_t"), F.lit(1).alias("_kind"), some, F.lit(None).cast(asked.select(F.struct(*others)).schema[0].dataType).alias("_a"))
    times = asked.select(*key, F.col(at).alias("_t"), F.lit(2).alias("_kind"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), F.struct(*others).alias("_a"))
    rows = rows.unionByName(times).withColumn("_slice", F.date_trunc(slice_, "_t"))
    place = F.when(F.col("_kind") == 1, F.struct("_t", "_v.version"))
    ends = rows.groupBy(*key, "_slice").agg(F.max_by("_v", place).alias("_v"))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_v", F.last("_v", ignorenulls=True).over(earlier)).where("_v is not null")
    starts = starts.select(*key, F.col("_slice").alias("_t"), F.lit(0).alias("_kind"), "_v", F.lit(None).cast(rows.schema["_a"].dataType).alias("_a"), "_slice")
    order = Window.partitionBy(*key, "_slice").orderBy("_t", "_kind", F.col("_v.version"))
    found = rows.unionByName(starts).withColumn("_v", F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 2")
    valid = F.col("_v").isNotNull()
    for c in fields:
        if c == "valid_from":
            valid = valid & (F.col("_v.valid_from").isNull() | (F.col("_v.valid_from") <= F.col("_t")))
        elif c in ("valid_to", "expires_at"):
            valid = valid & (F.col(f"_v.{c}").isNull() | (F.col(f"_v.{c}") > F.col("_t")))
    return found.select(*key, "_a.*", *(F.col(f"_v.{c}").alias(c) for c in fields), valid.alias("valid"))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): scores within 0..1, authority within 1..4."""
    good = F.coalesce(F.col("confidence").between(0, 1) & F.col("importance_score").between(0, 1) & F.col("authority_level").between(1, 4), F.lit(False))
    return df.where(good), df.where(~good)
