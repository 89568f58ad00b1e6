"""Upserts and other changes of the memory table as functions of (state, delta).

An identical write leaves the content as it was, so "identical" compares each write with the one
just before it: `lag` finds the changes of a key and a running sum numbers its versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERVER_KEY = ["user_id", "memory_key", "scope", "project_id"]
SIMPLE_KEY = ["user_id", "memory_key"]


FIRST = -(1 << 63)  # the place of a state's row before all writes


def _state_rows(state: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """A state as rows of a chain.  A state that upsert returned has created_at, updated_at and
    changed_at (of its content); what another lacks is taken from the times it has."""
    pick = lambda *names: F.col(next(n for n in names if n in state.columns))
    recency = F.col("recency_score") if "recency_score" in state.columns else F.lit(None).cast("double")
    return state.select(
        *key,
        F.lit(FIRST).alias("seq"),
        "content",
        pick("changed_at", "written_at", "updated_at").alias("written_at"),
        F.col("version").cast("int").alias("base"),
        pick("created_at", "written_at").alias("_created"),
        pick("updated_at", "written_at").alias("_touched"),
        recency.alias("_recency"),
        *carry,
    )


def chain(state: DataFrame | None, writes: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """Every state and write of each key in order, with content_hash, action, changed and version.
    writes: key columns, seq, content, written_at, `carry`; state: those of a former upsert."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = writes.select(*key, F.col("seq").cast("long").alias("seq"), "content", "written_at", none("int").alias("base"), F.col("written_at").alias("_created"), F.col("written_at").alias("_touched"), none("double").alias("_recency"), *carry)
    if state is not None:
        rows = _state_rows(state, key, carry).unionByName(rows)
    rows = rows.withColumn("content_hash", F.sha2("content", 256))
    order = Window.partitionBy(*key).orderBy("seq")
    before = F.lag("content_hash").over(order)
    rows = rows.withColumn("action", F.when(F.col("base").isNotNull(), "existing").when(F.row_number().over(order) == 1, "created").when(before.eqNullSafe(F.col("content_hash")), "skip_identical").otherwise("updated"))
    changed = F.when(F.col("action") == "existing", F.col("base")).when(F.col("action").isin("created", "updated"), 1).otherwise(0)
    return rows.withColumn("version", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def upsert(state: DataFrame | None, writes: DataFrame, key: list[str] = SERVER_KEY, carry: tuple[str, ...] = (), touch_on_skip: bool = True, first_wins: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state', snapshots, actions).

    state' has a row for each key: content, content_hash, version, created_at (of the key), changed_at
    (of the content), updated_at, recency_score and carry columns as of the last change; columns of
    first_wins keep their first value.  It is a state for the next call as it is.  touch_on_skip: an
    identical write still sets updated_at and recency_score.  recency_score is 1 for what was written
    and stays as it was for the rest.  valid_from, if carried, is by default the time of creation.
    snapshots: superseded versions with created_at, effective_from and superseded_at.  actions: each
    write with its action and version."""
    carry = list(carry)
    c = chain(state, writes, key, carry)
    if "valid_from" in carry:
        c = c.withColumn("valid_from", F.when(F.col("action") == "created", F.coalesce("valid_from", "written_at")).otherwise(F.col("valid_from")))
    change = F.when(F.col("action") != "skip_identical", F.col("seq"))  # null orders are left out by max_by
    touch = F.col("seq") if touch_on_skip else change
    last = F.max_by(F.struct("content", "content_hash", "version", F.col("written_at").alias("changed_at"), *carry), change)
    first = F.min_by(F.struct(F.col("_created").alias("created_at"), *first_wins), "seq")
    recency = F.max_by(F.when(F.col("base").isNull(), 1.0).otherwise(F.col("_recency")), touch)
    kept = c.groupBy(*key).agg(last.alias("l"), first.alias("f"), F.max_by("_touched", touch).alias("updated_at"), recency.alias("recency_score"))
    columns = ["l.content", "l.content_hash", "l.version", "f.created_at", "l.changed_at", "updated_at", "recency_score"]
    new = kept.select(*key, *columns, *(F.col(f"{'f' if x in first_wins else 'l'}.{x}").alias(x) for x in carry))
    order = Window.partitionBy(*key).orderBy("seq")
    versions = c.withColumn("created_at", F.first("_created").over(order)).where("action <> 'skip_identical'")
    snapshots = versions.withColumn("superseded_at", F.lead("written_at").over(order)).where("superseded_at is not null")
    snapshots = snapshots.select(*key, "version", "content", "content_hash", "created_at", F.col("written_at").alias("effective_from"), "superseded_at", *carry)
    actions = c.where("action <> 'existing'").select(*key, "seq", "action", "version", "content_hash", "written_at")
    return new, snapshots, actions


def contradictions(actions: DataFrame, key: list[str] = SERVER_KEY) -> DataFrame:
    """The `supersedes` self-link of each flagged update (U5): pass the flagged actions."""
    return actions.where("action = 'updated'").select(*key, "seq", F.lit("supersedes").alias("link_type"))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def set_status(mem: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Status changes (id, status, seq if there are several for an id) applied; the one of the greatest
    seq wins, then the greatest status (U7)."""
    order = F.struct("seq", "status") if "seq" in changes.columns else F.struct("status")
    new = changes.groupBy(F.col("id").alias("_id")).agg(F.max(order)["status"].alias("_status"))
    joined = mem.join(new, F.col("id") == F.col("_id"), "left")
    moved = F.col("_status").isNotNull()
    return joined.withColumns({"updated_at": F.when(moved, as_of).otherwise(F.col("updated_at")), "status": F.coalesce("_status", "status")}).select(*mem.columns)


def delete(mem: DataFrame, versions: DataFrame, ids: DataFrame, soft: bool, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ids (id) retracted, or removed with their versions (U8)."""
    if soft:
        return set_status(mem, ids.select("id", F.lit("retracted").alias("status")), as_of), versions
    gone = ids.select(F.col("id").alias("_id"))
    return mem.join(gone, F.col("id") == F.col("_id"), "left_anti"), versions.join(gone, F.col("memory_id") == F.col("_id"), "left_anti")


def update_fields(mem: DataFrame, patches: DataFrame) -> DataFrame:
    """Non-null columns of patches (id and any others) written over mem."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_p_{c}") for c in fields))
    return mem.join(p, F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields}).select(*mem.columns)


def create_links(mem: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links whose ends both exist, rejects)."""
    ids = mem.select("id")
    known = lambda df, c: df.join(ids.withColumnRenamed("id", f"_{c}"), F.col(c) == F.col(f"_{c}"), "left_semi")
    good = known(known(edges, "source_id"), "target_id")
    marked = edges.join(ids.select(F.col("id").alias("_s")).distinct(), F.col("source_id") == F.col("_s"), "left").join(ids.select(F.col("id").alias("_t")).distinct(), F.col("target_id") == F.col("_t"), "left")
    return good, marked.where("_s is null or _t is null").select(*edges.columns)


def enrich(writes: DataFrame, dim: int = 128) -> DataFrame:
    """Content masked, hashed, embedded before it is written."""
    from ..functions.masking import mask
    from ..functions.scoring import hash_embedding

    return mask(writes, "content").withColumn("content_hash", F.sha2("content", 256)).withColumn("embedding", hash_embedding(F.col("content"), dim))


def promote(insights: DataFrame, as_of: Column) -> DataFrame:
    """Insights (user_id, memory_key, content, thread_id) as writes with where they come from."""
    meta = F.to_json(F.struct(F.lit("conversation").alias("source"), "thread_id", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("promoted_at")))
    return insights.select("user_id", "memory_key", "content", F.lit("semantic").alias("memory_type"), F.lit(0.7).alias("importance_score"), F.lit(0.8).alias("confidence"), meta.alias("metadata"))
