"""Export and import of memories as JSON records.

An export is many records: of each user a header, parts of its memories in the order of creation, and
parts of the links that touch them.  A part holds a bounded number of items, so no row grows with a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.upsert import SERVER_KEY, upsert

VERSION = "version int, content string, content_hash string, status string, confidence double, importance_score double, created_at string, superseded_at string"
MEMORY = (
    "id bigint, memory_key string, memory_type string, scope string, content string, content_hash string, status string, authority_level bigint, confidence double, importance_score double, "
    f"version int, created_at string, updated_at string, versions array<struct<{VERSION.replace(' ', ':').replace(',:', ',')}>>"
)
RECORD = f"kind string, user_id long, part long, memory_count long, memories array<struct<{MEMORY.replace(', ', ',').replace(' ', ':')}>>, links array<struct<source_id:bigint,target_id:bigint,link_type:string>>"
WRITTEN = ("memory_type", "authority_level", "confidence", "importance_score")


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss").alias(column)


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """rows numbered (_n) in ranges of (user, order)."""
    return rows.repartitionByRange("user_id", *order).sortWithinPartitions("user_id", *order).withColumn("_n", F.monotonically_increasing_id())


def _parts(placed: DataFrame, item: Column, name: str, size: int) -> DataFrame:
    """Records of `size` items at most of a user: user_id, part, n, items; neighbours of _placed share
    a part.  They lie in ranges of (user, part), by which they are also grouped: one shuffle of the items."""
    ranged = placed.withColumn("part", F.floor(F.col("_n") / size)).repartitionByRange("user_id", "part")
    part = ranged.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_n", item.alias("x")))).alias("x"))
    return part.select("user_id", "part", "n", F.transform("x", lambda x: x["x"]).alias(name))


def export_records(mem: DataFrame, links: DataFrame, as_of: Column, versions: DataFrame | None = None, status: list[str] | None = None, types: list[str] | None = None, size: int = 1000) -> DataFrame:
    """The records of every user (S3): user_id, kind (header, memories, links), part, n (items), value
    (JSON).  versions: memory_id, version, content, ..., which stand in their memories; a user's links
    are all that touch its memories, whoever owns their other end."""
    rows = mem if status is None else mem.where(F.col("status").isin(*status))
    rows = rows if types is None else rows.where(F.col("memory_type").isin(*types))
    own = rows.select("user_id", "id")
    # only ids are dealt by range; their numbers are joined to the texts
    places = _placed(rows.select("user_id", "created_at", "id"), ["created_at", "id"]).select("id", "_n")
    old = F.array().cast(f"array<struct<{VERSION.replace(' ', ':').replace(',:', ',')}>>")
    if versions is not None:
        fields = [F.col(c.split()[0]) if c.split()[0] in versions.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in VERSION.split(", ")]
        fields = [_stamp(c) if c in ("created_at", "superseded_at") and c in versions.columns else f for c, f in zip((c.split()[0] for c in VERSION.split(", ")), fields)]
        held = versions.groupBy(F.col("memory_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_versions"))
        rows = rows.join(held, F.col("id") == F.col("_id"), "left")
        old = F.coalesce("_versions", old)
    names = ["id", "memory_key", "memory_type", "scope", "content", "content_hash", "status", "authority_level", "confidence", "importance_score", "version"]
    item = F.struct(*names, _stamp("created_at"), _stamp("updated_at"), old.alias("versions"))
    parts = _parts(rows.join(places, "id"), item, "memories", size)
    ends = [links.join(own.withColumnRenamed("id", c), c).select("user_id", "source_id", "target_id", "link_type") for c in ("source_id", "target_id")]
    touching = ends[0].unionByName(ends[1]).distinct()
    edges = _parts(_placed(touching, ["source_id", "target_id", "link_type"]), F.struct("source_id", "target_id", "link_type"), "links", size)
    sums = own.groupBy("user_id").agg(F.count("*").alias("n")).repartitionByRange("user_id")
    head = F.struct(F.lit("header").alias("kind"), "user_id", F.lit("1.0").alias("export_version"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"), F.col("n").alias("memory_count"))
    record = lambda df, kind: df.select("user_id", F.lit(kind).alias("kind"), "part", "n", F.to_json(F.struct(F.lit(kind).alias("kind"), "user_id", "part", kind)).alias("value"))
    headers = sums.select("user_id", F.lit("header").alias("kind"), F.lit(0).cast("long").alias("part"), "n", F.to_json(head).alias("value"))
    return headers.unionByName(record(parts, "memories")).unionByName(record(edges, "links"))


def write_export(records: DataFrame, path: str) -> None:
    """One JSON line a record (S6), written where export_records leaves it: a file holds one kind, of
    many users or of a part of one."""
    records.sortWithinPartitions("user_id", "kind", "part").select("value").write.mode("overwrite").text(path)


def read_export(spark, path: str) -> DataFrame:
    return spark.read.text(path).select("value")


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories with their versions, versions, links, bad lines) of records (value)."""
    parsed = lines.select("value", F.from_json("value", RECORD).alias("d"))
    good = F.coalesce(F.col("d.kind").isin("header", "memories", "links"), F.lit(False))
    mems = parsed.where("d.kind = 'memories'").select(F.col("d.user_id").alias("user_id"), F.inline("d.memories"))
    old = mems.select("user_id", F.col("id").alias("memory_id"), F.inline("versions"))
    links = parsed.where("d.kind = 'links'").select(F.inline("d.links")).distinct()
    return mems, old, links, parsed.where(~good).select("value")


def import_memories(incoming: DataFrame, state: DataFrame, strategy: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(state', counts: imported, skipped, errors) of incoming entries (user_id, memory_key, content,
    and scope, memory_type, authority_level, confidence, importance_score or their defaults) (S4).

    state: of upsert by (user, key, scope, project), with WRITTEN columns; entries have no project.
    skip_existing: of a known or repeated key nothing is written; upsert and overwrite: all go through
    upsert, and overwrite counts known keys as skipped.  An entry without key or content is an error."""
    if strategy not in ("skip_existing", "upsert", "overwrite"):
        raise ValueError(strategy)
    defaults = {"scope": "user", "memory_type": "semantic", "authority_level": 1, "confidence": 0.5, "importance_score": 0.5}
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in incoming.columns else F.lit(d)
    rows = incoming.select("user_id", "memory_key", "content", *(value(c, d).alias(c) for c, d in defaults.items()))
    rows = rows.withColumns({"project_id": F.lit(None).cast("long"), "seq": F.monotonically_increasing_id(), "written_at": as_of})
    good = F.col("memory_key").isNotNull() & F.col("content").isNotNull()
    writes = rows.where(good)
    if strategy == "skip_existing":
        known = state.where("project_id is null").select("user_id", "memory_key", "scope", F.lit(True).alias("_known"))
        first = F.row_number().over(Window.partitionBy("user_id", "memory_key", "scope").orderBy("seq")) == 1
        marked = writes.join(known, ["user_id", "memory_key", "scope"], "left").withColumn("_new", F.col("_known").isNull() & first)
        counts = marked.agg(F.count_if("_new").alias("imported"), F.count_if(~F.col("_new")).alias("skipped"))
        writes = marked.where("_new").drop("_known", "_new")
    new, _, actions = upsert(state, writes, SERVER_KEY, WRITTEN)
    if strategy != "skip_existing":
        made = F.lit(True) if strategy == "upsert" else F.col("action") == "created"
        counts = actions.agg(F.count_if(made).alias("imported"), F.count_if(~made).alias("skipped"))
    errors = rows.agg(F.count_if(~good).alias("errors"))
    return new, counts.withColumn("_one", F.lit(1)).join(errors.withColumn("_one", F.lit(1)), "_one").drop("_one")


def import_links(links: DataFrame, exported: DataFrame, mem: DataFrame) -> DataFrame:
    """Links with their ends' exported ids mapped to the state's by (user, key) (S5); links of which an
    end isn't known are left out."""
    ids = exported.select("user_id", "memory_key", F.col("id").alias("old")).join(mem.select("user_id", "memory_key", F.col("id").alias("new")), ["user_id", "memory_key"]).select("old", "new").distinct()
    one = links.join(ids.select(F.col("old").alias("source_id"), F.col("new").alias("_s")), "source_id")
    return one.join(ids.select(F.col("old").alias("target_id"), F.col("new").alias("_t")), "target_id").select(F.col("_s").alias("source_id"), F.col("_t").alias("target_id"), "link_type").distinct()
