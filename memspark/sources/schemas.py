"""Schemas of the memory store's tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array<float>": ArrayType(FloatType())}


def _schema(fields: str) -> StructType:
    """`name type, ...`, readable without a session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


MEMORIES = _schema(
    "id long, user_id long, project_id long, memory_key string, memory_type string, scope string, content string, content_hash string, "
    "embedding array<float>, status string, authority_level long, confidence double, importance_score double, recency_score double, "
    "created_at timestamp, updated_at timestamp, valid_from timestamp, valid_to timestamp, expires_at timestamp, version int, metadata string"
)
VERSIONS = _schema("memory_id long, version int, content string, content_hash string, status string, confidence double, importance_score double, created_at timestamp, effective_from timestamp")
LINKS = _schema("link_id long, source_id long, target_id long, link_type string")
EVENTS = _schema("event_id long, run_id long, user_id long, event_type string, content string, sequence_number long, created_at timestamp")
OBSERVATIONS = _schema("event_id long, run_id long, user_id long, content string, source_type string, confidence double, status string")
TASKS = _schema("task_id long, user_id long, state string, created_at timestamp")
RUNS = _schema("run_id long, user_id long, status string, started_at timestamp, ended_at timestamp")
ARTIFACTS = _schema("artifact_id long, run_id long, name string, size_bytes long, created_at timestamp")
ACCESS_LOG = _schema("memory_id long, user_id long, access_type string, created_at timestamp")
MESSAGES = _schema("thread_id long, seq long, role string, content string")
WEBHOOKS = _schema("webhook_id long, user_id long, events string, is_active boolean")

# The domains of enumerated columns.
MEMORY_TYPES = ("working", "episodic", "semantic", "procedural")
MEMORY_STATUSES = ("active", "superseded", "stale", "archived", "retracted")
LINK_TYPES = ("supports", "contradicts", "supersedes", "derived_from", "related_to")
TASK_STATES = ("pending", "in_progress", "waiting_review", "completed", "failed", "cancelled")
TRANSITIONS = {
    "pending": ("in_progress", "cancelled"),
    "in_progress": ("waiting_review", "completed", "failed", "cancelled"),
    "waiting_review": ("in_progress", "completed", "failed", "cancelled"),
    "completed": (),
    "failed": ("pending",),
    "cancelled": ("pending",),
}
