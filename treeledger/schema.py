"""Table schemas and fixed values shared by every module."""

from pyspark.sql import types as T

# They must equal the expected results literally.
NO_EXTENSION = "(无扩展名)"
CLEANUP_EXTENSIONS = (".tmp", ".log")
DAY_SECONDS = 86400
CLEANUP_AGE_DAYS = 7
BLOCK_BYTES = 512
QUARANTINE_QUOTA_BYTES = 2 * 1024**3
TOP_FILES = 200
TOP_DIRECTORIES = 100
PAGE_ROWS = 100
MAX_PAGE_ROWS = 500
COMPARISON_KINDS = ("added", "removed", "resized")
SCOPE_CLASSES = ("added", "removed", "replaced", "resized", "metadata_changed", "unchanged")
LIVE_STATES = ("quarantined", "pending", "purging", "restoring")
RESTORABLE_STATES = ("quarantined", "restoring")

# Name of the directory that holds files set aside for deletion. It is a
# parameter everywhere; pass the name your trees use.
QUARANTINE_NAME = ".quarantine"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TEXT, _LONG, _REAL, _FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

# kind: f regular file, d directory, l link or reparse point, anything else special.
LISTING = _struct(
    ("path", _TEXT), ("kind", _TEXT), ("size", _LONG), ("blocks", _LONG), ("mtime_ns", _LONG),
    ("device", _TEXT), ("inode", _TEXT), ("error", _TEXT),
)

FILES = _struct(
    ("path", _TEXT), ("parent", _TEXT), ("name", _TEXT), ("size", _LONG), ("allocated", _LONG),
    ("extension", _TEXT), ("modified", _REAL), ("mtime_ns", _LONG), ("fingerprint", _TEXT),
    ("device", _TEXT), ("inode", _TEXT),
)

DIRECTORIES = _struct(("path", _TEXT), ("parent", _TEXT), ("name", _TEXT), ("size", _LONG))

DIGESTS = _struct(
    ("path", _TEXT), ("parent", _TEXT), ("own_a", _LONG), ("own_b", _LONG), ("own_files", _LONG),
    ("all_a", _LONG), ("all_b", _LONG), ("all_files", _LONG))

# One row per data file of a snapshot: the parents its rows lie in, from first to last.
MANIFEST = _struct(
    ("table", _TEXT), ("file", _TEXT), ("first", _TEXT), ("last", _TEXT), ("rows", _LONG), ("bytes", _LONG))

ERRORS = _struct(("path", _TEXT), ("reason", _TEXT))

EXTENSIONS = _struct(("extension", _TEXT), ("files", _LONG), ("bytes", _LONG))

PATH_SIZE = _struct(("path", _TEXT), ("size", _LONG))

CANDIDATES = _struct(
    ("id", _TEXT), ("path", _TEXT), ("size", _LONG), ("fingerprint", _TEXT), ("age_days", _LONG))

CHANGE_COUNTS = _struct(*[(name, _LONG) for name in SCOPE_CLASSES])

SCOPE_CHANGES = _struct(
    ("schema_version", T.IntegerType()), ("basis", _TEXT), ("content_verified", _FLAG),
    ("counts", CHANGE_COUNTS), ("before_files", _LONG), ("after_files", _LONG),
    ("before_bytes", _LONG), ("after_bytes", _LONG), ("delta_bytes", _LONG),
)

REFRESH = _struct(
    ("baseline_id", _TEXT), ("baseline_finished_at", _REAL), ("path", _TEXT),
    ("scanned_files", _LONG), ("reused_files", _LONG), ("observed_at", _REAL),
    ("selected_coverage_complete", _FLAG), ("timeout_seconds", _LONG),
    ("elapsed_before_sync_seconds", _REAL), ("outside_revalidated", _FLAG),
    ("changes", SCOPE_CHANGES),
)

SUMMARY = _struct(
    ("root", _TEXT), ("bytes", _LONG), ("files", _LONG), ("errors", _LONG), ("skipped", _LONG),
    ("complete", _FLAG), ("directories", T.ArrayType(PATH_SIZE)), ("largest", T.ArrayType(PATH_SIZE)),
    ("candidate_files", _LONG), ("candidate_bytes", _LONG), ("finished_at", _REAL), ("elapsed_seconds", _REAL),
    ("unique_bytes", _LONG), ("allocated_bytes", _LONG),
    ("allocation_errors", _LONG), ("details_complete", _FLAG), ("coverage_complete", _FLAG),
    ("inventory_files", _LONG), ("measurement", _TEXT), ("refresh", REFRESH),
)

MOVES = _struct(
    ("id", _TEXT), ("source", _TEXT), ("destination", _TEXT), ("size", _LONG),
    ("fingerprint", _TEXT), ("state", _TEXT), ("created", _REAL), ("batch", _TEXT),
)
