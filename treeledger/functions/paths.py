"""Path arithmetic on text columns (lexical only, nothing is ever looked up)."""

import ntpath
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.schema import BLOCK_BYTES, NO_EXTENSION

UNKNOWN = "?"  # stands in a fingerprint for what the listing does not say


@dataclass(frozen=True)
class PathRules:
    """How paths of one inventory are spelled: their separator decides everything."""

    sep: str = "/"

    @property
    def _lib(self):
        return ntpath if self.sep == "\\" else posixpath

    def normalize(self, path: str) -> str:
        """Tidy a path argument without touching any file system."""
        return self._lib.normpath(str(path))

    def is_absolute(self, path: str) -> bool:
        return self._lib.isabs(path)

    def components(self, path: str) -> list[str]:
        return [part for part in path.split(self.sep) if part]

    def is_volume_root(self, path: str) -> bool:
        return path.endswith(self.sep)

    def prefix(self, directory: str) -> str:
        """Text every path below the directory starts with; it ends at a component boundary."""
        return directory.rstrip(self.sep) + self.sep

    def contains(self, root: str, path: str) -> bool:
        return path == root or path.startswith(self.prefix(root))

    def parent_of(self, path: str) -> str:
        head = self._lib.dirname(path)
        return head or path

    def under(self, path: Column, directory: str) -> Column:
        """Strictly below the directory. startswith reaches the Parquet reader as a filter."""
        return path.startswith(self.prefix(directory))

    def inside(self, path: Column, directory: str) -> Column:
        return (path == F.lit(directory)) | self.under(path, directory)

    def under_any(self, path: Column, directories) -> Column:
        test = F.lit(False)
        for directory in directories:
            test = test | self.under(path, directory)
        return test

    def name(self, path: Column) -> Column:
        return F.substring_index(path, self.sep, -1)

    def parent(self, path: Column) -> Column:
        head = F.left(path, F.length(path) - F.length(self.name(path)) - 1)
        # A volume root loses its separator with the name and needs it back.
        if self.sep == "\\":
            return F.when(head.endswith(":"), F.concat(head, F.lit(self.sep))).otherwise(head)
        return F.coalesce(F.nullif(head, F.lit("")), F.lit(self.sep))

    def lineage(self, directory: Column, root: str) -> Column:
        """The directory and everything above it, down from root. Needs directory inside root."""
        shallow = len(root.rstrip(self.sep).split(self.sep))
        parts = F.length(directory) - F.length(F.replace(directory, F.lit(self.sep), F.lit(""))) + 1
        depth = F.when(directory == F.lit(root), F.lit(shallow)).otherwise(F.greatest(parts, F.lit(shallow)))

        def cut(i: Column) -> Column:
            part = F.call_function("substring_index", directory, F.lit(self.sep), i)
            return F.when(i == shallow, F.lit(root)).otherwise(part)

        return F.transform(F.sequence(F.lit(shallow), depth), cut)

    def has_component_below(self, path: Column, root: str, name: str) -> Column:
        """Whether a directory called name lies between root and the entry itself."""
        below = F.substring(path, len(self.prefix(root)), 1 << 30)
        return below.contains(self.sep + name + self.sep)


POSIX = PathRules("/")
WINDOWS = PathRules("\\")


def extension(name: Column) -> Column:
    """Lower-cased last suffix; a leading or trailing dot does not make one."""
    tail = F.substring_index(name, ".", -1)
    dot = F.length(name) - F.length(tail) - 1
    return F.when((dot > 0) & (tail != ""), F.lower(F.concat(F.lit("."), tail))).otherwise(F.lit(NO_EXTENSION))


def own_path() -> Column:
    """The path where the inode is unknown, else null: a key that keeps files without identity apart."""
    unknown = F.col("inode").isNull() | (F.col("inode") == "0")
    return F.when(unknown, F.col("path")).alias("_own")


def fingerprint(device: Column, inode: Column, size: Column, mtime_ns: Column) -> Column:
    """device:inode:size:mtime_ns, with UNKNOWN for a part that the listing does not have."""
    return F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit(UNKNOWN)) for part in (device, inode, size, mtime_ns)])


def allocated_bytes(blocks: Column) -> Column:
    return blocks * BLOCK_BYTES
