import hashlib
import os
import random

from pyspark.sql import functions as F

from treeledger.plans.duplicates import find_duplicates
from treeledger.plans.staged import staged_digests
from treeledger.sources.content import digest_files, digest_ranges
from treeledger.sources.ingest import classify, files_of


def listed(spark, folder):
    rows = []
    for name in sorted(os.listdir(folder)):
        info = os.stat(f"{folder}/{name}")
        rows.append((f"{folder}/{name}", "f", info.st_size, info.st_blocks, info.st_mtime_ns, "1", str(info.st_ino)))
    schema = "path string, kind string, size bigint, blocks bigint, mtime_ns bigint, device string, inode string"
    return files_of(classify(spark.createDataFrame(rows, schema), str(folder))).where(F.lit(True))


class Counting:
    """Readers that add up the bytes they are asked for."""

    def __init__(self):
        self.ranges = self.whole = 0

    def read(self, asked):
        self.ranges += asked.agg(F.sum(F.least("length", F.col("size") - F.col("start")))).first()[0] or 0
        return digest_ranges(asked, 4)

    def read_whole(self, rows):
        self.whole += rows.agg(F.sum("size")).first()[0] or 0
        return digest_files(rows, 4)


def write(folder, content):
    os.makedirs(folder, exist_ok=True)
    for name, data in content.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def test_groups_and_bytes_read(spark, tmp_path):
    rng = random.Random(7)
    size = 40_000
    base = rng.randbytes(size)
    content = {f"early{i}": rng.randbytes(size) for i in range(20)}  # differ in the first range
    content |= {f"copy{i}": base for i in range(3)}
    content["late"] = base[:-1] + bytes([base[-1] ^ 1])  # differs in the very last byte
    content |= {"middle1": base[:9000] + b"x" + base[9001:], "small1": b"abc", "small2": b"abc", "small3": b"abd"}
    folder = tmp_path / "tree"
    write(folder, content)
    files, reader = listed(spark, folder), Counting()
    staged = lambda rows: staged_digests(rows, reader.read, reader.read_whole, first=1024, growth=4, block=8192)
    review = find_duplicates(files, staged)
    groups = {r["sha256"]: (r["copies"], r["potential_bytes"]) for r in review.groups.collect()}
    assert groups == {hashlib.sha256(base).hexdigest(): (3, 2 * size), hashlib.sha256(b"abc").hexdigest(): (2, 3)}
    assert sorted(os.path.basename(r["path"]) for r in review.members.collect()) == ["copy0", "copy1", "copy2", "small1", "small2"]
    assert review.meta.first()["errors"] == 0
    assert find_duplicates(files, digest_files).groups.count() == 2
    # Of twenty files the first range is read, of five all of it; the whole of one copy comes on top.
    assert reader.ranges <= 20 * 1024 + 5 * size + 9 and reader.whole == size


def test_changed_and_vanished_files_are_errors(spark, tmp_path):
    folder = tmp_path / "tree"
    data = random.Random(1).randbytes(5000)
    write(folder, {f"c{i}": data for i in range(4)})
    files = listed(spark, folder).cache()
    files.count()
    os.remove(folder / "c1")
    write(folder, {"c2": data + b"more"})
    plain = find_duplicates(files, digest_files)
    reader = Counting()
    staged = find_duplicates(files, lambda rows: staged_digests(rows, reader.read, reader.read_whole, first=100, block=1000))
    assert staged.meta.first()["errors"] == plain.meta.first()["errors"] == 2
    assert [tuple(r) for r in staged.groups.collect()] == [tuple(r) for r in plain.groups.collect()]


def test_a_head_that_changes_meanwhile_costs_only_itself(spark, tmp_path):
    folder = tmp_path / "tree"
    data = random.Random(2).randbytes(3000)
    write(folder, {f"c{i}": data for i in range(3)})
    files, reader = listed(spark, folder).cache(), Counting()
    files.count()

    def late(rows):
        write(folder, {"c0": data[::-1] + b"!"})
        return reader.read_whole(rows)

    review = find_duplicates(files, lambda rows: staged_digests(rows, reader.read, late, first=100, block=1000))
    assert [(r["copies"], r["sha256"]) for r in review.groups.collect()] == [(2, hashlib.sha256(data).hexdigest())]
    assert review.meta.first()["errors"] == 1


def test_ranges_are_those_of_the_file(spark, tmp_path):
    write(tmp_path / "t", {"f": bytes(range(256)) * 10})
    row = listed(spark, tmp_path / "t").select("path", "fingerprint", "size").first()
    asked = spark.createDataFrame([(*row, s, n) for s, n in ((0, 7), (100, 1000), (2000, 5000))],
                                  "path string, fingerprint string, size long, start long, length long")
    got = {r["start"]: r["sha256"] for r in digest_ranges(asked, 2).collect()}
    data = bytes(range(256)) * 10
    assert got == {s: hashlib.sha256(data[s:s + n]).hexdigest() for s, n in ((0, 7), (100, 1000), (2000, 5000))}
