from pyspark.sql import functions as F

from treeledger.ledger import Ledger


def test_search_opens_what_may_match(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    words = ["alpha", "Bravo", "charlie", "delta%_'", "écho", "foxtrot", "golf", "hôtel"]
    rows = [(f"/r/{w}/f{i}.txt", "f", i, 1, 0, "1", str(i)) for w in words for i in range(50)] + [("/r/needle", "f", 3, 1, 0, "1", "999")]
    listing = spark.createDataFrame(rows, "path string, kind string, size long, blocks long, mtime_ns long, device string, inode string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        ledger.scan("s", listing, "/r", 0.0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    paths = [r[0] for r in rows]

    def plain(query):
        def low(s):
            return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        return sorted(p for p in paths if low(query) in low(p))

    queries = ["bravo", "BRAVO/F1", "a%_'/", "Écho", "écho", "NEEDLE", "nowhere", "", "f", "f4", "/r/golf/f49.txt", "f1.txt"]
    before = {q: sorted(r["path"] for r in ledger.search("s", q).collect()) for q in queries}
    ledger.index_search("s")
    whole = len(ledger.store.read("s", "files").inputFiles())
    for q in queries:
        found = ledger.search("s", q)
        assert sorted(r["path"] for r in found.collect()) == before[q] == plain(q)
    assert len(ledger.search("s", "needle").inputFiles()) <= 2 < whole
    assert ledger.search("s", "nowhere").inputFiles() == []
    assert len(ledger.search("s", "f").inputFiles()) == whole
    assert ledger.store.spark.read.parquet(f"{ledger.store.root}/search/scan_id=s").agg(F.max(F.length("bits"))).first()[0] == 4096
