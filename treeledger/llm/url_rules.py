"""Allow and block rules on URLs, by a sorted sweep over reversed hosts."""

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.sources.workspace import materialize

# (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MARK = "\x00"  # ends each label of a key, so that a host's key is a prefix of its subdomains' keys only


def after_scheme(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def host_of(url: str) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, A to Z in lower case; empty without `://`."""
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to `?` or `#`; empty without `://`."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Canonical key: the labels from the last to the first, each with a mark."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK))


def precedence(rule: tuple) -> tuple:
    """The longest text of host and path wins, then block, then the greater text."""
    _, verdict, host, path = rule
    return len(host + path), verdict == "block", host + path


class Node:
    """All rules of one host, by path."""

    def __init__(self, key: str):
        self.key, self.paths = key, {}
        self.lengths: list[int] = []

    def add(self, path: str, rule: tuple) -> None:
        held = self.paths.setdefault(path, {})
        held[rule[0]] = max(held.get(rule[0], rule), rule, key=precedence)
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str, listed: bool) -> tuple | None:
        for n in self.lengths:
            if (found := self.paths.get(path[:n])) and len(path) >= n and listed in found:
                return found[listed]
        return None


def sweep(rows):
    """Verdicts for points, from rules and points in the order of their keys within a part.

    The stack holds the hosts whose intervals contain the current key, each inside the one
    below it, so a rule that fits is among theirs.
    """
    part, stack = None, []
    for own, key, kind, path, host, verdict, listed, page in rows:
        if own != part:
            part, stack = own, []
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1].key != key:
                stack.append(Node(key))
            stack[-1].add(path, (listed, verdict, host, path))
            continue
        best = {}
        for node in stack:
            for which in (True, False):
                rule = node.longest(path, which)
                # The key could only mislead where a host holds the mark itself, so the host decides.
                if rule and (host == rule[2] or host.endswith("." + rule[2])):
                    best[which] = max(best.get(which, rule), rule, key=precedence)
        yield page, host, path, best.get(True), best.get(False)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Every page with host, path, rule, verdict and default_rule.

    rules has verdict, host, path and listed; a rule fits its host and all subdomains where
    the path starts with the rule's, and the one with the most precedence wins. Listed rules
    go before the others, which only make up the default; without any the verdict is allow. Rows are not matched by name, so repeated pages and null ids
    or urls each get their row.

    Points are sorted by (key, page) in ranges, so even one host's points spread over many
    parts. A rule goes to the parts that its interval meets: the least and greatest key of
    each part (as many rows as there are parts) are all that the driver sees.
    """
    points = pages.select(F.col(page_id).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    points = points.withColumn("key", reversed_host(F.col("host")))
    laid = points.repartitionByRange("key", "path", "page").sortWithinPartitions("key", "path", "page")
    laid = materialize(laid.withColumn("part", F.spark_partition_id()))
    bounds = sorted(tuple(r) for r in laid.groupBy("part").agg(F.min("key"), F.max("key")).collect())
    numbers, least, greatest = ([b[i] for b in bounds] for i in range(3))
    schema = "part int, key string, kind int, path string, host string, verdict string, listed boolean"

    def deal(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = bisect_left(greatest, row["key"])
                last = bisect_right(least, row["key"] + "\U0010ffff")
                out += [row | {"part": part, "kind": 0} for part in numbers[first:last]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("part", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("path", pa.string()),
                ("host", pa.string()), ("verdict", pa.string()), ("listed", pa.bool_())]))

    dealt = rules.select(reversed_host(F.col("host")).alias("key"), "path", "host", "verdict", "listed")
    dealt = dealt.mapInArrow(deal, schema)
    page_type = points.schema["page"].dataType
    rows = dealt.withColumn("page", F.lit(None).cast(page_type)).unionByName(
        laid.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string"), "listed": F.lit(None).cast("boolean")})
        .select("part", "key", "kind", "path", "host", "verdict", "listed", "page"))
    rows = rows.repartition("part").sortWithinPartitions("part", "key", "kind", "path")

    def run(batches):
        def ordered():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(8)))

        held = []
        for page, host, path, rule, default in sweep(ordered()):
            held.append((page, host, path, rule and rule[2] + rule[3], (rule or default or (0, "allow"))[1],
                         default and default[2] + default[3]))
            if len(held) == 10_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held):
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], page_arrow), *[pa.array(c, pa.string()) for c in columns[1:]]],
                                          names=["page_id", "host", "path", "rule", "verdict", "default_rule"])

    from pyspark.sql.pandas.types import to_arrow_type
    page_arrow = to_arrow_type(page_type)
    return rows.mapInArrow(run, f"page_id {page_type.simpleString()}, host string, path string, rule string, "
                           "verdict string, default_rule string")


def rule_table(spark, rules=RULES, defaults=()) -> DataFrame:
    rows = [(*rule, True) for rule in rules] + [(*rule, False) for rule in defaults]
    return spark.createDataFrame(rows, "verdict string, host string, path string, listed boolean")
