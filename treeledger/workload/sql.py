"""The same inventories as SQL common table expressions, written independently of the package."""

_SUFFIX = ("CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.LOG' WHEN 2 THEN '.tmp' WHEN 3 THEN '' "
           "WHEN 4 THEN '.tar.gz' ELSE '.md' END")
_EXT = ("CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.log' WHEN 2 THEN '.tmp' WHEN 3 THEN '(无扩展名)' "
        "WHEN 4 THEN '.gz' ELSE '.md' END")


def _inventory(missing: int, size: str, inode: str, ns: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, lang, source, CAST({size} AS BIGINT) AS size, CAST({inode} AS VARCHAR) AS inode,
    1704067200 - ((doc_id * 7) % 19) * 86400 AS modified, {ns} AS ns, {_SUFFIX} AS suffix, {_EXT} AS extension
  FROM documents WHERE doc_id % 8 <> {missing}),
f AS (SELECT doc_id, text, size, inode, modified, ns, '/data/' || lang || '/' || source AS parent,
    'doc-' || CAST(doc_id AS VARCHAR) || suffix AS name, extension FROM d
  UNION ALL SELECT doc_id, text, size, inode, modified, ns, '/data/links/' || source,
    'ln-' || CAST(doc_id AS VARCHAR) || '.txt', '.txt' FROM d WHERE doc_id % 10 = 5)
SELECT parent || '/' || name AS path, parent, name, size, extension,
  CASE WHEN doc_id % 50 = 49 THEN NULL ELSE CAST(CEIL(size / 4096.0) AS BIGINT) * 4096 END AS allocated,
  CAST(modified AS BIGINT) AS modified, '1' AS device, inode,
  '1:' || inode || ':' || CAST(size AS VARCHAR) || ':' || CAST(modified * 1000000000 + ns AS VARCHAR) AS fingerprint,
  doc_id, text
FROM f"""


def _orders(missing: int, grown: str) -> str:
    return f"""
SELECT '/wh/' || o_orderstatus || '/c' || CAST(o_custkey % 100 AS VARCHAR) || '/o-' || CAST(o_orderkey AS VARCHAR) || '.dat' AS path,
  '/wh/' || o_orderstatus || '/c' || CAST(o_custkey % 100 AS VARCHAR) AS parent,
  'o-' || CAST(o_orderkey AS VARCHAR) || '.dat' AS name,
  CAST(floor(o_totalprice) AS BIGINT) + {grown} AS size
FROM orders WHERE o_orderkey % 9 <> {missing}"""


VIEWS = {
    "oldf": (_inventory(1, "CASE WHEN doc_id % 8 = 3 OR doc_id % 16 = 2 THEN n_chars + 1 ELSE n_chars END",
                        "doc_id + 1", "0"), ()),
    "newf": (_inventory(0, "n_chars", "CASE WHEN doc_id % 8 = 2 THEN doc_id + 1000001 ELSE doc_id + 1 END",
                        "CASE WHEN doc_id % 8 = 4 THEN 1 ELSE 0 END"), ()),
    "dirs": ("""
SELECT '/data' AS path UNION SELECT '/data/empty'
UNION SELECT '/data/' || split_part(parent, '/', 3) FROM newf
UNION SELECT parent FROM newf""", ("newf",)),
    "dirsizes": ("""
SELECT dirs.path, regexp_replace(dirs.path, '/[^/]*$', '') AS parent, split_part(dirs.path, '/', -1) AS name,
  CAST(coalesce(sum(newf.size), 0) AS BIGINT) AS size
FROM dirs LEFT JOIN newf ON starts_with(newf.path, dirs.path || '/') GROUP BY dirs.path""", ("dirs", "newf")),
    "mixf": ("""
SELECT path, parent, name, size, allocated, extension, modified FROM newf
UNION ALL SELECT '/data/en/Top-' || name, '/data/en', 'Top-' || name, size, allocated, extension, modified
FROM newf WHERE starts_with(path, '/data/en/') AND doc_id % 9 = 0""", ("newf",)),
    "mixdirs": ("""
SELECT dirs.path, regexp_replace(dirs.path, '/[^/]*$', '') AS parent, split_part(dirs.path, '/', -1) AS name,
  CAST(coalesce(sum(mixf.size), 0) AS BIGINT) AS size
FROM dirs LEFT JOIN mixf ON starts_with(mixf.path, dirs.path || '/') GROUP BY dirs.path""", ("dirs", "mixf")),
    "page": ("""
SELECT path, name, size, allocated, extension, modified, 'file' AS kind FROM mixf WHERE parent = '/data/en'
UNION ALL SELECT path, name, size, NULL, '', NULL, 'directory' FROM mixdirs
WHERE parent = '/data/en' AND path <> '/data/en'""", ("mixf", "mixdirs")),
    "listing": ("""
SELECT path, 'f' AS kind, size, allocated, modified, device, inode, doc_id FROM newf
UNION ALL SELECT parent || '/lnk-' || CAST(doc_id AS VARCHAR), 'l', 0, 0, modified, device, inode, doc_id FROM newf WHERE doc_id % 25 = 1
UNION ALL SELECT parent || '/pipe-' || CAST(doc_id AS VARCHAR), 'p', 0, 0, modified, device, inode, doc_id FROM newf WHERE doc_id % 60 = 7
UNION ALL SELECT '/data/en/.quarantine', 'd', 0, 0, 1704067200, '1', '900000001', NULL
UNION ALL SELECT '/data/en/.quarantine/q-' || CAST(doc_id AS VARCHAR), 'f', size, allocated, modified, device, inode, doc_id FROM newf WHERE doc_id % 40 = 9
UNION ALL SELECT path, 'd', 0, 0, 1704067200, '1', '900000002', NULL FROM dirs""", ("newf", "dirs")),
    "errors": ("""
SELECT path, 'Permission denied: ' || path || ' ' || text AS error FROM newf WHERE doc_id % 30 = 7""", ("newf",)),
    "moves": ("""
SELECT 'm' || CAST(doc_id AS VARCHAR) AS id, path AS source,
  '/data/en/.quarantine/m' || CAST(doc_id AS VARCHAR) AS destination, size, fingerprint,
  CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'restoring' WHEN 3 THEN 'purging' WHEN 4 THEN 'restored' ELSE 'failed' END AS state,
  CAST(1704067200 + doc_id AS BIGINT) AS created, 'b' || CAST(doc_id % 5 AS VARCHAR) AS batch,
  CAST(floor(doc_id / 6) AS BIGINT) % 4 IN (1, 3) AS src, CAST(floor(doc_id / 6) AS BIGINT) % 4 IN (2, 3) AS dst,
  CAST(floor(doc_id / 24) AS BIGINT) % 2 = 0 AS same_inode,
  CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE fingerprint END AS fp_now
FROM oldf WHERE starts_with(path, '/data/en/')""", ("oldf",)),
    "wh_old": (_orders(0, "0"), ()),
    "wh_new": (_orders(1, "CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END"), ()),
    "logs": ("""
SELECT '/logs/' || event_type || '/u' || CAST(user_id AS VARCHAR) || '/ev-' || CAST(event_id AS VARCHAR) || '.log' AS path,
  '/logs/' || event_type || '/u' || CAST(user_id AS VARCHAR) AS parent, 'ev-' || CAST(event_id AS VARCHAR) || '.log' AS name,
  CAST(floor(value * 100) AS BIGINT) AS size, CAST(ceil(value * 100 / 512) AS BIGINT) * 512 AS allocated, '.log' AS extension,
  epoch_us(ts) // 1000000 AS modified, '7' AS device, CAST(event_id AS VARCHAR) AS inode
FROM events""", ()),
    # Every file change between the two document snapshots.
    "changed": ("""
SELECT coalesce(b.path, a.path) AS path,
  CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'resized' END AS kind,
  b.size AS baseline_size, a.size AS current_size, coalesce(a.size, 0) - coalesce(b.size, 0) AS delta_bytes
FROM oldf b FULL JOIN newf a ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size""", ("oldf", "newf")),
    "six": ("""
SELECT coalesce(o.path, n.path) AS path, o.size AS old_size, n.size AS new_size,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
    WHEN o.inode <> '0' AND n.inode <> '0' AND (o.device <> n.device OR o.inode <> n.inode) THEN 'replaced'
    WHEN o.size <> n.size THEN 'resized' WHEN o.fingerprint <> n.fingerprint THEN 'metadata_changed'
    ELSE 'unchanged' END AS kind
FROM (SELECT * FROM oldf WHERE starts_with(path, '/data/en/')) o
FULL JOIN (SELECT * FROM newf WHERE starts_with(path, '/data/en/')) n ON o.path = n.path""", ("oldf", "newf")),
    # A refresh of /data/en: the rest of the old snapshot and what was observed there.
    "merged": ("""
SELECT * FROM oldf WHERE path <> '/data/en' AND NOT starts_with(path, '/data/en/')
UNION ALL SELECT * FROM newf WHERE starts_with(path, '/data/en/')""", ("oldf", "newf")),
    "olddirs": ("""
SELECT '/data' AS path UNION SELECT '/data/' || split_part(parent, '/', 3) FROM oldf
UNION SELECT parent FROM oldf""", ("oldf",)),
    "mergeddirs": ("""
SELECT path FROM olddirs WHERE path <> '/data/en' AND NOT starts_with(path, '/data/en/')
UNION SELECT path FROM dirs WHERE path = '/data/en' OR starts_with(path, '/data/en/')""", ("olddirs", "dirs")),
    "temporary": ("""
SELECT * FROM newf WHERE extension IN ('.tmp', '.log') AND 1704067200 - modified >= 604800
  AND (starts_with(path, '/data/en/') OR starts_with(path, '/data/links/'))""", ("newf",)),
    "single": ("""
SELECT size, device, inode, min(path) AS path FROM newf WHERE size > 0
GROUP BY size, device, inode""", ("newf",)),
    "candidates": ("""
SELECT s.* FROM single s JOIN (SELECT size FROM single GROUP BY size HAVING count(*) > 1) USING (size)""", ("single",)),
    "hashed": ("""
SELECT c.path, c.size, sha256(f.text) AS sha256 FROM candidates c JOIN newf f USING (path)""", ("candidates", "newf")),
    "groups": ("""
SELECT size, sha256, count(*) AS copies, size * (count(*) - 1) AS potential_bytes
FROM hashed GROUP BY size, sha256 HAVING count(*) > 1""", ("hashed",)),
}


def with_views(views: tuple[str, ...], body: str) -> str:
    """body behind the CTEs it needs, each after those it needs itself; body may bring more."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    body = body.strip()
    if not ordered:
        return body
    views = "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][0].strip()})" for name in ordered)
    return views + (",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body)
