"""SQL (DuckDB dialect) for the answers of the registered queries, over the same tables.

Written from the rules, not from the implementation: seeds come from a FULL JOIN, the frontier from
a recursive walk, pages and caps from row numbers.
"""

from __future__ import annotations

from workload.queries import EVENTS_CAP, INCREMENTAL_ROLLUPS, MANY_ROLLUPS, MANY_ROOTS, NEWER, OLDER, RANGE_ROOTS

_CATALOG = """
files AS (
  SELECT '/lineitem/' || l_returnflag || '/' || CAST(year(l_shipdate) AS VARCHAR) || '/'
           || lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') || '/' AS parent_path,
         'li-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || CAST(l_linenumber AS VARCHAR)
           || '-' || CAST(l_partkey AS VARCHAR) || '.dat' AS name,
         'FILE' AS element_type,
         CAST(floor(l_extendedprice) AS BIGINT) AS size,
         CAST(floor(l_quantity) AS BIGINT) * 4096 AS used,
         l_shipdate AS mtime, l_shipdate + INTERVAL 1 DAY AS atime,
         'user' || CAST(l_suppkey % 5 AS VARCHAR) AS owner_name, 'dat' AS extension,
         CAST(1 AS BIGINT) AS nlinks
  FROM lineitem
  UNION ALL
  SELECT '/orders/' || o_orderstatus || '/' || o_orderpriority || '/',
         'o-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.csv', 'FILE',
         CAST(floor(o_totalprice) AS BIGINT), CAST(floor(o_totalprice / 2) AS BIGINT),
         o_orderdate, o_orderdate + INTERVAL 2 DAY,
         'user' || CAST(o_custkey % 5 AS VARCHAR), 'csv', CAST(1 AS BIGINT)
  FROM orders
  UNION ALL
  SELECT CASE WHEN n_chars % 7 = 0 THEN '/documents/'
              WHEN n_chars % 5 = 0 THEN '/documents/' || source || '/'
              ELSE '/documents/' || source || '/' || lang || '/' END,
         'doc-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.txt', 'FILE',
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars * 2 END,
         TIMESTAMP '2024-01-01 00:00:00',
         CASE WHEN doc_id % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' END,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'user0' END, 'txt', CAST(1 AS BIGINT)
  FROM documents
  UNION ALL
  SELECT '/events/', 'ev-' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.log', 'FILE',
         CAST(floor(value * 1000) AS BIGINT), CAST(floor(value * 500) AS BIGINT), ts, ts,
         'user' || CAST(user_id % 5 AS VARCHAR), 'log', CAST(1 AS BIGINT)
  FROM events
  UNION ALL
  SELECT '/parts/',
         substr('=+@-x', CAST(p_partkey % 5 AS INT) + 1, 1) || p_name || '-'
           || CAST(p_partkey AS VARCHAR), 'FILE',
         CAST(p_size AS BIGINT), CAST(p_size AS BIGINT) * 10,
         TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-01-02 00:00:00', p_brand, '',
         CAST(1 AS BIGINT)
  FROM part
), dirp AS (
  SELECT DISTINCT parent_path AS p FROM files
  UNION SELECT '/home/links/' UNION SELECT '/home/empty/'
  UNION SELECT '/lineitem/empty/' UNION SELECT '/lineitemX/'
), anc AS (
  SELECT DISTINCT '/' || array_to_string(parts[1:i], '/') || '/' AS d, parts[i] AS nm
  FROM (SELECT list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM dirp) q,
       generate_series(1, 4) AS g(i)
  WHERE i <= len(parts)
), cat AS (
  SELECT * FROM files
  UNION ALL
  SELECT CASE WHEN n_regionkey = 0 THEN '/documents/' ELSE '/home/links/' END, 'link-' || n_name,
         'SYMLINK', CAST(24 AS BIGINT), CAST(0 AS BIGINT), TIMESTAMP '2023-01-01 00:00:00',
         TIMESTAMP '2023-01-01 00:00:00', 'root', '', CAST(1 AS BIGINT)
  FROM nation
  UNION ALL
  SELECT substr(d, 1, length(d) - 1 - length(nm)), nm, 'DIR', CAST(4096 AS BIGINT),
         CAST(4096 AS BIGINT), TIMESTAMP '2023-06-01 00:00:00', TIMESTAMP '2023-06-01 00:00:00',
         'root', '', CAST(2 AS BIGINT)
  FROM anc
)"""

_ENTRY = (
    "name, element_type, size, used, {mtime} AS mtime, {atime} AS atime, "
    "owner_name, extension, nlinks"
)


def _iso(column: str) -> str:
    return f"coalesce(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '000', '')"


_SHOWN = _ENTRY.format(mtime=_iso("mtime"), atime=_iso("atime"))


def _with(body: str, *ctes: str, recursive: bool = False) -> str:
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {', '.join([_CATALOG, *ctes])}\n{body}"


# ---- listings ----------------------------------------------------------------------------------


def _listing(path: str, where: str = "TRUE", cap: int = 10**15) -> str:
    """CTEs ``matching`` (all rows) and ``kept`` (capped rows)."""
    return f"""
matching AS (
  SELECT *, row_number() OVER (ORDER BY name) AS rn, count(*) OVER () AS n_all
  FROM cat WHERE parent_path = '{path}' AND ({where})
), kept AS (SELECT * FROM matching WHERE rn <= {cap})"""


def _whole(path: str, where: str = "TRUE", cap: int = 10**15) -> str:
    return _with(
        f"SELECT {_SHOWN}, n_all > {cap} AS truncated FROM kept", _listing(path, where, cap)
    )


def _page(path: str, order: str, page: int, size: int, cap: int = 10**15) -> str:
    return _with(
        f"""SELECT {_SHOWN}, CAST(this_page AS INTEGER) AS page, CAST(pages AS INTEGER) AS pages
FROM ranked WHERE pos > (this_page - 1) * {size} AND pos <= this_page * {size}""",
        _listing(path, cap=cap),
        f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS pos,
         greatest(1, (count(*) OVER () + {size - 1}) // {size}) AS pages,
         least({page}, greatest(1, (count(*) OVER () + {size - 1}) // {size})) AS this_page
  FROM kept)""",
    )


_FILES_LAST = "CASE WHEN element_type = 'DIR' THEN 0 ELSE 1 END"


def _by(key: str, direction: str = "ASC") -> str:
    if key == "name":
        return f"{_FILES_LAST}, name {direction}"
    return f"{key} {direction} NULLS LAST, {_FILES_LAST}, name"


def _meta(path: str, page: int, size: int) -> str:
    return _with(
        f"""SELECT n AS total_rows, d AS total_dirs, f AS total_files, n - d - f AS total_other,
       CAST(least({page}, pages) AS BIGINT) AS page, CAST({size} AS BIGINT) AS page_size,
       CAST(pages AS BIGINT) AS pages, FALSE AS truncated
FROM (SELECT *, greatest(1, (n + {size - 1}) // {size}) AS pages FROM counted) q""",
        _listing(path),
        """counted AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE element_type = 'DIR') AS d,
         count(*) FILTER (WHERE element_type = 'FILE') AS f FROM kept)""",
    )


# ---- rollups -----------------------------------------------------------------------------------


def _rollup_ctes(prefix: str, depth: int, name: str = "roll") -> str:
    """CTE with one row per group: data groups FULL JOIN seeds."""
    return f"""
{name}_keyed AS (
  SELECT *, CASE WHEN len(parts) = 0 THEN '.' ELSE array_to_string(parts[1:{depth}], '/') END AS k
  FROM (SELECT *, list_filter(string_split(substr(parent_path, {len(prefix) + 1}), '/'),
                              lambda x: x <> '') AS parts
        FROM cat WHERE element_type = 'FILE' AND starts_with(parent_path, '{prefix}')) q
), {name}_data AS (
  SELECT k, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS b,
         CAST(coalesce(sum(used), 0) AS BIGINT) AS u, max(mtime) AS m, max(atime) AS a
  FROM {name}_keyed GROUP BY k
), {name}_seed AS (
  SELECT DISTINCT name AS k FROM cat WHERE element_type = 'DIR' AND parent_path = '{prefix}'
), {name} AS (
  SELECT coalesce(d.k, s.k) AS name, coalesce(n, 0) AS file_count, coalesce(b, 0) AS total_bytes,
         coalesce(u, 0) AS total_used, m AS mtime, a AS atime
  FROM {name}_data d FULL JOIN {name}_seed s ON d.k = s.k)"""


_GROUP = (
    "name, file_count, total_bytes, total_used, "
    f"{_iso('mtime')} AS last_modified, {_iso('atime')} AS last_accessed"
)
_TOTALS = f"""CAST(sum(file_count) AS BIGINT) AS file_count,
  CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(total_used) AS BIGINT) AS total_used,
  {_iso('max(mtime)')} AS last_modified"""


def _rollup(prefix: str, depth: int) -> str:
    return _with(f"SELECT {_GROUP} FROM roll", _rollup_ctes(prefix, depth))


def _several(requests: list[tuple[str, int]], where: str = "TRUE") -> tuple[list[str], str]:
    ctes, parts = [], []
    for i, (prefix, depth) in enumerate(requests):
        ctes.append(_rollup_ctes(prefix, depth, f"r{i}"))
        parts.append(
            f"SELECT '{prefix}' AS prefix, CAST({depth} AS INTEGER) AS depth, {_GROUP} "
            f"FROM r{i} WHERE {where}"
        )
    return ctes, "\nUNION ALL\n".join(parts)


def _rollup_empty_dirs() -> str:
    requests = [("/", 1), ("/lineitem/", 2), ("/home/", 1), ("/documents/", 1)]
    ctes, body = _several(requests, "file_count = 0")
    return _with(body, *ctes)


def _rollup_many() -> str:
    ctes, body = _several(MANY_ROLLUPS)
    return _with(body, *ctes)


def _snapshot_refresh() -> str:
    requests = [("/", 1), ("/lineitem/", 2), ("/documents/", 2)]
    ctes, now = _several(requests)
    older = now.replace("total_used,", "total_bytes AS total_used,")
    return _with(
        f"""SELECT '{NEWER}' AS snapshot, *, TRUE AS is_current FROM ({now}) a
UNION ALL
SELECT '{OLDER}' AS snapshot, *, FALSE AS is_current FROM ({older}) b""",
        *ctes,
    )


_NEWCAT = """newcat AS (
  SELECT parent_path, name, element_type,
         CASE WHEN element_type = 'FILE' AND ends_with(name, '5.csv') THEN size * 2 + 1 ELSE size END AS size,
         used,
         CASE WHEN element_type = 'FILE' AND ends_with(name, '5.csv') THEN mtime + INTERVAL 1 DAY
              ELSE mtime END AS mtime,
         atime, owner_name, extension, nlinks
  FROM cat
  WHERE NOT (element_type = 'FILE' AND (ends_with(name, '3.dat') OR starts_with(parent_path, '/orders/F/')))
  UNION ALL
  SELECT parent_path, name || '.bak', element_type, size, used, mtime, atime, owner_name, extension, nlinks
  FROM cat WHERE element_type = 'FILE' AND ends_with(name, '1.csv')
  UNION ALL
  SELECT '/documents/', 'fresh-empty', 'DIR', 4096, 4096, NULL, NULL, 'root', '', 2
)"""


def _refresh_incremental() -> str:
    """A full rollup of the changed catalog."""
    ctes, body = _several(INCREMENTAL_ROLLUPS)
    return _with(body, _NEWCAT, *[c.replace("FROM cat ", "FROM newcat ") for c in ctes])


def _snapshot_totals(snapshot: str, used: str) -> str:
    return _with(
        f"""SELECT {snapshot} AS snapshot, element_type, count(*) AS n,
  CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes,
  CAST(coalesce(sum({used}), 0) AS BIGINT) AS total_used
FROM cat GROUP BY element_type"""
    )


def _safe(cell: str) -> str:
    return (
        f"CASE WHEN ascii(substr({cell}, 1, 1)) IN (61, 43, 45, 64, 9, 13, 10) AND {cell} <> '' "
        f"THEN chr(39) || {cell} ELSE {cell} END"
    )


def _human(size: str) -> str:
    """Half-up tenths in exact decimals, the unit picked from the size itself."""
    cases = [f"WHEN {size} IS NULL THEN '—'", f"WHEN {size} < 1024 THEN {size} || ' B'"]
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for power, unit in enumerate(units, start=1):
        scale = 1024**power
        tenths = f"((CAST({size} AS HUGEINT) * 20 + {scale}) // {2 * scale})"
        shown = f"({tenths} // 10) || '.' || ({tenths} % 10) || ' {unit}'"
        last = power == len(units)
        cases.append(f"ELSE {shown}" if last else f"WHEN {size} < {1024 * scale} THEN {shown}")
    return f"CASE {' '.join(cases)} END"


# ---- hierarchy ---------------------------------------------------------------------------------

_DIRS = (
    "dirs AS (SELECT parent_path, name, parent_path || name || '/' AS path "
    "FROM cat WHERE element_type = 'DIR')"
)


def _walk(roots: list[str], depth: int, name: str = "walk") -> str:
    starts = " UNION ALL ".join(f"SELECT '{r}' AS path, 0 AS level" for r in roots)
    return f"""
{name}_steps AS (
  {starts}
  UNION ALL
  SELECT d.path, w.level + 1 FROM {name}_steps w JOIN dirs d ON d.parent_path = w.path
  WHERE w.level < {depth}
), {name} AS (SELECT path, CAST(min(level) AS BIGINT) AS level FROM {name}_steps GROUP BY path)"""


_ROOTS = ["/lineitem/", "/documents/", "/lineitem/A/"]

_CRUMBS = """crumbs AS (
  SELECT parent_path AS of_path, CAST(i AS BIGINT) AS position,
         CASE WHEN i = 0 THEN '/' ELSE parts[i] END AS label,
         CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(parts[1:i], '/') || '/' END AS path
  FROM (SELECT DISTINCT parent_path, list_filter(string_split(parent_path, '/'),
               lambda x: x <> '') AS parts FROM files) q, generate_series(0, 10) AS g(i)
  WHERE i <= len(parts))"""


def _first_children(n: int) -> str:
    return (
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY name) "
        "AS position, count(*) OVER (PARTITION BY parent_path) AS total_dirs FROM dirs), "
        f"firsts AS (SELECT * FROM numbered WHERE position <= {n})"
    )


def _annotated(k: str, cut: str) -> str:
    """A page with the totals of the ``k`` largest groups; ``cut`` tells whether there are more."""
    return _with(
        f"""SELECT p.name, p.element_type, p.size, t.file_count AS rollup_files,
  t.total_bytes AS rollup_bytes, CASE WHEN p.element_type = 'DIR' THEN
    CASE WHEN t.name IS NOT NULL THEN 'stats' WHEN {cut} THEN 'truncated' ELSE 'newer' END
  END AS rollup_state
FROM (SELECT * FROM kept ORDER BY {_FILES_LAST}, name LIMIT 100) p
LEFT JOIN (SELECT * FROM roll ORDER BY total_bytes DESC, name LIMIT {'1000000000' if k == 'ALL' else k}) t
  ON p.element_type = 'DIR' AND p.name = t.name""",
        _listing("/documents/"),
        _rollup_ctes("/documents/", 1),
    )


ORACLES: dict[str, str] = {
    "catalog_scan": _with(
        "SELECT parent_path, name, size FROM cat WHERE element_type = 'FILE' "
        "AND owner_name = 'user3'"
    ),
    "dir_scan": _with(f"SELECT {_SHOWN} FROM cat WHERE parent_path = '/documents/'"),
    "subtree_files": _with(
        f"SELECT parent_path, size, used, {_iso('atime')} AS atime, {_iso('mtime')} AS mtime "
        "FROM cat WHERE element_type = 'FILE' AND parent_path LIKE '/lineitem/%'"
    ),
    "child_dirs": _with(
        "SELECT name FROM cat WHERE element_type = 'DIR' AND parent_path = '/documents/' "
        "ORDER BY name LIMIT 10"
    ),
    "snapshot_newest": (
        "SELECT max('files_' || strftime(ts, '%Y-%m-%d_%H_%M_%S') || '_UTC') AS snapshot FROM events"
    ),
    "snapshot_pinned_read": _snapshot_totals(f"'{OLDER}'", "size"),
    "snapshot_fallback": _snapshot_totals("CAST(NULL AS VARCHAR)", "used"),
    "snapshot_refresh": _snapshot_refresh(),
    "refresh_incremental": _refresh_incremental(),
    "views_normalised": """
SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_name
            WHEN c_custkey % 3 = 0 THEN 'alias-' || c_custkey
            ELSE '/views/' || c_custkey END AS name,
       '/views/' || c_custkey AS path,
       CASE WHEN c_custkey % 7 <> 0 THEN 'NFS,' || c_mktsegment ELSE '' END AS protocols,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS policy,
       CASE WHEN c_custkey % 6 = 1 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS tenant
FROM customer WHERE c_custkey % 5 <> 0""",
    "capacity_extract": """
SELECT '/orders/' || o_orderkey || '/' AS path, TRUE AS available, TRUE AS estimate,
       CASE WHEN ok THEN CAST(p * 3 AS VARCHAR) END AS logical,
       CASE WHEN ok THEN CAST(p AS VARCHAR) END AS "unique",
       CASE WHEN ok AND o_orderkey % 3 = 0 THEN CAST(p * 2 AS VARCHAR) END AS usable,
       CASE WHEN ok THEN CAST(o_orderkey % 100 AS VARCHAR) END AS percent,
       CASE WHEN ok THEN o_orderpriority END AS average_atime
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderstatus IN ('F', 'O') AS ok
      FROM orders) q""",
    "export_listing": _with(
        f"""SELECT {_safe('name')} AS name, element_type, size, used,
  strftime(mtime, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS mtime,
  strftime(atime, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS atime,
  {_safe('owner_name')} AS owner_name, {_safe('extension')} AS extension, nlinks
FROM kept""",
        _listing("/parts/"),
    ),
    "export_manifest": _with(
        f"""SELECT 'events' AS slug, 'listing-events' || CASE WHEN n > {EVENTS_CAP}
  THEN '-TRUNCATED' ELSE '' END AS output, CAST(least(n, {EVENTS_CAP}) AS BIGINT) AS row_count,
  n > {EVENTS_CAP} AS truncated FROM (SELECT count(*) AS n FROM cat
  WHERE parent_path = '/events/') q"""
    ),
    "export_rollup": _with(
        f"SELECT {_safe('name')} AS folder, file_count, total_bytes, total_used, "
        f"{_iso('mtime')} AS last_modified, {_iso('atime')} AS last_accessed FROM roll",
        _rollup_ctes("/orders/", 2),
    ),
    "csv_safe": _with(
        f"""SELECT 'doc-' || doc_id AS cell_id, {_safe('text')} AS cell, n_chars AS amount
FROM documents UNION ALL
SELECT {_safe('name')}, {_safe('name')}, size FROM files WHERE parent_path = '/parts/'"""
    ),
    "listing_type_file": _whole("/documents/", "element_type = 'FILE'"),
    "listing_type_dir": _whole("/documents/", "element_type = 'DIR'"),
    "listing_type_other": _whole(
        "/documents/", "element_type IS NULL OR element_type NOT IN ('FILE', 'DIR')"
    ),
    "listing_name_filter": _whole("/events/", "contains(name, '99')"),
    "name_search_indexed": _whole("/events/", "contains(name, '99')"),
    "listing_cap": _whole("/events/", cap=EVENTS_CAP),
    "listing_filter_escapes_cap": _whole("/events/", "contains(name, '777')", EVENTS_CAP),
    "listing_counts": _with(
        """SELECT count(*) AS total_rows, count(*) FILTER (WHERE element_type = 'DIR') AS total_dirs,
  count(*) FILTER (WHERE element_type = 'FILE') AS total_files,
  count(*) FILTER (WHERE coalesce(element_type, '') NOT IN ('FILE', 'DIR')) AS total_other
FROM cat WHERE parent_path = '/documents/' AND contains(name, '1')"""
    ),
    "listing_json": _with(
        f"SELECT name, CAST(to_json(q) AS VARCHAR) AS entry FROM (SELECT {_SHOWN} FROM cat "
        "WHERE parent_path = '/documents/') q"
    ),
    "listing_sort_name_asc": _page("/documents/", _by("name"), 2, 30),
    "listing_sort_name_desc": _page("/documents/", _by("name", "DESC"), 2, 30),
    "listing_sort_size_desc": _page("/documents/", _by("size", "DESC"), 2, 30),
    "listing_sort_size_asc": _page("/documents/", _by("size"), 2, 30),
    "listing_sort_mtime": _page("/events/", _by("mtime"), 3, 50),
    "listing_sort_mtime_desc": _page("/events/", _by("mtime", "DESC"), 3, 50),
    "listing_sort_atime": _page("/documents/", _by("atime", "DESC"), 4, 30),
    "listing_sort_owner": _page("/documents/", _by("owner_name"), 1, 30),
    "listing_page": _page("/documents/", _by("name"), 1, 100),
    "listing_page_last": _page("/events/", _by("size"), 10**6, 100),
    "listing_page_capped": _page("/events/", _by("size", "DESC"), 2, 100, EVENTS_CAP),
    "listing_page_meta": _meta("/events/", 10**6, 20),
    "listing_page_indexed": _page("/events/", _by("name"), 7, 100),
    "listing_unknown": _meta("/no/such/dir/", 3, 20),
    "rollup_depth1": _rollup("/lineitem/", 1),
    "rollup_depth2": _rollup("/lineitem/", 2),
    "rollup_root": _rollup("/", 1),
    "rollup_root_depth3": _rollup("/", 3),
    "rollup_flat": _rollup("/events/", 1),
    "rollup_null_sizes": _rollup("/documents/", 2),
    "rollup_empty_dirs": _rollup_empty_dirs(),
    "rollup_many": _rollup_many(),
    "rollup_merge": _with(
        f"""SELECT {_GROUP} FROM (
  SELECT name, CAST(sum(file_count) AS BIGINT) AS file_count,
    CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(total_used) AS BIGINT) AS total_used,
    max(mtime) AS mtime, max(atime) AS atime
  FROM (SELECT * FROM one UNION ALL SELECT * FROM two) q GROUP BY name) g""",
        _rollup_ctes("/lineitem/", 1, "one"),
        _rollup_ctes("/orders/", 1, "two"),
    ),
    "rollup_totals": _with(f"SELECT {_TOTALS} FROM roll", _rollup_ctes("/documents/", 2)),
    "rollup_guard": _with(
        """SELECT CAST(g.most AS BIGINT) AS max_groups, least(n, g.most + 1) AS groups_seen,
  n > g.most AS too_wide FROM (SELECT count(*) AS n FROM roll) q, (VALUES (10), (10000)) AS g(most)""",
        _rollup_ctes("/documents/", 2),
    ),
    "rows_scanned": _with(
        "SELECT count(*) AS rows_scanned FROM cat WHERE element_type = 'FILE' "
        "AND parent_path LIKE '/lineitem/%'"
    ),
    "rollup_topk": _with(
        f"""SELECT {_GROUP}, (SELECT count(*) FROM roll) AS total_children,
  (SELECT count(*) FROM roll) > 5 AS children_truncated
FROM roll ORDER BY total_bytes DESC, name LIMIT 5""",
        _rollup_ctes("/documents/", 2),
    ),
    "rollup_ranked": _with(
        f"SELECT {_GROUP}, row_number() OVER (ORDER BY total_bytes DESC, name) AS rank FROM roll",
        _rollup_ctes("/", 3),
    ),
    "rollup_share": _with(
        f"""SELECT {_GROUP}, greatest(1, max(total_bytes) OVER ()) AS max_bytes,
  100 * total_bytes / greatest(1, max(total_bytes) OVER ()) AS share_percent,
  {_human('total_bytes')} AS size_text FROM roll""",
        _rollup_ctes("/documents/", 1),
    ),
    "rollup_share_wide": f"""
WITH roll AS (
  SELECT 'c' || o_custkey AS name, count(*) AS file_count,
         CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_bytes,
         CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_used,
         max(o_orderdate) AS mtime, max(o_orderdate) AS atime
  FROM orders GROUP BY o_custkey)
SELECT {_GROUP}, greatest(1, max(total_bytes) OVER ()) AS max_bytes,
  100 * total_bytes / greatest(1, max(total_bytes) OVER ()) AS share_percent,
  {_human('total_bytes')} AS size_text FROM roll""",
    "rollup_envelope": _with(
        f"""SELECT CAST(to_json(e) AS VARCHAR) AS envelope FROM (
  SELECT '/orders/' AS path, '{OLDER}' AS catalog_snapshot,
    (SELECT CAST(sum(file_count) AS BIGINT) FROM roll) AS rows_scanned,
    (SELECT count(*) FROM roll) AS total_children,
    (SELECT count(*) > 2 FROM roll) AS children_truncated,
    (SELECT list(c ORDER BY c.total_bytes DESC, c.name)
     FROM (SELECT {_GROUP} FROM roll ORDER BY total_bytes DESC, name LIMIT 2) c) AS children,
    (SELECT t FROM (SELECT {_TOTALS} FROM roll) t) AS totals) e""",
        _rollup_ctes("/orders/", 1),
    ),
    "rollup_all_dirs": _with(
        f"SELECT {_GROUP} FROM totals",
        _DIRS,
        """every AS (SELECT path FROM dirs UNION SELECT '/'),
sums AS (
  SELECT e.path, count(*) AS n, CAST(sum(f.n) AS BIGINT) AS files, CAST(sum(f.b) AS BIGINT) AS b,
         CAST(sum(f.u) AS BIGINT) AS u, max(f.m) AS m, max(f.a) AS a
  FROM every e JOIN (SELECT parent_path, count(*) AS n, coalesce(sum(size), 0) AS b,
                            coalesce(sum(used), 0) AS u, max(mtime) AS m, max(atime) AS a
                     FROM files GROUP BY parent_path) f ON starts_with(f.parent_path, e.path)
  GROUP BY e.path),
totals AS (
  SELECT e.path AS name, coalesce(files, 0) AS file_count, coalesce(b, 0) AS total_bytes,
         coalesce(u, 0) AS total_used, m AS mtime, a AS atime
  FROM every e LEFT JOIN sums s ON e.path = s.path)""",
    ),
    "normalize_prefix": r"""
WITH given AS (
  SELECT page_id, unnest([url, p, '//' || p || '//']) AS given
  FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages) q)
SELECT page_id, given, CASE WHEN trim(given, '/') = '' THEN '/'
  ELSE '/' || trim(given, '/') || '/' END AS path FROM given""",
    "group_key": _with(
        """SELECT parent_path, n, CAST(depth AS BIGINT) AS depth,
  CASE WHEN len(parts) = 0 THEN '.' ELSE array_to_string(parts[1:depth], '/') END AS key
FROM (SELECT parent_path, count(*) AS n, list_filter(string_split(parent_path, '/'),
             lambda x: x <> '') AS parts FROM files GROUP BY parent_path) q,
     (VALUES (1), (2), (3), (8)) AS d(depth)"""
    ),
    "ns_to_iso": """
SELECT l_orderkey, l_linenumber, ns AS nanos,
  coalesce(strftime(make_timestamp((ns - ((ns % 1000000000) + 1000000000) % 1000000000) // 1000),
    '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(((ns % 1000000000) + 1000000000) % 1000000000
    AS VARCHAR), 9, '0'), '') AS iso
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 <> 0 THEN
        CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)
        * 86400000000000 + l_partkey * 1000003 + l_linenumber END AS ns FROM lineitem) q""",
    "human_size": f"""
SELECT l_orderkey, l_linenumber, size, {_human('size')} AS size_text
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 <> 0 THEN
        CAST(floor(l_extendedprice) AS BIGINT) * CAST([1, 1, 1024, 1048576, 1073741824,
        1099511627776, 1099511627776][l_linenumber] AS BIGINT) END AS size FROM lineitem) q""",
    "newest": _with(
        f"SELECT name, {_iso('greatest(coalesce(atime, mtime), coalesce(mtime, atime))')} AS newest "
        "FROM files WHERE starts_with(parent_path, '/documents/')"
    ),
    "ancestors": _with("SELECT * FROM crumbs", _CRUMBS),
    "expand_to": _with(
        "SELECT * FROM crumbs WHERE starts_with(of_path, '/lineitem/A/') "
        "AND starts_with(path, '/lineitem/A/')",
        _CRUMBS,
    ),
    "frontier": _with("SELECT * FROM walk", _DIRS, _walk(_ROOTS, 2), recursive=True),
    "frontier_ranges": _with("SELECT * FROM walk", _DIRS, _walk(RANGE_ROOTS, 2), recursive=True),
    "frontier_many_roots": _with(
        "SELECT * FROM walk", _DIRS, _walk(MANY_ROOTS, 1), recursive=True
    ),
    "frontier_capped": _with(
        "SELECT * FROM walk ORDER BY level, path LIMIT 50",
        _DIRS,
        _walk(_ROOTS, 2),
        recursive=True,
    ),
    "frontier_missing": _with(
        f"SELECT '{NEWER}' AS snapshot, path, level FROM walk WHERE path NOT IN "
        "(SELECT path FROM near)",
        _DIRS,
        _walk(_ROOTS, 2),
        _walk(_ROOTS, 1, "near"),
        recursive=True,
    ),
    "materialised_listing": _with(
        f"SELECT '{NEWER}' AS snapshot, parent_path, name, element_type, size, used, owner_name "
        "FROM cat WHERE parent_path IN (SELECT path FROM walk)",
        _DIRS,
        _walk(["/documents/", "/events/"], 1),
        recursive=True,
    ),
    "listing_ready": _page("/documents/", _by("size", "DESC"), 1, 40),
    "first_children": _with(
        "SELECT parent_path, name, path, position FROM firsts", _DIRS, _first_children(8)
    ),
    "tree_level": _with(
        "SELECT parent_path, name, path, position, total_dirs, greatest(total_dirs - 5, 0) "
        "AS more_dirs FROM firsts",
        _DIRS,
        _first_children(5),
    ),
    "listing_annotated": _annotated("12", "(SELECT count(*) > 12 FROM roll)"),
    "listing_annotated_complete": _annotated("ALL", "FALSE"),
    "listing_unannotated": _with(
        f"""SELECT name, element_type, size, CAST(NULL AS BIGINT) AS rollup_files,
  CAST(NULL AS BIGINT) AS rollup_bytes,
  CASE WHEN element_type = 'DIR' THEN 'none' END AS rollup_state
FROM kept ORDER BY {_FILES_LAST}, name LIMIT 100""",
        _listing("/documents/"),
    ),
    "tree_annotated": _with(
        f"""SELECT d.path, CASE WHEN d.parent_path = '/lineitem/' THEN
  CASE WHEN t.name IS NULL THEN '' ELSE {_human('t.total_bytes')} END END AS badge
FROM dirs d LEFT JOIN (SELECT * FROM roll ORDER BY total_bytes DESC, name LIMIT 3) t
  ON d.parent_path = '/lineitem/' AND d.name = t.name""",
        _DIRS,
        _rollup_ctes("/lineitem/", 1),
    ),
}

ORACLES["rollup_all_dirs_ranges"] = ORACLES["rollup_all_dirs"]
ORACLES["ready_bucketed"] = _with(
    """SELECT c.parent_path, c.name, c.element_type, c.size, n.total_rows, n.total_dirs, n.total_files
FROM cat c JOIN counts n ON c.parent_path = n.parent_path""",
    _DIRS,
    _walk(["/documents/", "/lineitem/"], 1),
    """counts AS (
  SELECT parent_path, count(*) AS total_rows, count(*) FILTER (WHERE element_type = 'DIR') AS total_dirs,
         count(*) FILTER (WHERE element_type = 'FILE') AS total_files
  FROM cat WHERE parent_path IN (SELECT path FROM walk) GROUP BY parent_path)""",
    recursive=True,
)
ORACLES["control_variant"] = ORACLES["capacity_extract"]
ORACLES["control_fields"] = """
WITH r AS (SELECT o_orderkey AS k, coalesce(o_orderstatus, '') AS s, o_orderpriority AS p FROM orders),
fields AS (
  SELECT 'details' AS key, s = 'F' AS is_object FROM r WHERE s <> 'O'
  UNION ALL SELECT 'logical', FALSE FROM r
  UNION ALL SELECT 'unique', FALSE FROM r WHERE s = 'O'
  UNION ALL SELECT 'usable', FALSE FROM r WHERE s = 'O' AND k % 3 = 0
  UNION ALL SELECT 'percent', FALSE FROM r WHERE s = 'O'
  UNION ALL SELECT 'average_atime', FALSE FROM r WHERE s = 'O' AND p IS NOT NULL
)
SELECT key, count(*) AS records, count(*) FILTER (WHERE is_object) AS objects FROM fields GROUP BY key
"""
ORACLES["arrivals_deduplicated"] = (
    "SELECT DISTINCT 'files_' || strftime(ts, '%Y-%m-%d_%H') AS snapshot FROM events"
)
