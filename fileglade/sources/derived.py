"""A file catalog derived from order, event and document tables.

Every order line, order, document, event and part stands for one file; directories follow from the
file paths. Only the branches that a request can touch are built.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileglade.functions.paths import explode_prefixes, normalize_prefix
from fileglade.schema import CATALOG_SCHEMA


# Columns read from each table.
_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "nation": "n_name string, n_regionkey int",
}

# What one row of a table stands for, as SQL expressions of the catalog columns.
_FILE_BRANCHES = {
    "/lineitem/": (
        "lineitem",
        {
            "parent_path": "concat('/lineitem/', l_returnflag, '/', year(l_shipdate), '/', "
            "lpad(month(l_shipdate), 2, '0'), '/')",
            "name": "concat('li-', lpad(l_orderkey, 9, '0'), '-', l_linenumber, '-', l_partkey, "
            "'.dat')",
            "size": "floor(l_extendedprice)",
            "used": "floor(l_quantity) * 4096",
            "mtime": "l_shipdate",
            "atime": "l_shipdate + interval 1 day",
            "owner_name": "concat('user', l_suppkey % 5)",
            "extension": "'dat'",
        },
    ),
    "/orders/": (
        "orders",
        {
            "parent_path": "concat('/orders/', o_orderstatus, '/', o_orderpriority, '/')",
            "name": "concat('o-', lpad(o_orderkey, 9, '0'), '.csv')",
            "size": "floor(o_totalprice)",
            "used": "floor(o_totalprice / 2)",
            "mtime": "o_orderdate",
            "atime": "o_orderdate + interval 2 days",
            "owner_name": "concat('user', o_custkey % 5)",
            "extension": "'csv'",
        },
    ),
    "/documents/": (
        "documents",
        {
            "parent_path": "case when n_chars % 7 = 0 then '/documents/' "
            "when n_chars % 5 = 0 then concat('/documents/', source, '/') "
            "else concat('/documents/', source, '/', lang, '/') end",
            "name": "concat('doc-', lpad(doc_id, 7, '0'), '.txt')",
            "size": "if(doc_id % 17 = 0, null, n_chars)",
            "used": "if(doc_id % 17 = 0, null, n_chars * 2)",
            "mtime": "timestamp_ntz '2024-01-01 00:00:00'",
            "atime": "if(doc_id % 13 = 0, null, timestamp_ntz '2024-02-01 00:00:00')",
            "owner_name": "if(doc_id % 11 = 0, null, 'user0')",
            "extension": "'txt'",
        },
    ),
    "/events/": (
        "events",
        {
            "parent_path": "'/events/'",
            "name": "concat('ev-', lpad(event_id, 9, '0'), '.log')",
            "size": "floor(value * 1000)",
            "used": "floor(value * 500)",
            "mtime": "ts",
            "atime": "ts",
            "owner_name": "concat('user', user_id % 5)",
            "extension": "'log'",
        },
    ),
    "/parts/": (
        "part",
        {
            "parent_path": "'/parts/'",
            "name": "concat(substr('=+@-x', p_partkey % 5 + 1, 1), p_name, '-', p_partkey)",
            "size": "bigint(p_size)",
            "used": "bigint(p_size) * 10",
            "mtime": "timestamp_ntz '2023-01-01 00:00:00'",
            "atime": "timestamp_ntz '2023-01-02 00:00:00'",
            "owner_name": "p_brand",
            "extension": "''",
        },
    ),
}
_LINKS = {
    "parent_path": "if(n_regionkey = 0, '/documents/', '/home/links/')",
    "name": "concat('link-', n_name)",
    "size": "24L",
    "used": "0L",
    "mtime": "timestamp_ntz '2023-01-01 00:00:00'",
    "atime": "timestamp_ntz '2023-01-01 00:00:00'",
    "owner_name": "'root'",
    "extension": "''",
}
_DIRECTORY = {
    "parent_path": "substr(path, 1, length(path) - length(label) - 1)",
    "name": "label",
    "size": "4096L",
    "used": "4096L",
    "mtime": "timestamp_ntz '2023-06-01 00:00:00'",
    "atime": "timestamp_ntz '2023-06-01 00:00:00'",
    "owner_name": "'root'",
    "extension": "''",
}
_LINK_FOLDERS = ("/documents/", "/home/links/")
_BARE_DIRECTORIES = ("/home/links/", "/home/empty/", "/lineitem/empty/", "/lineitemX/")


def _rows(table: DataFrame, kind: str, columns: dict[str, str], nlinks: int = 1) -> DataFrame:
    columns = {**columns, "element_type": f"'{kind}'", "nlinks": f"{nlinks}L"}
    return table.selectExpr(*[f"{columns[name]} as {name}" for name in CATALOG_SCHEMA.names])


def _directory_rows(parents: DataFrame) -> DataFrame:
    """DIR rows for the given directories and all above them, the root apart."""
    paths = (
        explode_prefixes(parents.distinct(), "parent_path", "path")
        .select("path")
        .where("path <> '/'")
        .distinct()
        .selectExpr("path", "substring_index(rtrim('/', path), '/', -1) as label")
    )
    return _rows(paths, "DIR", _DIRECTORY, nlinks=2)


def derived_catalog(spark: SparkSession, tables: str, under: str = "/") -> DataFrame:
    """Catalog rows of at least the subtree ``under``; with ``/``, of everything."""
    scope = normalize_prefix(under)

    def touches(root: str) -> bool:
        return root.startswith(scope) or scope.startswith(root)

    def table(name: str) -> DataFrame:
        return spark.read.schema(_TABLES[name]).parquet(f"{tables.rstrip('/')}/{name}.parquet")

    files = [
        _rows(table(name), "FILE", columns)
        for root, (name, columns) in _FILE_BRANCHES.items()
        if touches(root)
    ]
    bare = [p for p in _BARE_DIRECTORIES if touches(p) or touches(f"/{p.split('/')[1]}/")]
    parents = [f.select("parent_path") for f in files]
    if bare:
        literal = F.array(*[F.lit(p) for p in bare])
        parents.append(spark.range(1).select(F.explode(literal).alias("parent_path")))
    branches = files
    if any(touches(p) for p in _LINK_FOLDERS):
        branches = [*branches, _rows(table("nation"), "SYMLINK", _LINKS)]
    if parents:
        branches = [*branches, _directory_rows(functools.reduce(DataFrame.unionAll, parents))]
    if not branches:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return functools.reduce(DataFrame.unionAll, branches)
