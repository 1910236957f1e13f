"""A deterministic code graph derived from the part, lineitem and supplier tables: two sides to score without real data.

Each table is one statement in the SQL that Spark and DuckDB have in common, so queries and the SQL they are compared with
start from the same rows. Statements may use the tables before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("part", "lineitem", "supplier")

_ACCESSOR = "p_size % 8 = 0"
_FILE = "'src/' || replace(p_brand, '#', '_') || '.ts'"
_ALL = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

TABLES: dict[str, str] = {
    "sym0": f"""
SELECT p_partkey, p_size, {_FILE} AS path, replace(p_name, ' ', '_') AS base, CASE WHEN {_ACCESSOR} THEN 'get:' ELSE '' END || replace(p_name, ' ', '_') AS name,
  CASE WHEN {_ACCESSOR} THEN 'Method' WHEN p_type LIKE 'ECONOMY%' THEN 'Class' WHEN p_type LIKE 'STANDARD%' THEN 'Interface' WHEN p_type LIKE 'PROMO%' THEN 'Function'
    WHEN p_type LIKE 'SMALL%' THEN 'Method' WHEN p_type LIKE 'MEDIUM%' THEN 'Property' ELSE 'Enum' END AS kind,
  CAST(1 + (37 * p_partkey) % 500 AS INT) AS line FROM part""",
    "sym1": """
SELECT *, base || '@' || CAST(p_partkey AS STRING) AS lid, max(CASE WHEN kind = 'Class' THEN p_partkey END) OVER (PARTITION BY path ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM sym0""",
    "oracle_symbols": """
SELECT s.p_partkey AS ord, s.path, s.lid AS localId, s.name, s.kind, s.line AS startLine, CAST(s.line + s.p_size AS INT) AS endLine, CASE WHEN s.kind IN ('Method', 'Property') THEN o.lid END AS parentLocalId
FROM sym1 s LEFT JOIN sym1 o ON s.owner = o.p_partkey""",
    "calls": f"""
SELECT l.*, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS ord, l_partkey AS a, (7 * l_partkey + 13 * l_suppkey) % n AS b, n, CAST(l_quantity AS BIGINT) AS q,
  CASE l_linenumber WHEN 1 THEN 'CALLS' WHEN 2 THEN CASE WHEN l_returnflag = 'R' THEN 'ACCESSES' ELSE 'CALLS' END WHEN 3 THEN 'IMPORTS' WHEN 4 THEN 'EXTENDS' WHEN 5 THEN 'IMPLEMENTS' WHEN 6 THEN 'USES_TYPE' ELSE 'METHOD_OVERRIDES' END AS type
FROM lineitem l CROSS JOIN (SELECT count(*) AS n FROM part) c""",
    "oracle_edges": """
SELECT c.ord, f.path AS fromPath, CASE WHEN c.type = 'IMPORTS' OR (l_linenumber = 1 AND l_returnflag = 'N') THEN f.path ELSE f.lid END AS fromLocalId, c.type, t.name AS targetName,
  CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'O') THEN t.path END AS targetPath, CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'O') THEN t.lid END AS targetLocalId,
  CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'O') THEN t.line END AS targetStartLine,
  CASE WHEN c.type <> 'CALLS' THEN NULL WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'unresolved' WHEN q % 4 = 0 THEN 'symbol' WHEN q % 4 = 1 THEN 'signature' WHEN q % 4 = 2 THEN 'property' ELSE 'optional-chain-stripped' END AS resolutionTier,
  CAST(NULL AS BOOLEAN) AS scoreable, CASE WHEN q % 5 = 0 THEN CAST(q % 7 + 1 AS INT) END AS siteCount
FROM calls c JOIN sym1 f ON c.a = f.p_partkey JOIN sym1 t ON c.b = t.p_partkey""",
    "nodes": """
SELECT 'alpha' AS tool, p_partkey AS ord, 'a' || CAST(p_partkey AS STRING) AS id, name, path, kind, CAST(line + p_size % 3 - 1 AS INT) AS startLine, CAST(NULL AS STRING) AS parentId FROM sym1 WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'alpha', 1000000000 + min(p_partkey), 'a:' || path, path, path, 'File', 1, NULL FROM sym1 WHERE p_partkey % 10 <> 0 GROUP BY path
UNION ALL SELECT 'beta', 2 * p_partkey, 'b' || CAST(p_partkey AS STRING), base, CASE WHEN p_partkey % 6 = 1 THEN './' ELSE '' END || path, CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE kind END, line, NULL FROM sym1 WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'beta', 2 * p_partkey + 1, 'bd' || CAST(p_partkey AS STRING), base, path, CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE kind END, line, NULL FROM sym1 WHERE p_partkey % 4 <> 0 AND p_partkey % 50 = 1
UNION ALL SELECT 'beta', 1000000000 + s_suppkey, 'bg' || CAST(s_suppkey AS STRING), 'ghost' || CAST(s_suppkey AS STRING), 'src/Brand_1.ts', 'Function', CAST(s_suppkey % 500 AS INT), NULL FROM supplier
UNION ALL SELECT 'beta', 2000000000 + min(p_partkey), 'b:' || path, path, path, 'File', 1, NULL FROM sym1 GROUP BY path
UNION ALL SELECT 'gamma', p_partkey, 'g' || CAST(p_partkey AS STRING), CASE WHEN name = base THEN base ELSE '[get]' || base END, path, kind, CAST(NULL AS INT), CASE WHEN kind IN ('Method', 'Property') THEN 'g' || CAST(owner AS STRING) END FROM sym1
UNION ALL SELECT 'gamma', 1000000000 + min(p_partkey), 'g:' || path, path, path, 'File', 1, NULL FROM sym1 GROUP BY path""",
    "edges": """
SELECT 'alpha' AS tool, c.ord, CASE WHEN c.type = 'IMPORTS' OR (l_linenumber = 1 AND l_returnflag = 'N') THEN 'a:' || f.path ELSE 'a' || CAST(a AS STRING) END AS fromId,
  CASE WHEN l_orderkey % 97 = 0 THEN CASE WHEN c.type = 'IMPORTS' OR (l_linenumber = 1 AND l_returnflag = 'N') THEN 'a:' || f.path ELSE 'a' || CAST(a AS STRING) END
    WHEN l_orderkey % 11 = 0 THEN 'a' || CAST((b + 1) % n AS STRING) ELSE 'a' || CAST(b AS STRING) END AS toId, c.type, l_orderkey % 97 <> 0 AS resolved, CAST(1.0 AS DOUBLE) AS confidence
FROM calls c JOIN sym1 f ON c.a = f.p_partkey WHERE l_orderkey % 5 <> 0
UNION ALL SELECT 'beta', min(c.ord), CASE WHEN c.type = 'IMPORTS' THEN 'b:' || min(f.path) ELSE 'b' || CAST(a AS STRING) END, CASE WHEN min(l_suppkey) % 29 = 0 THEN 'gone' WHEN c.type = 'IMPORTS' THEN 'b:' || min(t.path) ELSE 'b' || CAST(b AS STRING) END, c.type, CAST(NULL AS BOOLEAN), CAST(NULL AS DOUBLE)
FROM calls c JOIN sym1 f ON c.a = f.p_partkey JOIN sym1 t ON c.b = t.p_partkey WHERE l_orderkey % 3 = 0 GROUP BY a, b, c.type
UNION ALL SELECT 'gamma', c.ord, CASE WHEN c.type = 'METHOD_OVERRIDES' AND f.owner IS NOT NULL THEN 'g' || CAST(f.owner AS STRING) WHEN c.type = 'IMPORTS' THEN 'g:' || f.path ELSE 'g' || CAST(a AS STRING) END, 'g' || CAST(b AS STRING), c.type, q % 10 >= 5, CAST(q % 10 AS DOUBLE) / 10
FROM calls c JOIN sym1 f ON c.a = f.p_partkey WHERE c.type <> 'ACCESSES'""",
    "files": """
SELECT 3 * s_suppkey AS ord, 'pkg' || CAST(s_nationkey AS STRING) || '/sub' || CAST(s_suppkey AS STRING) || '/f.ts' AS path FROM supplier
UNION ALL SELECT 3 * min(s_suppkey) + 1, 'pkg' || CAST(s_nationkey AS STRING) || '/package.json' FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY s_nationkey
UNION ALL SELECT 3 * s_suppkey + 2, 'pkg' || CAST(s_nationkey AS STRING) || '/sub' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 2 = 0 THEN '/tsconfig.json' ELSE '/tsconfig.build.json' END FROM supplier WHERE s_suppkey % 3 = 0""",
    "capabilities": """
SELECT * FROM (VALUES (0, 'alpha', 'CALLS edges'), (1, 'alpha', 'incremental indexing'), (2, 'beta', 'ACCESSES edges'), (3, 'beta', 'METHOD_OVERRIDES edges'), (4, 'gamma', 'incremental indexing'), (5, 'delta', 'vector search'), (6, 'gamma', 'USES_TYPE edges'), (7, 'beta', 'TEMPORAL edges'), (8, 'gamma', 'ACCESSES edges'), (9, 'delta', 'ACCESSES edges')) AS c(ord, tool, capability)""",
    "raw_labels": """
SELECT p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN 'Class' WHEN 1 THEN 'TypeAlias' WHEN 2 THEN 'Const' WHEN 3 THEN 'Folder' WHEN 4 THEN 'Trait' WHEN 5 THEN 'constructor' WHEN 6 THEN 'Variable' WHEN 7 THEN 'Method' ELSE 'Section' END AS label,
  CASE p_partkey % 8 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'EXTENDS' WHEN 2 THEN 'METHOD_IMPLEMENTS' WHEN 3 THEN 'HAS_METHOD' WHEN 4 THEN 'MEMBER_OF' WHEN 5 THEN 'HANDLES_ROUTE' WHEN 6 THEN 'ACCESSES' ELSE 'other' END AS relation,
  CASE p_partkey % 7 WHEN 0 THEN 'inherits' WHEN 1 THEN 'extends' WHEN 2 THEN 'indirect_call' WHEN 3 THEN 'imports_from' WHEN 4 THEN 'method' WHEN 5 THEN 'references' ELSE 'implements' END AS link,
  CASE p_partkey % 5 WHEN 0 THEN 'FILE' WHEN 1 THEN 'CLASS' WHEN 2 THEN 'INTERFACE' WHEN 3 THEN 'FUNCTION' ELSE 'OTHER' END AS node_type, CASE WHEN p_partkey % 2 = 0 THEN 'C' WHEN p_partkey % 11 = 1 THEN '' END AS class_name, CASE WHEN p_partkey % 4 = 0 THEN 'constructor' ELSE p_name END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'L' || CAST(p_size AS STRING) WHEN 1 THEN 'L' WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN 'xL1' WHEN 4 THEN NULL ELSE 'L007' END AS marker,
  CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN './' ELSE '' END || replace(p_name, ' ', '/') || CASE p_partkey % 3 WHEN 0 THEN '()' WHEN 1 THEN chr(92) || 'x' ELSE '' END AS text,
  CASE p_partkey % 9 WHEN 0 THEN '[get]min' WHEN 1 THEN 'get:x' WHEN 2 THEN 'setter y' WHEN 3 THEN 'getX' WHEN 4 THEN 'get:' WHEN 5 THEN 'setting:x' WHEN 6 THEN '[computed]' WHEN 7 THEN '[set]' ELSE 'getter: z' END AS symbol
FROM part""",
    "md_lines": """
SELECT CAST(-2 AS BIGINT) AS ord, '| id | name | filePath | startLine | endLine | label |' AS value UNION ALL SELECT -1, '|---|---|---|---|---|---|' UNION ALL SELECT -3, 'some prose before' 
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN '  ' ELSE '' END || '| n' || CAST(p_partkey AS STRING) || ' | ' || replace(p_name, ' ', '_') || ' | src/x.ts | ' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END || ' | ' || CASE WHEN p_partkey % 13 = 0 THEN '|' ELSE CAST(p_size + 3 AS STRING) || ' | Class |' END FROM part""",
    "links": """
SELECT c.ord, 'n' || CAST(a AS STRING) AS source, 'n' || CAST(b AS STRING) AS target, CASE WHEN c.type = 'METHOD_OVERRIDES' THEN 'method' WHEN c.type = 'CALLS' THEN 'calls' ELSE 'contains' END AS relation FROM calls c""",
    "link_nodes": """
SELECT p_partkey AS ord, 'n' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 7 = 0 THEN 'f.ts' WHEN p_partkey % 2 = 0 THEN '.' || replace(p_name, ' ', '_') || '()' ELSE replace(p_name, ' ', '_') END AS label, 'src/' || CASE WHEN p_partkey % 14 = 0 THEN 'f.ts' ELSE 'g.ts' END AS source_file FROM part""",
}


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES), given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The named tables and those they need, as plans; the tables in ``given`` are taken as they are."""
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES} | (given or {})
    for name, sql in TABLES.items():
        if given and name in given:
            continue
        used = {t: df for t, df in known.items() if _mentions(sql, t)}
        text = sql
        for t in used:
            text = _replaced(text, t)
        known[name] = spark.sql(text, **used)
    return {n: known[n] for n in names}


def _mentions(sql: str, table: str) -> bool:
    import re

    return re.search(rf"(?:FROM|JOIN) {table}\b", sql) is not None


def _replaced(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def sql_prefix() -> str:
    """The tables as common table expressions, without WITH."""
    return ",\n".join(f"{name} AS ({sql})" for name, sql in TABLES.items())
