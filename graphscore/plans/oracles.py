"""SQL that DuckDB runs to check the queries. Greedy steps are recursive queries that claim one row at a time, unlike the engine's streams."""

from __future__ import annotations

from ..functions import labels
from ..operators.capability import GUARDED
from ..operators.ownership import PREFERRED
from ..schemas import BAND, EDGE_TYPES, EXTENDED_TYPES, KINDS, MEMBER_KINDS
from .testgraph import sql_prefix


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _np(x: str) -> str:
    return rf"regexp_replace(replace({x}, chr(92), '/'), '^\./', '')"


def _cn(x: str) -> str:
    return rf"coalesce(nullif(regexp_extract({x}, '^\[(?:get|set)\](.+)$', 1), ''), nullif(regexp_extract({x}, '^(?:get|set)(?:ter)?[: ](.+)$', 1), ''), {x})"


def _ok(x: str) -> str:
    return f"({x} <> '' AND {x} NOT IN ('[computed]', '[anonymous]'))"


def _ratio(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0.0)"


_P, _R = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
_F1 = f"coalesce(2 * ({_P}) * ({_R}) / nullif(({_P}) + ({_R}), 0), 0.0)"
_SCORES = f"{_P} AS precision, {_R} AS recall, {_F1} AS f1"
_SCOPE_T = f"CASE WHEN type IN {_in(EXTENDED_TYPES)} THEN 'extended' WHEN type = 'IMPLEMENTS' AND coalesce(fkind IN {_in(MEMBER_KINDS)}, false) THEN 'member' WHEN type IN {_in(EDGE_TYPES)}"


def _steps(p: str, cands: str) -> str:
    """{p}step and {p}match(tool, tool_ord, oracle_ord): rows of {p}claim claim candidates of their bucket one by one."""
    return f"""
{p}step AS (
  SELECT DISTINCT tool, np, cn, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS pick FROM {p}claim
  UNION ALL
  SELECT tool, np, cn, rn, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END, ord, pick FROM (
    SELECT tool, np, cn, rn, claimed, ord, list_sort(list_transform(free, lambda x: {{'r': CASE WHEN x.k = kind OR (swap AND x.k IN ('Method', 'Property') AND kind IN ('Method', 'Property')) THEN 0 ELSE 1 END, 'd': CASE WHEN line IS NULL THEN 0 ELSE coalesce(abs(x.l - line), 1000000000) END, 'o': x.o}}))[1].o AS pick FROM (
      SELECT *, acc OR coalesce(list_bool_or(list_transform(free, lambda x: x.a)), false) AS swap FROM (
        SELECT t.*, s.claimed, list_filter(coalesce(c.cs, []), lambda x: NOT list_contains(s.claimed, x.o)) AS free FROM {p}step s JOIN {p}claim t ON s.tool = t.tool AND s.np = t.np AND s.cn = t.cn AND t.rn = s.rn + 1 LEFT JOIN {cands} c ON c.np = t.np AND c.cn = t.cn)))),
{p}match AS (SELECT tool, ord AS tool_ord, pick AS oracle_ord FROM {p}step WHERE rn > 0)"""


def _matching(p: str, nodes: str) -> str:
    """{p}dedup, {p}claim and the steps: nodes of ``nodes`` against osym."""
    return f"""
{p}dedup AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY ord) AS k FROM (SELECT *, {_np("path")} AS np, {_cn("name")} AS cn FROM {nodes}) WINDOW w AS (PARTITION BY tool, np, cn, kind, startLine)),
{p}claim AS (SELECT tool, np, cn, ord, kind, startLine AS line, cn <> name AS acc, row_number() OVER (PARTITION BY tool, np, cn ORDER BY ord) AS rn FROM {p}dedup WHERE k = 1 AND {_ok("name")}),{_steps(p, "cands")}"""


#: Tools of the derived graph that resolve edges, and so are references.
_REFERENCES = ("alpha", "gamma")


def _covered(r: str) -> str:
    """{r}_result: how much of one reference's resolved edges each other tool has. Ids are unique within a tool here."""
    named = f"(SELECT *, {_np('path')} AS np, {_cn('name')} AS cn FROM nodes WHERE {_ok('name')})"
    return f"""
{r}_cands AS (SELECT np, cn, list({{'o': ord, 'k': kind, 'l': startLine, 'a': cn <> name}} ORDER BY ord) AS cs FROM {named} WHERE tool = '{r}' GROUP BY np, cn),
{r}_claim AS (SELECT tool, np, cn, ord, kind, startLine AS line, cn <> name AS acc, row_number() OVER (PARTITION BY tool, np, cn ORDER BY ord) AS rn FROM {named} WHERE tool <> '{r}'),{_steps(r + "_", r + "_cands")},
{r}_pairs AS (SELECT m.tool, n.id AS fromId, o.id AS refId FROM {r}_match m JOIN nodes n ON n.tool = m.tool AND n.ord = m.tool_ord JOIN nodes o ON o.tool = '{r}' AND o.ord = m.oracle_ord),
{r}_theirs AS (SELECT DISTINCT e.tool AS other, p.refId, t.name AS toName, e.type FROM edges e JOIN {r}_pairs p ON p.tool = e.tool AND p.fromId = e.fromId JOIN nodes t ON t.tool = e.tool AND t.id = e.toId),
{r}_asked AS (SELECT e.type, f.id AS refId, t.name AS toName FROM edges e LEFT JOIN nodes f ON f.tool = e.tool AND f.id = e.fromId LEFT JOIN nodes t ON t.tool = e.tool AND t.id = e.toId WHERE e.tool = '{r}' AND e.resolved AND e.type IN {_in(EDGE_TYPES)}),
{r}_result AS (SELECT '{r}' AS ref_tool, g.other AS other_tool, g.type, coalesce(n, 0) AS "referenceResolved", coalesce(k, 0) AS covers FROM (SELECT tool AS other, unnest({list(EDGE_TYPES)}) AS type FROM (SELECT DISTINCT tool FROM nodes WHERE tool <> '{r}')) g
  LEFT JOIN (SELECT type, count(*) AS n FROM {r}_asked GROUP BY type) a ON a.type = g.type LEFT JOIN (SELECT t.other, t.type, count(*) AS k FROM {r}_asked a JOIN {r}_theirs t ON t.refId = a.refId AND t.toName = a.toName AND t.type = a.type GROUP BY ALL) c ON c.other = g.other AND c.type = g.type)"""


_BASE = f"""
known AS (SELECT DISTINCT path FROM nodes WHERE coalesce(path, '') <> ''),
tools AS (SELECT DISTINCT tool FROM nodes),
osym0 AS (SELECT * FROM oracle_symbols WHERE path IN (SELECT path FROM known)),
osym AS (SELECT * FROM (SELECT *, {_np("path")} AS np, {_cn("name")} AS cn, row_number() OVER (PARTITION BY {_np("path")}, localId ORDER BY ord) AS k FROM osym0) WHERE k = 1),
cands AS (SELECT np, cn, list({{'o': ord, 'k': kind, 'l': startLine, 'a': cn <> name}} ORDER BY ord) AS cs FROM osym WHERE {_ok("name")} GROUP BY np, cn),
idnodes AS (SELECT * FROM nodes WHERE kind NOT IN ('File', 'Directory'))"""

_EDGES = f"""
okind AS (SELECT path, localId, max_by(kind, ord) AS fkind FROM osym0 GROUP BY path, localId),
oedge AS (SELECT *, {_SCOPE_T} THEN 'main' END AS scope FROM (
  SELECT e.* REPLACE (coalesce(scoreable, CASE WHEN type IN {_in(EDGE_TYPES)} THEN coalesce(targetLocalId, '') <> '' END) AS scoreable), k.fkind FROM oracle_edges e LEFT JOIN okind k ON e.fromPath = k.path AND e.fromLocalId = k.localId WHERE e.fromPath IN (SELECT path FROM known))),
uniq AS (SELECT * FROM (SELECT *, {_np("fromPath")} AS nfrom, row_number() OVER (w ORDER BY ord) AS k, sum(coalesce(siteCount, 1)) OVER w AS sites FROM oedge WHERE coalesce(scoreable, true) AND scope IS NOT NULL
  WINDOW w AS (PARTITION BY scope, {_np("fromPath")}, fromLocalId, type, coalesce(targetLocalId, '') <> '', CASE WHEN coalesce(targetLocalId, '') <> '' THEN {_np("coalesce(targetPath, '')")} END, CASE WHEN coalesce(targetLocalId, '') <> '' THEN targetLocalId ELSE targetName END)) WHERE k = 1),
bind AS (SELECT n.tool, n.id, max_by(m.oracle_ord, m.tool_ord) AS o FROM amatch m JOIN nodes n ON n.tool = m.tool AND n.ord = m.tool_ord WHERE m.oracle_ord IS NOT NULL GROUP BY n.tool, n.id),
ends AS (SELECT n.*, {_np("s.path")} AS bpath, s.localId AS bid, s.name AS bname, s.kind AS bkind, s.parentLocalId AS bparent FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool, id ORDER BY ord DESC) AS k FROM nodes) WHERE k = 1) n
  LEFT JOIN bind b ON n.tool = b.tool AND n.id = b.id LEFT JOIN osym0 s ON s.ord = b.o),
bound AS (SELECT *, {_SCOPE_T} AND NOT (type = 'IMPORTS' AND coalesce(tkind, '') = 'File') THEN 'main' END AS scope FROM (
  SELECT e.*, f.id IS NOT NULL AS fthere, t.id IS NOT NULL AS tthere, f.kind AS fkind, f.path AS fpath, f.name AS fname, f.bpath AS fbpath, f.bid AS fbid, f.bkind AS fbkind, f.bparent AS fbparent, t.kind AS tkind, t.path AS tpath, t.name AS tname, t.startLine AS tline, t.bpath AS tbpath, t.bid AS tbid, t.bname AS tbname
  FROM edges e LEFT JOIN ends f ON e.tool = f.tool AND e.fromId = f.id LEFT JOIN ends t ON e.tool = t.tool AND e.toId = t.id WHERE e.type IN {_in(EDGE_TYPES + EXTENDED_TYPES)})),
ruled AS (SELECT *, CASE WHEN fromId = toId AND resolved IS NOT DISTINCT FROM false THEN 'abstained' WHEN NOT fthere OR NOT tthere THEN 'fp' WHEN NOT (type = 'IMPORTS' OR fkind = 'File') AND fbid IS NULL THEN 'fp' END AS rule,
  CASE WHEN type = 'IMPORTS' OR fkind = 'File' THEN {_np("fpath")} ELSE fbpath END AS kp, CASE WHEN type = 'IMPORTS' OR fkind = 'File' THEN fpath ELSE fbid END AS ki FROM bound WHERE scope IS NOT NULL),
asked AS (SELECT *, {_np("tpath")} AS tnp, row_number() OVER (PARTITION BY scope, tool, kp, ki, type ORDER BY ord) AS rn FROM ruled WHERE rule IS NULL),
rels AS (SELECT scope, nfrom AS kp, fromLocalId AS ki, type, list({{'o': ord, 'p': {_np("targetPath")}, 'i': targetLocalId, 'l': targetStartLine, 'n': targetName}} ORDER BY ord) AS cs FROM uniq GROUP BY ALL),
loose AS (SELECT DISTINCT scope, {_np("fromPath")} AS kp, fromLocalId AS ki, type, targetName FROM oedge WHERE scoreable IS NOT DISTINCT FROM false),
estep AS (
  SELECT k.*, CAST(0 AS BIGINT) AS rn, coalesce(r.cs, []) AS free, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS named FROM (SELECT DISTINCT scope, tool, kp, ki, type FROM asked) k
  LEFT JOIN rels r ON r.scope = k.scope AND r.kp = k.kp AND r.ki = k.ki AND r.type = k.type
  UNION ALL
  SELECT scope, tool, kp, ki, type, rn, list_filter(free, lambda x: x.o <> coalesce(hit, named, -1)), ord, hit, CASE WHEN hit IS NULL THEN named END FROM (
    SELECT *, list_filter(free, lambda x: coalesce(x.p, '') <> '' AND ((tbid IS NOT NULL AND coalesce(x.i, '') <> '' AND x.p = tbpath AND x.i = tbid) OR coalesce(x.p = tnp AND abs(x.l - tline) <= {BAND}, false)))[1].o AS hit, list_filter(free, lambda x: x.n = tname)[1].o AS named FROM (
      SELECT a.scope, a.tool, a.kp, a.ki, a.type, a.rn, a.ord, a.tbid, a.tbpath, a.tnp, a.tline, a.tname, s.free FROM estep s JOIN asked a ON s.scope = a.scope AND s.tool = a.tool AND s.kp = a.kp AND s.ki = a.ki AND s.type = a.type AND a.rn = s.rn + 1))),
verdicts AS (
  SELECT scope, tool, ord, type, rule AS verdict, CAST(NULL AS BIGINT) AS oracle_ord FROM ruled WHERE rule IS NOT NULL
  UNION ALL SELECT e.scope, e.tool, e.ord, e.type, CASE WHEN hit IS NOT NULL THEN 'target' WHEN named IS NOT NULL THEN 'name' WHEN l.targetName IS NOT NULL THEN 'unscoreable' ELSE 'fp' END, coalesce(hit, named)
  FROM estep e JOIN asked a ON a.scope = e.scope AND a.tool = e.tool AND a.ord = e.ord AND a.type = e.type LEFT JOIN loose l ON l.scope = e.scope AND l.kp = e.kp AND l.ki = e.ki AND l.type = e.type AND l.targetName = a.tname WHERE e.rn > 0)"""

_COUNTS = f"""
counts AS (SELECT g.tool, g.scope, g.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tc, 0) AS targetConfirmed, coalesce(nc, 0) AS nameOnlyConfirmed, coalesce(um, 0) AS unscoreableMatched, coalesce(ab, 0) AS abstentions, coalesce(ue, 0) AS unscoreableExcluded, coalesce(truth, 0) - coalesce(tp, 0) AS fn, coalesce(sites, 0) AS sites
FROM (SELECT tool, scope, type FROM tools, (VALUES {", ".join(f"('main', '{t}')" for t in EDGE_TYPES)}, {", ".join(f"('extended', '{t}')" for t in EXTENDED_TYPES)}, ('member', 'IMPLEMENTS')) AS v(scope, type)) g
LEFT JOIN (SELECT scope, tool, type, count(*) FILTER (verdict IN ('target', 'name')) AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'target') AS tc, count(*) FILTER (verdict = 'name') AS nc, count(*) FILTER (verdict = 'unscoreable') AS um, count(*) FILTER (verdict = 'abstained') AS ab FROM verdicts GROUP BY ALL) v USING (scope, tool, type)
LEFT JOIN (SELECT scope, type, count(*) AS truth, CAST(sum(sites) AS BIGINT) AS sites FROM uniq GROUP BY ALL) u USING (scope, type)
LEFT JOIN (SELECT scope, type, count(*) AS ue FROM oedge WHERE scoreable IS NOT DISTINCT FROM false GROUP BY ALL) x USING (scope, type))"""

_KINDCOUNTS = f"""
judged AS (SELECT m.tool, t.kind AS tkind, o.kind AS okind, o.name AS oname FROM imatch m JOIN idnodes t ON t.tool = m.tool AND t.ord = m.tool_ord LEFT JOIN osym0 o ON o.ord = m.oracle_ord),
kindcounts AS (SELECT tool, kind, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(truth) - sum(tp) AS BIGINT) AS fn FROM (
  SELECT tool, okind AS kind, 1 AS tp, 0 AS fp, 0 AS truth FROM judged WHERE okind IS NOT NULL UNION ALL SELECT tool, tkind, 0, 1, 0 FROM judged WHERE okind IS NULL
  UNION ALL SELECT tool, kind, 0, 0, 1 FROM osym, tools WHERE {_ok("name")}) GROUP BY ALL)"""

_IDENTITY, _ALL = _matching("i", "idnodes"), _matching("a", "nodes")
_EDGE_SELECT = f"tool, type, tp, fp, targetConfirmed, nameOnlyConfirmed, unscoreableMatched, abstentions, unscoreableExcluded, fn, {_SCORES}, {_ratio('targetConfirmed', 'tp')} AS targetAccuracy, {_ratio('tp', 'sites')} AS siteCoverage"


def _with(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {sql_prefix()}{''.join(',' + p for p in parts)}\n{select}"


def _map(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


def _agnostic(type_: str, left_t: str, left_o: str, joins: str = "") -> str:
    """Distinct claims and truth with sides ``l``; keys by id where known."""
    return f"""
truth AS (SELECT {left_o} AS l, CASE WHEN coalesce(targetLocalId, '') <> '' THEN {_np("coalesce(targetPath, '')")} || '|' || targetLocalId END AS i, targetName AS n FROM oedge e {joins} WHERE type = '{type_}'),
claims AS (SELECT tool, l, i, min(n) AS n FROM (SELECT b.tool, {left_t} AS l, b.tbpath || '|' || b.tbid AS i, coalesce(b.tbname, b.tname) AS n FROM bound b LEFT JOIN climbed c ON c.tool = b.tool AND c.start = b.fromId LEFT JOIN ends x ON x.tool = b.tool AND x.id = c.cls WHERE type = '{type_}' AND fthere AND tthere) GROUP BY tool, l, i, CASE WHEN i IS NULL THEN n END),
hits AS (SELECT tool, count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM truth t WHERE t.l = c.l AND t.i = c.i) OR EXISTS (SELECT 1 FROM truth t WHERE t.l = c.l AND t.n = c.n)) AS tp FROM claims c GROUP BY tool),
pairs AS (SELECT count(*) AS k FROM (SELECT DISTINCT l, i, CASE WHEN i IS NULL THEN n END FROM truth)),
result AS (SELECT tool, tp, pairs - tp AS fp, k - tp AS fn FROM hits, pairs)"""


_CLIMB = """
lastnode AS (SELECT tool, id, kind, parentId FROM (SELECT *, row_number() OVER (PARTITION BY tool, id ORDER BY ord DESC) AS k FROM nodes) WHERE k = 1),
walk AS (SELECT tool, id AS start, id AS cur, kind, parentId, 0 AS hops FROM lastnode UNION ALL SELECT w.tool, w.start, n.id, n.kind, n.parentId, w.hops + 1 FROM walk w JOIN lastnode n ON n.tool = w.tool AND n.id = w.parentId WHERE w.kind <> 'Class' AND w.hops < 10),
climbed AS (SELECT tool, start, coalesce(max(cur) FILTER (kind = 'Class'), start) AS cls, bool_or(kind = 'Class') AS found FROM walk GROUP BY tool, start)"""

_PREF = "CASE name " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(PREFERRED)) + f" ELSE {len(PREFERRED)} END"
_FILES = rf"""
named AS (SELECT ord, path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN path NOT LIKE '%/%' THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir FROM files),
conf AS (SELECT dir, min_by(path, {{'r': {_PREF}, 'n': name}}) AS tsconfigPath FROM named WHERE regexp_matches(name, '^tsconfig(\..+)?\.json$') GROUP BY dir),
roots AS (SELECT DISTINCT dir FROM named WHERE name = 'package.json' UNION SELECT dir FROM conf UNION SELECT '.')"""

ORACLES: dict[str, str] = {
    "normalize_path_name": _with(f"SELECT ord, {_np('text')} AS path, {_cn('symbol')} AS canonical, {_cn('symbol')} <> symbol AS accessor, {_ok('symbol')} AS matchable, regexp_replace(regexp_replace(text, '^\\.', ''), '\\(\\)$', '') AS bare FROM raw_labels"),
    "normalize_kinds": _with(f"SELECT ord, {_map('label', labels.GRAPH_KINDS, 'Unknown')} AS graph_kind, CASE WHEN node_type = 'FUNCTION' THEN CASE WHEN coalesce(class_name, '') = '' THEN 'Function' WHEN name = 'constructor' THEN 'Constructor' ELSE 'Method' END ELSE {_map('node_type', labels.RECORD_KINDS, 'Unknown')} END AS record_kind FROM raw_labels"),
    "normalize_edge_types": _with(f"SELECT ord, {_map('relation', labels.GRAPH_EDGES, 'UNKNOWN')} AS graph_type, {_map('link', labels.LINK_EDGES, 'UNKNOWN')} AS link_type, {_map('relation', labels.RECORD_EDGES, 'UNKNOWN')} AS record_type FROM raw_labels"),
    "line_marker": _with("SELECT ord, TRY_CAST(nullif(regexp_extract(marker, '^L([0-9]+)$', 1), '') AS INT) AS line FROM raw_labels"),
    "markdown_table_scan": _with("SELECT ord, trim(coalesce(p[2], '')) AS id, trim(coalesce(p[3], '')) AS name, trim(coalesce(p[4], '')) AS filePath, TRY_CAST(nullif(regexp_extract(trim(coalesce(p[5], '')), '^([+-]?[0-9]+)', 1), '') AS INT) AS startLine, TRY_CAST(nullif(regexp_extract(trim(coalesce(p[6], '')), '^([+-]?[0-9]+)', 1), '') AS INT) AS endLine, trim(coalesce(p[7], '')) AS label FROM (SELECT ord, string_split(trim(value), '|') AS p FROM md_lines WHERE trim(value) LIKE '|%' AND ord >= 0)"),
    "tool_node_dedupe": _with("SELECT tool, np AS npath, cn AS cname, kind, startLine, min(ord) AS ord, count(*) AS rows FROM idedup GROUP BY ALL", _BASE, _IDENTITY),
    "oracle_symbol_dedupe": _with(f"SELECT {_np('path')} AS npath, localId, min(ord) AS ord, count(*) AS rows FROM oracle_symbols GROUP BY ALL"),
    "oracle_edge_collapse": _with("SELECT ord, nfrom, fromLocalId, type, targetName, CAST(sites AS BIGINT) AS siteCount FROM uniq", _BASE, _ALL, _EDGES),
    "derive_scoreable": _with(f"SELECT ord, coalesce(scoreable, CASE WHEN type IN {_in(EDGE_TYPES)} THEN coalesce(targetLocalId, '') <> '' END) AS scoreable FROM oracle_edges"),
    "file_universe_semijoin": _with("SELECT fromPath, count(*) AS edges FROM oracle_edges WHERE fromPath IN (SELECT path FROM known) GROUP BY fromPath", _BASE),
    "edge_partition": _with("SELECT tool, type, scope, count(*) AS edges FROM bound GROUP BY ALL", _BASE, _ALL, _EDGES),
    "abstentions": _with("SELECT scope, tool, ord FROM ruled WHERE rule = 'abstained'", _BASE, _ALL, _EDGES),
    "dangling_selfloop": _with(f"SELECT tool, edges, selfLoops, dangling, {_ratio('dangling', 'edges')} AS danglingRate FROM (SELECT tool, count(*) AS edges, count(*) FILTER (fromId = toId) AS selfLoops, count(*) FILTER (NOT fthere OR NOT tthere) AS dangling FROM bound GROUP BY tool)", _BASE, _ALL, _EDGES),
    "imports_module_level": _with(
        f"SELECT tool, tp, fp, fn, oraclePairs, toolPairs, unscoreableExcluded, {_P} AS precision, {_R} AS recall FROM result", _BASE, _ALL, _EDGES,
        """
claims AS (SELECT DISTINCT tool, fpath AS a, tpath AS b FROM bound WHERE type = 'IMPORTS' AND coalesce(fpath, '') <> '' AND coalesce(tpath, '') <> ''),
truth AS (SELECT DISTINCT fromLocalId AS a, targetPath AS b FROM oedge WHERE type = 'IMPORTS' AND coalesce(targetPath, '') <> ''),
budget AS (SELECT fromLocalId AS a, count(*) AS k FROM oedge WHERE type = 'IMPORTS' AND coalesce(targetPath, '') = '' GROUP BY ALL),
byfile AS (SELECT tool, a, count(*) AS pairs, count(*) FILTER ((a, b) IN (SELECT (a, b) FROM truth)) AS tp FROM claims GROUP BY ALL),
result AS (SELECT *, toolPairs - tp - unscoreableExcluded AS fp, oraclePairs - tp AS fn FROM (SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pairs) AS BIGINT) AS toolPairs, CAST(sum(least(pairs - tp, coalesce(k, 0))) AS BIGINT) AS unscoreableExcluded, (SELECT count(*) FROM truth) AS oraclePairs FROM byfile LEFT JOIN budget USING (a) GROUP BY tool))""",
    ),
    "uses_type_agnostic": _with(f"SELECT tool, tp, fp, fn, {_SCORES} FROM result", _BASE, _ALL, _EDGES, _CLIMB, _agnostic("USES_TYPE", _np("b.fpath"), _np("e.fromPath"))),
    "method_overrides_agnostic": _with(
        f"SELECT tool, tp, fp, fn, {_SCORES} FROM result", _BASE, _ALL, _EDGES, _CLIMB,
        f"\nowner AS (SELECT {_np('path')} AS p, localId AS q, max_by(parentLocalId, ord) AS o FROM osym0 GROUP BY ALL)",
        _agnostic("METHOD_OVERRIDES", f"CASE WHEN b.fbkind = 'Class' THEN 'id|' || b.fbpath || '|' || b.fbid WHEN coalesce(b.fbparent, '') <> '' THEN 'id|' || b.fbpath || '|' || b.fbparent WHEN x.bid IS NOT NULL THEN 'id|' || x.bpath || '|' || x.bid ELSE 'name|' || {_np('x.path')} || '|' || x.name END", f"'id|' || {_np('e.fromPath')} || '|' || coalesce(o.o, e.fromLocalId)", f"LEFT JOIN owner o ON o.p = {_np('e.fromPath')} AND o.q = e.fromLocalId"),
    ),
    "climb_to_class": _with('SELECT tool, start AS id, cls AS "classId", found AS "hasClass" FROM climbed', _CLIMB),
    "resolution_tiers": _with(f"SELECT resolutionTier, n, {_ratio('n', '(SELECT sum(n) FROM c)')} AS share FROM c", _BASE, _ALL, _EDGES, "\nc AS (SELECT resolutionTier, count(*) AS n FROM oedge WHERE type = 'CALLS' AND resolutionTier IS NOT NULL GROUP BY ALL)"),
    "oracle_resolved_rate": _with(f"SELECT edges, resolved, {_ratio('resolved', 'edges')} AS rate FROM (SELECT count(*) AS edges, count(*) FILTER (coalesce(targetLocalId, '') <> '') AS resolved FROM oracle_edges)"),
    "headline": _with("SELECT n.tool, nodes, edges - abstentions AS asserted, abstentions FROM (SELECT tool, count(*) AS nodes FROM nodes GROUP BY tool) n JOIN (SELECT tool, count(*) AS edges, count(*) FILTER (fromId = toId AND resolved IS NOT DISTINCT FROM false) AS abstentions FROM edges GROUP BY tool) e USING (tool)"),
    "d4_ontology": _with("SELECT kind, tool, (kind, tool) IN (SELECT (kind, tool) FROM nodes) AS present FROM (SELECT DISTINCT kind FROM nodes), (SELECT DISTINCT tool FROM nodes)"),
    "d4_edge_types": _with("SELECT type, tool, (type, tool) IN (SELECT (type, tool) FROM edges) AS present FROM (SELECT DISTINCT type FROM edges), (SELECT DISTINCT tool FROM edges)"),
    "d4_capabilities": _with("SELECT capability, tool, (capability, tool) IN (SELECT (capability, tool) FROM capabilities) AS present FROM (SELECT DISTINCT capability FROM capabilities), (SELECT DISTINCT tool FROM nodes)"),
    "drift_guard": _with(f"SELECT c.tool, capability, type FROM capabilities c, (VALUES {', '.join(f"('{t}')" for t in GUARDED)}) AS g(type) WHERE contains(capability, type) AND c.tool IN (SELECT tool FROM nodes) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.tool = c.tool AND e.type = g.type)"),
    "file_ownership": _with("SELECT path, max_by(dir, CASE WHEN dir = '.' THEN 0 ELSE length(dir) END) AS rootPath FROM (SELECT path, r.dir FROM files f JOIN roots r ON r.dir = '.' OR f.path = r.dir OR starts_with(f.path, r.dir || '/')) GROUP BY path", _FILES),
    "tsconfig_select": _with("SELECT r.dir AS rootPath, tsconfigPath, tsconfigPath IS NOT NULL AS typed FROM roots r LEFT JOIN conf c ON r.dir = c.dir", _FILES),
    "graph_class_kinds": _with("SELECT id, CASE WHEN label = regexp_extract(source_file, '[^/]*$') THEN 'File' WHEN label LIKE '%()' THEN CASE WHEN id IN (SELECT target FROM links WHERE relation = 'method') THEN 'Method' ELSE 'Function' END ELSE 'Unknown' END AS kind FROM link_nodes"),
    "parent_backfill": _with("SELECT 'x' AS tool, target AS id, max_by(source, {'s': seen, 'o': ord}) AS \"parentId\" FROM (SELECT *, min(ord) OVER (PARTITION BY source) AS seen FROM links WHERE relation = 'contains') GROUP BY target"),
    "node_match": _with("SELECT tool, tool_ord, oracle_ord FROM imatch", _BASE, _IDENTITY),
    "node_fidelity_by_kind": _with(f"SELECT tool, kind, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, {_SCORES.replace('tp', 'coalesce(tp, 0)').replace('fp', 'coalesce(fp, 0)').replace('fn', 'coalesce(fn, 0)')} FROM (SELECT tool, unnest({list(KINDS)}) AS kind FROM tools) LEFT JOIN kindcounts USING (tool, kind)", _BASE, _IDENTITY, _KINDCOUNTS),
    "node_fidelity_overall": _with(
        f"""SELECT t.tool, tp, fp, fn, {_SCORES}, round("macroF1", 12) AS "macroF1", CAST(coalesce(d, 0) AS BIGINT) AS duplicates, {_P} AS "toolMatchRate", {_R} AS "oracleMatchRate" FROM (SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM kindcounts GROUP BY tool) t
JOIN (SELECT tool, coalesce(avg({_F1}) FILTER (tp + fn > 0), 0.0) AS "macroF1" FROM kindcounts WHERE kind IN {_in(KINDS)} GROUP BY tool) m ON m.tool = t.tool LEFT JOIN (SELECT tool, sum(n - 1) AS d FROM idedup WHERE k = 1 GROUP BY tool) x ON x.tool = t.tool""", _BASE, _IDENTITY, _KINDCOUNTS,
    ),
    "kind_labelling": _with(f"SELECT tool, kind, total, correct, unlabelled, total - correct - unlabelled AS mislabelled, {_ratio('correct', 'total')} AS accuracy FROM (SELECT tool, okind AS kind, count(*) AS total, count(*) FILTER (r) AS correct, count(*) FILTER (NOT r AND tkind = 'Unknown') AS unlabelled FROM (SELECT *, tkind = okind OR (tkind IN ('Method', 'Property') AND okind IN ('Method', 'Property') AND {_cn('oname')} <> oname) AS r FROM judged WHERE okind IS NOT NULL) GROUP BY ALL)", _BASE, _IDENTITY, _KINDCOUNTS),
    "edge_verdicts": _with("SELECT scope, tool, ord, type, verdict, oracle_ord FROM verdicts", _BASE, _ALL, _EDGES),
    "d2_edges": _with(
        f"SELECT {_EDGE_SELECT}, coalesce(CAST(r AS DOUBLE) / nullif(n, 0), 0.0) AS resolutionRate, type = 'IMPORTS' AND coalesce(f, false) AS onlyFileGranularity FROM counts LEFT JOIN (SELECT tool, type, count(*) AS n, count(*) FILTER (resolved) AS r FROM edges GROUP BY ALL) x USING (tool, type) LEFT JOIN (SELECT tool, bool_or(coalesce(tkind, '') = 'File') AND NOT bool_or(coalesce(tkind, '') <> 'File') AS f FROM bound WHERE type = 'IMPORTS' GROUP BY tool) y USING (tool) WHERE scope = 'main'", _BASE, _ALL, _EDGES, _COUNTS,
    ),
    "d2_extended": _with(f"SELECT {_EDGE_SELECT} FROM counts WHERE scope = 'extended'", _BASE, _ALL, _EDGES, _COUNTS),
    "member_implements": _with(f"SELECT {_EDGE_SELECT} FROM counts WHERE scope = 'member'", _BASE, _ALL, _EDGES, _COUNTS),
    "d2_edges_overall": _with(f'SELECT tool, tp, fp, fn, "targetConfirmed", abstentions, {_SCORES}, {_ratio("targetConfirmed", "tp")} AS "targetAccuracy" FROM (SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(targetConfirmed) AS BIGINT) AS "targetConfirmed", CAST(sum(abstentions) AS BIGINT) AS abstentions FROM counts WHERE scope = \'main\' GROUP BY tool)', _BASE, _ALL, _EDGES, _COUNTS),
    "d1_matrix": _with(
        f"SELECT tool, type, tp, fp, fn, coalesce(claimed, 0) AS toolClaimed, tp AS oracleConfirmed, {_R} AS oracleRecall, {_P} AS toolPrecision, targetConfirmed, {_ratio('tp', 'sites')} AS siteCoverage, unscoreableExcluded, unscoreableMatched FROM counts LEFT JOIN (SELECT tool, type, count(*) AS claimed FROM edges GROUP BY ALL) USING (tool, type) WHERE scope = 'main'", _BASE, _ALL, _EDGES, _COUNTS,
    ),
    "resolved_slice": _with(
        f"SELECT t.tool, t.type, coalesce(n, 0) AS resolvedTotal, coalesce(c, 0) AS resolvedConfirmed, coalesce(k, 0) AS resolvedTargetConfirmed FROM (SELECT tool, unnest({list(EDGE_TYPES)}) AS type FROM tools) t LEFT JOIN (SELECT tool, type, count(*) AS n FROM edges WHERE resolved GROUP BY ALL) e ON e.tool = t.tool AND e.type = t.type LEFT JOIN (SELECT v.tool, v.type, count(*) FILTER (verdict IN ('target', 'name')) AS c, count(*) FILTER (verdict = 'target') AS k FROM verdicts v JOIN edges e ON e.tool = v.tool AND e.ord = v.ord WHERE scope = 'main' AND resolved GROUP BY ALL) x ON x.tool = t.tool AND x.type = t.type", _BASE, _ALL, _EDGES,
    ),
    "edge_false_negatives": _with("SELECT u.scope, t.tool, u.ord, u.nfrom, u.fromLocalId, u.type, u.targetName, CAST(sites AS BIGINT) AS \"siteCount\" FROM uniq u, tools t WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.scope = u.scope AND v.tool = t.tool AND v.oracle_ord = u.ord AND v.verdict IN ('target', 'name'))", _BASE, _ALL, _EDGES),
    "kind_labelling_overall": _with(f"SELECT tool, total, correct, unlabelled, total - correct - unlabelled AS mislabelled, {_ratio('correct', 'total')} AS accuracy FROM (SELECT tool, count(*) AS total, count(*) FILTER (r) AS correct, count(*) FILTER (NOT r AND tkind = 'Unknown') AS unlabelled FROM (SELECT *, tkind = okind OR (tkind IN ('Method', 'Property') AND okind IN ('Method', 'Property') AND {_cn('oname')} <> oname) AS r FROM judged WHERE okind IS NOT NULL) GROUP BY ALL)", _BASE, _IDENTITY, _KINDCOUNTS),
    "d1_summary": _with('SELECT tool, CAST(sum(tp) AS BIGINT) AS "totalTp", CAST(sum(fp) AS BIGINT) AS "totalFp", CAST(sum(fn) AS BIGINT) AS "totalFn" FROM counts WHERE scope = \'main\' GROUP BY tool', _BASE, _ALL, _EDGES, _COUNTS),
    "nodes_by_kind_histogram": _with("SELECT tool, kind, count(*) AS nodes FROM nodes GROUP BY ALL"),
    "jsonl_nodes": _with('SELECT \'own\' AS tool, row_number() OVER (ORDER BY ord) - 1 AS ord, id, name, path, kind, "startLine", CAST(NULL AS INT) AS "endLine", "parentId", CAST(NULL AS VARCHAR) AS "originalKind" FROM nodes WHERE tool = \'alpha\''),
    "jsonl_edges": _with('SELECT \'own\' AS tool, row_number() OVER (ORDER BY ord) - 1 AS ord, "fromId", "toId", type, resolved, confidence, CAST(NULL AS VARCHAR) AS "edgeKind" FROM edges WHERE tool = \'gamma\''),
    "jsonl_oracle_symbols": _with("SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM oracle_symbols"),
    "jsonl_oracle_edges": _with("SELECT * REPLACE (row_number() OVER (ORDER BY ord) - 1 AS ord) FROM oracle_edges"),
    "node_link_nodes": _with("""SELECT 'own' AS tool, ord, id, CASE WHEN kind = 'File' THEN label ELSE regexp_replace(regexp_replace(label, '^\\.', ''), '\\(\\)$', '') END AS name, source_file AS path, kind, CAST(ord AS INT) AS "startLine", CAST(NULL AS INT) AS "endLine", CAST(NULL AS VARCHAR) AS "parentId", CAST(NULL AS VARCHAR) AS "originalKind"
FROM (SELECT *, CASE WHEN label = regexp_extract(source_file, '[^/]*$') THEN 'File' WHEN label LIKE '%()' THEN CASE WHEN id IN (SELECT target FROM links WHERE relation = 'method') THEN 'Method' ELSE 'Function' END ELSE 'Unknown' END AS kind FROM link_nodes)"""),
    "node_link_edges": _with(f"""SELECT 'own' AS tool, source AS "fromId", target AS "toId", {_map('relation', labels.LINK_EDGES, 'UNKNOWN')} AS type, ord % 3 = 0 AS resolved, CASE WHEN ord % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, relation AS "edgeKind" FROM links WHERE {_map('relation', labels.LINK_EDGES, 'UNKNOWN')} <> 'UNKNOWN'"""),
    "tagged_record_nodes": _with(f"""SELECT 'own' AS tool, ord + 1 AS ord, id, name, 'src/x.ts' AS path, CASE WHEN node_type = 'FUNCTION' THEN CASE WHEN coalesce(class_name, '') = '' THEN 'Function' WHEN name = 'constructor' THEN 'Constructor' ELSE 'Method' END ELSE {_map('node_type', labels.RECORD_KINDS, 'Unknown')} END AS kind, CAST(ord % 100 + 1 AS INT) AS "startLine", CAST(ord % 100 + 4 AS INT) AS "endLine", p AS "parentId", node_type AS "originalKind"
FROM (SELECT *, 'n' || CAST(ord AS VARCHAR) AS id FROM raw_labels) LEFT JOIN (SELECT target, max_by(source, {{'s': seen, 'o': ord}}) AS p FROM (SELECT *, min(ord) OVER (PARTITION BY source) AS seen FROM links WHERE relation = 'contains') GROUP BY target) ON target = id"""),
    "tagged_record_edges": _with("""SELECT 'own' AS tool, source AS "fromId", target AS "toId", 'USES_TYPE' AS type, CAST(NULL AS BOOLEAN) AS resolved, CAST(NULL AS DOUBLE) AS confidence, 'REFERENCES' AS "edgeKind" FROM links WHERE relation = 'calls'"""),
    "paged_table_nodes": _with(f"""SELECT 'own' AS tool, o AS ord, id, name, path, {_map('label', labels.GRAPH_KINDS, 'Unknown')} AS kind, CASE WHEN o % 9 <> 1 THEN "startLine" END AS "startLine", CAST(NULL AS INT) AS "endLine", CAST(NULL AS VARCHAR) AS "parentId", label AS "originalKind"
FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS o, CASE WHEN kind = 'GlobalVariable' THEN 'Const' ELSE kind END AS label FROM nodes WHERE tool = 'beta') WHERE o % 50 <> 7"""),
    "paged_table_edges": _with(f"""SELECT 'own' AS tool, o AS ord, "fromId", "toId", {_map('type', labels.GRAPH_EDGES, 'UNKNOWN')} AS type, CASE WHEN o % 4 > 0 THEN confidence >= 0.5 END AS resolved, CASE WHEN o % 4 > 0 THEN confidence END AS confidence, type AS "edgeKind"
FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS o FROM edges WHERE tool = 'gamma') WHERE {_map('type', labels.GRAPH_EDGES, 'UNKNOWN')} <> 'UNKNOWN'"""),
    "parse_results_flattened": _with("""SELECT "fromPath", CASE WHEN type = 'IMPORTS' THEN "fromPath" ELSE "fromLocalId" END AS "fromLocalId", type, "targetName" FROM oracle_edges WHERE type IN ('IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'CALLS')"""),
    "symbols_by_project": _with('SELECT kind AS project, ord, "localId" FROM oracle_symbols'),
    "walked_twice": _with("SELECT DISTINCT path, CAST(2 AS BIGINT) AS n FROM files WHERE path LIKE 'pkg1%'"),
    "source_files": _with(r"SELECT ord, path FROM files WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$')"),
    "project_slugs": _with("SELECT dir AS \"rootPath\", coalesce(nullif(trim(regexp_replace(dir, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'root') AS slug FROM roots", _FILES),
    "cross_tool_coverage": _with(" UNION ALL ".join(f'SELECT *, "referenceResolved" - covers AS misses FROM {r}_result' for r in _REFERENCES), *map(_covered, _REFERENCES)),
}
