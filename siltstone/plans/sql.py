"""The virtual repository and the scoring semantics in SQL, to hold the Spark queries against."""

from __future__ import annotations

from ..functions import constants as K
from . import virtual as V

B = r"\b"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


ACTIONS = "CASE " + " ".join(f"WHEN regexp_matches(low, '{B}({p}){B}') THEN '{n}'" for n, p in K.ACTIONS) + " ELSE 'unknown' END"


def says(words: list[str]) -> str:
    return f"regexp_matches(low, '{B}({'|'.join(words)}){B}')"


def any_anchor(words: list[str]) -> str:
    return f"len(list_intersect(alow, [{quoted(words)}])) > 0"


def parsed(source: str) -> str:
    """CTEs raw, found and parsed over source (task_id, raw_text)."""
    return f"""
raw AS (SELECT task_id, raw_text, lower(raw_text) AS low FROM ({source})),
found AS (SELECT *, {ACTIONS} AS type,
  list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(raw_text, '[A-Z][A-Za-z0-9_]{{2,}}'), regexp_extract_all(raw_text, '{K.FILENAME}')),
   list_concat(list_filter(regexp_extract_all(raw_text, '`([^`\\n]*)`', 1), lambda s: s <> ''),
   list_filter(regexp_extract_all(low, '[A-Za-z0-9]{{4,}}'), lambda w: NOT list_contains([{quoted(K.STOP_WORDS)}], w)))))) AS anchors FROM raw),
parsed AS (SELECT *, list_transform(anchors, lambda a: lower(a)) AS alow FROM found)"""


TASKS = "SELECT concat('task-', CAST(n_nationkey AS STRING)) AS task_id, " + V.TASK.replace("\\n", "' || chr(10) || '") + " AS raw_text FROM nation"
LANGUAGE = "CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'yaml' END"

FILES = f"""
files0 AS (SELECT path, CAST(sum(size) AS BIGINT) AS size_bytes, min(camel) AS camel, min(text) AS text FROM
  (SELECT {V.PATH} AS path, p_size * 40 AS size, {V.CAMEL} AS camel, {V.TEXT} AS text FROM part) GROUP BY path),
files AS (SELECT *, {LANGUAGE} AS language, path LIKE '%!_test.go' ESCAPE '!' AS is_test, regexp_extract(path, '[^/]*$') AS base,
  CASE WHEN path LIKE '%.go' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS package,
  CASE WHEN path LIKE '%.go' AND NOT path LIKE '%!_test.go' ESCAPE '!' THEN lower(camel) || chr(31) || 'new' || lower(camel) WHEN path LIKE '%.ts' THEN lower(camel) || 'view' ELSE '' END AS blob
  FROM files0),
imports AS (SELECT DISTINCT path, import FROM (SELECT {V.PATH} AS path, unnest([{V.MODULE}, {V.LIBRARY}]) AS import FROM part) WHERE path LIKE '%.go' OR path LIKE '%.ts'),
dirs AS (SELECT DISTINCT package AS dir, regexp_replace(package, '/[^/]*$', '') AS parent, regexp_extract(package, '[^/]*$') AS dbase FROM files WHERE package <> ''),
resolved AS (SELECT import, dir FROM (SELECT i.import, d.dir, row_number() OVER (PARTITION BY i.import ORDER BY length(d.dir) DESC, d.dir) AS r
  FROM (SELECT DISTINCT import FROM imports) i JOIN dirs d ON i.import = d.dir OR ends_with(i.import, '/' || d.dir)) WHERE r = 1),
edges AS (SELECT DISTINCT f.package AS src, r.dir AS dst FROM files f JOIN imports i USING (path) JOIN resolved r USING (import) WHERE f.package <> ''),
links AS (SELECT t.path AS path, c.path AS link FROM files t JOIN files c ON t.is_test AND NOT c.is_test AND c.path LIKE '%.go' AND c.path = replace(t.path, '_test.go', '.go')
  UNION SELECT c.path, t.path FROM files t JOIN files c ON t.is_test AND NOT c.is_test AND c.path LIKE '%.go' AND c.path = replace(t.path, '_test.go', '.go'))"""

JACCARD = "CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))"
NAME_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(base), '[^a-z0-9]+'), lambda t: t <> ''))"
DOC_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))"


def flanked(name: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9_])' || replace({name}, '.', '\\.') || '($|[^a-z0-9_])')"


SIGNALS = f"""
anc AS (SELECT task_id, list_distinct(alow) AS aset FROM parsed),
dense AS (SELECT p.task_id, p.type, p.alow, f.path, f.package, f.is_test, f.language, f.size_bytes,
  CASE WHEN {flanked("lower(f.path)")} OR {flanked("lower(f.base)")} THEN 1.0 ELSE 0.0 END::DOUBLE AS mention,
  {JACCARD.format(a=NAME_TOKENS, b="a.aset")} AS filename,
  CASE WHEN f.blob = '' THEN 0.0 ELSE CAST(len(list_filter(p.alow, lambda x: contains(f.blob, x))) AS DOUBLE) / len(p.anchors) END::DOUBLE AS symbol,
  CASE WHEN f.package = '' THEN 0.0 WHEN list_contains(p.alow, f.package) OR list_contains(p.alow, regexp_extract(f.package, '[^/]*$')) THEN 1.0
   WHEN EXISTS (SELECT 1 FROM dirs d WHERE d.parent = regexp_replace(f.package, '/[^/]*$', '') AND d.dir <> f.package AND list_contains(p.alow, d.dbase)) THEN 0.7 ELSE 0.0 END::DOUBLE AS package_signal,
  CASE WHEN f.path LIKE '%.md' THEN {JACCARD.format(a=DOC_TOKENS, b="a.aset")} ELSE 0.0 END::DOUBLE AS doc,
  CASE WHEN NOT f.path LIKE 'config/%' THEN 0.0 WHEN p.type IN ('feature', 'migration', 'refactor') THEN 1.0 ELSE 0.5 END::DOUBLE AS config,
  CASE WHEN f.is_test AND list_contains(p.alow, regexp_extract(f.package, '[^/]*$')) THEN 0.5 ELSE 0.0 END::DOUBLE AS named
  FROM parsed p JOIN anc a USING (task_id) CROSS JOIN files f),
direct AS (SELECT DISTINCT path, dir FROM imports JOIN resolved USING (import)),
onward AS (SELECT DISTINCT d.path, e.dst AS dir FROM direct d JOIN edges e ON e.src = d.dir WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.path = d.path AND x.dir = e.dst))"""


def scored(tag: str = "", source: str = "dense") -> str:
    """From the signals in source to scores; every name ends in tag."""
    return f"""
p1{tag} AS (SELECT *, least(1.0, 0.3 + 0.7 * greatest(symbol, filename, package_signal)) AS damp1 FROM {source}),
pass1{tag} AS (SELECT *, least(1.0, greatest(0.0, 0.25 * mention * damp1 + 0.12 * filename + 0.2 * symbol + 0.12 * 0.0 + 0.1 * package_signal + 0.08 * named + 0.07 * doc + 0.06 * config)) AS pass1 FROM p1{tag}),
pkg{tag} AS (SELECT task_id, package AS dir, max(pass1) AS best FROM pass1{tag} WHERE package <> '' GROUP BY ALL),
imp{tag} AS (SELECT task_id, path, max(s) AS import_signal FROM (
  SELECT task_id, path, CASE WHEN best >= 0.8 THEN 1.0 WHEN best >= 0.6 THEN 0.7 ELSE 0.0 END AS s FROM direct JOIN pkg{tag} USING (dir)
  UNION ALL SELECT task_id, path, CASE WHEN best >= 0.6 THEN 0.4 ELSE 0.0 END FROM onward JOIN pkg{tag} USING (dir)) GROUP BY ALL),
tested{tag} AS (SELECT DISTINCT p.task_id, l.path FROM links l JOIN pass1{tag} p ON p.path = l.link WHERE p.pass1 >= 0.5),
sig{tag} AS (SELECT p.*, CAST(coalesce(i.import_signal, 0.0) AS DOUBLE) AS import_signal, CASE WHEN p.is_test AND t.path IS NOT NULL THEN 1.0 ELSE named END::DOUBLE AS test
  FROM pass1{tag} p LEFT JOIN imp{tag} i ON i.task_id = p.task_id AND i.path = p.path LEFT JOIN tested{tag} t ON t.task_id = p.task_id AND t.path = p.path),
sig2{tag} AS (SELECT *, CAST(least(1.0, 0.3 + 0.7 * greatest(symbol, filename, package_signal, import_signal)) AS DOUBLE) AS dampener FROM sig{tag}),
scores{tag} AS (SELECT *, least(1.0, greatest(0.0, 0.25 * mention * dampener + 0.12 * filename + 0.2 * symbol + 0.12 * import_signal + 0.1 * package_signal + 0.08 * test + 0.07 * doc + 0.06 * config)) AS score FROM sig2{tag})"""


CANDIDATES = """
li AS (SELECT CAST(l_suppkey AS STRING) AS task_id,
  concat(CASE WHEN l_linestatus = 'F' THEN 'src/handler_' ELSE 'src/part_' END, CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), CASE WHEN l_returnflag = 'A' THEN '.go' ELSE '.ts' END) AS path,
  l_discount * 10 - l_tax AS score, CAST(l_quantity * 900 AS BIGINT) AS size_bytes, l_partkey, l_returnflag, l_tax FROM lineitem),
cand0 AS (SELECT task_id, path, greatest(0.0, max(score)) AS score, max(size_bytes) AS size_bytes, max(l_partkey) AS k, max(l_returnflag) AS flag, max(l_tax) AS tax FROM li GROUP BY ALL),
cand1 AS (SELECT *, CAST(ceil(size_bytes * 2 / 7) AS BIGINT) + 32 AS cost_full FROM cand0),
cand AS (SELECT task_id, path, score, tax >= 0.08 AS mentioned, size_bytes, cost_full, CAST(floor(cost_full / 5) AS BIGINT) + 24 AS cost_structural, CAST(floor(cost_full / 4) AS BIGINT) + 24 AS cost_behavioral,
  CASE WHEN flag = 'A' THEN 'go' ELSE 'typescript' END AS language, CAST(k % 4 AS INTEGER) AS n_symbols, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_tags,
  CASE WHEN score >= 0.8 THEN 'highly_relevant' WHEN score >= 0.6 THEN 'moderately_relevant' WHEN score >= 0.3 THEN 'plausibly_relevant' ELSE 'low' END AS band,
  CASE WHEN size_bytes <= 8192 AND cost_full <= 2000 THEN 'small' WHEN size_bytes <= 32768 AND cost_full <= 8000 THEN 'medium' ELSE 'large' END AS size_band FROM cand1),
elig0 AS (SELECT *, (band = 'highly_relevant' OR mentioned) AND size_band <> 'large' AS is_full, band IN ('highly_relevant', 'moderately_relevant') AND language = 'go' AND n_symbols > 0 AS is_structural FROM cand),
elig AS (SELECT *, band IN ('highly_relevant', 'moderately_relevant') AND (NOT is_structural OR n_tags >= 2 OR path LIKE 'src/handler!_%' ESCAPE '!') AS is_behavioral FROM elig0),
modes AS (
  SELECT task_id, path, 'full' AS mode, cost_full AS cost, score, 1.0 AS w, 3 AS prio FROM elig WHERE is_full
  UNION ALL SELECT task_id, path, 'structural_summary', cost_structural, score, 0.6, 2 FROM elig WHERE is_structural
  UNION ALL SELECT task_id, path, 'behavioral_summary', cost_behavioral, score, 0.4, 1 FROM elig WHERE is_behavioral),
pairs AS (SELECT *, floor(abs(score * w / greatest(1, cost)) * 1000000000.0 + 0.5) / 1000000000.0 AS efficiency FROM modes),
buds AS (SELECT DISTINCT CAST(l_suppkey AS STRING) AS task_id, (l_suppkey % 7) * 4000 + 200 AS budget FROM lineitem)"""


def picked(name: str, pairs: str, budgets: str) -> str:
    """A recursive CTE name (task_id, path, mode, cost): pairs in order while they fit."""
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY efficiency DESC, cost, path, prio DESC) AS rn FROM {pairs}),
{name}_w AS (
  SELECT task_id, CAST(0 AS BIGINT) AS rn, CAST(budget AS BIGINT) AS rem, CAST([] AS VARCHAR[]) AS chosen, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS BIGINT) AS cost FROM {budgets}
  UNION ALL
  SELECT w.task_id, r.rn, CASE WHEN r.cost <= w.rem AND NOT list_contains(w.chosen, r.path) THEN w.rem - r.cost ELSE w.rem END,
    CASE WHEN r.cost <= w.rem AND NOT list_contains(w.chosen, r.path) THEN list_append(w.chosen, r.path) ELSE w.chosen END,
    CASE WHEN r.cost <= w.rem AND NOT list_contains(w.chosen, r.path) THEN r.path END,
    CASE WHEN r.cost <= w.rem AND NOT list_contains(w.chosen, r.path) THEN r.mode END,
    CASE WHEN r.cost <= w.rem AND NOT list_contains(w.chosen, r.path) THEN r.cost END
  FROM {name}_w w JOIN {name}_r r ON r.task_id = w.task_id AND r.rn = w.rn + 1),
{name} AS (SELECT task_id, path, mode, cost FROM {name}_w WHERE path IS NOT NULL)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"
