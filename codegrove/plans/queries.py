"""Registered queries over code corpora and catalogs, and their expected answers in SQL.

The SQL side never parses source text: it computes what the generated sources must give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegrove.api import Corpus
from codegrove.operators import links, metrics, renderer, validator
from codegrove.plans.generated import FILE_KEY, LINKED, SHAPE, broken_sources, linked_catalog, nation_catalogs, order_functions, part_catalog, prose_sources, supplier_catalog, supplier_modules, verdict_catalog, written
from codegrove.sources.catalog import scan_catalogs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHAPES = f"""WITH f AS (SELECT *, l + d + 1 + 2 * b AS sloc, d + b AS branches, CASE WHEN d > 0 THEN d WHEN b > 0 THEN 1 ELSE 0 END AS depth,
  CASE WHEN d > 0 THEN 4 + doc + l + d WHEN b > 0 THEN 6 + doc + l ELSE 1 END AS depth_line, CASE WHEN d > 0 THEN 4 * (d + 1) WHEN b > 0 THEN 8 ELSE 0 END AS depth_col,
  4 + doc + l + d + 2 * b AS last_line FROM (SELECT {SHAPE} FROM orders))"""
TAGS = SHAPES + """, t AS (
  SELECT k, 0 AS detector_ord, 'deep-nesting' AS name, depth_line AS line, depth_col AS col, 'Control flow nested ' || depth || ' levels deep. Default threshold: 4.' AS measured FROM f WHERE depth >= 4
  UNION ALL SELECT k, 1, 'long-function', 1, 0, 'Function body has ' || sloc || ' SLOC (excluding docstring and nested-scope bodies). Default threshold: 80.' FROM f WHERE sloc >= 80
  UNION ALL SELECT k, 2, 'god-function', 1, 0, 'Function is long AND branchy: ' || sloc || ' SLOC, ' || branches || ' branches (if/elif/for/while/except/case). Default thresholds: 200 SLOC & 15 branches.' FROM f WHERE sloc >= 200 AND branches >= 15
  UNION ALL SELECT k, 3, 'too-many-params', 1, 0, 'Function signature has ' || p || ' parameters (excluding self/cls; *args and **kwargs count as 1 each). Default threshold: 5.' FROM f WHERE p >= 5)"""
INDEX = ", i(entry_kind, entry_id, entry_number, entry_title, name, entry_ord) AS (VALUES " + ", ".join(
    f"('{kind}', '{id_}', {'NULL' if number is None else number}, '{title}', '{tag}', {10 * (kind != 'dogma') + ord_})" for kind, ord_, id_, number, title, tags in LINKED for tag in tags
) + ")"
MODULES = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS m FROM supplier), g AS (
  SELECT k, 2 * i AS fn_ord, 'C' || k || '.m' || i AS qualified_name, 'method' AS kind, 'C' || k AS container, 2 + 4 * i AS lineno, 5 + 4 * i AS end_lineno, 3 AS n_params FROM s, unnest(range(m)) AS u(i)
  UNION ALL SELECT k, 2 * i + 1, 'C' || k || '.m' || i || '.helper', 'nested', 'C' || k || '.m' || i, 3 + 4 * i, 4 + 4 * i, 0 FROM s, unnest(range(m)) AS u(i)
  UNION ALL SELECT k, 2 * m, 'top', 'function', NULL, 2 + 4 * m, 3 + 4 * m, 1 FROM s
  UNION ALL SELECT k, 2 * m + 1, 'top', 'function', NULL, 4 + 4 * m, 5 + 4 * m, 0 FROM s WHERE k % 3 = 0)"""
PARTS = """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 <> 0 AS dogma, CASE WHEN p_partkey % 50 = 0 THEN 'dup' || (p_partkey % 7) ELSE 'e' || p_partkey END AS id,
  CASE WHEN p_partkey % 97 = 1 THEN 5 ELSE p_partkey END AS number FROM part)"""
ISSUES = {
    1: """SELECT 1 AS rule, 'error' AS severity, 'dogma:' || id AS entity, CASE WHEN k % 7 = 0 THEN 'counter_dogma ''n'' has no `attribution` (rule 1 — honesty-bug)' ELSE 'counter_dogmas[1] is not a mapping: ''text''' END AS message FROM p WHERE dogma AND k % 7 < 2""",
    2: """SELECT 2, CASE WHEN k % 8 = 3 THEN 'warning' ELSE 'error' END, 'dogma:' || id, CASE k % 8
  WHEN 1 THEN 'failure_cases: unknown marker ''bogus''. Allowed: [''need_cases'', ''need_data'', ''need_postmortems''] or a list of entries.'
  WHEN 3 THEN 'failure_cases[1] is missing `title`' WHEN 4 THEN 'failure_cases: expected str marker or list, got int' ELSE 'failure_cases[0] must be a mapping with title/source_url/summary, got str' END FROM p WHERE dogma AND k % 8 IN (1, 3, 4, 5)""",
    3: """SELECT 3, 'error', 'catalog', 'id ''' || id || ''' reused across entries: ' || string_agg(CASE WHEN dogma THEN 'dogma §' || number ELSE 'candidate' END, ', ' ORDER BY NOT dogma, k) FROM p GROUP BY id HAVING count(*) > 1""",
    4: """SELECT 4, 'error', 'catalog', 'number §' || number || ' reused: [' || string_agg('''' || id || '''', ', ' ORDER BY k) || ']' FROM p WHERE dogma GROUP BY number HAVING count(*) > 1
UNION ALL SELECT 4, 'error', 'catalog', 'dogma numbers are not a continuous 1..N sequence. Got [' || (SELECT string_agg(number, ', ' ORDER BY number) FROM n) || ']. Missing: ['
  || coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM unnest(range(1, (SELECT count(*) + 1 FROM n))) AS u(x) WHERE x NOT IN (SELECT number FROM n)), '') || ']. Extra/out-of-range: ['
  || coalesce((SELECT string_agg(number, ', ' ORDER BY number) FROM n WHERE number > (SELECT count(*) FROM n)), '') || '].'""",
    5: """SELECT 5, 'error', 'dogma:' || id, 'v01_priority is true but status is ''stub'' — priority dogmas must be at least ''draft''.' FROM p WHERE dogma AND k % 5 = 0 AND k % 3 = 0""",
    6: """SELECT 6, 'error', 'dogma:' || id, 'honest_verdict.status is ''final'' but these fields are empty/missing: [''break_when'', ''main_signal'']' FROM p WHERE dogma AND k % 9 = 1""",
}
PARTS += ", n AS (SELECT DISTINCT number FROM p WHERE dogma)"


def _register(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name], ORACLE[name] = query, oracle
        return query

    return add


def _orders(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(order_functions(spark, sf_dir))


def _modules(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(supplier_modules(spark, sf_dir))


def _longs(df: DataFrame) -> DataFrame:
    """Every int column as long, as counted by the other side."""
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _typed(sql: str, text: tuple[str, ...] = (), long: tuple[str, ...] = ()) -> str:
    columns = ", ".join([*text, *(f"CAST({c} AS BIGINT) AS {c}" for c in long)])
    return f"SELECT {columns} FROM ({sql})"


@_register("q_list_functions", _typed(MODULES + " SELECT 's' || k AS path, * FROM g", ("path", "qualified_name", "kind", "container"), ("fn_ord", "lineno", "end_lineno")))
def list_functions(spark, sf_dir):
    return _longs(_modules(spark, sf_dir).functions().select("path", "qualified_name", "kind", "container", "fn_ord", "lineno", "end_lineno"))


@_register("q_find_function", _typed(MODULES + " SELECT 's' || k AS path, min(fn_ord) AS fn_ord, min(lineno) AS lineno FROM g WHERE qualified_name = 'top' GROUP BY k", ("path",), ("fn_ord", "lineno")))
def find_function(spark, sf_dir):
    return _longs(_modules(spark, sf_dir).find("top").select("path", "fn_ord", "lineno"))


@_register("q_kind_counts", MODULES + " SELECT kind, count(*) AS n FROM g GROUP BY kind")
def kind_counts(spark, sf_dir):
    return _modules(spark, sf_dir).functions().groupBy("kind").agg(F.count("*").alias("n"))


@_register("q_listing", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS m FROM supplier)
SELECT 's' || k AS path, 'Top-level functions:' || chr(10) || '- top (line ' || (2 + 4 * m) || ')' || CASE WHEN k % 3 = 0 THEN chr(10) || '- top (line ' || (4 + 4 * m) || ')' ELSE '' END
  || chr(10) || 'Methods:' || (SELECT string_agg(chr(10) || '- C' || k || '.m' || i || ' (line ' || (2 + 4 * i) || ')', '' ORDER BY i) FROM unnest(range(m)) AS u(i))
  || chr(10) || 'Nested functions:' || (SELECT string_agg(chr(10) || '- C' || k || '.m' || i || '.helper (line ' || (3 + 4 * i) || ')', '' ORDER BY i) FROM unnest(range(m)) AS u(i)) AS listing FROM s""")  # fmt: skip
def listing(spark, sf_dir):
    return _modules(spark, sf_dir).listing()


@_register("q_params", _typed(SHAPES + " SELECT 'f' || k AS qualified_name, p AS n_params FROM f UNION ALL (" + MODULES + " SELECT qualified_name, n_params FROM g)", ("qualified_name",), ("n_params",)))
def params(spark, sf_dir):
    both = _orders(spark, sf_dir).functions().union(_modules(spark, sf_dir).functions())
    return _longs(both.select("qualified_name", metrics.n_params().alias("n_params")))


@_register("q_nesting_depth", _typed(SHAPES + " SELECT 'f' || k AS qualified_name, * FROM f", ("qualified_name",), ("depth", "depth_line", "depth_col")))
def nesting_depth(spark, sf_dir):
    return _longs(_orders(spark, sf_dir).metrics().select("qualified_name", F.col("max_depth").alias("depth"), "depth_line", "depth_col"))


@_register("q_sloc", _typed(SHAPES + " SELECT 'f' || k AS qualified_name, * FROM f", ("qualified_name",), ("sloc",)))
def sloc(spark, sf_dir):
    return _longs(_orders(spark, sf_dir).metrics().select("qualified_name", "sloc"))


@_register("q_branches", _typed(SHAPES + " SELECT 'f' || k AS qualified_name, * FROM f", ("qualified_name",), ("branches",)))
def branches(spark, sf_dir):
    return _longs(_orders(spark, sf_dir).metrics().select("qualified_name", "branches"))


def _tag_rows(spark, sf_dir) -> DataFrame:
    measured = F.regexp_extract("detail", "^(.*?) Source note", 1).alias("measured")
    return _longs(_orders(spark, sf_dir).tags().select("qualified_name", "detector_ord", "name", "line", "col", measured))


_TAG_TYPES = ("qualified_name", "name", "measured"), ("detector_ord", "line", "col")


@_register("q_tags", _typed(TAGS + " SELECT 'f' || k AS qualified_name, * FROM t", *_TAG_TYPES))
def tags(spark, sf_dir):
    return _tag_rows(spark, sf_dir)


for _query, _name in (("q_deep_nesting", "deep-nesting"), ("q_long_function", "long-function"), ("q_god_function", "god-function"), ("q_too_many_params", "too-many-params")):
    _register(_query, _typed(TAGS + f" SELECT 'f' || k AS qualified_name, * FROM t WHERE name = '{_name}'", *_TAG_TYPES))(
        lambda spark, sf_dir, name=_name: _tag_rows(spark, sf_dir).where(F.col("name") == name)
    )


@_register("q_statements", _typed(SHAPES + """, w AS (SELECT k, l + doc + d + 1 + 2 * b AS statements, l + doc + 1 + CASE WHEN b > 0 THEN 1 ELSE 0 END AS top_statements FROM f)
  SELECT 'o' || k AS path, * FROM w""", ("path",), ("statements", "top_statements")))  # fmt: skip
def statements(spark, sf_dir):
    # files are told by their paths alone, so two files of one path count together
    return _orders(spark, sf_dir).functions().groupBy("path").agg(F.sum("n_statements").alias("statements"), F.sum("n_top_statements").alias("top_statements"))


@_register("q_tag_index", _typed(TAGS + INDEX + " SELECT name AS tag, * FROM i", ("tag", "entry_kind", "entry_id", "entry_title"), ("entry_number",)))
def tag_index(spark, sf_dir):
    return _longs(links.tag_index(linked_catalog(spark)).select("tag", "entry_kind", "entry_id", "entry_title", "entry_number"))


def _probed(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).probe(linked_catalog(spark))


@_register("q_links", _typed(TAGS + INDEX + " SELECT 'f' || k AS qualified_name, name AS tag_name, * EXCLUDE (name) FROM t JOIN i USING (name)", ("qualified_name", "tag_name", "entry_id", "entry_kind", "entry_title"), ("entry_number",)))
def linked(spark, sf_dir):
    return _longs(links.links(_probed(spark, sf_dir)).select("qualified_name", "tag_name", "entry_id", "entry_kind", "entry_title", "entry_number"))


@_register("q_unlinked_tags", TAGS + INDEX + " SELECT 'f' || k AS qualified_name, name FROM t WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.name = t.name)")
def unlinked(spark, sf_dir):
    return links.unlinked_tags(_orders(spark, sf_dir).tags(), linked_catalog(spark)).select("qualified_name", "name")


_PROBE = TAGS + INDEX + """, a AS (SELECT k, count(*) AS n_tags, string_agg(name, ',' ORDER BY detector_ord) AS tags FROM t GROUP BY k),
  e AS (SELECT k, string_agg(entry_id, ',' ORDER BY detector_ord, entry_ord) AS links FROM t JOIN i USING (name) GROUP BY k)
  SELECT 'f' || k AS qualified_name, 1 AS line_start, last_line AS line_end, last_line AS loc, coalesce(n_tags, 0) AS n_tags, coalesce(tags, '') AS tags, coalesce(links, '') AS links FROM f LEFT JOIN a USING (k) LEFT JOIN e USING (k)"""  # fmt: skip


@_register("q_probe_results", _typed(_PROBE, ("qualified_name", "tags", "links"), ("line_start", "line_end", "loc", "n_tags")))
def probe_results(spark, sf_dir):
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    out = _probed(spark, sf_dir).select("qualified_name", F.col("lineno").alias("line_start"), F.col("end_lineno").alias("line_end"), "loc", F.size("tags").alias("n_tags"), names("tags", "name").alias("tags"), names("links", "entry_id").alias("links"))
    return _longs(out)


_NOTED = "CASE name " + " ".join(f"WHEN '{name}' THEN '{note}'" for name, note in metrics.NOTES.items()) + " END"
_REPORT = TAGS + INDEX + f""", a AS (SELECT k, string_agg('- [' || name || '] at line ' || line || ', col ' || col || chr(10) || '  ' || measured || ' Source note: ' || {_NOTED}, chr(10) ORDER BY detector_ord) AS tags FROM t GROUP BY k),
  e AS (SELECT k, string_agg('- [' || name || '] → ' || CASE WHEN entry_number IS NULL THEN '(candidate) ' ELSE '§' || entry_number || ' ' END || entry_title || '  [' || entry_id || ']', chr(10) ORDER BY detector_ord, entry_ord) AS links FROM t JOIN i USING (name) GROUP BY k)
  SELECT 'f' || k AS qualified_name, '=== Function Probe ===' || chr(10) || 'File: o' || k || chr(10) || 'Function: f' || k || ' (lines 1-' || last_line || ', ' || last_line || ' total)' || chr(10) || chr(10)
    || CASE WHEN tags IS NULL THEN 'No tags from the detector set.' || chr(10) || 'Detectors: {', '.join(metrics.DETECTORS)}.' || chr(10) || '(Absence of a tag is not absence of a problem.)'
       ELSE 'Detected tags:' || chr(10) || tags || chr(10) || chr(10) || coalesce('Catalog links:' || chr(10) || links, 'Catalog links: none — no catalog dogma claims these tags yet.') END AS report FROM f LEFT JOIN a USING (k) LEFT JOIN e USING (k)"""


@_register("q_probe_report", _REPORT)
def probe_report(spark, sf_dir):
    return _probed(spark, sf_dir).select("qualified_name", "report")


@_register("q_probe_function", MODULES + " SELECT 's' || k AS path, min(fn_ord) AS fn_ord, 'No tags detected. Trust score unknown.' AS spoken FROM g WHERE qualified_name = 'top' GROUP BY k")
def probe_function(spark, sf_dir):
    rows = _modules(spark, sf_dir).probe_function("top", linked_catalog(spark))
    return rows.select("path", F.col("fn_ord").cast("long").alias("fn_ord"), "spoken")


@_register("q_top_level", _typed(MODULES + " SELECT 's' || k AS path, fn_ord, qualified_name FROM g WHERE kind = 'function'", ("path", "qualified_name"), ("fn_ord",)))
def top_level(spark, sf_dir):
    return _longs(_modules(spark, sf_dir).top_level_functions().select("path", "qualified_name", "fn_ord"))


@_register("q_file_scan", _typed(MODULES + " SELECT k, * EXCLUDE (k) FROM g", ("qualified_name", "kind", "container"), ("k", "fn_ord", "lineno", "end_lineno")))
def file_scan(spark, sf_dir):
    """The same modules as files, read back by a file scan."""
    rows = supplier_modules(spark, sf_dir).select(F.substring("path", 2, 20).cast("long").alias("k"), "content")
    found = Corpus.of_files(spark, written(rows, "sources"), "*.txt").functions()
    return _longs(found.select(F.regexp_extract("path", FILE_KEY, 1).cast("long").alias("k"), "qualified_name", "kind", "container", "fn_ord", "lineno", "end_lineno"))


@_register("q_error_rows", """SELECT 'b' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey % 7 + 1 WHEN 3 THEN 1 END AS lineno, s_suppkey % 4 = 2 AS not_utf8 FROM supplier WHERE s_suppkey % 4 <> 0""")
def error_rows(spark, sf_dir):
    errors = Corpus(broken_sources(spark, sf_dir)).errors()
    return _longs(errors.select("path", "lineno", F.col("msg").startswith("not UTF-8").alias("not_utf8")))


_USABLE = "s_nationkey % 6 < 4"


@_register("q_catalog_scan", f"""SELECT s_nationkey AS k, 'dogma' AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, 'e' || s_suppkey AS id, s_suppkey AS number, s_name AS title, 'stub' AS status, s_suppkey % 2 = 0 AS v01_priority, 't' || (s_suppkey % 3) || ',x' AS tags FROM supplier WHERE {_USABLE}
  UNION ALL SELECT DISTINCT s_nationkey, 'candidate', 0, 'c' || s_nationkey, NULL, 'Candidate', NULL, false, '' FROM supplier WHERE {_USABLE}""")  # fmt: skip
def catalog_scan(spark, sf_dir):
    entries, _ = scan_catalogs(spark, written(nation_catalogs(spark, sf_dir), "catalogs"), "*.txt")
    key = F.regexp_extract("catalog", FILE_KEY, 1).cast("int").alias("k")
    return entries.select(key, "kind", F.col("ord").cast("long").alias("ord"), "id", F.col("number").cast("long").alias("number"), "title", "status", "v01_priority", F.array_join("related_tags", ",").alias("tags"))


@_register("q_catalog_problems", """SELECT DISTINCT s_nationkey AS k, s_nationkey % 6 = 4 AS no_mapping, s_nationkey % 6 = 5 AS other_version, s_nationkey % 6 = 5 AS lacks_fields FROM supplier WHERE s_nationkey % 6 >= 4""")
def catalog_problems(spark, sf_dir):
    _, problems = scan_catalogs(spark, written(nation_catalogs(spark, sf_dir), "catalogs"), "*.txt")
    key = F.regexp_extract("catalog", FILE_KEY, 1).cast("int").alias("k")
    return problems.select(key, F.col("msg").contains("mapping").alias("no_mapping"), F.col("msg").contains("only v1").alias("other_version"), F.col("msg").contains("lacks number, title, status").alias("lacks_fields"))


@_register("q_validate_catalogs", f"""SELECT s_nationkey AS k, 5 AS rule, 'dogma:e' || s_suppkey AS entity FROM supplier WHERE {_USABLE} AND s_suppkey % 2 = 0
  UNION ALL SELECT s_nationkey, 4, 'catalog' FROM supplier WHERE {_USABLE} GROUP BY s_nationkey HAVING min(s_suppkey) <> 1 OR max(s_suppkey) <> count(*)""")  # fmt: skip
def validate_catalogs(spark, sf_dir):
    entries, _ = scan_catalogs(spark, written(nation_catalogs(spark, sf_dir), "catalogs"), "*.txt")
    issues = validator.validate(entries)
    return issues.select(F.regexp_extract("catalog", FILE_KEY, 1).cast("int").alias("k"), "rule", "entity")


@_register("q_spoken_summary", TAGS + """, a AS (SELECT k, count(*) AS n, string_agg(replace(name, '-', ' '), ', ' ORDER BY detector_ord) AS said FROM t GROUP BY k)
  SELECT 'f' || k AS qualified_name, CASE WHEN n IS NULL THEN 'No tags detected.' ELSE CASE n WHEN 1 THEN 'One tag' WHEN 2 THEN 'Two tags' WHEN 3 THEN 'Three tags' ELSE 'Four tags' END || ' found: ' || said || '.' END || ' Trust score unknown.' AS spoken FROM f LEFT JOIN a USING (k)""")  # fmt: skip
def spoken_summary(spark, sf_dir):
    return _probed(spark, sf_dir).select("qualified_name", "spoken")


@_register("q_spoken_numbers", """WITH w AS (SELECT ['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten'] AS words)
  SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN 'No tags detected.' ELSE coalesce(words[n_nationkey], CAST(n_nationkey AS VARCHAR)) || CASE WHEN n_nationkey = 1 THEN ' tag' ELSE ' tags' END || ' found: ' || rtrim(repeat('a tag b, ', n_nationkey), ', ') || '.' END || ' Trust score unknown.' AS spoken FROM nation, w""")  # fmt: skip
def spoken_numbers(spark, sf_dir):
    names = F.expr("array_repeat('a-tag-b', n_nationkey)")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), links.spoken_summary(names).alias("spoken"))


@_register("q_parse_errors", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def parse_errors(spark, sf_dir):
    lang = F.when(F.instr("path", "/") > 0, F.expr("substring(path, instr(path, '/') + 1)"))
    return Corpus(prose_sources(spark, sf_dir)).errors().groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


for _k, _sql in ISSUES.items():
    _columns = "" if _k == 1 else "AS i(rule, severity, entity, message)"
    _register(f"q_validate_rule{_k}", f"{PARTS} SELECT CAST(rule AS INTEGER) AS rule, severity, entity, message FROM ({_sql}) {_columns}")(
        lambda spark, sf_dir, rule=validator.RULES[_k - 1]: rule(part_catalog(spark, sf_dir)).drop("catalog")
    )

_ALL = " UNION ALL ".join(ISSUES.values())


@_register("q_issues_sorted", f"{PARTS}, a AS ({_ALL}) SELECT row_number() OVER (ORDER BY rule, encode(entity), encode(message)) AS rank, CAST(rule AS INTEGER) AS rule, entity, message FROM a")
def issues_sorted(spark, sf_dir):
    from pyspark.sql import Window

    issues = validator.validate(part_catalog(spark, sf_dir))
    # issues of one catalog: what a person reads
    return issues.withColumn("rank", F.row_number().over(Window.partitionBy("catalog").orderBy("rule", "entity", "message")).cast("long")).select("rank", "rule", "entity", "message")


@_register("q_issue_counts", f"{PARTS}, a AS ({_ALL}) SELECT CAST(rule AS INTEGER) AS rule, severity, count(*) AS n, severity = 'error' AS fails FROM a GROUP BY rule, severity")
def issue_counts(spark, sf_dir):
    issues = validator.validate(part_catalog(spark, sf_dir))
    return issues.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "error").alias("fails"))


_N = "chr(10)"
_TAGS_LINE = f"CASE WHEN k % 2 = 0 THEN {_N} || {_N} || '**Related tags:** `deep-nesting`, `x`.' ELSE '{{}}' END"
_BLOCK = f"""WITH s AS (SELECT s_suppkey AS k, s_name, 100000 - s_suppkey AS number FROM supplier), r AS (SELECT k, number, k % 5 <> 0 AS dogma, CASE
  WHEN k % 5 = 0 THEN '### ' || s_name || '  \\[e' || k || '\\]' || {_N} || {_N} || 'Note ' || k || {_N} || {_N} || '{renderer.TEXT['sources']}' || {_N} || {_N} || '- [Q](w)' || CASE WHEN k % 2 = 0 THEN {_TAGS_LINE} ELSE {_N} END
  ELSE '## §' || number || '. ' || s_name || CASE WHEN k % 7 = 0 THEN ' 🎯' ELSE '' END || '  \\[' || CASE WHEN k % 3 = 0 THEN 'stub' ELSE 'filled' END || '\\]' || {_N} || {_N} || '{renderer.TEXT['definition']}Def ' || k || {_N} || {_N}
    || CASE WHEN k % 3 = 0 THEN '{renderer.TEXT['stub']}' || CASE WHEN k % 2 = 0 THEN {_TAGS_LINE} ELSE '' END
    ELSE '{renderer.TEXT['conditions']}' || {_N} || {_N} || '- c1' || {_N} || '- c2' || {_N} || {_N} || '**Failure cases.**' || {_N} || {_N} || CASE WHEN k % 4 = 1 THEN '- _need_data_' ELSE '- [T](u) — S' END || {_N} || {_N}
      || '{renderer.TEXT['counter']}' || {_N} || {_N} || '- **N** — _{renderer.TEXT['no-author']}_' || {_N} || '  > H' || CASE WHEN k % 2 = 0 THEN {_TAGS_LINE} ELSE {_N} END END END AS block FROM s)"""


@_register("q_render_block", _BLOCK + " SELECT 'e' || k AS id, block FROM r")
def render_block(spark, sf_dir):
    return renderer.blocks(supplier_catalog(spark, sf_dir)).select("id", "block")


_TEMPLATE = renderer.Template("<!-- banner -->", "# Title", "Two\nlines", "## Candidates", "---\n\nFooter")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", f"' || {_N} || '") + "'"


@_register("q_render_catalog", _BLOCK + f""" SELECT {_sql_text(chr(10).join(x + chr(10) for x in (_TEMPLATE.banner, _TEMPLATE.title, renderer.TEXT['updated'].format('2026-01-02', 1), _TEMPLATE.intro)))} || {_N}
  || string_agg(block, {_N} || {_N} ORDER BY number) FILTER (dogma) || {_N} || {_N} || {_sql_text(_TEMPLATE.candidates)} || {_N} || {_N}
  || string_agg(block, {_N} || {_N} ORDER BY k) FILTER (NOT dogma) || {_N} || {_N} || {_sql_text(_TEMPLATE.footer)} || {_N} AS markdown FROM r""")  # fmt: skip
def render_catalog(spark, sf_dir):
    return renderer.render(supplier_catalog(spark, sf_dir), "2026-01-02", template=_TEMPLATE).select("markdown")


_P = f"{_N} || {_N}"


@_register("q_render_shapes", f"""SELECT 'v' || k AS id, CASE WHEN k % 6 = 0 THEN '### ' || s_name || '  \\[v' || k || '\\]'
    || CASE WHEN k % 12 = 0 THEN {_P} || '{renderer.TEXT['sources']}' || {_P} || '- text' || {_N} || '- [T](w) — H' ELSE '' END
  ELSE '## §' || k || '. ' || s_name || '  \\[filled\\]' || CASE WHEN k % 2 = 0 THEN {_P} || '{renderer.TEXT['origin']}O' ELSE '' END
    || CASE WHEN k % 8 IN (0, 2, 6) THEN '' ELSE {_P} || '**Failure cases.**' || {_P} || CASE k % 8 WHEN 1 THEN '- _need_data_' WHEN 5 THEN '- plain' || {_N} || '- [N](u)' || {_N} || '- (untitled source) — S' || {_N} || '- 7'
         ELSE '- _unsupported value shape for `Failure cases`: ' || CASE k % 8 WHEN 3 THEN 'int' WHEN 4 THEN 'dict' ELSE 'bool' END || '_' END END
    || CASE WHEN k % 3 = 0 THEN {_P} || '{renderer.TEXT['counter']}' || {_P} || '- **N** — _A_ ([source](s))' || {_N} || '  > H' || {_N} || '- **(untitled)** — _{renderer.TEXT['no-author']}_' ELSE '' END
    || CASE k % 4 WHEN 1 THEN {_P} || '**Honest verdict** \\[final\\].' || {_P} || '{renderer.TEXT['follow']}' || {_P} || '- a' || {_N} || '- 1' || {_P} || '**Main signal:** M'
         WHEN 2 THEN {_P} || '**Honest verdict** \\[pending\\].' || {_P} || '{renderer.TEXT['break']}' || {_P} || '- b' ELSE '' END END || {_N} AS block
  FROM (SELECT s_suppkey AS k, s_name FROM supplier)""")  # fmt: skip
def render_shapes(spark, sf_dir):
    return renderer.blocks(verdict_catalog(spark, sf_dir)).select("id", "block")


@_register("q_drift", """SELECT side, line_no, line FROM (SELECT 'rendered' AS side, 2 AS line_no, '# Title' AS line UNION ALL SELECT 'written', 2, '# Changed')""")
def drift(spark, sf_dir):
    text = renderer.render(supplier_catalog(spark, sf_dir), template=_TEMPLATE).select(F.col("markdown").alias("text"))
    return renderer.drift(text, text.select(F.replace("text", F.lit(_TEMPLATE.title), F.lit("# Changed")).alias("text")))


@_register("q_rule_list", """SELECT CASE WHEN s_suppkey % 5 = 0 THEN '- ' || s_name || '  [e' || s_suppkey || ']'
  ELSE '§' || (100000 - s_suppkey) || '. ' || s_name || ' [filled]' || CASE WHEN s_suppkey % 7 = 0 THEN ' 🎯' ELSE '' END END AS line FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 <> 0""")  # fmt: skip
def rule_list(spark, sf_dir):
    return renderer.rule_list(supplier_catalog(spark, sf_dir), stubs=False, candidates=True).select("line")
