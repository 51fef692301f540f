"""The code-corpus engine: inline sources with expected numbers, the standard library as a differential corpus, catalogs, reports, CLI."""

import ast
import sys
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from codegrove import cli, voice
from codegrove.api import Corpus
from codegrove.functions.parser import Rows, parse
from codegrove.operators import links, renderer, validator
from codegrove.operators.metrics import Thresholds
from codegrove.sources.catalog import CatalogError, discover, parse_catalog, scan_catalogs

# source of one function `f`, then depth, line of the deepest statement, SLOC, branches, parameters
CASES = [
    ("def f():\n    pass\n", 0, 1, 1, 0, 0),
    ('def f(self, a, /, b, *, c, **d):\n    """doc"""\n    x = 1\n\n    # note\n    y = 2\n', 0, 1, 2, 0, 4),
    ("def f(cls):\n    if a:\n        x\n    elif b:\n        y\n    else:\n        z\n", 1, 3, 6, 2, 0),
    ("def f(*a):\n    if a:\n        pass\n    else:\n        if b:\n            pass\n", 1, 3, 5, 2, 1),
    ("def f(a):\n    if a:\n\n        # note\n        def g():\n            if b:\n                pass\n", 1, 5, 6, 1, 1),
    ("def f(a):\n    def g():\n        if b:\n            pass\n    @d\n    class C:\n        x = 1\n", 0, 1, 2, 0, 1),
    ("def f():\n    try:\n        a\n    except* E:\n        if b:\n            c\n    finally:\n        for x in y: pass\n", 0, 1, 7, 1, 0),
    ("def f():\n    try:\n        a\n    except E:\n        for x in y:\n            c\n    except F:\n        pass\n    else:\n        while z: pass\n", 2, 6, 9, 4, 0),
    ("def f(x):\n    match x:\n        case 1:\n            with a:\n                b\n        case _:\n            pass\n", 2, 5, 6, 2, 1),
    ("async def f():\n    async for x in y:\n        async with z:\n            a; b\n", 2, 4, 3, 1, 0),
    ('def f():\n    "doc"\n', 0, 1, 0, 0, 0),
    ('def f():\n    a\n    "not doc"\n    x = (1,\n        2)\n', 0, 1, 4, 0, 0),
]


def corpus(spark, *sources, **options):
    return Corpus(spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sources)], "path string, content " + ("binary" if isinstance(sources[0], bytes) else "string")), **options)


def test_metrics_of_inline_sources(spark):
    rows = {r.path: r for r in corpus(spark, *(c[0] for c in CASES)).metrics().where("qualified_name = 'f'").collect()}
    for i, (source, *want) in enumerate(CASES):
        r = rows[f"p{i}"]
        assert [r.max_depth, r.depth_line, r.sloc, r.branches, r.n_params] == want, source


NAMES = "def a(): pass\nclass B:\n    def c(self):\n        def d(): pass\n        class E:\n            async def f(self): pass\nif x:\n    def no(): pass\ndef a(x): pass\n"


def test_discovery_names_kinds_and_first_match(spark):
    c = corpus(spark, NAMES)
    rows = c.functions().orderBy("fn_ord").collect()
    assert [(r.qualified_name, r.kind, r.container) for r in rows] == [("a", "function", None), ("B.c", "method", "B"), ("B.c.d", "nested", "B.c"), ("B.c.E.f", "method", "B.c.E"), ("a", "function", None)]
    assert [r.n_arguments for r in c.find("a").collect()] == [0] and c.find("c").count() == 0
    assert c.listing().first().listing == "Top-level functions:\n- a (line 1)\n- a (line 9)\nMethods:\n- B.c (line 3)\n- B.c.E.f (line 6)\nNested functions:\n- B.c.d (line 4)"


def test_bad_files_are_rows(spark):
    bad = [b"\xff\xfe", "\ufeffx = 1\n".encode(), b"x = 1\0", b"(" * 250 + b")" * 250, b"def f(:\n", b"".join(b" " * i + b"if x:\n" for i in range(101)) + b" " * 101 + b"pass\n"]
    c = corpus(spark, *bad, b"", b"def ok(): pass\n")
    assert {r.path for r in c.errors().collect()} == {f"p{i}" for i in range(len(bad))}
    assert [r.qualified_name for r in c.functions().collect()] == ["ok"]
    rows = Rows()
    parse("x", None, rows)
    parse("y", "def f(): pass\n", rows)
    parse("z", "def f(): pass\ndef g(:\n", rows)
    assert rows.batch().to_pydict()["path"] == ["y", "z"] and rows.ends == [0, 1, 1]


PIECES = ["# lead\n\nx = 1\n", "def f(a, *, b):\n  x = 0\n  y = 1\n", "def f(\n    a,\n    b\n):\n    x = 0\n", "@d\ndef f(a):\n    x = 0\n", "def f(): pass\n", "def f(a):\n    'doc'; y = 2\n    x = 0;\n", "def f():\n    exit()\n    x = 0\n", "@d\n",
          "def f(self):\n    try:\n        a\n    except* E:\n        for b in c: pass\n    x = 0\n", "def f():\n    def g():\n        pass\n    x = 0\n", "class A:\n    def f(self):\n        x = 0\n", "if a:\n    def f():\n        x = 0\nelse:\n    x = 0\n", "def f():\n    x = (1,\n    2)\n    x = 0\n",
          "def f():\n    x = 0 \\\n    + 1\n    x = 0\n", "def f(a):\n    match x:\n        case 1:\n            y\n    x = 0\n", "def if(a):\n    x = 0\n", "def f(é):\n\n    # é\n    'doc é'\n    x = 'é'; z = 1\n    x = 0\n", 's = """\ndef f(a):\n    x = 0\n"""\n', "def f():\n    '''\n    x = 0\n    '''\n    x = 0\n", "def f():\n    if a:\n        x\n    elif b:\n        y\n    else:\n        z\n"]


def test_known_parts_give_the_rows_of_a_fresh_parse():
    random, known, fresh, before = Random(1), Rows(), [], 0
    for k in range(3000):
        lines = "".join(random.choices(PIECES, k=random.randrange(1, 4))).replace("def f(", f"def f{k % 9}(").splitlines(keepends=True)
        for _ in range(random.choice((0, 0, 1, 2))):
            lines.insert(random.randrange(len(lines)), lines.pop(random.randrange(len(lines))))
        rows = Rows()
        parse(str(k), "".join(lines), rows)
        fresh += rows.batch().to_pylist()
        parse(str(k), "".join(lines), known)
    assert known.batch().to_pylist() == fresh
    for r in fresh:
        body = [s for s in r["statements"] if not s["in_star"]]
        deepest = max((s["depth"] for s in body), default=0)
        place = next(((s["lineno"], s["col"]) for s in body if s["depth"] == deepest), None) if deepest else (r["lineno"], r["col"])
        own = [s for s in r["statements"] if s["is_top"] and not s["is_docstring"]]
        lines = {x for s in own for x in range(s["lineno"], (s["lineno"] if s["is_scope"] else s["end_lineno"]) + 1)}
        if r["error"] is None:
            assert (r["max_depth"], (r["depth_line"], r["depth_col"]), r["sloc"], r["n_statements"], r["n_top_statements"]) == (deepest, place, len(lines), len(r["statements"]), sum(s["is_top"] for s in r["statements"]))
    assert 500 < sum(r["error"] is not None for r in fresh) < len(fresh) - 2000


def test_files_of_known_parts_are_not_parsed_again(monkeypatch):
    texts, real, rows = [], ast.parse, Rows(statements=False)
    monkeypatch.setattr(ast, "parse", lambda text: texts.append(text) or real(text))
    for k in range(1000):
        parse("p", f"def f{k}({', '.join('abc'[: k % 3])}):\n    # note\n" + "    x = 0\n" * (k % 7 + 1) + f"    if a == {k % 5}:\n        y\n", rows)
    assert len(texts) < 50 and len(rows.told) == 1000 and len(rows.parts.counted) < 9 * 50


def test_filters_on_tags_count_nothing_again(spark):
    from codegrove.plans.queries import QUERIES

    for name in ("q_god_function", "q_spoken_summary", "q_tags", "q_statements"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "aggregate(" not in plan and "statements:" not in plan and "explode(statements" not in plan


def walk(f):
    """Depth, line, SLOC and branches by plain recursion, as a second opinion."""
    best, count, lines = [0, f.lineno], [0], set()

    def blocks(s):
        if isinstance(s, ast.Match):
            return [(c.body, 1) for c in s.cases]
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.TryStar)):
            return []
        out = [(getattr(s, "body", []), 1)] + [(h.body, 1) for h in getattr(s, "handlers", [])]
        rest = getattr(s, "orelse", [])
        flat = isinstance(s, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If)
        return out + [(rest, 0 if flat else 1), (getattr(s, "finalbody", []), 1)]

    def depth(body, d):
        for s in body:
            if d > best[0]:
                best[:] = [d, s.lineno]
            for b, step in blocks(s):
                depth(b, d + step)

    def branch(body):
        for s in body:
            if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While)):
                count[0] += 1
            if isinstance(s, ast.Try):
                count[0] += len(s.handlers)
            if isinstance(s, ast.Match):
                count[0] += len(s.cases)
            if isinstance(s, ast.TryStar):
                for b in (s.body, s.orelse, s.finalbody):
                    branch(b)
            for b, _ in blocks(s):
                branch(b)

    depth(f.body, 0)
    branch(f.body)
    for i, s in enumerate(f.body):
        if i == 0 and isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            continue
        lines.update([s.lineno] if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else range(s.lineno, s.end_lineno + 1))
    return best[0], best[1], len(lines), count[0]


def test_standard_library_against_plain_recursion(spark):
    root = Path(ast.__file__).parent
    files = sorted(p for p in root.glob("*.py"))[:80] + sorted((root / "asyncio").glob("*.py"))
    c = Corpus(spark.createDataFrame([(str(p), p.read_bytes()) for p in files], "path string, content binary").repartition(8))
    got = {(r.path, r.fn_ord): (r.max_depth, r.depth_line, r.sloc, r.branches) for r in c.metrics().collect()}
    want = {}
    for p in files:
        found = []

        def discover_in(body):
            for s in body:
                if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    found.append(s)
                if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    discover_in(s.body)

        discover_in(ast.parse(p.read_bytes().decode()).body)
        want |= {(str(p), k): walk(f) for k, f in enumerate(found)}
    assert got == want and len(want) > 2000


def test_statements_are_rows(spark):
    rows = corpus(spark, "def f(a):\n    if a:\n        x\n", "def f(:\n", "def g(a):\n    if a:\n        x\n").statements().orderBy("path", "ord").collect()
    assert [(r.path, r.ord, r.node, r.lineno, r.depth, r.is_top) for r in rows] == [("p0", 0, "If", 2, 0, True), ("p0", 1, "Expr", 3, 1, False), ("p2", 0, "If", 2, 0, True), ("p2", 1, "Expr", 3, 1, False)]


def test_tags_thresholds_and_order(spark):
    body = "".join(f"    if a:\n        x = {i}\n" for i in range(100))
    c = corpus(spark, f"def f(a, b, c, d, e):\n{body}", "def g(self, a, b, c, d): pass\n")
    rows = c.tags().orderBy("path", "detector_ord").collect()
    assert [(r.path, r.name) for r in rows] == [("p0", "long-function"), ("p0", "god-function"), ("p0", "too-many-params")]
    assert "200 SLOC, 100 branches" in rows[1].detail and "Default threshold: 80" in rows[0].detail
    low = corpus(spark, "def g(self, a):\n    if a:\n        pass\n", thresholds=Thresholds(1, 2, 2, 1, 1)).tags()
    assert [r.name for r in low.orderBy("detector_ord").collect()] == ["deep-nesting", "long-function", "god-function", "too-many-params"]


CATALOG = """
schema_version: 1
updated: 2026-01-02
dogmas:
  - {id: b, number: 2, title: Second, status: stub, definition: D, related_tags: [too-many-params]}
  - id: a
    number: 1
    title: First
    status: filled
    v01_priority: true
    failure_cases: need_data
    success_cases: [{title: T, source_url: u}]
    counter_dogmas: [{name: N, attribution: W, thesis: H, source_url: s}]
    honest_verdict: {status: final, follow_when: [x], break_when: [y], main_signal: z}
    related_tags: [too-many-params, too-many-params]
candidates:
  - {id: c, title: Third, note: Hm, sources: [plain, {name: Q, url: w, thesis: K}]}
"""


def test_links_reports_and_speech(spark):
    c = corpus(spark, "def f(a, b, c, d, e): pass\n", "def g(): pass\n")
    rows = {r.qualified_name: r for r in c.probe(parse_catalog(CATALOG).entries(spark)).collect()}
    assert [(x.entry_id, x.entry_number) for x in rows["f"].links] == [("b", 2), ("a", 1), ("a", 1)]
    assert rows["f"].report.endswith("Catalog links:\n- [too-many-params] → §2 Second  [b]\n- [too-many-params] → §1 First  [a]\n- [too-many-params] → §1 First  [a]")
    assert "Function: f (lines 1-1, 1 total)\n\nDetected tags:\n- [too-many-params] at line 1, col 0\n  Function" in rows["f"].report
    assert rows["g"].report.count("Catalog links") == 0 and rows["g"].spoken == "No tags detected. Trust score unknown." and rows["g"].trust_score is None
    assert rows["f"].spoken == "One tag found: too many params. Trust score unknown."
    assert c.probe(None).where("qualified_name = 'f'").first().report.endswith("Catalog links: none — no catalog dogma claims these tags yet.")
    said = spark.createDataFrame([(["x-y"] * 11,)], "n array<string>").select(links.spoken_summary(F.col("n")).alias("s")).first().s
    assert said.startswith("11 tags found: x y, ")


def test_catalog_is_clean_and_renders(spark):
    catalog = parse_catalog(CATALOG)
    entries = catalog.entries(spark)
    assert validator.validate(entries).collect() == [] and not validator.has_errors(validator.validate(entries))
    text = renderer.render(entries, catalog.updated).first().markdown
    first = "## §1. First 🎯  \\[filled\\]\n\n**Failure cases.**\n\n- _need_data_\n\n**Success cases.**\n\n- [T](u)\n\n**Контр-догмы.**\n\n- **N** — _W_ ([source](s))\n  > H\n\n**Honest verdict** \\[final\\].\n\n_Следуй догме, когда:_\n\n- x\n\n_Ломай догму, когда:_\n\n- y\n\n**Main signal:** z\n\n**Related tags:** `too-many-params`, `too-many-params`.\n\n## §2. Second  \\[stub\\]\n\n**Определение.** D\n\n"
    assert first in text and "### Third  \\[c\\]\n\nHm\n\n**Источники.**\n\n- plain\n- [Q](w) — K\n" in text
    assert "_Обновлено: 2026-01-02 — schema v1._" in text and text.endswith("\n") and not text.endswith("\n\n")


BROKEN = """
schema_version: 1
dogmas:
  - {id: a, number: 1, title: A, status: stub, v01_priority: true, counter_dogmas: [{name: n}, text], failure_cases: '', success_cases: [{summary: s}, x]}
  - {id: a, number: 1, title: B, status: draft, failure_cases: 5, success_cases: [], honest_verdict: {status: final, follow_when: [' '], main_signal: m}}
  - {id: c, number: 4, title: C, status: draft, failure_cases: null}
candidates: [{id: c, title: C}]
"""


def test_every_rule_fires(spark):
    rows = [(r.rule, r.severity, r.entity, r.message) for r in validator.validate(parse_catalog(BROKEN).entries(spark)).collect()]
    assert [(r, s, e) for r, s, e, _ in rows] == [(1, "error", "dogma:a")] * 2 + [(2, "error", "dogma:a")] * 2 + [(2, "warning", "dogma:a") if "title`" in m else (2, "error", "dogma:a") for r, _, _, m in rows if r == 2][2:] + [(3, "error", "catalog")] * 2 + [(4, "error", "catalog")] * 2 + [(5, "error", "dogma:a"), (6, "error", "dogma:a")]
    text = "\n".join(m for *_, m in rows)
    for part in ("failure_cases: unknown marker ''.", "expected str marker or list, got int", "success_cases[1] must be a mapping", "success_cases[0] is missing `title`", "id 'a' reused across entries: dogma §1, dogma §1", "id 'c' reused across entries: dogma §4, candidate", "number §1 reused: ['a', 'a']", "Got [1, 4]. Missing: [2]. Extra/out-of-range: [4].", "['follow_when', 'break_when']"):
        assert part in text, part


@pytest.mark.parametrize("text, part", [("- 1", "mapping"), ("schema_version: 9", "v1"), ("a: [", "parse error"), ("schema_version: 1\ndogmas: [{id: x}]", "x lacks number, title, status"), ("schema_version: 1\ncandidates: [{id: x}, text]", "x lacks title; candidate number 2"), ("schema_version: 1\ndogmas: [{id: x, number: n, title: t, status: s}]", "integer"), ("schema_version: 1\ndogmas: [{id: x, number: 1, title: t, status: s, related_tags: ab}]", "list")])
def test_unusable_catalogs(text, part):
    with pytest.raises(CatalogError, match=part):
        parse_catalog(text)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda name: spark)
    monkeypatch.chdir(tmp_path)
    source, bad, catalog = tmp_path / "m.py", tmp_path / "bad.py", tmp_path / "catalog" / "dogmas.yaml"
    catalog.parent.mkdir()
    catalog.write_text(CATALOG)
    source.write_text(NAMES)
    bad.write_text("def f(:\n")
    assert discover() == catalog.resolve()
    assert cli.main(["probe", str(source)]) == 0 and "Methods:\n- B.c (line 3)" in capsys.readouterr().out
    assert cli.main(["probe", str(source), "-f", "B.c"]) == 0 and "=== Function Probe ===" in capsys.readouterr().out
    assert cli.main(["probe", str(source), "-f", "c"]) == 1 and "- B.c  [method]  (line 3)" in capsys.readouterr().err
    assert cli.main(["probe", str(bad)]) == 2 and "Parse error" in capsys.readouterr().err
    assert cli.main(["dogmas", "--no-stubs", "--include-candidates"]) == 0
    assert capsys.readouterr().out == "=== Dogma catalog (schema v1) ===\n§1. First [filled] 🎯\n\nCandidates (not yet full dogmas):\n- Third  [c]\n"
    assert cli.main(["validate-catalog"]) == 0 and "OK: catalog clean (2 dogmas, 1 candidates). 6/6 rules pass." in capsys.readouterr().out
    assert cli.main(["render-catalog", "--check"]) == 1
    assert cli.main(["render-catalog", "-o", "DOGMAS.md"]) == 0 and cli.main(["render-catalog", "--check"]) == 0
    Path("DOGMAS.md").write_text("other")
    assert cli.main(["render-catalog", "--check"]) == 1
    catalog.write_text(BROKEN)
    capsys.readouterr()
    assert cli.main(["validate-catalog"]) == 1 and "  [rule 2] warning  dogma:a: " in capsys.readouterr().out
    with pytest.raises(SystemExit) as usage:
        cli.main(["dogmas", "--catalog", "none.yaml"])
    assert usage.value.code == 2


def test_more_of_the_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda name: spark)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "m.py").write_text("def f(a, b, c, d, e): pass\ndef f(): pass\ndef g(): pass\n")
    (tmp_path / "c.yaml").write_text(CATALOG)
    (tmp_path / "t.yaml").write_text("banner: ''\ntitle: '# Own'\nfooter: |\n  The\n  end\n")
    probe = ["probe", "m.py", "-f", "f"]
    # no catalog anywhere: a note, and a report without links
    assert cli.main(probe) == 0
    plain = capsys.readouterr()
    assert "no catalog links" in plain.err and "Catalog links: none" in plain.out and "lines 1-1" in plain.out
    said = []
    monkeypatch.setattr(voice, "speak", lambda text: bool(said.append(text)))
    assert cli.main([*probe, "--speak"]) == 0 and capsys.readouterr().out == plain.out
    assert said == ["One tag found: too many params. Trust score unknown."]
    monkeypatch.undo()
    monkeypatch.setattr(cli, "local_session", lambda name: spark)
    monkeypatch.chdir(tmp_path)
    broken = voice.Program("no-such-program")
    monkeypatch.setattr(voice.Program, "usable", lambda self, platform: True)
    monkeypatch.setattr(voice.subprocess, "run", lambda *a, **b: (_ for _ in ()).throw(OSError()))
    assert not voice.speak("x", (broken,)) and cli.main([*probe, "--speak"]) == 0 and capsys.readouterr().out == plain.out
    assert cli.main(["--pretty", *probe, "--catalog", "c.yaml"]) == 0
    pretty = capsys.readouterr().out
    assert "Function Probe" in pretty and "│ too-many-params │ L1:0" in pretty and "│ too-many-params │ dogma │ §2 Second" in pretty
    assert cli.main(["--pretty", "probe", "m.py", "-f", "g", "--catalog", "c.yaml"]) == 0 and "No tag was raised" in capsys.readouterr().out
    assert cli.main(["render-catalog", "--catalog", "c.yaml", "--template", "t.yaml", "-o", "o.md"]) == 0
    text = (tmp_path / "o.md").read_text()
    assert text.startswith("# Own\n\n_Обновлено") and text.endswith("\n\nThe\nend\n")
    capsys.readouterr()
    assert cli.main(["render-catalog", "--catalog", "c.yaml", "--check", "-o", "o.md"]) == 1 and "stale: " in capsys.readouterr().err
    assert cli.main(["render-catalog", "--catalog", "c.yaml", "--template", "t.yaml", "--check", "-o", "o.md"]) == 0
    assert cli.main(["render-catalog", "--catalog", "c.yaml", "--check", "-o", "none.md"]) == 1
    (tmp_path / "c.yaml").write_text("- 1")
    assert cli.main([*probe, "--catalog", "c.yaml"]) == 1 and "mapping" in capsys.readouterr().err
    with pytest.raises(SystemExit) as stopped:
        cli.main(["--version"])
    assert stopped.value.code == 0 and cli.VERSION in capsys.readouterr().out


def test_module_run():
    import subprocess

    out = subprocess.run([sys.executable, "-m", "codegrove", "--help"], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and "probe" in out.stdout and "validate-catalog" in out.stdout


def test_files_and_catalogs_are_scanned(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text(NAMES)
    (tmp_path / "b.py").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_text("def no(): pass")
    c = Corpus.of_files(spark, str(tmp_path))
    assert c.functions().count() == 5 and [r.path.rpartition("/")[2] for r in c.errors().collect()] == ["b.py"]
    assert [r.lineno for r in c.probe_function("a").collect()] == [1] and c.probe_function("nobody").count() == 0
    for name, text in (("one", CATALOG), ("two", CATALOG.replace("id: b", "id: a")), ("empty", "schema_version: 1"), ("bad", "a: [")):
        (tmp_path / f"{name}.yaml").write_text(text)
    (tmp_path / "bytes.yaml").write_bytes(b"\xff")
    entries, problems = scan_catalogs(spark, str(tmp_path))
    assert entries.count() == 6 and {r.catalog.rpartition("/")[2] for r in problems.collect()} == {"bad.yaml", "bytes.yaml"}
    assert [(r.catalog.rpartition("/")[2], r.rule) for r in validator.validate(entries).collect()] == [("two.yaml", 3)]
    assert renderer.render(entries).count() == 2


def test_unlinked_tags_are_not_dealt_out_by_name(spark):
    from codegrove.plans.queries import QUERIES

    plan = QUERIES["q_unlinked_tags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_written_files_are_one_for_each_key(spark, tmp_path, monkeypatch):
    from codegrove.plans import generated, queries

    rows = spark.range(300).selectExpr("id AS k", "concat('def f', id, '(): pass\\n# é\\n') AS content").repartition(3)
    path = generated.written(rows.union(rows.limit(0)).union(spark.createDataFrame([(7, "def g(): pass\n")], "k long, content string")), "test")
    files = {p.name: p for p in Path(generated.local_path(spark, path)).glob("*/*")}
    assert set(files) == {f"k={k}.txt" for k in range(300)} and sorted(files["k=7.txt"].read_text().splitlines()) == ["# é", "def f7(): pass", "def g(): pass"]
    assert Corpus.of_files(spark, path, "*.txt").functions().count() == 301
    here, there = [], queries.QUERIES["q_file_scan"](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(generated, "local_path", lambda spark, path: here.append(path))
    assert sorted(queries.QUERIES["q_file_scan"](spark, "/root/testdata/sf0.001").collect()) == sorted(there) and here and len({r.k for r in there}) == 10


def test_too_many_entries_of_a_tag_are_refused(spark, monkeypatch):
    monkeypatch.setattr(links, "MAX_LINKS", 1)
    with pytest.raises(Exception, match="too many catalog entries"):
        corpus(spark, "def f(a, b, c, d, e): pass\n").probe(parse_catalog(CATALOG).entries(spark)).collect()


def test_speech_never_raises(monkeypatch, caplog):
    said = []

    class Speaker:
        name = "speaker"

        def usable(self, platform):
            return True

        def say(self, text):
            said.append(text)

    assert voice.speak("hi", (Speaker(),)) and said == ["hi"] and not any(voice.speak(x, (Speaker(),)) for x in (" \n", "", None))
    voice.ONCE.forget()
    monkeypatch.setattr(voice.shutil, "which", lambda p: None)
    assert not voice.speak("x") and not voice.speak("y") and len(caplog.records) == 1 and "espeak-ng" in caplog.text
    assert voice.backend("darwin") is None or isinstance(voice.backend("darwin"), voice.Library)
    monkeypatch.setattr(voice.shutil, "which", lambda p: p)
    assert [voice.backend(p).name for p in ("darwin", "linux")] == ["say", "espeak-ng"] and voice.backend("win32").name in ("pyttsx3", "espeak-ng")
    monkeypatch.setattr(voice.subprocess, "run", lambda *a, **b: (_ for _ in ()).throw(OSError()))
    assert not voice.speak("x", (voice.Program("say"),)) and not voice.speak("x", (voice.Library("json"),)) and len(caplog.records) == 3
    monkeypatch.setattr(voice.subprocess, "run", lambda *a, **b: None)
    assert voice.speak("x", (voice.Program("say"),)) and not voice.Library("no.such.module").usable("linux")


def test_streamed_folder(spark, tmp_path):
    from codegrove.streaming.watch import write_tags

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("def f(a, b, c, d, e): pass\n")
    write_tags(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["too-many-params"]


def test_documents_that_are_python_are_counted_as_prose(spark, tmp_path):
    import duckdb

    from codegrove.plans.queries import ORACLE, QUERIES

    texts = ["Ofreeswhwh### nt%%% erblean%%%", "x = 1\n", "", None, "two words", '"""', "a)", "(", "\ufeff", "def f(): pass\n"]
    rows = [(k, text, lang) for k, text in enumerate(texts) for lang in ("en", "a/b", "", None)] + [(None, "x", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = set(db.sql(ORACLE["q_parse_errors"]).fetchall())
    assert {tuple(r) for r in QUERIES["q_parse_errors"](spark, str(tmp_path)).collect()} == want and len(want) == 4


def test_entry_points(spark):
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
