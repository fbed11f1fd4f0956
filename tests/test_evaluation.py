"""Cases to verdicts, load-mode calibration, schemas, estimators, fingerprints, baselines."""

import hashlib
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import estimator, globs
from siltstone.operators import fingerprint, loadmode, manifest, pack, report, schema_check
from siltstone.plans import evaluation
from siltstone.sources import files, fixtures

SUM = "sha256:" + "0" * 64
GOOD = f"name: one\ntask: Fix it\nbudget: 200000\nmodel: claude-x\nrepo_fingerprint: {SUM}\n"


def test_cases_are_read_strictly():
    got = fixtures.case(GOOD + "expected:\n  selections:\n    - path: ./a\\b.go\n      load_mode: full\n    - path: c\n  forbidden: [{path: x/**}]\n  gaps: [{type: missing_spec}]\nagent_check: {command: go test, timeout: 1m30s}\n")
    assert got[:8] == ("one", "Fix it", None, 200000, "claude-x", SUM, "go test", 90.0)
    assert got[8:] == ([{"path": "a/b.go", "load_mode": "full"}, {"path": "c", "load_mode": None}], [{"pattern": "x/**", "regex": globs.forbidden("x/**")}], ["missing_spec"])
    for bad, why in [
        ("", "empty"), (GOOD + "more: 1", "unknown keys"), (GOOD.replace("name: one", "name: ' '"), "name"), (GOOD + "task_file: x", "exactly one"), (GOOD.replace("task: Fix it\n", ""), "exactly one"), (GOOD.replace("Fix it", "' '"), "empty"),
        (GOOD.replace("200000", "0"), "budget"), (GOOD.replace("200000", "many"), "type"), (GOOD.replace("claude-x", "''"), "model"), (GOOD.replace(SUM, "abc"), "repo_fingerprint"), (GOOD + "expected: {selections: [{load_mode: full}]}", "path is required"),
        (GOOD + "expected: {gaps: [{type: ''}]}", "type is required"), (GOOD + "expected: {other: []}", "unknown keys"), (GOOD + "agent_check: {command: x, timeout: 30}", "duration"), (GOOD + "agent_check: {command: x, timeout: 0s}", "> 0"), (GOOD + "agent_check: {timeout: 1s}", "command"), ("a: [", "yaml"),
    ]:
        with pytest.raises(ValueError, match=why):
            fixtures.case(bad)


def tree_sum(root):
    state = hashlib.sha256(b"fixture-fingerprint-v1\0")
    held = {unicodedata.normalize("NFC", p.relative_to(root).as_posix()): p for p in root.rglob("*") if p.is_file()}
    for name in sorted(held, key=lambda n: n.encode()):
        state.update(name.encode() + b"\0" + hashlib.sha256(held[name].read_bytes()).hexdigest().encode() + b"\0")
    return "sha256:" + state.hexdigest()


def test_fingerprints_of_trees(spark, tmp_path):
    root = tmp_path / "r"
    for name in ("b/x.go", "b.go", ".hidden/z", "vendor/v", unicodedata.normalize("NFD", "é.txt"), "big"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * 3 + b"\0")
    assert files.tree_fingerprint(spark, str(root)) == tree_sum(root)
    files.verify_tree(spark, str(root), tree_sum(root))
    with pytest.raises(ValueError, match="expected"):
        files.verify_tree(spark, str(root), SUM)
    os.symlink(root / "big", root / "link")
    for place in (root, tmp_path / "nowhere"):
        with pytest.raises(files.NotPlain):
            files.tree_fingerprint(spark, str(place))
    rows = spark.createDataFrame([(k, i, "x" * i) for k in ("a", None, "b") for i in range(50)], "k string, i int, t string").repartition(7)
    got = {r.k: (r.fingerprint, r.n) for r in fingerprint.chained(rows, "k", ["i"], F.col("t"), b"<", b",", b">").collect()}
    assert got == dict.fromkeys(("a", None, "b"), (hashlib.sha256(("<" + ",".join("x" * i for i in range(50)) + ">").encode()).hexdigest(), 50))


CASES = {
    "mentioned": ("Fix NewProvider in auth/provider.go, `auth`", {"auth/provider.go": "package auth\n\nfunc NewProvider() {}\n", "auth/other.go": "package auth\n", "go.mod": "module m\n"}, "  selections: [{path: auth/provider.go, load_mode: full}]\n"),
    "failing": ("Fix NewProvider in auth/provider.go, `auth`", {"auth/provider.go": "package auth\n\nfunc NewProvider() {}\n"}, "  selections: [{path: auth/absent.go}]\n  forbidden: [{path: auth/**}]\n  gaps: [{type: missing_spec}, {type: missing_tests}]\n"),
    "changed": ("Fix it", {"a.go": "package a\n"}, "  selections: [{path: a.go}]\n"),
}


def test_from_cases_to_a_verdict(spark, tmp_path):
    folder = tmp_path / "cases"
    for name, (task, held, expected) in CASES.items():
        for path, text in held.items():
            (folder / name / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
            (folder / name / "repo" / path).write_text(text)
        (folder / name / "repo" / "task.md").write_text(task)
        digest = tree_sum(folder / name / "repo") if name != "changed" else SUM
        how = "task_file: task.md" if name == "mentioned" else f"task: '{task}'"
        (folder / name / f"{name}.eval.yaml").write_text(f"name: {name}\n{how}\nbudget: 200000\nmodel: claude-x\nrepo_fingerprint: {digest}\nexpected:\n{expected}")
    # what lies in a case's repository is no case
    (folder / "changed" / "repo" / "x.eval.yaml").write_text("broken: [")
    first = evaluation.run(spark, str(folder), str(tmp_path / "baseline"))
    got = {r.name: r for r in first.results.collect()}
    assert (got["mentioned"].precision, got["mentioned"].recall, got["mentioned"].f1) == (1, 1, 1) and got["mentioned"].failures == []
    assert (got["failing"].f1, got["changed"].precision, got["changed"].recall) == (0, 1, 0)
    assert got["failing"].failures == ["expected gap missing_spec not present", "forbidden path auth/provider.go appears in selections at score >= 0.30"]
    assert "expected " + SUM in got["changed"].failures[0]
    assert not first.verdict.first().passed and first.verdict.first().failed == 2
    report.write_baseline(first.metrics, str(tmp_path / "baseline"), "sel", "now")
    held = report.load_baseline(spark, str(tmp_path / "baseline"))
    assert held.count() == 3 and report.load_baseline(spark, str(tmp_path / "none")) is None
    worse = first.metrics.withColumn("f1", F.lit(0.0))
    with pytest.raises(ValueError, match="would fall: mentioned"):
        report.write_baseline(worse, str(tmp_path / "baseline"), "sel", "now")
    report.write_baseline(worse, str(tmp_path / "baseline"), "sel", "now", force=True)
    assert report.load_baseline(spark, str(tmp_path / "baseline")).where("f1 = 0").count() == 3
    a, b = (report.as_json(first.results, "f", "b", 0.02, "sel", {"at": t}).select("json", report.json_without_per_run(F.col("json")).alias("bare")).first() for t in ("1", "2"))
    assert a.json != b.json and a.bare == b.bare and a.bare.endswith("]}")
    (folder / "changed" / "changed.eval.yaml").write_text("name: mentioned")
    with pytest.raises(ValueError, match="changed.eval.yaml: exactly one"):
        fixtures.load(spark, str(folder))
    with pytest.raises(ValueError, match="escapes"):
        fixtures.task_text(spark, str(folder / "mentioned"), None, "../x.md")


def test_both_plans_and_their_report(spark):
    """A mentioned file below the best band is summarised in A and whole in B."""
    rows = [("t", "a.go", 0.70, True, 4000, 1500, 40, 60), ("t", "b.go", 0.90, False, 4000, 1500, 50, 60), ("t", "c.go", 0.2, False, 10, 40, 40, 40), ("u", "a.go", 0.9, False, 100, 61, 60, 60)]
    cand = spark.createDataFrame([(*r, "go", 2, []) for r in rows], "task_id string, path string, score double, mentioned boolean, size_bytes bigint, cost_full bigint, cost_structural bigint, cost_behavioral bigint, language string, n_symbols int, side_effects array<string>")
    eligible = pack.with_eligibility(cand)
    budgets = spark.createDataFrame([("t", 1600), ("u", 100)], "task_id string, budget bigint")
    both, overflow = loadmode.packed(eligible, budgets)
    modes = {p: {(r.task_id, r.path): r.load_mode for r in loadmode.of_plan(both, p).collect()} for p in "AB"}
    alone = {p: {(r.task_id, r.path): r.load_mode for r in pack.assignments(eligible, chosen).collect()} for p, chosen in (("A", pack.greedy(pack.mode_rows(eligible), budgets)), ("B", pack.forced_full(pack.mode_rows(eligible), budgets)[0]))}
    assert modes == alone and modes["A"]["t", "a.go"] == "structural_summary" and modes["B"]["t", "a.go"] == "full"
    assert {r.task_id: r.overflow for r in overflow.collect()} == {"t": 1400, "u": 0}
    gaps = spark.createDataFrame([("tA", "x"), ("tA", "y"), ("tB", "y"), ("tB", "z"), ("uA", "y"), ("uB", "y")], "task_id string, type string")
    feasible = spark.createDataFrame([("tA", 0.5), ("tB", 0.25), ("uA", 0.5), ("uB", 0.5)], "task_id string, score double")
    found = loadmode.report(loadmode.Variants(both, gaps, feasible, overflow))
    got = {r.task_id: r for r in found.collect()}
    assert [tuple(d) for d in got["t"].demoted_in_a] == [("a.go", 0.7, 40), ("b.go", 0.9, 50)] and (got["t"].gaps_a_only, got["t"].gaps_b_only) == (["x"], ["z"])
    assert (got["t"].tokens_gained, got["t"].feasibility_delta, got["t"].overflow_tokens, got["t"].would_underflow) == (3000 - 90, -0.25, 1400, True)
    assert got["u"].demoted_in_a == [] and not got["u"].would_underflow and got["u"].gaps_a_only == []
    text = loadmode.markdown(found, spark.createDataFrame([("t", False, True)], "task_id string, a_passed boolean, b_passed boolean"))
    one = {r.task_id: r.markdown for r in text.collect()}
    assert "- Feasibility delta: -0.2500\n" in one["t"] and "  - `a.go` (score=0.7000, tokens=40)\n" in one["t"] and "- Delta: **IMPROVEMENT**" in one["t"] and "Delta: **" not in one["u"]
    whole = loadmode.document(text, None, {"host": "h"}).first().markdown
    assert whole.index("### t") < whole.index("### u") < whole.index("- host: h")


def test_schemas_name_what_fails(spark):
    schema = schema_check.of(id={"type": "string", "pattern": "^a"}, n={"type": "integer", "minimum": 1, "maximum": 3}, note={"type": ["string", "null"]}, items={"type": "array", "items": schema_check.of(k={"type": "string", "enum": ["x", "y"]})}, tiers={"type": "object", "additionalProperties": {"type": "string", "const": "t"}})
    kind = "v struct<id:string,n:int,note:string,items:array<struct<k:string>>,tiers:map<string,string>>"
    rows = [(("a1", 2, None, [("x",)], {"go": "t"}),), (("b", 0, "s", [("y",), ("z",), None], {"go": "u"}),), ((None, None, None, None, None),), (None,)]
    got = [r.violations for r in schema_check.violations(spark.createDataFrame(rows, kind), "v", schema).collect()]
    assert got == [[], ["$.id", "$.n", "$.items[1].k", "$.items[2]", "$.tiers.go"], ["$.id", "$.n", "$.items", "$.tiers"], ["$"]]
    wrong = spark.createDataFrame([(("x", 1.5, 1),)], "v struct<id:string,n:double,other:int>")
    assert [r.violations for r in schema_check.violations(wrong, "v", schema).collect()] == [["$.note", "$.items", "$.tiers", "$.other", "$.id", "$.n"]]


def test_incomplete_plans_come_first(spark):
    kind = "task_id string, manifest struct<incomplete:boolean,gaps:array<struct<id:string,type:string,severity:string,description:string,suggested_remediation:array<string>>>,feasibility:struct<score:double>>"
    gap = [("gap-1", "x", "blocking", "", [])]
    rows = spark.createDataFrame([("a", (True, gap, (0.1,))), ("b", (False, gap, (0.1,))), ("c", (False, [], (0.1,))), ("d", (False, None, (0.9,)))], kind)
    assert [r.exit_code for r in manifest.gates(rows, True, 0.3).orderBy("task_id").collect()] == [9, 8, 7, 0]
    assert [r.exit_code for r in manifest.gates(rows).orderBy("task_id").collect()] == [9, 0, 0, 0]


def test_escapes_in_patterns(spark):
    cases = {("a\\*b", "a*b"): True, ("a\\*b", "a\\xb"): False, ("a\\*b", "axb"): False, ("[\\]a]", "]"): True, ("[a\\-c]x", "bx"): False, ("[a\\-c]x", "-x"): True, ("[^a]b", "cb"): True, ("[^a]b", "ab"): False, ("x[\\d]", "x5"): False, ("x[\\d]", "xd"): True, ("a\\", "a"): False, ("[[a]", "["): True, ("[a", "[a"): False, ("[]a]", "]"): True, ("[a&&b]", "&"): True, ("[!a]", "a"): True}
    for (pattern, path), want in cases.items():
        assert spark.createDataFrame([(path,)], "p string").select(globs.any_of(F.col("p"), [pattern])).first()[0] is want, (pattern, path)


def test_models_decide_how_tokens_are_counted(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    table = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert estimator.resolve("") == estimator.resolve("claude-9") == estimator.resolve("other") == estimator.Estimator()
    for model in ("GPT-4o-mini", "o3-x", "codex-1", " gpt-4 "):
        with pytest.raises(estimator.NoTable):
            estimator.resolve(model)
    texts = ["", "Hello world, it's 12345 o'clock!\n\n  x", "déjà vu 日本語 😀", "func main() {\n\treturn nil\n}\n", "a" * 300, " " * 50 + "end", "HTTPServer's don't WE'LL"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for encoding, model in (("p50k_base", "codex-1"), ("cl100k_base", "gpt-4"), ("o200k_base", "gpt-4o")):
        held = estimator.resolve(model, {encoding: table})
        assert (held.identity, held.version) == (f"tiktoken:{encoding}", encoding)
        library = tiktoken.Encoding("x", pat_str=estimator.PATTERNS[encoding], mergeable_ranks=estimator.ranks(table), special_tokens={})
        assert {r.i: r.n for r in rows.select("i", held.tokens(F.col("t")).alias("n")).collect()} == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    config = Config.of({"model": "gpt-4", "token_tables": {"cl100k_base": table}})
    assert config.estimator().table == table and config.digest() == Config.of({"model": "gpt-4"}).digest()
    assert spark.range(1).select(estimator.Estimator().tokens(F.lit("é" * 7))).first()[0] == 4
