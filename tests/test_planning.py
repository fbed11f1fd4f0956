"""Planning operators on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import globs, paths, text
from siltstone.operators import diff, evaluate, feasibility, index, manifest, pack, report, rules, score, tasks
from siltstone.operators import terms as term_search
from siltstone.plans import registry


def parsed(spark, *texts):
    rows = spark.createDataFrame([(f"t{i}", x, True) for i, x in enumerate(texts)], "task_id string, raw_text string, markdown boolean")
    return tasks.parse(rows)


def test_task_types_in_order(spark):
    got = {r.task_id: r.type for r in parsed(spark, "Fix and add docs", "add tests for x", "update the readme", "migrate it", "split it", "look into it", "support y", "éfix it", None).collect()}
    assert [got[f"t{i}"] for i in range(9)] == ["bugfix", "test-addition", "documentation", "migration", "refactor", "investigation", "feature", "bugfix", "unknown"]


def test_anchors(spark):
    row = parsed(spark, "Use `db` and `` in App.tsx with RefreshToken, see internal/x.go \\`no`").first()
    assert row.anchors == sorted({"db", "Use", "App", "RefreshToken", "refreshtoken", "App.ts", "internal/x.go", "internal"})
    assert row.expects_config and not row.expects_api


def test_objective_is_first_line_with_text(spark):
    assert parsed(spark, "\n \n\t Do it \nnow").first().objective == "Do it"


@pytest.mark.parametrize(
    "dialect, pattern, hits, misses",
    [
        (globs.ignore, "node_modules/**", ["node_modules", "node_modules/a/b.js"], ["pkg/node_modules/a"]),
        (globs.ignore, "*.lock", ["a.lock", "x/y.lock"], ["a.locks"]),
        (globs.ignore, "a/**/b/**", [], ["a/x/b/y"]),
        (globs.supplemental, "docs/adr/**/*.md", ["docs/adr/x.md", "docs/adr/a/b.md", "docs/adr-old/x.md"], ["docs/x.md", "a/docs/adr/x.md"]),
        (globs.supplemental, "README", ["readme", "sub/readme"], ["readme.md"]),
        (globs.forbidden, "a/**", ["a", "a/b/c"], ["ab/c"]),
        (globs.forbidden, "a/**/x.go", ["a/x.go", "a/b/x.go"], ["b/x.go", "a/b/y.go"]),
        (globs.forbidden, "a/*.go", ["a/x.go"], ["a/b/x.go"]),
    ],
)
def test_globs(spark, dialect, pattern, hits, misses):
    rows = spark.createDataFrame([(p,) for p in hits + misses] + [("zz",)], "path string")
    got = {r.path for r in rows.where(globs.any_of(F.col("path"), [pattern], dialect)).collect()}
    assert got == set(hits)


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ["go.mod", "a/go.mod", "config/x.yaml", "a/x.yaml", "api/v1.yaml", "x.proto", "cmd/main.go", "README.md", "a_test.go", "b.spec.ts", "test_c.py"]], "path string")
    p = F.col("path")
    got = {r.path: r for r in rows.select("path", paths.language(p).alias("lang"), paths.config_for_score(p).alias("cs"), paths.config_for_gap(p).alias("cg"), paths.external_contract(p).alias("ec"), paths.plays_role(p).alias("role"), paths.is_test(p).alias("t"), paths.is_test_for_gap(p).alias("tg")).collect()}
    assert got["go.mod"].lang == "go" and got["cmd/main.go"].role and got["README.md"].role
    assert [got[x].cs for x in ("go.mod", "a/go.mod", "config/x.yaml", "a/x.yaml")] == [True, False, True, False]
    assert got["a/go.mod"].cg and not got["a/x.yaml"].cg
    assert got["api/v1.yaml"].ec and got["x.proto"].ec and not got["a/x.yaml"].ec
    assert got["b.spec.ts"].t and not got["b.spec.ts"].tg and got["test_c.py"].t and not got["test_c.py"].tg and got["a_test.go"].tg


def test_rounding(spark):
    row = spark.range(1).select(text.rounded(F.lit(0.00005), 4).alias("a"), text.rounded(F.lit(-2.5), 0).alias("b"), text.tokens_heuristic(F.lit(7)).alias("c"), text.tokens_heuristic(F.lit(0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (0.0001, -3.0, 2, 0)


def files_of(spark, rows):
    made = spark.createDataFrame(rows, "path string, size_bytes bigint, symbols array<string>, text string")
    return index.describe(made)


def test_worked_scores(spark):
    """One small file, all signals known by hand."""
    task = parsed(spark, "Update the Greet function in cmd/sample/main.go to include a timestamp.")
    files = files_of(spark, [("cmd/sample/main.go", 100, ["Greet", "other"], "")])
    none = spark.createDataFrame([], "path string, import string")
    row = score.score(task, files, none, spark.createDataFrame([], "path string, link string")).first()
    assert row.mention == 1 and row.package == 1 and row.filename == pytest.approx(1 / 9)
    assert row.symbol == pytest.approx(0.2) and row.dampener == 1 and row.score == pytest.approx(0.4033, abs=5e-5)


def test_mentions_need_boundaries(spark):
    task = parsed(spark, "please rerun.go now", "edit run.go, please", "look at .eslintrc here")
    files = files_of(spark, [("a/run.go", 1, [], ""), (".eslintrc", 1, [], "")])
    assert {(r.task_id, r.path) for r in score.mention(task, files).collect()} == {("t1", "a/run.go"), ("t2", ".eslintrc")}


def test_mentions_of_odd_names(spark):
    """Names that begin or end with other characters, hold no word at all or other scripts, against the definition."""
    names = ["日本.md", "x/日本", "+++", "a/++", ".env", "a~", "~a~", "b/+.go", "é", "x_y", "_", "c++/d", "(z)", "q\\\\e.go", "main.go", "cmd/main.go", "x/main.go.bak"]
    texts = ["See 日本.md and ++ now", "+++", "x++++y", "a~b ~a~ .env", "日本 + é", "use c++/d, (z)", "x.env", "_ x_y x_y_", "Q\\\\E.GO main.go!", "cmd/main.go", "x/main.go.bak", "", "日本日本 éé", "b/+.go"]
    got = {(r.task_id, r.path) for r in score.mention(parsed(spark, *texts, None), files_of(spark, [(n, 1, [], "") for n in names])).collect()}
    flanked = lambda n, t: re.search(rf"(?:^|[^a-z0-9_]){re.escape(n.lower())}(?:$|[^a-z0-9_])", t.lower())
    assert got == {(f"t{i}", n) for i, t in enumerate(texts) for n in names if flanked(n, t) or flanked(n.rsplit("/", 1)[-1], t)}
    plan = score.mention(parsed(spark, "x"), files_of(spark, [("a", 1, [], "")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "contains" not in next((x for x in plan.split("\n") if "Join" in x and "contains" in x), "")


def test_texts_that_reach_packages_and_tests(spark):
    """Text files inside of packages: the scores are those of a second pass over all pairs."""
    task = parsed(spark, "Refactor `guide` `readme` `alpha` in pkg/guide.md, `pkg`, `beta` and `gamma`")
    held = [("pkg/guide.md", 1, [], "guide readme alpha beta gamma pkg"), ("pkg/a.go", 1, ["alpha"], ""), ("use/b.go", 1, [], ""), ("pkg/guide_test.go", 1, [], "")]
    files = files_of(spark, held).withColumn("package", F.when(F.col("path").startswith("pkg/"), "pkg").otherwise("use"))
    imports = spark.createDataFrame([("use/b.go", "m/pkg")], "path string, import string")
    links = spark.createDataFrame([("pkg/guide_test.go", "pkg/guide.md")], "path string, link string")
    for settings in (score.Settings(), score.Settings({"mention": 0.2, "filename": 0.1, "symbol": 0.1, "import": 0.1, "package": 0.1, "test": 0.05, "doc": 0.3, "config": 0.05})):
        scores = score.Scores(task, files, imports, links, settings)
        assert scores.texts_reach_others()
        first = score.Scores(task, files.withColumn("text", F.lit("")), imports, links, settings).all().where("score >= 0.1")
        seen = files.join(first.select("path"), "path", "left").withColumn("text", F.when(files.path.isin([r.path for r in first.collect()]), F.col("text")).otherwise(""))
        want = score.Scores(task, seen, imports, links, settings).all().join(first.select("path"), "path", "left_semi")
        columns = ["path", *score.FACTORS, "dampener", "pass1", "score"]
        plain = lambda rows: sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rows.select(columns).collect())
        assert plain(scores.viable(0.1)) == plain(want)


def test_packing_is_linear_and_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows, want, budgets = [], set(), []
    for t, budget in (("a", 900), ("b", 10**6), ("c", 0), ("d", 37)):
        held = [(t, f"p{rng.randrange(200)}", mode, rng.randrange(1, 400), rng.randrange(9) / 10, 0.5, k) for k, mode in enumerate(("full", "structural_summary", "behavioral_summary")) for _ in range(150)]
        held = list({(r[1], r[2]): r for r in held}.values())
        left, paths = budget, set()
        for r in sorted(held, key=lambda r: (-r[4], r[3], r[1], -r[6], r[2])):
            if r[3] <= left and r[1] not in paths:
                left -= r[3]
                paths.add(r[1])
                want.add(r[:4])
        rows += held
        budgets.append((t, budget))
    rng.shuffle(rows)
    pairs = spark.createDataFrame(rows, "task_id string, path string, mode string, cost bigint, efficiency double, score double, priority int")
    monkeypatch.setattr(pack, "BLOCK", 7)
    assert {tuple(r) for r in pack.greedy(pairs, spark.createDataFrame(budgets, "task_id string, budget bigint")).collect()} == want
    many = spark.range(100_000).selectExpr("'t' AS task_id", "cast(id as string) AS path", "'full' AS mode", "50 + id % 97 AS cost", "id % 1009 / 1009 AS efficiency", "3 AS priority")
    assert pack.greedy(many, spark.createDataFrame([("t", 10**6)], "task_id string, budget bigint")).agg(F.sum("cost")).first()[0] > 10**6 - 50


def test_mentions_of_long_names(spark):
    adr = "docs/adr/0007-how-we-move-all-of-the-old-tables-to-the-new-store.md"
    twelve = "a-b-c-d-e-f-g-h-i-j-k.md"
    task = parsed(spark, f"See {adr.upper()} now", "read " + adr.rsplit("/", 1)[1], f"see {adr}x", "how we move all of the old tables to the new", f"{twelve}, please")
    files = files_of(spark, [(adr, 1, [], ""), (twelve, 1, [], ""), ("x/" + twelve, 1, [], "")])
    assert {(r.task_id, r.path) for r in score.mention(task, files).collect()} == {("t0", adr), ("t1", adr), ("t4", twelve), ("t4", "x/" + twelve)}


def test_scores_without_lexical_overlap(spark):
    """Files that only import a relevant package, only test a relevant file or only are configuration."""
    task = parsed(spark, "Refactor RefreshToken in internal/auth/provider.go, `auth`")
    files = files_of(spark, [("internal/auth/provider.go", 1, ["RefreshToken", "RefactorProvider", "AuthInternal"], ""), ("cmd/x/main.go", 1, [], ""), ("config/a.yaml", 1, [], ""), ("zz/q_test.go", 1, [], ""), ("lone.txt", 1, [], "")])
    imports = spark.createDataFrame([("cmd/x/main.go", "m/internal/auth")], "path string, import string")
    links = spark.createDataFrame([("zz/q_test.go", "internal/auth/provider.go")], "path string, link string")
    rows = score.score(task, files, imports, links)
    got = {r.path: r for r in rows.collect()}
    best = got["internal/auth/provider.go"].pass1
    assert best >= 0.5 and set(got) == {"internal/auth/provider.go", "config/a.yaml", "zz/q_test.go"} | ({"cmd/x/main.go"} if best >= 0.6 else set())
    assert got["config/a.yaml"].score == pytest.approx(0.06) and (got["zz/q_test.go"].test, got["zz/q_test.go"].score) == (1, pytest.approx(0.08))
    weights = {"mention": 0.35, "filename": 0.0, "symbol": 0.1, "import": 0.3, "package": 0.2, "test": 0.02, "doc": 0.02, "config": 0.01}
    heavy = score.Settings(weights)
    rows = score.score(task, files, imports, links, heavy)
    got = {r.path: r for r in score.everywhere(rows, task, files, heavy).collect()}
    assert got["internal/auth/provider.go"].pass1 >= 0.6 and got["cmd/x/main.go"]["import"] in (0.7, 1.0) and got["cmd/x/main.go"].score >= 0.2
    assert len(got) == 5 and (got["lone.txt"].score, got["lone.txt"].dampener) == (0, pytest.approx(0.3))


def test_imports_reach_two_steps(spark):
    files = files_of(spark, [(f"{d}/x.go", 1, [], "") for d in ("auth", "internal/auth", "b", "c")])
    imports = spark.createDataFrame([("b/x.go", "example.com/m/internal/auth"), ("c/x.go", "m/b"), ("c/x.go", "xauth")], "path string, import string")
    rows = spark.createDataFrame([("t", "internal/auth", 0.9)], "task_id string, dir string, pass1 double").withColumn("path", F.lit("internal/auth/x.go"))
    got = {r.path: r.reached for r in score.late_signals(rows, score.reachable(files, imports), spark.createDataFrame([], "path string, link string"), files).collect()}
    assert got == {"b/x.go": 1.0, "c/x.go": 0.4}


def test_links_and_supplementals(spark):
    files = files_of(spark, [(p, 1, [], "") for p in ("a/x.go", "a/x_test.go", "b/y.ts", "b/y.tsx", "b/y.test.ts", "d/w.TS", "d/w.test.js", "c/z.py", "c/test_z.py", "specs/a/SPEC.md", "AGENTS.md")])
    got = {(r.path, r.link) for r in index.test_links(files).collect()}
    assert got == {("a/x.go", "a/x_test.go"), ("a/x_test.go", "a/x.go"), ("b/y.tsx", "b/y.test.ts"), ("b/y.test.ts", "b/y.tsx"), ("d/w.TS", "d/w.test.js"), ("d/w.test.js", "d/w.TS"), ("c/z.py", "c/test_z.py"), ("c/test_z.py", "c/z.py")}
    assert {(r.category, r.path) for r in index.supplementals(files).collect()} == {("spec", "specs/a/SPEC.md"), ("agents", "AGENTS.md")}


def candidates(spark, rows):
    made = spark.createDataFrame(rows, "path string, score double, mentioned boolean, size_bytes bigint, cost_full bigint, cost_structural bigint, cost_behavioral bigint, language string, n_symbols int")
    return made.withColumns({"task_id": F.lit("t"), "side_effects": F.array().cast("array<string>")})


def test_packing_skips_what_does_not_fit_and_goes_on(spark):
    rows = [(f"f{i}.go", s, False, 100, c, c // 2, c // 3, "go", 1) for i, (s, c) in enumerate([(0.9, 300), (0.85, 900), (0.7, 500), (0.65, 100), (0.4, 10)])]
    budget = spark.createDataFrame([("t", 420)], "task_id string, budget bigint")
    want = None
    for n in (1, 3, 17):
        made = pack.with_eligibility(candidates(spark, rows).repartition(n))
        got = sorted(map(tuple, pack.greedy(pack.mode_rows(made), budget).collect()))
        want = want or got
        assert got == want
    assert sum(r[3] for r in want) <= 420 and len({r[1] for r in want}) == len(want) >= 2
    all_rows = {r.path: r for r in pack.assignments(made, pack.greedy(pack.mode_rows(made), budget)).collect()}
    assert all_rows["f4.go"].load_mode == "reachable" and all_rows["f4.go"].cost == 0


def test_equal_pairs_prefer_full(spark):
    made = pack.mode_rows(pack.with_eligibility(candidates(spark, [("a.go", 0.0, True, 10, 100, 100, 100, "go", 1)])))
    assert [r.mode for r in made.collect()] == ["full"]


def test_forced_full_overflows(spark):
    made = pack.with_eligibility(candidates(spark, [("a.go", 0.9, False, 10, 500, 50, 40, "go", 1), ("b.go", 0.7, False, 10, 500, 50, 40, "go", 1)]))
    chosen, overflow = pack.forced_full(pack.mode_rows(made), spark.createDataFrame([("t", 100)], "task_id string, budget bigint"))
    assert [(r.path, r.mode) for r in chosen.collect()] == [("a.go", "full")] and overflow.first().overflow == 400


def test_rules_fire_and_number(spark):
    task = parsed(spark, "Implement the NewThing handler for config", "Review it")
    assigned = spark.createDataFrame([("t0", "a/x.go", "full", 0.7, 5, None)], "task_id string, path string, load_mode string, score double, cost bigint, demoted_reason string")
    files = files_of(spark, [("a/x.go", 1, ["Other"], "")]).withColumn("side_effects", F.array().cast("array<string>"))
    over = spark.createDataFrame([("t0", True), ("t1", False)], "task_id string, underflow boolean")
    got = [(r.task_id, r.id, r.type, r.severity) for r in rules.gaps(task, assigned, files, index.supplementals(files), over, ("missing_tests",)).orderBy("task_id", "ordinal").collect()]
    assert got[:2] == [("t0", "gap-1", "oversized_primary_context", "blocking"), ("t0", "gap-2", "missing_spec", "warning")]
    kinds = [k for t, _, k, _ in got if t == "t0"]
    assert kinds == ["oversized_primary_context", "missing_spec", "missing_tests", "missing_config_context", "unresolved_symbol_dependency", "unresolved_symbol_dependency", "missing_runtime_path"]
    assert ("t0", "gap-3", "missing_tests", "blocking") in got and ("t1", "gap-2", "task_underspecified", "warning") in got


def test_feasibility_bounds(spark):
    task = parsed(spark, "Fix the Greet bug in a/x.go")
    assigned = spark.createDataFrame([("t0", "a/x.go", "full", 0.9, 50, None)], "task_id string, path string, load_mode string, score double, cost bigint, demoted_reason string")
    files = files_of(spark, [("a/x.go", 1, ["Greet"], "")])
    gaps = spark.createDataFrame([("t0", "blocking")], "task_id string, severity string")
    row = feasibility.compute(task, assigned, files, gaps, spark.createDataFrame([("t0", 100)], "task_id string, budget bigint")).first()
    assert row.coverage == pytest.approx(1 / 3) and row.task_specificity == 1 and row.budget_headroom == 0.5 and row.score <= 0.4


def test_metrics_edge_cases(spark):
    cases = spark.createDataFrame([("none",), ("half",), ("miss",)], "name string")
    expected = spark.createDataFrame([("half", "a", "full"), ("miss", "x", None)], "name string, path string, load_mode string")
    actual = spark.createDataFrame([("half", "a", "reachable"), ("half", "b", "full")], "name string, path string, load_mode string")
    got = {r.name: (r.precision, r.recall, round(r.f1, 4)) for r in evaluate.metrics(cases, expected, actual).collect()}
    assert got == {"none": (1, 1, 1), "half": (0.25, 0.5, 0.3333), "miss": (1, 0, 0)}


def test_terms_count_anywhere_in_the_text(spark):
    terms = spark.createDataFrame([("a", ["token", "refresh.go", "tokens"]), ("b", ["foo_bar", "é f()"]), ("c", ["aaaa"]), ("d", [])], "task_id string, terms array<string>")
    texts = {"x": "Tokens, tokenstoken; Refresh.go refreshxgo foo_barfoo_bar", "y": "aaaaaaaaaa-aaaa É F() é  f()", "z": None, "w": "retokenize/refresh.gone"}
    found = term_search.term_counts(terms, spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3), 2)
    want = {(r.task_id, p): n for r in terms.collect() if r.terms for p, t in texts.items() if (n := len(re.findall("|".join(map(re.escape, r.terms)), (t or "").lower())))}
    assert {(r.task_id, r.path): r.cnt for r in found.collect()} == want == {("a", "x"): 4, ("a", "w"): 2, ("b", "x"): 2, ("b", "y"): 1, ("c", "y"): 3}
    assert [(r.path, r["rank"]) for r in found.where("task_id = 'a'").orderBy("rank").collect()] == [("x", 1), ("w", 2)]


def test_automaton_and_settling_equal_regular_expressions(monkeypatch):
    rng = random.Random(2)
    for lane, rounds in ((256, 16), (3, 0), (5, 2)):
        monkeypatch.setattr(term_search, "LANE", lane)
        monkeypatch.setattr(term_search, "ROUNDS", rounds)
        monkeypatch.setattr(term_search, "BLOCK", 7)
        monkeypatch.setattr(term_search, "DENSE", lane)
        letters = "ab é-\n"[: rng.randrange(2, 6)]
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
        terms = [list(dict.fromkeys(word(5) for _ in range(rng.randrange(1, 6)))) for _ in range(30)]
        texts = ["", "a" * 300, *[word(60) for _ in range(40)]]
        counts = term_search.Counts(terms)
        for _ in range(2):
            got = counts.of(texts)
            assert got.tolist() == [[len(re.findall("|".join(map(re.escape, t)), x)) for t in terms] for x in texts]


def test_shards_of_tasks_give_the_same(spark, monkeypatch):
    terms = spark.createDataFrame([(i, [f"w{i}", f"w{i}{i}", "w"]) for i in range(20)], "task_id int, terms array<string>")
    texts = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(40)], "path int, text string")
    want = sorted(map(tuple, term_search.term_counts(terms, texts, 5).collect()))
    monkeypatch.setattr(term_search, "SHARD", 40)
    assert sorted(map(tuple, term_search.term_counts(terms, texts.repartition(3), 5).collect())) == want and len(want) == 100
    assert term_search.term_counts(terms.where("false"), texts, 5).count() == 0


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    assert {(r.k, r.change) for r in diff.changes(a, b, ["k"], ["v"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    row = spark.range(1).select(diff.first_difference(F.lit("a\nb\nc"), F.lit("a\nx\nc")).alias("d"), diff.version_at_least(F.lit("1"), 1, 0).alias("v"), diff.version_at_least(F.lit("x"), 1, 0).alias("w")).first()
    assert (row.d, row.v, row.w) == ("A:b -> B:x", True, False)


def test_canonical_json():
    assert manifest.canonical({"b": [1.0, -0.0, 1.2e-7], "a": "<é>"}) == '{"a":"\\u003cé\\u003e","b":[1,-0,0.00000012]}'
    assert manifest.digest({"a": 1, "generated_at": "x"}) == manifest.digest({"a": 1})


def test_config():
    assert Config().digest() == Config.of({}).digest() and re.match("sha256:[0-9a-f]{64}$", Config().digest())
    with pytest.raises(ValueError):
        Config.of({"weight": 1})
    with pytest.raises(ValueError):
        Config.of({"weights": {"mention": 1.0}}).scoring()
    assert Config.of({"budget": 50_000}).effective_budget() == 2000


@pytest.mark.parametrize("given, want", [("", None), (".", None), ("./a\\b/", "a/b"), ("a/././b", "a/b"), ("/a", ValueError), ("a/../b", ValueError), ("./", ValueError)])
def test_scopes(given, want):
    if want is ValueError:
        with pytest.raises(ValueError):
            index.scope_of(given)
    else:
        assert index.scope_of(given) == want


def test_reports(spark, tmp_path):
    now = spark.createDataFrame([("a", 1.0, 0.5, 0.6), ("b", 0.2, 0.2, 0.2), ("n", 1.0, 1.0, 1.0)], "name string, precision double, recall double, f1 double")
    before = spark.createDataFrame([("a", 0.1, 1.0, 0.6), ("b", 0.2, 0.2, 0.5), ("o", 1.0, 1.0, 1.0)], "name string, precision double, recall double, f1 double")
    report.write_baseline(before, str(tmp_path / "base"), "sel-v2", "2026-01-01T00:00:00Z")
    held = report.load_baseline(spark, str(tmp_path / "base"))
    rows = report.results(now, held, spark.createDataFrame([("a", "forbidden: x.go")], "name string, reason string"))
    assert {r.name: r.status for r in rows.collect()} == {"a": "ok", "b": "regressed", "n": "unreferenced", "o": "orphaned"}
    assert tuple(report.verdict(rows).first()) == (1, 1, 1, 1, False)
    texts = [report.markdown(rows.repartition(k), "fx", "base", 0.02, "sel-v2", {"pid": str(k)}).select("markdown", report.without_per_run(F.col("markdown")).alias("same")).first() for k in (1, 4)]
    assert texts[0].same == texts[1].same and texts[0].markdown != texts[1].markdown
    assert "- **b**: F1 0.5000 → 0.2000 (drop 0.3000, tolerance 0.0200)" in texts[0].same and "| a | 1.0000 | 0.5000 | 0.6000 | yes |" in texts[0].same and "## Orphaned baseline entries\n\n- o\n" in texts[0].same
    spark.createDataFrame([("0.9", "a")], "schema_version string, name string").write.json(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        report.load_baseline(spark, str(tmp_path / "old"))
    assert report.verdict(report.results(now, None), bootstrap=True).first().passed


def test_percentiles_of_repeated_values(spark):
    rows = spark.createDataFrame([("a", 5.0, 1), ("a", 1.0, 2), ("a", 1.0, 3), ("a", 5.0, 4), ("a", 9.0, 5), ("b", 2.0, 1)], "k string, v double, o int")
    assert {r.k: (r.cold, r.warm, r.p95) for r in evaluate.percentiles(rows, "k", "v", "o").collect()} == {"a": (5.0, 1.0, 9.0), "b": (2.0, None, 2.0)}


@pytest.mark.parametrize("name, most", [("pack_forced_full", 2), ("loadmode_ab", 2), ("diff_reachable", 0), ("diff_selections", 0)])
def test_packing_reads_its_candidates_once(spark, tmp_path, name, most):
    """Candidates and budgets are two readings of the lines; of two plans packed together, only what they choose is read again."""
    lines = spark.range(400).selectExpr("id % 4 AS l_suppkey", "id AS l_orderkey", "1 AS l_linenumber", "id % 90 AS l_partkey", "'F' AS l_linestatus", "if(id % 2 = 0, 'A', 'N') AS l_returnflag", "double(1 + id % 50) AS l_quantity", "id % 11 / 100 AS l_discount", "id % 9 / 100 AS l_tax")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_suppkey" in x for x in plan.split("\n") if "Relation [" in x) == most


def test_limits_and_forced_pairs_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(t, f"p{i}", rng.randrange(1, 90), rng.randrange(9) / 10, rng.random() < 0.1) for t in "abc" for i in range(120)]
    pairs = spark.createDataFrame(rows, "task_id string, path string, cost bigint, efficiency double, full boolean").selectExpr("*", "if(full, 'full', 'behavioral_summary') AS mode", "1 AS priority")
    budgets = spark.createDataFrame([("a", 300), ("b", 2000)], "task_id string, budget bigint")
    two = pack.greedy_each(pairs, budgets.selectExpr("task_id", "budget AS a", "budget * 2 AS b"), ("a", "b"), keep=("full",)).collect()
    for plan, times in (("a", 1), ("b", 2)):
        alone = pack.greedy(pairs, budgets.withColumn("budget", F.col("budget") * times)).collect()
        assert {(r.task_id, r.path) for r in two if r.plan == plan} == {(r.task_id, r.path) for r in alone}
    assert all(r.full == (r.mode == "full") for r in two)
    got = {(r.task_id, r.path) for r in pack.forced_full(pairs, budgets)[0].collect()}
    want = {(t, p) for t, p, *_, full in rows if full}
    for task, budget in (("a", 300), ("b", 2000)):
        left = budget - sum(c for t, _, c, _, full in rows if full and t == task)
        for t, p, c, *_ in sorted((r for r in rows if r[0] == task and not r[4]), key=lambda r: (-r[3], r[2], r[1])):
            if c <= left:
                left -= c
                want.add((t, p))
    assert got == want, "forced files of a task without a budget stay"


def test_two_plans_read_the_parts_twice(spark, monkeypatch):
    """Files and imports are made of the parts once each, whatever plans are compared."""
    asked, load = [], registry.V.load
    monkeypatch.setattr(registry.V, "load", lambda s, d, name: asked.append(name) or load(s, d, name))
    registry.diff_documents(spark, "/root/testdata/sf0.001")
    assert asked.count("part") == 2
