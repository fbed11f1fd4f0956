"""Reading repositories, analysing sources, the cache and its stream."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import manifest, manifest_diff
from siltstone.plans import repository
from siltstone.sources import analyze, cache, files, go_grammar, script_grammar, tasks
from siltstone.streaming.incremental import follow

GO = '''package oauth

import (
	"errors"
	alias "net/http"
)

// type Hidden struct{}
const (
	DefaultTimeout = 3
	internal = 4
)

var ErrExpired = errors.New("func Nope()")

type Provider interface {
	Name() string
}

type GitHub struct{}

func NewProvider() *GitHub { return nil }

func (g *GitHub) Refresh(x int) error { return nil }
func helper() {}
'''
TS = '''import { a } from "./util";
const fs = require('node:fs');
export const make = (x: number) => x;
export interface Shape {}
class Inner {}
export default function () {}
'''
PY = "import os.path\nfrom . import x\nclass A: pass\ndef _b(): pass\nc = lambda: 1\n"


def test_analyzers(spark):
    rows = spark.createDataFrame([("a.go", "go", GO), ("b.ts", "typescript", TS), ("c.py", "python", PY), ("d.py", "python", "def ("), ("e.md", "markdown", "x"), ("f.go", "go", None)], "path string, language string, text string")
    got = {r.path: r for r in analyze.analyze(rows).collect()}
    assert {(s.name, s.kind, s.receiver) for s in got["a.go"].symbols} == {("DefaultTimeout", "const", ""), ("ErrExpired", "var", ""), ("Provider", "interface", ""), ("GitHub", "type", ""), ("NewProvider", "func", ""), ("Refresh", "method", "GitHub")}
    assert got["a.go"].imports == ["errors", "net/http"]
    assert {(s.name, s.kind, s.exported) for s in got["b.ts"].symbols} == {("make", "func", True), ("Shape", "interface", True), ("Inner", "type", False), ("fs", "var", False), ("default", "func", True)}
    assert got["b.ts"].imports == ["./util"]
    assert {(s.name, s.kind, s.exported) for s in got["c.py"].symbols} == {("A", "type", True), ("_b", "func", False), ("c", "func", True)}
    assert got["c.py"].imports == [".", "os.path"] and got["d.py"].parse_error and got["f.go"].parse_error and not got["e.md"].symbols


def test_declarations_over_several_lines_and_names(spark):
    go = """package p

type (
	Reader   interface{ Read() }
	Box[T any] struct {
		Inner int
	}
	ID = string
	hidden int
)

const A, b, C = 1, 2, 3

var d, E int

const (
	F, G = 1, 2
	h    = 3
)
"""
    ts = """import {
  a, // don't stop; here
  b
} from "./x";
import type D, {
  e,
} from './y'
export {
  a as z
} from "./w"
export * from"./v";
export const s = 1
const t = pick("from 'nowhere'")
import "./side"
"""
    rows = spark.createDataFrame([("a.go", "go", go), ("b.ts", "typescript", ts)], "path string, language string, text string")
    got = {r.path: r for r in analyze.analyze(rows).collect()}
    want = {("Reader", "interface"), ("Box", "type"), ("ID", "type")} | {(n, "const") for n in "ACFG"} | {("E", "var")}
    assert {(s.name, s.kind) for s in got["a.go"].symbols} == want
    assert got["b.ts"].imports == ["./side", "./v", "./w", "./x", "./y"]


def test_scanner_knows_strings_comments_and_brackets(spark):
    go = """package p

type ( Alpha struct{}; Beta int )

var X, Y int

var s = "a/*"

func Between() { _ = `raw " ( */` }

// func Commented() {}
/* type Hidden int
func Nor() {} */
const C = '"'

func After(a []int) {}
"""
    ts = """export const a = `x ${f({ k: `in ${1} (` })} func( export`
/* export class No {} */
export const re = /[/"(]+/g
export function b(x) { return x / 2 / 3 }
const s = "export class Nope { '"
export class Yes {}
"""
    texts = [("a.go", "go", go), ("b.ts", "typescript", ts), ("c.go", "go", 'package p\n\nimport "fmt"\n\nfunc Broken( {\n'), ("d.ts", "typescript", "export const a = (;\n"), ("e.js", "javascript", "export const t = `open\n"), ("f.go", "go", "package p\n/* open\nfunc F() {}\n"), ("g.txt", "", "(")]
    got = {r.path: r for r in analyze.analyze(spark.createDataFrame(texts, "path string, language string, text string")).collect()}
    assert {(s.name, s.kind) for s in got["a.go"].symbols} == {("Alpha", "type"), ("Beta", "type"), ("X", "var"), ("Y", "var"), ("Between", "func"), ("C", "const"), ("After", "func")}
    assert {s.name for s in got["b.ts"].symbols if s.exported} == {"a", "re", "b", "Yes"}
    assert [(p, got[p].parse_error, len(got[p].symbols)) for p in ("c.go", "d.ts", "e.js", "f.go", "g.txt")] == [("c.go", True, 0), ("d.ts", True, 0), ("e.js", True, 0), ("f.go", True, 0), ("g.txt", False, 0)]
    assert got["c.go"].imports == ["fmt"] and not got["a.go"].parse_error and not got["b.ts"].parse_error


def test_walk(spark, tmp_path):
    held = {"a/x.go": b"package a", ".git/config": b"x", "b.bin": b"a\x00b", "vendor/v.go": b"x", "keep/me.txt": b"y", ".github/ci.yaml": b"z", "pkg/__init__.py": b"", "pkg/_helper.go": b"package pkg",
            ".golangci.yml": b"x", "R.MD": b"x", "big.txt": b"x" * ((10 << 20) + 1), "a/b c/%41é.txt": b"q", "sub/vendor/v.go": b"x", "x.min.js": b"x"}
    for name, data in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.go").symlink_to(tmp_path / "a/x.go")
    (tmp_path / "loop").symlink_to(tmp_path)
    kept, out = files.walk(spark, str(tmp_path), ("keep",))
    got = {r.path: r for r in kept.collect()}
    assert {(p, r.language) for p, r in got.items()} == {("a/x.go", "go"), (".github/ci.yaml", "yaml"), ("pkg/__init__.py", "python"), ("pkg/_helper.go", "go"), (".golangci.yml", "yaml"), ("R.MD", "markdown"), ("a/b c/%41é.txt", ""), ("sub/vendor/v.go", "go")}
    assert got["R.MD"].extension == ".md" and got["a/x.go"].sha256 == hashlib.sha256(b"package a").hexdigest() and got["a/x.go"].text == "package a"
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", got["a/x.go"].mtime)
    assert {(r.path, r.reason) for r in out.collect()} == {(".git/", "hidden_dir"), ("b.bin", "binary"), ("vendor/", "default_pattern"), ("keep/", "user_pattern"), ("big.txt", "oversize_cutoff"), ("link.go", "symlink"), ("loop", "symlink"), ("x.min.js", "default_pattern")}
    a, b = (files.fingerprint(kept.repartition(n), "v").first().fingerprint for n in (1, 5))
    assert a == b
    assert {r.path for r in files.walk(spark, str(tmp_path), (), [])[0].collect()} >= {"vendor/v.go", "keep/me.txt", "x.min.js"}
    missing = files.walk(spark, str(tmp_path / "nowhere"))
    assert missing[0].count() == 0 and [r.reason for r in missing[1].collect()] == ["read_error"]


def test_task_files(spark, tmp_path):
    (tmp_path / "t.md").write_text("# Fix it")
    (tmp_path / "u.txt").write_bytes(b"a\x00b")
    good, bad = tasks.read_tasks(spark, [str(tmp_path / "t.md"), str(tmp_path / "u.txt")])
    assert [(r.raw_text, r.markdown) for r in good.collect()] == [("# Fix it", True)] and [r.reason for r in bad.collect()] == ["binary"]


def test_plan_of_a_folder(spark, tmp_path):
    held = {"go.mod": "module m\n", "auth/provider.go": GO, "auth/provider_test.go": "package oauth\n\nfunc TestX() {}\n", "cmd/main.go": 'package main\n\nimport "m/auth"\n\nfunc main() {}\n', "docs/auth.md": "provider refresh guide", "AGENTS.md": "x", "node_modules/a.js": "x"}
    for name, data in held.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(data)
    texts = spark.createDataFrame([("t", "Refactor NewProvider in auth/provider.go, `auth` `provider`", False)], "task_id string, raw_text string, markdown boolean")
    plan, manifests = repository.plan_repository(spark, str(tmp_path / "r"), texts, Config.of({"budget": 60_000}))
    assert {r.path: r.load_mode for r in plan.assigned.collect()}["auth/provider.go"] == "full"
    m = manifests.first().manifest
    assert [(x.path, x.reason) for x in m.exclusions] == [("node_modules/", "default_pattern")] and m.repo.language_hints == ["go", "markdown"]
    assert {x.category for x in m.supplementals} == {"agents", "build_files"} and m.language_tiers["go"] == "tier1_deep" and m.budget.token_ceiling == 60_000
    assert m.feasibility.positives and {g.type: g.suggested_remediation for g in m.gaps}["missing_tests" if "missing_tests" in {g.type for g in m.gaps} else m.gaps[0].type]
    repository.write_artifacts(manifests, str(tmp_path / "out"))
    back = repository.read_manifests(spark, str(tmp_path / "out"), manifests)
    made = repository.write_files(manifests, str(tmp_path / "files")).first()
    whole = json.loads((tmp_path / "files" / made.json).read_text())
    assert whole["manifest_hash"] == manifests.first().manifest_hash and made.json == f"manifest-{whole['manifest_hash'][7:]}.json" and whole["task"]["type"] == "refactor" and whole["budget"]["reserved"]["reasoning"] > 0
    text = (tmp_path / "files" / made.markdown).read_text()
    assert [x for x in text.split("\n") if x.startswith("## ")][:7] == ["## Task Summary", "## Planning Assumptions", "## Selected Full Context", "## Selected Summaries", "## Reachable Context", "## Gaps", "## Feasibility"]
    assert "- `auth/provider.go` — score 0." in text and "  - rationale: direct task mention" in text and "- estimator: heuristic-3.5 (v1)" in text and "incomplete" not in text
    assert (tmp_path / "files" / made.run).read_text() == text + "\n---\n\n" + whole["task"]["raw_text"]
    with pytest.raises(ValueError, match=r"t: \$\.schema_version"):
        repository.write_files(manifests.withColumn("manifest", F.col("manifest").withField("schema_version", F.lit("2.0"))), str(tmp_path / "files"))
    assert "mention 1.0000 x 0.2500" in manifest.explain(manifests).first().explanation
    assert back.first() == manifests.first()
    other = repository.plan_repository(spark, str(tmp_path / "r"), texts, Config.of({"budget": 48_100}), "auth/")[1]
    row = manifest_diff.documents(manifests, other).first()
    assert not row.semantic_equivalent and '"scope":{"unchanged":false' in row.json and "## Budget" in row.markdown
    same = manifest_diff.documents(manifests, back).first()
    assert same.semantic_equivalent and '"tool_bug_diagnostic":[]' in same.json and '"unchanged":false' not in same.json


def rows(spark, *names):
    return spark.createDataFrame([(n, 1, "t", "go", f"package p\n\ntype {n} struct{{}}\n") for n in names], "path string, size bigint, mtime string, language string, text string")


def test_cache_and_stream(spark, tmp_path):
    held = cache.AnalysisCache(spark, str(tmp_path / "cache"))
    assert held.analyze(rows(spark, "A", "B")).count() == 2
    hits, misses = held.lookup(rows(spark, "B", "C"))
    assert [r.path for r in hits.collect()] == ["B"] and [r.path for r in misses.collect()] == ["C"]
    rows(spark, "B", "C", "D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows(spark, "A").schema).parquet(str(tmp_path / "in"))
    follow(stream, held, str(tmp_path / "ck")).awaitTermination(120)
    assert {r.path for r in held.entries().collect()} == {"A", "B", "C", "D"}
    assert held.entries().where(F.size("symbols") == 1).count() == 4
    held.clear()
    assert held.entries().count() == 0


def test_cache_loses_no_row(spark, tmp_path, monkeypatch):
    """Growing input, replays, clearing, compaction and other versions: every file has its result each time."""
    monkeypatch.setattr(cache, "COMPACT", 3)
    held = cache.AnalysisCache(spark, str(tmp_path / "cache"))
    for names in ("A", "AB", "ABCDEF", "ABCDEF", "G", "AGH", "BCI"):
        got = held.analyze(rows(spark, *names)).collect()
        assert sorted((r.path, r.symbols[0].name) for r in got) == [(n, n) for n in sorted(names)]
    assert len(held.pointer()[1]) <= 3 and held.entries().count() == 9
    old = held.entries()
    held.clear()
    assert held.analyze(rows(spark, "A", "B")).count() == 2 and held.entries().count() == 2
    assert old.count() == 9, "a reader keeps what it has read"
    newer = cache.AnalysisCache(spark, str(tmp_path / "cache"), {"go": "go-next"})
    assert newer.lookup(rows(spark, "A"))[0].count() == 0 and newer.analyze(rows(spark, "A", "C")).count() == 2
    newer.compact()
    assert {(r.path, r.version) for r in newer.entries().collect()} == {("A", "go-next"), ("C", "go-next")}
    assert newer.vacuum() > 0 and newer.vacuum() == 0 and newer.entries().count() == 2
    # of two writers that saw the same pointer one has to read again
    number, live = newer.pointer()
    assert newer.commit(number, live) and not newer.commit(number, [])


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "latin.go").write_bytes(b"package p\n\n// caf\xe9\nfunc Run() {}\n")
    (tmp_path / "t.md").write_bytes(b"Fix caf\xe9 in `latin.go`")
    kept, out = files.walk(spark, str(tmp_path / "r"))
    row = analyze.analyze(kept).first()
    assert "caf\ufffd" in row.text and [s.name for s in row.symbols] == ["Run"] and row.sha256 == hashlib.sha256((tmp_path / "r" / "latin.go").read_bytes()).hexdigest()
    assert out.count() == 0
    good, bad = tasks.read_tasks(spark, [str(tmp_path / "t.md")])
    assert good.first().raw_text == "Fix caf\ufffd in `latin.go`" and bad.count() == 0


def test_warm_plan_analyses_changed_files_only(spark, tmp_path, monkeypatch):
    for n in "abc":
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / f"{n}.go").write_text(f"package p\n\nfunc {n.upper()}() {{}}\n")
    held = cache.AnalysisCache(spark, str(tmp_path / "cache"))
    first = repository.indexed(spark, str(tmp_path / "r"), Config.of({}), cache=held)[0].collect()
    (tmp_path / "r" / "b.go").write_text("package p\n\nfunc Changed() {}\n")
    asked = []
    monkeypatch.setattr(cache, "analyze", lambda rows: asked.append(sorted(r.path for r in rows.select("path").collect())) or analyze.analyze(rows))
    second = repository.indexed(spark, str(tmp_path / "r"), Config.of({}), cache=held)[0].collect()
    assert asked == [["b.go"]]
    assert {r.path: r.symbols for r in first} == {"a.go": ["A"], "b.go": ["B"], "c.go": ["C"]}
    assert {r.path: r.symbols for r in second} == {"a.go": ["A"], "b.go": ["Changed"], "c.go": ["C"]}


GO_GOOD = """package p

import ("a"; . "b"
	c `d`)

type Pair[K comparable, V any] struct { Key K; Val, Other []V `json:"v"`; *Base; pkg.Other }
type (
	Ünder interface { ~int | string; Do(x, y int, rest ...string) (n int, err error) }
	Fn = func(int) chan<- bool
	Grid [3 * 2]int
)

const Ägypten, b = 1 << iota, 'x'

var Q, _ = map[string][]int{"a": {1, 2}, "b": nil}, struct{ A int }{A: 1}

func (p *Pair[K, V]) Get(k K) (v V) { return p.Val[0] }
func Ärger() {}
func New[T any](xs ...T) *Pair[int, T] {
	defer func() { recover() }()
	for i, x := range xs {
		if y, ok := any(x).(int); ok && y > 0 { continue } else if i == 3 { break }
	}
	for i := 0; i < 3; i++ {
	}
	for range xs {
	}
outer:
	switch z := any(xs).(type) {
	case nil, []T: goto outer
	case func(int) bool:
	default:
		_ = z
	}
	select {
	case v := <-ch: ch <- v
	case ch <- 1:
	}
	var f = func(a, b int) (int, error) { return a &^ b, nil }
	go f(1, 2)
	xs = append(xs[:1:2], xs...)
	return &Pair[int, T]{Key: []int{1}[0], Val: xs}
}
"""


def test_go_files_are_read_by_their_grammar():
    package, symbols, imports, broken = go_grammar.read(GO_GOOD)
    assert (package, imports, broken) == ("p", ["a", "b", "d"], False)
    assert symbols == [("Pair", "type", ""), ("Ünder", "interface", ""), ("Fn", "type", ""), ("Grid", "type", ""), ("Ägypten", "const", ""), ("Q", "var", ""), ("Get", "method", "Pair"), ("Ärger", "func", ""), ("New", "func", "")]
    head = "package p\n\nimport \"x\"\nimport (\n\ty \"z\"\n)\n\n"
    for bad in ("func F() { x := := 3 }", "var a", "const a = 1 1 1", "func F() { if x { }", "type T struct { a, }", "func F() { a b }", "x := 1", "func F(a int b) {}", "var s = \"open", "func F() { return 1 +\n}", "func F() { for i := 0; i < 3 {{ }", "var c = 'ab'", "var x = [1]"):
        assert go_grammar.read(head + bad) == ("", [], ["x", "z"], True), bad
    for good in ("var a, b = f(x)[1:], g.h(T{1})", "func F() { if (x == T{}) { } }", "func F() { for _, t := range []T{{1}} { _ = t } }", "var x = a.(*T).b", "type A []func()", "func F() { x.y++; *p = 3; <-c; f()() }", "func f()", "var f func(a, b int, c ...[]string) (map[string]int, error)", "func F() { switch { case a, b: } }", "func F() { switch x := f(); x {\n} }"):
        assert not go_grammar.read(head + good)[3], good
    assert go_grammar.read("package p\nvar a int\nimport \"late\"\nfunc") == ("", [], ["late"], True)
    assert go_grammar.read("")[3] and go_grammar.read("package p" + "\nvar x = " + "(" * 5000)[3]


TS_GOOD = """#!/usr/bin/env node
import React, { type A, b as c } from "react"
import * as ns from './ns';
import "side";
import fs = require("fs");
export * from "./all"; export { x as y } from "./some"
export type { T } from './types'
export type Id<T> = { [K in keyof T]: T[K] extends string ? 1 : 2 } | undefined
export interface Shape<T> extends Base<T> { area(): number }
export default class {}
export const make = async <T,>(x: T, { y }: { y: number } = { y: 1 }): Promise<T> => { return x! }
export let p = 1, q = a ? (b) : c, { r } = o
export function* gen() { yield* x; }
export abstract class Abs {}
export enum Color { Red }
declare function ambient(x: number): string
function over(a: string): void
function over(a: any) { if (a) return; else throw new Error(`x ${`y ${a}`}`) }
const re = /[/"(]+/g.test(s) || 4 / 2 / 1, g = f<Map<string, number>>(x)
@Deco({ a: 1 }) class Kept<T> extends mix(A, B)<T> implements I { #p = 1; get z() { return 1 } }
for (const x of y) { label: while (x--) continue label }
try { a?.b?.[c]?.(d) } catch { } finally { }
const ünï = function () { return require("inner") }
switch (a) { case 1: b(); default: c() }
export default function named() {}
"""


def test_scripts_are_read_by_their_grammar():
    symbols, imports, broken = script_grammar.read(TS_GOOD, True, False)
    assert not broken and imports == ["./all", "./ns", "./some", "./types", "react", "side"]
    assert symbols == [
        ("Id", "type", True), ("Shape", "interface", True), ("default", "type", True), ("make", "func", True), ("p", "var", True), ("q", "var", True), ("over", "func", False),
        ("re", "var", False), ("g", "var", False), ("Kept", "type", False), ("ünï", "func", False), ("default", "func", True),
    ]
    for bad in ("const a = 1 1 1;", "export const a = (;", "const t = `open", "let x = ;", "function f( {}", "if (a {}", "const = 3", "a b", "return 1 +", "import x from", "export { a", "/* open", "class { ", "x = 'open\n'", "const f = (a) => ;", "}"):
        assert script_grammar.read("import 'x'\n" + bad, True, False) == ([], [], True), bad
    js = "const a = require('a'), b = require('b').c, d = require(x)\nrequire('e');\nfunction f() { require('g') }\nrequire('h')()\nvar el = <div className='it'>don't {a < 1 && <b/>} <></></div>\n"
    symbols, imports, broken = script_grammar.read(js, False, True)
    assert (imports, broken) == (["a", "e"], False) and [s[0] for s in symbols] == ["a", "b", "d", "f", "el"]
    assert script_grammar.read("x = " + "(" * 5000, False, True)[2] and script_grammar.read("", True, False) == ([], [], False)


def test_files_of_one_partition_are_dealt(spark):
    """A small table of many files comes as one partition; its files are read by several tasks, copies of a text alike."""
    made = [(f"f{i}.{end}", language, f"export const a{i % 300} = <T>(x: T) => x") for i in range(1200) for end, language in (("ts", "typescript"), ("tsx", "typescript"), ("js", "javascript"))]
    rows = spark.createDataFrame(made, "path string, language string, text string").coalesce(1)
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "1b")
    try:
        got = analyze.analyze(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(name)
    assert len({r.task for r in got}) > 1
    alone = {end: analyze.script_file(f"f.{end}", made[0][2]) for end in ("ts", "tsx", "js")}
    assert len(got) == len(made) and alone["ts"][3] != alone["js"][3], "the ending decides"
    assert all(r.parse_error == alone[r.path.split(".")[1]][3] for r in got)
    assert all([s.name for s in r.symbols] == ([] if r.parse_error else [f"a{int(r.path[1:].split('.')[0]) % 300}"]) for r in got)
