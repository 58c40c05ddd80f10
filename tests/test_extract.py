"""Facts of small sources in each language, and stored baselines."""

import pytest

from strata.extract import braces, cargo, python_lang
from strata.extract.common import ParseError
from strata.extract.tables import analyze
from strata.plans.history import revision_summaries
from strata.policy import Policy
from strata.sources import snapshot
from strata.streaming.gate import summarise_arrivals, windowed_mass


def facts_of(found):
    return [(f.qualified_name, f.start_line, f.cc, f.sloc, f.role) for f in found.functions]


def test_python_functions():
    text = (
        "class Box:\n    async def load(self, items):\n        # note\n        def pick(x):\n            return [y for y in x if y]\n        return items if items and 1 else 2\n\n"
        "    @property\n    def size(self):\n        return self._n\n\n    @size.setter\n    def size(self, n):\n        self._n = n\n\n    @overload\n    def get(self): ...\n\n"
        "def test_all():\n    match 1:\n        case 1:\n            pass\n        case _:\n            pass\n"
    )
    assert facts_of(python_lang.extract("a.py", text)) == [
        ("Box.load", 2, 3, 2, "general"), ("Box.load.pick", 4, 3, 2, "general"), ("Box.size@property", 9, 1, 2, "accessor"),
        ("Box.size@setter", 13, 1, 2, "accessor"), ("test_all", 19, 2, 6, "test"),
    ]
    with pytest.raises(ParseError):
        python_lang.extract("a.py", "def broken(:\n")


def test_rust_functions_and_surface():
    text = (
        "mod util {\n  impl<'a> Show for Point<'a> {\n    /* fn no() {} */\n    pub fn draw(&self, s: &'a str) -> Option<u8> {\n      if s.is_empty() && true || false { return None; }\n"
        "      let t = \"fn {\"; let r = r#\"a\"b\"#; let c = '}';\n      fn inner(x: u8) -> u8 { if x > 1 { 2 } else { 3 } }\n      match s.len() { 0 => Some(1), _ => None }\n    }\n"
        "    fn x(&self) -> u8 { self.x }\n    fn new() -> Self { Point { x: 1 } }\n  }\n}\n#[cfg_attr(test, allow(dead_code, unused))]\nunsafe fn raw() { for i in 0..3 { step(i)?; } }\n"
    )
    found = braces.extract_rust("src/a.rs", text)
    assert facts_of(found) == [("util::Point::draw", 4, 5, 6, "general"), ("util::Point::x", 10, 1, 1, "accessor"), ("util::Point::new", 11, 1, 1, "constructor"), ("raw", 15, 3, 1, "general")]
    assert [(x[0], x[1], x[3], x[4]) for x in found.lints] == [("allow", ["dead_code", "unused"], "fn", 14)]
    assert [(x[0], x[2]) for x in found.unsafe] == [("unsafe-function", 15)]
    for broken in ("fn a() {", "fn a() }", 'fn a() { "x }'):
        with pytest.raises(ParseError):
            braces.extract_rust("a.rs", broken)


def test_names_and_literals_do_not_change_the_stream():
    one = braces.extract_rust("a.rs", 'fn a(x: u8) -> u8 { let y = x + 1; call(y, "s") }').functions[0]
    two = braces.extract_rust("b.rs", 'fn bb(q: u8) -> u8 {\n let z = q + 22;\n call(z, "other text") // c\n}').functions[0]
    assert one.tokens == two.tokens and one.shape == two.shape and len(two.tokens) == len(two.token_lines)


def test_typescript_functions():
    text = (
        "export class A extends B {\n  constructor(a: number) { super(a); }\n  get v(): number { return this.x; }\n  run<T>(a: T): T | undefined {\n    if (a && b) { for (const q of a) { q ? 1 : 2; } }\n"
        "    return a ?? `t${x}`;\n  }\n  over(a: string): void;\n}\nexport function outer(a?: string) {\n  function nested() { return 1; }\n  return nested();\n}\n"
    )
    assert [(f.qualified_name, f.cc) for f in braces.extract_typescript("a.ts", text).functions] == [
        ("A::constructor", 1), ("A::get v", 1), ("A::run", 6), ("outer", 1), ("outer::nested", 1),
    ]


def test_cargo_edges():
    text = (
        '[dependencies]\nserde = { version = "1", features = ["derive", "derive"] }\nlog = "1"\n[target.\'cfg(unix)\'.build-dependencies]\n'
        'cc = { git = "https://x/y/", rev = "1" }\n[dev-dependencies]\nz = "1"\n[dependencies.big]\npath = "../b/"\ndefault-features = false\n'
    )
    edges = {d[1]: d for d in cargo.extract("Cargo.toml", text).dependencies}
    assert set(edges) == {"serde", "log", "cc", "big"} and edges["serde"][6] == ["derive"] and [edges[k][8] for k in ("serde", "log", "big")] == [2, 3, 8]
    assert edges["cc"][3:5] == ("git", "https://x/y#rev=1") and edges["big"][3:6] == ("path", "../b", False)
    with pytest.raises(ParseError):
        cargo.extract("Cargo.toml", "not toml")


def test_entries_are_analysed_whole_or_not_at_all():
    assert analyze("a.txt", "file", b"x")[:2] == ("unsupported", "unsupported file type")
    assert analyze("a.py", "symlink", b"x")[0] == "unsupported"
    assert analyze("a.py", "file", b"\xff")[:2] == ("failed", "not valid UTF-8")
    assert analyze("a.py", "file", b"def f(): pass\ndef (")[0] == "failed" and analyze("a.py", "file", b"")[0] == "analyzed"


def test_baseline_round_trip_and_tampering(spark, tmp_path):
    entries = snapshot.from_rows(spark, "r", {"a.py": "def f(x):\n    return x\n", "b.rs": "fn g() {}\n"})
    snapshot.validate_entries(entries)
    meta = snapshot.metadata(entries)
    path = str(tmp_path / "base")
    snapshot.write_baseline(snapshot.analyze(entries), meta, path, "r", Policy())
    revision, stored, rev = snapshot.read_baseline(spark, path, Policy())
    assert rev == "r" and revision.functions.count() == 2 and stored.count() == 2
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_baseline(spark, path, Policy().with_rule("near_clone", minimum_sloc=9))
    stored.limit(1).write.parquet(str(tmp_path / "cut"))
    spark.read.parquet(str(tmp_path / "cut")).write.mode("overwrite").parquet(f"{path}/entries")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_baseline(spark, path, Policy())
    with pytest.raises(snapshot.SnapshotError):
        snapshot.validate_entries(snapshot.from_rows(spark, "r", {"/a": "x"}))


def test_manifest(spark):
    old, new = (snapshot.metadata(snapshot.from_rows(spark, r, f)) for r, f in (("a", {"x": "1", "y": "2", "z": "3"}), ("b", {"x": "1", "y": "22", "w": "3"})))
    true = snapshot.manifest(old, new)
    assert {r.path: r.status for r in true.collect()} == {"x": "unchanged", "y": "changed", "w": "added", "z": "deleted"}
    moved = snapshot.manifest(old, new, spark.createDataFrame([("w", "z")], "path string, old_path string"))
    assert {r.path: (r.status, r.old_path) for r in moved.collect()} == {"x": ("unchanged", None), "y": ("changed", None), "w": ("changed", "z")}
    snapshot.validate_manifest(true, true)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.validate_manifest(true.where("path <> 'y'"), true)


def test_history_extracts_shared_contents_once(spark):
    first = snapshot.from_rows(spark, "c1", {"a.rs": "fn f(x: u8) { if x { } }\n"})
    second = snapshot.from_rows(spark, "c2", {"a.rs": "fn f(x: u8) { if x { } }\n", "b.rs": "fn g() {}\n", "c.py": "def h(): pass\n"})
    rows = {(r.revision, r.cutoff): r for r in revision_summaries(first.unionByName(second), [1, 10]).collect()}
    assert rows["c1", 1].high_count == 1 and rows["c2", 1].erosion_ratio == pytest.approx(2 / 3) and rows["c2", 10].high_mass == 0.0


def test_streams(spark, tmp_path):
    entries = snapshot.from_rows(spark, "c1", {"a.py": "def f(x):\n    return x\n"})
    entries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entries.schema).parquet(str(tmp_path / "in"))
    summarise_arrivals(stream, [1], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.rev_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["c1"]
    events = "/root/testdata/sf0.001/events.parquet"
    query = windowed_mass(spark.readStream.schema(spark.read.parquet(events).schema).parquet("/root/testdata/sf0.001/ev*.parquet"), "1 day")
    run = query.writeStream.outputMode("complete").format("memory").queryName("mass").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("mass").agg({"n": "sum"}).first()[0] == spark.read.parquet(events).count()


def rust_one(source):
    [function] = braces.extract_rust("src/a.rs", source).functions
    return function


def test_guards_and_macros_add_what_the_grammar_has():
    assert rust_one("fn g(n: i32) -> i32 { match n { n if n > 0 => 1, _ => 2 } }").cc == 2
    assert rust_one("fn g(n: i32) -> i32 { match n { _ if n > 0 && n < 9 => 1, _ => 2 } }").cc == 3
    assert rust_one("fn g(n: i32) -> i32 { if n > 0 { 1 } else if n < 0 { 2 } else { 3 } }").cc == 3
    assert rust_one('fn g(a: bool) { assert!(if a { 1 } else { 2 } == 1); vec![match a { true => 1, _ => 2 }]; }').cc == 1
    assert rust_one("fn g(a: bool, b: bool) { assert!(a && b); }").cc == 2
    source = "def g(x):\n    match x:\n        case [a] if a:\n            return 1\n        case _ if x:\n            return 2\n        case _:\n            return 3\n"
    [function] = python_lang.extract("a.py", source).functions
    assert function.cc == 4


def test_constructors_build_structs_or_tuples():
    assert rust_one("fn g(a: u8) -> Result<u8, E> { Ok(a) }").role == "general"
    assert rust_one("fn g(a: u8) -> (u8, u8) { (a, a) }").role == "constructor"
    assert rust_one("fn g(a: u8) -> P { P { a } }").role == "constructor"
    assert rust_one("fn g(p: (u8, u8)) -> u8 { let (a, b) = p; if a == LIMIT { f(a, b) } else { 0 } }").role == "general"
    assert rust_one("fn with_it(a: u8) -> u8 { f(a) }").role == "constructor"
