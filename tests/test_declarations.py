"""Brace languages: segments, nested nodes, calls with their callers, what is dead, files whose brackets don't match."""

from __future__ import annotations

import pytest

from quarry.functions import brackets
from quarry.functions.pattern_tables import language_of
from quarry.operators import declarations
from quarry.plans import tools
from quarry.scratch import staged

SOURCES = {
    "A.java": 'package x;\n/** Doc one.\n * More { */\n@Ann("a{b")\npublic class A<T> extends B {\n  // } f99(\n  int x = g("{");\n  public A(int x) { this.x = x; }\n  /** Finds. */\n  private static List<Map<String, T>> f(int a, List<T> b)\n      throws E {\n    if (a > 0) { return h(a); }\n    return m(() -> { n(); });\n  }\n  interface I { int find(); }\n  abstract void later();\n  enum K { P, Q; int z() { return 1; } }\n}\n',
    "a.go": 'package x\n\n// Config holds.\ntype Config struct {\n\tA int\n}\n\nfunc (c *Config) Run(a, b int) (int, error) {\n\tx := func() { inner() }\n\tfor i := 0; i < 3; i++ {\n\t\tc.step(i)\n\t}\n\treturn fmt.Sprint("{", `}`), nil\n}\n\nfunc main() { run() }\n',
    "a.rs": "#[derive(Debug)]\npub struct U { a: &'a str }\npub struct Unit;\n/// Svc\npub trait Svc {\n    fn ask(&self) -> i32;\n    fn hook(&self) -> i32 { one() }\n}\nimpl<T: X> Svc for U<T> where T: Y {\n    fn hook(&self) -> i32 { let c = '{'; two(c) }\n}\n",
    "A.cs": "namespace N.M\n{\n    [ApiController]\n    public class A : Base, IFace\n    {\n        public string Name { get; set; }\n        public A(int x) : base(x) { }\n        internal async Task<int> Run<T>(T a) where T : class\n        {\n            foreach (var x in xs) { Do(x); }\n            return await Go();\n        }\n        int Short() => Calc(1);\n    }\n    public interface IRepo { int Find(); }\n}\n",
    "a.cpp": "#define M { (\nnamespace n {\nclass W : public B {\npublic:\n  W() : x(1) {}\n  virtual void draw() { paint(); }\nprivate:\n  int hid() const { return 1; }\n};\n}\nstatic int local(int a) { return a; }\nvoid W::draw2(std::vector<int> v) {\n  if (v.size()) { local(1); }\n}\n",
    "a.php": '<?php\nabstract class S extends T implements R {\n  # } c\n  private function f($a = "{") : int { return $this->g(new H(1)); }\n  public abstract function later();\n}\nfunction top() { $x = function() { inner(); }; return top2(); }\n',
    "a.swift": 'struct D: App {\n  var body: V {\n    Text("}")\n  }\n  func go(_ a: Int) -> T where Q: P {\n    run(a)\n  }\n  init(x: Int) { make() }\n}\nprotocol P { func draw()\n func b() -> Int }\nextension D: P { override func draw() { go(1) } }\n',
    "a.ts": 'export class W extends V {\n  private x = 1\n  constructor(a: number) { super(a) }\n  private async run<T>(a: T, b = {}): Promise<T> {\n    if (a) { go(a) }\n    return other(() => { deep() })\n  }\n}\nexport const Root = () => <App/>;\ninterface I { m(a: string): void; n: number }\n',
    "a.zig": 'pub const P = struct {\n    x: i32,\n    pub fn len(self: P) f64 {\n        return sqrt(self.x);\n    }\n};\nconst E = enum(u8) { a, b };\ntest "adds {" {\n    try expect(add(1));\n}\n',
}
# path: (depth, type, name, signature, start, end, modifiers)
NODES = {
    "A.java": [(0, "class", "A", "<T> extends B", 4, 18, "public"), (1, "constructor", "A", "(int x)", 8, 8, "public"), (1, "method", "f", "(int a, List<T> b) throws E : List<Map<String, T>>", 10, 14, "private static"), (1, "interface", "I", "", 15, 15, ""), (2, "method", "find", "() : int", 15, 15, ""), (1, "method", "later", "() : void", 16, 16, "abstract"), (1, "enum", "K", "", 17, 17, ""), (2, "method", "z", "() : int", 17, 17, "")],
    "a.go": [(0, "struct", "Config", "", 4, 6, ""), (0, "method", "Run", "(c *Config) (a, b int) (int, error)", 8, 14, ""), (0, "function", "main", "()", 16, 16, "")],
    "a.rs": [(0, "struct", "U", "", 2, 2, "pub"), (0, "struct", "Unit", "", 3, 3, "pub"), (0, "trait", "Svc", "", 5, 8, "pub"), (1, "function", "ask", "(&self) -> i32", 6, 6, ""), (1, "function", "hook", "(&self) -> i32", 7, 7, ""), (0, "impl", "Svc for U<T>", "", 9, 11, ""), (1, "function", "hook", "(&self) -> i32", 10, 10, "")],
    "A.cs": [(0, "namespace", "N.M", "", 1, 16, ""), (1, "class", "A", ": Base, IFace", 3, 14, "public"), (2, "property", "Name", "", 6, 6, "public"), (2, "constructor", "A", "(int x) : base(x)", 7, 7, "public"), (2, "method", "Run", "<T>(T a) where T : class : Task<int>", 8, 12, "internal async"), (2, "method", "Short", "() : int", 13, 13, ""), (1, "interface", "IRepo", "", 15, 15, "public"), (2, "method", "Find", "() : int", 15, 15, "")],
    "a.cpp": [(0, "namespace", "n", "", 2, 10, ""), (1, "class", "W", ": public B", 3, 9, ""), (2, "constructor", "W", "()", 5, 5, "public"), (2, "method", "draw", "() : void", 6, 6, "virtual public"), (2, "method", "hid", "() const : int", 8, 8, "private"), (0, "function", "local", "(int a) : int", 11, 11, "static"), (0, "function", "W::draw2", "(std::vector<int> v) : void", 12, 14, "")],
    "a.php": [(0, "class", "S", "extends T implements R", 2, 6, "abstract"), (1, "method", "f", "($a = ) : int", 4, 4, "private"), (1, "method", "later", "()", 5, 5, "public abstract"), (0, "function", "top", "()", 7, 7, "")],
    "a.swift": [(0, "struct", "D", ": App", 1, 9, ""), (1, "method", "go", "(_ a: Int) -> T where Q: P", 5, 7, ""), (1, "initializer", "init", "(x: Int)", 8, 8, ""), (0, "protocol", "P", "", 10, 11, ""), (1, "method", "draw", "()", 10, 10, ""), (1, "method", "b", "() -> Int", 11, 11, ""), (0, "extension", "D", ": P", 12, 12, ""), (1, "method", "draw", "()", 12, 12, "override")],
    "a.ts": [(0, "class", "W", "extends V", 1, 8, "export"), (1, "method", "constructor", "(a: number)", 3, 3, ""), (1, "method", "run", "<T>(a: T, b = {}): Promise<T>", 4, 7, "private async"), (0, "function", "Root", "()", 9, 9, "export const"), (0, "interface", "I", "", 10, 10, ""), (1, "method", "m", "(a: string): void", 10, 10, "")],
    "a.zig": [(0, "struct", "P", "", 1, 6, "pub const"), (1, "function", "len", "(self: P) f64", 3, 5, "pub"), (0, "enum", "E", "", 7, 7, "const"), (0, "test", "adds {", "", 8, 10, "")],
}
CALLS = {("A.java", "f", "h", 12), ("A.java", "f", "m", 13), ("A.java", "f", "n", 13), ("a.go", "Run", "inner", 9), ("a.go", "Run", "step", 11), ("a.go", "Run", "Sprint", 13), ("a.go", "main", "run", 16), ("a.rs", "hook", "one", 7), ("a.rs", "hook", "two", 10), ("A.cs", "Run", "Do", 10), ("A.cs", "Run", "Go", 11)}
CALLS |= {("a.cpp", "draw", "paint", 6), ("a.cpp", "W::draw2", "size", 13), ("a.cpp", "W::draw2", "local", 13), ("a.php", "f", "g", 4), ("a.php", "f", "H", 4), ("a.php", "top", "inner", 7), ("a.php", "top", "top2", 7), ("a.swift", "go", "run", 6), ("a.swift", "init", "make", 8), ("a.swift", "draw", "go", 12), ("a.ts", "run", "go", 5), ("a.ts", "run", "other", 6), ("a.ts", "run", "deep", 6), ("a.zig", "len", "sqrt", 4), ("a.zig", "adds {", "expect", 9), ("a.zig", "adds {", "add", 9)}


def table(spark, sources):
    rows = [(p, c, len(c.encode()), 0.0) for p, c in sources.items()]
    return spark.createDataFrame(rows, "path string, content string, size long, mtime double").selectExpr("*", "false as is_binary", f"{language_of()} as language")


@pytest.fixture(scope="module")
def parsed(spark):
    found = staged(brackets.parsed(table(spark, SOURCES)), "test-segments")
    return found, staged(declarations.nodes(found), "test-nodes")


def test_nested_nodes(parsed):
    got: dict = {}
    for r in parsed[1].orderBy("path", "node_id").collect():
        assert r["node_id"] == len(got.setdefault(r["path"], []))
        got[r["path"]].append(r)
    for path, want in NODES.items():
        assert [(r["depth"], r["type"], r["name"], r["signature"], r["start_line"], r["end_line"], " ".join(r["modifiers"])) for r in got[path]] == want, path
        for k, r in enumerate(got[path]):
            above = [i for i in range(k) if got[path][i]["depth"] == r["depth"] - 1]
            below = [i for i in range(k + 1, len(got[path]) + 1) if i == len(got[path]) or got[path][i]["depth"] <= r["depth"]]
            assert r["parent_id"] == (above[-1] if above else -1) and r["last_desc_id"] == below[0] - 1
            assert r["parent_id"] < 0 or got[path][r["parent_id"]]["start_line"] <= r["start_line"] <= r["end_line"] <= got[path][r["parent_id"]]["end_line"]
    assert [r["decorators"] for r in got["A.java"]][0] == ['@Ann("a{b")'] and got["a.rs"][0]["decorators"] == ["#[derive(Debug)]"] and got["A.cs"][1]["decorators"] == ["[ApiController]"]
    assert got["A.java"][0]["docstring"] == "Doc one." and got["a.go"][0]["docstring"] == "Config holds." and got["a.rs"][2]["docstring"] == "Svc"


def test_calls_belong_to_the_definition_around_them(parsed):
    got = {(r["caller_file"], r["caller_name"], r["callee_name"], r["line"]): r["is_cross_file"] for r in declarations.calls(*parsed).collect()}
    assert set(got) == CALLS and [k[:3] for k, cross in got.items() if not cross] == [k[:3] for k in got if k[2] in ("local",) or k[:3] == ("a.swift", "draw", "go")]


def test_parents_of_definitions(parsed):
    got = {(r["file"], r["name"], r["line"]): (r["parent"], r["enclosing_kind"]) for r in declarations.definitions(parsed[1]).collect()}
    assert got["A.java", "z", 17] == ("K", "enum") and got["a.rs", "hook", 10] == ("Svc for U<T>", "impl") and got["a.cpp", "hid", 8] == ("W", "class") and got["a.cpp", "W", 3] == (None, None) and got["a.swift", "draw", 12] == ("D", "extension")


DEAD = {
    "d.go": ("package m\nfunc Shown() int { return 1 }\nfunc lost() int { return 2 }\nfunc main() { _ = used() }\nfunc used() int { return 0 }\n", {"lost"}),
    "D.java": ("class D {\n  public int shown() { return 1; }\n  private int lost() { return 2; }\n  private int used() { return 3; }\n  public int user() { return used(); }\n}\n", {"lost"}),
    "d.rs": ("pub fn shown() -> i32 { 1 }\nfn lost() -> i32 { 2 }\npub trait Svc {\n    fn hook(&self) -> i32 { 42 }\n}\nstruct One;\nimpl Svc for One { fn by_trait(&self) -> i32 { 1 } }\nstruct Own;\nimpl Own { fn unhelped(&self) -> i32 { 9 } }\nfn main() {}\n", {"lost", "unhelped"}),
    "d.php": ("<?php\ninterface R { public function find(); }\nclass S implements R {\n  public function find() { return 1; }\n  protected function sub() { return 2; }\n  private function lost() { return 3; }\n  private function used() { return 4; }\n  public function user() { return $this->used(); }\n  public function __get($k) { return null; }\n}\n", {"lost"}),
    "d.zig": ("pub fn shown() void {}\nfn lost() void {}\nfn used() void {}\npub fn user() void { used(); }\nexport fn abi() void {}\n", {"lost"}),
    "d.swift": ("protocol Draws { func draw() }\nstruct Shape: Draws {\n  func draw() {}\n  func unhelped() {}\n}\nstruct Money: Codable {\n  func encode(to e: Encoder) {}\n}\nclass VC: SomeDataSource {\n  func rows() -> Int { 0 }\n}\npublic func shown() {}\nprivate func lost() {}\n", {"unhelped", "lost"}),
    "d.cpp": ("static int lost() { return 1; }\nint shown() { return 2; }\nclass W {\npublic:\n  void api() {}\n  virtual void onDraw() {}\nprivate:\n  int hidden() { return 3; }\n};\n", {"lost", "hidden"}),
    "d.tsx": ("export function Shown() { return 1; }\nfunction lost() { return 2; }\nfunction Used() { return <div/>; }\nfunction Unused() { return <div/>; }\nfunction App() { return <Used/>; }\nexport const Root = () => <App/>;\nexport class S {\n  api() { return 1; }\n  private secret() { return 2; }\n}\n", {"lost", "Unused", "secret"}),
    "D.cs": ("public interface IRepo { int Find(); }\npublic class D {\n  public int Shown() { return 1; }\n  private int Lost() { return 2; }\n  int Implicit() { return 3; }\n}\n", {"Lost", "Implicit"}),
}


@pytest.mark.parametrize("name", sorted(DEAD))
def test_dead_code_of_nine_languages(spark, name):
    source, want = DEAD[name]
    got = {r["qualified"].rsplit(".", 1)[-1] for r in tools.Facts(table(spark, {name: source})).dead().collect()}
    assert got == want


def test_files_whose_brackets_do_not_match_go_by_patterns(spark):
    sources = {"ok.java": "class A {\n  void f() { }\n}\n", "bad.java": "public class Half {\n  public void f() { } } } ) ) ) ] } )\n", "none.go": "package x\n", "empty.rs": "", "open.ts": "function f() {\n  if (a) {\n"}
    facts = tools.Facts(table(spark, sources))
    got = {r["path"]: (round(r["ratio"], 3), r["fallback"]) for r in facts.broken.collect()}
    assert got["ok.java"] == (0, False) and got["bad.java"][1] and got["none.go"] == (0, False) and got["empty.rs"] == (0, False) and not got["open.ts"][1]
    tiers = {(r["path"], r["name"]): r["tier"] for r in facts.nodes.collect()}
    assert tiers["ok.java", "f"] == "tokens" and tiers["bad.java", "Half"] == "pattern" and tiers["open.ts", "f"] == "tokens"
    assert all(p != "bad.java" for p, _ in ((r["caller_file"], 0) for r in facts.calls.where("caller_name is not null").collect()))


@pytest.mark.parametrize("language", brackets.LANGUAGES)
def test_blanking_keeps_length_and_lines(language):
    text = 'a "b\\"{" c\n/* { \n } */ d // } "\n\'{\' e `{` f\n"open\n{ g }'
    got = brackets.blanked(text, language)
    assert len(got) == len(text) and [k for k, c in enumerate(got) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
    assert got.count("{") <= 3 and "g" in got


def test_marks_name_what_follows(spark):
    from quarry.operators import entries

    sources = {"A.java": '@Controller class Here {}\n@RestController\n@RequestMapping("/x")\n// class Not\nfinal class Later {}\n@WebServlet(name = "s", urlPatterns = {"/u"})\n', "b.rs": "#[actix_web::test] async fn a() {}\n#[cfg(test)]\nmod tests {}\n#[bench]\n\n  fn b() {}\n", "c.cs": "[HttpGet]\n[Authorize]\npublic IActionResult Get(int x) {}\n [HttpPut]\n", "d.swift": "@main\nfunc x() {}\n"}
    got = {tuple(r) for r in entries.marked(table(spark, sources)).drop("language").collect()}
    assert got == {
        ("A.java", "controller", "Here", 1, "Spring"), ("A.java", "rest_controller", "Not", 2, "Spring"), ("A.java", "servlet", "Unknown:/u", 6, "Servlet"),
        ("b.rs", "async_test", "a", 1, "actix_web"), ("b.rs", "benchmark", "b", 4, None), ("c.cs", "http_handler", "Get", 1, "ASP.NET"), ("c.cs", "http_handler", "ActionMethod", 4, "ASP.NET"),
    }
    assert entries.marked(table(spark, {"x.py": "@main\n"})).count() == 0


def test_groups_of_imports(spark):
    from quarry.operators import imports

    sources = {"a.rs": "use a::{b, c::{self, d as e, f::{g}}, h};\nuse {x, y::z};\npub(crate) use super::k::{l};\n", "b.go": 'package b\nimport (\n)\nimport (\n\t. "m/n" // c\n)\n', "c.php": "<?php\nuse function A\\{f, g as h};\n  use B\\C;\n", "d.rs": ""}
    got = {(r["path"], r["line_no"], r["type"], r["name"], " ".join(r["names"])) for r in imports.grouped(table(spark, sources)).collect()}
    assert got == {("a.rs", 1, "use", "a", "b h"), ("a.rs", 1, "use", "a::c", "self d"), ("a.rs", 1, "use", "a::c::f", "g"), ("a.rs", 2, "use", "x", ""), ("a.rs", 2, "use", "y::z", ""), ("a.rs", 3, "use", "super::k", "l"), ("b.go", 4, "import", "m/n", ""), ("c.php", 2, "use_grouped", "A\\f", ""), ("c.php", 2, "use_grouped", "A\\g", "")}


def test_sql_statements_and_dialects(spark):
    from quarry.functions import sql_text

    text = "-- a; b\nCREATE TABLE `t` (\n a int(11) UNSIGNED, 'x;y' varchar(3),\n  CONSTRAINT k UNIQUE (a)\n) ENGINE=InnoDB;;\n/* c; */ SELECT 1; DO $x$ BEGIN; END $x$;\nCREATE OR REPLACE FUNCTION f(a int) RETURNS int AS $$ SELECT ';' $$;\ncreate index i on t (a)"
    files = table(spark, {"a.sql": text, "b.sql": "", "c.sql": "pragma x; create table u (a int) without rowid"})
    got = {(r["path"], r["turn"], r["start_line"], r["end_line"]) for r in sql_text.statements(files).collect()}
    assert got == {("a.sql", 1, 2, 5), ("a.sql", 2, 6, 6), ("a.sql", 3, 6, 6), ("a.sql", 4, 7, 7), ("a.sql", 5, 8, 8), ("c.sql", 1, 1, 1), ("c.sql", 2, 1, 1)}
    made = {(r["path"], r["dialect"], r["type"], r["name"], tuple(r["columns"])) for r in sql_text.structures(files).collect()}
    assert made == {("a.sql", "mysql", "table", "t", ("a int(11)", "'x;y' varchar(3)")), ("a.sql", "mysql", "function", "f", ()), ("a.sql", "mysql", "index", "i", ()), ("c.sql", "sqlite", "table", "u", ("a int",))}
