"""Extraction by tokens: what is defined where, in every language; comments, fingerprints and complexity."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.api import Project
from orrery.sources.lexed_code import rows_of
from orrery.sources.lexer import LANGUAGES, SUFFIXES, language_of

# source and its symbols: kind, name, line, end line, scope
SYMBOLS = {
    "javascript": (
        'export default class Till {\n  #sum = 0;\n  add(n) { this.#sum += n; }\n  get total() {\n    return this.#sum;\n  }\n  static open() {}\n}\nasync function pay(till) {\n  function inner() {}\n  const unseen = /[{]/.test("}");\n}\nlet rate = `${1}{`, two = 2;\nconst act = { go() { return 1 }, stop: 2 };\nconst [a, b] = pair;\n',
        [("class", "Till", 1, 8, ""), ("method", "add", 3, 3, "Till"), ("method", "total", 4, 6, "Till"), ("method", "open", 7, 7, "Till"), ("function", "pay", 9, 12, ""), ("function", "inner", 10, 10, "pay"), ("variable", "rate", 13, 13, ""), ("variable", "act", 14, 14, ""), ("method", "go", 14, 14, "")],
    ),
    "typescript": (
        "namespace shop {\n  export interface Item { price(): number }\n}\nexport type Id = { raw: string } | null;\nabstract class Shelf<T extends Item> {\n  constructor(private items: T[]) {}\n  abstract pick(id: Id): T;\n  sort<K>(by: (x: T) => K): { ok: boolean } {\n    return { ok: true };\n  }\n}\ndeclare function outside(x: Id): void;\nexport enum Size { S, L }\n",
        [("interface", "Item", 2, 2, ""), ("type", "Id", 4, 4, ""), ("class", "Shelf", 5, 11, ""), ("method", "constructor", 6, 6, "Shelf"), ("method", "pick", 7, 7, "Shelf"), ("method", "sort", 8, 10, "Shelf"), ("enum", "Size", 13, 13, "")],
    ),
    "tsx": ("export const title: string = 'x';\nexport function Page() {\n  return <b>{title}</b>;\n}\n", [("variable", "title", 1, 1, ""), ("function", "Page", 2, 4, "")]),
    "go": (
        "package p\n\ntype (\n\tA int\n\tB struct {\n\t\tx int\n\t}\n)\n\ntype C = B\n\nconst (\n\tOne = iota\n\tTwo\n)\n\nvar f = func(x int) int {\n\treturn x\n}\n\nfunc (b *B) Get() interface{} {\n\tvar local = 1\n\treturn local\n}\n\nfunc Map[T any](xs []T) {}\n",
        [("type", "A", 4, 4, ""), ("type", "B", 5, 7, ""), ("variable", "One", 13, 13, ""), ("variable", "Two", 14, 14, ""), ("variable", "f", 17, 19, ""), ("method", "Get", 21, 24, ""), ("function", "Map", 26, 26, "")],
    ),
    "rust": (
        "mod m {\n    pub static mut COUNT: u8 = b'{';\n}\n#[derive(Debug)]\nstruct Pair<'a>(&'a str, &'static str);\nimpl<'a> Show for Pair<'a> {\n    fn show(&self) -> impl Fn() -> u8 { || 1 }\n}\ntrait Show {\n    const N: usize;\n    fn show(&self);\n}\nconst fn one() -> u8 { 1 }\n",
        [("variable", "COUNT", 2, 2, ""), ("struct", "Pair", 5, 5, ""), ("function", "show", 7, 7, "Pair<'a>"), ("trait", "Show", 9, 12, ""), ("function", "show", 11, 11, "Show"), ("function", "one", 13, 13, "")],
    ),
    "csharp": (
        'namespace Bank;\npublic class Box<T> : Base where T : class, new()\n{\n    private readonly Dictionary<string, int> map = new();\n    public int Size => map.Count;\n    public string Path { get; } = @"c:\\";\n    [Fact(Skip = "x")]\n    public async Task<T> Load<T>(int n = 1) where T : class\n    {\n        var o = new Other() { A = 1 };\n    }\n    internal Box(int a) : base(a) {}\n}\n',
        [("class", "Box", 2, 13, ""), ("property", "Size", 5, 5, "Box"), ("property", "Path", 6, 6, "Box"), ("method", "Load", 7, 11, "Box"), ("constructor", "Box", 12, 12, "Box")],
    ),
    "java": (
        'final class Node<T> {\n  static final Map<String, Class> M = Map.of("a", Node.class);\n  @Override\n  public <K extends T> List<K> pick(int[] at) throws Error {\n    return new Thread() { public void run() {} };\n  }\n  enum Kind { A(1), B(2); Kind(int n) {} }\n}\n',
        [("class", "Node", 1, 8, ""), ("method", "pick", 3, 6, "Node"), ("method", "run", 5, 5, "Node.pick"), ("enum", "Kind", 7, 7, "Node"), ("constructor", "Kind", 7, 7, "Node.Kind")],
    ),
    "c": (
        '#define F(x) { x\ntypedef struct { int a; } Anon;\nstruct Named *make(struct Named *p);\nstatic const char *\nlabel(int n)\n{\n    return n ? "}" : "{";\n}\nstruct Named find(void) { struct Named n; return n; }\n',
        [("struct", "<anon>", 2, 2, ""), ("function", "label", 4, 8, ""), ("function", "find", 9, 9, "")],
    ),
    "cpp": (
        'namespace a { namespace b {\ntemplate <class T>\nclass Q {\n  Q() : n{1} {}\n  ~Q();\n  T get() const noexcept { return t; }\n  enum class E : int { X };\n};\n} }\nstd::vector<int> a::b::Q<int>::all(int x) {\n  return {};\n}\n',
        [("class", "Q", 3, 8, ""), ("function", "Q", 4, 4, "Q"), ("function", "get", 6, 6, "Q"), ("enum", "E", 7, 7, "Q"), ("function", "all", 10, 12, "")],
    ),
    "kotlin": (
        "data class P(val x: Int)\nsealed interface S { fun go() }\nclass K : S {\n  companion object {\n    fun of(): K = K()\n  }\n  override fun go() = listOf(1).forEach { it }\n}\nfun <T> List<T>.second(): T {\n  return this[1]\n}\n",
        [("class", "P", 1, 1, ""), ("class", "S", 2, 2, ""), ("function", "go", 2, 2, "S"), ("class", "K", 3, 8, ""), ("function", "of", 5, 5, "K"), ("function", "go", 7, 7, "K"), ("function", "second", 9, 11, "")],
    ),
    "swift": (
        "struct V {\n  let n: Int\n  var twice: Int { return n * 2 }\n  static func make() -> V {\n    if let x = seek() { return x }\n    return V(n: 1)\n  }\n}\nprotocol Q { var a: Int { get }\n  func b() }\nextension V { func c() {} }\n",
        [("class", "V", 1, 8, ""), ("property", "n", 2, 2, "V"), ("property", "twice", 3, 3, "V"), ("function", "make", 4, 7, "V"), ("protocol", "Q", 9, 10, ""), ("method", "b", 10, 10, "Q"), ("class", "V", 11, 11, ""), ("function", "c", 11, 11, "V")],
    ),
    "php": (
        "<html>{</html>\n<?php\nuse function a\\b;\nfinal class M extends N {\n  private $x = ['{'];\n  public function run(): ?array { return array_map(function ($y) { return M::class; }, []); }\n}\n// } note\nfunction top() { echo <<<EOT\n}\nEOT;\n}\n?> } tail",
        [("class", "M", 4, 7, ""), ("method", "run", 6, 6, "M"), ("function", "top", 9, 12, "")],
    ),
    "ruby": (
        'class Cart < Base\n  class << self\n    def open?; true if ready; end\n  end\n  def add(x) = @n += x\n  def each\n    items.each do |i|\n      yield i unless i.class == Nil\n    end\n    while @n > 0 do @n -= 1 end\n  end\nend\n',
        [("class", "Cart", 1, 12, ""), ("method", "open?", 3, 3, "Cart"), ("method", "add", 5, 5, "Cart"), ("method", "each", 6, 11, "Cart")],
    ),
    "bash": ('build() {\n  if [ "$#" -gt 0 ]; then echo "${1%%\\}}"; fi # {\n}\nfunction clean-up\n{\n  :\n}\n', [("function", "build", 1, 3, ""), ("function", "clean-up", 4, 7, "")]),
    "lua": ("local function a(n)\n  for i = 1, n do print(i) end\n  repeat n = n - 1 until n == 0\n  return function() end\nend\nfunction T:m() if x then return 1 end end\n", [("function", "a", 1, 5, ""), ("function", "T:m", 6, 6, "")]),
}


def rows(kind, text, name):
    return [r for k, r in rows_of("f", text, name) if k == kind]


@pytest.mark.parametrize("name", SYMBOLS)
def test_symbols(name):
    text, want = SYMBOLS[name]
    assert [(r["kind"], r["name"], r["line"], r["end_line"], r["scope"]) for r in rows("symbol", text, name)] == want


def test_languages():
    assert set(SYMBOLS) == set(LANGUAGES) == set(SUFFIXES) - {"python"}
    assert [language_of(p) for p in ("a/b.PY", "x.h", "x.hpp", "Makefile", "a.b/c", "q.cobol")] == ["python", "c", "cpp", None, None, None]


FLOW = "{ if (a && b || c) { for (;;) { if (d) { } } } else if (e) { } else { x = y ? 1 : 2; } switch (z) { case 1: break; default: break; } do { } while (q); }"


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        # if 1, two runs 2, for 2, if 3, else-if 1, else 1, ternary 2, switch 1, do 1
        ("c", "int f(void) " + FLOW, 14), ("cpp", "int f() " + FLOW, 14), ("java", "class C { int f() " + FLOW + " }", 14), ("csharp", "class C { int f() " + FLOW + " }", 14), ("javascript", "function f() " + FLOW, 14), ("typescript", "function f(): void " + FLOW, 14),
        ("javascript", "function f(n) { return n ? f(n - 1) : o.f(n) }", 2), ("typescript", "class C { f(x?: number) { this.f(1); xs.map(x => { if (x) {} }) } }", 3), ("csharp", "class C { void f(int? n) { int? m = n ?? 1; foreach (var a in b) goto end; } }", 1),
        ("go", "func f() {\n\tselect {\n\tcase <-c:\n\t}\n\tgo func() {\n\t\tif a && (b && c) {\n\t\t}\n\t}()\n}", 4), ("rust", "fn f(o: Option<u8>) -> u8 { let x = o?; match x { 0 => 1, n if n > 1 => xs.iter().map(|y| { if y { 1 } else { 2 } }), _ => 3 } }", 7),
        ("kotlin", "fun f(x: Int) {\n  val y = when (x) {\n    1 -> 2\n    else -> 3\n  }\n  xs.forEach { if (it > 0) println(it) }\n}", 3), ("swift", "func f() {\n  guard let a = b else { return }\n  xs.forEach { x in if x { } }\n  let z = a?.b ?? c\n}", 3),
        ("ruby", "def f(a)\n  return if a\n  x = if a then 1 else 2 end\n  b.each { |c| d while c }\n  f(a)\nend", 6), ("lua", "function f() if a then end end", None), ("php", "<?php function f() { if (1) {} }", None), ("bash", "f() { if a; then b; fi; }", None),
    ],
)
def test_cognitive_complexity(name, text, want):
    assert [r["cognitive"] for r in rows("fingerprint", text, name)][:1] == [want]


def test_fingerprints():
    loop = "int {n}(int {a}) {{\n  int t = 0;\n  for (int i = 0; i < {a}; i++) {{ t += g({a}); }}\n  return t; // {n}\n}}\n"
    a, b, c = rows("fingerprint", loop.format(n="one", a="k") + loop.format(n="two", a="m") + "int one(int k) { return k; }", "c")
    assert a["shape_hash"] == b["shape_hash"] != c["shape_hash"] and a["raw_token_hash"] != b["raw_token_hash"]
    assert a["call_hash"] == b["call_hash"] is not None and c["call_hash"] is None
    assert (a["nstmts"], c["nstmts"], a["has_control_flow"], c["has_control_flow"]) == (3, 1, True, False)
    again = rows("fingerprint", loop.format(n="one", a="k").replace("  ", " "), "c")[0]
    assert again["raw_token_hash"] == a["raw_token_hash"]


def test_comments():
    text = "//! about the file\n\n/// Adds.\n/// Twice.\nfn add() {\n    // TODO: \"one\"\n    let s = \"// none\";\n}\n/** far */\n\n\n\nfn far() {}\n/// taken\n// breaks\nfn broken() {}\n/* block\n two */\n"
    got = [(r["line"], r["end_line"], r["kind"], r["is_doc"], r["scope"], r["owner_line"]) for r in rows("comment", text, "rust")]
    assert got == [
        (1, 1, "doc", True, "", None), (3, 3, "doc", True, "", None), (4, 4, "doc", True, "", 5), (6, 6, "line", False, "add", None), (9, 9, "doc", True, "", None), (14, 14, "doc", True, "", None), (15, 15, "line", False, "", None), (17, 18, "block", False, "", None),
    ]
    assert [r["text"] for r in rows("comment", "x = '# no' # yes\n=begin\nmany\n=end\n", "ruby")] == ["# yes", "=begin\nmany\n=end"]
    assert [r["text"] for r in rows("comment", "a --[[ two\nlines ]] b -- end\n", "lua")] == ["--[[ two\nlines ]]", "-- end"]


PIECES = ["{", "}", "(", ")", "[", "]", "<", ">", ";", ":", "=", "=>", "->", "?", ",", ".", "'", '"', "/*", "*/", "//", "#", "\n", "\\", "@", "`", "é", " ", "f", "T", "1"]
WORDS = ["if", "else", "for", "while", "do", "end", "def", "class", "struct", "enum", "fn", "func", "fun", "function", "type", "impl", "var", "let", "init", "public", "static", "new", "get", "case", "switch", "until", "rescue", "interface", "delegate", "record", "template", "namespace"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(LANGUAGES)), st.lists(st.sampled_from(PIECES + WORDS), max_size=60))
def test_broken_text_gives_rows_within_it(name, parts):
    text = " ".join(parts)
    last = text.count("\n") + 1
    for kind, row in rows_of("f", text, name):
        assert 1 <= row["line"] <= row["end_line"] <= last, (kind, row)


def test_long_and_deep_text():
    many = "".join(f"/// doc {i}\nfn f{i}(a: u8) -> u8 {{ if a > {i} {{ return f{i}(a - 1); }} a }}\n" for i in range(3_000))
    found = rows("fingerprint", many, "rust")
    assert len(found) == 3_000 and {r["cognitive"] for r in found} == {2}
    assert len(rows("comment", many, "rust")) == 3_000
    assert rows("symbol", "{" * 50_000, "java") == [] and rows("symbol", "", "go") == []


def test_project_of_many_languages(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    for name, (text, _) in SYMBOLS.items():
        (root / ("x" + SUFFIXES[name][0])).write_text(text)
    (root / "core.py").write_text("def hub():\n    return 1\n\n\ndef caller():\n    return hub()\n")
    (root / "note.txt").write_text("fn none() {}")
    p = Project(spark, str(root), str(tmp_path / "store"))
    assert p.index_project() == {"new": 16}
    want = {("x" + SUFFIXES[n][0], *s) for n, (_, symbols) in SYMBOLS.items() for s in symbols} | {("core.py", "function", "hub", 1, 2, ""), ("core.py", "function", "caller", 5, 6, "")}
    assert {(r["path"], r["kind"], r["name"], r["line"], r["end_line"], r["scope"]) for r in p.get_symbols().collect()} == want
    verdicts = {(r["path"], r["verdict"]) for r in p.find_deadcode().collect()}
    assert {v for path, v in verdicts if not path.endswith(".py")} == {"UNKNOWN_NO_RESOLVER"} and ("core.py", "KEEP") in verdicts
    assert p.reference_level("hub") == "high" and p.reference_level("Till") == p.reference_level("nowhere") == "low"
    assert {r["confidence"] for r in p.find_references("Pair").collect()} == {"low"}
    assert {r["name"]: r["cognitive"] for r in p.tables.read("fingerprints").filter("path = 'x.java'").collect()}["pick"] == 0
