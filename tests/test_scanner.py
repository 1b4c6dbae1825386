from pyspark.sql import functions as F

from glossmill.functions import scanner
from glossmill.functions.scanner import find_functions
from glossmill.operators.extraction import extract_functions, register_sql

SOURCE = '''// head
/** adds */
function add<T>(a: number, {b, c}: X = {}, ...rest): Promise<{x: number}> { return a + "}"; }
class Box extends Base {
  private x = 5;
  constructor(a) { this.a = a }
  /** opens */
  @Dec({a: 1})
  public async open(private readonly q: Map<string, number>, z?) { if (a) { b(); } function inner(p) { return 1 } }
  get z() { return 1 }
  nothing() {}
  onlyComment() { /* todo */ }
  fn = (a) => { add(); }
}
const o = { m(a) { return a }, n: function named() { return 2 }, k: `a ${ {a:`${b}`} } }` };
if (x) { y() }
for (const a of b) { c() }
export default function () { return /[/}]/.test("a") }
'''


def test_declarations_are_found_in_order():
    found = [(f["kind"], f["name"], f["params"]) for f in find_functions(SOURCE)]
    assert found == [
        ("function", "add", ["a", "{b, c}", "rest"]),
        ("method", "open", ["q", "z"]),
        ("function", "inner", ["p"]),
        ("method", "m", ["a"]),
        ("function", "", []),
    ]


def test_positions_and_comments():
    add, opened = find_functions(SOURCE)[:2]
    assert (add["line"], add["character"], add["comments"]) == (2, 0, "// head\n/** adds */")
    assert (opened["line"], opened["character"], opened["comments"]) == (7, 2, "/** opens */")
    assert opened["text"].startswith("@Dec({a: 1})") and opened["text"].endswith("return 1 } }")
    for f in find_functions(SOURCE):
        assert SOURCE[f["start_off"] : f["end_off"]] == f["text"]


def test_positions_count_utf16_units():
    assert find_functions("/* \U0001f600 */ function f() { x }")[0]["character"] == 9


def test_unreadable_text_gives_nothing():
    for bad in ("function a() { return '}' ", "const t = `a ${ b", None, ""):
        assert find_functions(bad) == []


def test_expressions_are_not_declarations():
    for code in ("x = function f() { a }", "call(function f() { a })", "return function f() { a }"):
        assert find_functions(code) == []
    assert find_functions("function f(); function g() { a }")[0]["name"] == "g"


def names(src):
    return [f["name"] for f in find_functions(src)]


def test_comments_of_any_length_between_modifier_and_keyword():
    assert names("export /* " + "c" * 5000 + " */ default /* d */ function f(a) { return a; }") == ["f"]
    decorated = "class A {\n  @x." + "y" * 500 + "(1)\n  m(a) { b }\n}"
    assert find_functions(decorated)[0]["text"].startswith("@x.")


def test_words_of_statements_name_methods_of_classes_and_objects():
    words = ["delete", "catch", "of", "import", "with", "in", "return", "throw", "if", "for"]
    members = " ".join(f"{w}(a) {{ a }}" for w in words)
    assert names(f"class A extends B<{{ x: 1 }}> {{ {members} }}") == words
    assert names(f"const o = {{ {members.replace('} ', '}, ')} }}") == words
    assert names("return { with(a) { a } }") == ["with"]
    blocks = "x => { if (a) { b } }; switch (c) { case 1: { while (d) { e } } default: { for (;;) { f } } }"
    assert names(blocks) == []


def test_computed_and_decorated_names():
    src = "class A { [Symbol.iterator]() { x }\n async *[key](a) { y }\n @dec(1) @e m(a) { z } }"
    assert names(src) == ["[Symbol.iterator]", "[key]", "m"]
    assert names("a = b[c](d); [e](f)") == []


def test_patterns_behind_conditions_only():
    assert names("if (x) /re}/.test(y); function f(a) { b }") == ["f"]
    assert names("for await (x of y) /}/.test(x); function f(a) { b }") == ["f"]
    assert names("z = (a) / 2; function f(a) { return (a) / b / 2 }") == ["f"]


def test_unbalanced_stretches_do_not_hide_the_rest():
    assert names("function a() { x ) } function b() { y }") == ["a", "b"]
    assert names("( function a() { y }\n; function b() { z }") == ["b"]
    assert names("} ) function a() { b } `") == ["a"]


def test_bodies_without_statements():
    assert names("function a() { } function b() { /* c */ } function d() { // e\n } function f() { 1 }") == ["f"]


def test_calls_and_control_words_are_not_methods():
    assert find_functions("{\n while (a) { b }\n switch (c) { d }\n foo(a);\n new Foo()\n}") == []


def test_long_blank_runs_stay_linear():
    src = "/* " + "x" * 200_000 + " */\nfunction f(a) { b }" + " " * 200_000 + "// end"
    assert find_functions(src)[0]["name"] == "f"


def test_empty_bodies_are_dropped_by_the_job(spark):
    files = spark.createDataFrame([(1, SOURCE), (2, "function a() { x "), (3, "no code")], "id int, content string")
    rows = extract_functions(files).collect()
    assert [(r.id, r.name) for r in rows] == [
        (1, "add"), (1, "open"), (1, "inner"), (1, "m"), (1, ""),
    ]


def test_sql_surface(spark):
    register_sql(spark, "found_in")
    names = spark.sql(
        "SELECT m.name FROM VALUES ('function f(a) { a }'), ('oops {') t(src), LATERAL found_in(t.src) m"
    ).collect()
    assert [r.name for r in names] == ["f"]
    empty = "SELECT count(m.name) AS n FROM VALUES ('function f() { /* c */ }'), (NULL) t(src), LATERAL found_in(t.src) m"
    assert spark.sql(empty).first().n == 0
    many = spark.sql("SELECT size(found_in_array('function f(a) { a } function g() { b }')) AS n")
    assert many.first().n == 2


def test_templates_of_any_depth():
    """Nested templates need no recursion: the functions around them are found."""
    deep = "`${" * 5000 + "1" + "}`" * 5000
    src = f"/** c */\nfunction f(a) {{ return {deep}; }}\nfunction g() {{ return `${{`${{ {{}} }}}}`}}`; }}"
    assert [f["name"] for f in find_functions(src)] == ["f", "g"]
    broken = "function f() { return 1; }\nconst t = " + "`${" * 3000
    assert [f["name"] for f in find_functions(broken)] == ["f"]


def test_brackets_and_calls_in_bulk():
    """Matching brackets come from arrays and from the loop alike; calls are no candidates."""
    texts = ["", "a", "(a[b]{c}(d))[]{}", "{" * 64 + "}" * 64, "f();g(h[1]);{({[]})}", "((]", "é(😀)[\ud800]"]
    for text in texts:
        found = scanner._nested(text)
        if found is not None:
            bare, scanner._DEEPEST = scanner._DEEPEST, -1
            try:
                assert scanner._nested(text) is None and scanner._partners(text) == found
            finally:
                scanner._DEEPEST = bare
    assert scanner._nested("(]") is None and scanner._nested(")(") is None and scanner._nested("(") is None
    src = "class A { a() { b();\nc().d();\ne(f(), g()); } h() { return 1; } }"
    assert [f["name"] for f in scanner.find_functions(src)] == ["a", "h"]
    text = scanner._blanked(src)
    names = [text[c[2] : c[3]] for c in scanner._candidates(text, *scanner._partners(text))]
    assert names == ["a", "h"]


def test_only_quotes_and_slashes_open_opaque_text():
    """A division is read on, a pattern is blanked, whatever stands in front of them."""
    for src, want in {
        'a / b / "c/d" // e': 'a / b / """""     ',
        "x = /[/]'/g; y": 'x = """""""; y',
        "if (x) /a'/.test(y)": 'if (x) """".test(y)',
        "(x) / 'a' / y": '(x) / """ / y',
        "return /'/": 'return """',
        "/'/": "/'/",
    }.items():
        assert scanner._blanked(src) == want


def test_functions_of_a_batch_are_built_by_column(spark, monkeypatch):
    """Files without functions, null files, several functions; no value is converted as a dictionary."""
    from glossmill.operators import extraction

    texts = [None, "", "function f(a) { return a; }", "class C { m(x, y) { x(); }\n n() { y(); } }", "no (code) {", "let functions = 1; function g(é) { é(); }"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "i int, t string")
    got = {r.i: [f.asDict() for f in r.f] for r in df.select("i", extraction.functions_of(F.col("t")).alias("f")).collect()}
    assert got == {i: find_functions(t) for i, t in enumerate(texts * 40)} and len(got[5]) == 1
    kinds, array = [], extraction.pa.array
    monkeypatch.setattr(extraction.pa, "array", lambda x, *a, **k: kinds.extend(map(type, x)) or array(x, *a, **k))
    out = list(extraction.functions_of.func(iter([array(texts)])))
    assert out[0].to_pylist() == [find_functions(t) for t in texts] and dict not in kinds


def test_words_are_looked_for_as_the_patterns_match():
    from glossmill.functions import scanner

    texts = ["function function (", "xfunction f( function*g<", "a.function h( class\nclass {classs classclass {", "$class { class{", "functionclass class function\n\n(", "", "function"]
    for pattern, word in ((scanner._FUNCTION, "function"), (scanner._CLASS, "class")):
        for text in texts:
            want = [m.span() for m in pattern.finditer(text)]
            assert [m.span() for m in scanner._beginning(pattern, word, text)] == want
