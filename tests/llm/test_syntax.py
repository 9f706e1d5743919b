import random

import pytest

from lodeseam.llm.parsing import failure_rates, file_syntax, ranked_languages, verdict
from lodeseam.llm.syntax import language_of, parses

GOOD = {
    "javascript": [
        "import a, { b as c } from 'x';\nexport default class A extends B {\n  static #n = 1\n  get x() { return this.#n }\n  async *gen(a, { b = 2, ...c }, [d]) { yield* other() }\n  static { init() }\n}\n",
        "const f = async (x) => ({ ...x, [k]: 1, m() {}, 'q': /[(\\[{]+/g }), y = a ? b : c ? d : e\nlabel: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break }\n",
        "let s = `a ${b + `c`} d`\nswitch (x) { case 1: case 'a': f(); break; default: { g() } }\ntry { a() } catch { b() } finally { c() }\ndo x++; while (x < 9)\n(function () { return })()\n",
        "for (let i = 0, n = 2; i < n; i++) w(i)\nfor (;;) { break }\nvar a = b\n++c\nnew Foo\nif (a) b\nelse c\nexport { x as default, y }; export * from 'm'\nawait import('z')\n",
        "", "// only a comment\n", "x = a / b / c; y = a?.b?.[c]?.(d) ?? e; z = typeof void 0\n",
    ],
    "typescript": [
        "export interface A<T extends B = C> extends D<T> { readonly a?: string; [k: string]: unknown; m<U>(x: U): Promise<U[]>; new (x: number): A; (y: 'a' | 'b'): void }\n",
        "type X = { a: number } & Partial<Record<string, Array<Map<number, string>>>>\nenum E { A = 1, B = 'x' }\nabstract class C<T> implements I, J { constructor(private readonly a: string, public b?: number) { super() } abstract f(): void; private g = (x: T): x is string => true }\n",
        "const f = <T,>(a: T, ...rest: string[]): T => a as unknown as T\nlet x = y!.z satisfies Q\ndeclare module 'm' { export const a: number }\nimport type { T } from './t'\nfunction over(a: string): void\nfunction over(a: any) {}\n",
        "const a: (x: number) => string = (x) => String(x)\nlet t: [string, number?] = ['a']\nfunction g(this: Window, o?: { a: string }): asserts o is { a: string } {}\n@dec({ a: 1 })\nclass K { @prop() name!: string }\n",
    ],
    "java": [
        'package a.b;\nimport static a.C.*;\n@Ann(value = 1, names = {"a"})\npublic final class A<T extends Comparable<T>> extends B<T> implements C, D {\n  static { x(); }\n  private final Map<String, List<? extends T>> m = new HashMap<>();\n  int[] a = {1, 2}, b[] = new int[2][];\n  public <U> A(U u) throws E { this.x = u; }\n  abstract void f();\n}\n',
        "class A { void f(int... xs) { for (int i = 0, j = 1; i < xs.length; i++) { } for (String s : list) g(s); try (var r = open(); s) { } catch (A | B e) { throw e; } finally { } switch (x) { case 1 -> f(); case A a -> { } default -> throw new X(); } int y = switch (z) { case 1: yield 2; default: yield 3; }; Runnable q = () -> { }; g((a, b) -> a + b, A::new, int[]::new); char c = '\\''; String t = \"\"\"\n x \"y\" \"\"\"; if (o instanceof String w && w.isEmpty()) return; assert x > 0 : \"m\"; synchronized (this) { } do { } while (a); l: for (;;) break l; (a).b(); ((Runnable) q).run(); new Thread() { public void run() { } }.start(); } }",
        "enum E implements I { A(1) { int f() { return 1; } }, B(2),; private final int x; E(int x) { this.x = x; } }\nrecord P(int x, @N String y) implements Q { P { } }\n@interface An { int v() default 1; }\nsealed interface S permits T { default void f() { } }\n",
    ],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tm "x/y"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype S struct {\n\tA, B int `json:"a"`\n\t*Embedded\n}\n\ntype I interface {\n\tM(x int) (string, error)\n\t~int | string\n}\n\nfunc (s *S) F(a, b int, c ...string) (r map[string][]int, err error) {\n\tdefer s.Close()\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn nil, err\n\t} else if x {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range xs {\n\t\tgo func() { ch <- v }()\n\t}\n\tswitch t := v.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase x := <-c:\n\t\tf(x)\n\tcase c <- 1:\n\t}\n\tx := S{A: 1, B: []int{1, 2}, C: map[string]int{"a": 1}}\n\ty := [...]string{"a"}\n\tp := &S{}\n\tx.a, y[1:2] = y, x\nouter:\n\tfor {\n\t\tbreak outer\n\t}\n\treturn\n}\n',
        "package p\n\nfunc Map[T, U any](xs []T, f func(T) U) []U {\n\tvar out []U\n\treturn append(out, f(xs[0]))\n}\n",
    ],
    "rust": [
        "#![allow(x)]\nuse a::{b, c as d, e::*};\npub(crate) struct S<'a, T: Clone + 'a> where T: X { pub a: &'a str, b: Vec<Option<T>> }\nenum E { A, B(u8, String), C { x: i32 } = 3 }\nimpl<T> Tr for S<'_, T> { const N: usize = 3; type O = T; fn f(&mut self, x: impl Fn(i32) -> i32) -> Result<(), Box<dyn Error>> { self.a.b()?.c::<u8>(); Ok(()) } }\ntrait Q: A + B { fn g(&self); }\n",
        'fn main() { let x: [u8; 3] = [0; 3]; let (mut a, ref b) = (1, 2); if let Some(Foo { x, .. }) = y { } else if a == b && !c { } match x { 0..=9 | 10 if a > 1 => { } Some(n @ 1..) => n, _ => return, } while let Some(z) = it.next() { } for (i, v) in xs.iter().enumerate() { } let c = move |a: i32, b| -> i32 { a + b }; \'l: loop { break \'l; } println!("{} {:?}", a, b as u64); let s = r#"a "b" c"#; let t = b\'x\'; unsafe { *p = 1; } let k = S { a, ..d }; (0..10).map(|x| x * 2).collect::<Vec<_>>(); async move { f().await } }',
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic A: &str = \"x\";\nmod m { pub fn f<T>() -> impl Iterator<Item = T> { x } }\nextern crate a;\n".replace("extern crate a;\n", ""),
    ],
    "python": ["def f(a, /, b, *, c=1) -> int:\n    match a:\n        case [x, *_]: return x\n", ""],
    "json": ['{"a": [1, 2.5e3, null, true, "\\u00e9"]}'],
}
BAD = {
    "javascript": ["const x: number = 1\n", "function f( { }", "a = ;\n", "if (x { y() }\n", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x\n", "let a = 'x\n", "foo(a b)\n", "class A { x( }\n", "<!DOCTYPE html>\n<html></html>\n", "package main\nfunc f() {}\n", "else { x() }\n", "return (\n", "var a b\n", "a ? b\n"],
    "typescript": ["function f(a: ) {}\n", "interface A { a: string b c d }\n", "const x = {a: 1,, b}\n", "let x: number = = 3\n", "export class { }}\n"],
    "java": ["class A { void f() { x = 1 } }", "class A { void f() { a b c; } }", "class A { void f() { x; } }", "void f() { }\nclass", "class A { int f( { } }", "def f(self): pass", "class A { void f() { if (x) } }", "class A { void f(int a,) { } }"],
    "go": ["package a\nfunc f() {\n\tx := \n}\n", "func f() {}\n", "package a\nfunc f( {}\n", "package a\nif x {}\n", "package a\nfunc f() { a b }\n", ""],
    "rust": ["fn f() { let x = ; }", "fn f( { }", "struct S { a: }", "fn f() { a b }", "public class A { }", "fn f() { x. }"],
    "python": ["def f(:\n", "x = (1\n", "if a\n  b\n"],
    "json": ["{'a': 1}", '{"a": 1,}', '{"a": NaN}', "", '{"a": 1 /* c */}'],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert parses(text, language), text
    assert parses(text.replace("\n", "\r\n"), language), "with carriage returns"


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert not parses(text, language), text


def test_java_comma_is_a_parameter():
    assert parses("class A { void f(int a, int b,) { } }", "java", java_trailing_comma=True)
    assert not parses("class A { void f(int a,, int b) { } }", "java", java_trailing_comma=True)


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "rust"])
def test_lost_brackets_are_found(language):
    """Any one bracket taken away makes a file invalid."""
    for text in GOOD[language]:
        spots = [k for k, c in enumerate(text) if c in "{}" and text.count("'") < 99]
        for k in random.Random(1).sample(spots, min(8, len(spots))):
            if "`" in text or "'" in text or '"' in text:
                continue
            assert not parses(text[:k] + text[k + 1 :], language)


def test_unknown_and_markdown():
    assert parses("((((", "markdown") and parses("((((", None)
    assert language_of("/a/b.PY") == "python" and language_of("/a.d/b") is None and language_of("x.tar.zig") is None


def test_verdicts():
    assert verdict("/a.py", "package a\n\nfunc f() error {\n\treturn nil\n}\n") == ("python", False, "go")
    assert verdict("/a.js", "def f(:\n  }{") == ("javascript", False, None)
    assert verdict("/a.py", "x = 1") == ("python", True, None)
    assert ranked_languages("fn f() -> u8 { let mut x = 1; }")[0] == "rust"


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, project string, file_path string, start_line int, content string, indexed_at timestamp, language string, symbols array<string>")


def test_frame(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [
        ("1", "p", "/a.py", 1, "def f():", t, None, None), ("2", "p", "/a.py", 2, "    return 1", t, None, None), ("2", "p", "/a.py", 2, "    return (", t.replace(year=2023), None, None),
        ("3", "p", "/b.py", 1, "def f(:", t, None, None), ("3", "p", "/b.py", 1, "def f(:", t, None, None), ("4", None, "/c.go", None, None, None, None, None), (None, None, None, 1, "x", t, None, None), (None, "p", "/d.md", 1, "x" * 300_000, t, None, None),
    ]
    files = file_syntax(chunks(spark, rows))
    assert {(r["file_path"], r["parses"]) for r in files.collect()} == {("/a.py", True), ("/b.py", False), ("/c.go", False), ("/d.md", True)}
    rates = {(r["project"], r["language"]): r["failure_rate"] for r in failure_rates(files).collect()}
    assert rates[("p", "python")] == 0.5 and rates[(None, "go")] == 1.0
    assert file_syntax(chunks(spark, rows).limit(0)).count() == 0
