"""Ordinary code of every language, written by hand: what compilers take must pass and what they refuse must not."""

import zipfile
from pathlib import Path

import pyspark
import pytest

from lodeseam.llm.docpairs import file_pairs
from lodeseam.llm.provenance import provenance
from lodeseam.llm.syntax import parses

VALID = {
    "java": r'''
enum Color { RED, GREEN, BLUE; }
####
enum Level { LOW(1), HIGH(2); private final int v; Level(int v) { this.v = v; } int v() { return v; } }
####
package a.b;
public enum Op implements IntBinaryOperator {
    PLUS("+") {
        @Override public int applyAsInt(int a, int b) { return a + b; }
    },
    MINUS("-") {
        @Override public int applyAsInt(int a, int b) { return a - b; }
    };
    private final String sign;
    Op(String sign) { this.sign = sign; }
}
####
enum Empty { }
enum Only { ; static int x; }
enum Trailing { A, B, }
enum Noted { @Deprecated A, @Ann(x = 1) B(2); }
####
public class Box<T extends Comparable<? super T> & Cloneable> {
    private T value;
    private static final Map<String, Map<Integer, List<String>>> CACHE = new ConcurrentHashMap<>();
    public Box(T value) { this.value = Objects.requireNonNull(value, "value"); }
    public <R extends Comparable<R>> Box<R> map(Function<? super T, ? extends R> f) { return new Box<>(f.apply(value)); }
    public boolean less(Box<T> other) { return value.compareTo(other.value) < 0 && other.value != null; }
    int compare(int a, int b, int c) { return a < b ? -1 : a > c ? 1 : 0; }
    boolean both(int a, int b, int c, int d) { return a < b && c > d; }
    void call(int a, int b, int c, int d) { check(a < b, c > d); }
}
####
class Loops {
    int run(List<int[]> rows) {
        int sum = 0;
        outer:
        for (int[] row : rows) {
            for (int i = 0, n = row.length; i < n; i++) {
                if (row[i] < 0) continue outer;
                else if (row[i] > 99) break outer;
                sum += row[i] << 2 >>> 1;
            }
        }
        int k = 10;
        while (k-- > 0) sum ^= k;
        do { sum--; } while (sum > 1_000 || sum == 0x1F);
        for (;;) { break; }
        return (int) (sum * 1.5e3f) + (byte) 3 - 'a' + "x".length();
    }
}
####
class Switches {
    String name(Object o) {
        switch (o.hashCode()) {
            case 1:
            case 2:
                return "a";
            default:
                break;
        }
        return switch (o) {
            case Integer i when i > 3 -> "big";
            case String s -> { yield s; }
            case Point(int x, var y) -> "p" + x;
            case null, default -> throw new IllegalStateException("no " + o);
        };
    }
    int days(Month m) {
        return switch (m) { case FEB -> 28; case APR, JUN, SEP -> 30; default -> 31; };
    }
}
####
@FunctionalInterface
public interface Shape extends Comparable<Shape>, java.io.Serializable {
    double PI = 3.14;
    double area();
    default String label() { return getClass().getSimpleName(); }
    static Shape unit() { return () -> 1.0; }
    private void hidden() {}
    record Circle(double r) implements Shape { public double area() { return Math.PI * r * r; } }
    sealed interface Poly permits Square, Triangle {}
    non-sealed class Square implements Poly {}
}
####
import java.util.*;
import static java.util.stream.Collectors.toList;
class Streams {
    List<String> f(Collection<? extends Item> items) {
        return items.stream().filter(i -> i.age() > 3).map(Item::name).sorted(Comparator.comparing(String::length).reversed()).collect(Collectors.<String>toList());
    }
    Supplier<int[]> g = () -> new int[] {1, 2, 3};
    Runnable r = () -> { synchronized (this) { notifyAll(); } };
    BiFunction<Integer, Integer, Integer> add = (final Integer a, Integer b) -> a + b;
    Object[][] grid = {{1, "a"}, {}, new Object[0]};
    int[] a[] = new int[3][];
    Class<?> c = int[].class, d = String.class, e = void.class;
    static { try (var in = open(); Reader r2 = wrap(in)) { in.read(); } catch (IOException | RuntimeException ex) { throw new Error(ex); } finally { done(); } }
    { count = 0; }
    Iterator<T> it() { return new Iterator<T>() { int i; public boolean hasNext() { return i < n; } public T next() { return data[i++]; } }; }
    <T> void generic(T... xs) throws IOException, E { this.<String>call("x"); List.<String>of(); Outer.this.x(); outer.new Inner(); super.generic(xs); }
    boolean is(Object o) { return o instanceof String s && !s.isEmpty() || !(o instanceof Integer); }
    int assertive(int x) { assert x > 0 : "x " + x; return -x + ~x + +x; }
    String block = """
        {"a": "b"}
        """;
    char q = '\'', u = '\u00e9', n = '\n';
    long big = 0xFFFF_FFFFL, bin = 0b1010, oct = 017;
    double h = 1e-9, f2 = .5, f3 = 1.f, hex = 0x1.8p1;
    public @interface Ann { String[] value() default {"a", "b"}; int n() default 3; Class<?> c() default Object.class; }
    @Ann({"x", "y"}) @SuppressWarnings("unchecked") void annotated(@NonNull final String s, @Ann(value = "x", n = 2) int... rest) { }
    final int x = cond ? a : b ? c : d;
    List<? super Integer>[] arr;
    void local() { class L { } record R(int a) { R { if (a < 0) throw new X(); } } final var v = 1; int i = 0, j; i = j = 3; i += 2; (i)++; label: { break label; } ; }
    void gen() { Map.Entry<String, List<Integer>> e = m.entrySet().iterator().next(); for (Map.Entry<String, Integer> x : m.entrySet()) { } for (final String s : list) { } boolean b = i < j; foo((List<String>) o); var t = (Function<A, B> & Serializable) z -> z; }
}
####
class Consts {
    static final int A = 1;
    static final int B = 2;
    public static final String NAME = "x";
    protected volatile int c;
    transient Object d = null;
    native void e();
    abstract static class In { abstract int f(); protected In() { super(); } }
}
####
package com.example;

import java.util.List;

/** Javadoc. */
public final class Main {
    public static void main(final String[] args) throws Exception {
        if (args.length == 0) {
            System.err.println("usage");
            return;
        } else if (args[0].equals("-v")) {
            System.out.printf("%s%n", args[0]);
        } else {
            new Main().run(List.of(args));
        }
        int[] xs = new int[args.length];
        xs[0]++;
        --xs[1];
        xs[2] = xs[1] = 3;
        String s = args.length > 1 ? args[1] : null;
        Thread t = new Thread(() -> System.out.println("x"));
        t.start();
        lock.lock();
        try {
            work();
        } finally {
            lock.unlock();
        }
        throw new IllegalArgumentException("bad: " + s, cause);
    }
}
''',
    "javascript": r'''
if (x) /re[/]x/.test(s);
####
while (ok) /a/g.exec(b)
####
const { a, b: { c = 1 }, ...rest } = obj, [d, , e = 2, ...f] = arr;
####
export const pipe = (...fns) => (x) => fns.reduce((v, f) => f(v), x);
export function* ids() { let i = 0; while (true) yield i++; }
export default async () => { await x; };
####
import def, * as ns from "./a.js";
import { default as z } from "./b.js";
import "./side.js";
import data from "./d.json" with { type: "json" };
export * as q from "./c.js";
export { a as b };
export default { name: "x", data() { return { n: 1 }; }, get y() { return 1; }, set y(v) {}, async *g() {}, [k + 1]: 2, "s-t": 3, 4: 5, ...o };
####
class A extends (B ?? C) {
  static x = 1;
  #p = 2;
  static async *gen() {}
  static { this.y = 3; }
  get v() { return this.#p; }
  set v(n) { this.#p = n; }
  static get = 4;
  async = 5;
  'quoted'() {}
  [Symbol.iterator]() { return this; }
  has(o) { return #p in o; }
  constructor() { super(); new.target; super.m(); }
}
####
let re = a / b / c, r2 = x ? /y/ : /z/i, r3 = [/a/, /b/u];
const f = x => /[/\]]+/.test(x);
return_ = 1;
####
let t = `a ${`b ${c ? `d ${e}` : ''}`} f`, tag = html`<b>${x}</b>`;
####
var i = 0
for (const k in o) if (o.hasOwnProperty(k)) { i++ } else continue
for (let j = 0, n = a.length; j < n; ++j) ;
for await (const x of xs) { f(x) }
for (;;) { if (i > 3) break }
for (x.y of z) {}
do { i-- } while (i > 0)
label: while (1) { break label }
switch (a) { case 1: case 2: { b() } break; default: c() }
try { a() } catch { b() } finally { c() }
try { a() } catch ({ message }) { b(message) }
if (a) b(); else if (c) d(); else { e() }
throw new Error(`bad ${x}`)
####
x ||= 1; y &&= 2; z ??= 3; w **= 2; q >>>= 1; a = b = c;
[a, b] = [b, a];
({ a, b } = c);
(a, b);
a?.b?.[c]?.(d);
delete a.b, void 0, typeof a === 'x';
!a; -a; +a; ~a; i++; --i;
a ? b : c ? d : e;
n = 0xFF + 0b11 + 0o17 + 1_000 + 10n + .5 + 5. + 1e-3;
new Foo; new Foo.Bar(1); new (f())(); new Foo().bar();
(function () { return 1 })();
(() => {})();
!function () {}();
async function g() { for (const x of await y) { } const r = await Promise.all([a(), b()]); return { ...r } }
const h = async x => { await x }, k = async (a, b) => a + b;
var let_ = 1, of = 2, get = 3, set = 4, async = 5, from = 6, static_ = 7;
of(get, set, async, from);
const o = { get, set, async, of, from, async x() {}, get: 1, set: 2, async: 3, get a() { return 1 }, if: 1, class: 2, new: 3 };
o.if.class.new.delete();
####
#!/usr/bin/env node
'use strict'
const a = 1
const b = a
  .map(x => x)
  .filter(Boolean)
const s = a
  ? b
  : c
foo(a,
  b,
)
let x
let y = 1, z
;[1, 2].forEach(f)
;(function () {})()
export {}
####
const fn = function named(a, b = 1, { c } = {}, ...d) { return a < b && c > d };
const cmp = (a, b) => a < b ? -1 : a > b ? 1 : 0;
if (a < b || c > d) { f(a < b, c > d) }
const esc = '\'' + "\"" + '\u{1F600}' + "\
";
const deep = { a: { b: { c: [{ d: () => ({}) }] } } };
const longer = a
  && b
  || !c;
promise.then(r => r.json()).then(({ data }) => { set(data) }).catch(console.error);
while (i--) a[i] = b[i];
var fnExpr = async function* () { yield* a; };
function outer() { function inner() { return; } return inner; }
const obj = { 'a': 1, "b": 2, c };
export let m1 = 1, m2;
export class Z {}
export function ff() {}
export async function gg() {}
export default class {}
####
const html = "<div>" + '</div>';
// comment with ' and "
/* block ` */
const d1 = x / 2;
const d2 = (x) / 2;
const d3 = a[0] / b / 2;
const d4 = f() / 2 / g;
const r1 = s.replace(/'/g, "\\'").replace(/"/g, '\\"').split(/\s*,\s*/);
const r5 = !/x/.test(y) && /z/.test(w) || typeof /q/ === 'object';
const r6 = { re: /a{2,}/, f: () => /b}/ };
function q() { return /}/.test(s) }
case_ = /=/;
arr = [/,/, /\//];
i = x++ / 2;
''',
    "typescript": r'''
type Mutable<T> = { -readonly [K in keyof T]: T[K] };
type Ro<T> = { readonly [K in keyof T]: T[K] };
type Opt<T> = { [K in keyof T]?: T[K] };
type Req<T> = { [K in keyof T]-?: T[K] };
type Get<T> = { [K in keyof T as `get${Capitalize<K & string>}`]: () => T[K] };
####
@Component({ selector: "app", template: `<b>x</b>` })
export class AppComponent {
  @Input() name: string = "";
  @Output() changed = new EventEmitter<string>();
  constructor(private readonly http: HttpClient, @Inject(TOKEN) public token?: string) {}
}
####
@Injectable()
class S {}
@a @b() @c.d({ x: [1, 2] })
export default class T {}
export @dec class U {}
####
interface P {
  get x(): string;
  set x(v: string);
  readonly y?: number;
  new (a: string): P;
  (b: number): void;
  [key: string]: unknown;
  m?(z: number): void;
  get: string;
  set(v: number): void;
}
####
type A = string | number | undefined;
type B = { a: string; b?: number } & C;
type D = T extends (infer U)[] ? U : never;
type F = (a: string, ...rest: number[]) => void;
type G = new (...args: any[]) => object;
type H = typeof x;
type I = keyof typeof y;
type J = [a: string, b?: number, ...rest: boolean[]];
type K = readonly string[];
type L = `a-${string}`;
type M = A["x"]["y"][number];
type N = | "a" | "b";
type O = unique symbol;
type Q = asserts_ | null;
type R = Promise<Map<string, Array<{ a: number }>>>;
type S = T extends { a: infer X extends string } ? X : T extends null ? 1 : 2;
type U = import("./x").Y<string>;
type V = abstract new () => void;
type W = (typeof list)[number];
type X = -1 | 1 | true;
type Fn<T = {}> = <U>(x: U) => T;
####
function f<T extends object = {}>(this: Window, a: T, b?: string, c: number = 1, ...d: any[]): a is T & { x: 1 } { return true; }
function over(a: string): string;
function over(a: number): number;
function over(a: any) { return a; }
const g = <T,>(x: T): T => x;
const h = async <T extends U>(x: T): Promise<T> => { return x as T; };
const i = (x as unknown as string[])!.map((y): number => y.length);
let v = <string>x;
let j: number | undefined, k!: string;
const l = { a: 1 } as const satisfies Record<string, number>;
const m = new Map<string, number[]>([["a", [1]]]);
const n = a < b && c > d;
call(a < b, c > d);
if (a < b || c > d) {}
const o = f<string>("x"), p = f<string, number>(1);
for (const [q, r] of Object.entries<number>(s)) {}
const t = x?.y![0]?.z!();
####
export abstract class Repo<T extends { id: string }> extends Base<T> implements A, B<T> {
  private static readonly x: number = 1;
  protected abstract y: string;
  declare z: number;
  readonly #p: string[] = [];
  public static async create<T>(this: new () => T): Promise<T> { return new this(); }
  abstract find(id: string): Promise<T | undefined>;
  get size(): number { return 1; }
  set size(v: number) {}
  constructor(protected a: string, private b?: number) { super(a); }
  method?(): void;
  [key: string]: any;
  override toString(): string { return ""; }
  private handler = (e: Event): void => { this.x; };
  private async *gen(): AsyncGenerator<number> { yield 1; }
  static { }
}
####
enum E { A, B = 2, C = "x", D = A | B, "e-f" = 3 }
const enum CE { X = 1 << 2 }
declare enum DE { Q }
export enum EE { A = `a`.length }
namespace N.M { export const a = 1; }
declare module "x" { export function f(a: string): void; export default f; }
declare global { interface Window { x: number } }
declare const VERSION: string;
declare function d(a: number): string;
declare let a1: any, b1: string;
import type { A } from "./a";
import { type B, C } from "./b";
import D = require("d");
import fs = N.M;
export type { A };
export type { Z } from "./z";
export = D;
export as namespace Foo;
export import Q = N.M;
abstract class K {}
export default interface I {}
export declare class DC { m(): void; }
####
const x = {
  a<T>(y: T): void {},
  async b(): Promise<void> {},
  get c(): string { return ""; },
  d: (z: string): void => {},
  e: <T>(w: T) => w,
};
let fnType: (a: number) => (b: string) => void = (a) => (b) => {};
let obj: { a: string, b: number; c?(): void } | null = null;
let arr: Array<string | number>[] = [], tup: [string, number] = ["a", 1];
let opt = a ? (b) : c;
let cond = a ? (b: string) => c : d;
let u: unknown = JSON.parse(s) as { a?: string }[];
export const sel = (s: State) => s.a;
export const thunk = (): Thunk<void> => async (dispatch, getState) => { dispatch({ type: "x" }); };
type State = ReturnType<typeof reducer>;
try { f(); } catch (e: unknown) { if (e instanceof Error) throw e; }
let type = 1, of = 2, as = 3, is = 4, declare = 5, module = 6, abstract = 7, readonly = 8;
type = 2; module.exports = type; abstract(declare);
for (let i = 0; i < n; i++) { a[i] = i as any; }
function assertIsString(val: any): asserts val is string {}
function assertTruthy(val: any): asserts val {}
let big = 10n, regex = /a<b>/g;
let y1 = (await import("./x")).default;
class P1<in out T> { accessor z = 1; }
export { x as default, type T1 };
let z1 = a! + b!; let w1 = a!.b!.c;
using(res);
''',
    "go": r'''
package main

import "fmt"

const (
	A = iota
	B
	_
	C, D = iota, "x"
)

var (
	x, y int = 1, 2
	z        = map[string][]int{"a": {1, 2}, "b": nil}
	fn       = func(a, b int) (int, error) { return a + b, nil }
	e        error
)

type (
	ID   string
	Pair struct{ A, B int }
	F    func(int, ...string) (n int, err error)
)

type Number interface {
	~int | ~int64 | float64
	fmt.Stringer
	M(x int) (y string)
}

type List[T any, K comparable] struct {
	head *node[T]
	m    map[K]T `json:"m,omitempty"`
	*Embedded
	pkg.Other
	fn func()
	ch <-chan int
	c2 chan<- struct{}
	arr [4]byte
	any interface{}
}

func (l *List[T, K]) Push(v T) { l.head = &node[T]{v: v, next: l.head} }
func (List[T, K]) Len() int { return 0 }
func Map[T, U any](xs []T, f func(T) U) []U {
	out := make([]U, 0, len(xs))
	for _, x := range xs {
		out = append(out, f(x))
	}
	return out
}
func noBody(a int) string
func variadic(a string, rest ...interface{}) (err error) {
	defer func() {
		if r := recover(); r != nil {
			err = fmt.Errorf("x: %v", r)
		}
	}()
	return
}

func main() {
	if v, ok := z["a"]; ok && len(v) > 1 || !ok {
		fmt.Println(v[0], v[1:], v[:2], v[1:2:3])
	} else if x := 3; x < 4 {
		return
	} else {
		panic("x")
	}
	for i := 0; i < 10; i++ {
		continue
	}
	for i := range 10 {
		_ = i
	}
	for range xs {
	}
	for x < 3 {
		x++
	}
	for {
		break
	}
	switch {
	case x > 1, y < 2:
		fallthrough
	default:
	}
	switch v := i.(type) {
	case nil:
	case *int, []string, map[string]int, func(int) error:
	case error:
		_ = v
	}
	switch x := f(); x {
	case 1:
	}
	select {
	case v := <-ch:
		_ = v
	case v, ok := <-ch:
	case ch <- 1:
	case <-time.After(time.Second):
	default:
	}
	go func(a int) { ch <- a }(1)
	defer mu.Unlock()
	a, b := 1, 'x'
	a, b = b, a
	p := &Pair{A: 1, B: 2}
	q := []Pair{{1, 2}, {A: 3}}
	r := [...]int{1, 2, 5: 3}
	m := map[Pair]string{{1, 2}: "a"}
	s := struct{ X int }{1}
	t := x.(int)
	u, ok := x.(interface{ M() })
	*p = Pair{}
	p.A += 2
	x <<= 1
	x &^= 2
	y = -x ^ ^y + +1
	str := `raw
	string`
	w := "a" + "b\"c" +
		"d"
	c := 1.5e3 + 0x1F + 0b11 + 0o17 + 1_000 + 2i
	f := func() {}
	f()
	func() { fmt.Println("x") }()
	var arr [3][4]int
	arr[0][1] = 2
	l := List[int, string]{}
	Map[int, string](nil, nil)
	n := (*Pair)(nil)
	o := []byte("x")
	g := chan int(nil)
	h := interface{}(3)
	if a < b && c > d {
	}
	if x == (Pair{1, 2}) {
	}
	if f(Pair{1, 2}) {
	}
	foo(a < b, c > d)
	fmt.Printf(
		"%s",
		x,
	)
loop:
	for {
		goto loop
		break loop
	}
	{
		x := 1
		_ = x
	}
	type local struct{ a int }
	const k = 1
	var (
		v1 int
	)
	return
}
####
package a
type E int
const (
	E1 E = iota + 1
	E2
	E3
)
func (e E) String() string {
	return [...]string{"a", "b"}[e]
}
var _ fmt.Stringer = (*E)(nil)
var errNotFound = errors.New("not found")
func init() {}
type Opt func(*cfg)
func With(x int) Opt { return func(c *cfg) { c.x = x } }
func g() (func(), error) { return nil, nil }
func h(f func(a, b int) bool, m map[string]interface{}) <-chan []byte { return nil }
type G[T ~[]E, E cmp.Ordered] interface{ Do(T) E }
func k[K comparable, V int | float64](m map[K]V) (s V) { for _, v := range m { s += v }; return s }
''',
    "rust": r'''
fn cmp(a: i32, b: i32, c: i32, d: i32) -> bool { a < b && c > d }
####
fn call(a: i32) { g(a < b, c > d); let x = a < b; if a < b || c > d { } let y = (a as i64) < b; while i < n { i += 1; } }
####
use std::{collections::HashMap, fmt::{self, Display}, io::prelude::*};
use crate::a::b as c;
use super::*;
pub use self::x::Y;
extern crate serde;
mod tests;
pub mod m { pub(super) fn f() {} }
#[derive(Debug, Clone, PartialEq)]
pub struct P<'a, T: 'a + Clone, const N: usize> where T: Display + Send, Vec<T>: Sized { pub a: &'a T, pub(crate) b: [u8; N], c: Option<Box<dyn Fn(i32) -> Result<(), String> + Send + 'static>> }
struct Unit;
struct Tup(pub i32, String);
#[repr(u8)]
enum E { A = 1, B(i32, String), C { x: u8, y: Vec<u8> }, #[serde(rename = "d")] D }
pub type R<T> = std::result::Result<T, Box<dyn std::error::Error>>;
const MAX: usize = 1 << 4;
static mut COUNT: u64 = 0;
static NAMES: [&str; 2] = ["a", "b"];
union U { a: u32, b: f32 }
####
impl<'a, T> Iterator for P<'a, T> where T: Clone { type Item = (usize, &'a T); fn next(&mut self) -> Option<Self::Item> { self.i += 1; Some((self.i, &self.v[self.i - 1])) } }
impl<T: Display> fmt::Display for W<T> { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "{}: {:?}", self.0, self.1) } }
unsafe impl Send for X {}
impl X { pub const fn new() -> Self { Self { a: 1, ..Default::default() } } pub async fn go(self: Arc<Self>, mut x: Vec<u8>) -> io::Result<()> { self.inner.lock().await?; Ok(()) } const Z: i32 = 3; }
trait Tr: Clone + Send + 'static { type Out: Default; const N: usize; fn f(&self) -> Self::Out; fn g(&self) -> i32 { 1 } fn h<F>(f: F) where F: FnOnce(&str) -> bool, Self: Sized; }
impl<F> Tr2 for F where F: Fn(&Request) -> Response + Send + Sync + 'static {}
impl From<io::Error> for E { fn from(e: io::Error) -> Self { E::Io(e) } }
####
fn main() -> Result<(), Box<dyn Error>> {
    let mut v: Vec<i32> = Vec::new();
    let (a, mut b) = (1, 2.5_f64);
    let [x, .., y] = arr;
    let P { a, b: c, .. } = p;
    let Some(z) = opt else { return Ok(()) };
    if let Some(x) = v.get(0) { println!("{x}"); } else if a == 1 { } else { }
    if let Ok(n) = s.parse::<i32>() && n > 3 { }
    while let Some(top) = stack.pop() { continue; }
    for (i, x) in v.iter().enumerate().filter(|(i, _)| i % 2 == 0) { }
    for i in 0..10 { } for i in (0..=n).rev() { }
    let r = match x { 0 => "a", 1 | 2 => "b", 3..=9 if a > 2 => { "c" } n @ 10..=20 => "d", -1 => "e", _ => unreachable!() };
    match self { Self::A => 1, E::B(a, _) => a, E::C { x, .. } => { x } &Some(ref q) => 2, (a, b) | (b, a) => 3, [] => 4, [first, rest @ ..] => 5, 'a'..='z' => 6, "s" => 7, Some(x) if x < 3 => 8, };
    let f = |a: i32, b| -> i32 { a + b };
    let g = move || x + 1; let h = |&(a, b)| a < b; let k = |x| async move { x.await };
    let s = format!("{} {}", a, b.c); let t = r#"raw "x""#; let u = b"bytes"; let w = br##"x"#"##; let c = 'x'; let nl = '\n'; let q = '\''; let l = '\u{1F600}';
    let n = 1_000u64 + 0xFF + 0b11 + 0o17 + 1e3 as u64; let fl = 1.0f32 * 2. ;
    let val = loop { break 3; };
    'outer: for a in b { loop { continue 'outer; } break 'outer; }
    let blk = { let a = 1; a + 1 };
    let cond = if a { 1 } else { 2 };
    v[0] += 1; *p = 3; self.x.y = z; x.0.1 = 3; (a, b) = (b, a);
    let sl = &v[1..]; let sl2 = &mut v[..n]; let all = &v[..];
    let arr = [0; 10]; let arr2 = [[1, 2], [3, 4]];
    let e = Foo::<T>::bar(&a)?.baz::<Vec<_>>()?; let m: HashMap<String, Vec<(i32, &str)>> = HashMap::new();
    let it = v.iter().map(|x| x * 2).collect::<Result<Vec<_>, _>>()?;
    let st = S { a, b: 1, c: vec![1, 2], ..d }; let tu = T(1, 2); let un = U; let p2 = <T as Default>::default();
    unsafe { *ptr = 1 } return Err("x".into());
    assert_eq!(a, b, "msg {}", c); vec![1; 3]; matches!(x, Some(_) | None);
    let neg = -a + !b; let dd = **a; let rr = &&a; let c2 = a as usize as u8; let sh = a << 2 >> 1; let rng = ..; let cl = a.b.c().d[1].e;
    let x = if let Some(y) = z { y } else { return Ok(()) }; let big = a.lt(&b) || a <= b && c >= d;
    x.iter().for_each(|y| { println!("{}", y); });
    let _ = std::mem::replace(&mut a, b); let f: fn(i32) -> i32 = g; let bx: Box<dyn Fn() -> ()> = Box::new(|| ());
    std::thread::spawn(move || { for i in 0..3 { tx.send(i).unwrap(); } });
    Ok(())
}
####
macro_rules! hash { ($($k:expr => $v:expr),* $(,)?) => {{ let mut m = HashMap::new(); $(m.insert($k, $v);)* m }}; }
#[cfg(test)]
mod tests {
    use super::*;
    #[test]
    #[should_panic(expected = "x")]
    fn it_works() { assert!(true); }
    #[tokio::test]
    async fn t() -> Result<()> { Ok(()) }
}
extern "C" { fn c_fn(a: *const u8, b: *mut i32) -> i32; static X: i32; }
pub extern "C" fn cb(x: i32) -> i32 { x }
pub(in crate::a) fn q<'a, T>(x: &'a mut T, f: impl Fn(&T) -> bool + 'a, g: &dyn Fn(i32)) -> impl Iterator<Item = &'a T> + 'a where T: ?Sized + for<'b> Foo<'b> { std::iter::empty() }
fn arr<const N: usize>(a: [u8; N], (b, c): (i32, i32), _: &str, mut d: u8) {}
fn never() -> ! { loop {} }
fn ptr(f: extern "C" fn(i32), g: fn(&str) -> String, t: (), u: (i32,), s: &[u8], v: &mut [T], w: *const c_void) {}
thread_local! { static A: RefCell<u32> = RefCell::new(1); }
lazy_static! { static ref RE: Regex = Regex::new("x").unwrap(); }
async fn a() { let x = async { b().await }; tokio::select! { _ = a() => {}, x = b() => {} } }
const fn sq(x: u32) -> u32 { x * x }
impl<const N: usize> A<N> { }
impl<T> Deref for B<T> { type Target = T; fn deref(&self) -> &T { &self.0 } }
type Cb = Box<dyn FnMut(&mut Ctx, u32) -> bool>;
pub trait Visitor { type R; fn visit(&mut self, n: &Node) -> Self::R; }
fn tern(x: u8) -> u8 { if x > 3 { 1 } else { 2 } }
fn chain() -> bool { a.b() && (c || d) && !e.f() }
fn idx(a: &[u32], i: usize) -> bool { a[i] < a[i + 1] && i < a.len() - 1 }
fn ge(x: Option<u8>) -> bool { x.map_or(false, |v| v < 3) }
fn rets(a: u8) -> Option<u8> { if a < 3 { return None; } Some(a) }
''',
    "python": r'''
async def f(a, /, b: int = 1, *args, c, **kw) -> "x":
    async with a as b, c:
        yield await d
        g = [x async for x in y if z]
    return
####
match x:
    case {"a": [1, *rest], **kw} if rest:
        pass
    case Point(x=0) | None:
        ...
type X[T] = list[T]
def g[T: int](x: T) -> T: return (y := x)
print(f"{x!r:>{width}} {'a'}")
''',
}
INVALID = {
    "java": r'''
class A { void f() { 1 = 2; } }
####
class A { void f() { f() = 2; } }
####
class A { void f() { 5++; } }
####
class A { void f() { ++g(); } }
####
enum E { A B }
####
enum E { A, B int x; }
####
class A { int f() { return 1 } }
####
class A { void f() { int x = ; } }
####
class A { void f() { if x > 1 { } } }
####
class A { void f() { for (int i = 0; i < 3) { } } }
####
class A { void f() { foo(1,); } }
####
class A { void f() { String s = "abc; } }
####
class A { void f() { else { } } }
####
class A { void f() { try { } } }
####
class A { void f() { case 1: break; } }
####
class A extends { }
####
class A { public void () { } }
####
class A { void f( { } }
####
class A { int x = 1, ; }
####
class { }
####
class A { void f() { new ; } }
####
class A { void f() { a.; } }
####
class A { void f() { switch (x) { int y; } } }
####
clas A { }
####
class A { } }
####
class A { void f() { a + ; } }
####
class A { private public2 void f() { } }
####
import java.util.List
class A { }
####
class A { void f() { do { } while (x) } }
####
class A { void f() { int[] a = {1 2}; } }
####
class A { fun g(): int {} }
####
class A { void f() { char c = 'ab'; } }
####
class A { void f() { int class = 3; } }
''',
    "javascript": r'''
1 = 2;
####
f() = 2;
####
5++;
####
++f();
####
return 1;
####
break;
####
continue;
####
if (x) { import a from "b"; }
####
{ export const a = 1; }
####
x = 010;
####
a + = b;
####
const x;
####
let { a };
####
let let = 1;
####
for (const x of) {}
####
function (a) { }
####
class { }
####
class A { x: 1 }
####
var a = [1, 2;
####
foo(1, , 2);
####
const a = { b c };
####
const a = { b: };
####
if (a { }
####
x => { } + 1
####
let a = 1 let b = 2
####
try { }
####
switch (a) { b }
####
"abc
####
`abc
####
a ?? ;
####
new.foo;
####
import { a b } from "x";
####
export { a;
####
function f(a, a.b) {}
####
with (a) { }
####
if (a) { } else else { }
####
while () { }
####
for (;;;) { }
####
async function f() { await }
####
x = { get a { } };
####
throw
x;
####
let x: string = "a";
####
function f(a: string) {}
####
interface A { }
####
@@x
####
a = b ? c;
####
var 1a = 2;
####
delete;
####
(a, b) = 1;
####
a && b = c;
####
-x = 3;
####
for (1 of x) {}
####
x++ ++;
####
this = 1;
####
[1] = x;
####
({ a: 1 } = x);
####
function f() { yield 1 }
''',
    "typescript": r'''
1 = 2;
####
return 1;
####
let x: = 1;
####
type A = ;
####
interface A { x y }
####
class A { private }}
####
function f(a: string b: number) {}
####
enum E { A = }
####
type = { a: }
####
let x: number = ;
####
const f = (a: string => a;
####
interface { a: string }
####
class A extends { }
####
import { a } form "b";
####
let a = <string;
####
export const = 1;
####
type A<T = string;
####
f(a: string);
####
abstract class { }
####
enum { A }
####
namespace { }
####
let x: string | ;
####
let x: [string, ;
####
if (x) { type }}
####
function f(): { return 1; }
####
@ class A {}
''',
    "go": r'''
package a
func f() { x++ + 1 }
####
package a
func f() { return
####
package a
func f() { if x == 1 return }
####
package a
x := 1
####
package a
func f()
{
}
####
package a
func f() { var x }
####
package a
func f() { for i := 0; i < 3 { } }
####
package a
import fmt
####
package a
func f(a int b int) {}
####
package a
type T struct { a int, b int }
####
package a
func f() { x = [1, 2] }
####
package a
func f() { if x { } 
else { } }
####
package a
func f() { fmt.Println("a" "b") }
####
package a
func f() { a := }
####
package a
func f() { while x { } }
####
package a
func f() { f() = 1 := 2 }
####
package a
func () { }
####
package a
func f() { "a" := 2 }
####
package a
func f() { x = 'ab' }
####
package a
func f() { switch x { a() } }
####
package a
func f() { go x }
####
package a
func f() { a, b }
####
package a
func f() { foo(1,, 2) }
####
package a
func f() { foo(
	1
) }
####
package a
var x int := 1
####
package a; import "x"; func f() {}; import "y"
####
import "x"
func f() {}
''',
    "rust": r'''
fn f() { let x = }
####
fn f() { let = 1; }
####
fn f() { x = = 1; }
####
fn f(a i32) {}
####
fn f() -> { }
####
struct S { a: i32 b: i32 }
####
enum E { A B }
####
fn f() { if x == 1 return; }
####
fn f() { for x y { } }
####
fn f() { match x { 1 2 } }
####
fn f() { match x { 1 => } }
####
fn f() { foo(1 2); }
####
fn f() { let x: = 1; }
####
impl { }
####
fn f() { a.; }
####
fn f() { "abc }
####
fn f() { let x = 1 let y = 2; }
####
fn f() { [1, 2; }
####
fn () { }
####
let x = 1;
####
x = 1;
####
fn f() { 1 + ; }
####
fn f() { else { } }
####
use a::;
####
pub fn f() { x +/ y; }
####
fn f() { int x = 1; }
####
fn f() { let x := 1; }
####
fn f() { a ? b : c; }
####
fn f(x) {}
####
fn f() { while { } }
####
fn f() { x++ ; }
####
struct { a: u8 }
####
fn f() { return 1 2; }
####
trait T { fn f() return 1; }
''',
    "python": r'''
print "x"
####
def f(a=1, b): pass
####
1 = x
####
f() = 2
####
return 1
####
def f():
  x = 1
 y = 2
####
await x
####
break
####
class A
  pass
####
x = 010
''',
}


def cases(corpus):
    return [(language, text.strip("\n") + "\n") for language, texts in corpus.items() for text in texts.split("\n####\n")]


@pytest.mark.parametrize("language,text", cases(VALID))
def test_compilers_take_it(language, text):
    assert parses(text, language), text


@pytest.mark.parametrize("language,text", cases(INVALID))
def test_compilers_refuse_it(language, text):
    assert not parses(text, language), text


SPARK = Path(pyspark.__path__[0])


def test_scripts_that_spark_ships_parse():
    """Pages of Spark and the libraries that they use, minified or not, as JavaScript and as TypeScript."""
    jars = sorted(SPARK.glob("jars/spark-core_*.jar"))
    if not jars:
        pytest.skip("no jar of Spark")
    with zipfile.ZipFile(jars[0]) as jar:
        scripts = {n: jar.read(n).decode("utf-8", "replace") for n in jar.namelist() if n.endswith(".js")}
    assert len(scripts) > 20
    for name, text in scripts.items():
        assert parses(text, "javascript") and parses(text, "typescript"), name
        assert not parses(text + "\n}) function", "javascript"), name
        own = provenance(f"/x/src/{name}", text, "spark")
        assert own in ("vendored", "minified") if ".min." in name else own is None, (name, own)


def test_sources_of_pyspark():
    """They all parse, generated modules are named, and hardly any of the others is."""
    named, others = [], 0
    for path in sorted(SPARK.rglob("*.py")):
        text = path.read_text(encoding="utf-8")
        verdict = provenance(f"/x/src/{path.relative_to(SPARK)}", text, "spark")
        generated = "_pb2" in path.name or path.name == "shared.py"
        assert not generated or verdict == "generated", path
        others += not generated
        if verdict and not generated:
            named.append(path.name)
        assert file_pairs(str(path), text) is not None, path
    assert len(named) <= 0.01 * others, named
