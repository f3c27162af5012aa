"""Goldens of the source reader: hand-made files with strings, comments, generics and nesting in each language."""

from larkspur.functions.source import parse, tokenize


def got(source, lang):
    s, c, i = parse(source, lang)
    return (
        [(x["name"], x["kind"], x["line_start"], x["line_end"], x["parent"]) for x in s],
        [(x["callee_name"], x["call_line"], x["call_type"]) for x in c],
        [(x["imported_module"], x["import_line"]) for x in i],
    )


RUST = """use std::collections::{HashMap, HashSet};
use crate::util as u;
use serde::*;

/// The store.
/// Two lines.
#[derive(Debug, Clone)]
pub struct Store<T> {
    items: HashMap<String, T>,
}

pub(crate) const LIMIT: usize = 10;
static mut COUNT: u32 = 0;
type Pair<'a> = (&'a str, char);

impl<T: Clone + Into<String>> Display for Store<T> where T: Send {
    // fn hidden() { nothing(); }
    pub async fn fetch<'a, F: Fn(u8) -> bool>(&'a self, key: &str) -> Option<T> {
        let text = "call(\\"not\\") { }"; let c = '{'; let r = r#"raw "quoted" call()"#;
        /* outer /* nested() */ still() */
        if let Some(found) = self.items.get(key) {
            println!("{}", key.len());
            return Some(found.clone());
        }
        match c { Ok(x) => u::run(x), Err(e) if e.bad() => vec![], _ => Vec::<u8>::with_capacity(3) };
        const INNER: u8 = 1;
        fn local() {}
        None
    }
}

trait Show { fn show(&self); fn twice(&self) -> u8 { self.show(); 2 } }
mod inner { pub fn deep() { super::top(|x| x.map(y)); } }
enum Kind { A(u8), B }
macro_rules! make { ($x:expr) => { build($x) }; }
"""


def test_rust():
    s, c, i = got(RUST, "rust")
    assert s == [
        ("Store", "class", 8, 10, None), ("LIMIT", "constant", 12, 12, None), ("COUNT", "constant", 13, 13, None), ("Pair", "type", 14, 14, None), ("fetch", "method", 18, 29, "Store"),
        ("INNER", "constant", 26, 26, "Store"), ("local", "function", 27, 27, "Store"), ("Show", "interface", 32, 32, None), ("twice", "function", 32, 32, None), ("inner", "module", 33, 33, None), ("deep", "function", 33, 33, "inner"), ("Kind", "enum", 34, 34, None),
    ]
    assert c == [
        ("get", 21, "method"), ("println", 22, "macro"), ("len", 22, "method"), ("Some", 23, "direct"), ("clone", 23, "method"), ("run", 25, "qualified"), ("bad", 25, "method"), ("vec", 25, "macro"), ("with_capacity", 25, "qualified"),
        ("show", 32, "method"), ("top", 33, "qualified"), ("map", 33, "method"),
    ]
    assert i == [("std::collections", 1), ("crate::util", 2), ("serde", 3)]
    store, *_, = parse(RUST, "rust")[0]
    assert store["docstring"] == "The store.\nTwo lines." and store["visibility"] == "public"
    fetch = parse(RUST, "rust")[0][4]
    assert fetch["signature"] == "(&'a self, key: &str) -> Option<T>" and fetch["docstring"] == "fn hidden() { nothing(); }"


TS = """import { a as b } from './util';
import type { T } from "types";
import 'side-effect';
const fs = require('fs');
/** Opens boxes.
 *  Carefully. */
export abstract class Box<T extends Base> extends make(Base) {
  private count = start(0);
  static #hidden: number;
  constructor(private readonly x: number, cb = () => init(1)) { super(x); this.log(`n ${this.fmt(x)} } call()`); }
  @memo({ deep: wrap() })
  public async open<K>(n: number): Promise<Map<K, string>> {
    if (/a(b)\\/[/]{2}/.test(n)) { return new Map<K, string>(); }
    return other?.go(n) ?? fallback(n)
  }
  get size(): number { return this.count }
  abstract later(n: number): void;
}
export const twice = (x: number) => x * 2, plain = 3
let many: number[] = [1, 2].map((y) => y + one(y))
for (const item of items) { use(item) }
export default async function* main<T>(args: string[]): AsyncGenerator<T> { yield* run(args); }
interface Shape { area(): number; name: string }
export type Fn<T> = (x: T) => void
export enum Color { Red = 1, Green = calc() }
const f = function named() { inner() };
new Worker;
new ns.Pool(4);
if (a < b && c > (d)) { typeof check(a); }
namespace Geo { export function far() { return near.by() } }
"""


def test_typescript():
    s, c, i = got(TS, "typescript")
    assert s == [
        ("fs", "variable", 4, 4, None), ("Box", "class", 7, 18, None), ("constructor", "method", 10, 10, "Box"), ("open", "method", 12, 15, "Box"), ("size", "method", 16, 16, "Box"),
        ("twice", "function", 19, 19, None), ("plain", "variable", 19, 19, None), ("many", "variable", 20, 20, None), ("main", "function", 22, 22, None), ("Shape", "interface", 23, 23, None), ("Fn", "type", 24, 24, None), ("Color", "enum", 25, 25, None),
        ("f", "variable", 26, 26, None), ("Geo", "module", 30, 30, None), ("far", "function", 30, 30, "Geo"),
    ]
    assert [x for x in c if x[0] != "require"] == [
        ("start", 8, "direct"), ("init", 10, "direct"), ("log", 10, "method"), ("fmt", 10, "method"), ("test", 13, "method"), ("Map", 13, "constructor"), ("go", 14, "method"), ("fallback", 14, "direct"),
        ("map", 20, "method"), ("one", 20, "direct"), ("use", 21, "direct"), ("run", 22, "direct"), ("inner", 26, "direct"), ("Worker", 27, "constructor"), ("Pool", 28, "constructor"), ("check", 29, "direct"), ("by", 30, "method"),
    ]
    assert i == [("./util", 1), ("types", 2), ("side-effect", 3), ("fs", 4)]
    box, make = parse(TS, "typescript")[0][1], parse(TS, "typescript")[0][3]
    assert box["docstring"] == "Opens boxes.\nCarefully." and make["signature"] == "(n: number): Promise<Map<K, string>>" and make["visibility"] == "public"


def test_javascript():
    s, c, i = got("class A { go() { return a / b(c) / d } }\nvar x = { m() { k() } }\nfunction g(type) { let type2 = type; }\nexport { x } from './y'\n", "javascript")
    assert s == [("A", "class", 1, 1, None), ("go", "method", 1, 1, "A"), ("x", "variable", 2, 2, None), ("g", "function", 3, 3, None), ("type2", "variable", 3, 3, None)]
    assert ("b", 1, "direct") in c and ("k", 2, "direct") in c and i == []


GO = """package main

import (
	"fmt"
	str "strings" // alias
)
import "os"

// Box holds.
type Box[T any] struct {
	items []T
	f func(int) string
}
type (
	Shape interface { Area(x int) float64 }
	ID = string
)
const (
	First, second = iota, 2
	Third
)
var Default = New(`raw "call()"`)

/* Open opens. */
func (b *Box[T]) Open(x int, f func(int) error) (n int, err error) {
	defer b.mu.Unlock()
	go func() { work('(') }()
	v := map[string]interface{}{"k": make([]int, 3)}
	switch x { case 1: return fmt.Println(len(v)), nil }
	return f(x), nil
}

func New(s string) *Box[int] { return &Box[int]{} }
"""


def test_go():
    s, c, i = got(GO, "go")
    assert s == [
        ("Box", "class", 10, 13, None), ("Shape", "interface", 15, 15, None), ("ID", "type", 16, 16, None), ("First", "constant", 19, 19, None), ("second", "constant", 19, 19, None), ("Third", "constant", 20, 20, None),
        ("Default", "variable", 22, 22, None), ("Open", "method", 25, 31, "Box"), ("New", "function", 33, 33, None),
    ]
    assert c == [("New", 22, "direct"), ("Unlock", 26, "method"), ("work", 27, "direct"), ("make", 28, "direct"), ("Println", 29, "method"), ("len", 29, "direct"), ("f", 30, "direct")]
    assert i == [("fmt", 4), ("strings", 5), ("os", 7)]
    rows = {x["name"]: x for x in parse(GO, "go")[0]}
    assert rows["Open"]["signature"] == "(x int, f func(int) error) (n int, err error)" and rows["Open"]["docstring"] == "Open opens." and rows["second"]["visibility"] == "private" and rows["Box"]["docstring"] == "Box holds."


JAVA = """package a.b;
import java.util.List;
import static java.lang.Math.*;

/** Doc. */
@Entity(name = "call()")
public final class Store<T extends Comparable<T>> extends Base implements Closeable {
    private static final Map<String, List<T>> CACHE = new HashMap<>(size());
    int a = 1, b;
    static { init("}"); }

    @Inject
    public Store(@Named("x") int a) { super(a); this.b = helper.make(a); }

    @Override
    public <K> Map<K, T> load(List<? extends K> keys) throws IOException {
        String s = \"\"\"
            text call() {
            \"\"\";
        Runnable r = () -> go(new Task<K>(keys) { void run() { inside(); } });
        return keys.stream().map(Store::of).collect(toMap());
    }
    abstract int count();
    enum Color { RED(1), GREEN { int f() { return g(); } }; private final int v = 0; Color() {} int v() { return v; } }
    interface Shape { double area(int x); default void draw() { paint(); } }
    record Point(int x, int y) { int sum() { return x + y; } }
}
"""


def test_java():
    s, c, i = got(JAVA, "java")
    assert s == [
        ("Store", "class", 7, 27, None), ("CACHE", "variable", 8, 8, "Store"), ("a", "variable", 9, 9, "Store"), ("b", "variable", 9, 9, "Store"), ("Store", "method", 13, 13, "Store"), ("load", "method", 16, 22, "Store"), ("run", "method", 20, 20, "Store"), ("count", "method", 23, 23, "Store"),
        ("Color", "enum", 24, 24, "Store"), ("f", "method", 24, 24, "Color"), ("v", "variable", 24, 24, "Color"), ("Color", "method", 24, 24, "Color"), ("v", "method", 24, 24, "Color"), ("Shape", "interface", 25, 25, "Store"), ("area", "method", 25, 25, "Shape"), ("draw", "method", 25, 25, "Shape"), ("Point", "class", 26, 26, "Store"), ("sum", "method", 26, 26, "Point"),
    ]
    assert c == [
        ("HashMap", 8, "constructor"), ("size", 8, "direct"), ("init", 10, "direct"), ("make", 13, "method"), ("go", 20, "direct"), ("Task", 20, "constructor"), ("inside", 20, "direct"), ("stream", 21, "method"), ("map", 21, "method"), ("collect", 21, "method"), ("toMap", 21, "direct"), ("g", 24, "direct"), ("paint", 25, "direct"),
    ]
    assert i == [("java.util.List", 2), ("java.lang.Math", 3)]
    rows = parse(JAVA, "java")[0]
    assert rows[0]["docstring"] == "Doc." and rows[5]["signature"] == "(List<? extends K> keys)" and rows[1]["visibility"] == "private"


CPP = """#include <vector>
#include "util.h"
#define CALL(x) run(x)
// A box.
template <typename T>
class Box final : public Base<T> {
    int hidden() const { return size_; }
public:
    explicit Box(int n) : size_(init(n)), data_{n} { setup(); }
    ~Box() override;
    virtual void open(const std::string& s = "f(") noexcept override { this->log(s); other.go(); }
    static int count = 0;
};
struct Point { double x, y; };
enum class Color : int { Red, Green };
typedef unsigned long ulong_t;
using Name = std::string;
namespace a::b {
int Point::area(int k) const { return std::max(k, (int)sizeof(k)); }
auto make() -> Box<int> { auto p = new Box<int>(3); auto q = R"x(raw call() )x"; return wrap<int>(p); }
int global = compute(2);
int declared(int x);
}
int main(int argc, char** argv) {
    Box<int> box(argc);
    std::vector<int> v(3);
    for (int i = 0; i < argc; ++i) { if (check(i)) { (*fn)(i); } }
    return a::b::run('"');
}
"""


def test_cpp():
    s, c, i = got(CPP, "cpp")
    assert s == [
        ("Box", "class", 6, 13, None), ("hidden", "method", 7, 7, "Box"), ("Box", "method", 9, 9, "Box"), ("open", "method", 11, 11, "Box"), ("count", "variable", 12, 12, "Box"), ("Point", "class", 14, 14, None), ("Color", "enum", 15, 15, None), ("ulong_t", "type", 16, 16, None), ("Name", "type", 17, 17, None),
        ("b", "module", 18, 23, None), ("area", "method", 19, 19, "Point"), ("make", "function", 20, 20, "b"), ("global", "variable", 21, 21, "b"), ("main", "function", 24, 29, None),
    ]
    assert c == [
        ("init", 9, "direct"), ("setup", 9, "direct"), ("log", 11, "method"), ("go", 11, "method"), ("max", 19, "qualified"), ("Box", 20, "constructor"), ("wrap", 20, "direct"), ("compute", 21, "direct"), ("check", 27, "direct"), ("run", 28, "qualified"),
    ]
    assert i == [("vector", 1), ("util.h", 2)]
    rows = {x["name"]: x["visibility"] for x in parse(CPP, "cpp")[0]}
    assert rows["hidden"] == "private" and rows["open"] == "public" and rows["main"] == "public"


def test_broken_sources_end():
    """Open brackets, quotes and comments, cut anywhere, never hang or raise."""
    for source, lang in ((RUST, "rust"), (TS, "typescript"), (GO, "go"), (JAVA, "java"), (CPP, "cpp")):
        for cut in range(0, len(source), 3):
            parse(source[:cut], lang)
            parse(source[cut:], lang)
            parse(source[:cut][::-1], lang)
    for lang in ("rust", "javascript", "go", "java", "cpp"):
        parse("{(<[" * 20_000, lang)
        parse("a < " * 20_000 + "f(x)", lang)
        parse("`${" * 5_000, lang)


def test_tokens_cover_the_words():
    t = tokenize("fn f<'a>(c: char) { let x = 'a'; let y = b\"z\"; }", "rust")
    assert [x.kind for x in t if x.text in ("'a", "'a'", 'b"z"')] == ["literal"] * 3
