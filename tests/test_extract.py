import pytest

from codeatlas.operators import extract

SOURCE = """// #include <no1.h>
/* block
   #include <no2.h> */
#define REAL "real.h"
#define ALIAS REAL
#define LIMIT 64
# include ALIAS
#include <map> // why
  #include "base.h"
const char* text = "#include <no3.h> call(1)";
int first = 1; \\
int second[LIMIT] = {0};
auto raw = R"x(class Hidden { void no(); };)x";
namespace geo {
class Area {
 public:
  virtual ~Area();
  virtual double size() const = 0;
 protected:
  std::string label_;
};
template <class T> class Box : public Area, private util::Base<T> {
 public:
  Box(int n) : n_(n) { fill(n); }
  double size() const override { return scale(n_) + other.weight(2); }
  Box& operator+(const Box& o);
 private:
  int n_;
  Helper helper_;
  std::vector<Item> items_;
};
enum class Color { Red };
double scale(double x) { return x * 2.0; }
}
double geo::scale2(double x);
void run(int argc)
{
  Area a;
  geo::scale(1.0);
  std::sort(a);
  ptr->go(LIMIT);
  fill(3);
  return make(1);
}
"""


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("src/a.cpp", SOURCE), ("src/none.cpp", None), ("src/empty.cpp", "")], "path string, content string")
    symbols, refs, includes = extract.extract(files)
    return symbols.collect(), refs.collect(), includes.collect()


def ids(found, kind):
    return sorted(s.qualified for s in found[0] if s.kind == kind)


def test_includes_come_from_directives_alone(found):
    assert [(i.target, i.line) for i in sorted(found[2], key=lambda i: i.ord)] == [("real.h", 7), ("map", 8), ("base.h", 9)]


def test_symbols(found):
    assert ids(found, "macro") == ["ALIAS", "LIMIT", "REAL"]
    assert ids(found, "class") == ["geo::Area", "geo::Box"]
    assert ids(found, "enum") == ["geo::Color"]
    assert ids(found, "variable") == ["first", "raw", "text"]
    assert ids(found, "function") == ["geo::Area::size", "geo::Area::~Area", "geo::Box::Box", "geo::Box::operator+", "geo::Box::size", "geo::scale", "geo::scale2", "run"]


def test_places_signatures_and_bodies(found):
    by = {s.qualified: s for s in found[0] if s.kind == "function"}
    assert (by["run"].line, by["run"].declaration, by["run"].body_lines, by["run"].signature) == (36, False, 8, "void run(int argc)")
    assert (by["geo::scale"].line, by["geo::scale"].declaration, by["geo::scale"].body_lines) == (33, False, 1)
    assert by["geo::scale2"].declaration and by["geo::Area::size"].declaration and not by["geo::Box::size"].declaration
    classes = {s.name: s for s in found[0] if s.kind == "class"}
    assert classes["Area"].line == 15 and classes["Area"].column == 1 and classes["Area"].signature == "class Area @ src/a.cpp"


def refs(found, kind):
    return sorted((r.from_id, r.name) for r in found[1] if r.kind == kind)


def test_references(found):
    assert refs(found, "inherits") == [("class:geo::Box", "Area"), ("class:geo::Box", "T")]
    assert refs(found, "uses") == [("class:geo::Area", "string"), ("class:geo::Box", "Helper"), ("class:geo::Box", "Item")]
    assert refs(found, "refs") == [("file:src/a.cpp", "LIMIT")]
    assert refs(found, "calls") == [
        ("func:geo::Box::Box", "fill"), ("func:geo::Box::size", "scale"), ("func:geo::Box::size", "weight"),
        ("func:run", "fill"), ("func:run", "geo::scale"), ("func:run", "go"), ("func:run", "make"),
    ]


def test_bare_calls_count_only_if_asked(spark):
    files = spark.createDataFrame([("a.c", "void f() {\n  log(1);\n}\n")], "path string, content string")
    names = lambda kinds: sorted(s.qualified for s in extract.extract(files, kinds)[0].collect())
    assert names(extract.Kinds()) == ["f"] and names(extract.Kinds(bare_calls=True)) == ["f", "log"]


def test_switches_and_empty_tables(spark):
    files = spark.createDataFrame([("a.c", '#include "b.h"\nint A = 1;\nclass C : B { D d; };\nvoid f() { g(MAX); }\n')], "path string, content string")
    symbols, pending, includes = extract.extract(files, extract.Kinds(includes=False, calls=False, types=False, symbols=False))
    assert [s.kind for s in symbols.collect()] == ["function"] and pending.count() == includes.count() == 0
    symbols, pending, includes = extract.extract(files.limit(0))
    assert symbols.count() == pending.count() == includes.count() == 0


@pytest.mark.parametrize("text", ["(" * 3000, "{" * 3000, '"' * 3001, "R\"(" * 500, "/*" * 3000, "#define A \\\n" * 3000, "a::" * 2000 + "b("])
def test_broken_texts_end(spark, text):
    files = spark.createDataFrame([("a.c", text)], "path string, content string")
    cut = extract.pieces(files)
    assert "".join(r.raw for r in sorted(cut.collect(), key=lambda r: r.place)) == text


NESTED = """namespace a { namespace b {
struct Outer : Base<int>, Other {
  struct Inner { Part part_; int operator()(int x) const { return look(x); } };
  Inner in_;
  void go() { struct Local { void run() { call_in(1); } }; call_out(2); }
  bool operator()(Key a, Key b);
};
} }
bool Outer::operator()(Key a, Key b) { return less(a, b); }
int lambda() { auto f = [](int x) { return twice(x); }; return f(LIMITED); }
"""


def test_nested_scopes_owners_and_bodies(spark):
    symbols, pending, _ = extract.extract(spark.createDataFrame([("n.cpp", NESTED)], "path string, content string"))
    names = {(s.kind, s.qualified) for s in symbols.collect()}
    assert {("class", "a::b::Outer"), ("class", "a::b::Outer::Inner"), ("class", "a::b::Outer::Local"), ("function", "a::b::Outer::operator()"), ("function", "a::b::Outer::Inner::operator()"), ("function", "operator()"), ("function", "a::b::Outer::Local::run")} <= names
    got = {(r.from_id, r.name) for r in pending.collect() if r.kind == "calls"}
    # a call in a body within a body belongs to both
    assert {("func:a::b::Outer::Local::run", "call_in"), ("func:a::b::Outer::go", "call_in"), ("func:a::b::Outer::go", "call_out"), ("func:a::b::Outer::Inner::operator()", "look"), ("func:lambda", "twice"), ("func:operator()", "less")} <= got
    assert ("func:a::b::Outer::Local::run", "call_out") not in got
    assert {(r.from_id, r.name) for r in pending.collect() if r.kind == "inherits"} == {("class:a::b::Outer", "int"), ("class:a::b::Outer", "Other")}
    assert {(r.from_id, r.name) for r in pending.collect() if r.kind == "uses"} == {("class:a::b::Outer::Inner", "Part"), ("class:a::b::Outer", "Inner")}


def test_one_large_file_keeps_every_function_and_call(spark):
    body = lambda i: f"int part_{i}(int x) {{\n  if (x) {{ helper_{i % 7}(x, y); }}\n  return part_{i + 1}(LIMIT);\n}}\n"
    text = "namespace big {\nclass Holder {\n" + "".join(body(i) for i in range(3000)) + "};\n}\n" + "a::" * 20_000 + "end();\n"
    symbols, pending, _ = extract.extract(spark.createDataFrame([("big.cpp", text)], "path string, content string"))
    assert symbols.where("kind = 'function' and qualified like 'big::Holder::part_%' and not declaration").count() == 3000
    assert pending.where("kind = 'calls'").groupBy("from_id").count().where("count = 2").count() == 3000


def test_a_task_holds_a_bounded_share_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(extract, "PART_BYTES", 4000)
    monkeypatch.setattr(extract, "LEAST_BYTES", 1 << 30)
    text = "int f(int x) {\n  return g(x);\n}\n" * 20
    files = spark.createDataFrame([(f"src/f{k}.cpp", text) for k in range(200)], "path string, content string")
    found = extract.Parsed(files)
    assert found.parts == -(-200 * len(text) // 4000)
    sizes = [sum(1 for _ in part) for part in found.rows.select("path", "idx").rdd.glom().collect()]
    assert len(sizes) == found.parts and sum(sizes) == 200 * 20 * 14 and max(sizes) < 6 * sum(sizes) / len(sizes)
