"""Queries over source texts, file lists and specifications written from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names
from codequarry.operators import counts, diagrams, graph, metrics, resolver, search, symbols
from codequarry.registered import views
from codequarry.sources import brace_code, files as sf, openapi, parsing, python_code

# every part is a Python module: a class with a base, two methods, a route, a function and nested calls
PYTHON = '''
SELECT concat('brand_', replace(p_brand, 'Brand#', '')) AS repo_name, concat('src/part_', CAST(p_partkey AS STRING), '.py') AS file_path,
  concat('import ', split_part(p_name, ' ', 1), '
from catalog import ', split_part(p_name, ' ', 2), '

class Part', CAST(p_partkey AS STRING), '(Base', CAST(p_size AS STRING), ', object):
    def price(self, tax: float = 0.0):
        """Price of ', p_name, '."""
        def net():
            return round(self.base(', CAST(p_size AS STRING), '))
        return net() + catalog.tax.of(tax)

    @app.get("/parts/', CAST(p_partkey AS STRING), '")
    async def show(self):
        return self.price()

def make_', CAST(p_partkey AS STRING), '():
    return Part', CAST(p_partkey AS STRING), '()
') AS content, 'python' AS language
FROM {part}
'''

# every customer is a Java class, every supplier a TypeScript module
JAVA = """
SELECT concat('n', CAST(c_nationkey AS STRING)) AS repo_name, concat('src/Customer', CAST(c_custkey AS STRING), '.java') AS file_path,
  concat('package shop;
import java.util.List;
/** Customer ', c_name, ' {{ of ', c_mktsegment, '. */
@Service
@RequestMapping("/customers/', CAST(c_custkey AS STRING), '")
public class Customer', CAST(c_custkey AS STRING), ' extends Nation', CAST(c_nationkey AS STRING), ' implements ', replace(c_mktsegment, ' ', ''), ', Billable {{
    @Autowired
    private OrderRepo orders;

    public Customer', CAST(c_custkey AS STRING), '(Ledger ledger) {{
        super.init(ledger);
    }}

    @GetMapping("/balance")
    public double balance(int days) {{
        // balance( {{ in a comment
        if (days > ', CAST(c_nationkey AS STRING), ') {{ return ledger.sum("text {{ sum(" + days); }}
        return new Money(days).value();
    }}
}}
') AS content, 'java' AS language
FROM {customer}
"""

TYPESCRIPT = """
SELECT concat('n', CAST(s_nationkey AS STRING)) AS repo_name, concat('src/supplier', CAST(s_suppkey AS STRING), '.ts') AS file_path,
  concat('import axios from "axios";
/**
 * Loads ', s_name, '.
 */
export async function load', CAST(s_suppkey AS STRING), '(id: string) {{
  const rows = await axios.get("/api/customers/', CAST(s_suppkey AS STRING), '/balance");
  return rows.map(r => r.total);
}}

export const Card', CAST(s_suppkey AS STRING), ' = (props: CardProps) => {{
  return <div>{{props.title}}</div>;
}};

@Controller("suppliers")
export class Supplier', CAST(s_suppkey AS STRING), ' extends Base implements OnInit {{
  @Post(":id")
  async save(id: string) {{
    return this.repo.save(new Item(id));
  }}
}}
') AS content, 'typescript' AS language
FROM {supplier}
"""


def _python(spark, sf_dir):
    return views.sources(spark, sf_dir, PYTHON)


def _braces(spark, sf_dir):
    return views.sources(spark, sf_dir, JAVA).unionByName(views.sources(spark, sf_dir, TYPESCRIPT))


def _forms(table: str, key: str, texts: list[str], suffix: str, language: str) -> str:
    """A view in which each row of a table is one of some source texts; @K@ stands for the row's key (@D@ for a dollar, which SQL texts expand)."""
    cases = " ".join(f"WHEN {i} THEN '{t.replace('$', '@D@').replace('{', '{{').replace('}', '}}')}'" for i, t in enumerate(texts))
    return f"""SELECT concat('f', CAST({key} % 7 AS STRING)) AS repo_name, concat('src/form', CAST({key} AS STRING), '{suffix}') AS file_path,
      replace(replace(CASE {key} % {len(texts)} {cases} END, '@K@', CAST({key} AS STRING)), '@D@', '$') AS content, '{language}' AS language FROM {{{table}}}"""


# forms in which line by line reading fails: one line for all, enums and records, long strings, anonymous classes, interfaces with code
JAVA_FORMS = [
    "class A@K@ { int x = first(); void a() { b@K@(); } void c() { d(1); } static { e(); } }",
    """enum Color@K@ { RED(1) { int w() { return mix(); } }, GREEN(2); Color@K@ next() { return values()[1]; } }
record Point@K@(int a) { Point@K@ { check(a); } int sum() { return add(a); } }""",
    '''class T@K@ {
  String s = """
    class Fake { void no() { nope(); } }
    """;
  String run() { return s.trim(); }
}''',
    """class R@K@ { Runnable make() {
    return new Runnable() { public void run() { go@K@(); } };
  }
}""",
    """interface I@K@ extends Base { default void q() { w(); } void z(); int K = 3; }
class G@K@<T extends I@K@> { <U extends List<U>> Map<String, U> gen(U u) throws X { return u.<U>make(); } }""",
    """class O@K@ {
  // void gone() { no(); }
  class Inner { Inner(int a) { super(a); this.set(a); } }
  void last() { String c = "}"; int[] all = {1, 2}; if (c > 1) { hit(all); } }
}""",
]
TYPESCRIPT_FORMS = [
    "class Q@K@ { a() { return `x ${f(`in ${g()} {`)} }`; } static b<T>(x: T): T { return h(x); } }",
    """export const one@K@ = async (x) => { await two(); }; const three@K@ = y => four(y)
function five@K@() { const six@K@ = () => seven(); return six@K@() }""",
    """const obj@K@ = { ten() { eleven(); }, twelve: () => { thirteen(); } };
function re@K@(s) { if (/}{/.test(s)) { hit(s); } return s; }""",
    """interface S@K@ { area(): number; name: string }
abstract class V@K@ extends W<X> { abstract z(): void; private p = () => { k(); }; constructor(private a: B) { super(a); this.run(); } }""",
    """type U@K@ = { a: string }
export default function eight@K@() { nine(`
}`); }""",
    """foo(function() { bar(); });
class Y@K@ { get v() { return 1 } async *w() { yield make(); } }""",
]
#: chunk_type, name, parent_name, first and last line of what each form declares; caller, callee, line and kind of its calls
JAVA_UNITS = [
    [("class", "A@K@", None, 1, 1), ("method", "a", "A@K@", 1, 1), ("method", "c", "A@K@", 1, 1)],
    [("method", "w", None, 1, 1), ("method", "next", None, 1, 1), ("method", "sum", None, 2, 2)],
    [("class", "T@K@", None, 1, 6), ("method", "run", "T@K@", 5, 5)],
    [("class", "R@K@", None, 1, 4), ("method", "make", "R@K@", 1, 3), ("method", "run", "R@K@", 2, 2)],
    [("interface", "I@K@", None, 1, 1), ("method", "q", "I@K@", 1, 1), ("method", "z", "I@K@", 1, 1), ("class", "G@K@", None, 2, 2), ("method", "gen", "G@K@", 2, 2)],
    [("class", "O@K@", None, 1, 5), ("class", "Inner", "O@K@", 3, 3), ("constructor", "Inner", "Inner", 3, 3), ("method", "last", "O@K@", 4, 4)],
]
JAVA_SITES = [
    [("A@K@.a", "b@K@", 1, "direct"), ("A@K@.c", "d", 1, "direct")],
    [("w", "mix", 1, "direct"), ("next", "values", 1, "direct"), ("sum", "add", 2, "direct")],
    [("T@K@.run", "s.trim", 5, "method")],
    [("R@K@.make", "Runnable.<init>", 2, "constructor"), ("R@K@.make", "go@K@", 2, "direct"), ("R@K@.run", "go@K@", 2, "direct")],
    [("I@K@.q", "w", 1, "direct"), ("G@K@.gen", "make", 2, "direct")],
    [("Inner.Inner", "this.set", 3, "method"), ("O@K@.last", "hit", 4, "direct")],
]
TYPESCRIPT_UNITS = [
    [("class", "Q@K@", None, 1, 1), ("method", "a", "Q@K@", 1, 1), ("method", "b", "Q@K@", 1, 1)],
    [("function", "one@K@", None, 1, 1), ("function", "three@K@", None, 1, 1), ("function", "five@K@", None, 2, 2), ("function", "six@K@", None, 2, 2)],
    [("function", "re@K@", None, 2, 2)],
    [("interface", "S@K@", None, 1, 1), ("method", "area", "S@K@", 1, 1), ("class", "V@K@", None, 2, 2), ("method", "z", "V@K@", 2, 2), ("method", "constructor", "V@K@", 2, 2)],
    [("class", "U@K@", None, 1, 1), ("function", "eight@K@", None, 2, 3)],
    [("class", "Y@K@", None, 2, 2), ("method", "v", "Y@K@", 2, 2), ("method", "w", "Y@K@", 2, 2)],
]
TYPESCRIPT_SITES = [
    [("Q@K@.a", "f", 1, "direct"), ("Q@K@.a", "g", 1, "direct"), ("Q@K@.b", "h", 1, "direct")],
    [("one@K@", "two", 1, "direct"), ("three@K@", "four", 1, "direct"), ("five@K@", "seven", 2, "direct"), ("five@K@", "six@K@", 2, "direct"), ("six@K@", "seven", 2, "direct")],
    [("re@K@", "test", 2, "direct"), ("re@K@", "hit", 2, "direct")],
    [("V@K@.constructor", "this.run", 2, "method")],
    [("eight@K@", "nine", 2, "direct")],
    [("Y@K@.w", "make", 2, "direct")],
]


def _form_files(spark, sf_dir):
    java = views.sources(spark, sf_dir, _forms("part", "p_partkey", JAVA_FORMS, ".java", "java"))
    return java.unionByName(views.sources(spark, sf_dir, _forms("customer", "c_custkey", TYPESCRIPT_FORMS, ".ts", "typescript")))


def parse_forms_chunks(spark, sf_dir):
    """Declarations of six forms per language that lines alone do not tell apart."""
    return parsing.tables_of(brace_code.parse_braces(_form_files(spark, sf_dir))).chunks.select("repo_name", "file_path", "chunk_type", "name", "parent_name", "start_line", "end_line")


def parse_forms_calls(spark, sf_dir):
    """Calls of the same forms: declarations are none, calls inside templates and anonymous classes are."""
    return parsing.tables_of(brace_code.parse_braces(_form_files(spark, sf_dir))).calls


def _form_rows(found: list[list[tuple]], columns: str) -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in (i, *row)) + ")" for i, rows in enumerate(found) for row in rows)
    return f"(VALUES {rows}) AS v(form, {columns})"


def _forms_sql(chosen: str, java: list, typescript: list, columns: str) -> str:
    parts = [
        f"SELECT 'f' || (k % 7) AS repo_name, 'src/form' || k || '{suffix}' AS file_path, {chosen} FROM (SELECT {key} AS k FROM {table}) JOIN {_form_rows(found, columns)} ON form = k % 6"
        for table, key, suffix, found in (("part", "p_partkey", ".java", java), ("customer", "c_custkey", ".ts", typescript))
    ]
    return " UNION ALL ".join(parts)


FORM_CHUNKS_SQL = _forms_sql(
    "chunk_type, replace(name, '@K@', k::VARCHAR) AS name, replace(parent_name, '@K@', k::VARCHAR) AS parent_name, start_line::INT AS start_line, end_line::INT AS end_line",
    JAVA_UNITS, TYPESCRIPT_UNITS, "chunk_type, name, parent_name, start_line, end_line",
)
FORM_CALLS_SQL = "SELECT caller, callee, file_path AS caller_file, caller_line, repo_name, call_type FROM (" + _forms_sql(
    "replace(caller, '@K@', k::VARCHAR) AS caller, replace(callee, '@K@', k::VARCHAR) AS callee, line::INT AS caller_line, call_type", JAVA_SITES, TYPESCRIPT_SITES, "caller, callee, line, call_type",
) + ")"

BROKEN_PYTHON = ['''import os

def good@K@(a):
    return helper(a)

def bad@K@(:
    pass

@app.get("/keep/@K@")
def kept@K@():
    return os.go()

x = [1, 2
class Keep@K@(Base):
    def run(self):
        return self.go()

def tail@K@():
    """a
def hidden():
    b"""
    return end()''']
PARTIAL_UNITS = [[
    ("function", "good@K@", None, 3, 4), ("function", "kept@K@", None, 10, 11), ("class", "Keep@K@", None, 14, 16), ("method", "run", "Keep@K@", 15, 16), ("function", "tail@K@", None, 18, 22),
]]


def parse_partial(spark, sf_dir):
    """What the sound blocks of broken Python files hold; the files keep their error."""
    parsed = python_code.parse_python(views.sources(spark, sf_dir, _forms("supplier", "s_suppkey", BROKEN_PYTHON, ".py", "python")))
    chunks = parsed.select(F.inline_outer("chunks"), F.col("error").isNotNull().alias("broken")).where("id is not null")
    return chunks.select("repo_name", "file_path", "chunk_type", "name", "parent_name", "start_line", "end_line", F.array_join("imports", ";").alias("imports"), "broken")


PARTIAL_SQL = f"""SELECT 'f' || (k % 7) AS repo_name, 'src/form' || k || '.py' AS file_path, chunk_type, replace(name, '@K@', k::VARCHAR) AS name, replace(parent_name, '@K@', k::VARCHAR) AS parent_name,
 start_line::INT AS start_line, end_line::INT AS end_line, 'import os' AS imports, true AS broken FROM (SELECT s_suppkey AS k FROM supplier) JOIN {_form_rows(PARTIAL_UNITS, "chunk_type, name, parent_name, start_line, end_line")} ON true"""

CHUNK_COLUMNS = ["repo_name", "file_path", "chunk_type", "name", "parent_name", "start_line", "end_line", "signature", "docstring"]


def parse_python_chunks(spark, sf_dir):
    chunks = parsing.tables_of(python_code.parse_python(_python(spark, sf_dir))).chunks
    return chunks.select(*CHUNK_COLUMNS, F.col("metadata.route.path").alias("route_path"), F.array_join("imports", ";").alias("imports"), F.length("content").cast("bigint").alias("length"))


_P = "SELECT 'brand_' || replace(p_brand, 'Brand#', '') AS repo_name, 'src/part_' || p_partkey || '.py' AS file_path, p_partkey::VARCHAR AS k, *, 'import ' || split_part(p_name, ' ', 1) || ';from catalog import ' || split_part(p_name, ' ', 2) AS imports FROM part"
PYTHON_SQL = f"""WITH p AS ({_P}), src AS ({views.cte(PYTHON)}), t AS (SELECT file_path, string_split(content, chr(10)) AS ls FROM src),
u AS (SELECT repo_name, file_path, 'class' AS chunk_type, 'Part' || k AS name, NULL AS parent_name, 4::INT AS start_line, 12::INT AS end_line, NULL AS signature, NULL AS docstring, NULL AS route_path, imports FROM p
 UNION ALL SELECT repo_name, file_path, 'method', 'price', 'Part' || k, 5, 9, 'def price(self, tax: float = 0.0):', 'Price of ' || p_name || '.', NULL, imports FROM p
 UNION ALL SELECT repo_name, file_path, 'method', 'show', 'Part' || k, 12, 13, 'async def show(self):', NULL, '/parts/' || k, imports FROM p
 UNION ALL SELECT repo_name, file_path, 'function', 'make_' || k, NULL, 15, 16, 'def make_' || k || '():', NULL, NULL, imports FROM p),
v AS (SELECT * REPLACE (CASE WHEN chunk_type = 'class' THEN 13 ELSE end_line END::INT AS end_line) FROM u)
SELECT v.*, length(array_to_string(ls[start_line:end_line], chr(10))) AS length FROM v JOIN t USING (file_path)"""


def parse_python_calls(spark, sf_dir):
    return parsing.tables_of(python_code.parse_python(_python(spark, sf_dir))).calls


PYTHON_CALLS_SQL = f"""WITH p AS ({_P}), c AS (
 SELECT repo_name, file_path, 'Part' || k || '.price' AS caller, unnest(['round', 'self.base', 'net', 'catalog.tax.of']) AS callee, unnest([8, 8, 9, 9])::INT AS caller_line, unnest(['direct', 'method', 'direct', 'method']) AS call_type FROM p
 UNION ALL SELECT repo_name, file_path, 'Part' || k || '.show', 'self.price', 13, 'method' FROM p UNION ALL SELECT repo_name, file_path, 'make_' || k, 'Part' || k, 16, 'direct' FROM p)
SELECT caller, callee, file_path AS caller_file, caller_line, repo_name, call_type FROM c"""


def parse_brace_chunks(spark, sf_dir):
    chunks = parsing.tables_of(brace_code.parse_braces(_braces(spark, sf_dir))).chunks
    outgoing = F.array_join(F.transform("metadata.outgoing_api_calls", lambda c: F.concat(c["method"], F.lit(" "), c["url"])), ";")
    return chunks.select(
        *CHUNK_COLUMNS, F.col("metadata.route.method").alias("route_method"), F.col("metadata.route.path").alias("route_path"), outgoing.alias("outgoing"),
        F.col("metadata.is_react_component").alias("react"), F.col("metadata.props_interface").alias("props"),
    )


_C = "SELECT 'n' || c_nationkey AS repo_name, 'src/Customer' || c_custkey || '.java' AS file_path, c_custkey::VARCHAR AS k, * FROM customer"
_S = "SELECT 'n' || s_nationkey AS repo_name, 'src/supplier' || s_suppkey || '.ts' AS file_path, s_suppkey::VARCHAR AS k, * FROM supplier"
BRACE_SQL = f"""WITH c AS ({_C}), s AS ({_S})
SELECT repo_name, file_path, 'class' AS chunk_type, 'Customer' || k AS name, NULL AS parent_name, 6::INT AS start_line, 20::INT AS end_line, NULL AS signature,
 'Customer ' || c_name || ' {{ of ' || c_mktsegment || '.' AS docstring, NULL AS route_method, NULL AS route_path, NULL AS outgoing, NULL::BOOLEAN AS react, NULL AS props FROM c
UNION ALL SELECT repo_name, file_path, 'constructor', 'Customer' || k, 'Customer' || k, 10, 12, 'public Customer' || k || '(Ledger ledger)', NULL, NULL, NULL, NULL, NULL, NULL FROM c
UNION ALL SELECT repo_name, file_path, 'method', 'balance', 'Customer' || k, 15, 19, 'public double balance(int days)', NULL, 'GET', '/customers/' || k || '/balance', NULL, NULL, NULL FROM c
UNION ALL SELECT repo_name, file_path, 'function', 'load' || k, NULL, 5, 8, 'export async function load' || k || '(id: string)', 'Loads ' || s_name || '.', NULL, NULL, 'GET /api/customers/' || k || '/balance', NULL, NULL FROM s
UNION ALL SELECT repo_name, file_path, 'function', 'Card' || k, NULL, 10, 12, 'export const Card' || k || ' = (props: CardProps) =>', NULL, NULL, NULL, NULL, true, 'CardProps' FROM s
UNION ALL SELECT repo_name, file_path, 'class', 'Supplier' || k, NULL, 15, 20, NULL, NULL, 'CONTROLLER', 'suppliers', NULL, NULL, NULL FROM s
UNION ALL SELECT repo_name, file_path, 'method', 'save', 'Supplier' || k, 17, 19, 'async save(id: string)', NULL, 'POST', '/suppliers/:id', NULL, NULL, NULL FROM s"""


def parse_brace_calls(spark, sf_dir):
    return parsing.tables_of(brace_code.parse_braces(_braces(spark, sf_dir))).calls


BRACE_CALLS_SQL = f"""WITH c AS ({_C}), s AS ({_S}), x AS (
 SELECT repo_name, file_path, 'Customer' || k || '.Customer' || k AS caller, 'super.init' AS callee, 11::INT AS caller_line, 'method' AS call_type FROM c
 UNION ALL SELECT repo_name, file_path, 'Customer' || k || '.balance', unnest(['ledger.sum', 'Money.<init>', 'value']), unnest([17, 18, 18])::INT, unnest(['method', 'constructor', 'direct']) FROM c
 UNION ALL SELECT repo_name, file_path, 'load' || k, unnest(['axios.get', 'rows.map']), unnest([6, 7])::INT, 'method' FROM s
 UNION ALL SELECT repo_name, file_path, 'Supplier' || k || '.save', unnest(['this.repo.save', 'Item.constructor']), 18, unnest(['method', 'constructor']) FROM s)
SELECT caller, callee, file_path AS caller_file, caller_line, repo_name, call_type FROM x"""


def parse_inheritance(spark, sf_dir):
    files = python_code.parse_python(_python(spark, sf_dir), ["bases"]).unionByName(brace_code.parse_braces(_braces(spark, sf_dir), ["bases"]))
    return parsing.tables_of(files).inheritance


INHERITANCE_SQL = f"""WITH p AS ({_P}), c AS ({_C}), s AS ({_S}), x AS (
 SELECT 'Part' || k AS child_name, 'Base' || p_size AS parent_name, 'extends' AS relation_type, file_path, repo_name, 4::INT AS line_number FROM p
 UNION ALL SELECT 'Customer' || k, unnest(['Nation' || c_nationkey, replace(c_mktsegment, ' ', ''), 'Billable']), unnest(['extends', 'implements', 'implements']), file_path, repo_name, 6 FROM c
 UNION ALL SELECT 'Supplier' || k, unnest(['Base', 'OnInit']), unnest(['extends', 'implements']), file_path, repo_name, 15 FROM s)
SELECT child_name, child_name AS child_qualified, parent_name, relation_type, file_path, repo_name, line_number FROM x"""


def parse_dependencies(spark, sf_dir):
    return parsing.tables_of(brace_code.parse_braces(_braces(spark, sf_dir), ["dependencies"])).class_dependencies


def parse_counters(spark, sf_dir):
    """Processed and skipped files when documents pose as Python: prose does not parse, and says so."""
    docs = views.texts(spark, sf_dir, "documents")
    prose = docs.select(F.col("source").alias("repo_name"), F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("file_path"), F.concat(F.lit("1 + = "), "text").alias("content"), F.lit("python").alias("language"))
    parsed = parsing.parse_files(_python(spark, sf_dir).unionByName(prose), [])
    return parsing.counters(parsing.tables_of(parsed).files)


# ---- file lists --------------------------------------------------------------------------------


def _paths(spark, sf_dir):
    """A path per page: host as repository, its folder and file name from the page number."""
    return views.view(spark, sf_dir, PATHS)


PATHS = """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS repo_name,
  concat(CASE page_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'logs/a/' WHEN 3 THEN 'gen/' WHEN 4 THEN '' ELSE 'docs/' END,
    CASE page_id % 7 WHEN 0 THEN 'keep' ELSE concat('f', CAST(page_id AS STRING)) END,
    CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.min.js' WHEN 3 THEN '.tsx' ELSE '.txt' END) AS file_path
FROM {pages}
"""
IGNORE_TEXT = "# generated\nlogs/\n/gen/*.py\n!keep.py\n*.java\n"


def ignore_rules(spark, sf_dir):
    p = _paths(spark, sf_dir)
    path = F.col("file_path")
    return p.select("page_id", "file_path", names.language_of(path).alias("language"), sf.ignored(path, sf.gitignore_rules(IGNORE_TEXT)).alias("ignored"))


IGNORE_SQL = f"""WITH p AS ({views.cte(PATHS)}), m AS (SELECT *, CASE WHEN file_path LIKE '%.java' THEN true WHEN split_part(file_path, '/', -1) = 'keep.py' THEN false
 WHEN file_path LIKE 'gen/%.py' THEN true WHEN file_path LIKE 'logs/%' THEN true ELSE false END AS git FROM p)
SELECT page_id, file_path, CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.java' THEN 'java' WHEN file_path LIKE '%.tsx' THEN 'typescript' WHEN file_path LIKE '%.js' THEN 'javascript' END AS language,
 contains(file_path, 'build/') OR file_path LIKE '%.min.js' OR git AS ignored FROM m"""


def discover_repositories(spark, sf_dir):
    return sf.discover(_paths(spark, sf_dir), ["*example.com", "*.net"], ["www.*"], 2)


DISCOVER_SQL = f"""WITH p AS ({views.cte(PATHS)}) SELECT repo_name, count(*) AS source_files FROM p WHERE regexp_matches(file_path, '[.](py|java|tsx|js)$')
 AND (repo_name LIKE '%example.com' OR repo_name LIKE '%.net') AND repo_name NOT LIKE 'www.%' GROUP BY ALL HAVING count(*) >= 2"""


# ---- specifications --------------------------------------------------------------------------------


def spec_endpoints(spark, sf_dir):
    """One specification per page; half are OpenAPI 3, half Swagger 2."""
    p = views.read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1), F.lit("/{id}"))
    parameter = '"parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "string"}}]'
    paths = F.concat(F.lit('"paths": {"'), path, F.lit('": {' + parameter + ', "get": {"operationId": "get'), "page_id", F.lit('"}, "post": {"parameters": [{"name": "q"}]}, "x-info": 1}}}'))
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"openapi": "3.0.0", "servers": [{"url": "https://'), host, F.lit('/api/v2"}], '), paths)).otherwise(
        F.concat(F.lit('{"swagger": "2.0", "basePath": "/base", '), paths)
    )
    files = p.select(host.alias("repo_name"), F.concat(F.lit("p"), "page_id", F.lit("/swagger.json")).alias("file_path"), text.alias("content"))
    found = openapi.spec_endpoints(openapi.as_json(files))
    return found.select("repo_name", "file_path", "qualified_name", "route.method", "route.path_pattern", "route.base_path", "metadata.spec_version",
                        F.array_join(F.transform("route.parameters", lambda x: F.concat_ws(":", x["name"], x["source"], x["type_hint"])), ",").alias("parameters"))


SPEC_SQL = """WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/]+)/', 1) AS repo_name, '/' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) || '/{id}' AS path, page_id % 2 = 0 AS three FROM pages),
v AS (SELECT *, unnest(['GET', 'POST']) AS method FROM p)
SELECT repo_name, 'p' || page_id || '/swagger.json' AS file_path, CASE method WHEN 'GET' THEN 'get' || page_id ELSE 'POST_' || CASE WHEN three THEN '/api/v2' ELSE '/base' END || path END AS qualified_name, method,
 CASE WHEN three THEN path ELSE '/base' || path END AS path_pattern, CASE WHEN three THEN '/api/v2' END AS base_path, CASE WHEN three THEN 'openapi3' ELSE 'swagger2' END AS spec_version,
 'id:path:string' || CASE method WHEN 'POST' THEN ',q:query' ELSE '' END AS parameters FROM v"""


# ---- resolver and diagrams ----------------------------------------------------------------------------


def resolve_references(spark, sf_dir):
    """Call sites of a supplier, those of open lines also known to a server."""
    calls = views.calls(spark, sf_dir)
    server = calls.where("callee = 'Supplier7' and call_type = 'direct'").select(
        F.col("caller_file").alias("file_path"), F.col("caller_line").alias("line"), F.lit("server").alias("context"), F.lit("any").alias("repo_name"), F.lit(1.0).alias("confidence"), F.lit("lsp").alias("backend")
    )
    return resolver.references(calls, "Supplier7", server=server).groupBy("file_path", "line", "backend", "confidence").agg(F.count("*").alias("n"))


REFERENCES_SQL = f"""WITH calls AS ({views.cte(views.CALLS)}) SELECT caller_file AS file_path, caller_line AS line, CASE WHEN bool_or(call_type = 'direct') THEN 'lsp' ELSE 'index' END AS backend,
 CASE WHEN bool_or(call_type = 'direct') THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence, 1::BIGINT AS n FROM calls WHERE callee = 'Supplier7' GROUP BY caller_file, caller_line"""


def _hits(spark, sf_dir):
    """The thirty dearest parts and suppliers stand for a page of search results."""
    part = views.read(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select(F.concat(F.lit("Part"), "p_partkey").alias("name"))
    supplier = views.read(spark, sf_dir, "supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(10).select(F.concat(F.lit("Supplier"), "s_suppkey").alias("name"))
    chosen = part.unionByName(supplier)
    hits = views.symbol_chunks(spark, sf_dir).join(F.broadcast(chosen), "name", "left_semi")
    return hits.withColumn("rank", F.expr("row_number() over (order by name)"))


HITS_CTE = f"""calls AS ({views.cte(views.CALLS)}), symbols AS ({views.cte(views.SYMBOLS)}), h AS (SELECT *, row_number() OVER (ORDER BY name) AS rank FROM symbols WHERE name IN
 (SELECT 'Part' || p_partkey FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20) UNION ALL SELECT 'Supplier' || s_suppkey FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10))),
hm AS (SELECT *, regexp_extract(file_path, 'src/(.*)[.]py', 1) AS module FROM h), sm AS (SELECT *, regexp_extract(file_path, 'src/(.*)[.]py', 1) AS module FROM symbols)"""


def diagram_architecture_nodes(spark, sf_dir):
    g = diagrams.architecture(_hits(spark, sf_dir), views.calls(spark, sf_dir), views.symbol_chunks(spark, sf_dir))
    return g.nodes.select("id", "label", "type", "file", F.col("extra.layer").alias("layer"), F.col("extra.chunk_count").alias("chunk_count"))


def diagram_module_edges(spark, sf_dir):
    g = diagrams.dependency(_hits(spark, sf_dir), views.calls(spark, sf_dir), views.symbol_chunks(spark, sf_dir))
    return g.edges.select("source", "target", "label", "type")


def diagram_dataflow_edges(spark, sf_dir):
    g = diagrams.dataflow(_hits(spark, sf_dir), views.calls(spark, sf_dir), 1)
    return g.edges.select("source", "target", "label", "type")


def diagram_callflow_edges(spark, sf_dir):
    g = diagrams.limited(diagrams.callflow(_hits(spark, sf_dir), views.calls(spark, sf_dir), 1), 30)
    return g.edges.select("source", "target", "type").distinct()


def diagram_sequence(spark, sf_dir):
    """Numbered messages from the entry points of the page."""
    g = diagrams.sequence(_hits(spark, sf_dir), views.calls(spark, sf_dir), 1)
    return g.edges.select("source", "target", "label", F.col("position").alias("sequence"))


def diagram_class_nodes(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    g = diagrams.limited(diagrams.classes(hits, views.inheritance(spark, sf_dir)), 100, include_external=True)
    return g.nodes.select("id", "type", F.coalesce("extra.external", F.lit(False)).alias("external"))


def module_names(spark, sf_dir):
    c = views.chunks(spark, sf_dir)
    return c.select("id", names.module_name(F.col("file_path")).alias("module"), names.node_id(F.col("file_path")).alias("node"), names.file_stem(F.col("file_path")).alias("stem"))


QUERIES = {
    "parse_python_chunks": (parse_python_chunks, PYTHON_SQL),
    "parse_python_calls": (parse_python_calls, PYTHON_CALLS_SQL),
    "parse_brace_chunks": (parse_brace_chunks, BRACE_SQL.replace("{{", "{")),
    "parse_forms_chunks": (parse_forms_chunks, FORM_CHUNKS_SQL),
    "parse_forms_calls": (parse_forms_calls, FORM_CALLS_SQL),
    "parse_partial": (parse_partial, PARTIAL_SQL),
    "parse_brace_calls": (parse_brace_calls, BRACE_CALLS_SQL),
    "parse_inheritance": (parse_inheritance, INHERITANCE_SQL),
    "parse_dependencies": (parse_dependencies, f"WITH c AS ({_C}) SELECT 'Customer' || k AS class_name, unnest(['orders', 'ledger']) AS field_name, unnest(['OrderRepo', 'Ledger']) AS field_type, unnest(['field', 'constructor']) AS injection_type, repo_name FROM c"),
    "parse_counters": (parse_counters, "SELECT 'brand_' || replace(p_brand, 'Brand#', '') AS repo_name, count(*) AS processed, 0::BIGINT AS skipped, 4 * count(*) AS chunks FROM part GROUP BY ALL UNION ALL SELECT source, 0, count(*), 0 FROM documents GROUP BY ALL"),
    "ignore_rules": (ignore_rules, IGNORE_SQL),
    "discover_repositories": (discover_repositories, DISCOVER_SQL),
    "spec_endpoints": (spec_endpoints, SPEC_SQL),
    "resolve_references": (resolve_references, REFERENCES_SQL),
    "diagram_architecture_nodes": (diagram_architecture_nodes, f"WITH {HITS_CTE} SELECT module AS id, module AS label, 'component' AS type, min_by(file_path, rank) AS file, CASE WHEN bool_or(has_route) THEN 'api' ELSE 'service' END AS layer, count(*) AS chunk_count FROM hm GROUP BY module"),
    "diagram_module_edges": (diagram_module_edges, f"WITH {HITS_CTE} SELECT DISTINCT a.module AS source, b.module AS target, 'imports' AS label, 'import' AS type FROM hm a JOIN calls ON caller = a.name JOIN sm b ON callee = b.name WHERE b.module IN (SELECT module FROM hm) AND a.module <> b.module"),
    "diagram_dataflow_edges": (diagram_dataflow_edges, f"WITH {HITS_CTE} SELECT DISTINCT caller AS source, callee AS target, 'process' AS label, 'dataflow' AS type FROM calls WHERE caller IN (SELECT name FROM h) AND callee IN (SELECT name FROM h)"),
    "diagram_callflow_edges": (diagram_callflow_edges, f"WITH {HITS_CTE} SELECT DISTINCT caller AS source, callee AS target, 'call' AS type FROM calls WHERE caller IN (SELECT name FROM h) AND callee IN (SELECT name FROM h)"),
    "diagram_sequence": (diagram_sequence, f"WITH {HITS_CTE}, s AS (SELECT * FROM hm WHERE CASE WHEN (SELECT bool_or(has_route) FROM h) THEN has_route ELSE rank = 1 END), m AS (SELECT DISTINCT s.rank, s.module, callee FROM s JOIN calls ON caller = s.name) SELECT module AS source, callee AS target, callee AS label, row_number() OVER (ORDER BY rank, callee) AS sequence FROM m"),
    "diagram_class_nodes": (diagram_class_nodes, f"WITH {HITS_CTE}, inh AS ({views.cte(views.INHERITANCE)}) SELECT name AS id, CASE chunk_type WHEN 'interface' THEN 'interface' ELSE 'class' END AS type, false AS external FROM h UNION ALL SELECT DISTINCT parent_name, 'interface', true FROM inh WHERE child_name IN (SELECT name FROM h)"),
    "module_names": (module_names, f"WITH chunks AS ({views.cte(views.CHUNKS)}) SELECT id, array_to_string(string_split(regexp_replace(substr(file_path, 5), '[.][a-z]+$', ''), '/'), '.') AS module, replace(replace(file_path, '/', '_'), '.', '_') AS node, split_part(split_part(file_path, '/', -1), '.', 1) AS stem FROM chunks"),
}
