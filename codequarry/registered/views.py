"""Inputs derived from the supplied tables.

One SQL text serves both engines; ``{array}`` is the array constructor. Every row of the
base table takes part: modulo only varies derived columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.functions.partitions import dealt, widened

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# documents stand for chunks: sources are repositories, languages are file kinds
CHUNKS = """
SELECT concat('d', CAST(doc_id AS STRING)) AS id,
  source AS repo_name,
  concat('src/', lang, '/', CASE WHEN doc_id % 5 = 1 THEN 'test_' ELSE '' END, 'mod_',
         CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING),
         CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.ts' ELSE '.js' END) AS file_path,
  CAST(1 + (doc_id % 50) * 4 AS INT) AS start_line,
  CAST(1 + (doc_id % 50) * 4 + length(text) - length(replace(text, chr(10), '')) AS INT) AS end_line,
  CASE WHEN n_chars < 600 THEN 'method' WHEN n_chars < 1500 THEN 'function' WHEN n_chars < 3000 THEN 'class'
       WHEN n_chars < 4500 THEN 'constructor' ELSE 'interface' END AS chunk_type,
  CASE doc_id % 6 WHEN 0 THEN concat('getUserData', CAST(doc_id AS STRING))
       WHEN 1 THEN concat('test_fetch_order_', CAST(doc_id AS STRING))
       WHEN 2 THEN concat('ParseHTMLConfig', CAST(doc_id AS STRING))
       WHEN 3 THEN concat('save_the_record_', CAST(doc_id AS STRING))
       WHEN 4 THEN concat('handleEvent', CAST(doc_id AS STRING)) ELSE 'main' END AS name,
  text AS content,
  CASE WHEN doc_id % 3 = 0 THEN concat('def run(self, a: Dict[str, int], b=', CAST(n_chars AS STRING), ') -> List[str]:')
       END AS signature,
  CASE WHEN doc_id % 4 <> 1 THEN split_part(text, chr(10), 1) END AS docstring,
  CASE WHEN n_chars < 600 THEN concat('Class', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING))
       WHEN n_chars >= 4500 THEN '' END AS parent_name,
  CASE WHEN n_chars < 600 THEN 'class' END AS parent_type,
  CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'typescript' ELSE 'javascript' END AS language,
  {array}(CASE doc_id % 4 WHEN 0 THEN 'import requests' WHEN 1 THEN concat('from mod_', CAST(doc_id % 3 AS STRING), ' import run')
               WHEN 2 THEN 'import com.example.spring;' ELSE 'import axios' END,
          CASE WHEN doc_id % 2 = 0 THEN 'from pytest import fixture' ELSE 'import winston' END) AS imports,
  CAST(NULL AS STRING) AS summary
FROM {documents}
"""

SNIPPETS = [
    """import requests
class Loader(BaseService):
    def __init__(self, client: HttpClient):
        try:
            r = requests.get(url)
        except ValueError:
            pass""",
    """def test_order_service(self, a, b: Dict[str, int] = None, *rest):
    service = OrderService()
    assert service.total if service else None
    # done""",
    """/* block
 comment */
public class Shop extends BaseShop implements OrderService {{
  @Autowired
  private Store store;
  if (a && b || c) {{
    for (int i = 0;;) {{ x = y ? 1 : 2; }}
  }}
}}""",
    """async function load(a, b) {{
  const s: OrderService = new OrderService();
  fetch(path).then((r) => axios.get(r));
  switch (a) {{ case 1: break; }}
  // the end
}}""",
    """from app.services import OrderService
async def run(order: OrderService, other: Optional[OrderService]) -> OrderService:
    \"\"\"
    docs
    \"\"\"
    while True:
        with lock:
            if a and b:
                return 1""".replace("\\", ""),
    """describe("x", () => {{
  it("works", () => expect(x).to(y));
}});
this.bus.subscribe(function(e) {{}});""",
]
_SNIPPET = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SNIPPETS)) + " END"

# the same chunks with a piece of code before each whole text
CODE = CHUNKS.replace("text AS content", f"concat({_SNIPPET}, chr(10), text) AS content")

# lineitem rows stand for call sites: parts call suppliers, returned parts are called back; a month is a repository
CALLS = """
SELECT CASE WHEN l_returnflag = 'R' THEN concat('Supplier', CAST(l_suppkey AS STRING))
            ELSE concat('Part', CAST(l_partkey AS STRING)) END AS caller,
  CASE WHEN l_returnflag = 'R' THEN concat('Part', CAST(l_partkey AS STRING))
       ELSE concat('Supplier', CAST(l_suppkey AS STRING)) END AS callee,
  CASE WHEN l_returnflag = 'R' THEN concat('src/supplier_', CAST(l_suppkey % 29 AS STRING), '.py')
       ELSE concat('src/part_', CAST(l_partkey % 997 AS STRING), '.py') END AS caller_file,
  l_linenumber AS caller_line,
  concat('m', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING)) AS repo_name,
  CASE l_linestatus WHEN 'O' THEN 'direct' ELSE 'method' END AS call_type
FROM {lineitem}
"""

# parts and suppliers stand for the symbols of those calls; the largest parts serve routes
SYMBOLS = """
SELECT concat('Part', CAST(p_partkey AS STRING)) AS name, CAST(NULL AS STRING) AS parent_name, p_brand AS repo_name,
  concat('src/part_', CAST(p_partkey % 997 AS STRING), '.py') AS file_path, CAST(p_partkey AS INT) AS start_line,
  CASE WHEN p_size >= 40 THEN 'interface' ELSE 'class' END AS chunk_type, p_size >= 48 AS has_route, p_name AS docstring
FROM {part}
UNION ALL
SELECT concat('Supplier', CAST(s_suppkey AS STRING)) AS name, CAST(NULL AS STRING) AS parent_name, 'suppliers' AS repo_name,
  concat('src/supplier_', CAST(s_suppkey % 29 AS STRING), '.py') AS file_path, CAST(s_suppkey AS INT) AS start_line,
  CASE WHEN s_acctbal >= 5000 THEN 'interface' ELSE 'class' END AS chunk_type, false AS has_route, s_name AS docstring
FROM {supplier}
"""

INHERITANCE = """
SELECT concat('Customer', CAST(c_custkey AS STRING)) AS child_name, concat('Customer', CAST(c_custkey AS STRING)) AS child_qualified,
  concat('Nation', CAST(c_nationkey AS STRING)) AS parent_name, 'extends' AS relation_type,
  concat('src/', lower(c_mktsegment), '.py') AS file_path, 'world' AS repo_name, CAST(c_custkey AS INT) AS line_number FROM {customer}
UNION ALL
SELECT concat('Supplier', CAST(s_suppkey AS STRING)), concat('Supplier', CAST(s_suppkey AS STRING)),
  concat('Nation', CAST(s_nationkey AS STRING)), 'implements', 'src/supplier.py', 'world', CAST(s_suppkey AS INT) FROM {supplier}
UNION ALL
SELECT concat('Nation', CAST(n_nationkey AS STRING)), concat('Nation', CAST(n_nationkey AS STRING)),
  concat('Region', CAST(n_regionkey AS STRING)), 'implements', 'src/nation.py', 'world', CAST(n_nationkey AS INT) FROM {nation}
"""

# pages stand for routes: secure ones are endpoints, plain ones are calls
ROUTES = """
SELECT page_id, url,
  CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method,
  concat('/', regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), '/',
         CASE page_id % 5 WHEN 0 THEN '{{pageId}}' WHEN 1 THEN ':page_id' WHEN 2 THEN '<page>' WHEN 3 THEN concat('$', '{{pageId}}')
              ELSE regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9])', 1) END,
         CASE WHEN page_id % 7 < 3 THEN concat('/Items/', CASE WHEN page_id % 2 = 0 THEN ':item-id' ELSE '{{itemId}}' END) ELSE '' END) AS path,
  concat('repo_', regexp_extract(url, '[.]([a-z]+)/', 1)) AS repo_name,
  concat('src/page_', CAST(page_id AS STRING), '.ts') AS file_path,
  concat('page', CAST(page_id AS STRING)) AS name,
  CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language,
  url LIKE 'https://%' AS is_endpoint
FROM {pages}
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose rows are heavy to work on."""
    return widened(read(spark, sf_dir, table))


def view(spark: SparkSession, sf_dir: str, text: str, heavy: bool = False) -> DataFrame:
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if "documents" in used and heavy:
        used["documents"] = widened(used["documents"])
    return spark.sql(text.replace("{array}", "array"), **used)


def sources(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Source texts written from narrow tables: their rows are dealt out before the texts exist, since each is parsed."""
    return spark.sql(text.replace("{array}", "array"), **{t: dealt(read(spark, sf_dir, t)) for t in TABLES if "{" + t + "}" in text})


def cte(text: str) -> str:
    """The view text for the checking engine."""
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text.replace("{array}", "list_value").replace("{{", "{").replace("}}", "}")


def chunks(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    from codequarry.schema import METADATA, as_struct

    return view(spark, sf_dir, CHUNKS, heavy).selectExpr("*", f"CAST(NULL AS {as_struct(METADATA)}) AS metadata")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.schema import METADATA, as_struct

    return view(spark, sf_dir, CODE, heavy=True).selectExpr("*", f"CAST(NULL AS {as_struct(METADATA)}) AS metadata")


def route_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks whose metadata holds a route or an outgoing call."""
    return view(spark, sf_dir, ROUTES).selectExpr(
        "concat('p', page_id) AS id", "repo_name", "file_path", "CAST(page_id AS INT) AS start_line", "name", "CAST(NULL AS STRING) AS parent_name", "language",
        "named_struct('route', CASE WHEN is_endpoint THEN named_struct('method', method, 'path', path, 'framework', CAST(NULL AS STRING)) END, "
        "'outgoing_api_calls', CASE WHEN NOT is_endpoint THEN array(named_struct('method', method, 'url', path)) END) AS metadata",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CALLS)


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INHERITANCE)


def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, SYMBOLS)
    return df.selectExpr(
        "name AS id", "repo_name", "file_path", "start_line", "start_line AS end_line", "chunk_type", "name", "docstring",
        "CAST(NULL AS STRING) AS signature", "parent_name", "'python' AS language",
        "named_struct('route', CASE WHEN has_route THEN named_struct('method', 'GET', 'path', concat('/', name), 'framework', "
        "CAST(NULL AS STRING)) END, 'is_react_component', CAST(NULL AS BOOLEAN)) AS metadata",
    )
