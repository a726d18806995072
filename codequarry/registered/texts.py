"""Queries over whole texts: metrics, secrets, conventions, usages and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import metrics as mf, names
from codequarry.operators import conventions, metrics, security, usages
from codequarry.registered import views

CODE_CTE = f"chunks AS ({views.cte(views.CODE)})"
# every non-ASCII character of the texts is a letter; for word boundaries a 'z' stands for it
FOLDED_CTE = CODE_CTE + r", folded AS (SELECT *, regexp_replace(content, '[^\x00-\x7F]', 'z', 'g') AS f FROM chunks)"


def _code(spark, sf_dir):
    return views.code_chunks(spark, sf_dir)


def _q(regex: str) -> str:
    return regex.replace("'", "''")


# ---- metrics ----------------------------------------------------------------------


def cyclomatic(spark, sf_dir):
    value = mf.cyclomatic(F.col("content"), F.col("language"))
    return _code(spark, sf_dir).select("id", value.cast("bigint").alias("cyclomatic"), mf.cyclomatic_rating(value).alias("rating"))


def _count_sql(regex: str) -> str:
    """Matches of a pattern in the folded text; look-aheads are spelled out."""
    if regex == r"\bif\b(?!\s*__name__)":
        return r"len(regexp_extract_all(f, '\bif\b')) - len(regexp_extract_all(f, '\bif\b\s*__name__'))"
    if regex == r"\bif\b.*\belse\b(?!:)":
        return r"len(regexp_extract_all(f, '\bif\b.*\belse\b(?:[^:\n]|(?:$|\n))'))"
    return f"len(regexp_extract_all(f, '{_q(regex)}'))"


def _cyclomatic_sql() -> str:
    totals = {lang: " + ".join(_count_sql(p) for p in patterns) for lang, patterns in fixed.DECISION_POINTS.items()}
    return f"""1 + CASE language WHEN 'python' THEN {totals['python']} WHEN 'java' THEN {totals['java']} ELSE {totals['typescript']} END"""


def line_metrics(spark, sf_dir):
    loc = mf.line_counts(F.col("content"), F.col("language"))
    return _code(spark, sf_dir).select("id", loc.alias("loc")).select(
        "id", *[F.col(f"loc.{c}").cast("bigint").alias(c) for c in ("total_lines", "source_lines", "comment_lines", "blank_lines")], "loc.comment_ratio"
    )


LINES_SQL = f"""lines AS (SELECT id, language, i, list_extract(ls, i) AS line, regexp_replace(list_extract(ls, i), '^\\s+|\\s+$', '', 'g') AS s
 FROM (SELECT id, language, string_split(content, chr(10)) AS ls FROM chunks), unnest(range(1, len(ls) + 1)) AS u(i)),
marked AS (SELECT *, language = 'python' AND (starts_with(s, '\"\"\"') OR starts_with(s, '''''''''')) AS quoted,
 language <> 'python' AND contains(s, '/*') AS opens, language <> 'python' AND contains(s, '*/') AS closes FROM lines),
state AS (SELECT *, sum(quoted::INT) OVER (PARTITION BY id ORDER BY i) AS quotes,
 last_value(CASE WHEN closes THEN 0 WHEN opens THEN 1 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS block FROM marked),
kinds AS (SELECT *, CASE WHEN quoted OR quotes % 2 = 1 OR closes OR coalesce(block, 0) = 1 THEN 'comment' WHEN s = '' THEN 'blank'
 WHEN starts_with(s, '#') OR starts_with(s, '//') THEN 'comment' ELSE 'source' END AS kind FROM state),
loc AS (SELECT id, count(*) AS total_lines, count(*) FILTER (kind = 'source') AS source_lines, count(*) FILTER (kind = 'comment') AS comment_lines,
 count(*) FILTER (kind = 'blank') AS blank_lines FROM kinds GROUP BY id)"""


def cognitive(spark, sf_dir):
    value = mf.cognitive(F.col("content"), F.col("language"))
    return _code(spark, sf_dir).select("id", value.alias("c")).select(
        "id", *[F.col(f"c.{c}").cast("bigint").alias(c) for c in ("complexity", "nesting_depth_max", "nested_penalties")], mf.cognitive_rating(F.col("c.complexity")).alias("rating")
    )


COGNITIVE_SQL = r"""code AS (SELECT *, length(line) - length(regexp_replace(line, '^\s+', '')) AS indent,
   regexp_replace(line, '[^\x00-\x7F]', 'z', 'g') AS f FROM lines WHERE s <> '' AND NOT (starts_with(s, '#') OR starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*'))),
lvl AS (SELECT *, greatest(0, floor((indent - first_value(indent) OVER (PARTITION BY id ORDER BY i)) / 4))::BIGINT AS nesting,
 CASE WHEN language = 'python' THEN regexp_matches(f, '^\s*(if|elif|for|while|except|with)\b') ELSE regexp_matches(f, '^\s*(if|else\s+if|for|while|catch|switch)\s*[\({]') END AS flow,
 CASE WHEN language = 'python' THEN regexp_matches(f, '^\s*(and|or)\b')::BIGINT ELSE len(regexp_extract_all(f, '&&|\|\|')) END AS bools FROM code),
pts AS (SELECT *, CASE WHEN flow AND nesting > 1 THEN nesting - 1 ELSE 0 END AS penalty FROM lvl),
cog AS (SELECT id, sum(CASE WHEN flow THEN 1 + penalty ELSE bools END)::BIGINT AS complexity, max(nesting)::BIGINT AS nesting_depth_max, sum(penalty)::BIGINT AS nested_penalties FROM pts GROUP BY id)"""


def halstead(spark, sf_dir):
    value = mf.halstead(F.col("content"), F.col("language"))
    counts = ("distinct_operators", "distinct_operands", "total_operators", "total_operands", "vocabulary", "length")
    return _code(spark, sf_dir).select("id", value.alias("h")).select("id", *[F.col(f"h.{c}").cast("bigint").alias(c) for c in counts], F.col("h.volume").alias("volume"))


def _halstead_sql() -> str:
    word = r"[\p{L}\p{N}_]"

    def tokens(patterns):
        parts = []
        for p in patterns:
            if p.startswith(r"\b("):
                inner = p[3:-3].replace("(", "")
                parts.append(f"list_transform(regexp_extract_all(f, '\\b(?:{inner})\\b'), lambda x: x)")
            else:
                parts.append(f"regexp_extract_all(content, '{_q(p)}')")
        return " || ".join(parts)

    identifiers = f"regexp_extract_all(content, '(?:^|[^\\p{{L}}\\p{{N}}_])([a-zA-Z_]{word}*)', 1)"
    literals = r"""regexp_extract_all(f, '\b\d+\.?\d*\b|"[^"]*"|''[^'']*''')"""
    ops = fixed.HALSTEAD_OPERATORS
    return f"""t AS (SELECT id, CASE WHEN language = 'python' THEN {tokens(ops['python'])} ELSE {tokens(ops['other'])} END AS o, {identifiers} || {literals} AS d FROM folded),
n AS (SELECT id, len(list_distinct(o)) AS n1, greatest(len(list_distinct(d)), 1) AS n2, len(o) AS b1, len(d) AS b2 FROM t)
SELECT id, n1 AS distinct_operators, n2 AS distinct_operands, b1 AS total_operators, b2 AS total_operands, n1 + n2 AS vocabulary, b1 + b2 AS length,
 round_even((b1 + b2) * log2((n1 + n2)::DOUBLE), 2) AS volume FROM n"""


def parameter_counts(spark, sf_dir):
    return _code(spark, sf_dir).select("id", mf.parameter_count(F.col("content"), F.col("language")).cast("bigint").alias("parameters"))


PARAMETERS_SQL = r"""args AS (SELECT id, language, CASE WHEN language = 'python' THEN regexp_extract(content, 'def\s+[\p{L}\p{N}_]+\s*\(([^)]*)\)', 1)
   ELSE regexp_extract(content, '[\p{L}\p{N}_]\s*\(([^)]*)\)', 1) END AS args FROM chunks),
depths AS (SELECT *, list_transform(range(1, length(args) + 1), lambda i: CASE WHEN args[i] = ',' AND
   length(regexp_replace(args[1:i], '[^\[<(]', '', 'g')) = length(regexp_replace(args[1:i], '[^\]>)]', '', 'g')) THEN chr(1) ELSE args[i] END) AS marked FROM args),
parts AS (SELECT id, language, args, list_transform(string_split(array_to_string(marked, ''), chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))) AS parts FROM depths)"""


def function_hotspots(spark, sf_dir):
    """Ten most complex functions of all texts."""
    hot = metrics.hotspots(metrics.function_metrics(_code(spark, sf_dir)))
    return hot.select("name", "file", "repo_name", F.col("cyclomatic").cast("bigint").alias("cyclomatic"), F.col("cognitive").cast("bigint").alias("cognitive"), F.col("lines").cast("bigint").alias("lines"), "rating")


def repository_metrics(spark, sf_dir):
    return metrics.repository_metrics(_code(spark, sf_dir), by_repo=True)


# ---- secrets -----------------------------------------------------------------------------


def secret_scan(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents")
    found = security.scan(docs, "text", ["doc_id"])
    return found.select("doc_id", F.col("line_number").cast("bigint").alias("line_number"), "secret_type", "severity", "matched_text", "rule_id", F.round("confidence", 6).alias("confidence"))


def _secret_cte() -> str:
    rules = " UNION ALL ".join(
        f"SELECT doc_id, i, line, '{k}' AS secret_type, '{s}' AS severity, unnest(regexp_extract_all(line, '{_q(r)}')) AS m FROM lines"
        for k, s, r, _, _ in fixed.SECRET_RULES
    )
    placeholder = " OR ".join(f"contains(lower(m), '{w}') OR contains(low, '{w}')" for w in fixed.PLACEHOLDER_WORDS)
    comment = " OR ".join(f"starts_with(low, '{_q(w)}')" for w in fixed.COMMENT_STARTS)
    certain = ", ".join(f"'{w}'" for w in fixed.CERTAIN_SECRETS)
    return f"""lines AS (SELECT doc_id, i, list_extract(ls, i) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
raw AS ({rules}), low AS (SELECT *, lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS low FROM raw),
c AS (SELECT *, 0.85::DOUBLE - CASE WHEN {placeholder} THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN {comment} THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(line, '[=:]\\s*["'']') THEN 0.05::DOUBLE ELSE 0 END AS c0 FROM low),
found AS (SELECT *, greatest(0, least(1, CASE WHEN secret_type IN ({certain}) THEN greatest(c0, 0.9::DOUBLE) ELSE c0 END)) AS confidence FROM c)"""


def secret_severity_summary(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents")
    return security.by_severity(security.scan(docs, "text", ["doc_id"]))


def secret_scan_result(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents")
    return security.scan_result(security.scan(docs, "text", ["doc_id"], "high"), docs, ["doc_id"])


def page_secrets(spark, sf_dir):
    """The same rules over raw pages."""
    pages = views.texts(spark, sf_dir, "pages")
    return security.scan(pages, "html", ["page_id"]).groupBy("page_id", "secret_type").agg(F.count("*").alias("n"))


# ---- conventions ----------------------------------------------------------------------------


def pattern_share(spark, sf_dir):
    report = conventions.pattern_report(conventions.pattern_hits(_code(spark, sf_dir)))
    return report.withColumn("occurrence_count", F.col("occurrence_count").cast("bigint"))


def _pattern_cte() -> str:
    rows = []
    for category, patterns in fixed.CODE_PATTERNS.items():
        for name, regexes in patterns.items():
            total = " + ".join(f"len(regexp_extract_all(f, '{_q(r)}'))" for r in regexes)
            rows.append(f"SELECT '{category}' AS category, '{name}' AS pattern_name, sum({total})::BIGINT AS occurrence_count FROM folded")
    return f"{FOLDED_CTE}, pc AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE occurrence_count > 0)"


def pattern_examples(spark, sf_dir):
    places = conventions.pattern_examples(conventions.pattern_hits(_code(spark, sf_dir), "testing", places=True))
    return places.drop("confidence")


def _examples_sql() -> str:
    """All matches, then the first three per pattern."""
    parts = [
        f"SELECT '{name}' AS pattern_name, '{_q(r)}' AS r, id, repo_name, file_path, start_line, i, unnest(regexp_extract_all(line, '{_q(r)}')) AS m FROM ln"
        for name, regexes in fixed.CODE_PATTERNS["testing"].items() for r in regexes
    ]
    return f"""WITH {FOLDED_CTE}, ln AS (SELECT id, repo_name, file_path, start_line, i, list_extract(ls, i) AS line FROM (SELECT *, string_split(f, chr(10)) AS ls FROM folded), unnest(range(1, len(ls) + 1)) AS u(i)),
m AS ({' UNION ALL '.join(parts)}), r AS (SELECT 'testing' AS category, pattern_name, repo_name, file_path, (start_line + i - 1)::INT AS line_number, m[1:100] AS code_snippet FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY pattern_name ORDER BY repo_name, file_path, line_number, code_snippet)::INT AS rank FROM r) SELECT * FROM x WHERE rank <= 3"""


def library_usage(spark, sf_dir):
    return conventions.library_report(conventions.library_uses(_code(spark, sf_dir)))


def top_libraries(spark, sf_dir):
    report = conventions.library_report(conventions.library_uses(_code(spark, sf_dir)))
    return conventions.top_libraries(report, 2).select("category", "library", "import_count", "call_count", F.col("rank").cast("bigint").alias("rank"))


def _library_cte() -> str:
    names_ = [l for ls in fixed.LIBRARY_CATEGORIES.values() for l in ls]
    calls = " UNION ALL ".join(f"SELECT '{l}' AS library, sum(len(regexp_extract_all(f, '(?i)\\b{l}\\.')))::BIGINT AS n FROM folded" for l in names_)
    category = "CASE " + " ".join(f"WHEN library IN ({', '.join(repr(l) for l in ls)}) THEN '{c}'" for c, ls in fixed.LIBRARY_CATEGORIES.items()) + " END"
    return f"""{FOLDED_CTE}, imp AS (SELECT repo_name, file_path, unnest(imports) AS s FROM chunks),
il AS (SELECT repo_name, file_path, lower(coalesce(nullif(regexp_extract(s, '^from\\s+(\\w+)', 1), ''), nullif(regexp_extract(s, '^import\\s+(\\w+)', 1), ''))) AS library FROM imp),
ic AS (SELECT library, count(*) AS import_count, count(DISTINCT (repo_name, file_path)) AS file_count FROM il GROUP BY ALL),
cc AS (SELECT * FROM ({calls}) WHERE n > 0),
rep AS (SELECT library, coalesce(import_count, 0) AS import_count, coalesce(file_count, 0) AS file_count, coalesce(n, 0) AS call_count, {category} AS category FROM ic FULL JOIN cc USING (library))"""


def testing_conventions(spark, sf_dir):
    return conventions.testing_conventions(_code(spark, sf_dir))


def golden_files(spark, sf_dir):
    """Every file that reaches the minimum score."""
    best = conventions.golden_files(_code(spark, sf_dir), None)
    return best.select("repo_name", "file_path", "symbol_count", F.col("score").cast("bigint").alias("score"), "test_coverage_indicator", "reasons")


GOLDEN_SQL = r"""WITH {code}, f AS (SELECT repo_name, file_path, count(*) AS symbol_count, max(end_line) AS line_count, bool_or(coalesce(docstring, '') <> '') AS documented FROM chunks
 WHERE NOT (contains(lower(file_path), 'test_')) GROUP BY ALL HAVING count(*) >= 2),
files AS (SELECT DISTINCT repo_name, file_path, split_part(file_path, '/', -1) AS base FROM chunks),
m AS (SELECT DISTINCT id, repo_name, file_path, unnest(string_split_regex(lower(s), '[^a-z0-9_\-]+')) AS stem FROM (SELECT id, repo_name, file_path, unnest(imports) AS s FROM chunks)),
j AS (SELECT f.*, split_part(f.file_path, '/', -1) AS base FROM f),
k AS (SELECT j.*, exists(SELECT 1 FROM files t WHERE t.repo_name = j.repo_name AND t.base = 'test_' || j.base) AS tested,
 (SELECT count(DISTINCT m.id) FROM m WHERE m.repo_name = j.repo_name AND m.file_path <> j.file_path AND m.stem = split_part(j.base, '.', 1)) AS refs FROM j),
s AS (SELECT *, symbol_count / line_count * 100 > 5 AS dense,
 least(100, 25 * documented::INT + 20 * (symbol_count / line_count * 100 > 5)::INT + 30 * tested::INT + 15 * (symbol_count >= 5)::INT + 10 * (refs >= 3)::INT)::BIGINT AS score FROM k)
SELECT repo_name, file_path, symbol_count, score, tested AS test_coverage_indicator,
 list_filter([CASE WHEN documented THEN 'Contains documentation' END, CASE WHEN dense THEN 'Well-structured code' END, CASE WHEN tested THEN 'Has associated tests' END,
  CASE WHEN symbol_count >= 5 THEN 'Comprehensive implementation' END, CASE WHEN refs >= 3 THEN 'Referenced by ' || refs || ' files' END], lambda x: x IS NOT NULL) AS reasons
FROM s WHERE score >= 40"""


def momentum(spark, sf_dir):
    """Event kinds of the last fifteen days against the fifteen before."""
    events = views.read(spark, sf_dir, "events")
    return conventions.momentum(events, "event_type", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 15)


# ---- usages and tests ---------------------------------------------------------------------------


def find_usages(spark, sf_dir):
    found = usages.find_usages(_code(spark, sf_dir), views.calls(spark, sf_dir), "OrderService", include_definitions=True, limit=None)
    return found.select("category", "repo_name", "file_path", F.col("line").cast("bigint").alias("line"))


def usage_totals(spark, sf_dir):
    found = usages.find_usages(_code(spark, sf_dir), views.calls(spark, sf_dir), "OrderService", limit=None)
    return usages.usage_totals(found)


def _usages_cte() -> str:
    parts = [
        f"SELECT DISTINCT '{c}' AS category, repo_name, file_path, start_line + i - 1 AS line FROM lines WHERE regexp_matches(f, '{'(?i)' if 'i' in flags else ''}{_q(r)}')"
        for c, r, flags in usages.usage_rules("OrderService")
    ]
    return f"""{FOLDED_CTE}, lines AS (SELECT repo_name, file_path, start_line, i, list_extract(ls, i) AS f FROM (SELECT *, string_split(f, chr(10)) AS ls FROM folded WHERE contains(content, 'OrderService')),
 unnest(range(1, len(ls) + 1)) AS u(i)), us AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"""


def find_test_files(spark, sf_dir):
    return usages.test_files(_code(spark, sf_dir), "OrderService")


def find_test_methods(spark, sf_dir):
    return usages.test_methods(_code(spark, sf_dir), "FetchOrder").select("repo_name", "file_path", "name", F.col("line").cast("bigint").alias("line"), "match_reason")


REPOSITORY_SQL = f"""WITH {FOLDED_CTE}, {LINES_SQL}, {COGNITIVE_SQL}, {PARAMETERS_SQL},
cnt AS (SELECT id, CASE WHEN trim(args) = '' THEN 0 ELSE len(list_filter(parts, lambda p: p <> '' AND NOT (language = 'python' AND p IN ('self', 'cls')))) END AS parameters FROM parts),
m AS (SELECT f.*, ({_cyclomatic_sql()}) AS cyc, coalesce(cog.complexity, 0) AS cog, parameters, total_lines, source_lines, comment_lines, blank_lines,
 chunk_type IN ('function', 'method', 'constructor') AS fn, chunk_type IN ('class', 'interface') AS cls FROM folded f JOIN loc USING (id) LEFT JOIN cog USING (id) JOIN cnt USING (id)),
{_halstead_sql().split("SELECT id, n1 AS distinct_operators")[0].rstrip()}, vol AS (SELECT id, round_even((b1 + b2) * log2((n1 + n2)::DOUBLE), 2) AS volume FROM n),
av AS (SELECT repo_name, avg(volume) AS v FROM m JOIN vol USING (id) WHERE fn GROUP BY ALL),
a AS (SELECT repo_name, count(DISTINCT file_path) FILTER (fn OR cls) AS total_files, count(*) FILTER (fn) AS total_functions, count(*) FILTER (cls) AS total_classes, sum(total_lines)::BIGINT AS total_lines, sum(source_lines)::BIGINT AS source_lines,
 sum(comment_lines)::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines, coalesce(avg(cyc) FILTER (fn), 0) AS ac, coalesce(avg(cog) FILTER (fn), 0) AS ag,
 count(*) FILTER (fn AND (cyc > 10 OR cog > 15 OR source_lines > 50 OR parameters > 5)) AS complex_function_count FROM m GROUP BY repo_name)
SELECT repo_name, total_files, total_functions, total_classes, total_lines, source_lines, comment_lines, blank_lines, round_even(comment_lines / source_lines, 3) AS comment_ratio, round_even(ac, 2) AS avg_cyclomatic,
 round_even(ag, 2) AS avg_cognitive, complex_function_count, round_even(complex_function_count / total_functions * 100, 1) AS complex_function_percentage,
 round_even(greatest(0, (171 - 5.2::DOUBLE * ln(greatest(coalesce(v, 0), 1)) - 0.23::DOUBLE * ac - 16.2::DOUBLE * ln(greatest(source_lines / total_files, 1))) * 100 / 171), 1) AS maintainability_index FROM a LEFT JOIN av USING (repo_name)"""

QUERIES = {
    "cyclomatic": (cyclomatic, f"WITH {FOLDED_CTE}, c AS (SELECT id, ({_cyclomatic_sql()})::BIGINT AS cyclomatic FROM folded) SELECT *, CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'high' ELSE 'very_high' END AS rating FROM c"),
    "line_metrics": (line_metrics, f"WITH {CODE_CTE}, {LINES_SQL} SELECT *, CASE WHEN source_lines > 0 THEN round_even(comment_lines / source_lines, 3) ELSE 0 END AS comment_ratio FROM loc"),
    "cognitive": (cognitive, f"WITH {CODE_CTE}, {LINES_SQL}, {COGNITIVE_SQL} SELECT chunks.id, coalesce(complexity, 0) AS complexity, coalesce(nesting_depth_max, 0) AS nesting_depth_max, coalesce(nested_penalties, 0) AS nested_penalties, CASE WHEN coalesce(complexity, 0) <= 5 THEN 'low' WHEN complexity <= 15 THEN 'moderate' WHEN complexity <= 25 THEN 'high' ELSE 'very_high' END AS rating FROM chunks LEFT JOIN cog USING (id)"),
    "halstead": (halstead, f"WITH {FOLDED_CTE}, {_halstead_sql()}"),
    "parameter_counts": (parameter_counts, f"WITH {CODE_CTE}, {PARAMETERS_SQL} SELECT id, CASE WHEN trim(args) = '' THEN 0 ELSE len(list_filter(parts, lambda p: p <> '' AND NOT (language = 'python' AND p IN ('self', 'cls')))) END AS parameters FROM parts"),
    "function_hotspots": (function_hotspots, f"WITH {FOLDED_CTE}, {LINES_SQL}, {COGNITIVE_SQL}, c AS (SELECT CASE WHEN nullif(parent_name, '') IS NULL THEN name ELSE parent_name || '.' || name END AS name, file_path || ':' || start_line AS file, repo_name, ({_cyclomatic_sql()})::BIGINT AS cyclomatic, complexity AS cognitive, source_lines AS lines FROM folded JOIN cog USING (id) JOIN loc USING (id) WHERE chunk_type IN ('function', 'method', 'constructor') ORDER BY cyclomatic DESC, name, file, repo_name LIMIT 10) SELECT *, CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'high' ELSE 'very_high' END AS rating FROM c"),
    "repository_metrics": (repository_metrics, REPOSITORY_SQL),
    "secret_scan": (secret_scan, f"WITH {_secret_cte()} SELECT doc_id, i AS line_number, secret_type, severity, CASE WHEN length(m) <= 8 THEN m[1:2] || '***' ELSE m[1:4] || '...' || m[-4:] END AS matched_text, 'SEC-' || upper(secret_type) AS rule_id, round(confidence, 6) AS confidence FROM found WHERE confidence >= 0.5"),
    "secret_severity_summary": (secret_severity_summary, f"WITH {_secret_cte()}, l AS (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity, unnest([0, 1, 2, 3, 4])::INT AS severity_rank) SELECT severity, severity_rank, (SELECT count(*) FROM found WHERE found.severity = l.severity AND confidence >= 0.5) AS n FROM l"),
    "secret_scan_result": (secret_scan_result, f"WITH {_secret_cte()}, h AS (SELECT * FROM found WHERE confidence >= 0.5 AND severity IN ('high', 'critical')) SELECT (SELECT count(*) FROM documents) AS total_files_scanned, count(*) AS total_findings, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in fixed.SEVERITIES) + " FROM h"),
    "page_secrets": (page_secrets, f"WITH {_secret_cte().replace('doc_id', 'page_id').replace('string_split(text', 'string_split(html').replace('FROM documents', 'FROM pages')} SELECT page_id, secret_type, count(*) AS n FROM found WHERE confidence >= 0.5 GROUP BY ALL"),
    "pattern_share": (pattern_share, f"WITH {_pattern_cte()} SELECT *, round(occurrence_count / sum(occurrence_count) OVER (PARTITION BY category) * 100, 1) AS percentage, row_number() OVER (PARTITION BY category ORDER BY occurrence_count DESC, pattern_name) = 1 AS recommended FROM pc"),
    "pattern_examples": (pattern_examples, _examples_sql()),
    "library_usage": (library_usage, f"WITH {_library_cte()} SELECT library, import_count, file_count, call_count, category FROM rep"),
    "top_libraries": (top_libraries, f"WITH {_library_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY import_count + call_count DESC, library) AS rank FROM rep WHERE category IS NOT NULL) SELECT category, library, import_count, call_count, rank FROM r WHERE rank <= 2"),
    "testing_conventions": (testing_conventions, f"WITH {CODE_CTE} SELECT 'pytest' AS framework, count(*) AS usage_count, ['test_*.py'] AS file_patterns, ['assert'] AS common_assertions, 'pytest-mock' AS mock_library FROM chunks WHERE regexp_matches(file_path, 'test_\\w+\\.py$') AND (SELECT count(*) FROM chunks WHERE regexp_matches(content, 'assert\\s+\\w+')) > 0"),
    "golden_files": (golden_files, GOLDEN_SQL.replace("{code}", CODE_CTE)),
    "momentum": (momentum, "WITH c AS (SELECT event_type, count(*) FILTER (ts > TIMESTAMP '2024-01-16' AND ts <= TIMESTAMP '2024-01-31') AS recent, count(*) FILTER (ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-16') AS previous FROM events GROUP BY ALL) SELECT *, CASE WHEN recent > previous * 1.2 THEN 'increasing' WHEN recent < previous * 0.8 THEN 'decreasing' ELSE 'stable' END AS momentum FROM c"),
    "find_usages": (find_usages, f"WITH {_usages_cte()} SELECT * FROM us"),
    "usage_totals": (usage_totals, f"WITH {_usages_cte()} SELECT category, count(*) AS n FROM us GROUP BY ALL"),
    "find_test_files": (find_test_files, f"WITH {CODE_CTE}, r AS (SELECT repo_name, file_path, min(CASE WHEN contains(lower(content), 'orderservice') THEN 2 END) AS r FROM chunks WHERE contains(lower(file_path), 'test_') GROUP BY ALL) SELECT repo_name, file_path, 'content_reference' AS match_reason FROM r WHERE r IS NOT NULL"),
    "find_test_methods": (find_test_methods, f"WITH {CODE_CTE}, t AS (SELECT repo_name, file_path, name, start_line, CASE WHEN regexp_matches(lower(name), 'test.*fetch_order|test.*fetchorder') THEN 1 WHEN (starts_with(lower(name), 'test') OR contains(lower(parent_name), 'test')) AND contains(lower(content), 'fetchorder') THEN 2 END AS r FROM chunks WHERE contains(lower(file_path), 'test_') AND chunk_type IN ('function', 'method')), m AS (SELECT repo_name, file_path, name, min((r, start_line)) AS f FROM t WHERE r IS NOT NULL GROUP BY ALL) SELECT repo_name, file_path, name, f[2]::BIGINT AS line, CASE f[1] WHEN 1 THEN 'method_name_pattern' ELSE 'content_reference' END AS match_reason FROM m"),
}
