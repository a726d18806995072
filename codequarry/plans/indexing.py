"""Full and incremental index runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.operators import counts, routes, search, snapshots
from codequarry.plans.store import Store
from codequarry import schema
from codequarry.sources import files as sf, git, parsing

PARSED_TABLES = ["chunks", "calls", "inheritance", "class_dependencies"]


def _deduplicated(table: str, df: DataFrame) -> DataFrame:
    """One row per key. Chunk ids hold file, name, kind and line, so a parser never repeats one."""
    if table == "chunks":
        return df
    keys, wins = schema.KEYS[table]
    order = [F.col(c) for c, t in df.dtypes if c not in keys and t in ("string", "int")]
    return counts.keep_one(df, keys, order or [F.lit(0)], last=(wins == "last"))


def _parse(store: Store, files: DataFrame) -> parsing.ParsedTables:
    """Read every file once, parse once.

    The texts land in the shared folder by language, so each parser reads its own languages only
    and many small files become few large ones; the parsed result lands there too, since four
    tables read it.
    """
    texts = store.staged(sf.decoded(files.select("repo_name", "file_path", "content")), by="language")
    return parsing.tables_of(store.staged(parsing.parse_files(texts)))


def _gitignore(path: str) -> list[tuple[str, bool]]:
    try:
        with open(os.path.join(path, ".gitignore"), encoding="utf-8") as handle:
            return sf.gitignore_rules(handle.read())
    except (OSError, UnicodeDecodeError):
        return []


def scan(store: Store, root: str, repo: str | None, globs: list[str] | None = None) -> DataFrame:
    """Source files below a folder, without the ignored ones."""
    rules = _gitignore(root) if "://" not in root else []
    return sf.source_files(sf.read_tree(store.spark, root, repo), rules, globs)


def index_files(store: Store, files: DataFrame, repos: list[str], model: str = "mock") -> DataFrame:
    """Replace the repositories by what their files hold; returns the counters per repository."""
    tables = _parse(store, files)
    for table in PARSED_TABLES:
        store.replace_repos(table, _deduplicated(table, getattr(tables, table)), repos)
    chunks = store.read("chunks").where(F.col("repo_name").isin(repos))
    store.replace_repos("embeddings", search.embed_chunks(chunks, model), repos)
    store.replace_repos("manifest", snapshots.files_of_chunks(files.drop("content"), chunks), repos)
    return parsing.counters(tables.files)


def link_routes(store: Store, repos: list[str], spec: DataFrame | None = None, min_confidence: float | None = None) -> DataFrame:
    """Endpoints, API calls and their links of some repositories, stored; returns the linking figures."""
    chunks = store.read("chunks").where(F.col("repo_name").isin(repos))
    endpoints, calls = routes.endpoints_of(chunks), routes.api_calls_of(chunks)
    if spec is not None:
        endpoints = endpoints.unionByName(spec.select(*endpoints.columns))
    store.replace_repos("endpoints", counts.keep_one(endpoints, ["id"], [F.col("chunk_id")], last=True), repos)
    store.replace_repos("api_calls", counts.keep_one(calls, ["id"], [F.col("chunk_id")], last=True), repos)
    endpoints, calls = store.read("endpoints").where(F.col("repo_name").isin(repos)), store.read("api_calls").where(F.col("repo_name").isin(repos))
    links = routes.link(calls, endpoints, min_confidence or fixed.ROUTE_MIN_CONFIDENCE).drop("match_details")
    owned = links.join(calls.select(F.col("id").alias("call_id"), "repo_name"), "call_id")
    store.replace_repos("route_links", owned, repos)
    return routes.linking_stats(endpoints, calls, store.read("route_links").where(F.col("repo_name").isin(repos)))


def index_repo(store: Store, path: str, repo: str | None = None, incremental: bool = False, model: str = "mock") -> dict:
    """Index one folder; errors are part of the result."""
    if "://" not in path and not os.path.isdir(path):
        return {"error": f"Repository path does not exist: {path}", "status": "error"}
    name = repo or os.path.basename(path.rstrip("/"))
    files = scan(store, path, name)
    if incremental and store.exists("manifest"):
        return update_repo(store, files, name, path, model)
    row = index_files(store, files, [name], model).first()
    commit = git.head(path) if "://" not in path else None
    if commit:
        store.save_commit(name, commit)
    done = row.asDict() if row else {"processed": 0, "skipped": 0, "chunks": 0}
    return {"status": "indexed", "repo_name": name, "files_processed": done["processed"], "files_skipped": done["skipped"], "chunks": done["chunks"] or 0}


def update_repo(store: Store, files: DataFrame, repo: str, path: str | None = None, model: str = "mock") -> dict:
    """Apply the difference to the stored manifest: only buckets of changed files are rewritten."""
    before = store.read("manifest").where(F.col("repo_name") == repo)
    diff = store.staged(snapshots.snapshot_diff(before, files.select("repo_name", "file_path", "mtime", "size")))
    sizes = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"status": "up_to_date", "repo_name": repo, "new": 0, "modified": 0, "deleted": 0}
    live = diff.where("change <> 'deleted'")
    changed_files = files.join(live.select("repo_name", "file_path"), ["repo_name", "file_path"], "left_semi")
    tables = _parse(store, changed_files)
    old_chunks = store.read("chunks").where(F.col("repo_name") == repo).join(diff.select("repo_name", "file_path"), ["repo_name", "file_path"], "left_semi")
    # embeddings follow chunk ids, dependencies follow class names: their changed keys come from both versions
    old_ids = old_chunks.select("repo_name", F.col("id").alias("file_path"))
    new_ids = tables.chunks.select("repo_name", F.col("id").alias("file_path"))
    ids = store.staged(old_ids.unionByName(new_ids).distinct())
    old_classes = old_chunks.where("chunk_type = 'class'").select("repo_name", F.col("name").alias("file_path"))
    new_classes = tables.chunks.where("chunk_type = 'class'").select("repo_name", F.col("name").alias("file_path"))
    classes = store.staged(old_classes.unionByName(new_classes).distinct())
    for table in ("chunks", "calls", "inheritance"):
        store.replace_files(table, _deduplicated(table, getattr(tables, table)), diff)
    store.replace_files("class_dependencies", _deduplicated("class_dependencies", tables.class_dependencies), classes)
    store.replace_files("embeddings", search.embed_chunks(_deduplicated("chunks", tables.chunks), model), ids)
    store.replace_files("manifest", snapshots.files_of_chunks(changed_files.drop("content"), tables.chunks), diff)
    commit = git.head(path) if path and "://" not in path else None
    if commit:
        store.save_commit(repo, commit)
    return {"status": "updated", "repo_name": repo, "new": sizes.get("new", 0), "modified": sizes.get("modified", 0), "deleted": sizes.get("deleted", 0)}


def index_all(
    store: Store, root: str, include: list[str] | None = None, exclude: list[str] | None = None, minimum: int = 1, explicit: list[str] | None = None, model: str = "mock"
) -> dict:
    """All repositories below a folder in one run: one job per table, not one per repository."""
    if "://" not in root and not os.path.isdir(root):
        return {"error": f"Directory does not exist: {root}", "status": "error"}
    files = scan(store, root, None)
    repos = [r["repo_name"] for r in sf.discover(files, include, exclude, minimum, explicit).collect()]
    if not repos:
        return {"status": "no_repositories", "repositories": [], "summary": {"success": 0, "failed": 0, "skipped": 0}}
    results = {r["repo_name"]: r.asDict() for r in index_files(store, files.where(F.col("repo_name").isin(repos)), repos, model).collect()}
    rows = [{"repo_name": n, "status": "success" if n in results else "failed", **{k: v for k, v in results.get(n, {}).items() if k != "repo_name"}} for n in repos]
    return {"status": "complete", "repositories": rows, "summary": {"success": len(results), "failed": len(repos) - len(results), "skipped": 0}}
