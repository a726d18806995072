"""Vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import embedding, names, vectors
from codequarry.operators.vector_index import VectorIndex

#: As many ids are pushed to the scan as values (``spark.sql.parquet.pushdown.inFilterThreshold`` in the session).
ASKED_BY_VALUE = 100


def metadata_filter(df: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def nearest(embeddings: DataFrame, query: list[float], k: int, threshold: float | None = None, key: str = "id") -> DataFrame:
    """Exact top-k by cosine: one pass, a bounded heap per task, one small merge."""
    scored = embeddings.withColumn("score", vectors.similarity_to(F.col("embedding"), query)).where("score is not null")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.drop("embedding").orderBy(F.col("score").desc(), key).limit(k)


def query_keywords(query: str) -> list[str]:
    """Distinct lower-case words longer than two letters."""
    return sorted({w.lower() for w in query.replace("_", " ").split() if len(w) > 2})


def query_windows(query: str) -> list[str]:
    """All runs of two and of three words."""
    words = query.split()
    return [" ".join(words[i : i + n]).lower() for i in range(len(words)) for n in (2, 3) if i + n <= len(words)]


def keyword_boost(query: str, name: Column, docstring: Column, content: Column) -> Column:
    """What a chunk gains for words and phrases of the query, at most the cap."""
    keywords = query_keywords(query)
    if not keywords:
        return F.lit(0.0)
    name, docstring, content = F.lower(name), F.lower(F.coalesce(docstring, F.lit(""))), F.lower(content)

    def hits(text: Column) -> Column:
        total = F.lit(0)
        for word in keywords:
            total = total + F.contains(text, F.lit(word)).cast("int")
        return total

    phrases = F.lit(0.0)
    for window in query_windows(query):
        gain = (
            F.when(F.contains(name, F.lit(window)), fixed.PHRASE_BOOST["name"])
            .when(F.contains(docstring, F.lit(window)), fixed.PHRASE_BOOST["docstring"])
            .when(F.contains(content, F.lit(window)), fixed.PHRASE_BOOST["content"])
            .otherwise(0.0)
        )
        phrases = phrases + gain
    in_name, in_doc, in_content = hits(name), hits(docstring), hits(content)
    factor = fixed.KEYWORD_FACTOR
    weight = F.when((in_name == 0) & (in_doc == 0), factor["content_only"]).otherwise(factor["content"])
    single = (in_name * factor["name"] + in_doc * factor["docstring"] + in_content * weight) * fixed.KEYWORD_BOOST
    return F.least(phrases + single, F.lit(fixed.BOOST_CAP))


def hybrid(
    chunks: DataFrame,
    embeddings: DataFrame,
    query: list[float],
    n_results: int = 10,
    repo: str | None = None,
    chunk_type: str | None = None,
    language: str | None = None,
    query_text: str | None = None,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    index: VectorIndex | None = None,
    probes: int = 8,
) -> DataFrame:
    """Vector top-k, over-fetched and re-ranked by keyword boost when the query text is given.

    Phase one scans vectors only, or the nearest lists of ``index``, and ends in three times the ids asked for at most.
    Phase two asks the chunk table for those ids, so row groups without them are skipped and texts are read for hits only.
    Hits that have no chunk, or whose chunk a filter drops, take no places: then phase one runs again on ids of chunks.
    """
    narrow = metadata_filter(chunks, repo_name=repo, chunk_type=chunk_type, language=language)
    candidates = metadata_filter(embeddings, repo_name=repo)
    if chunk_type or language:
        candidates = candidates.join(narrow.select("id"), "id", "left_semi")
    fetch = n_results * 3 if query_text else n_results
    if index is not None and not (chunk_type or language):
        equal = None if repo is None else "repo_name = '" + repo.replace("\\", "\\\\").replace("'", "\\'") + "'"
        scored = index.nearest(query, fetch, probes, where=equal)
    else:
        scored = nearest(candidates.select("id", "embedding"), query, fetch)
    best = [(r["id"], r["score"]) for r in scored.select("id", "score").collect()]
    known = _with_ids(narrow.select("id"), [i for i, _ in best])
    if len(best) == fetch and known.distinct().count() < len({i for i, _ in best}):
        held = candidates.select("id", "embedding").join(narrow.select("id").distinct(), "id", "left_semi")
        best = [(r["id"], r["score"]) for r in nearest(held, query, fetch).collect()]
    hits = chunks.sparkSession.createDataFrame(best, "id string, score double")
    found = _with_ids(narrow, [i for i, _ in best]).join(F.broadcast(hits), "id")
    score = F.col("score")
    if query_text:
        score = F.least(F.lit(1.0), score + keyword_boost(query_text, F.col("name"), F.col("docstring"), F.col("content")))
    return found.withColumn("score", score).where(F.col("score") >= threshold).orderBy(F.col("score").desc(), "id").limit(n_results)


def _with_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows with some ids. A page of ids is asked for by value, so row groups are skipped; more ids are a join."""
    if len(ids) <= ASKED_BY_VALUE:
        return df.where(F.col("id").isin(ids))
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")), "id", "left_semi")


# ---- query text, rewritten once on the driver -----------------------------------------


def rewrite_query(query: str) -> str:
    """``X to Y`` questions also name the layers they connect."""
    three = re.compile(r"\b(from|through)\s+(\w+)\s+to\s+(\w+)\s+to\s+(\w+)", re.IGNORECASE)
    two = re.compile(r"\b(\w+)\s+to\s+(\w+)\b", re.IGNORECASE)
    if three.search(query):
        return three.sub(r"\g<0> \2 \3 \4 layer integration workflow", query)
    return two.sub(r"\g<0> \1 \2 integration layer", query)


def expand_query(query: str) -> str:
    """Append synonyms of the phrases and of the words no phrase covers."""
    lowered = query.lower()
    phrases = [p for p in fixed.QUERY_PHRASES if p in lowered]
    extra = [fixed.QUERY_PHRASES[p] for p in phrases]
    extra += [s for t, s in fixed.QUERY_TERMS.items() if t in lowered and not any(t in p for p in phrases)]
    return f"{query} ({' '.join(extra)})" if extra else query


def expand_column(query: Column) -> Column:
    """``expand_query`` for a column of queries."""
    lowered = F.lower(query)
    covered = {p: F.contains(lowered, F.lit(p)) for p in fixed.QUERY_PHRASES}
    parts = [F.when(covered[p], text) for p, text in fixed.QUERY_PHRASES.items()]
    for term, text in fixed.QUERY_TERMS.items():
        hidden = F.lit(False)
        for phrase, hit in covered.items():
            if term in phrase:
                hidden = hidden | hit
        parts.append(F.when(F.contains(lowered, F.lit(term)) & ~hidden, text))
    extra = F.concat_ws(" ", *parts)
    return F.when(extra == "", query).otherwise(F.concat(query, F.lit(" ("), extra, F.lit(")")))


def model_text(query: str, model: str) -> str:
    """The text a model embeds for a query; retrieval models of one family want an instruction."""
    text = expand_query(rewrite_query(query))
    return fixed.QUERY_INSTRUCTION + text if "bge" in model.lower() else text


def embed_chunks(chunks: DataFrame, model: str = "mock") -> DataFrame:
    """Embedding rows of chunks: what the model makes of their embedding texts."""
    text = names.embedding_text(
        F.col("chunk_type"), F.col("name"), F.col("parent_name"), F.col("docstring"), F.col("signature"),
        F.col("summary"), F.col("file_path"), F.col("language"), F.col("content"),
    )
    return chunks.select("id", "repo_name", F.lit(model).alias("model"), embedding.vectors_of(text, model).alias("embedding"))


def embed_query(query: str, model: str = "mock") -> list[float]:
    return embedding.vector_of(model_text(query, model), model)


def wrong_dimension(embeddings: DataFrame, model: str) -> DataFrame:
    """Rows whose vector length is not the model's; an empty result means the table is sound."""
    return embeddings.where((F.col("model") == model) & (F.size("embedding") != fixed.EMBEDDING_DIMENSIONS.get(model, 768)))


def checked(embeddings: DataFrame, model: str) -> DataFrame:
    """The same table, after making sure that every vector of the model has its length."""
    bad = wrong_dimension(embeddings, model).count()
    if bad:
        raise ValueError(f"{bad} vectors do not have the dimension of {model}")
    return embeddings
