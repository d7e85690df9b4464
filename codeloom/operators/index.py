"""The tables of an index at one time, lookups in them, and its upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import key_form


def current_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per id: the version without removed_at; of several the latest, then the first by content_hash."""
    rows = chunks.where("removed_at is null")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("indexed_at"), "content_hash", "file_path", "start_line"))
    keep = dict.fromkeys(("id", "indexed_at", "content_hash", "file_path", "start_line", *columns))
    return (rows.select(*keep) if columns else rows).withColumn("_r", rank).where("_r = 1").drop("_r")


def with_symbol(chunks: DataFrame) -> DataFrame:
    """Adds name_lower, null for empty and anonymous names."""
    key = key_form("name")
    return chunks.withColumn("name_lower", F.when(key != "anonymous", key))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges with keys in the form used for comparing, once each (repeated rows, self references kept); without a target none."""
    return edges.select(key_form("from_chunk_id").alias("src"), key_form("to_chunk_id").alias("dst"), "kind", "confidence").where("src is not null and dst is not null").distinct()


def distinct_calls(call_edges: DataFrame) -> DataFrame:
    """callee, chunk_id: call edges at the level of names."""
    return call_edges.select(key_form("callee").alias("callee"), key_form("chunk_id").alias("chunk_id")).where("callee is not null and chunk_id is not null").distinct()


# -- lexical index ------------------------------------------------------------------------------

def chunk_terms(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf of the lexical document of each chunk; raw tokens only."""
    tokens = chunks.select(F.col("id").alias("chunk_id"), F.explode(T.raw_tokens(T.lexical_document())).alias("term"))
    return tokens.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def stems_of(tokens: DataFrame) -> DataFrame:
    """term, stem of the distinct tokens (term) whose stem differs, in the name space of stems; in Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("term").to_pylist()
            stems = [T.stem(t) if t.isascii() else t for t in tokens]
            kept = [(t, T.STEM_PREFIX + s) for t, s in zip(tokens, stems) if s != t and len(s) >= 3]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string())], ["term", "stem"])

    return tokens.select("term").distinct().mapInArrow(run, "term string, stem string")


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings of the stems that differ from their token, in the name space of stems.

    Stems are computed once per distinct token.
    """
    return postings.join(stems_of(postings), "term").groupBy("chunk_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def document_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id").agg(F.sum("tf").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


# -- lookups -------------------------------------------------------------------------------------

def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id)


def chunks_by_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("start_line", "id")


def resolve_symbol(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks of a name, whatever its case; anonymous ones never."""
    return with_symbol(chunks).where(F.col("name_lower") == name.strip().lower())


def resolve_names(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """All definitions of each of ``names`` (name): name, chunk_id, file_path."""
    defs = with_symbol(chunks).where("name_lower is not null").select(F.col("name_lower").alias("key"), F.col("id").alias("chunk_id"), "file_path")
    return names.select("name", key_form("name").alias("key")).join(defs, "key").drop("key")


def current_routes(routes: DataFrame) -> DataFrame:
    """Routes once each, methods in upper case."""
    return routes.withColumn("method", F.upper(F.btrim("method"))).withColumn("handler_chunk_id", key_form("handler_chunk_id")).dropDuplicates(["route_ord"])


def find_routes(routes: DataFrame, method: str | None = None, path: str | None = None) -> DataFrame:
    """Routes of a method whose path starts with ``path`` if that starts with a slash, else holds it; sorted."""
    found = routes
    if method:
        found = found.where(F.col("method") == method.upper())
    if path:
        low = F.lower("path")
        found = found.where(low.startswith(path.lower()) if path.startswith("/") else low.contains(path.lower()))
    return found.orderBy("file_path", "line", "method", "path", "route_ord")


def routes_with_handlers(routes: DataFrame, chunks: DataFrame) -> DataFrame:
    handlers = chunks.select(F.col("id").alias("handler_chunk_id"), F.col("name").alias("chunk_name"), F.col("start_line").alias("chunk_line"))
    return routes.join(handlers, "handler_chunk_id", "left")


def incident_edges(edges: DataFrame, chunk_id: str, direction: str = "out", kind: str | None = None) -> DataFrame:
    """Edges out of, into, or at a chunk, of one kind or all."""
    sides = {"out": F.col("src") == chunk_id, "in": F.col("dst") == chunk_id, "both": (F.col("src") == chunk_id) | (F.col("dst") == chunk_id)}
    found = edges.where(sides[direction])
    return (found.where(F.col("kind") == kind) if kind else found).orderBy("kind", "src", "dst", "confidence")


def edges_with_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each edge with name and file of both ends, null where there is no such chunk."""
    end = lambda side: chunks.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_file"))
    return edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")


# -- statistics ------------------------------------------------------------------------------------

def index_stats(chunks: DataFrame) -> DataFrame:
    return with_symbol(chunks).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.countDistinct("name_lower").alias("n_symbols"), F.countDistinct("content_hash").alias("n_contents"),
    )


def extension_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct().groupBy(F.element_at(F.split("file_path", r"\."), -1).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"))


def index_quality(chunks: DataFrame) -> DataFrame:
    """Shares of chunks with a name, docstring, calls and parameters, in percent, and their sizes in estimated tokens."""
    share = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    tokens = T.token_estimate(F.col("code_snippet"))
    sized = chunks.withColumn("tokens", tokens)
    return sized.agg(
        share(F.coalesce("name", F.lit("")) != "").alias("pct_named"), share(F.coalesce("docstring", F.lit("")) != "").alias("pct_docstring"),
        share(F.coalesce(F.size("calls"), F.lit(0)) > 0).alias("pct_calls"), share(F.coalesce(F.size("params"), F.lit(0)) > 0).alias("pct_params"),
        F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.median("tokens").alias("median_tokens"), F.max("tokens").alias("max_tokens"),
    )


def size_percentile(chunks: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: the estimated tokens at place floor(share · n) of the sorted sizes, from counts per size."""
    sizes = chunks.groupBy(T.token_estimate(F.col("code_snippet")).alias("tokens")).agg(F.count(F.lit(1)).alias("c"))  # one row per distinct size
    order = Window.orderBy("tokens")
    placed = sizes.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return placed.where(F.col("upto") > F.floor(share * F.col("n"))).agg(F.min("tokens").alias("p95_tokens"))


def dependency_stats(deps: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: n_dep_edges, n_files_with_deps, pct_files_with_deps of deps (file, dep) over the files of chunks."""
    edges = deps.agg(F.count(F.lit(1)).alias("n_dep_edges"), F.countDistinct("file").alias("n_files_with_deps")).withColumn("_one", F.lit(1))  # one row
    files = chunks.agg(F.countDistinct("file_path").alias("n_files")).withColumn("_one", F.lit(1))  # one row
    return edges.join(F.broadcast(files), "_one").select("n_dep_edges", "n_files_with_deps", F.round(100 * F.col("n_files_with_deps") / F.col("n_files"), 4).alias("pct_files_with_deps"))


def repo_map(chunks: DataFrame, per_file: int = 8) -> DataFrame:
    """file_path, n_symbols and the first symbols of each file, once per name whatever its case."""
    first = F.row_number().over(Window.partitionBy("file_path", "name_lower").orderBy("start_line", "id"))
    named = with_symbol(chunks).where("name_lower is not null").withColumn("_r", first).where("_r = 1")
    order = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))
    ranked = named.withColumn("_o", order)
    counts = ranked.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.sort_array(F.collect_list(F.when(F.col("_o") <= per_file, F.struct("_o", "name")))).alias("s"))
    return counts.select("file_path", "n_symbols", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("symbols"))


def language_votes(chunks: DataFrame) -> DataFrame:
    """Files per language family, the one with the most first."""
    return chunks.select("file_path").distinct().groupBy(T.language_key(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files")).where("language is not null")


#: Language of each extension, folders of one framework, words of paths.
FAMILIES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "c": "c", "h": "c", "sh": "bash", "bash": "bash", "zsh": "bash", "scss": "scss", "css": "scss", "sass": "scss",
}
LARAVEL_DIRS = ("models", "http", "controllers", "console", "providers", "middleware", "requests", "builders", "repositories", "services")
LARAVEL_WORDS = ("laravel", "eloquent", "artisan", "symfony")


def repo_language(chunks: DataFrame, scanned: int = 400) -> DataFrame:
    """language: one row, the language or framework that most chunks are in; null if the second has nine tenths as many, or none is known.

    Frameworks show in the paths of the first ``scanned`` chunks by file, line and id. The web is one
    family; it is TypeScript if three fifths of it are.
    """
    ext = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    family = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))[ext]
    votes = chunks.select(family.alias("family")).where("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    web = F.col("family").isin("typescript", "javascript")
    merged = votes.groupBy(F.when(web, "web").otherwise(F.col("family")).alias("family")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("family") == "typescript", F.col("n")).otherwise(0)).alias("ts"))
    best = F.sort_array(F.collect_list(F.struct(F.col("n"), "family", "ts")), asc=False)  # one entry per language
    ranked = merged.agg(best.alias("r"), F.max(F.col("family") == "java").alias("java")).withColumn("_one", F.lit(1))
    low = F.lower("file_path")
    first = chunks.where("file_path is not null").orderBy("file_path", F.asc_nulls_first("start_line"), "id").limit(scanned).select(low.alias("p"), F.split(low, "/").alias("parts"))
    signs = first.agg(
        F.max(F.col("p").contains("springframework")).alias("spring"), F.max(F.arrays_overlap("parts", F.array(*map(F.lit, LARAVEL_WORDS)))).alias("words"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("parts", F.array(*map(F.lit, LARAVEL_DIRS))))))).alias("folders"),  # of at most ``scanned`` rows
    ).withColumn("_one", F.lit(1))
    j = ranked.join(F.broadcast(signs), "_one")
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    spring = F.coalesce("spring", F.lit(False))
    name = (
        F.when(F.coalesce("java", F.lit(False)) & spring, "java-spring").when(F.coalesce(second["n"], F.lit(0)) >= 0.9 * top["n"], F.lit(None))
        .when(top["family"] == "web", F.when(top["ts"] >= 0.6 * top["n"], "typescript").otherwise("javascript"))
        .when(top["family"] == "php", F.when(F.coalesce("words", F.lit(False)) | (F.col("folders") >= 2), "php-laravel").otherwise("php")).otherwise(top["family"])
    )
    return j.select(name.alias("language"))


# -- vectors by content -----------------------------------------------------------------------------

def vector_keys(chunks: DataFrame) -> DataFrame:
    """key, chunk_id: the keys under which the vectors of a chunk may be stored. Chunks of equal content share them.

    The key of the content and its enrichment, those of its summary and windows, and the bare hash of
    the content, as older stores have it.
    """
    own = T.embedding_key(F.col("content_hash"), F.col("summary"), F.col("concepts"))
    marks = ["", "|s", *(f"|w{i}" for i in range(1, T.MAX_WINDOWS))]
    keys = F.array_distinct(F.concat(F.array(*(F.concat(own, F.lit(m)) for m in marks)), F.array("content_hash")))
    return chunks.where("content_hash is not null").select(F.explode(keys).alias("key"), F.col("id").alias("chunk_id"))


def chunks_of_vectors(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: hits on stored vectors (query_id, key, score) as chunks, the best of each."""
    return hits.join(vector_keys(chunks), "key").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


# -- upkeep ---------------------------------------------------------------------------------------

def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """``old`` without all rows of the files in ``changed`` (file_path), plus ``new``."""
    return old.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(new).select(old.columns)


def missing_vectors(expected: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys (key) that have to be embedded."""
    return expected.select("key").distinct().join(cached.select("key"), "key", "left_anti")


def core_chunks(chunks: DataFrame, rank: DataFrame | None = None, most: int | None = 500) -> DataFrame:
    """Chunks worth enriching: named, at least four lines, neither test nor example; by rank of their file, all if ``most`` is None."""
    found = with_symbol(chunks).where("name_lower is not null").where(F.col("end_line") - F.col("start_line") >= 3).where(~T.is_test_file(F.col("file_path")) & ~T.is_example_dir(F.col("file_path")))
    found = found.join(rank, "file_path", "left").fillna(0.0, ["score"]) if rank is not None else found.withColumn("score", F.lit(0.0))
    return found.orderBy(F.desc("score"), "file_path", "id").limit(most) if most else found


def update_frequencies(df: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """term, df after the postings ``old`` are taken out and ``new`` are put in; terms that no chunk holds any more are dropped.

    Only the postings of changed chunks are read; the rest of the index isn't.
    """
    delta = lambda p, sign: p.groupBy("term").agg(F.count(F.lit(sign)).alias("n")).select("term", (F.col("n") * sign).alias("df"))
    both = df.select("term", "df").unionByName(delta(old, -1)).unionByName(delta(new, 1))
    return both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def update_stats(stats: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row, n_docs and avgdl, of ``stats`` (the same) after documents of lengths ``old`` go and ``new`` come (chunk_id, doc_len)."""
    part = lambda lengths, sign: lengths.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("doc_len"), F.lit(0)) * sign).cast("double").alias("total"))
    rows = stats.select(F.col("n_docs").alias("n"), (F.col("n_docs") * F.coalesce("avgdl", F.lit(0.0))).alias("total")).unionByName(part(old, -1)).unionByName(part(new, 1))
    return rows.agg(F.sum("n").alias("n_docs"), F.sum("total").alias("total")).select("n_docs", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).alias("avgdl"))
