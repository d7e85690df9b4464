"""The questions that users ask of an index, as functions from tables to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import key_form
from codeloom.operators import bm25, embed, graph, index, search, signals, taint
from codeloom.session import cut_lineage
from codeloom.sources.tables import table


@dataclass
class Index:
    """Tables of an index at one time. Optional tables that are absent turn what needs them off."""

    chunks: DataFrame
    edges: DataFrame
    calls: DataFrame
    routes: DataFrame
    commits: DataFrame | None = None
    vectors: DataFrame | None = None
    associations: DataFrame | None = None
    centrality: DataFrame | None = None
    rows: DataFrame | None = None  # chunks of all times, of which ``chunks`` are the current
    _postings: DataFrame | None = None
    _deps: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, folder: str, **optional: DataFrame) -> Index:
        """The current index of a folder of tables."""
        rows = table(spark, folder, "chunks")
        return cls(
            index.current_chunks(rows), index.distinct_edges(table(spark, folder, "edges")),
            index.distinct_calls(table(spark, folder, "call_edges")), index.current_routes(table(spark, folder, "routes")), **({"rows": rows} | optional),
        )

    @property
    def postings(self) -> DataFrame:
        self._postings = self._postings if self._postings is not None else index.chunk_terms(self.chunks)
        return self._postings

    @property
    def deps(self) -> DataFrame:
        self._deps = self._deps if self._deps is not None else graph.file_graph(self.edges, self.chunks)
        return self._deps

    def _one(self, **values: str) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))

    def _ids(self, symbol: str) -> DataFrame:
        return index.resolve_symbol(self.chunks, symbol).select(F.col("id").alias("chunk_id"))

    def _card(self, ids: DataFrame) -> DataFrame:
        """Chunks as results, without their code."""
        return ids.join(self.chunks.select(F.col("id").alias("chunk_id"), "name", "node_type", "file_path", "start_line", "end_line", T.signature_line(F.col("code_snippet")).alias("signature")), "chunk_id")

    # -- the sixteen questions

    def topology(self, files: DataFrame) -> DataFrame:
        """file_path, dependencies, used_by of a set of files (file_path): sorted lists."""
        own = files.select("file_path").distinct()
        out = self.deps.withColumnRenamed("file", "file_path").join(own, "file_path", "left_semi").groupBy("file_path").agg(F.sort_array(F.collect_set("dep")).alias("dependencies"))
        back = self.deps.withColumnRenamed("dep", "file_path").join(own, "file_path", "left_semi").groupBy("file_path").agg(F.sort_array(F.collect_set("file")).alias("used_by"))
        none = F.array().cast("array<string>")
        return own.join(out, "file_path", "left").join(back, "file_path", "left").select("file_path", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("used_by", none).alias("used_by"))

    def search_code(self, queries: DataFrame, top_k: int = 5, min_score: float = 0.3, learned: bool = False, git_weight: float = 0.0, budget: int | None = None, topology: bool = False) -> DataFrame:
        """Chunks for queries (query_id, text, and optionally exact), with their pruned bodies.

        ``budget`` keeps the results whose bodies fit into so many tokens; ``topology`` adds what the file
        of each depends on, and what uses it.
        """
        pool = min(max(2 * top_k, 12), 25) if learned or git_weight else top_k
        channels = {}
        if self.vectors is not None:
            asked = embed.embedded(queries, "query_id").withColumnRenamed("vec", "qvec")
            channels["vector"] = search.vector_search(asked, self.vectors, min_score)
        if self.associations is not None:
            added = search.expanded_query(queries, self.associations).withColumnRenamed("weight", "n")
            channels["sparse"] = search.ranked(search.bm25_scores(added, self.postings), search.LEXICAL_CAP)
        kept = {c: F.col(c) for c in ("name", "node_type", "file_path", "start_line", "end_line")}
        vectors = lambda terms: bm25.vectors_of(self.chunks, terms, **kept) if self.rows is None else bm25.current_vectors(self.rows, terms, **kept)
        found, chunks = bm25.fused_search(queries, vectors, pool, channels)
        found = cut_lineage(search.few(cut_lineage(found)).join(chunks.select("chunk_id", *kept), "chunk_id"))
        if learned:
            degree = self.edges.groupBy(F.col("dst").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_in"), F.count(F.when(F.col("confidence") == "resolved", 1)).alias("n_resolved"))
            rank = self.centrality.select("chunk_id", F.col("score").alias("centrality")) if self.centrality is not None else found.select("chunk_id", F.lit(None).cast("double").alias("centrality")).distinct()
            found = search.learned_rerank(found.join(degree, "chunk_id", "left").join(rank, "chunk_id", "left").withColumn("git", F.lit(0.0)))
        if git_weight and self.commits is not None:
            now = self.commits.agg(F.max("ts")).first()[0] or 0
            found = search.git_boost(found, signals.hot_files(signals.file_stats(self.commits), now), git_weight)
        # bodies of the results alone, before versions are compared
        ids = search.few(cut_lineage(found.select(F.col("chunk_id").alias("id")).distinct()))
        bodies = self.chunks.join(ids, "id", "left_semi") if self.rows is None else index.current_chunks(self.rows.join(ids, "id", "left_semi"), "code_snippet")
        bodies = bodies.select(F.col("id").alias("chunk_id"), "code_snippet")
        words = queries.select("query_id", T.raw_tokens(F.col("text")).alias("tokens"))
        found = found.where(F.col("rank") <= top_k).join(bodies, "chunk_id").join(words, "query_id").withColumn("body", T.pruned_body(F.col("code_snippet"), F.col("tokens"))).drop("code_snippet", "tokens")
        if budget is not None:
            found = search.within_budget(found.withColumn("tokens", T.token_estimate(F.col("body"))), budget)
        return found.join(self.topology(found), "file_path", "left") if topology else found

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return index.chunk_by_id(self.chunks, chunk_id)

    def resolve_symbol(self, symbol: str) -> DataFrame:
        return self._card(self._ids(symbol)).orderBy("file_path", "start_line", "chunk_id")

    def get_chunk_summary(self, chunk_id: str, callees: int = 6) -> DataFrame:
        """The chunk's card with the first definition of each of its first callees."""
        own = index.chunk_by_id(self.chunks, chunk_id)
        names = own.select(F.posexplode("calls").alias("o", "callee")).select("o", key_form("callee").alias("name")).where(F.col("o") < callees)
        first = graph.definitions(self.chunks).groupBy("name").agg(F.min(F.struct("def_file", "def_id")).alias("d"))
        return names.join(first, "name").select("o", "name", F.col("d.def_id").alias("chunk_id"), F.col("d.def_file").alias("file_path")).orderBy("o")

    def get_file_skeleton(self, path: str) -> DataFrame:
        return index.chunks_by_file(self.chunks, path).select("name", "node_type", "start_line", "end_line", T.signature_line(F.col("code_snippet")).alias("signature"))

    def get_call_graph(self, name: str, target_class: str | None = None) -> DataFrame:
        return graph.classify_callers(self.chunks, self.deps, target_class).where(F.col("name") == name.strip().lower())

    def find_references(self, symbol: str, target_class: str | None = None) -> DataFrame:
        calls = self.get_call_graph(symbol, target_class).select("caller", F.lit("calls").alias("kind"), "reason", "confidence")
        other = graph.referers(self.chunks, self.deps).where(F.col("name") == symbol.strip().lower()).select("caller", "kind", "reason", "confidence")
        return self._card(calls.unionByName(other).withColumnRenamed("caller", "chunk_id"))

    def find_routes(self, method: str | None = None, path: str | None = None) -> DataFrame:
        return index.find_routes(self.routes, method, path)

    def get_subgraph(self, symbol: str, depth: int = 2, max_nodes: int = 12) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.edges, self._ids(symbol), depth, max_nodes)

    def get_repo_map(self, path_filter: str | None = None, max_files: int = 80) -> DataFrame:
        chunks = self.chunks.where(F.col("file_path").contains(path_filter)) if path_filter else self.chunks
        rank = graph.file_page_rank(self.deps, self.chunks.select("file_path"))
        return index.repo_map(chunks).join(rank, "file_path", "left").orderBy(F.desc_nulls_last("score"), "file_path").limit(max_files)

    def list_index_stats(self) -> DataFrame:
        return index.index_stats(self.chunks)

    def tests_for(self, symbol: str) -> DataFrame:
        found = graph.tests_for(self.edges, self.chunks).join(self._ids(symbol).withColumnRenamed("chunk_id", "dst"), "dst", "left_semi")
        return self._card(found.select(F.col("test_id").alias("chunk_id")).distinct()).orderBy("file_path", "start_line", "chunk_id")

    def explain_symbol(self, symbol: str) -> DataFrame:
        """Each definition with its numbers of referring chunks and tests, its routes, and whether it is a hub."""
        ids = self._ids(symbol)
        into = self.edges.groupBy(F.col("dst").alias("chunk_id")).agg(F.countDistinct("src").alias("n_referers"))
        tests = graph.tests_for(self.edges, self.chunks).groupBy(F.col("dst").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_tests"))
        routes = self.routes.groupBy(F.col("handler_chunk_id").alias("chunk_id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "method", "path"))), ",").alias("routes"))
        out = self._card(ids).join(into, "chunk_id", "left").join(tests, "chunk_id", "left").join(routes, "chunk_id", "left")
        if self.centrality is not None:
            most = self.centrality.agg(F.ceil(F.max("rank") * 0.1).alias("m")).first()[0] or 0
            out = out.join(self.centrality.select("chunk_id", (F.col("rank") <= most).alias("is_hub")), "chunk_id", "left")
        return out.fillna(0, ["n_referers", "n_tests"])

    def impact_of_edit(self, symbols: list[str] | None = None, files: list[str] | None = None, max_depth: int = 3, max_nodes: int = 200, strict: bool = False) -> DataFrame:
        """What an edit may break, tests marked, the nearest first."""
        names = [s.strip().lower() for s in symbols or []]
        seeds = index.with_symbol(self.chunks).where(F.col("name_lower").isin(names) | F.col("file_path").isin(files or [])).select(F.col("id").alias("chunk_id"))
        hit = self._card(graph.impact(self.edges, seeds, max_depth, strict)).withColumn("is_test", T.is_test_file(F.col("file_path")))
        return hit.orderBy("depth", "file_path", "start_line", "chunk_id").limit(max_nodes)

    def trace_taint(self, kind: str | None = None, category: str | None = None, max_depth: int = 4, max_flows: int = 100) -> DataFrame:
        calls = self.edges.where("kind = 'calls'").select("src", "dst")
        return taint.trace(taint.flows(taint.scan(self.chunks), calls, taint.sanitizing(self.chunks), max_depth), kind, category, max_flows)

    def find_tainted_sinks(self, category: str | None = None, reachable_only: bool = False, max_depth: int = 4) -> DataFrame:
        hits = taint.scan(self.chunks)
        found = taint.tainted_sinks(hits, taint.flows(hits, self.edges.where("kind = 'calls'").select("src", "dst"), taint.sanitizing(self.chunks), max_depth), reachable_only)
        return found.where(F.col("category") == category) if category else found

    def co_changed(self, files: DataFrame, most: int = 5) -> DataFrame:
        """Partners of a set of files (file) in the change history; empty without one."""
        if self.commits is None:
            return files.select(F.col("file").alias("partner"), F.lit(0).cast("bigint").alias("n")).limit(0)
        return signals.co_change_of(files, signals.co_change(self.commits), most)


def to_markdown(rows: DataFrame, most: int = 50) -> str:
    """The first rows as a table for reading."""
    found = rows.limit(most).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("\n", " ").replace("|", "\\|") for v in r) + " |\n" for r in found)
