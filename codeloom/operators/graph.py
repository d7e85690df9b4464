"""Program-graph operators: centrality, callers and references, the symbol graph, impact, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.keys import key_form
from codeloom.operators.index import with_symbol
from codeloom.operators.skew import salted_join
from codeloom.session import cut_lineage

#: Damping of both page ranks.
DAMPING = 0.85
#: Rounds of a page rank that are one plan.
WRITE_EVERY = 10


def file_graph(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """file, dep: files whose chunks refer to chunks of other files. edges: src, dst."""
    of = chunks.select("id", "file_path")
    return (
        edges.join(of.select(F.col("id").alias("src"), F.col("file_path").alias("file")), "src")
        .join(of.select(F.col("id").alias("dst"), F.col("file_path").alias("dep")), "dst").where("file <> dep").select("file", "dep").distinct()
    )


def imported_by(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("dep").alias("file"), F.col("file").alias("imported_by")).distinct()


def file_page_rank(deps: DataFrame, files: DataFrame, iterations: int = 30) -> DataFrame:
    """file_path, score: nodes are ``files`` (file_path); what is sent to files outside them, or not sent, is lost."""
    nodes = files.select(F.col("file_path").alias("node")).distinct()
    n = nodes.count()
    out = deps.groupBy("file").agg(F.count(F.lit(1)).alias("out"))
    links = cut_lineage(deps.join(out, "file").select(F.col("file").alias("src"), F.col("dep").alias("dst"), "out").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    rank = cut_lineage(nodes.withColumn("score", F.lit(1.0 / max(1, n))))
    nodes = rank.select("node")
    for i in range(1, iterations + 1):
        sent = links.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("sent"))
        rank = nodes.join(sent, "node", "left").select("node", ((1 - DAMPING) / max(1, n) + DAMPING * F.coalesce("sent", F.lit(0.0))).alias("score"))
        if i % WRITE_EVERY == 0:
            rank = cut_lineage(rank)
    return rank.select(F.col("node").alias("file_path"), F.round("score", 9).alias("score"))


def edge_weight() -> Column:
    return F.when(F.col("confidence").isin("resolved", "high"), 1.0).otherwise(0.5)


def symbol_centrality(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """chunk_id, score, rank over the ends of ``edges`` (src, dst, confidence); edges between the same chunks add up.

    The rank of chunks that refer to nothing is shared by all. What is shared by all is proportional to
    what each starts a round with, so the rounds leave it out and the scores are scaled to a sum of 1 at
    the end: the same ranks, but a round reads the one before only once, and WRITE_EVERY rounds are one
    plan. Stops when the scores move less than ``tolerance`` in all over a round, which is looked at
    whenever they are written.
    """
    links = edges.groupBy("src", "dst").agg(F.sum(edge_weight()).alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    links = cut_lineage(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("w")))
    nodes = cut_lineage(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    n = max(1, nodes.count())
    rank = nodes.withColumn("score", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        before = rank
        sent = links.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("sent"))
        rank = nodes.join(sent, "node", "left").select("node", ((1 - DAMPING) / n + DAMPING * F.coalesce("sent", F.lit(0.0))).alias("score"))
        if i % WRITE_EVERY == 0 or i == iterations:
            if tolerance and i > 1:
                both = cut_lineage(rank.join(before.select("node", F.col("score").alias("old")), "node"))
                rank = both.select("node", "score")
                if (both.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) < tolerance:
                    break
            else:
                rank = cut_lineage(rank)
    total = rank.agg(F.sum("score").alias("all")).withColumn("_one", F.lit(1))  # one row
    # rounding first: ranks don't depend on the order of addition. Ranks of all chunks are numbered in two levels.
    scaled = rank.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").withColumn("score", F.col("score") / F.col("all"))
    scored = scaled.select(F.col("node").alias("chunk_id"), (F.floor(F.col("score") * 1e8 + 0.5) / 1e8).alias("score"))
    return numbered(scored, [F.desc("score"), F.asc("chunk_id")], "rank")


def top_central(centrality: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most central chunks (chunk_id, score, rank)."""
    return centrality.where(F.col("rank") <= limit).orderBy("rank")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers rows 1.. in ``order`` without sorting them all in one task: range partitions are counted, then numbered."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))  # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return spread.join(F.broadcast(before), "_p").withColumn(name, (local + F.col("_before")).cast("int")).drop("_p", "_before")


# -- callers and references ---------------------------------------------------------------------------

def definitions(chunks: DataFrame) -> DataFrame:
    """name, def_id, def_file, def_class of all named chunks."""
    named = with_symbol(chunks).where("name_lower is not null")
    return named.select(F.col("name_lower").alias("name"), F.col("id").alias("def_id"), F.col("file_path").alias("def_file"), F.coalesce(F.lower("class_context"), F.lit("")).alias("def_class"))


def call_sites(chunks: DataFrame) -> DataFrame:
    """caller, caller_file, caller_class, name, recv, type of every call site of the chunks."""
    site = chunks.select(F.col("id").alias("caller"), F.col("file_path").alias("caller_file"), F.coalesce(F.lower("class_context"), F.lit("")).alias("caller_class"), F.explode("call_sites").alias("s"))
    return site.select(
        "caller", "caller_file", "caller_class", key_form("s.name").alias("name"), F.coalesce("s.recv", F.lit("")).alias("recv"),
        F.lower(F.coalesce(F.nullif(F.col("s.recv_type"), F.lit("")), F.col("s.recv_resolved_type"))).alias("type"), key_form("s.recv_via_call").alias("via"),
    ).where("name is not null")


def _importable(deps: DataFrame, defs: DataFrame) -> DataFrame:
    """file, name: names that are defined in a file that ``file`` depends on. A file that many depend on is salted."""
    def_files = defs.select("name", F.col("def_file").alias("dep")).distinct()
    return salted_join(deps.select("file", "dep").distinct(), def_files, ["dep"], "inner", F.xxhash64("file")).select("file", "name").distinct()


def _flagged(rows: DataFrame, *flags: str) -> DataFrame:
    """caller, name and the maximum of each flag: all evidence for a pair meets in one aggregation."""
    return rows.groupBy("caller", "name").agg(*(F.max(f).alias(f) for f in flags))


def classify_callers(chunks: DataFrame, deps: DataFrame, target_class: str | None = None, defs: DataFrame | None = None, importable: DataFrame | None = None) -> DataFrame:
    """name, caller, confidence, proven, reason for every chunk that calls a defined name.

    The first that holds: sole definition; called on ``this`` within a class that defines it; called
    without receiver where a free function is defined; the receiver's type defines it; the caller's
    file depends on a file that defines it; the same file; the receiver is ``target_class``; else only
    the name. Every test is an equi-join on distinct pairs, so no definition list is ever collected.
    Call sites and definitions are written once; the evidence of all tests is united and aggregated per
    pair, and what is known of a name joins the pairs last, salted by the pairs of the name.
    """
    defs = cut_lineage(definitions(chunks)) if defs is None else defs
    if target_class:
        narrowed = defs.where(F.col("def_class") == target_class.lower())
        defs = narrowed.unionByName(defs.join(narrowed.select("name").distinct(), "name", "left_anti"))
    sites = cut_lineage(call_sites(chunks).join(defs.select("name").distinct(), "name", "left_semi"))
    per_name = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n_defs"), F.max(F.col("def_class") == "").alias("free"))
    classes = defs.where("def_class <> ''").select("name", F.col("def_class").alias("cls")).distinct()
    returns = with_symbol(chunks).where("name_lower is not null").select(F.col("name_lower").alias("via"), F.explode(T.type_tokens(F.col("return_type"))).alias("via_type")).distinct()
    typed = sites.where("type is not null or via is not null").join(returns, "via", "left").select("caller", "name", F.coalesce("type", "via_type").alias("cls")).where("cls is not null").distinct()
    known = classes.unionByName(classes.select("name", F.lit(target_class.lower()).alias("cls"))).distinct() if target_class else classes
    def_files = defs.select("name", F.col("def_file").alias("dep")).distinct()
    places = sites.select("caller", "name", F.col("caller_file").alias("file")).distinct()
    no, yes = F.lit(False), F.lit(True)
    flags = ("bare", "by_target", "by_this", "by_type", "by_import", "by_file")
    found = lambda df, flag: df.select("caller", "name", *((yes if f == flag else no).alias(f) for f in flags))
    evidence = (
        sites.select("caller", "name", (F.col("recv") == "").alias("bare"), (F.lower("recv") == (target_class or "\0").lower()).alias("by_target"), *(no.alias(f) for f in flags[2:]))
        .unionByName(found(sites.where("recv = 'this' and caller_class <> ''").join(classes.withColumnRenamed("cls", "caller_class"), ["name", "caller_class"], "left_semi"), "by_this"))
        .unionByName(found(typed.join(known, ["name", "cls"], "left_semi"), "by_type"))
        .unionByName(found(places.join((_importable(deps, defs) if importable is None else importable), ["file", "name"], "left_semi"), "by_import"))
        .unionByName(found(places.join(def_files.withColumnRenamed("dep", "file"), ["file", "name"], "left_semi"), "by_file"))
    )
    j = salted_join(cut_lineage(_flagged(evidence, *flags)), per_name, ["name"], "inner", F.xxhash64("caller"))
    reason = (
        F.when((F.col("n_defs") <= 1) & F.lit(target_class is None), "sole definition").when(F.col("by_this"), "own class").when(F.col("bare") & F.col("free"), "free function").when(F.col("by_type"), "receiver type")
        .when(F.col("by_import"), "imports file").when(F.col("by_file"), "same file").when(F.col("by_target"), "receiver name").otherwise("name only")
    )
    return j.select("name", "caller", reason.alias("reason")).select(
        "name", "caller", "reason", F.when(F.col("reason") == "name only", "name_only").otherwise("high").alias("confidence"), F.col("reason").isin("sole definition", "own class", "receiver type").alias("proven"))


def referers(chunks: DataFrame, deps: DataFrame, defs: DataFrame | None = None, importable: DataFrame | None = None) -> DataFrame:
    """name, caller, kind (extends or type), reason, confidence of chunks that name a defined symbol; chunks of the same name are left out."""
    defs = cut_lineage(definitions(chunks)) if defs is None else defs
    one = lambda c, kind: chunks.select(F.col("id").alias("caller"), F.col("file_path").alias("file"), key_form("name").alias("own"), F.explode(c).alias("r")).select("caller", "file", "own", key_form("r").alias("name"), F.lit(kind).alias("kind"))
    refs = one("extends", "extends").unionByName(one("type_refs", "type")).where("name is not null and (own is null or own <> name)").drop("own").distinct()
    refs = cut_lineage(refs.join(defs.select("name").distinct(), "name", "left_semi"))
    per_name = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n_defs"))
    def_files = defs.select("name", F.col("def_file").alias("dep")).distinct()
    imports = refs.join((_importable(deps, defs) if importable is None else importable), ["file", "name"], "left_semi").withColumn("by_import", F.lit(True)).withColumn("by_file", F.lit(False))
    same = refs.join(def_files.withColumnRenamed("dep", "file"), ["file", "name"], "left_semi").withColumn("by_import", F.lit(False)).withColumn("by_file", F.lit(True))
    evidence = refs.withColumn("by_import", F.lit(False)).withColumn("by_file", F.lit(False)).unionByName(imports).unionByName(same)
    met = cut_lineage(evidence.groupBy("name", "caller", "kind").agg(F.max("by_import").alias("by_import"), F.max("by_file").alias("by_file")))
    reason = F.when(F.col("n_defs") <= 1, "sole definition").when(F.col("by_import"), "imports file").when(F.col("by_file"), "same file").otherwise("name only")
    out = salted_join(met, per_name, ["name"], "inner", F.xxhash64("caller")).withColumn("reason", reason)
    return out.select("name", "caller", "kind", "reason", F.when(F.col("reason") == "name only", "name_only").otherwise("high").alias("confidence"))


def symbol_graph(chunks: DataFrame, deps: DataFrame, resolver: str = "heuristic") -> DataFrame:
    """src, dst, kind, confidence: an edge from every caller or referer to each definition of the name.

    ``chunks`` holds one row per id. resolver: heuristic keeps the confidence; precise makes proven calls
    ``resolved``. All edges of a name are kept; names with many callers are salted. A chunk has one
    name, so a pair of chunks and a kind come from one name and are unique without another shuffle.
    """
    defs = cut_lineage(definitions(chunks))
    importable = cut_lineage(_importable(deps, defs))
    calls = classify_callers(chunks, deps, None, defs, importable).withColumn("kind", F.lit("calls"))
    if resolver == "precise":
        calls = calls.withColumn("confidence", F.when((F.col("confidence") == "high") & F.col("proven"), "resolved").otherwise(F.col("confidence")))
    refs = calls.select("name", "caller", "kind", "confidence").unionByName(referers(chunks, deps, defs, importable).select("name", "caller", "kind", "confidence"))
    edges = salted_join(cut_lineage(refs), defs.select("name", F.col("def_id").alias("dst")), ["name"], "inner", F.xxhash64("caller"))
    return edges.select(F.col("caller").alias("src"), "dst", "kind", "confidence")


def apply_bindings(edges: DataFrame, bindings: DataFrame, covered: DataFrame) -> DataFrame:
    """Call edges under an external binding (src, dst): confirmed ones become resolved; siblings of covered
    targets (dst) that the binding doesn't confirm are dropped; others stay."""
    marked = edges.join(bindings.select("src", "dst").distinct().withColumn("_bound", F.lit(True)), ["src", "dst"], "left").join(covered.select("dst").distinct().withColumn("_known", F.lit(True)), "dst", "left")
    call = F.col("kind") == "calls"
    return marked.where(~(call & F.col("_known").isNotNull() & F.col("_bound").isNull())).withColumn("confidence", F.when(call & F.col("_bound").isNotNull(), "resolved").otherwise(F.col("confidence"))).select("src", "dst", "kind", "confidence")


def unresolved_calls(calls: DataFrame, chunks: DataFrame, external: DataFrame) -> DataFrame:
    """callee, n_callers of names that are neither defined nor external. calls: callee, chunk_id."""
    known = definitions(chunks).select(F.col("name").alias("callee")).union(external.select(key_form("symbol"))).distinct()
    return calls.join(known, "callee", "left_anti").groupBy("callee").agg(F.count(F.lit(1)).alias("n_callers"))


def tests_for(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """dst, test_id: chunks of test files that refer to a chunk."""
    tests = chunks.where(T.is_test_file(F.col("file_path"))).select(F.col("id").alias("src"))
    return edges.join(tests, "src", "left_semi").select("dst", F.col("src").alias("test_id")).distinct()


# -- traversal ------------------------------------------------------------------------------------------

def reach(edges: DataFrame, seeds: DataFrame, depth: int, per_seed: bool = False) -> DataFrame:
    """Nodes reached over src -> dst within ``depth`` steps: node, depth (first reached), and seed if ``per_seed``.

    seeds: node (and seed). Each level is one join and an anti-join with what is reached; levels are
    written to the shared folder.
    """
    keys = ["seed", "node"] if per_seed else ["node"]
    start = seeds.select(*(["seed"] if per_seed else []), "node").distinct().withColumn("depth", F.lit(0))
    reached = frontier = cut_lineage(start)
    links = edges.select(F.col("src").alias("node"), "dst").distinct()
    for d in range(1, depth + 1):
        step = frontier.drop("depth").join(links, "node").drop("node").withColumnRenamed("dst", "node").distinct()
        frontier = cut_lineage(step.join(reached.select(*keys), keys, "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, strict: bool = False) -> DataFrame:
    """chunk_id, depth of what may break with ``seeds`` (chunk_id): the reverse closure over proven or, unless ``strict``, likely edges."""
    used = edges.where(F.col("confidence").isin(*(("resolved",) if strict else ("resolved", "high"))))
    back = used.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds.select(F.col("chunk_id").alias("node")), depth).where("depth > 0").select(F.col("node").alias("chunk_id"), "depth")


def ambiguous_referers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """src, dst of direct references by name only to ``seeds``."""
    return edges.where("confidence = 'name_only'").join(seeds.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def subgraph(edges: DataFrame, seed: DataFrame, depth: int = 2, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around ``seed`` (chunk_id) by any likely edge in either direction, and the edges among them; the nearest ``max_nodes`` by depth, id."""
    likely = edges.where("confidence <> 'name_only' and src <> dst")
    both = likely.select("src", "dst").union(likely.select("dst", "src"))
    nodes = reach(both, seed.select(F.col("chunk_id").alias("node")), depth)
    if max_nodes:
        nodes = nodes.orderBy("depth", "node").limit(max_nodes)
    among = likely.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").distinct()
    return nodes, among


def propagate_types(seeds: DataFrame, returns: DataFrame, rounds: int = 8) -> DataFrame:
    """name, type: types of functions from their own (seeds: name, type) and those they return the result of (returns: name, via).

    A name with several types has none, and passes none on.
    """
    known = seeds.groupBy("name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type"))
    known = known.select("name", F.when(F.col("n") == 1, F.col("type")).alias("type"))
    for _ in range(rounds):
        passed = returns.join(known.where("type is not null").select(F.col("name").alias("via"), "type"), "via").join(known.select("name"), "name", "left_anti")
        new = cut_lineage(passed.groupBy("name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("t")).select("name", F.when(F.col("n") == 1, F.col("t")).alias("type")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known.where("type is not null")


# -- spans -----------------------------------------------------------------------------------------------

#: Lines of a bin of the finest level, how many times longer the bins of the next one are, and the number of levels.
BIN_LINES, BIN_GROWTH, BIN_LEVELS = 16, 8, 8


def innermost(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each of ``points`` (point_id, file_path, line) the chunk whose lines hold it: the shortest, then the latest, then the first id.

    A span lies in the bins of the finest level whose bins are as long as it is, at most two; a point
    asks its bin of every level. So a file of very many spans and points is spread, and a point meets
    only spans near it.
    """
    size = [BIN_LINES * BIN_GROWTH**i for i in range(BIN_LEVELS)]
    spans = chunks.where("start_line is not null and end_line >= start_line").select("file_path", F.col("id").alias("chunk_id"), "start_line", "end_line")
    length = F.col("end_line") - F.col("start_line") + 1
    level = F.lit(BIN_LEVELS - 1)
    for i in reversed(range(BIN_LEVELS - 1)):
        level = F.when(length <= size[i], i).otherwise(level)
    sizes = F.array(*(F.lit(n).cast("bigint") for n in size))
    at = lambda line, lev: F.floor(line / F.element_at(sizes, lev + 1)).cast("bigint")
    binned = spans.withColumn("level", level.cast("int")).withColumn("bin", F.explode(F.sequence(at(F.col("start_line"), F.col("level")), at(F.col("end_line"), F.col("level")))))
    asked = points.select("point_id", "file_path", "line").where("line is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(BIN_LEVELS - 1)))).withColumn("bin", at(F.col("line"), F.col("level")))
    held = asked.join(binned, ["file_path", "level", "bin"]).where("line between start_line and end_line")
    best = held.groupBy("point_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), (-F.col("start_line")).alias("s"), "chunk_id")).alias("b"))
    return best.select("point_id", F.col("b.chunk_id").alias("chunk_id"))


def bound_references(occurrences: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst from occurrences (point_id, file_path, line, symbol, is_definition): references to definitions of the same symbol."""
    placed = occurrences.join(innermost(occurrences, chunks), "point_id")
    defs = placed.where("is_definition").select("symbol", F.col("chunk_id").alias("dst")).distinct()
    refs = placed.where("not is_definition").select("symbol", F.col("chunk_id").alias("src")).distinct()
    return refs.join(defs, "symbol").where("src <> dst").select("src", "dst").distinct()
