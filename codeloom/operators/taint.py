"""Finding ways of untrusted input to dangerous calls: line patterns, then reachability over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.graph import reach
from codeloom.session import cut_lineage

#: Patterns of untrusted input (pattern, kind) per language family.
SOURCES = {
    "js": (
        (r"\breq(uest)?\.(body|query|params|cookies|headers|url|originalUrl)\b", "http-request"),
        (r"\bctx\.(request|query|params|body)\b", "http-request"),
        (r"\bprocess\.(argv|env)\b", "process-input"),
        (r"\.on\s*\(\s*['\"]data['\"]", "socket-data"),
        (r"\b(location\.(search|hash|href)|document\.(URL|cookie|referrer))\b", "dom-input"),
    ),
    "py": (
        (r"\brequest\.(GET|POST|data|args|form|json|values|cookies|files|headers)\b", "http-request"),
        (r"\b(sys\.argv|os\.environ)\b", "process-input"),
        (r"\binput\s*\(", "stdin"),
        (r"\bflask\.request\b|\bself\.get_argument\s*\(", "http-request"),
    ),
    "java": (
        (r"\b(request|req)\.(getParameter|getParameterValues|getParameterMap|getHeader|getHeaders|getQueryString|getInputStream|getReader|getCookies)\s*\(", "http-request"),
        (r"@(RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue|MatrixVariable|ModelAttribute)\b", "http-request"),
        (r"\bSystem\.(getenv|getProperty)\s*\(", "process-input"),
        (r"\bnew\s+Scanner\s*\(\s*System\.in\b", "stdin"),
    ),
    "go": (
        (r"\br\.(URL\.Query\s*\(\s*\)|FormValue|PostFormValue|Form\b|PostForm\b|MultipartForm)|\br\.Header\.Get\s*\(|\br\.Cookie\s*\(", "http-request"),
        (r"\b(mux\.Vars|c\.(Param|Query|PostForm|DefaultQuery)|ctx\.(Query|Param))\s*\(", "http-request"),
        (r"\b(os\.Args|os\.Getenv\s*\(|flag\.(String|Int|Bool|Parse)\s*\()", "process-input"),
        (r"\bbufio\.NewReader\s*\(\s*os\.Stdin\b|\bfmt\.Scan\w*\s*\(", "stdin"),
    ),
}
#: Patterns of dangerous calls (pattern, category, label).
SINKS = {
    "js": (
        (r"\beval\s*\(", "rce", "eval()"),
        (r"\bnew\s+Function\s*\(", "rce", "new Function()"),
        (r"\b(child_process\b|\bexecSync\b|\bexecFile\b|\bexec\s*\(|\bspawn\s*\()", "rce", "child_process exec/spawn"),
        (r"\.(query|execute|raw)\s*\(", "sqli", "db query/execute"),
        (r"(\.innerHTML\s*=|dangerouslySetInnerHTML|\bres\.(send|write|end)\s*\()", "xss", "html sink"),
        (r"\b(fs\.(readFile|writeFile|unlink|createReadStream|createWriteStream|appendFile)(Sync)?|path\.join|res\.sendFile)\s*\(", "path", "fs/path sink"),
        (r"\b(fetch|axios|got|superagent)\s*\(|\bhttps?\.request\s*\(", "ssrf", "outbound request"),
    ),
    "py": (
        (r"\b(eval|exec)\s*\(", "rce", "eval/exec"),
        (r"\bos\.system\s*\(|\bsubprocess\.(call|run|Popen|check_output)\s*\(|\bos\.popen\s*\(", "rce", "os.system/subprocess"),
        (r"\.execute(many)?\s*\(|\bcursor\.execute\s*\(|\.raw\s*\(", "sqli", "cursor.execute"),
        (r"\b(mark_safe|render_template_string|HttpResponse)\s*\(", "xss", "html sink"),
        (r"\b(open|send_file|os\.path\.join)\s*\(", "path", "open/send_file"),
        (r"\brequests\.(get|post|put|delete|request)\s*\(|\burllib\.|\burlopen\s*\(", "ssrf", "outbound request"),
    ),
    "java": (
        (r"\bRuntime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(|\bnew\s+ProcessBuilder\s*\(|\bProcessBuilder\s*\(", "rce", "Runtime.exec/ProcessBuilder"),
        (r"\.(executeQuery|executeUpdate|execute|createQuery|createNativeQuery|createStatement)\s*\(", "sqli", "jdbc/jpa statement"),
        (r"\b(getWriter\s*\(\s*\)\s*\.(print|println|write)|out\.(print|println)\s*\(|\.appendChild\s*\()", "xss", "servlet/JSP writer"),
        (r"\bnew\s+(File|FileInputStream|FileReader|FileOutputStream|FileWriter)\s*\(|\bPaths\.get\s*\(|\bFiles\.(read|write|newInputStream|copy)\w*\s*\(", "path", "file/path sink"),
        (r"\bnew\s+URL\s*\(|\.openConnection\s*\(|\b(RestTemplate|WebClient|HttpClient)\b|\bHttpRequest\.newBuilder\s*\(", "ssrf", "outbound request"),
    ),
    "go": (
        (r"\bexec\.Command(Context)?\s*\(", "rce", "exec.Command"),
        (r"(?<!\.URL)\.(Query|QueryRow|QueryContext|QueryRowContext)\s*\(", "sqli", "db query"),
        (r"\.(Exec|ExecContext)\s*\(", "sqli", "db exec"),
        (r"\bw\.Write\s*\(|\bio\.WriteString\s*\(\s*w|\bfmt\.Fprint\w*\s*\(\s*w|\btemplate\.HTML\s*\(", "xss", "response writer / template.HTML"),
        (r"\b(os\.Open|os\.OpenFile|os\.ReadFile|ioutil\.ReadFile|os\.Create|filepath\.Join|http\.ServeFile)\s*\(", "path", "file/path sink"),
        (r"\bhttp\.(Get|Post|Head|PostForm|NewRequest|NewRequestWithContext)\s*\(|\b\w*[Cc]lient\.Do\s*\(", "ssrf", "outbound request"),
    ),
}
#: Patterns of what makes input harmless.
SANITIZERS = {
    "js": (r"(?i)\b(escape|encodeURI|encodeURIComponent|sanitize|DOMPurify|validator|xss)\b", r"(?i)\b(parameteriz|prepared|placeholder)\b", r"\b(Number|parseInt|parseFloat)\s*\("),
    "py": (r"(?i)\b(shlex\.quote|escape|bleach|markupsafe|secure_filename|quote)\b", r"(?i)\b(parameteriz|placeholder)\b", r"\bint\s*\(|\bfloat\s*\("),
    "java": (
        r"\b(PreparedStatement|setString|setInt|setLong|NamedParameter)\b|@Param\b",
        r"\b(URLEncoder\.encode|StringEscapeUtils|HtmlUtils\.htmlEscape|ESAPI|encodeForHTML|Encode\.forHtml|Jsoup\.clean)\b",
        r"\b(Integer\.parseInt|Long\.parseLong|Double\.parseDouble|UUID\.fromString)\s*\(",
    ),
    "go": (
        r"\bstrconv\.(Atoi|ParseInt|ParseFloat|ParseUint|ParseBool)\s*\(",
        r"\b(template\.HTMLEscapeString|template\.JSEscapeString|html\.EscapeString|url\.QueryEscape|url\.PathEscape)\s*\(",
        r"\bfilepath\.(Clean|Base)\s*\(|\bsql\.Named\b|\$\d+",
    ),
}
#: Categories, the worst first.
SEVERITY = ("rce", "sqli", "ssrf", "path", "xss")


def _found(catalog: dict, line: Column, language: Column) -> Column:
    """Indexes of the patterns of the language that a line matches."""
    hits = None
    for lang, patterns in catalog.items():
        found = F.filter(F.array(*(F.when(line.rlike(p[0]), F.lit(i)) for i, p in enumerate(patterns))), lambda x: x.isNotNull())
        hits = F.when(language == lang, found) if hits is None else hits.when(language == lang, found)
    return F.coalesce(hits, F.array().cast("array<int>"))


def scan(chunks: DataFrame) -> DataFrame:
    """chunk_id, role (source or sink), what (kind or category), label, line, ord, snippet, sanitized for every pattern hit.

    Patterns run on lines in the JVM. Null start lines count as 1.
    """
    language = T.language_key(F.col("file_path"))
    clean = None
    for lang, patterns in SANITIZERS.items():
        any_of = F.col("code_snippet").rlike("|".join(f"(?:{p})" for p in patterns))
        clean = F.when(F.col("language") == lang, any_of) if clean is None else clean.when(F.col("language") == lang, any_of)
    lines = (
        chunks.withColumn("language", language).where("language is not null and code_snippet <> ''").withColumn("sanitized", clean)
        .select(F.col("id").alias("chunk_id"), "language", "sanitized", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("base"), F.posexplode(F.split("code_snippet", "\n")).alias("i", "text"))
    )
    hits = lines.select(
        "*", F.explode(F.concat(
            F.transform(_found(SOURCES, F.col("text"), F.col("language")), lambda x: F.struct(F.lit("source").alias("role"), x.alias("p"))),
            F.transform(_found(SINKS, F.col("text"), F.col("language")), lambda x: F.struct(F.lit("sink").alias("role"), x.alias("p"))),
        )).alias("h"))
    name = F.create_map(*(F.lit(x) for role, catalog in (("source", SOURCES), ("sink", SINKS)) for lang, ps in catalog.items() for i, p in enumerate(ps) for x in (f"{role} {lang} {i}", p[1])))
    label = F.create_map(*(F.lit(x) for lang, ps in SINKS.items() for i, p in enumerate(ps) for x in (f"sink {lang} {i}", p[2])))
    key = F.concat_ws(" ", "h.role", "language", F.col("h.p").cast("string"))
    return hits.select("chunk_id", F.col("h.role").alias("role"), name[key].alias("what"), label[key].alias("label"), (F.col("base") + F.col("i")).alias("line"), (F.col("i") * 100 + F.col("h.p")).alias("ord"), F.substring(F.trim("text"), 1, 160).alias("snippet"), "sanitized")


def sanitizing(chunks: DataFrame) -> DataFrame:
    """chunk_id of the chunks whose code holds something that makes input harmless."""
    language = T.language_key(F.col("file_path"))
    found = None
    for lang, patterns in SANITIZERS.items():
        any_of = F.col("code_snippet").rlike("|".join(f"(?:{p})" for p in patterns))
        found = F.when(language == lang, any_of) if found is None else found.when(language == lang, any_of)
    return chunks.where(found).select(F.col("id").alias("chunk_id"))


def flows(hits: DataFrame, calls: DataFrame, clean: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """src, dst, kind, category, label, line, hops, sanitized, confidence: input that may reach a dangerous call.

    In one chunk: high, or low if sanitised; over up to ``depth`` calls (src, dst): medium or low. The
    first source of a chunk stands for it; of equal (src, dst, category, line) the first pattern counts.
    A flow is sanitised if on each of its shortest ways some chunk, its ends included, is one of ``clean``
    (chunk_id, see :func:`sanitizing`).

    The walk goes backwards from the dangerous calls first, without regard to sources; then forwards
    from the sources, only over calls from which a dangerous one is within the steps that are left.
    """
    first = Window.partitionBy("chunk_id").orderBy("ord")
    sources = hits.where("role = 'source'").withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("chunk_id").alias("src"), F.col("what").alias("kind"), F.col("sanitized").alias("s1"))
    once = Window.partitionBy("chunk_id", "what", "line").orderBy("ord")
    sinks = hits.where("role = 'sink'").withColumn("_r", F.row_number().over(once)).where("_r = 1").select(F.col("chunk_id").alias("dst"), F.col("what").alias("category"), "label", "line", F.col("sanitized").alias("s2"))
    links = calls.where("src <> dst").select("src", "dst").distinct()
    left = reach(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sinks.select(F.col("dst").alias("node")), depth)
    useful = cut_lineage(links.join(left.select(F.col("node").alias("dst"), F.col("depth").alias("left")), "dst"))
    harmless = clean.select(F.col("chunk_id").alias("node"), F.lit(True).alias("_clean")).distinct() if clean is not None else None
    frontier = cut_lineage(sources.select(F.col("src").alias("seed"), F.col("src").alias("node"), F.lit(0).alias("hops"), (~F.col("s1")).alias("raw")))
    ways = frontier
    for step in range(1, depth + 1):
        ahead = useful.where(F.col("left") <= depth - step).select(F.col("src").alias("node"), "dst")
        new = frontier.join(ahead, "node").groupBy("seed", F.col("dst").alias("node")).agg(F.max("raw").alias("raw"))
        new = new.join(ways.select("seed", "node"), ["seed", "node"], "left_anti")
        if harmless is not None:
            new = new.join(harmless, "node", "left").withColumn("raw", F.col("raw") & F.col("_clean").isNull()).drop("_clean")
        frontier = cut_lineage(new.select("seed", "node", F.lit(step).alias("hops"), "raw"))
        if frontier.isEmpty():
            break
        ways = ways.unionByName(frontier)
    out = ways.select(F.col("seed").alias("src"), F.col("node").alias("dst"), "hops", "raw").join(sinks, "dst").join(sources, "src").withColumn("sanitized", ~F.col("raw") | F.col("s2"))
    return out.select("src", "dst", "kind", "category", "label", "line", "hops", "sanitized", F.when(F.col("sanitized"), "low").when(F.col("hops") == 0, "high").otherwise("medium").alias("confidence"))


def trace(found: DataFrame, kind: str | None = None, category: str | None = None, most: int = 100) -> DataFrame:
    """Flows of a kind and category, the worst first; filtered before they are cut."""
    severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("category"))
    sure = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("confidence"))
    out = found.where(F.col("kind") == kind) if kind else found
    out = out.where(F.col("category") == category) if category else out
    return out.orderBy(severity, sure, "hops", "src", "dst", "line").limit(most)


def tainted_sinks(hits: DataFrame, found: DataFrame, reachable_only: bool = False) -> DataFrame:
    """Dangerous calls with a mark on those some input reaches."""
    sinks = hits.where("role = 'sink'").select("chunk_id", F.col("what").alias("category"), "label", "line").distinct()
    reached = found.select(F.col("dst").alias("chunk_id"), "category", "line").distinct().withColumn("reached", F.lit(True))
    out = sinks.join(reached, ["chunk_id", "category", "line"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    return out.where("reached") if reachable_only else out


def cached_flows(cache: DataFrame, cached_depth: int, depth: int = 4, category: str | None = None) -> DataFrame | None:
    """Flows up to ``depth`` from a table of all flows up to ``cached_depth``; null if that isn't deep enough and they have to be computed."""
    if depth > cached_depth:
        return None
    found = cache.where(F.col("hops") <= depth)
    return found.where(F.col("category") == category) if category else found
