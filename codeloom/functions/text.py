"""Scalar functions over code and queries, as column expressions."""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a query look like a sentence.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "at",
    "by", "from", "that", "this", "is", "are", "was", "were", "be", "how", "what",
    "when", "where", "which", "who", "why", "does", "do", "it", "its", "into",
    "back", "if", "then", "their", "there", "all", "any",
)
#: Test files, and example trees as first or second part of a path.
TEST_FILE = r"(?i)\.(test|spec)\.|[/\\]__tests__[/\\]|_test\.|^tests?[/\\]|[/\\]tests?[/\\]|[/\\]spec[/\\]"
EXAMPLE_DIR = r"^(?:[^/\\]+[/\\])?(?:examples?|samples?|demos?|tutorials?|docs_src|sandbox|benchmarks?|scripts?)[/\\]"
#: BM25 parameters, embedding windows, the name space of stems.
K1, B = 1.5, 0.3
WINDOW, STRIDE, MAX_WINDOWS = 8000, 7040, 4
STEM_PREFIX = "~stem~"
SPLIT = r"[\s\W_]+"
#: Lines that open a body, leave a function, branch, or call.
_OPENS = r"[{:]\s*$"
_LEAVES = r"^\s*(return|throw|raise|yield)\b"
_BRANCHES = r"^\s*(if |else |for |while |switch |try |catch |finally |return |throw |raise |yield |await )"
_CALLS = r"[a-zA-Z_]\w*\s*\("


def words(text: Column) -> Column:
    """Words of at least two characters, as written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: F.length(w) >= 2)


def raw_tokens(text: Column) -> Column:
    """Lower-case words, each followed by its camel-case parts if it has several."""
    def forms(w: Column) -> Column:
        parts = F.split(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"), " ")
        return F.concat(F.array(F.lower(w)), F.when(F.size(parts) > 1, F.transform(F.filter(parts, lambda p: F.length(p) >= 2), F.lower)).otherwise(F.array()))

    return F.flatten(F.transform(words(text), forms))


def is_natural_language(query: Column) -> Column:
    """At least five words, two of them stop words, and a fifth of all."""
    found = F.filter(F.split(F.lower(query), SPLIT), lambda w: w != "")
    stops = F.size(F.filter(found, lambda w: w.isin(*STOPWORDS)))
    return F.coalesce((F.size(found) >= 5) & (stops >= 2) & (stops * 5 >= F.size(found)), F.lit(False))


def is_test_file(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_FILE), F.lit(False))


def is_example_dir(path: Column) -> Column:
    return F.coalesce(path.rlike(EXAMPLE_DIR), F.lit(False))


def lexical_document(deps: Column | None = None) -> Column:
    """What BM25 indexes of a chunk (columns of ``chunks``); concepts, or else hyde; null fields are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    scope = F.when(text("class_context") != "", F.concat(text("class_context"), F.lit("."), text("name"))).otherwise("")
    concepts = F.when(F.size(F.coalesce("concepts", F.array().cast("array<string>"))) > 0, joined("concepts")).otherwise(text("hyde"))
    return F.concat_ws(" ", text("name"), text("docstring"), deps if deps is not None else F.lit(""), joined("calls"), joined("params"), text("return_type"), scope, joined("type_refs"), concepts, text("code_snippet"))


def embedding_payload() -> Column:
    """What is embedded of a chunk; empty parts are left out."""
    refs = F.coalesce(F.col("type_refs"), F.array().cast("array<string>"))
    return F.concat_ws(
        "\n", F.nullif(F.col("summary"), F.lit("")), F.concat(F.lit("File Location: "), F.col("file_path")),
        F.concat(F.lit("Symbol Name: "), F.col("node_type"), F.lit(" -> "), F.coalesce("name", F.lit(""))),
        F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("Developer Documentation: "), F.col("docstring"))),
        F.when(F.size(refs) > 0, F.concat(F.lit("Type References: "), F.array_join(refs, ", "))),
        F.lit("--- Source Code ---"), F.nullif(F.col("code_snippet"), F.lit("")),
    )


def embedding_windows(payload: Column, most: int | None = MAX_WINDOWS) -> Column:
    """Overlapping windows of a payload beyond one window, at most ``most``, the whole payload if None; none if it fits."""
    last = F.ceil((F.length(payload) - WINDOW) / F.lit(STRIDE)).cast("int")
    last = F.least(F.lit(most - 1), last) if most else last
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(payload, i * STRIDE + 1, F.lit(WINDOW)))
    return F.when(F.length(payload) > WINDOW, cut).otherwise(F.array().cast("array<string>"))


def full_body(code: Column, content: Column, start: Column, end: Column, cut_at: int = 3000) -> Column:
    """The whole definition from its file where the stored code was cut; null where it wasn't, for a skeleton, and without lines."""
    body = F.array_join(F.slice(F.split(content, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")
    cut = (F.length(code) >= cut_at) & ~code.contains("// ... ") & (start >= 1) & end.isNotNull()
    return F.when(cut & (F.length(body) > F.length(code)), body)


def summary_text() -> Column:
    """What is embedded of a chunk's enrichment (columns of ``chunks``): summary, tags and qualified name; null without enrichment."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), ", ")
    named = F.when(text("class_context") != "", F.concat(text("class_context"), F.lit("."), text("name"))).otherwise(text("name"))
    parts = F.filter(F.array(text("summary"), tags, named), lambda p: p != "")
    return F.when((text("summary") != "") | (F.size(F.coalesce("concepts", F.array().cast("array<string>"))) > 0), F.array_join(parts, ". "))


def truncated(text: Column) -> Column:
    """The first window of a text."""
    return F.substring(text, 1, WINDOW)


def embedding_key(content_hash: Column, summary: Column, concepts: Column) -> Column:
    """Hash of the content, marked with that of the enrichment if there is one."""
    listed = F.array_join(F.coalesce(concepts, F.array().cast("array<string>")), ",")
    enriched = (F.coalesce(summary, F.lit("")) != "") | (listed != "")
    digest = F.substring(F.sha2(F.concat(F.coalesce(summary, F.lit("")), F.lit("|"), listed), 256), 1, 12)
    return F.when(enriched, F.concat(content_hash, F.lit("|e:"), digest)).otherwise(content_hash)


def base_key(key: Column) -> Column:
    """A vector's key without the mark of a summary or window."""
    return F.regexp_replace(key, r"[|](?:s|w[0-9]+)$", "")


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 for a zero vector or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def sign_bits(v: Column) -> Column:
    """Signs of a vector packed into 64-bit words; the value at i is bit i mod 64 of word i div 64."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
        lambda s, i: F.when(F.try_element_at(v, (w * 64 + i + 1).cast("int")) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(s),
    )
    return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / 64).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def blend(a: Column, b: Column, alpha: float = 0.5) -> Column:
    return F.zip_with(a, b, lambda p, q: p.cast("double") * (1 - alpha) + q.cast("double") * alpha)


def type_tokens(text: Column) -> Column:
    """Capitalised identifiers in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)"), 1), F.lower))


def single_type(text: Column) -> Column:
    """The only capitalised identifier of a type, null if there are several."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)"), 1))
    return F.when(F.size(found) == 1, found[0])


def signature_line(code: Column, most: int = 10) -> Column:
    """The first lines up to one after the first that opens a body or holds an arrow, as they are; empty for no code."""
    lines = F.slice(F.split(F.coalesce(code, F.lit("")), "\n", -1), 1, most)
    ends = F.transform(lines, lambda line, i: F.when((i > 0) & (line.rlike(_OPENS) | line.contains("=>")), i + 1).otherwise(most))
    return F.array_join(F.slice(lines, 1, F.array_min(ends)), "\n")


def skeleton(code: Column, lines: int = 15) -> Column:
    """The first lines of a class too large to keep whole, with a note."""
    all_lines = F.split(F.coalesce(code, F.lit("")), "\n")
    note = F.concat(F.lit("// ... "), (F.size(all_lines) - lines).cast("string"), F.lit(" more lines"))
    return F.when(F.size(all_lines) > lines, F.concat_ws("\n", F.array_join(F.slice(all_lines, 1, lines), "\n"), note)).otherwise(code)


def pruned_body(code: Column, tokens: Column, head: int = 5, tail: int = 3, most: int = 40) -> Column:
    """The first and last lines of a body of more than ``most``, and of those between the ones that hold a query token or leave the function.

    Without such a line the first that branch or call; without those, or without tokens of three
    characters, the first ``most`` lines with a mark. Empty for no code.
    """
    lines = F.split(F.coalesce(code, F.lit("")), "\n", -1)
    n = F.size(lines)
    useful = F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), F.lower)
    first, last, between = F.slice(lines, 1, head), F.slice(lines, -tail, tail), F.slice(lines, head + 1, F.greatest(n - head - tail, F.lit(0)))
    relevant = F.filter(between, lambda line: F.lower(line).rlike(_LEAVES) | F.exists(useful, lambda t: F.lower(line).contains(t)))
    structural = F.slice(F.filter(between, lambda line: F.lower(line).rlike(_BRANCHES) | (line.rlike(_CALLS) & (F.length(F.regexp_replace(line, r"^\s+|\s+$", "")) > 4))), 1, max(4, most - head - tail))
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n// …"))
    kept = lambda some: F.array_join(F.concat(first, some, last), "\n")
    return F.when(n <= most, F.coalesce(code, F.lit(""))).when(F.coalesce(F.size(useful), F.lit(0)) <= 0, cut).when(F.size(relevant) > 0, kept(relevant)).when(F.size(structural) > 0, kept(structural)).otherwise(cut)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def hotness(age_days: Column, churn: Column, max_churn: Column) -> Column:
    """Half recency, half churn; 0 without a signal; an unknown date is ten years ago."""
    score = 0.5 * F.exp(-F.coalesce(age_days.cast("double"), F.lit(3650.0)) / 90) + 0.5 * F.log1p(churn) / F.log1p(max_churn)
    return F.when(F.coalesce(churn, F.lit(0)) <= 0, F.lit(0.0)).otherwise(score)


def freshness(indexed: Column, head: Column, dirty: Column) -> Column:
    """Whether an index is of the commit at hand."""
    return F.when(indexed.isNull() | head.isNull(), "unknown").when((indexed == head) & (dirty == 0), "fresh").when(indexed == head, "syncing").otherwise("stale")


def language_key(path: Column) -> Column:
    """Pattern family of a file: js, py, java, go or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx"), "js").when(ext == "py", "py").when(ext == "java", "java").when(ext == "go", "go")


def normalized_scip_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:file://)?(?:\./)*", "")


def joined_route(base: Column, path: Column) -> Column:
    """Two parts of a route with one slash between, one at the front and none at the end."""
    whole = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), "/{2,}", "/")
    return F.when(F.length(whole) > 1, F.regexp_replace(whole, "/$", "")).otherwise(whole)


def parsed_enrichment(response: Column) -> Column:
    """Summary and at most 8 tags of a model's answer."""
    summary = F.trim(F.regexp_extract(response, r"(?im)^\s*SUMMARY:\s*(.+)$", 1))
    tags = F.regexp_extract(response, r"(?im)^\s*TAGS:\s*(.+)$", 1)
    listed = F.slice(F.array_distinct(F.filter(F.transform(F.split(F.lower(tags), r"\s*,\s*"), F.trim), lambda t: t != "")), 1, 8)
    return F.struct(F.nullif(summary, F.lit("")).alias("summary"), listed.alias("concepts"))


def parsed_ranking(response: Column, n: Column) -> Column:
    """Distinct numbers 1..n of a model's answer, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(response, F.lit("")), F.lit(r"(\d{1,6})"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= n)))


def enrich_prompt(name: Column, code: Column) -> Column:
    return F.concat(F.lit("Describe in one sentence what the function "), name, F.lit(" does, as SUMMARY: ..., and give up to 8 TAGS: ...\n\n"), code)


def rerank_prompt(query: Column, cards: Column) -> Column:
    """Asks a model to order numbered candidates (an array of one-line cards)."""
    numbered = F.transform(cards, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.concat(F.lit("Order the candidates by how well they answer the question. Reply with their numbers, the best first.\n\nQuestion: "), query, F.lit("\n\n"), F.array_join(numbered, "\n"))


def hyde_prompt(query: Column, language: Column) -> Column:
    """Asks a model for code that would answer a question, in the language of the repository if it is known."""
    return F.concat(F.lit("Write a short "), F.coalesce(F.concat(language, F.lit(" ")), F.lit("")), F.lit("function that does the following. Reply with code only.\n\n"), query)


def string_list(text: Column) -> Column:
    """A JSON array of strings; empty for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def canonical_json(value: object) -> str:
    """JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def wilson(hits: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """Confidence interval of a share."""
    if n == 0:
        return 0.0, 0.0
    p, d = hits / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (mid - half) / d), min(1.0, (mid + half) / d)


# -- stems ------------------------------------------------------------------------------------------

#: Suffixes of the Porter stemmer (1980), 'or' added to the agent nouns.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "or", "ic", "ou")


def _shape(word: str) -> str:
    """The word as v and c; y is a vowel at the start and after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and not out.endswith("v")) else "c"
    return out


def _m(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter stem of a lower-case word; words of up to three letters stay."""
    if len(word) <= 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")) or (not (_double(w) and w[-1] not in "lsz") and _m(w) == 1 and _short_end(w)):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
    if len(w) > 2 and w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP2, _STEP3):
        for end, new in step.items():
            if w.endswith(end):
                w = w[: -len(end)] + new if _m(w[: -len(end)]) else w
                break
    for end in _STEP4:
        if w.endswith(end):
            rest = w[: -len(end)]
            if _m(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
