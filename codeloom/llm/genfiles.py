"""Files that nobody wrote by hand: generated, minified, third-party copies, data held as code.

Three linear support-vector classifiers decide, each on its own view of a file: hashed character
n-grams of the texts that head it, its path components, and hashed character n-grams of its code
without those heads. There are no labels, so they come from marks (:func:`head_marks`,
:func:`path_marks`, :func:`shape_marks`), and never from the view that is trained (co-training):

    view   features                  labels of training          held-out repositories give
    head   n-grams of heads          marks of path or shape      a threshold against head marks
    path   components of the path    marks of head or shape      a threshold against path marks
    body   n-grams, heads masked     marks of shape              a threshold against shape marks

Shape (line lengths, runs of literals, line directives) is no feature. Marks take no part in judging
a file: it is found if the margin of some view is above the threshold of that view.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: files, those of them whose code is used, rows of one file, and
#: rows of one file whose code is used; heads of one file, and characters of a head.
TRAINING_FILES, BODY_FILES, TRAINING_ROWS, BODY_ROWS, TRAINING_HEADS, HEAD_CHARS = 16_000, 3000, 200, 20, 50, 2000
#: Slots of the hashed features.
GRAMS, PATHS, HEADS = 1 << 15, 1 << 15, 1 << 15
#: N-grams that are added to the number of those of a file, so that a few of a short one don't decide.
SMOOTHING = 200
#: Penalties of the classifiers. They are small for head and path, whose labels miss about half of the
#: files they should mark: many equal examples then outweigh a few labels.
_C = {"head": 0.003, "path": 0.0004, "body": 0.3}
#: Penalties where a view has to learn from its own marks.
_OWN_C = {"head": 1.0, "path": 1.0, "body": 0.3}
#: F1 on held-out repositories below which a view learns from its own marks instead.
LEAST_F1 = 0.97

# -- what a file shows --------------------------------------------------------------------------

_GIVEAWAY = re.compile(
    r"auto[\s_-]*generated|machine[\s-]*(?:made|generated)|\bgenerated (?:by|from|automatically|with|using)|@generated\b|automatically (?:created|generated|produced)|do not (?:edit|modify|change)|don't edit|changes will be lost"
    r"|自动生成|自動生成|automatisch (?:erzeugt|erstellt|generiert)|nicht (?:ändern|bearbeiten)|ne (?:pas|jamais) modifier|(?:produit|généré) (?:par|automatiquement)|generado (?:por|automáticamente)|no (?:editar|modificar)|não (?:editar|modificar)|сгенерирован|generowan[ye]|genererad|자동 생성", re.I
)
_COPIED = re.compile(
    r"(?:imported|copied|vendored|taken|forked) from (?:upstream|https?:|[\w./-]+ v?\d)|(?:bundled|vendored|verbatim|local) copy of|fixes go upstream|^[\s/*!]*[\w.@/-]+ (?:- )?(?:version |v)\d+\.\d+|^[\s/*!#]*@license +[\w.-]+ +v?\d|\(c\) the [\w.-]+ (?:contributors|authors)|see upstream\b", re.I | re.M
)
_PATH_DIRS = frozenset("node_modules bower_components third_party third-party thirdparty vendors deps external externals contrib generated __generated__ gen autogen auto_generated autogenerated jspm_packages site-packages".split())
_PATH_NAME = re.compile(
    r"(?:\.min|\.packed|\.bundle|\.chunk|\.pb|_pb2|_pb2_grpc|\.pb2|\.gen|_gen|\.g|\.generated|_generated|\.autogen|\.tab|\.yy|\.designer|\.freezed)\.\w+$|^(?:zz_generated|moc_|ui_|qrc_|lex\.yy)|-\d+\.\d+(?:\.\d+)*(?:[-.]min)?\.\w+$|\.[0-9a-f]{7,}\.(?:chunk\.)?\w+$", re.I
)
_VERSIONED_DIR = re.compile(r"^[A-Za-z][\w.]*-\d+\.\d+(?:\.\d+)*$")
_LINE_MARK = re.compile(r"^[ \t]*(?://|#|/\*)?[ \t]*#[ \t]*line \d+ \"", re.M)
_BLOB = re.compile(r"[A-Za-z0-9+/=_\-]{60,}|(?:\\x[0-9a-fA-F]{2}){16,}|(?:\\u[0-9a-fA-F]{4}){12,}|(?:(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?)[uUlLfF]*[ \t]*,\s*){40,}|(?:[\[{(][^\[\]{}()\n\r]{4,160}[\]})][ \t]*,?\s*){8,}")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_SHORT = re.compile(r"(?<![\w$])(?:[A-Za-z]\d?|[a-z]{2}|_0x[0-9a-f]+)(?![\w$])")
_LEADING = re.compile(r"\s*((?:(?://[^\n\r]*|/\*.*?\*/|#[^\n\r]*)\s*)+)", re.S)
_LONG_LINE = 250

SHAPE_COLUMNS = ("chars", "dense", "blob", "idents", "shorts", "line_marks")
VIEWS = ("head", "path", "body")


def head_texts(docstring: str | None, code: str | None) -> list[str]:
    """Texts that may head the file: an inherited docstring and the comments before the code."""
    out = []
    if docstring and docstring.startswith("[File Context]"):
        out.append(docstring[len("[File Context]") :].lstrip(": "))
    if code and (m := _LEADING.match(code)):
        out.append(m.group(1))
    return out


def shape(code: str) -> tuple[int, ...]:
    """SHAPE_COLUMNS of a text: characters, those in long lines without spaces, those in data literals, identifiers, short ones, line directives."""
    if len(code) < 60:
        return len(code), 0, 0, 0, 0, 0
    dense = 0
    if len(code) > _LONG_LINE:
        for line in code.splitlines():
            if len(line) > _LONG_LINE and line.count(" ") < 0.12 * len(line):
                dense += len(line)
    blob = 0
    for m in _BLOB.finditer(code):
        run = m.group()
        if len(run) >= 400 or not (run.isalpha() or len(set(run)) < 12):
            blob += len(run)
    shorts = len(_SHORT.findall(code)) if dense else 0
    idents = len(_IDENT.findall(code)) if dense else 0
    return len(code), dense, blob, idents, shorts, len(_LINE_MARK.findall(code)) if "line " in code else 0


def path_marks(path: str) -> bool:
    """Whether the path follows a convention for files that nobody wrote here."""
    *dirs, name = path.split("/")
    at_root = len(dirs) > 2 and dirs[1].lower() in ("vendor", "dist")  # elsewhere these are ordinary words
    return at_root or any(d.lower() in _PATH_DIRS or _VERSIONED_DIR.match(d) for d in dirs[1:]) or bool(_PATH_NAME.search(name))


def shape_marks(chars: float, dense: float, blob: float, idents: float, shorts: float, line_marks: float) -> bool:
    """Whether the code is minified, data, or maps its lines to a source it was made from."""
    chars = max(chars, 1)
    return (dense > 0.4 * chars and shorts > 0.25 * max(idents, 1)) or (blob + dense > 0.25 * chars and blob >= 400) or line_marks > 0


def head_marks(text: str) -> bool:
    """Whether a head says that the file is generated or copied."""
    return bool(_GIVEAWAY.search(text) or _COPIED.search(text))


# -- features -------------------------------------------------------------------------------------

def _hash(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def grams(text: str, size: int, n: int = 4) -> np.ndarray:
    """Hashes of the character n-grams of a text (over its UTF-8 bytes)."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < n:
        return np.empty(0, np.int64)
    h = np.zeros(len(b) - n + 1, np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) ^ b[i : len(b) - n + 1 + i]
    return ((h ^ (h >> np.uint32(15))) % np.uint32(size)).astype(np.int64)


def body(code: str) -> str:
    """Code without the comments before it."""
    m = _LEADING.match(code)
    return code[m.end() :] if m else code


def path_parts(path: str) -> set[str]:
    """Components of a path that may tell: its folders, and of the name the suffixes and the first and last part with their separators.

    The first folder, the repository, is left out; numbers and hashes are alike.
    """
    *dirs, name = path.lower().split("/")
    found = set()
    for i, d in enumerate(dirs[1:]):
        plain = re.sub(r"\d+(?:\.\d+)*", "#", d)
        found.add(f"folder {plain}")
        if i == 0:
            found.add(f"top {plain}")
        if plain.endswith("#"):
            found.add("folder *" + re.search(r"[-_]?v?#$", plain).group())
    name = re.sub(r"(?<![a-z0-9])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![a-z0-9])", "@", name)
    stem, *suffixes = re.sub(r"\d+(?:\.\d+)*", "#", name).split(".")
    found |= {f"suffix {s}" for s in suffixes[:-1]}
    parts = [p for p in re.split(r"([_-])", stem) if p]
    if len(parts) > 1:
        found |= {"last " + "".join(parts[-2:]), "first " + "".join(parts[:2])}
    if len(parts) > 3:
        found.add("last " + "".join(parts[-4:]))
    return found


def path_slots(path: str) -> np.ndarray:
    return np.array(sorted({_hash(p, PATHS) for p in path_parts(path)}), np.int64)


def head_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    index, n = np.unique(grams(text.lower(), HEADS), return_counts=True)
    return index, n * (2.0 / max(1e-9, float(np.linalg.norm(n))))


def _rarity(slots: list[np.ndarray], size: int, most: float) -> np.ndarray:
    """A scale per slot: the rarer in the sample, the larger, so that rare features learn as fast as others."""
    df = np.zeros(size)
    for s in slots:
        df[s] += 1
    return np.minimum(np.sqrt(len(slots) / 10 / np.maximum(df, 2)), most)


# -- linear support-vector machine -----------------------------------------------------------------

def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, c: np.ndarray, epochs: int = 30) -> np.ndarray:
    """Weights (the last one is the bias) by dual coordinate descent on the hinge loss; rows are (indices, values)."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(0)
    y = np.where(labels, 1.0, -1.0)
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            gradient = y[i] * (w[index] @ value + w[size]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[index] += step * value
                w[size] += step
                moved = max(moved, abs(step) / c[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def best_threshold(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float, float, float]:
    """The threshold with the best F1, in the middle of the gap where it lies, with F1, precision and recall.

    Without a true case it is infinite, without a false one minus infinite.
    """
    if not truth.any():
        return np.inf, 0.0, 0.0, 0.0
    if truth.all():
        return -np.inf, 1.0, 1.0, 1.0
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(truth[order])
    n = np.arange(1, len(m) + 1)
    f1 = np.where(np.r_[m[:-1] > m[1:], True], 2 * hits / (n + truth.sum()), 0.0)
    at = int(np.argmax(f1))
    below = m[at + 1] if at + 1 < len(m) else m[at] - 1.0
    return float((m[at] + below) / 2), float(f1[at]), float(hits[at] / n[at]), float(hits[at] / truth.sum())


NOTHING = -1e9  #: margin of a view that has nothing to look at


@dataclass
class Model:
    """Weights and bias of each view, its threshold, and what the held-out repositories gave."""

    weights: dict[str, np.ndarray]
    bias: dict[str, float]
    thresholds: dict[str, float]
    validation: list[dict] = field(default_factory=list)

    def head_margin(self, text: str) -> float:
        index, value = head_vector(text)
        return float(self.weights["head"][index] @ value + self.bias["head"]) if len(index) else NOTHING

    def path_margin(self, path: str) -> float:
        return float(self.weights["path"][path_slots(path)].sum() + self.bias["path"])

    def body_margin(self, gram_sum: float, gram_n: float) -> float:
        return gram_sum / (gram_n + SMOOTHING) + self.bias["body"] if gram_n else NOTHING

    def verdict(self, path: str, head: float, gram_sum: float, gram_n: float) -> tuple[str, float]:
        """The view that says most against the file, and how far its margin is above the threshold."""
        over = {"head": head, "path": self.path_margin(path), "body": self.body_margin(gram_sum, gram_n)}
        view = max(VIEWS, key=lambda v: over[v] - self.thresholds[v])
        return view, over[view] - self.thresholds[view]


_SAMPLE_DDL = "file_path string, in_body boolean, told boolean, heads array<string>, grams binary, " + ", ".join(f"{c} bigint" for c in SHAPE_COLUMNS)
_SAMPLE_TYPES = [pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.binary(), *[pa.int64()] * len(SHAPE_COLUMNS)]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: heads and whether one gives the file away, the shape, and the n-grams of the code of body files."""
    for batch in batches:
        out = []
        for path, docstring, code, in_body in zip(*(c.to_pylist() for c in batch.columns)):
            heads = head_texts(docstring, code)
            found = grams(body(code), GRAMS).astype("<u2").tobytes() if in_body and code else b""
            out.append((path, bool(in_body), any(map(head_marks, heads)), [h[:HEAD_CHARS] for h in heads], found, *shape(code or "")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SAMPLE_TYPES)], ["file_path", "in_body", "told", "heads", "grams", *SHAPE_COLUMNS])


_FILE_SAMPLE_DDL = "file_path string, told boolean, heads array<string>, slots binary, counts binary, gram_n bigint, " + ", ".join(f"{c} bigint" for c in SHAPE_COLUMNS)


def _sample_files(keys: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    counts = np.zeros(GRAMS, np.int64)
    for data in table.column("grams").to_pylist():
        counts += np.bincount(np.frombuffer(data, "<u2"), minlength=GRAMS)
    slots = np.flatnonzero(counts)
    heads = sorted({h for own in table.column("heads").to_pylist() for h in own})[:TRAINING_HEADS]
    row = (keys[0].as_py(), any(table.column("told").to_pylist()), heads, slots.astype("<u2").tobytes(), np.minimum(counts[slots], 65535).astype("<u2").tobytes(), int(counts.sum()), *(sum(table.column(c).to_pylist()) for c in SHAPE_COLUMNS))
    types = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64(), *[pa.int64()] * len(SHAPE_COLUMNS)]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=["file_path", "told", "heads", "slots", "counts", "gram_n", *SHAPE_COLUMNS])


def sample(chunks: DataFrame, max_files: int = TRAINING_FILES, body_files: int = BODY_FILES, max_rows: int = TRAINING_ROWS) -> list:
    """At most ``max_files`` files, chosen by the hash of their path, with about ``max_rows`` rows of each; the first ``body_files`` with n-grams of their code."""
    files = chunks.where("file_path is not null").groupBy("file_path").count()
    chosen = files.withColumn("_h", F.xxhash64("file_path")).orderBy("_h", "file_path").limit(max_files)
    chosen = chosen.withColumn("in_body", F.row_number().over(Window.orderBy("_h", "file_path")) <= body_files).drop("_h")  # bounded by max_files
    place = F.pmod(F.xxhash64("id", "indexed_at"), F.greatest("count", F.lit(max_rows)))
    rows = chunks.select("id", "indexed_at", "file_path", "docstring", "code_snippet").join(F.broadcast(chosen), "file_path").where(place < max_rows)
    rows = rows.withColumn("in_body", F.col("in_body") & (F.pmod(F.xxhash64("indexed_at", "id"), F.greatest("count", F.lit(BODY_ROWS))) < BODY_ROWS))
    per_row = rows.select("file_path", "docstring", "code_snippet", "in_body").mapInArrow(_sample_rows, _SAMPLE_DDL)
    return sorted(per_row.groupBy("file_path").applyInArrow(_sample_files, _FILE_SAMPLE_DDL).collect(), key=lambda r: r.file_path)


def _fit(rows: list, labels: np.ndarray, size: int, c: float) -> np.ndarray:
    if not len(labels) or labels.all() or not labels.any():
        return np.zeros(size + 1)
    return train_svm(rows, labels, size, np.where(labels, max(1.0, (~labels).sum() / labels.sum()), 1.0) * c)


def train(chunks: DataFrame, max_files: int = TRAINING_FILES, body_files: int = BODY_FILES, max_rows: int = TRAINING_ROWS) -> Model:
    """The classifiers of all views, trained on a bounded sample (see :func:`sample`).

    A fifth of the repositories is held out (all count where that leaves either side without a marked
    file): thresholds come from them, against the marks of the view, which its training never saw.
    Where that agrees poorly (F1 below LEAST_F1, as in a small table where hardly any file has marks of
    two kinds), the view learns from its own marks if that is better. A view without any mark of its own
    finds nothing; one that marks all files of the sample finds all.
    """
    rows = sample(chunks, max_files, body_files, max_rows)
    head = np.array([r.told for r in rows], bool)
    path = np.array([path_marks(r.file_path) for r in rows], bool)
    form = np.array([shape_marks(*(float(r[c]) for c in SHAPE_COLUMNS)) for r in rows], bool)
    held = np.array([_hash(r.file_path.split("/")[0], 5) == 0 for r in rows], bool)

    heads = [(i, head_vector(h)) for i, r in enumerate(rows) for h in r.heads]
    slots = [path_slots(r.file_path) for r in rows]
    path_scale = _rarity(slots, PATHS, 12.0)
    coded = [i for i, r in enumerate(rows) if r.gram_n]
    found = [np.frombuffer(rows[i].slots, "<u2").astype(np.int64) for i in coded]
    gram_scale = _rarity(found, GRAMS, 6.0) * 20
    views = {
        "head": (HEADS, np.ones(HEADS), [i for i, _ in heads], [v for _, v in heads], head, path | form),
        "path": (PATHS, path_scale, list(range(len(rows))), [(s, path_scale[s]) for s in slots], path, head | form),
        "body": (GRAMS, gram_scale, coded, [(s, np.frombuffer(rows[i].counts, "<u2") / (rows[i].gram_n + SMOOTHING) * gram_scale[s]) for i, s in zip(coded, found)], form, form),
    }
    model = Model({}, {}, {})
    for view, (size, scale, owner, vectors, own, other) in views.items():
        owner = np.array(owner, np.int64)
        seen = np.zeros(len(rows), bool)
        seen[owner] = True
        judged_here = seen if view == "body" else np.ones(len(rows), bool)  # a file without a head has no mark of one
        split = (own & held & judged_here).any() and (own & ~held & judged_here).any()
        test, fit = (held & judged_here, ~held) if split else (judged_here, np.ones(len(rows), bool))
        best = None
        for labels, c in ((other, _C[view]), (own, _OWN_C[view])):
            use = np.flatnonzero(fit[owner])
            w = _fit([vectors[i] for i in use], labels[owner[use]], size, c)
            margins = np.full(len(rows), NOTHING)
            np.maximum.at(margins, owner, np.array([w[i] @ v + w[size] for i, v in vectors]))
            judged = best_threshold(margins[test], own[test])
            if best is None or judged[1] > best[1][1]:
                best = w, judged, "other marks" if labels is other and view != "body" else "own marks"
            if judged[1] >= LEAST_F1 or view == "body":
                break
        w, (threshold, _, precision, recall), learnt = best
        model.weights[view], model.bias[view], model.thresholds[view] = w[:size] * scale, float(w[size]), threshold
        model.validation.append({"view": view, "learnt_from": learnt, "n_files": int(test.sum()), "n_marked": int(own[test].sum()), "precision": round(precision, 4), "recall": round(recall, 4), "threshold": round(threshold, 4)})
    return model


_ROW_DDL = "file_path string, gram_sum double, gram_n bigint, head double"
_FILE_DDL = "file_path string, margin double, view string"


def judged_files(chunks: DataFrame, model: Model) -> DataFrame:
    """file_path, margin, view for every file: how far the view that says most is above its threshold.

    Rows give partial sums of linear scores, which are added per file with a map-side combine, so
    a file of very many rows is no hot group. Null code counts as empty; rows without a path are
    left out.
    """
    head_cache: dict[str, float] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights["body"]
        for batch in batches:
            out = []
            for path, docstring, code in zip(*(c.to_pylist() for c in batch.columns)):
                head = NOTHING
                for text in head_texts(docstring, code):
                    if text not in head_cache:
                        if len(head_cache) > 50_000:
                            head_cache.clear()
                        head_cache[text] = model.head_margin(text)
                    head = max(head, head_cache[text])
                g = grams(body(code), GRAMS) if code else np.empty(0, np.int64)
                out.append((path, float(weights[g].sum()), len(g), head))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.int64(), pa.float64()))], ["file_path", "gram_sum", "gram_n", "head"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, *reversed(model.verdict(path, head, gram_sum, gram_n))) for path, gram_sum, gram_n, head in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.string()))], ["file_path", "margin", "view"])

    partial = chunks.where("file_path is not null").select("file_path", "docstring", "code_snippet").mapInArrow(rows, _ROW_DDL)
    summed = partial.groupBy("file_path").agg(F.sum("gram_sum").alias("gram_sum"), F.sum("gram_n").alias("gram_n"), F.max("head").alias("head"))
    return summed.mapInArrow(files, _FILE_DDL)


def not_hand_written(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """file_path, margin, view of the files of which some view's margin is above its threshold."""
    return judged_files(chunks, model or train(chunks)).where("margin > 0")


def validation(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per view: what it learnt from, and precision and recall on held-out repositories against its own marks."""
    kind = "view string, learnt_from string, n_files int, n_marked int, precision double, recall double, threshold double"
    return chunks.sparkSession.createDataFrame((model or train(chunks)).validation, kind)
