"""Finding text that was read in a wrong character encoding, and restoring it by noisy-channel decoding.

The channel: the bytes of the text, in the right encoding, were read in a wrong one, once or
several times; bytes may have been lost (U+FFFD). The source: frequencies of words and of pairs
of characters over the whole corpus, in hashed tables of fixed size. For every passage the bytes
are recovered under each wrong encoding and decoded under each right one; lost bytes are wildcards
of a lattice that is searched with Viterbi.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: Entries of the hashed tables: words and pairs of characters. They don't grow with the corpus.
WORDS, PAIRS = 1 << 20, 1 << 18
#: Most frequent tokens that are decoded once for all tasks, how often one must occur for that, and distinct tokens a task
#: counts before it hands them on.
SHARED_TOKENS, SHARED_LEAST, COUNTED_TOKENS = 20_000, 2, 500_000
#: Ways that the searches keep at a place: by last character over bytes, and over letters for a lost one.
BYTE_BEAM, LETTER_BEAM = 24, 64

#: Encodings in which text was wrongly read, or in which it was written.
SINGLE = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15", "cp866", "cp852", "mac_cyrillic", "cp1255", "cp1256", "cp874", "cp1258")
WIDE = ("gbk", "cp932", "cp949", "big5")
WRITTEN_WIDE = ("gbk", "euc_jp", "cp932", "cp949", "big5")
#: Wrong readings of text that was not written in UTF-8.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")

LOST = "�"
_QUOTED = re.compile(r"(`+)(?!`)[^`\n\r]{1,200}?\1")
_TOKEN = re.compile(r"[A-Za-z]*[^\x00-\x7f](?:[^\x00-\x7f]|[A-Za-z])*")
_LINE = re.compile(r"[^\n]+")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯ｦ-ﾟ]")
_SANE = frozenset(("Lu", "Ll", "Lo", "Lm", "Mn", "Mc", "Nd", "No", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sc", "Sk", "Sm", "So", "Zs", "Cf"))


def _table(codec: str) -> dict[int, str]:
    """Each character of a single-byte encoding as the byte it was read from; undefined bytes stand for themselves."""
    out = {}
    for b in range(255, 127, -1):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = chr(b)
    for b in range(128, 160):
        out.setdefault(b, chr(b))
    return out


_TABLES = {c: _table(c) for c in SINGLE}
_CHARS = {c: frozenset(map(chr, t)) | {LOST} for c, t in _TABLES.items()}
_READ = {c: {ord(v): chr(k) for k, v in _table(c).items() if not (128 <= k < 160 and c != "latin_1")} for c in SINGLE}


def _to_bytes(text: str, codec: str) -> str | None:
    """Bytes of a text as characters below 256; null if some character isn't of the encoding. A lost one stays."""
    if not all(c < "\x80" or c in _CHARS[codec] for c in text):
        return None
    return text.translate(_TABLES[codec])


@lru_cache(maxsize=200_000)
def _is_odd(c: str) -> bool:
    return c > "\x7f" and c != LOST and unicodedata.category(c) not in _SANE


def _odd(text: str) -> int:
    """Characters that text doesn't hold: control codes, unassigned ones."""
    return sum(map(_is_odd, text))


def _sane(text: str) -> bool:
    return _odd(text) == 0


# -- source model ---------------------------------------------------------------------------------

def _word_slot(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WORDS


def _pair_slot(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B >> 7) % PAIRS


@dataclass
class Source:
    """Logarithms of the frequencies (per million) of words and pairs of characters with a character beyond ASCII."""

    words: np.ndarray
    pairs: np.ndarray
    cache: dict = field(default_factory=dict)
    shared: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._words, self._pairs = array("f", self.words.tobytes()), array("f", self.pairs.tobytes())  # faster to read one by one

    def __getstate__(self) -> dict:
        return {"words": self.words, "pairs": self.pairs, "shared": self.shared}

    def __setstate__(self, state: dict) -> None:
        self.words, self.pairs, self.shared, self.cache = state["words"], state["pairs"], state["shared"], {}
        self.__post_init__()

    def word(self, token: str) -> float:
        return self._words[_word_slot(token)]

    def pair(self, a: str, b: str) -> float:
        return self._pairs[_pair_slot(a, b)]

    def score(self, token: str) -> float:
        """How usual a token is: the mean over its pairs, and the word itself unless it is of a script without spaces."""
        total, n, last, table = 0.0, 0, 0, self._pairs
        for c in map(ord, token):
            if last and (last > 0x7F or c > 0x7F):
                total += table[(last * 0x9E3779B1 + c * 0x85EBCA6B >> 7) % PAIRS]
                n += 1
            last = c
        mean = total / n if n else self.word(token)
        if len(_CJK.findall(token)) * 2 > len(token):
            return mean
        return 0.6 * self.word(token) + 0.4 * mean


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if "`" in text else text


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the texts of one task with their number."""
    seen: Counter[str] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        tokens = list(seen)
        for at in range(0, len(tokens), 50_000):
            part = tokens[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t.encode("utf-8", "replace").decode() for t in part], pa.string()), pa.array([seen[t] for t in part], pa.int64())], ["token", "n"])
        seen.clear()

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text and not text.isascii():
                seen.update(_TOKEN.findall(_unquoted(text)))
        if len(seen) > COUNTED_TOKENS:
            yield from rows()
    yield from rows()


def _fill_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filled entries of the tables of words and pairs over counted tokens."""
    words, pairs = np.zeros(WORDS, np.int64), np.zeros(PAIRS, np.int64)
    for batch in batches:
        for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()):
            words[_word_slot(token)] += n
            for a, b in zip(token, token[1:]):
                if a > "\x7f" or b > "\x7f":
                    pairs[_pair_slot(a, b)] += n
    for kind, table in ((0, words), (1, pairs)):
        index = np.flatnonzero(table)
        for at in range(0, len(index), 50_000):
            i = index[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(table[i])], ["kind", "slot", "n"])


def train(documents: DataFrame, shared_tokens: int = SHARED_TOKENS) -> Source:
    """The source model over all texts.

    Tokens are counted once over the whole corpus; from the counts come the tables of words and pairs, of
    which tasks send only the filled entries, and the ``shared_tokens`` most frequent tokens (of at least
    SHARED_LEAST occurrences). Those are decoded once, over all tasks, and go with the model: they are nearly all tokens of a corpus, and would else be
    decoded again by every worker. Any other token is decoded where it occurs.
    """
    tokens = cut_lineage(documents.select("text").mapInArrow(_count_tokens, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    counts = tokens.mapInArrow(_fill_tables, "kind int, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most WORDS + PAIRS rows
    tables = []
    for kind, size in ((0, WORDS), (1, PAIRS)):
        table = np.zeros(size)
        own = counts.filter(pa.compute.equal(counts.column("kind"), kind))
        table[own.column("slot").to_numpy()] = own.column("n").to_numpy()
        tables.append(np.log2(table * 1e6 / max(1.0, table.sum()) + 0.5).astype(np.float32))
    source = Source(*tables)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([pickle.dumps(_readings(source, t)) for t in found], pa.binary())], ["token", "readings"])

    tasks = min(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100)
    frequent = tokens.where(F.col("n") >= SHARED_LEAST).orderBy(F.desc("n"), "token").limit(shared_tokens).repartition(tasks)
    decoded = frequent.select("token").mapInArrow(decode, "token string, readings binary").toArrow()  # at most shared_tokens rows
    return Source(*tables, {}, {t: pickle.loads(r) for t, r in zip(decoded.column("token").to_pylist(), decoded.column("readings").to_pylist())})


# -- channel --------------------------------------------------------------------------------------

def _viterbi_utf8(source: Source, data: list[int | None]) -> tuple[str, int, int]:
    """Best text for UTF-8 bytes with wildcards (null): text, characters from complete bytes, bytes that fit nowhere."""
    lengths = lambda b: 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    # state: last character -> (score, text, complete, misfits) of the best path, by position
    best: list[dict[str, tuple[float, str, int, int]]] = [{} for _ in range(len(data) + 1)]
    best[0] = {"": (0.0, "", 0, 0)}

    def reach(at: int, path: tuple[float, str, int, int]) -> None:
        last = path[1][-1:]
        held = best[at].get(last)
        if held is None or path[0] > held[0]:
            best[at][last] = path

    def steps(i: int, b: int | None) -> list[tuple[int, str, float, int]]:
        """End, character, cost and whether all of its bytes are there, of the characters that may begin at ``i``."""
        out = []
        for n in (1, 2, 3, 4) if b is None else (lengths(b),):
            part = data[i : i + n]
            if not n or len(part) < n or (n == 1 and b is None) or sum(x is None for x in part) > 1:
                continue
            if None not in part:
                try:
                    out.append((i + n, bytes(part).decode(), 0.0, 1))
                except UnicodeDecodeError:
                    pass
                continue
            hole = part.index(None)
            rest = [x for x in part if x is not None]
            if (hole > 0 and lengths(rest[0]) != n) or any(x is not None and not 0x80 <= x < 0xC0 for x in part[1:]):
                continue
            for x in range(0x80, 0xC0) if hole else range({2: 0xC2, 3: 0xE0, 4: 0xF0}[n], {2: 0xE0, 3: 0xF0, 4: 0xF5}[n]):
                try:
                    c = bytes([x if y is None else y for y in part]).decode()
                except UnicodeDecodeError:
                    continue
                if not _is_odd(c):
                    out.append((i + n, c, -2.0, 0))
        return out

    for i, b in enumerate(data):
        paths = sorted(best[i].values(), reverse=True)[:BYTE_BEAM]
        ahead = steps(i, b) if paths else []
        for score, text, complete, misfits in paths:
            reach(i + 1, (score - 8.0, text + (LOST if not text.endswith(LOST) else ""), complete, misfits + (b is not None)))
            last = text[-1:]
            for end, c, cost, whole in ahead:
                reach(end, (score + cost + (source.pair(last, c) if last and (c > "\x7f" or last > "\x7f") else 0.0), text + c, complete + whole, misfits))
    found = max(best[len(data)].values(), default=(0.0, LOST, 0, len(data)))
    return found[1], found[2], found[3]


def _wide_bytes(text: str, codec: str) -> list[int | None] | None:
    out: list[int | None] = []
    for c in text:
        if c == LOST:
            out.append(None)
            continue
        try:
            out.extend(c.encode(codec))
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0xFF and codec != "gbk":
                out.append(ord(c))
            else:
                return None
    return out


def _from_utf8(source: Source, token: str, codec: str) -> str | None:
    """The token if it was UTF-8 read in ``codec``; null if it wasn't."""
    if codec in WIDE:
        if not _CJK.search(token):
            return None
        data = _wide_bytes(token, codec)
        if not data or len(data) < 3:
            return None
        lost = data.count(None)
        if lost == 0:
            try:
                out = bytes(data).decode()  # type: ignore[arg-type]
            except UnicodeDecodeError:
                if len(data) < 8:
                    return None
                out, complete, misfits = _viterbi_utf8(source, data)
                if complete < 4 * max(1, misfits):
                    return None
            return out if out != token and _sane(out) else None
        out, complete, misfits = _viterbi_utf8(source, data)
        return out if complete >= max(1, 2 * misfits) and complete >= lost / 2 and _sane(out) else None
    data = _to_bytes(token, codec)
    return None if data is None else _utf8_of(source, token, data)


def _utf8_of(source: Source, token: str, data: str) -> str | None:
    """The token decoded from its bytes (characters below 256, or lost) as UTF-8; null if they aren't."""
    if not _UTF8.search(data):
        return None
    if LOST in data:
        out, complete, misfits = _viterbi_utf8(source, [None if c == LOST else ord(c) for c in data])
        return out if complete > misfits else None
    # what isn't a sequence stays as it was; most of it must be one
    sequences = sum(m.end() - m.start() for m in _UTF8.finditer(data))
    if 2 * sequences <= sum(c > "\x7f" for c in data):
        return None
    pieces, at = [], 0
    for m in _UTF8.finditer(data):
        pieces += [token[at : m.start()], m.group().encode("latin_1").decode()]
        at = m.end()
    out = "".join([*pieces, token[at:]])
    return out if out != token else None


def _legacy_of(data: str, written: str) -> str | None:
    """Bytes (characters below 256) as text of another encoding than UTF-8; null if they aren't."""
    if written in SINGLE:
        return data.translate(_READ[written])
    try:
        return data.encode("latin_1").decode(written)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=1)
def _channels() -> tuple[tuple[str, str], ...]:
    """Pairs of wrong reading and right encoding."""
    utf8 = tuple((w, "utf_8") for w in (*SINGLE, *WIDE))
    return utf8 + tuple((r, w) for r in ("cp1252", "latin_1") for w in WRITTEN_WIDE) + tuple((r, w) for r in READ_AS for w in SINGLE if w != r)


#: Score that a passage must win per channel: text in UTF-8 leaves a pattern of bytes, other text doesn't.
_LEAST = {"utf_8": -1.0}
_LEGACY_LEAST, _LEGACY_MEAN = 10.0, 2.0


#: What each channel makes of a token and the score won, and a bound of what any channel can win (infinite if it was UTF-8).
Readings = tuple[dict[tuple[str, str], tuple[str, float]], float]


def _readings(source: Source, token: str) -> Readings:
    """What each channel makes of a token. Wrong readings that give the same bytes are decoded once."""
    if (held := source.shared.get(token) or source.cache.get(token)) is not None:
        return held
    own, odd = source.score(token), _odd(token)
    scores: dict[str, float] = {}
    won: dict[tuple[str, str], tuple[str, float]] = {}

    def note(channel: tuple[str, str], text: str) -> None:
        if text not in scores:
            scores[text] = (source.score(text) if not text.isascii() else own - 1) - own
        if scores[text] > (_LEAST["utf_8"] if channel[1] == "utf_8" else 0.0):
            won[channel] = text, scores[text]

    beyond = {c for c in token if c > "\x7f"}
    by_data: dict[str, list[str]] = {}
    for read in SINGLE:
        if beyond <= _CHARS[read]:
            by_data.setdefault(token.translate(_TABLES[read]), []).append(read)
    utf8 = [(read, _utf8_of(source, token, data)) for data, reads in by_data.items() if _UTF8.search(data) for read in reads]
    if _CJK.search(token):
        utf8 += [(read, _from_utf8(source, token, read)) for read in WIDE]
    for read, text in utf8:
        for _ in range(3):  # read wrongly more than once
            if text is None or LOST in text or (again := _from_utf8(source, text, read)) is None:
                break
            text = again
        if text is not None and _odd(text) <= odd:
            note((read, "utf_8"), text)
    for data, reads in by_data.items():
        for written in (*SINGLE, *WRITTEN_WIDE) if LOST not in data else ():
            own_reads = [r for r in reads if r in (READ_AS if written in SINGLE else ("cp1252", "latin_1")) and r != written]
            if own_reads and (text := _legacy_of(data, written)) is not None and text != token and _sane(text):
                for read in own_reads:
                    note((read, written), text)
    found = {c: won[c] for c in _channels() if c in won} if won else won
    bound = np.inf if any(c[1] == "utf_8" for c in found) else max((g for _, g in found.values()), default=0.0)
    if len(source.cache) > 100_000:
        source.cache.clear()
    source.cache[token] = found, bound
    return found, bound


def _restore_once(source: Source, line: str) -> tuple[str, tuple[str, str]] | None:
    """The line restored by the channel that wins most; null if none wins enough."""
    spans = [m.span() for m in _QUOTED.finditer(line)] if "`" in line else []
    tokens = [m for m in _TOKEN.finditer(line) if not any(a <= m.start() < b for a, b in spans)]
    if not tokens:
        return None
    readings = [_readings(source, m.group()) for m in tokens]
    weights = [max(1.0, len(m.group()) / 12) for m in tokens]  # text without spaces comes as few long tokens
    if sum(bound * weight for (_, bound), weight in zip(readings, weights)) < _LEGACY_LEAST:
        return None  # as for nearly all clean lines: no channel can win enough
    won: dict[tuple[str, str], list[float]] = {}
    for (found, _), weight in zip(readings, weights):
        for channel, (_, gain) in found.items():
            won.setdefault(channel, []).append(gain * weight)
    best, best_value = None, 0.0
    for channel, gains in won.items():
        total, n = sum(gains), len(gains)
        if channel[1] == "utf_8":
            value = total + 4.0 * n  # each well-formed sequence is evidence by itself
        else:
            value = total - 4.0 * (len(tokens) - n)
            if value < _LEGACY_LEAST or total / n < _LEGACY_MEAN or n < 0.6 * len(tokens):
                continue
        if value > best_value:
            best, best_value = channel, value
    if best is None:
        return None
    out, at = [], 0
    for m, (found, _) in zip(tokens, readings):
        out.append(line[at : m.start()])
        out.append(found.get(best, (m.group(), 0.0))[0])
        at = m.end()
    out.append(line[at:])
    return "".join(out), best


_LETTERS = "".join(sorted({c for codec in ("cp1252", "cp1250", "cp1254", "cp1257") for b in range(0x80, 0x100) if (c := bytes([b]).decode(codec, "ignore")) and (c.isalpha() or c in "‘’“”–—…€£¢§©®™°±µ·¹²³«»¡¿")}, reverse=True))
_HOLED = re.compile(r"[^\s!-&(-/:-@\[-`{-~]*�[^\s!-&(-/:-@\[-`{-~]*")


_BEYOND = np.array([c > "\x7f" for c in _LETTERS])


def _after(source: Source, last: str) -> np.ndarray:
    """Scores of all letters after a character."""
    if (held := source.cache.get((last, None))) is None:
        row = source.pairs[[_pair_slot(last, c) for c in _LETTERS]] if last else np.zeros(len(_LETTERS), np.float32)
        held = source.cache[(last, None)] = row if last > "\x7f" else np.where(_BEYOND, row, 0.0)
    return held


def _fill(source: Source, line: str) -> str:
    """The line with lost single characters filled in, where a known word fits."""
    def fill(m: re.Match[str]) -> str:
        word = m.group()
        if (held := source.cache.get((word,))) is not None:
            return held
        beam: list[tuple[float, str]] = [(0.0, "")]
        for i, c in enumerate(word):
            if c != LOST:
                beam = [(s + (source.pair(t[-1], c) if t and (c > "\x7f" or t[-1] > "\x7f") else 0.0), t + c) for s, t in beam]
                continue
            nxt = word[i + 1] if i + 1 < len(word) else ""
            before = np.array([0.5 * source.pair(o, nxt) for o in _LETTERS]) if nxt and nxt != LOST else 0.0
            grown = np.array([s for s, _ in beam])[:, None] + np.array([_after(source, t[-1:]) for _, t in beam]) + before
            best = np.argsort(-grown, axis=None, kind="stable")[:LETTER_BEAM]
            beam = [(float(grown.flat[k]), beam[k // len(_LETTERS)][1] + _LETTERS[k % len(_LETTERS)]) for k in best]
        best = max(beam, key=lambda b: (source.word(b[1]), b[0]))
        out = source.cache[(word,)] = best[1] if source.word(best[1]) > 0 else word
        return out

    return _HOLED.sub(fill, line)


def restore(source: Source, text: str | None) -> tuple[str | None, int, int, str]:
    """Restored text, number of garbled lines, number of those that stay damaged, channels found ('' if none)."""
    if not text or text.isascii():
        return text, 0, 0, ""
    out, at, garbled, damaged, used = [], 0, 0, 0, []
    for m in _LINE.finditer(text):
        line = m.group()
        if line.isascii():
            continue
        new, found = line, False
        for _ in range(4):
            step = _restore_once(source, new)
            if step is None:
                break
            new, found = step[0], True
            used.append(f"{step[1][1]} as {step[1][0]}")
        if LOST in _unquoted(new):
            found = True
            new = _fill(source, new)
        if found:
            garbled += 1
            damaged += LOST in new
            out += [text[at : m.start()], new]
            at = m.end()
    out.append(text[at:])
    return "".join(out), garbled, damaged, ", ".join(sorted(set(used)))


_DDL = "restored string, garbled_lines int, damaged_lines int, channels string"


def garbled_documents(documents: DataFrame, source: Source | None = None) -> DataFrame:
    """doc_id, restored, garbled_lines, damaged_lines, channels of the documents with a garbled passage.

    Null and empty texts, plain ASCII, control codes and what is quoted between backticks are no
    cases. Lost characters that no known word explains stay U+FFFD and count as damaged.
    """
    source = source or train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *restore(source, t)) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            rows = [r for r in rows if r[2]]
            if rows:
                types = (batch.schema.field("doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "restored", "garbled_lines", "damaged_lines", "channels"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_DDL}")


#: Known ways of garbling (written in, read as), by which restoring is measured.
KNOWN = (("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "mac_roman"), ("utf_8", "cp1251"), ("utf_8", "gbk"), ("utf_8", "cp932"), ("cp1251", "latin_1"), ("cp1252", "utf_8"), ("iso8859_2", "cp1252"), ("euc_jp", "latin_1"))
_MEASURE_DDL = "channel string, found int, exact int, lines int, exact_lines int"


def measured_restoration(documents: DataFrame, source: Source | None = None) -> DataFrame:
    """channel, n_docs, n_found, n_exact, n_lines, n_exact_lines: clean documents garbled in known ways, and what restoring makes of them.

    Each clean document with a character beyond ASCII takes one of KNOWN by its doc_id; what the encoding
    can't hold leaves it out. Lines are those with a character beyond ASCII. Bytes that the reading has no
    character for are lost, so that not all can come back.
    """
    source = source or train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text or text.isascii() or restore(source, text)[1]:
                    continue
                written, read = KNOWN[(i or 0) % len(KNOWN)]
                try:
                    bad = text.encode(written).decode(read, "replace")
                except UnicodeEncodeError:
                    continue
                if bad != text:
                    back, found, _, _ = restore(source, bad)
                    lines = [x for x in text.split("\n") if not x.isascii()]
                    held = Counter((back or "").split("\n"))
                    rows.append((f"{written} as {read}", int(found > 0), int(back == text), len(lines), sum((Counter(lines) & held).values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int32()] * 4))], ["channel", "found", "exact", "lines", "exact_lines"])

    per = documents.select("doc_id", "text").mapInArrow(run, _MEASURE_DDL)
    return per.groupBy("channel").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("found").alias("n_found"), F.sum("exact").alias("n_exact"), F.sum("lines").alias("n_lines"), F.sum("exact_lines").alias("n_exact_lines"))
