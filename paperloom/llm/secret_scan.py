"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Fixed patterns give the base spans.  Beyond them, a long string with letters and digits that follows a
sensitive word closely is a candidate.  Its novelty is the number of bytes that zstandard needs for it when
primed with a dictionary of identifiers and the text around it (without the string itself).  The dictionary
holds common identifiers and those that most documents of the corpus use.  What the
surroundings or known identifiers explain compresses well; a key does not, and is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HEX_RUN = b"0" * 24

CONTEXT = re.compile(r"pass(word|wd|phrase)?\b|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie", re.IGNORECASE | re.ASCII)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "session", "cookie")
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 9876543210 1234567890123456 0000000000000000 "
    "access_token refresh_token client_secret client_id api_key private_key public_key session_id user_name password "
    "authorization Bearer Basic application/json Content-Type X-Amz-Signature AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY "
    "your_api_key_here changeme example placeholder xxxxxxxxxxxxxxxx config settings default version localhost "
    "https://www.example.com/index.html getElementById toString2 utf8_general_ci sha256 base64 rsa2048 md5sum int64_t "
)

#: What may stand between strings that belong together: line breaks, dots, list separators.
ADJOINING = re.compile(r"""(?:[\s.,;|"'`\[\](){}]|\\[nrt])*""")

#: Words with underscores, inner capitals or digits, whole (Java syntax).
IDENTIFIER = "(?<![A-Za-z0-9_])(?:[A-Za-z]+(?:_[A-Za-z0-9]+)+|[A-Za-z]?[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Za-z]+[0-9]+[A-Za-z0-9]*)(?![A-Za-z0-9_])"

_TO_HEX_RUNS = bytes(0x30 if c in b"0123456789abcdef" else 0x20 for c in range(256))


@dataclass(frozen=True)
class NoveltyParams:
    """What makes a string a candidate, and a candidate a secret.  ``piece``, ``step`` and ``piece_ratio``:
    pieces of longer candidates, how far apart they start, and the novelty of one that is a secret.
    ``dictionary``: characters of the corpus's own identifiers that prime the measure."""

    shortest: int = 16
    dictionary: int = 8192
    reach: int = 48
    window: int = 1024
    ratio: float = 0.85
    piece: int = 32
    step: int = 8
    piece_ratio: float = 0.95


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in code points, end exclusive."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_TO_HEX_RUNS):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _bytes_needed(packer: zstandard.ZstdCompressor, data: bytes) -> int:
    return len(packer.compress(data)) - len(packer.compress(b""))


def identifiers(docs: DataFrame, p: NoveltyParams = NoveltyParams()) -> str:
    """The identifiers that most documents use, the most frequent last, up to ``p.dictionary`` characters.

    All documents are counted.  An identifier stands in two documents at least, and nothing that could be a
    candidate itself (long, with digits) is one: a key that is copied about stays novel."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0))).alias("word"))
    plain = (F.length("word") < p.shortest) | (~F.col("word").rlike("[0-9]") & (F.length("word") <= 64))
    counted = words.filter(plain).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # No more can fit: an identifier has two characters at least, and a space follows.
    found, room = [], p.dictionary
    for row in counted.orderBy(F.desc("n"), "word").limit(p.dictionary // 3).collect():
        room -= len(row.word) + 1
        if room < 0:
            break
        found.append(row.word)
    return "".join(f"{w} " for w in reversed(found))


def _primed(candidate: str, around: str, known: str = "") -> zstandard.ZstdCompressor:
    """A compressor that knows identifiers and the candidate's surroundings."""
    prime = (known + IDENTIFIERS + around.replace(candidate, " ")).encode("utf-8", "replace")
    raw = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False)


def novelty(candidate: str, around: str, known: str = "") -> float:
    """Marginal compressed bytes of the candidate per byte, given identifiers and its surroundings."""
    data = candidate.encode()
    return _bytes_needed(_primed(candidate, around, known), data) / len(data)


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def is_novel(candidate: str, around: str, p: NoveltyParams, known: str = "") -> bool:
    """Whether the candidate, or any piece of a longer one, is novel.

    The whole of a long candidate says little: a key behind a plain start is diluted, and the code lengths
    of random letters alone bring a thousand of them below ``ratio``.
    """
    if novelty(candidate, around, known) >= p.ratio:
        return True
    if len(candidate) <= p.piece:
        return False
    packer, last = _primed(candidate, around, known), len(candidate) - p.piece
    pieces = (candidate[i : i + p.piece] for i in (*range(0, last, p.step), last))
    return any(_mixed(x) and _bytes_needed(packer, x.encode()) >= p.piece_ratio * p.piece for x in pieces)


def _left_over(start: int, end: int, busy: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the busy stretches (by start) leave of start..end."""
    out, at = [], start
    for s, e in busy:
        if s > at:
            out.append((at, min(s, end)))
        at = max(at, e)
    return [*out, (at, end)] if at < end else out


def novel_spans(text: str, taken: list[tuple[str, int, int]], p: NoveltyParams = NoveltyParams(), known: str = "") -> list[tuple[str, int, int]]:
    """Spans that only the novelty measure finds.

    A sensitive word speaks for the next string and for those that adjoin it: lines of a key, parts between
    dots, members of a list.  Of a string that base spans cover in part, the rest is reported.
    """
    lowered = text.lower()
    if not any(w in lowered for w in CONTEXT_WORDS):
        return []
    busy = sorted((s, e, k) for k, s, e in taken)
    found, at = [], 0
    last = 0  # the end of what came before: one sensitive word speaks for the next string only
    spoken, spoken_end = False, 0  # whether a word speaks for the string before, and where that one ends
    carried = lambda start: spoken and spoken_end <= start and ADJOINING.fullmatch(text, spoken_end, start) is not None
    context = lambda start: carried(start) or CONTEXT.search(text, max(last, start - p.reach), start) is not None
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{p.shortest},}}|(?<=\n)[A-Za-z0-9+/=]+(?=\r?\n-----END )", text):
        start, end = m.span()
        while at < len(busy) and busy[at][1] <= start:
            s, e, kind = busy[at]
            spoken, spoken_end = kind == "assign" or context(s), max(e, spoken_end)
            last = max(last, e)
            at += 1
        over = []
        for s, e, _ in busy[at:]:
            if s >= end:
                break
            over.append((s, e))
        said = context(start)
        rest = _left_over(start, end, over)
        assigned = any(k == "assign" and s < end for s, _, k in busy[at : at + len(over)])
        s = m.group()
        tail = len(s) < p.shortest
        if tail or _mixed(s):
            if said and rest and not (tail and not carried(start)):
                around = text[max(0, start - p.window) : start] + " " + text[end : end + p.window]
                if assigned:
                    # What stands before an assignment is a name unless it is a candidate itself.
                    whole = [x for x in rest if x[1] - x[0] >= p.shortest]
                    found += [("novel", *x) for x in whole if _mixed(text[slice(*x)]) and is_novel(text[slice(*x)], around, p, known)]
                else:
                    left = "".join(text[slice(*x)] for x in rest)
                    if tail or is_novel(s, around, p, known) or (over and _mixed(left) and is_novel(left, around, p, known)):
                        found += [("novel", *x) for x in rest]
            last = end
        spoken, spoken_end = said or assigned, max([end, *(e for _, e in over)])
    return found


def all_spans(text: str, p: NoveltyParams = NoveltyParams(), known: str = "") -> list[tuple[str, int, int]]:
    """Base and novel spans by start, then kind."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + novel_spans(text, base, p, known), key=lambda x: (x[1], order[x[0]], x[2]))


SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, params: NoveltyParams = NoveltyParams()) -> DataFrame:
    """documents -> doc_id, spans (by start, then kind), one row per input row.

    A null text is empty and has no spans, as is an empty one; repeated rows repeat; an empty table gives
    an empty result; columns besides doc_id and text are ignored.  One document is held at a time, and long
    candidates are measured whole.
    """
    known = identifiers(docs, params)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t.as_py() or "", params, known)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SPANS)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with each stretch covered by spans replaced by the mask."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", params: NoveltyParams = NoveltyParams()) -> DataFrame:
    """The same rows and columns with all secrets in ``text`` replaced by ``mask``; null texts stay null."""
    place, known = docs.columns.index("text"), identifiers(docs, params)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(place):
                text = t.as_py()
                spans = all_spans(text, params, known) if text else []
                texts.append(redact(text, spans, mask) if spans else text)
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(clean, docs.schema)
