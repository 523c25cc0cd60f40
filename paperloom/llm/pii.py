"""PII surrogates: keyed, type-consistent replacements with collision checks.

A detected entity's canonical form is its letters and digits in lower case, so spellings that differ in
case, spaces or punctuation are one entity and get one surrogate, everywhere.  A surrogate is drawn by a
keyed hash with the same length, script, kind of character at each place and, for names, gender; it is
put into the mention's own format.  No two entities may share a surrogate, nor may a surrogate be an entity
of the corpus: those that would are drawn again until none does.  Only the redrawn ones need a table, which
reaches the texts by a join; all others are computed where the text is.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_safe, release

# Patterns by kind, in the order in which they claim text, and honorifics by gender.
EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)", re.ASCII)
CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)", re.ASCII)
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)", re.ASCII)
SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", re.ASCII)
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Sra", "Srta", "Señora", "Господжа", "Госпожа", "Κυρία")
KINDS = ("email", "ip", "card", "phone", "ssn", "name_m", "name_f", "surname")
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
FEMALE_END = {"latin": "a", "cyrillic": "а", "greek": "α"}

_TITLE = re.compile(rf"\b(?:({'|'.join(MALE)})|({'|'.join(FEMALE)}))\.?[  ]+")
_TITLE_HINTS = tuple(x[:3] for x in MALE + FEMALE)
_TITLES = frozenset(MALE + FEMALE)
_NAME = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_POSSESSIVE = ("'s", "’s", "'S", "’S")
_GAP = re.compile("[ \u00a0]+")
_INITIAL_GAP = re.compile("(?:\\.[ \u00a0]*|[ \u00a0]+)")


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int
    end: int
    canonical: str


def canonical(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text if c.isalnum())


def _name_at(text: str, at: int) -> re.Match | None:
    """The capitalized name at a place, without the ending of a possessive."""
    n = _NAME.match(text, at)
    if n and n.group()[-2:] in _POSSESSIVE:
        n = _NAME.match(text, at, n.end() - 2)
    return n if n and n.group()[0].isupper() else None


def _named(text: str) -> list[Mention]:
    """Names after titles, and the other mentions of the same names in the text.

    All capitalized words after a title are its name, initials with dots among them; the last is the surname,
    unless it stands alone and is a given name elsewhere in the text.
    """
    titled: list[tuple[str, list[re.Match]]] = []
    for m in _TITLE.finditer(text):
        parts, at = [], m.end()
        while (n := _name_at(text, at)) and n.group() not in _TITLES:
            parts.append(n)
            gap = (_INITIAL_GAP if len(n.group()) == 1 else _GAP).match(text, n.end())
            if not gap:
                break
            at = gap.end()
        if parts:
            titled.append(("name_m" if m.group(1) else "name_f", parts))
    given = {(kind, canonical(n.group())) for kind, parts in titled for n in parts[:-1]}
    found = []
    for kind, parts in titled:
        alone = len(parts) == 1 and (kind, canonical(parts[0].group())) in given
        found += [Mention(kind if n is not parts[-1] or alone else "surname", *n.span(), canonical(n.group())) for n in parts]
    kinds: dict[str, str] = {}
    for x in found:
        kinds[x.canonical] = "surname" if "surname" in (x.kind, kinds.get(x.canonical)) else kinds.get(x.canonical, x.kind)
    known = {x.start for x in found}
    for m in _NAME.finditer(text) if found else ():
        if m.start() in known:
            continue
        n = _name_at(text, m.start())
        whole = n and canonical(n.group()) in kinds
        for start, end in [n.span()] if whole else [x.span() for x in _LETTERS.finditer(text, *m.span())]:
            name = canonical(text[start:end])
            # A single letter is a name only where a dot makes it an initial.
            if text[start].isupper() and name in kinds and (end - start > 1 or text[end : end + 1] == "."):
                found.append(Mention(kinds[name], start, end, name))
    return found


def mentions(text: str) -> list[Mention]:
    """Entities of a text from left to right, none overlapping; earlier kinds claim first."""
    found: list[Mention] = []
    if "@" in text:
        # The whole address, marks included, is the entity: a.b@c.d is not ab@c.d.
        found += [Mention("email", *m.span(), m.group().lower()) for m in EMAIL.finditer(text)]
    if re.search(r"\d", text, re.ASCII):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE), ("ssn", SSN)):
            # An address keeps its dots: 1.23.4.5 is not 12.3.4.5.
            found += [Mention(kind, *m.span(), m.group() if kind == "ip" else canonical(m.group())) for m in pattern.finditer(text)]
    if any(h in text for h in _TITLE_HINTS):
        found += _named(text)
    order = {k: i for i, k in enumerate(KINDS)}
    taken: list[Mention] = []
    for x in sorted(found, key=lambda x: (order[x.kind], x.start)):
        if x.canonical and all(x.end <= y.start or x.start >= y.end for y in taken):
            taken.append(x)
    return sorted(taken, key=lambda x: x.start)


def _stream(key: bytes, kind: str, entity: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{entity}\0{attempt}\0{block}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest()
        block += 1


def _pick(draw: Iterator[int], choices: str) -> str:
    # Two bytes keep the lean towards early choices under one in a thousand.
    return choices[(next(draw) << 8 | next(draw)) % len(choices)]


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def surrogate(kind: str, entity: str, attempt: int, key: bytes, extra: int = 0) -> str:
    """The canonical surrogate of a canonical entity, of the same length; another one per attempt.

    With ``extra`` it is that much longer, and an address may have octets of any length.
    """
    draw = _stream(key, kind, entity, attempt)
    digits = "0123456789"
    if kind == "ip" and extra:
        return ".".join(str((next(draw) << 8 | next(draw)) % 256) for _ in range(4))
    if kind == "email" and extra:
        entity = "a" * extra + entity
    elif extra:
        entity += entity[-1] * extra
    if kind == "ip":
        octets = []
        for octet in entity.split("."):
            low, high = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(octet.lstrip("0") or "0")]
            octets.append(str(low + (next(draw) << 8 | next(draw)) % (high - low + 1)).zfill(len(octet)))
        return ".".join(octets)
    if kind in ("card", "phone", "ssn"):
        # A card keeps its issuer's digit and whether its check digit holds, a phone number its first digit.
        kept = 1 if kind in ("card", "phone") else 0
        out = entity[:kept] + "".join(_pick(draw, digits) for _ in entity[kept:])
        if kind == "card" and _luhn(entity) != _luhn(out):
            valid = next(out[:-1] + d for d in digits if _luhn(out[:-1] + d))
            out = valid if _luhn(entity) else out[:-1] + _pick(draw, digits.replace(valid[-1], ""))
        return out
    if kind == "email":
        local, _, domain = entity.partition("@")
        top = domain.rpartition(".")[2]
        places = _stream(key, "domain", domain, 0)  # one company, one surrogate domain
        return f"{_same_shape(local, draw)}@{_same_shape(domain[: -len(top) - 1], places)}.{top}"
    out = ""
    for i, c in enumerate(entity):
        s = _script(c)
        if c.isdigit():
            out += _pick(draw, digits)
        elif i == len(entity) - 1 and kind != "surname":
            out += FEMALE_END[s] if kind == "name_f" else _pick(draw, CONSONANTS[s])
        else:
            out += _pick(draw, (CONSONANTS if i % 2 == 0 else VOWELS)[s])
    return out


def _same_shape(text: str, draw: Iterator[int]) -> str:
    return "".join(_pick(draw, "0123456789") if c.isdigit() else _pick(draw, "abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in text)


def rendered(mention: str, replacement: str) -> str:
    """The canonical replacement in the format and case of the mention."""
    if len(mention) == len(replacement):
        pairs = zip(mention, replacement, strict=True)
        return "".join((n.upper() if m.isupper() else n) if m.isalnum() else m for m, n in pairs)
    if len(mention.split(".")) == len(replacement.split(".")) == 4 and replacement.replace(".", "").isdigit():
        return replacement
    if "@" in replacement:
        local, _, domain = replacement.rpartition("@")
        old = mention.rpartition("@")[2]
        return f"{local}@{rendered(old, domain)}" if len(old) == len(domain) else replacement
    # A longer replacement goes on where the mention ends, in the case of its last letters.
    letters = iter(replacement)
    out = "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(letters, "")) is not None else c for c in mention)
    rest = "".join(letters)
    return out + (rest.upper() if len(mention) > 1 and mention.isupper() else rest)


def extra_length(attempt: int, rounds: int) -> int:
    """How much longer than its entity a surrogate of an attempt is: not at all in the first ``rounds``."""
    return max(0, attempt - rounds + 1)


def replaced(text: str, attempts: dict, key: bytes, rounds: int = 40) -> tuple[str, dict]:
    """The text with surrogates, and how many mentions of each kind it had."""
    out, at, counts = [], 0, dict.fromkeys(KINDS, 0)
    for m in mentions(text):
        counts[m.kind] += 1
        attempt = attempts.get(_hidden(key, m.kind, m.canonical), 0) if attempts else 0
        new = surrogate(m.kind, m.canonical, attempt, key, extra_length(attempt, rounds))
        out += [text[at : m.start], rendered(text[m.start : m.end], new)]
        at = m.end
    return "".join([*out, text[at:]]), counts


def entities_of(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, entity), distinct in each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in sorted({(m.kind, m.canonical) for m in mentions(t.as_py() or "")})]
            ids, kinds, names = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["doc_id", "kind", "entity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, kind string, entity string")


def _drawn(entities: DataFrame, key: bytes, rounds: int) -> DataFrame:
    """(kind, entity, attempt) with its surrogate."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, e, a, key, extra_length(a, rounds)) for k, e, a in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    return entities.select("kind", "entity", "attempt").mapInArrow(scan, "kind string, entity string, attempt int, surrogate string")


def resolved(entities: DataFrame, key: bytes, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """Distinct (kind, entity) -> the accepted (kind, entity, attempt, surrogate) by round, and those left
    over (none).

    In a round, a surrogate is accepted if it is no entity of its kind, was not accepted before, and its
    entity is the least of those that drew it.  After ``rounds`` the shapes of what is pending are used up,
    or nearly so: surrogates grow by a character a round, until every entity has its own.
    """
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    pending, accepted = entities.withColumn("attempt", F.lit(0)), []
    for attempt in itertools.count():
        drawn = materialize(_drawn(pending, key, rounds), "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(real, ["kind", "surrogate"], "left_anti")
        if accepted:
            free = free.join(reduce(DataFrame.unionByName, accepted).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(free.select("kind", "entity", F.lit(attempt).alias("attempt"), "surrogate"), "pii-won")
        accepted.append(won)
        before, pending = pending, materialize(drawn.select("kind", "entity").join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").withColumn("attempt", F.lit(attempt + 1)), "pii-pending")
        release(drawn, before)
        if pending.isEmpty():
            break
    return accepted, pending


def _hidden(key: bytes, kind: str, entity: str) -> str:
    """What stands for an entity in a table: its keyed digest."""
    return hashlib.sha256(key.hex().encode() + f"{kind}\0{entity}".encode("utf-8", "surrogatepass")).hexdigest()


def surrogate_pii(docs: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """documents -> doc_id, text (with surrogates; null stays null), n_<kind>..., n_replaced.

    One row per input row, whose other columns are ignored; an empty table gives an empty result.  Texts
    without entities are unchanged.  Entities of a kind and shape with so few values that no free one was
    found in ``rounds`` draws (such as every one-digit address) get a longer surrogate.  Tables with entities
    in clear are deleted before the result is returned; what stays holds keyed digests.  Very long texts are
    held one at a time.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(entities_of(base), "pii-found")
    entities = materialize(found.select("kind", "entity").distinct(), "pii-entities")
    accepted, pending = resolved(entities, secret, rounds)
    again = reduce(DataFrame.unionByName, accepted).filter("attempt > 0")
    redrawn = materialize(again.select("kind", "entity", "attempt").unionByName(pending.select("kind", "entity", "attempt")), "pii-redrawn")
    # Bounded by the document's own entities; a table of known size, so the planner may broadcast it.
    digest = F.sha2(F.concat(F.lit(secret.hex()), F.concat_ws("\0", "kind", "entity")), 256)
    own = found.join(redrawn, ["kind", "entity"]).groupBy("doc_id").agg(F.collect_set(F.struct(digest.alias("digest"), "attempt")).alias("redrawn"))
    own = materialize(own, "pii-own")
    release(found, entities, redrawn, *accepted, pending)
    with_own = null_safe(base, own, ["doc_id"], "left").select("doc_id", "text", "redrawn")
    counts = ", ".join(f"n_{k} int" for k in KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, tallies = [], []
            for t, r in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                attempts = {x["digest"]: x["attempt"] for x in r or []}
                text, tally = replaced(t.as_py() or "", attempts, secret, rounds)
                texts.append(text if t.is_valid else None)
                tallies.append(tally)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), *(pa.array([x[k] for x in tallies], pa.int32()) for k in KINDS)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)]
            )

    out = with_own.mapInArrow(scan, f"doc_id long, text string, {counts}")
    return out.withColumn("n_replaced", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))


def collisions(docs: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, entity) of the entities without a surrogate of their own; there are none."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    entities = materialize(entities_of(docs).select("kind", "entity").distinct(), "pii-entities")
    return resolved(entities, secret, rounds)[1].select("kind", "entity")
