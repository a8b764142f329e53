"""Personal data: patterns, and information-theoretic sanitisation around them.

Patterns find the protected entities: e-mail addresses, IP addresses, card and
phone numbers.  A term near an entity may reveal it although it matches no
pattern.  How much it does is estimated from the corpus: with n documents, n_c
of which hold entity c, n_t term t, and n_ct both, t near c,

    IC(c) = log2(n / n_c)                 what c's disclosure would tell
    PMI(c; t) = log2(n n_ct / (n_c n_t))  how much of it t tells

and PMI / IC, at most 1, is the share of c that t discloses.  Terms above one
threshold are generalised, above a higher one removed, where they stand near
the entity; a share estimated from a single document means nothing, so a
least support is asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Workspace, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")
WINDOW = 8  # terms on each side of an entity
SUPPORT = 2  # documents that hold both
GENERALISE, REMOVE = 0.6, 0.9  # shares of an entity's information
SALTS = 16
COUNTED_WORDS = 1 << 18  # of a task, between two of its partial counts

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Possessive, and starting where a run of digits does: the same matches as the
# plain patterns, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NOT_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        end = at + 1
        domain = _DOMAIN(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = end = domain.end()
                yield start, end
        at = text.find("@", end)


def _digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def find_base(text: str | None) -> list[tuple[int, int, int]]:
    """Kind (its place in ``BASE``), start and end of each pattern's matches,
    by kind, then start.  Matches that fail their check are dropped."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP(text) if _is_ip(m.group())]
    out += [(2, *m.span()) for m in _CARD(text) if m.end() - m.start() >= 16 and _is_card(m.group())]
    out += [(3, *m.span()) for m in _PHONE(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def entity(text: str, span: tuple[int, int, int]) -> str:
    """An entity's kind and value, however it is written."""
    kind, start, end = span
    value = text[start:end]
    return f"{BASE[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def near_terms(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """Entity, term (lower case), start and end of each term that stands at
    most ``window`` terms from an entity; terms inside spans aren't counted."""
    if not spans:
        return []
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    opens = [a for a, _ in covered]
    terms = []
    for m in _TERM.finditer(text):
        k = bisect_left(opens, m.end()) - 1  # the last span that opens before the term ends
        if k < 0 or covered[k][1] <= m.start():
            terms.append(m.span())
    starts = [a for a, _ in terms]
    out = []
    for span in spans:
        name = entity(text, span)
        left, right = bisect_left(starts, span[1]), bisect_left(starts, span[2])
        for a, b in (*terms[max(0, left - window):left], *terms[right:right + window]):
            out.append((name, text[a:b].lower(), a, b))
    return out


def _found(docs: DataFrame, id_col: str, text_col: str, window: int, work: Workspace, with_text: bool) -> DataFrame:
    """Row number, id, base spans, near terms (and the text) of each row,
    written once, so that row numbers stay."""
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    term = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans, terms = [], []
            for text in batch.column("text").to_pylist():
                base = find_base(text)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                terms.append([dict(zip(("entity", "term", "start", "end"), t)) for t in near_terms(text, base, window)]
                             if base else [])
            columns = [pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column("doc_id"),
                       pa.array(spans, pa.list_(span)), pa.array(terms, pa.list_(term))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("text")] if with_text else [])],
                                             names=["row", "doc_id", "base", "near", "text"][:4 + with_text])

    schema = (f"row long, doc_id {source.schema['doc_id'].dataType.simpleString()}, "
              "base array<struct<kind:int,start:int,end:int>>, "
              "near array<struct<entity:string,term:string,start:int,end:int>>" + ", text string" * with_text)
    return work.stage(source.mapInArrow(run, schema), "found")


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, documents``: how many rows hold each term.  Tasks count their
    own rows first."""
    source = docs.select(quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["term", "documents"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update({t.lower() for t in set(_TERM.findall(text or ""))})
                if len(counts) >= COUNTED_WORDS:
                    yield counted()
        yield counted()

    return (source.mapInArrow(run, "term string, documents long")
            .groupBy("term").agg(F.sum("documents").alias("documents")))


def disclosures(docs: DataFrame, found: DataFrame, text_col: str, support: int, generalise: float,
                remove: float) -> DataFrame:
    """``entity, term, share, action`` of the terms to be generalised
    (action 4) or removed (5) near the entity."""
    entities = found.filter(F.size("near") > 0).select("row", F.explode("near").alias("t")).select(
        "row", "t.entity", "t.term")
    both = entities.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).filter(
        F.col("n_ct") >= support)
    holders = (found.filter(F.size("near") > 0).select(F.explode(F.array_distinct(F.col("near.entity"))).alias("entity"))
               .groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")))
    rows = found.count()
    counts = document_counts(docs, text_col)
    joint = both.join(holders, "entity").join(counts, "term")
    told = F.log2(F.lit(float(rows)) * F.col("n_ct") / (F.col("n_c") * F.col("documents")))
    share = told / F.log2(F.lit(float(rows)) / F.col("n_c"))
    return (joint.filter(F.col("n_c") < rows).withColumn("share", share).filter(F.col("share") >= generalise)
            .select("entity", "term", "share",
                    F.when(F.col("share") >= remove, 5).otherwise(4).alias("action")))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE,
                 with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, base`` (spans of the patterns) and
    ``added`` (spans of the sanitisation), arrays of ``kind, start, end`` with
    kinds by number in ``KINDS`` and code points, end exclusive; ``with_text``
    adds the text.

    Null texts count as empty.  Every row counts as a document, repeated rows
    and null ids too.  An entity that all rows hold tells nothing.  Texts
    without an entity get no span.  An empty table gives no rows; other
    columns are ignored.
    """
    ship_package(docs.sparkSession)
    work = Workspace(docs.sparkSession, "private")
    found = _found(docs, id_col, text_col, window, work, with_text)
    risky = work.stage(disclosures(docs, found, text_col, support, generalise, remove), "disclosures")
    # An entity may stand in any share of the rows: its terms' rows are dealt
    # over several keys.
    near = found.filter(F.size("near") > 0).select("row", F.explode("near").alias("t")).select(
        "row", "t.*", (F.col("row") % SALTS).alias("salt"))
    salted = risky.select("entity", "term", "action", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    hits = (near.join(salted, ["entity", "term", "salt"]).groupBy("row", "start", "end")
            .agg(F.max("action").alias("kind"))
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.join(hits, "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added"), *(["text"] if with_text else []))


def _written(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans``; the digest is of the base spans, written as
    ``kind:start:end`` and joined by commas, ``spans`` all spans written so.
    Cases as in :func:`find_private`; without spans both texts are empty.
    """
    found = find_private(docs, id_col, text_col, **options)

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind]}")

    counts = map(count, range(len(BASE)))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.concat("base", "added")).alias("spans"))


def general(term: str) -> str:
    """What a generalised term is replaced by: its class."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span's replacement: the entity's kind, a term's
    class, or nothing.  Of overlapping spans the first (then the longest)
    counts, over the length of all."""
    merged: list[list[int]] = []
    for start, end, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1], s[2])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += text[at:start], (f"[{BASE[kind].upper()}]" if kind < 4 else general(text[start:end]) if kind == 4 else "")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, text, n_replaced long`` with every span
    of :func:`find_private` replaced.  Null texts stay null."""
    found = find_private(docs, id_col, text_col, with_text=True, **options)
    merged = found.select("doc_id", "text", F.concat("base", "added").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t and replaced(t, s) for t, s in zip(texts, spans)], pa.string()),
                 pa.array(map(len, spans), pa.int64())], names=["doc_id", "text", "n_replaced"])

    return merged.mapInArrow(run, f"doc_id {merged.schema['doc_id'].dataType.simpleString()}, text string, n_replaced long")
