"""Personal data: exact patterns, and terms that disclose a protected entity.

The base kinds (email, ip, card, phone) follow fixed patterns.  On top, the corpus says which terms give an entity away.  For an entity ``e`` (one
address, one number, or a kind: any address, any number) and a term ``t``, ``P(e | t)`` is the share of the documents with ``t`` that hold ``e``
anywhere, and ``log2(P(e | t) / P(e))`` the bits about ``e`` that ``t`` discloses.  A term above the thresholds whose share is no chance result is
itself a span of kind ``term``: above ``remove_bits`` it is removed, else it is replaced by its kind.

Chance is bounded by Chernoff's bound on the binomial tail, times the number of pairs looked at.  It has no least number of texts, but one text alone is
no evidence, since every text has words of its own: an entity of a single text is covered by its kind, in the terms that it shares with others.

Only terms that can still pass are counted over the corpus: those that a part of the documents doesn't already have too often, then in one pass over all.  A bitmap of fixed size says which terms may be among them, their counts meet in one shuffle.
The terms that are flagged in the end are held ``BLOCK`` at a time, with another step over each text for each further block, so that memory is bounded and no term is left out.

Cases: null text counts as empty.  Long texts are read whole.  Repeated rows are answered each; in the bound on chance one text with an entity counts once.  An empty table
gives an empty result.  Other columns are kept by ``sanitize`` and ignored by ``find``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
BLOCK = 200_000
#: Bits of the bitmap of terms, and counts that a task holds before it passes them on.
BITS, HELD = 1 << 23, 200_000
#: One in so many documents is counted first.
PART = 16
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A term is a run of at least this many letters.
_TERM = re.compile(r"[^\W\d_]{3,}")
Span = tuple[str, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` once: the local part is the run before it, so that no start is tried twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        free = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            out.append((at - local, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Maximal dotted runs, four parts at a time."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((at, at + size))
                at += size + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) by kind as in ``KINDS``, then start; code points, end exclusive."""
    text = text or ""
    out: list[Span] = [("email", *x) for x in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *x) for x in _ips(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """What one protected entity is known by, however it is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def terms_of(text: str, spans: list[Span]) -> set[str]:
    """Terms of a text outside its base spans."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            parts.append(text[at:start])
        at = max(at, end)
    return {t.lower() for t in set(_TERM.findall(" ".join([*parts, text[at:]])))}


CONTEXTS = "digest long, kinds array<string>, entities array<string>, terms array<string>"


def disclosing_terms(documents: DataFrame, least_share: float = 0.8, least_bits: float = 4.0, chance: float = 0.01) -> DataFrame:
    """(term, bits) of the terms whose disclosure exceeds the thresholds, one row a term, written to the shared folder.

    ``chance`` bounds the probability that any term passes whose documents hold entities no more often than others do.
    """

    def contexts(batches):
        for pdf in batches:
            rows = []
            for text in pdf.text:
                if spans := base_spans(text):
                    own = {entity(k, text[s:e]) for k, s, e in spans}
                    rows.append((xxhash.xxh3_64_intdigest(text) - (1 << 63), sorted({k for k, _, _ in spans}), sorted(own), sorted(terms_of(text, spans))))
            yield pd.DataFrame(rows, columns=["digest", "kinds", "entities", "terms"])

    found = documents.select("text").mapInPandas(contexts, CONTEXTS)
    texts = found.groupBy("digest").agg(F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("kinds", "entities", "terms")])
    texts = materialize(texts, "pii-contexts")
    counted = [F.sum("docs").alias("joint"), F.count("*").alias("texts")]
    kinds = texts.select(F.explode("kinds").alias("entity"), "docs", "terms")
    named = texts.select(F.explode("entities").alias("entity"), "digest")
    several = named.groupBy("entity").count().filter("count > 1").select("entity")
    named = named.join(several, "entity").join(texts.select("digest", "docs", "terms"), "digest").select("entity", "docs", "terms")
    # the empty term counts the documents of an entity
    every = [x.select("entity", "docs", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("entity", "term").agg(*counted) for x in (kinds, named)]
    pairs = materialize(every[0].unionByName(every[1]), "pii-pairs")
    entities = pairs.filter("term = ''").select("entity", F.col("joint").alias("entity_docs"))
    total, tested = documents.count(), pairs.filter("term <> ''").count()
    least_evidence = math.log2(max(tested, 1) / chance)
    rate = F.col("entity_docs") / F.lit(float(max(total, 1)))
    # evidence is highest where no other document has the term: what fails there fails everywhere
    pairs = materialize(pairs.filter("term <> ''").join(entities, "entity").filter(-F.col("texts") * F.log2(rate) >= least_evidence), "pii-candidates")
    # a term that part of the documents already has too often is out, whatever the others hold: what is left to count in all of them is little
    limits = pairs.groupBy("term").agg(F.max("joint").alias("most"))
    part = _document_counts(documents.filter(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), limits)
    left = limits.join(part, "term", "left").filter(F.coalesce("term_docs", F.lit(0)) * least_share <= F.col("most") * (1 + 1e-9))
    known = _document_counts(documents, materialize(left.select("term"), "pii-left"))
    share = F.col("joint") / F.greatest("term_docs", "joint")
    scored = pairs.join(known, "term").withColumns({"share": share, "bits": F.log2(share / rate), "evidence": _evidence(rate)})
    passed = scored.filter((F.col("share") >= least_share) & (F.col("bits") >= least_bits) & (F.col("evidence") >= least_evidence))
    return materialize(passed.groupBy("term").agg(F.max("bits").alias("bits")), "pii-terms")


def _evidence(rate: Column) -> Column:
    """Bits against chance: ``-log2`` of Chernoff's bound on the probability that, at this rate, so many of the texts with a term hold the entity.

    Texts with the entity count once, documents without it each: there are no more texts with the term than that.
    """
    others = F.greatest(F.col("term_docs") - F.col("joint"), F.lit(0))
    n = F.col("texts") + others
    inside = F.col("texts") * F.log2(F.col("texts") / n / rate)
    outside = F.when(others > 0, others * F.log2(others / n / F.greatest(1 - rate, F.lit(1e-300)))).otherwise(0.0)
    return F.when(F.col("texts") / n > rate, inside + outside).otherwise(0.0)


def _blocks(terms: DataFrame):
    """Broadcasts of ``BLOCK`` terms at most (by expectation), as {term: bits or 0}."""
    n = terms.count()
    parts = -(-n // BLOCK)
    bits = F.col("bits") if "bits" in terms.columns else F.lit(0.0)
    for i in range(parts):
        part = terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).select("term", bits.alias("bits")).toPandas()
        yield terms.sparkSession.sparkContext.broadcast(dict(zip(part.term, part.bits, strict=True)))


def _bitmap(terms: DataFrame) -> bytes:
    """A bit for each hash of a term, packed: a megabyte however many terms there are."""
    bit = terms.select((F.crc32(F.col("term").cast("binary")) % BITS).alias("bit"))
    words = bit.groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).collect()  # BITS / 32 rows at most
    out = np.zeros(BITS // 32, "<u4")
    for word, bits in words:
        out[word] = bits
    return out.tobytes()


def _document_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, term_docs) of terms that may be among ``terms``, all of these included: documents that hold the term outside base spans."""
    packed = terms.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def frame(seen: Counter):
        return pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "n": list(seen.values())}).astype({"n": "int64"})

    def count(batches):
        wanted = np.unpackbits(np.frombuffer(packed.value, np.uint8), bitorder="little").tobytes()
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf.text:
                if text:
                    seen.update([t for t in terms_of(text, base_spans(text)) if wanted[zlib.crc32(t.encode("utf-8", "surrogatepass")) % BITS]])
                if len(seen) > HELD:
                    yield frame(seen)
                    seen.clear()
        yield frame(seen)

    return materialize(documents.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("term_docs")), "pii-counts")


def term_spans(text: str, terms: dict[str, float], taken: list[Span]) -> list[tuple[str, int, int, float]]:
    """Spans of flagged terms that overlap no base span, with their bits."""
    if not terms or terms.keys().isdisjoint({t.lower() for t in set(_TERM.findall(text))}):
        return []
    hit = [(m.start(), m.end(), terms[w]) for m in _TERM.finditer(text) if (w := m[0].lower()) in terms]
    return [("term", s, e, b) for s, e, b in hit if all(e <= x or y <= s for _, x, y in taken)]


SPANS = "array<struct<kind:string,start:int,end:int,bits:double>>"


def find(documents: DataFrame, terms: DataFrame | None = None, **thresholds) -> DataFrame:
    """``documents`` with ``pii``: spans by kind as listed (``term`` last), then start."""
    terms = disclosing_terms(documents, **thresholds) if terms is None else terms
    first, *others = list(_blocks(terms)) or [None]

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "bits"), x, strict=True)) for x in all_spans(t, first)] for t in texts], dtype=object)

    out = small_batches(documents).withColumn("pii", found("text"))
    for block in others:
        out = out.withColumn("pii", _flagger(block)("text", "pii"))
    return out


def all_spans(text: str | None, block) -> list[tuple[str, int, int, float | None]]:
    """Base spans, then those of the terms of a block."""
    base = base_spans(text)
    return [(*x, None) for x in base] + (term_spans(text or "", block.value, base) if block is not None else [])


def _flagger(block):
    """Adds the spans of one more block of terms to those found so far."""

    @F.pandas_udf(SPANS)
    def flagged(texts: pd.Series, spans: pd.Series) -> pd.Series:
        found = []
        for t, own in zip(texts, spans, strict=True):
            base, terms = [x for x in own if x["kind"] != "term"], [x for x in own if x["kind"] == "term"]
            taken = [(x["kind"], x["start"], x["end"]) for x in base]
            terms += [{"kind": k, "start": s, "end": e, "bits": b} for k, s, e, b in term_spans(t or "", block.value, taken)]
            found.append(base + sorted(terms, key=lambda x: x["start"]))
        return pd.Series(found, dtype=object)

    return flagged


def replaced(text: str | None, spans, remove_bits: float) -> str | None:
    """The text with every span (kind, start, end, bits) as its kind in brackets, terms of ``remove_bits`` or more removed."""
    if text is None or not len(spans):
        return text
    parts, at = [], 0
    for kind, start, end, bits in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], "" if kind == "term" and bits >= remove_bits else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitize(documents: DataFrame, remove_bits: float = 12.0, **thresholds) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets, terms of ``remove_bits`` or more removed, and ``n_chars`` anew."""
    terms = disclosing_terms(documents, **thresholds)
    blocks = list(_blocks(terms)) or [None]

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, all_spans(t, blocks[0]), remove_bits) for t in texts], dtype=object)

    @F.pandas_udf("string")
    def clean_found(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, [(x["kind"], x["start"], x["end"], x["bits"]) for x in found], remove_bits) for t, found in zip(texts, spans, strict=True)], dtype=object)

    if len(blocks) == 1:  # spans and text in one step
        out = small_batches(documents).withColumn("text", clean("text"))
    else:
        out = find(documents, terms).withColumn("text", clean_found("text", "pii")).drop("pii")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``find`` returns."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
