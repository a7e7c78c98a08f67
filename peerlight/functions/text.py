"""Cleaning of names, companies, representatives and URLs, as column expressions.

Unicode compatibility forms (NFKC) have no built-in function and come from an Arrow function over the standard library; plain ASCII
passes through it unchanged, so ``nfkc=False`` gives the same on such data and stays in the JVM.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens that relaxed names lose, in this order; company types; role words; damaged-scheme spellings.
RELAXED_TOKENS = ("就労継続支援b型事業所", "就労継続支援b型", "就労継続支援b", "事業所", "就労支援施設", "就労支援", "b型作業所", "作業所", "オフィス", "センター")
LEGAL_PREFIXES = ("株式会社", "有限会社", "合同会社", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "社会福祉法人", "医療法人", "学校法人", "宗教法人", "特定非営利活動法人")
LEGAL_SUFFIXES = ("株式会社", "合同会社", "一般社団法人", "一般財団法人", "社会福祉法人", "医療法人", "特定非営利活動法人", "npo法人")
ABBREVIATIONS = (("(㈱|\\(株\\)|（株）)", "株式会社"), ("(㈲|\\(有\\)|（有）)", "有限会社"), ("npo法人", "特定非営利活動法人"), ("(\\(一社\\)|（一社）)", "一般社団法人"), ("(\\(社福\\)|（社福）)", "社会福祉法人"))
ROLE_WORDS = ("代表取締役社長", "代表取締役会長", "代表取締役", "取締役社長", "代表社員", "代表理事", "理事長", "院長", "会長", "社長", "代表", "理事")
NOTE_WORDS = ("職場情報総合サイト", "geps")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def folded(c: Column, nfkc: bool = True) -> Column:
    return F.lower(_nfkc(c) if nfkc else c)


def without(c: Column, words: tuple[str, ...]) -> Column:
    """``c`` without each word, one after the other."""
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def strict_name(c: Column, nfkc: bool = True) -> Column:
    """Letters and digits only: no punctuation, symbols or space of any script."""
    return F.regexp_replace(folded(F.coalesce(c, F.lit("")), nfkc), "(?U)[\\p{P}\\p{S}\\s]", "")


def relaxed_name(c: Column, tokens: tuple[str, ...] = RELAXED_TOKENS, nfkc: bool = True) -> Column:
    return without(strict_name(c, nfkc), tokens)


def match_text(c: Column, nfkc: bool = True) -> Column:
    return F.regexp_replace(folded(F.coalesce(c, F.lit("")), nfkc), "(?U)[\\s・･（）()「」『』【】\\[\\]_/,.、。:：;；'\"!！?？\\-‐‑–—―－&＆+＋]", "")


def without_legal_suffix(c: Column, words: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    return F.trim(without(F.coalesce(c, F.lit("")), words))


def company_key(c: Column, abbreviations=ABBREVIATIONS, nfkc: bool = True) -> Column:
    """Normalised company name, null if blank."""
    out = F.trim(folded(c, nfkc))
    for pattern, full in abbreviations:
        out = F.regexp_replace(out, f"^{pattern}", full)
    out = F.regexp_replace(out, "[‐‑‒–—―ｰ－-]", "ー")
    return F.nullif(F.regexp_replace(out, "(?U)[・･·\\s]", ""), F.lit(""))


def company_base_key(key: Column, prefixes: tuple[str, ...] = LEGAL_PREFIXES) -> Column:
    """A company key without its legal prefix; the key itself if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(key, f"^(?:{'|'.join(prefixes)})", ""), F.lit("")), key)


def has_legal_prefix(key: Column, prefixes: tuple[str, ...] = LEGAL_PREFIXES) -> Column:
    return F.coalesce(key.rlike(f"^(?:{'|'.join(prefixes)})"), F.lit(False))


def representative(c: Column, roles: tuple[str, ...] = ROLE_WORDS, notes: tuple[str, ...] = NOTE_WORDS, nfkc: bool = True) -> dict[str, Column]:
    """raw, role, name and name_key of a representative: notes in brackets and leading role words are peeled off."""
    compact = F.trim(F.regexp_replace(_nfkc(c) if nfkc else c, "(?U)\\s+", " "))
    raw = F.nullif(F.regexp_replace(compact, f"(?i)\\s*[（(][^()（）]*({'|'.join(notes)})[^()（）]*[)）]\\s*$", ""), F.lit(""))
    # alternatives in list order, kept once chosen
    lead = f"^(?>[・･\\s]*(?>{'|'.join(roles)})[ :：・･]*)+"
    role = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(raw, f"({lead})", 1), "[・･:：]+", " ")), F.lit(""))
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(raw, lead, ""), "^[・･\\s]+", "")), F.lit(""))
    return {"raw": raw, "role": role, "name": name, "name_key": F.nullif(F.regexp_replace(F.lower(name), "(?U)[・･·\\s]", ""), F.lit(""))}


def unescaped(c: Column, every: bool = True) -> Column:
    """HTML entities resolved; with ``every=False`` only the common five, in the JVM."""
    if every:
        return _unescape(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_markup(c: Column, every: bool = True) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, "<[^>]+>", " "), every), "(?U)\\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_url(c: Column, every: bool = False) -> Column:
    """Absolute http(s) URL with a lower-case host and without query, fragment and trailing slash; null for anything else."""
    u = F.regexp_replace(F.trim(unescaped(c, every)), "[)\\]}>,.;、。）」』】]+$", "")
    for pattern, good in (("(?i)^h(?:xx|tt|yy)ps://", "https://"), ("(?i)^h(?:xx|tt|yy)p://", "http://"), ("(?i)^https//", "https://"), ("(?i)^http//", "http://"), ("^//", "https://"), ("(?i)^www\\.", "https://www.")):
        u = F.regexp_replace(u, pattern, good)
    shape = "^(https?)://([^/?#\\s]+)([^?#\\s]*)"

    def parts(x: Column) -> Column:
        host = F.regexp_extract(x, shape, 2)
        path = F.regexp_replace(F.regexp_extract(x, shape, 3), "/+$", "")
        return F.when(host != "", F.concat(F.regexp_extract(x, shape, 1), F.lit("://"), F.lower(host), path))

    return let(u, parts)


def url_host(canonical: Column) -> Column:
    return F.nullif(F.regexp_extract(canonical, "^https?://([^/:]+)", 1), F.lit(""))


def url_path(canonical: Column) -> Column:
    return F.regexp_extract(canonical, "^https?://[^/]+(/.*)?$", 1)


RESERVED_SEGMENTS = ("p", "reel", "reels", "stories", "explore", "tv")


def profile_url(canonical: Column, hosts: tuple[str, ...] = ("instagram.com", "www.instagram.com", "m.instagram.com"), reserved: tuple[str, ...] = RESERVED_SEGMENTS, base: str = "https://www.instagram.com/") -> Column:
    """Profile page out of any page of a profile host: its first path segment, unless that is reserved."""
    first = F.regexp_extract(url_path(canonical), "^/([^/]+)", 1)
    good = url_host(canonical).isin(*hosts) & (first != "") & ~F.lower(first).isin(*reserved)
    return F.when(good, F.concat(F.lit(base), first, F.lit("/")))
