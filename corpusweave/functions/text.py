"""Column functions on text, identifiers and links."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Fixed value: a name in source code.
TOKEN = r"[A-Za-z_][A-Za-z0-9_'.]*"


def search_text(value: str) -> str:
    """Compatibility decomposition without accents, in lower case, pi spelled out (F1)."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not "̀" <= c <= "ͯ")
    return flat.lower().replace("π", "pi")


def ascii_words(value: str) -> str:
    """Lower-case ASCII letters and digits after decomposition, one blank between words (F2)."""
    flat = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
    return " ".join(re.findall("[a-z0-9]+", flat))


@F.pandas_udf(StringType())
def search_normalize(s: pd.Series) -> pd.Series:
    return s.map(search_text, na_action="ignore")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_markup(c: Column) -> Column:
    """Tags out, backquotes around mathematics out, white space joined, trimmed; entities need ``unescape`` besides."""
    x = F.replace(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("$`"), F.lit("$")), F.lit("`$"), F.lit("$"))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def markup_text(c: Column) -> Column:
    """The whole clean: tags out, entities as characters, then as ``clean_markup``."""
    return clean_markup(unescape(F.regexp_replace(c, "<[^>]+>", "")))


def citation_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits, one blank between words (F2 on ASCII text)."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def join_fields(*fields: Column) -> Column:
    """Non-blank fields, trimmed, a blank line between them."""
    return F.array_join(F.filter(F.transform(F.array(*fields), F.trim), lambda x: x != ""), "\n\n")


def canonical_doi(c: Column) -> Column:
    """Decoded, lower case, without closing punctuation and one leading resolver of each kind."""
    x = F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)))
    x = F.regexp_replace(x, r"[.,;\"}’]+$", "")
    for prefix in ("https://doi.org/", "http://dx.doi.org/", "doi:"):
        x = F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)
    return F.trim(x)


def doi(value: str) -> str:
    x = unquote(value or "").strip().lower().rstrip(".,;\"}’")
    for prefix in ("https://doi.org/", "http://dx.doi.org/", "doi:"):
        x = x.removeprefix(prefix)
    return x.strip()


_ARXIV = r"(?i)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?"


def arxiv_id(c: Column) -> Column:
    """New- or old-style identifier without its version, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(c, _ARXIV, 1))


def arxiv(value: str) -> str:
    m = re.search(_ARXIV, value or "")
    return m[1].lower() if m else ""


def surname(c: Column) -> Column:
    """Of the first author the last word of two letters or more, before a comma if there is one (F6 on ASCII text)."""
    first = F.element_at(F.split(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\s+and\s+|;"), 1), ","), 1)
    words = F.filter(F.regexp_extract_all(F.lower(first), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def year(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:18|19|20)\d\d)", 1)


def padded_id(c: Column, width: int = 3) -> Column:
    """Zeros before short ids; longer ones stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def whole_word(c: Column, word: str) -> Column:
    return c.rlike(f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def once(value: Column, body) -> Column:
    """``body(value)``; the value is made once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_windows(c: Column, size: int = 1024, overlap: int = 96) -> Column:
    """Windows of words; empty text has one empty window, and the last may lie within the one before (V7)."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(1)) - 1, F.lit(size - overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return once(words, cut)


def title_terms(c: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), F.lit(0))), F.array(*map(F.lit, stop)))


def glossary(c: Column, terms: tuple[str, ...], names: dict[str, str] | None = None, most: int = 7) -> Column:
    """Of the terms found in a text, in the order of the list, the first ``most``, under the name they are shown by."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = F.array_compact(F.array(*(F.when(low.contains(t), (names or {}).get(t, t)) for t in terms)))
    return F.slice(hits, 1, most)


def first_rule(c: Column, rules: tuple[tuple[tuple[str, ...], str], ...], default: str) -> Column:
    """The name of the first rule one of whose words is in the lower-cased text (P5)."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(default)
    for words, name in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit |= low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def valid_request(texts: Column, most: int = 32, each: int = 2048, total: int = 16000) -> Column:
    """1 to 32 non-blank texts, none and all together too long."""
    return ((F.size(texts) >= 1) & (F.size(texts) <= most) & F.forall(texts, lambda t: (F.trim(t) != "") & (F.length(t) <= each))
            & (F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t)) <= total))


def ramp(delta: Column, extent: float, low: tuple[int, int, int], mid: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Colour of a difference: from the middle towards one end, clamped (P10)."""
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), delta / extent))
    part = lambda m, lo, hi: F.lpad(F.hex(F.floor(m + (F.when(t < 0, F.lit(lo)).otherwise(F.lit(hi)) - m) * F.abs(t) + 0.5)), 2, "0")
    return F.lower(F.concat(F.lit("#"), *(part(m, lo, hi) for m, lo, hi in zip(mid, low, high, strict=True))))


def escape_markup(c: Column) -> Column:
    """The five characters that markup reserves, as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def encode_path(c: Column) -> Column:
    """Each segment of a path percent-encoded, slashes kept (F16)."""
    return F.array_join(F.transform(F.split(c, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")


def normal_path(c: Column) -> Column:
    """A relative path without empty and ``.`` segments, each ``..`` taking the segment before it; ``.`` for nothing."""
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(x.isin("", "."), done).when((x == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, x))

    path = F.array_join(F.aggregate(F.split(c, "/"), none, step), "/")
    return F.when(path == "", ".").otherwise(path)
