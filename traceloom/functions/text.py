"""Column functions over texts (TXT-1 to TXT-24, FLT-3 to FLT-9)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"  # fixed ranges


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """TXT-1: compatibility form, for the index and for queries alike. Null stays null."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


RUN = re.compile("[㐀-䶿一-鿿豈-﫿]+")


def bigrams_of(text: str) -> str:
    """TXT-4: overlapping pairs of each run of Chinese characters, single ones kept, all else as it is."""

    def pairs(m: re.Match) -> str:
        s = m[0]
        return f" {' '.join(s[i : i + 2] for i in range(len(s) - 1)) if len(s) > 1 else s} "

    return re.sub(r" +", " ", RUN.sub(pairs, text)).strip()


@F.pandas_udf(StringType())
def bigrams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bigrams_of(t) if t else t, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def index_tokens(texts: pd.Series) -> pd.Series:
    """TXT-6: tokens of the index: folded, no case or diacritics, Chinese runs as pairs."""

    def of(t: str) -> list[str]:
        t = unicodedata.normalize("NFKC", t).lower()
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        return re.findall(r"[^\W_]+", bigrams_of(t))

    return texts.map(lambda t: of(t) if t else [], na_action="ignore")


def phrase(query: str) -> str:
    """TXT-5: a query as one quoted phrase."""
    return '"' + query.replace('"', '""') + '"'


def short_scan(query: str) -> bool:
    """TXT-7, SEA-6: whether a query is too short for the index: one or two signs, unless two Chinese characters."""
    return 0 < len(query) <= 2 and not (len(query) == 2 and RUN.fullmatch(query))


def tokens_estimate(text: Column) -> Column:
    """TXT-8."""
    return F.ceil(F.length(text) / 2).cast("long")


def truncated(text: Column, tokens: int) -> Column:
    """TXT-9: at most two signs a token, the last one an ellipsis if the text is longer."""
    n = 2 * tokens
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def narrative_tokens(text: Column) -> Column:
    """TXT-10: wide signs 1, ASCII letters and digits a half, white space a third, others 1; rounded up, 48 more."""
    n = F.length(text)
    half = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    third = F.length(F.regexp_replace(text, r"\S", ""))
    return (F.ceil((n - half - third) + half / 2 + third / 3 - 1e-9) + 48).cast("long")


def snippet(text: Column, query: str, around: int = 40, whole: int = 80) -> Column:
    """SEA-12: the first hit with what stands around it, or the beginning of the text."""
    flat = F.regexp_replace(text, r"\r\n|[\r\n]", " ")
    at = F.instr(F.lower(flat), query.lower())
    lo, hi = F.greatest(F.lit(1), at - around), F.least(F.length(flat), at + len(query) - 1 + around)
    cut = F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(flat, lo, hi - lo + 1), F.when(hi < F.length(flat), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(flat, 1, whole))


def duration_text(ms: Column) -> Column:
    """TXT-15."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), F.pmod(s, F.lit(60)), F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def luhn(text: Column) -> Column:
    """TXT-13: 13 to 19 digits, apart from separators, with a right check digit."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


#: Secrets by their published formats: PEM blocks, access keys of cloud, code and chat services, and assignments.
SECRETS = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.DOTALL)),
    ("cloud_key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("code_token", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{20,})\b")),
    ("chat_token", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b")),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[:=]\s*[\"']?([^\s\"']{6,})")),
    ("card", re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")),
    ("code", re.compile(r"(?i)(?:\b(?:code|otp|verification)\b|验证码)[^\d\n]{0,20}(\d{4,8})(?!\d)")),
    ("code", re.compile(r"(?i)(?<![\d ])(\d{4,8}) (?:is your|is the)\b[^\d\n]{0,30}?(?:code|otp)|(?<!\d)(\d{4,8})是您的验证码")),
)


def luhn_ok(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def redacted_secrets(text: str) -> tuple[str, dict[str, int]]:
    """TXT-12: secrets replaced by their type; of overlapping ones the rule named first wins, then the earlier."""
    taken: list[tuple[int, int, str]] = []
    for kind, rule in SECRETS:
        for m in rule.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if kind == "card" and not luhn_ok(m[0]):
                continue
            if all(b <= x or y <= a for x, y, _ in taken):
                taken.append((a, b, kind))
    out, at, counts = [], 0, {}
    for a, b, kind in sorted(taken):
        out += [text[at:a], f"[REDACTED:{kind}]"]
        at = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


@F.pandas_udf(StructType().add("text", StringType()).add("found", IntegerType()))
def redact_secrets(texts: pd.Series) -> pd.DataFrame:
    rows = [redacted_secrets(t) if t else (t, {}) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "found": [sum(r[1].values()) for r in rows]})


def coverage(known: Column, seen: Column) -> Column:
    """TXT-11: share of the distinct words of one text that stand in another; null if there are none."""
    words = F.filter(F.array_distinct(F.split(F.lower(known), r"[^\p{L}\p{N}\p{M}]+")), lambda w: w != "")
    hit = F.filter(words, lambda w: F.contains(F.lower(seen), w))
    return F.when(F.size(words) > 0, F.size(hit) / F.size(words))


def opaque_tokens(text: Column) -> Column:
    """TXT-19: tokens that recognition gets wrong easily: hex numbers, hashes and long opaque words."""
    odd = lambda w: w.rlike(r"^0[xX][0-9a-fA-F]+$") | (w.rlike(r"^[0-9a-fA-F]{7,40}$") & w.rlike("[0-9]") & w.rlike("[a-fA-F]")) | (w.rlike(r"^[A-Za-z0-9_-]{16,}$") & w.rlike("[0-9]"))
    return F.filter(F.split(text, r"\s+"), odd)


def number_literals(text: Column) -> Column:
    """TXT-16: numbers of a text, without separators of thousands."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[,.]\d+)*)"), 1), lambda n: F.regexp_replace(n, r",(\d{3})", "$1"))


def slug(text: Column) -> Column:
    """TXT-24."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


FIELDS = ("url", "host", "path", "app", "title")


def field_query(query: str) -> tuple[str | None, str]:
    """FLT-4: (field, rest) of a query with a field prefix; a head that is no field, or nothing behind it, is text."""
    head, sep, rest = query.partition(":")
    if sep and head.strip().lower() in FIELDS and rest.strip():
        return head.strip().lower(), rest.strip()
    return None, query


HOSTLIKE = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9-]+)*\.[a-z]{2,}(:[0-9]+)?(/.*)?$"


def route(query: Column) -> Column:
    """FLT-5: url, path or text, by the shape of a query."""
    q = F.lower(F.trim(query))
    return (
        F.when(q.rlike(r"\s"), "text").when(q.rlike(r"^(https?|file)://"), "url").when(q.rlike(r"^(/|~/|\./)"), "path").when(q.rlike(HOSTLIKE), "url").when(F.contains(q, F.lit("/")), "path").otherwise("text")
    )


def bare_host(url: Column) -> Column:
    """FLT-7."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def has_path(url: Column) -> Column:
    return F.contains(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), F.lit("/"))


def url_kind(url: Column) -> Column:
    """FLT-8: web, file, deeplink or other, by the scheme."""
    u = F.lower(url)
    return F.when(u.rlike("^https?://"), "web").when(u.rlike("^file:"), "file").when(u.rlike("^[a-z][a-z0-9+.-]*://"), "deeplink").otherwise("other")


def file_path(document: Column) -> Column:
    """FLT-9: path of a file URL or of an absolute path, else null."""
    return F.when(F.lower(document).rlike("^file://"), F.try_url_decode(F.regexp_replace(document, "(?i)^file://(localhost)?", ""))).when(document.startswith("/"), document)


def private_title(title: Column) -> Column:
    """FLT-16: titles of private windows, by what browsers write there."""
    t = F.lower(title)
    return t.rlike(r"(incognito|inprivate|private browsing|privates fenster|navigation privée|无痕|隐私浏览)")
