"""Texts read in a wrong character encoding (problem 9), by round-trip repair.

A text is searched for sequences that, re-encoded under a candidate legacy encoding, decode strictly as the intended
encoding. A reading is accepted if the garbling cost drops, and the repair is repeated on its result for nested layers.
Candidates are UTF-8 read as one of the single-byte encodings of `SINGLE` or as GBK, and single-byte Cyrillic or GBK
bytes read as Latin-1. Sequences of which parts are lost (replacement characters, lone control bytes) can't be restored;
they are kept as they are and reported.

A sequence that a text only quotes is no case: its restored form stands in the same line as the right spelling of the
same word. Null and empty texts hold nothing. Every row is judged by itself, so copies count each; extra columns are
ignored. The work is per row, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from traceloom.store import table

SINGLE = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
LAYERS = 4
#: Signs that stand next to each other in right texts: behind Cyrillic letters, and in tables drawn with lines.
USUAL = {"cp1251": set("ё…»«“”’‘–—№„·§°\xa0"), "cp437": set("│┤╡╢╖╕╣║╗╝╜╛┐"), "cp850": set("│┤╣║╗╝┐")}
LOST = re.compile("�+|锟斤拷|â€|[\x80-\x9f]+|¡[¢£ª\xad®¯°±]")
WIDE = re.compile("[‐-◿　-鿿가-퟿-＀-￯€\xa0-\xffͰ-ӿ]{2,}")
HAN = re.compile("[一-鿿]")
DENSE = re.compile("[\xc0-\xff]{3,}")
SHORT = re.compile("(?<![^\\W_])[\xc0-\xff]{1,3}(?![^\\W_])")
NARROW = re.compile("(?=[\xa1-\xbf]*[\xc0-\xff][\xa1-\xbf]*[\xc0-\xff])[\xa1-\xff]{4,}")


@cache
def readers() -> list[tuple[str, dict[str, int], re.Pattern]]:
    """Each single-byte encoding: the byte of each of its signs, and the pattern of UTF-8 sequences read in it."""
    out = []
    for name in SINGLE:
        to = {}
        for b in range(0x80, 0x100):
            try:
                to[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                pass
        if name.startswith("cp125"):
            for b in range(0x80, 0xA0):
                to.setdefault(chr(b), b)  # bytes that the encoding leaves open stay as they are
        of = lambda low, high: "[" + "".join(re.escape(c) for c, b in to.items() if low <= b <= high) + "]"  # noqa: B023, E731
        rest = of(0x80, 0xBF)
        out.append((name, to, re.compile(f"(?:{of(0xC2, 0xDF)}{rest}|{of(0xE0, 0xEF)}{rest}{{2}}|{of(0xF0, 0xF4)}{rest}{{3}})+")))
    return out


@cache
def pair() -> re.Pattern:
    """A first and a second byte of UTF-8 as some single-byte encoding shows them: texts without are not looked at."""
    of = lambda low, high: "".join(sorted({re.escape(c) for _, to, _ in readers() for c, b in to.items() if low <= b <= high}))
    return re.compile(f"[{of(0xC2, 0xF4)}][{of(0x80, 0xBF)}]")


def plain(c: str) -> bool:
    """Signs that are usual in restored texts."""
    n = ord(c)
    return (
        0x20 <= n < 0x7F or n in (9, 10, 13) or 0xA0 <= n <= 0x17F or n in (0x192, 0x2C6, 0x2DC) or 0x400 <= n <= 0x4FF or 0x2010 <= n <= 0x22FF or 0x2500 <= n <= 0x27BF or 0x3000 <= n <= 0x9FFF
        or n in (0x200D, 0x20E3, 0xFE0F) or 0xFF00 <= n <= 0xFFEF or n >= 0x1F000
    )


@lru_cache(70_000)
def weight(c: str) -> int:
    n = ord(c)
    if n < 0x80:
        return 0
    if n < 0xA0 or n == 0xFFFD or 0xE000 <= n <= 0xF8FF:
        return 4
    if 0x4E00 <= n <= 0x9FFF:
        try:
            c.encode("gb2312")
        except UnicodeEncodeError:
            return 3
    return 1 if c.isalpha() else 2


def cost(text: str) -> int:
    """Garbling cost: nothing for ASCII, 1 for a letter of any script, 2 for a sign, 3 for a Chinese character outside
    the usual set, 4 for what no text has; one more for each of three and more accented letters in a
    row."""
    return sum(map(weight, text)) + sum(len(m) for m in DENSE.findall(text))


def from_single(name: str, to: dict[str, int], found: str) -> str | None:
    """What a run of UTF-8 sequences read in a single-byte encoding was; None if it is right as it stands."""
    try:
        was = bytes(to[c] for c in found).decode("utf-8")
    except UnicodeDecodeError:
        return None
    cyrillic = sum(0x400 <= ord(c) <= 0x4FF for c in was)
    if not all(plain(c) or 0x80 <= ord(c) < 0xA0 for c in was) or 0 < cyrillic < 3 and cyrillic == len(was):
        return None
    usual = USUAL.get(name, ())
    if usual and all(c in usual for c in found if 0x80 <= to[c] <= 0xBF):
        if name == "cp1251" or not set(found) & set("├┬") or "┬" in found or any(ord(c) >= 0x100 for c in was):
            return None
    return was if cost(was) < cost(found) else None


def from_gbk(found: str) -> str | None:
    """What UTF-8 bytes read as GBK were; the bytes of a cut last sequence are lost."""
    if not HAN.search(found):
        return None
    try:
        found.encode("gb2312")
        return None  # ordinary Chinese
    except UnicodeEncodeError:
        pass
    try:
        raw = found.encode("gb18030")
        try:
            was = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                return None
            was = raw[: e.start].decode("utf-8")
    except UnicodeEncodeError:
        return None
    return was if was and all(map(plain, was)) and cost(was) < cost(found) else None


def from_latin(found: str) -> tuple[str, str] | None:
    """What Cyrillic or GBK bytes shown as Latin-1 were, and in which encoding: of the strict readings the one with the
    fewest odd signs."""
    raw = found.encode("latin-1")
    best, least = None, None
    for name in ("koi8-r", "cp1251", "gb18030"):
        try:
            was = raw.decode(name)
        except UnicodeDecodeError:
            continue
        odd = sum(not c.isalpha() for c in was) + sum(c.isupper() for c in was[1:])
        if name == "gb18030":
            try:
                was.encode("gb2312")
            except UnicodeEncodeError:
                odd += len(was)
        if least is None or odd < least:
            best, least = (was, name), odd
    return best


def latin_runs(text: str) -> list[tuple[int, int, str]]:
    """Runs shown as Latin-1; short words of the same line are read like the long ones beside them."""
    out, lines = [], {}
    for m in NARROW.finditer(text):
        if len(set(m.group())) >= 3 and (found := from_latin(m.group())) is not None:
            out.append((m.start(), m.end(), found[0]))
            lines[text.rfind("\n", 0, m.start())] = found[1]
    for begin, name in lines.items():
        end = text.find("\n", begin + 1)
        for m in SHORT.finditer(text, begin + 1, len(text) if end < 0 else end):
            if not any(a <= m.start() < b for a, b, _ in out):
                try:
                    was = m.group().encode("latin-1").decode(name)
                except UnicodeDecodeError:
                    continue
                if was.isalpha():
                    out.append((m.start(), m.end(), was))
    return sorted(out)


def quoted(text: str, begin: int, end: int, was: str) -> bool:
    """Whether the run is shown as an example: its line has the right spelling of the same word beside it."""
    low, high = text.rfind("\n", 0, begin) + 1, text.find("\n", end)
    high = len(text) if high < 0 else high
    a, b = begin, end
    while a > low and text[a - 1].isalpha() and text[a - 1].isascii():
        a -= 1
    while b < high and text[b].isalpha() and text[b].isascii():
        b += 1
    right = re.escape(text[a:begin] + was + text[end:b])
    return re.search(rf"(?<!\w){right}(?!\w)", text[low:a] + "\n" + text[b:high]) is not None


def readings(text: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """For each candidate encoding the runs that it restores: begin, end, original."""
    out = []
    for name, to, seek in readers() if pair().search(text) else ():
        hits = [(m.start(), m.end(), was) for m in seek.finditer(text) if (was := from_single(name, to, m.group())) is not None]
        out.append((name, hits))
    out.append(("gbk", [(m.start(), m.end(), was) for m in WIDE.finditer(text) if (was := from_gbk(m.group())) is not None]))
    out.append(("latin-1", latin_runs(text)))
    return [(n, h) for n, h in out if h]


def repaired(text: str | None) -> tuple[str | None, bool]:
    """The text with all garbled sequences restored as far as they can be, and whether it holds any."""
    if not text or text.isascii():
        return text, False
    found = False
    for layer in range(LAYERS):
        best, least = None, None
        claimed = []  # runs of any encoding, restored or quoted: their parts are not lost by themselves
        for _, hits in readings(text):
            claimed += [(a, b) for a, b, _ in hits]
            own = [h for h in hits if not quoted(text, *h)]
            if not own:
                continue
            parts, at = [], 0
            for a, b, was in own:
                parts += [text[at:a], was]
                at = b
            new = "".join([*parts, text[at:]])
            if least is None or cost(new) < least:
                best, least = new, cost(new)
        if layer == 0:
            found = best is not None or any(not any(x <= m.start() and m.end() <= y for x, y in claimed) for m in LOST.finditer(text))
        if best is None or least >= cost(text):
            break
        text = best
    return text, found


def repairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, t) for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for t, found in [repaired(text)] if found]
        cols = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["doc_id", "text"])


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents and their text, restored as far as it can be."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInArrow(repairs_of, "doc_id long, text string")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repaired(spark, sf_dir).select("doc_id")
