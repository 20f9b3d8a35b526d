"""Personal information in free text (problem 1), by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, street words, and cues of telephone, identity number and person.
At each anchor a deterministic parser reads the item around it and checks its boundaries: an address needs a house
number, a telephone number its digits and grouping, an email a domain that is no file name. Numbers without a cue are
found by their digit runs and go through the same parsers.

Names are learnt from the corpus itself: a word that stands both in the local part of an email address and at a place
where a person is named (salutation, signature, sender, title) is a name, with its usual place (first or last). Words
of all records are then looked up by the distinct-word shuffle, so that the learnt table is joined, not broadcast.
Chinese names have no spaces: which characters begin and continue a name is learnt at the same cues; these sets are
bounded by the character set.

The text is read in a folded form (full-width forms, dashes, zero-width signs; percent-encoding in URLs) whose
positions map back, so a placeholder replaces exactly the item and all other wording stays. Null and empty texts hold
nothing; very long texts are read whole; every row is a record by its id, extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.llm.words import dictionary, encoded, noted, resolved
from traceloom.store import table

FIELDS = (("text", "text_versions", "vrow", "text"), ("title", "windows", "id", "title"), ("url", "urls", "id", "raw_locator"))
KINDS = ("email", "phone", "id_number", "address", "name")
AROUND = 90  # characters around an anchor that a parser may need; items are shorter

AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s(?=\S+(?:\sdot\s|\s?[\[({]dot)))"
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?P<local>[\w.+%-]*[^\W_][\w.+-]*?){AT}(?:[a-z0-9-]+{DOT})+(?!(?:png|jpe?g|gif|svg|webp|pdf|md)\b)[a-z]{{2,}}(?![a-z0-9])", re.IGNORECASE)
CALL = r"(?:tel(?:[eé]fono|efon|ephone)?|t[eé]l|phone|mobile|fax|call(?: from)?|dial-in|number is|voicemail from|ll[aá]mame al|joignable au|unter|电话|请打|тел)"
PHONE = re.compile(
    r"(?<![\w+])\+\d{1,3}[ .\-/(]*\d(?:[ .\-/()]{0,3}\d){6,12}(?!\d)"
    r"|(?<![\w.\-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?<![\w.\-])0\d(?:[ .-]\d\d){4}(?![\d-])"
    r"|(?<![\w.\-])(?:0|0?\(0\))7\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)"
    r"|(?<![\w.\-])\(?0\d{2,4}\)?(?: ?/ ?|[ -])\d{4,6}[ -]?\d{1,4}(?!\d)"
    r"|(?<![\w.\-])00\d{2}[ .-]\d(?:[ .\-/()]{0,3}\d){6,12}(?!\d)"
    r"|(?<![\w.\-])1[3-9]\d[ -]\d{4}[ -]\d{4}(?![\d-])"
    rf"|{CALL}[^\w\n+]{{0,3}}(?P<n>\+?\d(?:[ .\-/()]{{0,3}}\d){{8,13}})(?!\d)",
    re.IGNORECASE,
)
ID_CUE = r"(?i:ssn|national id|身份证号?|证件号码|dni/nie|steuernummer|tax file|passport(?: or id)?(?: no\.?)?|identity check|applicant)"
ID = re.compile(
    r"(?<![A-Za-z0-9])QQ[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[A-D](?![A-Za-z0-9])"
    r"|(?<![\w-])\d{3}[- ]\d\d[- ]\d{4}(?![\w-])"
    r"|(?<![A-Za-z0-9.,])\d\d \d{3} \d{3} \d{3}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])\d{8}[- ]?[A-Z](?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])\d{6}(?:19|20)\d\d(?:0\d|1[0-2])[0-3]\d{4}[\dXx](?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])XZ ?\d{7}(?![A-Za-z0-9])"
    rf"|{ID_CUE}[^\w\n]{{1,3}}(?P<n>(?:[A-Z]{{1,2}}[ -]?)?\d(?:[ .-]?\d){{6,17}}(?:[ -]?[A-Z])?)(?![A-Za-z0-9])"
)
WAY = r"(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Boulevard|Blvd|Court|Square|Terrace)"
UP = r"[^\W\d_a-zß-öø-ÿ][\w’'-]*"
ADDRESS = re.compile(
    rf"(?<![\w.])\d{{1,5}}[A-Za-z]?,?[ \xa0](?:(?:N|S|E|W|North|South|East|West)\.? )?(?!The\b){UP} (?:{UP} )?{WAY}\b"
    r"|(?:[^\W\d_][\w’'-]*(?<=[^\W\d_])(?:weg|stra(?:ß|ss)e|str\.|gasse|allee)|(?:(?<!\w)[^\W\d_]+ )?(?<!\w)(?:Stra(?:ß|ss)e|Str\.|Gasse|Allee|Weg))\s?\d{1,4}[a-z]?(?!\w)"
    r"|(?<![\w.])\d{1,5}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|quai|impasse|allée)\s(?:d[eu]s?\s|de la\s|d[’'])?[^\W\d_][\w’'-]*"
    r"|(?<!\w)(?:Calle|C/|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Rua|R\.)\s?(?:[^\W\d_][\w’'.-]*\s?){1,5},?\s?(?:n[.º°]+\s?|núm\.?\s)?\d{1,4}"
    r"|(?:ул\.|улица|проспект|пр\.|переулок)\s?[^\d\n]{2,30}\d+"
    r"|[一-鿿]{1,8}(?:路|街|大道|巷|弄)\s?\d+\s?(?:号|弄)"
)
#: Signs at which each parser begins to read, in lower case.
ANCHORS = {
    "email": ("@", "[at]", "(at)", "{at}", " at ", "[ at ]", "( at )"),
    "phone": ("+", "tel", "tél", "phone", "mobile", "fax", "call", "dial", "number is", "voicemail", "llámame", "llamame", "joignable", "unter", "电话", "请打", "тел"),
    "id_number": ("ssn", "national id", "身份证", "证件号码", "dni/nie", "steuernummer", "tax file", "passport", "identity check", "applicant", "qq", "xz"),
    "address": (
        " street", " st", " avenue", " ave", " lane", " ln", " road", " rd", " drive", " boulevard", " blvd", " court", " square", " terrace",
        "weg", "straße", "strasse", "str.", "gasse", "allee", "rue ", "avenue ", "av.", "bd ", "place ", "chemin ", "quai ", "impasse ", "allée ",
        "calle", "c/", "c.", "avda", "avenida", "plaza", "pza.", "paseo", "camino", "rua", "r.", "ул.", "улица", "проспект", "пр.", "переулок", "路", "街", "大道", "巷", "弄",
    ),
}
PARSERS = {"email": EMAIL, "phone": PHONE, "id_number": ID, "address": ADDRESS}
DIGITS = re.compile(r"[(+]?\d[\d .\-/()]{5,}[\dA-Za-z]")  # a run that a number without cue must hold

NAME = rf"(?:[^\W\d_a-zß-öø-ÿ](?:\.|[\w’'-]+)(?:,? (?:(?:de la|de|van der|van|von|da|dos) )?[^\W\d_a-zß-öø-ÿ](?:\.|[\w’'-]+)){{0,4}}|(?:de la|van der) {UP}(?: {UP})?)"
#: What stands before and behind a person's name, in lower case.
BEFORE = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "sra", "mme ", "m. ", "herr ", "frau ", "don ", "doña ", "from: ", "to: ", "cc: ", "owner: ", "assignee: ",
    "contact: ", "bearbeiter: ", "bearbeiterin: ", "responsable: ", "author: ", "name: ", "assigned to ", "chat with ", "hi ", "hello ", "hola ",
    "bonjour ", "hallo ", "olá ", "dear ", "ciao ", "thanks ", "regards", "grüße", "grüssen", "saludos", "cordialement", "atentamente", "sincerely", "cheers",
)
BEHIND = (" joined the call", " signed", " hat zugestimmt", " est d’accord", " est d'accord")
AFTER_CUE = re.compile(rf"(?:\.? ?|,?\s*\n\s*)({NAME})")
UNTIL_CUE = re.compile(rf"({NAME})$")
HAN_CUE = re.compile(r"(?:联系人|收件人|经办人|姓名|签名)[::]\s?([一-鿿]{2,3})(?![一-鿿])|@([一-鿿]{2,3})(?= )|(?<![一-鿿])([一-鿿]{2,3})(?=已经确认)|与([一-鿿]{2,3})(?=的聊天)")
HAN = re.compile("[一-鿿]{2,}")
LETTERS = re.compile(r"[^\W\d_]+")
CHAIN = re.compile(r"[^\W\d_]+(?:(?:[-’'. ]|’ )[^\W\d_]+)*")
ONE_TO_ONE = {0x3000: " ", 0xA0: " ", 0x202F: " ", 0x2212: "-", 0xFF5E: "~"} | {c: "-" for c in range(0x2010, 0x2013)} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5E)}
WIDE = re.compile(f"[{''.join(map(re.escape, map(chr, ONE_TO_ONE)))}]")
MARKS = re.compile("[\xad​-‍⁠﻿̀-ͯ]")
GONE = re.compile("[​-‍⁠﻿\xad]")
HEX = re.compile("(?:%[0-9A-Fa-f]{2})+")
BARE = str.maketrans("øØłŁđĐßæÆœŒ", "oOlLdDsaAoO")


def folded(text: str, url: bool) -> tuple[str, np.ndarray | None]:
    """The text as the parsers read it; position of each of its characters, and of its end, where they differ."""
    at = None
    if url and "%" in text:
        for _ in range(2):
            parts, places, last = [], [], 0
            base = at if at is not None else np.arange(len(text) + 1)
            for m in HEX.finditer(text):
                raw = bytes.fromhex(m[0].replace("%", ""))
                try:
                    out = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                parts += [text[last : m.start()], out]
                places.append(base[last : m.start()])
                bounds = np.append(0, np.cumsum([len(c.encode()) for c in out]))[:-1]
                places.append(base[m.start() + 3 * bounds])
                last = m.end()
            if not parts:
                break
            at = np.concatenate([*places, base[last:]])
            text = "".join([*parts, text[last:]])
    if not text.isascii():
        if WIDE.search(text):
            text = text.translate(ONE_TO_ONE)
        if MARKS.search(text):
            # letters are put together with their marks; signs without width are left out
            out, places = [], []
            base = at if at is not None else np.arange(len(text) + 1)
            for m in re.finditer("[​-‍⁠﻿\xad]|.[̀-ͯ]*", text, re.DOTALL):
                if GONE.fullmatch(m[0]):
                    continue
                one = unicodedata.normalize("NFC", m[0])
                out.append(one)
                places += [base[m.start()]] * len(one)
            at = np.array([*places, base[len(text)]])
            text = "".join(out)
    if url:
        host = re.match(r"\w+://[^/?#]*", text)
        n = host.end() if host else 0
        text = text[:n] + re.sub(r"(?:(?<=[^=/])\+|\+(?=\D))(?![\w.%-]*@)", " ", text[n:])
    return text, at


@cache
def automaton():
    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in (*ANCHORS.items(), ("before", BEFORE), ("behind", BEHIND)):
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(k)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


DIGIT = re.compile(r"\d")


def stands(low: str, kind: str, begin: int, end: int) -> bool:
    """Whether an anchor at begin .. end stands where its parser can read an item: cheap tests of its neighbours."""
    before, behind = low[begin - 1 : begin], low[end : end + 1]
    if kind == "phone":
        return behind.isdigit() if low[begin] == "+" else not (behind.isalpha() and low[begin].isascii() and behind.isascii())
    if kind == "address":
        if low[begin] == " ":
            return not behind.isalnum()
        return low[end - 1] not in "./" or not before.isalnum() or low[begin:end] == "str."
    if kind == "email":
        return low[begin:end] != " at " or "dot" in low[end : end + 40]
    return kind == "behind" or not before.isalnum() or not before.isascii()


def items(text: str, names: list[str] | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of emails, numbers and addresses of a folded text. `names` gets what is written where a
    person is named."""
    windows: dict[str, list[list[int]]] = {k: [] for k in PARSERS}

    def look(kind: str, lo: int, hi: int) -> None:
        w = windows[kind]
        if w and lo <= w[-1][1]:
            w[-1][1] = max(w[-1][1], hi)
        else:
            w.append([lo, hi])

    low, size = lowered(text), len(text)
    for last, (n, kinds) in automaton().iter(low):
        end = last + 1
        for k in kinds:
            if not stands(low, k, end - n, end):
                continue
            if k in PARSERS:
                look(k, max(0, end - n - AROUND), min(size, end + AROUND))
            elif names is not None and (m := AFTER_CUE.match(text, end, end + AROUND) if k == "before" else UNTIL_CUE.search(text, max(0, end - n - AROUND), end - n)):
                names.append(m[1])
    numbers = [(max(0, m.start() - 30), min(size, m.end() + 12)) for m in DIGITS.finditer(text) if sum(map(str.isdigit, m[0])) >= 7]
    out: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in out)
    for kind in PARSERS:
        spans = windows[kind]
        if kind in ("phone", "id_number"):
            spans = sorted([tuple(s) for s in spans] + numbers)
        for lo, hi in spans:
            if kind != "email" and not DIGIT.search(text, lo, hi):
                continue
            for m in PARSERS[kind].finditer(text, lo, hi):
                a, b = (m.span("n") if "n" in m.re.groupindex and m["n"] else m.span())
                if m.end() == hi < size and text[hi].isalnum():
                    continue  # cut by the window: a later one holds it whole
                if kind == "id_number" or free(a, b):
                    if not any(x == a and y == b and k == kind for x, y, k in out):
                        out.append((a, b, kind))
    return out


def bare(word: str) -> str:
    """A word without case and accents."""
    w = word.translate(BARE)
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    return w.lower()


def chains(words: list[str]) -> Iterator[tuple[int, int, str]]:
    """Neighbouring words of a name written as one: from, to, all of them bare."""
    low = [bare(w) for w in words]
    for i in range(len(low)):
        for j in range(i + 1, min(i + 5, len(low) + 1)):
            yield i, j, "".join(low[i:j])


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, kind in spans:
        if kind == "email":
            text = text[:a] + ";" * (b - a) + text[b:]
    return text


def noted_of(text: str, spans: list[tuple[int, int, str]], named: list[str]) -> list[str]:
    """What a record teaches about names: role and word; roles: mail, first, last, begin, inside."""
    out = []
    for a, b, kind in spans:
        if kind == "email":
            local = EMAIL.fullmatch(text, a, b)
            out += [f"mail {w}" for w in re.split(r"[^a-z]+", local["local"].lower()) if len(w) >= 3] if local else []
    for name in named:
        words = LETTERS.findall(name)
        out += [f"{'first' if i == 0 and len(words) > j else 'last'} {w}" for i, j, w in chains(words) if len(w) >= 3]
    if not text.isascii():
        for m in HAN_CUE.finditer(text):
            name = m[m.lastindex]
            out += [f"begin {name[0]}", *(f"inside {c}" for c in name[1:])]
    return out


def learnt(batches: DataFrame) -> tuple[DataFrame, str, str]:
    """Names of the corpus as rows (word, last: whether it is mostly a last name), and the characters that begin and
    continue Chinese names, at most as many as the character set has."""
    seen = noted(batches).select(F.substring_index("word", " ", 1).alias("role"), F.substring_index("word", " ", -1).alias("word"), "n")
    of = lambda *roles: F.sum(F.when(F.col("role").isin(*roles), F.col("n")).otherwise(0))
    latin = seen.where("role in ('mail', 'first', 'last')").groupBy("word").agg(of("mail").alias("mail"), of("first").alias("first"), of("last").alias("last"))
    latin = latin.where("mail > 0 and first + last > 0").select("word", (F.col("last") > F.col("first")).alias("last"))
    han = seen.where("role in ('begin', 'inside') and n >= 2").collect()
    return latin, "".join(sorted(r["word"] for r in han if r["role"] == "begin")), "".join(sorted(r["word"] for r in han if r["role"] == "inside"))


def han_pattern(begin: str, inside: str) -> re.Pattern | None:
    """A name at a cue, or a first character followed by one or two inner ones and no third."""
    if not begin or not inside:
        return HAN_CUE
    return re.compile(rf"{HAN_CUE.pattern}|([{begin}][{inside}]{{1,2}})(?![{inside}])")


def han_names(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [m.span(m.lastindex) for m in pattern.finditer(text)]


def words_of(record: str) -> tuple[list[str], list[str]]:
    """Words of a record that may be names, and marks of the kinds found by the parsers; then what it teaches about
    names. A record's first character tells its field."""
    url = record[0] == "2"
    text, _ = folded(record[1:], url)
    named: list[str] = []
    spans = items(text, named)
    out = {f"\1{kind}" for _, _, kind in spans}
    rest = blanked(text, spans)
    if url and (host := re.match(r"\w+://[^/?#]*", rest)):
        rest = rest[host.end() :]
    if not rest.isascii():
        if HAN_CUE.search(rest):
            out.add("\1name")
        for m in HAN.finditer(rest):  # each place where a Chinese name may begin, with the sign behind it
            out.update(f"\3{m[0][i : i + 4]}" for i in range(len(m[0]) - 1))
    out.update(candidates(rest, url))
    return list(out), noted_of(text, spans, named)


class Forms(dict):
    """Bare form of a word of a text; a word in lower case is marked."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = ("" if word[0].isupper() else "\2") + bare(word)
        return out


FORMS = Forms()
U = "[^\\W\\d_a-zß-öø-ÿ][^\\W\\d_]*"
CAPITALS = re.compile(rf"(?:\b(?:de|van|von) (?:la |der )?)?{U}(?:(?:[-’' ]|\. )(?:(?:de|la|van|der|von|da|dos) ){{0,2}}{U})+")


def candidates(text: str, any_case: bool) -> set[str]:
    """Bare forms of all words, and of neighbouring words that may be one name; words in lower case are marked."""
    words = set(LETTERS.findall(text))
    out = {bare(w) for w in words if len(w) >= 3} if any_case else {FORMS[w] for w in words if len(w) >= 3}
    for m in (CHAIN if any_case else CAPITALS).finditer(text):
        parts = LETTERS.findall(m[0])
        if len(parts) > 1:
            low = [bare(p) for p in parts]
            out.update("".join(low[i:j]) for i in range(len(low) - 1) for j in range(i + 2, min(i + 5, len(low) + 1)))
    out.update([w.replace("ae", "a").replace("oe", "o").replace("ue", "u") for w in out if "ae" in w or "oe" in w or "ue" in w])
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, field, record_id, text) of all three fields; key is the id and the field in one number."""
    out = None
    for i, (field, name, key, column) in enumerate(FIELDS):
        part = table(spark, sf_dir, name).select((F.col(key) * 4 + i).alias("key"), F.lit(field).alias("field"), F.col(key).alias("record_id"), F.col(column).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def kinds_of(table_: pa.Array, keys: pa.Array, places: pa.Array) -> pa.RecordBatch:
    n = np.asarray(pc.list_value_length(places).fill_null(0))
    flat = table_.take(places.flatten()).to_pylist()
    bounds, out = np.append(0, np.cumsum(n)).tolist(), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(sorted({v for v in flat[a:b] if v is not None}))
    return pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.string()))], ["key", "found"])


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    """(key, found: marks of kinds, and bare names) of the records that hold anything."""
    rows = records(spark, sf_dir)
    code = F.when(F.col("field") == "url", "2").otherwise("0")
    batches = encoded(rows.where("length(text) > 0").select("key", F.concat(code, "text")), words_of, notes=True)
    names, begin, inside = learnt(batches)
    values = names.select("word", F.col("word").alias("value"))
    marked = F.concat(F.lit("\2"), "word")  # a word in lower case is a name only if it is mostly a last name
    values = values.unionByName(names.where("last and length(word) >= 5").select(marked.alias("word"), F.col("word").alias("value")))
    values = values.unionByName(spark.createDataFrame([(f"\1{k}", f"\1{k}") for k in KINDS], "word string, value string"))
    if begin and inside:
        han = dictionary(batches).select("word").distinct().where(F.col("word").rlike(rf"^\x{{03}}[{begin}][{inside}]{{1,2}}(?![{inside}])"))
        values = values.unionByName(han.select("word", F.lit("\1name").alias("value")))
    out = resolved(batches, values, "string", "key long, found array<string>", kinds_of)
    return out.where("size(found) > 0"), begin, inside


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = found(spark, sf_dir)
    kind = lambda w: F.when(w.startswith("\1"), F.substring(w, 2, 20)).otherwise("name")
    rows = rows.select("key", F.explode(F.array_distinct(F.transform("found", kind))).alias("kind"))
    field = F.element_at(F.array(*(F.lit(f[0]) for f in FIELDS)), (F.pmod("key", F.lit(4)) + 1).cast("int"))
    return rows.select(field.alias("field"), F.floor(F.col("key") / 4).alias("record_id"), "kind")


def redacted(text: str, url: bool, names: set[str], pattern: re.Pattern) -> str:
    """The same wording with a placeholder for every item."""
    view, at = folded(text, url)
    spans = items(view)
    rest = blanked(view, spans)
    low = 0
    if url and (host := re.match(r"\w+://[^/?#]*", rest)):
        low = host.end()
    if not rest.isascii():
        spans += [(a, b, "name") for a, b in han_names(rest, pattern)]
    if names:
        short = lambda w: w.replace("ae", "a").replace("oe", "o").replace("ue", "u")
        for m in CHAIN.finditer(rest, low):
            parts = list(LETTERS.finditer(rest, m.start(), m.end()))
            i = 0
            while i < len(parts):
                for j in range(min(i + 4, len(parts)), i, -1):
                    w = "".join(bare(p[0]) for p in parts[i:j])
                    if w in names or short(w) in names:
                        spans.append((parts[i].start(), parts[j - 1].end(), "name"))
                        i = j - 1
                        break
                i += 1
    out, last = [], 0
    merged: list[list] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if merged and kind == "name" == merged[-1][2] and rest[merged[-1][1] : a] in (" ", ", ", "+", "_", "-"):
            merged[-1][1] = b  # given and family name are one item
        elif not merged or a >= merged[-1][1]:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        a, b = (int(at[a]), int(at[b])) if at is not None else (a, b)
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_id, text) of all records, items replaced by placeholders; records without any stay as they are."""
    marks, begin, inside = found(spark, sf_dir)
    pattern_of = (begin, inside)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = han_pattern(*pattern_of)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("field", "text", "found")]
            out = [redacted(t, f == "url", {w for w in n if w[0] != "\1"}, pattern) if t and n else t for f, t, n in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("record_id"), pa.array(out, pa.string())], ["field", "record_id", "text"])

    rows = records(spark, sf_dir).join(marks, "key", "left").select("field", "record_id", "text", "found")
    return rows.mapInArrow(of, "field string, record_id long, text string")
