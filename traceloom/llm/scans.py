"""Page texts of scanned files (problem 3): what noise they carry, and their repair into readable paragraphs.

The lines at both edges of a page are compared with those at the same edge of the other pages of its file, by a fuzzy
form: it leaves out a page number beside the line and maps signs that are taken for each other to one. Forms that still
differ in up to two places meet by their shingles, of which each form gives so many that no such pair is missed. What
comes again at the top is a running header, also as second line if it is another page's first; what comes again at the
bottom is a running footer if at least three pages and half of the file have it, since texts end alike by chance. Page
numbers are edge lines, or ends of an edge line, that fit the sequence of their file. Lines are joined, and a word broken at a line end is put
together unless the corpus knows it better as a compound. Misread words are rare words whose form is that of a much
more frequent word of the corpus.

The vocabulary (in how many texts of the whole corpus a word stands) is a table that is joined with the words of the
pages, batch dictionary by batch dictionary; nothing of it comes to the driver or to every task.

Null and empty texts have no noise. A text that several observations or files show is one page of each file; a page
seen twice comes once. Copies of one page text don't make its first line a header.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.llm.words import BATCH_CHARS, encoded, resolved
from traceloom.store import table, written

SCANNED = r"\.(pdf|tiff?)$"
HYPHEN = "-‐¬\xad"
BREAK = re.compile(rf"([^\W_]+)[{HYPHEN}][ \t]*\r?\n[ \t]*(?!(?:und|oder)\b)([^\W_]+)")
ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMBER = rf"(?:(?=[\dlo]*\d)[\dlo]{{1,4}}|{ROMAN})"
PAGE = re.compile(
    rf"[-–—\[(]?\s*(?:(?:page|pg?\.?|p[áa]gina|p[áa]g\.?|seite|s\.|стр\.?|第)\s*)?(?P<n>{NUMBER})(?:\s*(?:of|von|de|sur|из|/)\s*\d+)?\s*页?\s*[-–—\])]?",
    re.IGNORECASE,
)
LEFT = re.compile(rf"^{PAGE.pattern}\s{{2,}}", re.IGNORECASE)
RIGHT = re.compile(rf"\s{{2,}}{PAGE.pattern}$", re.IGNORECASE)
HEADING = re.compile(r"\d+(?:\.\d+)+\.?\s")
WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*[@$]?|[@$][^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
SPACE = re.compile(r"\r?\n|\f")
#: Signs that are taken for each other, as one sign each; first those that stand for two.
TWO = (("m", "rri"), ("n", "ri"), ("d", "ei"), ("u", "ii"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"))
ONE = ("lcfth013456789@$", "ieeebiieasbebgas")
DEPTH = {"top": 2, "bottom": 1}  # lines of text that are compared at each edge
NEAR, SHINGLE = 2, 3  # places in which two running lines may differ; signs of a shingle
SHORT = NEAR * SHINGLE + SHINGLE  # from this length on, forms that differ in NEAR places share a shingle
END = 99  # signs at the end of a line in which a page number beside it stands
LEAST_ODD, LEAST, TIMES = 2, 5, 8  # texts that know the right word: with a digit or sign inside, else; times the misread one


def form(word: Column) -> Column:
    out = F.lower(word)
    for a, b in TWO:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(F.translate(out, "0", "o"), *ONE)


def form_of(line: str) -> str:
    """The form of a whole line, without what is no letter or digit."""
    out = "".join(c for c in line.lower() if c.isalnum() or c in "@$")
    for a, b in TWO:
        out = out.replace(a, b)
    return out.translate(str.maketrans("0", "o")).translate(str.maketrans(*ONE))


def number_of(text: str) -> tuple[str, int]:
    s = text.lower()
    if any(c.isdigit() for c in s):
        return "arabic", int(s.translate(str.maketrans("lo", "10")))
    values, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0
    for a, b in zip(s, [*s[1:], " "]):
        total += -values[a] if values.get(b, 0) > values[a] else values[a]
    return "roman", total


def number_beside(s: str, kind: str) -> tuple[str, str] | None:
    """A page number at the left or right end of a line, and the line without it. Only the end is searched, however long
    the line is."""
    if kind == "left":
        m = LEFT.search(s[:END])
        return m and (m["n"], s[m.end() :].strip())
    m = RIGHT.search(s[-END:])
    return m and (m["n"], s[: max(0, len(s) - END) + m.start()].strip())


def edge_lines(text: str) -> tuple[list[tuple[str, int, str]], list[tuple[int, str, str]]]:
    """The lines of text at both edges that may be running lines: edge, place from there, line without a page number
    beside it. And the page numbers: index of the line, how it is written (line, left or right) and the number."""
    lines = [(i, s.strip()) for i, s in enumerate(SPACE.split(text)) if s.strip()]
    if not lines:
        return [], []
    numbers, left = [], dict(lines)

    def number(i: int, s: str, beside: bool) -> str:
        if m := PAGE.fullmatch(s):
            numbers.append((i, "line", m["n"]))
            return ""
        for kind in ("left", "right") if beside else ():
            if found := number_beside(s, kind):
                numbers.append((i, kind, found[0]))
                return found[1]
        return s

    left[lines[0][0]] = first = number(*lines[0], True)
    if len(lines) > 1:
        i, second = lines[1]
        if PAGE.fullmatch(second):
            if not first:
                left[i] = ""
            elif len(lines) > 2 and len(lines[0][1]) < 60 and lines[0][1][-1] not in ".,;":
                left[i] = number(i, second, False)
        left[lines[-1][0]] = number(*lines[-1], True)
    rest = [s for s in left.values() if s]
    found = [("top", k, s) for k, s in enumerate(rest[: DEPTH["top"]])]
    found += [("bottom", k, s) for k, s in enumerate(rest[: -DEPTH["bottom"] - 1 : -1]) if len(rest) - k > DEPTH["top"]]
    return [x for x in found if not HEADING.match(x[2]) and form_of(x[2])], numbers


def edges(text: str) -> tuple[str | None, list[tuple[int, str, str]]]:
    """The first line of text, if it may be a running header, and the page numbers."""
    lines, numbers = edge_lines(text)
    return next((s for edge, k, s in lines if (edge, k) == ("top", 0)), None), numbers


MARKS = "vrow long, file_id long, tag string, a string, b string, n long"


def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of what the lines of a page show: tag break (a: the word as one, b: as a compound), top (a: form, b: line, n: place),
    bottom
    (the same), number (a: arabic or roman, b: place, n: value) and sign (a ligature)."""
    for batch in batches:
        rows = []
        for vrow, file, text in zip(*(batch.column(c).to_pylist() for c in ("vrow", "file_id", "text"))):
            for m in BREAK.finditer(text or ""):
                rows.append((vrow, file, "break", (m[1] + m[2]).lower(), f"{m[1]}-{m[2]}".lower(), None))
            lines, numbers = edge_lines(text or "")
            for edge, k, line in lines:
                rows.append((vrow, file, edge, form_of(line), line, k))
            for i, place, n in numbers:
                kind, value = number_of(n)
                rows.append((vrow, file, "number", kind, f"{i} {place}", value))
            if "ﬁ" in (text or "") or "ﬂ" in (text or ""):
                rows.append((vrow, file, "sign", None, None, None))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["vrow", "file_id", "tag", "a", "b", "n"])


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(BREAK.sub(r"\1\2", text))]


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a stretch of the corpus each word or compound stands."""

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "texts"])

    known, chars = Counter(), 0
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                known.update({*words_of(text), *map(str.lower, COMPOUND.findall(text))})
                chars += len(text)
        if chars > 4 * BATCH_CHARS:
            yield flush()
            known, chars = Counter(), 0
    if known:
        yield flush()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, texts) over all rows of a column of texts."""
    return texts.mapInArrow(counts_of, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def corrections(known: DataFrame) -> DataFrame:
    """(word, right) for the words of a vocabulary that are misread forms of a much more frequent word."""
    forms = known.where(~F.col("word").contains("-")).withColumn("form", form(F.col("word")))
    letters = F.col("word").rlike(r"^\p{L}+$")
    best = forms.where(letters).groupBy("form").agg(F.max(F.struct("texts", F.col("word").alias("right"))).alias("best"))
    odd = ~letters & F.col("word").rlike(r"\p{L}") & (F.length("word") > 2)
    least = F.when(odd, F.lit(LEAST_ODD)).otherwise(F.greatest(F.lit(LEAST), F.lit(TIMES) * F.col("texts")))
    rows = forms.where(odd | (letters & (F.length("word") > 1))).join(best, "form")
    return rows.where((F.col("best.right") != F.col("word")) & (F.col("best.texts") >= least)).select("word", F.col("best.right").alias("right"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vrow, file_id, text) of every page of a scanned file."""
    files = table(spark, sf_dir, "files").where(F.lower("path").rlike(SCANNED)).select(F.col("id").alias("file_id")).distinct()
    seen = table(spark, sf_dir, "observations").where("capture_method in ('ocr', 'mixed') and file_id is not null")
    seen = seen.select("device_id", F.col("id").alias("observation_id"), "file_id").join(files, "file_id", "left_semi").distinct()
    shown = table(spark, sf_dir, "occurrences").select("device_id", "observation_id", F.col("text_version_id").alias("id"))
    shown = shown.join(seen, ["device_id", "observation_id"]).select("device_id", "id", "file_id").distinct()
    texts = table(spark, sf_dir, "text_versions").select("device_id", "id", "vrow", "text")
    return written(texts.join(shown, ["device_id", "id"]).select("vrow", "file_id", "text"), "pages")


def edge_forms(marks: DataFrame, texts: DataFrame, edge: str) -> tuple[DataFrame, DataFrame]:
    """The lines at an edge (vrow, file_id, form, line), and their forms: (file_id, form, pages, place), the place
    nearest to the edge."""
    rows = marks.where(F.col("tag") == edge).select("vrow", "file_id", F.col("a").alias("form"), F.col("b").alias("line"), F.col("n").alias("place"))
    forms = rows.join(texts, ["vrow", "file_id"]).groupBy("file_id", "form").agg(F.count_distinct("hash").alias("pages"), F.min("place").alias("place"))
    return rows.drop("place"), forms


def shingles(line: Column) -> Column:
    """Of the distinct shingles the first by hash, so many that two lines that differ in up to NEAR places share one:
    such lines differ in NEAR * SHINGLE shingles at most."""
    all_ = F.transform(F.sequence(F.lit(1), F.length(line) - SHINGLE + 1), lambda i: F.xxhash64(F.substring(line, i, F.lit(SHINGLE))))
    return F.slice(F.array_sort(F.array_distinct(all_)), 1, NEAR * SHINGLE + 1)


def near_forms(forms: DataFrame) -> DataFrame:
    """(file_id, form, other, pages, place, other_pages, other_place), each pair in both directions: forms of one edge
    of a file that differ in up to NEAR places."""
    a = forms.where(F.length("form") >= SHORT).withColumn("shingle", F.explode(shingles(F.col("form"))))
    b = a.select("file_id", "shingle", F.col("form").alias("other"), F.col("pages").alias("other_pages"), F.col("place").alias("other_place"))
    both = a.join(b, ["file_id", "shingle"]).where((F.col("form") != F.col("other")) & F.levenshtein("form", "other", NEAR).between(0, NEAR))
    return both.drop("shingle").distinct()


def running_headers(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(vrow, file_id, line) of the lines that come again at the top of other pages of their file. One of the pages has
    the line as its first."""
    rows, forms = edge_forms(marks, texts, "top")
    near = near_forms(forms).where(F.least("place", "other_place") == 0)
    again = forms.where("pages >= 2 and place = 0").select("file_id", "form").unionByName(near.select("file_id", "form")).distinct()
    return rows.join(again, ["file_id", "form"]).select("vrow", "file_id", "line").distinct()


def running_footers(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(vrow, file_id, line) of the lines that come again at the bottom of at least three pages and half of their file."""
    rows, forms = edge_forms(marks, texts, "bottom")
    own = forms.where("pages >= 2").select("file_id", F.col("form").alias("other"), "form", "pages")
    near = near_forms(forms).where("other_pages >= 2").select("file_id", "other", "form", "pages")
    groups = own.unionByName(near)
    count = groups.groupBy("file_id", "other").agg(F.sum("pages").alias("n"))
    whole = texts.groupBy("file_id").agg(F.count_distinct("hash").alias("whole"))
    again = count.where("n >= 3").join(whole, "file_id").where("2 * n >= whole").select("file_id", "other")
    forms = groups.join(again, ["file_id", "other"], "left_semi").select("file_id", "form").distinct()
    return rows.join(forms, ["file_id", "form"]).select("vrow", "file_id", "line").distinct()


def page_numbers(marks: DataFrame) -> DataFrame:
    """(vrow, file_id, place) of the numbers that fit the sequence of their file."""
    rows = marks.where("tag = 'number'").select("vrow", "file_id", F.col("a").alias("style"), F.col("b").alias("place"), "n")
    seq = rows.groupBy("file_id", "style").agg(F.percentile_approx("n", 0.5).alias("mid"), F.count("*").alias("many"))
    fits = (F.col("many") < 3) | (F.abs(F.col("n") - F.col("mid")) <= 2 * F.col("many") + 20)
    return rows.join(seq, ["file_id", "style"]).where(fits).select("vrow", "file_id", "place")


def broken_words(marks: DataFrame, known: DataFrame) -> DataFrame:
    """(vrow, file_id, compound) of words broken at a line end; not those that the corpus knows better as compounds."""
    rows = marks.where("tag = 'break'").select("vrow", "file_id", "a", "b")
    count = lambda c, n: known.select(F.col("word").alias(c), F.col("texts").alias(n))
    rows = rows.join(count("a", "one"), "a", "left").join(count("b", "two"), "b", "left")
    # a break that no line shows otherwise counts in its own page as one word
    return rows.where("coalesce(two, 0) < greatest(coalesce(one, 0), 1)").select("vrow", "file_id", F.col("b").alias("compound"))


def fixes_of(table_: pa.Array, keys: pa.Array, places: pa.Array) -> pa.RecordBatch:
    """The corrections that apply to each page."""
    flat = table_.take(places.flatten())
    kept = [sorted({v for v in flat[a:b].drop_null().to_pylist()}) for a, b in _spans(places)]
    return pa.RecordBatch.from_arrays([keys, pa.array(kept, pa.list_(pa.string()))], ["key", "fixes"])


def _spans(places: pa.Array) -> list[tuple[int, int]]:
    at, out = 0, []
    for n in pc.list_value_length(places).fill_null(0).to_pylist():
        out.append(slice(at, at + n))
        at += n
    return [(s.start, s.stop) for s in out]


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, headers, footers, page numbers, broken words and corrections per page."""
    own = pages(spark, sf_dir)
    known = written(vocabulary(table(spark, sf_dir, "text_versions").select("text")), "vocabulary")
    marks = written(own.mapInArrow(marks_of, MARKS), "marks")
    texts = own.select("vrow", "file_id", F.xxhash64("text").alias("hash"))
    values = corrections(known).select("word", F.concat_ws("\0", "word", "right").alias("value"))
    batches = encoded(own.select("vrow", "text").dropDuplicates(["vrow"]), words_of)
    fixes = resolved(batches, values, "string", "key long, fixes array<string>", fixes_of).where("size(fixes) > 0").withColumnRenamed("key", "vrow")
    signs = marks.where("tag = 'sign'").select("vrow", F.array().cast("array<string>").alias("fixes"))
    return own, running_headers(marks, texts), running_footers(marks, texts), page_numbers(marks), broken_words(marks, known), fixes.unionByName(signs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, headers, _, numbers, broken, fixes = analysed(spark, sf_dir)
    kinds = ((headers, "header"), (numbers, "page_number"), (broken, "hyphen"), (fixes, "glyph"))
    out = None
    for rows, kind in kinds:
        part = rows.select("vrow", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def paragraphs(text: str, header: list[str], places: list[str], compounds: set[str], fixes: dict[str, str], footer: list[str]) -> str:
    """Continuous paragraphs of a page: without headers, footers and page numbers, words corrected, lines joined."""
    lines = SPACE.split(text)
    for place in places:
        i, kind = place.split()
        s = lines[int(i)].strip()
        lines[int(i)] = "" if kind == "line" else number_beside(s, kind)[1]
    there = [i for i, s in enumerate(lines) if s.strip()]
    for i in there[: DEPTH["top"]]:
        if lines[i].strip() in header:
            lines[i] = ""
    for i in there[-DEPTH["bottom"] :]:
        if lines[i].strip() in footer:
            lines[i] = ""
    text = "\n".join(lines).strip("\n")
    text = BREAK.sub(lambda m: m[1] + m[2] if f"{m[1]}-{m[2]}".lower() in compounds else f"{m[1]}-{m[2]}", text)

    def right(m: re.Match) -> str:
        word = m[0].replace("ﬁ", "fi").replace("ﬂ", "fl")
        fix = fixes.get(m[0].lower())
        if fix is None:
            return word
        return fix.upper() if word.upper() == word and len(fix) > 1 else fix.capitalize() if word[0].isupper() else fix

    text = WORD.sub(right, text)
    parts = re.split(r"\n[ \t]*\n+|\n(?=[ \t]{2,}\S)|\n(?=\d+(?:\.\d+)+\.?\s)", text)
    return "\n\n".join(p for p in (re.sub(r"[ \t]*\n[ \t]*", " ", x).strip() for x in parts) if p)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("text", "header", "places", "compounds", "fixes", "footer")]
        out = [paragraphs(t or "", h or [], p or [], set(c or []), dict(x.split("\0") for x in f or []), e or []) for t, h, p, c, f, e in zip(*cols)]
        yield pa.RecordBatch.from_arrays([b.column("vrow"), b.column("file_id"), pa.array(out, pa.string())], ["vrow", "file_id", "text"])


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vrow, file_id, text): the readable text of every page. What is collected per page are marks of its own lines."""
    own, headers, footers, numbers, broken, fixes = analysed(spark, sf_dir)
    key = ["vrow", "file_id"]
    rows = own.join(headers.groupBy(*key).agg(F.collect_set("line").alias("header")), key, "left")
    rows = rows.join(footers.groupBy(*key).agg(F.collect_set("line").alias("footer")), key, "left")
    rows = rows.join(numbers.groupBy(*key).agg(F.collect_set("place").alias("places")), key, "left")
    rows = rows.join(broken.groupBy(*key).agg(F.collect_set("compound").alias("compounds")), key, "left")
    rows = rows.join(fixes.groupBy("vrow").agg(F.flatten(F.collect_list("fixes")).alias("fixes")), "vrow", "left")
    return rows.mapInArrow(texts_of, "vrow long, file_id long, text string")
