"""Running lines at both edges of scanned pages."""

from traceloom.llm import scans


def test_running_lines_at_both_edges(spark, store):
    def page(i, top, bottom):
        return f"{top}\nPage {'abcdefghij'[i]} tells of {'qwertzuiop'[i] * 9}.\nAnd of {'yxcvbnmasd'[i] * 9}.\n{bottom}"

    tops = {
        1: ["HARBOUR X OUTLINE", "HARBOUR OUTLINE", "HARB0UR OUTL#NE"],  # no two forms are the same
        2: ["SIGNAL REPORT", "?!x?\nSIGNAL REPORT", "THE FIRST LINE HERE"],  # a second line that is another page's first
        3: ["Yes indeed", "No, not so", "Perhaps so"],  # nothing comes again
        4: ["x" * 120, "x" * 120, "Alone"],  # however long
    }
    bottoms = {1: ["Harbour press", "Harbour press", "Harbour pzess"], 2: ["the end.", "the end.", "as agreed."], 3: [f"Line {c} ends here." for c in "abc"], 4: ["7", "8", "9"]}
    texts, seen, shown, n = [], [], [], 0
    for f in tops:
        for i in range(3):
            texts.append({"vrow": n, "device_id": "a", "id": n, "text": page(n % 10 if f < 4 else i, tops[f][i], bottoms[f][i])})
            seen.append({"device_id": "a", "id": n, "ts": n, "file_id": f, "capture_method": "ocr"})
            shown.append({"device_id": "a", "id": n, "observation_id": n, "text_version_id": n})
            n += 1
    d = store(text_versions=texts, observations=seen, occurrences=shown, files=[{"id": f, "path": f"/{f}.pdf"} for f in tops])
    assert {r["vrow"] for r in scans.p3_found(spark, d).where("kind = 'header'").collect()} == {0, 1, 2, 3, 4, 9, 10}
    out = {r["vrow"]: r["text"] for r in scans.p3_paragraphs(spark, d).collect()}
    assert all("HARB" not in out[v] and "Harb" not in out[v] for v in (0, 1, 2)) and all("SIGNAL" not in out[v] for v in (3, 4))
    assert out[3].endswith("the end.") and out[6].endswith("Line a ends here.") and out[6].startswith("Yes indeed")  # chance, not footers


def test_near_forms_are_found_without_a_twin(spark):
    forms = ["quarterlysummary", "quarterlysumary", "quartxrlysummzry", "quarterlyxxxmary", "abcdefghi", "abcxefghi", "short", "shorx"]
    rows = spark.createDataFrame([(1, f, 1, 0) for f in forms] + [(2, "quarterlysummary", 1, 0)], "file_id long, form string, pages long, place long")
    got = {(r["file_id"], r["form"], r["other"]) for r in scans.near_forms(rows).collect()}
    pairs = {("quarterlysummary", "quarterlysumary"), ("quarterlysummary", "quartxrlysummzry"), ("abcdefghi", "abcxefghi")}
    assert got == {(1, a, b) for a, b in pairs} | {(1, b, a) for a, b in pairs}


def test_number_beside_a_long_line():
    line = "HARBOUR " * 40
    assert scans.edge_lines(f"12   {line}\ntext\nmore\n{line}  -13-") == ([("top", 0, line.strip()), ("top", 1, "text"), ("bottom", 0, line.strip())], [(0, "left", "12"), (3, "right", "13")])
    assert scans.paragraphs(f"12   {line}\ntext", [line.strip()], ["0 left"], set(), {}, []) == "text"
