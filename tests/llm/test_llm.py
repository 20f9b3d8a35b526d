"""Problems on texts: small cases, nulls, empty and long texts, ties, copies, empty tables, clashing names."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from traceloom.llm import mojibake, packing, personal, queries, runs, scans, splitting, tokens, words


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, store, name):
    assert queries.QUERIES[name](spark, store()).count() == 0


# 1 personal information
def kinds(text, url=False):
    return {k for _, _, k in personal.items(personal.folded(text, url)[0])}


def test_items_of_each_kind():
    assert kinds("write to van.x [at] post [dot] test") == {"email"}
    assert kinds("mail a.b＠example.org now") == {"email"}
    assert kinds("Tel: (415) 555-0151") == {"phone"} and kinds("call +33 1 99 00 23 21") == {"phone"}
    assert kinds("SSN / national ID: QQ 51 35 99 A") == {"id_number"}
    assert kinds("Ship to 99 North Heron Avenue") == {"address"} and kinds("Grüne Straße 94, Ort") == {"address"}
    assert kinds("https://a.test/login#user=jonas%40example.net&k=1", True) == {"email"}
    for text in ("The Kiln Lane sprint ends on Friday.", "Ticket 3906-2199-24 is closed.", "Pinned leftgrid@2.4.6", "icon-qfe@2x.png", "", "x" * 5000):
        assert not kinds(text), text


def test_names_are_learnt_and_replaced_in_place(spark, store):
    texts = [
        "From: Olga Wexholm\nplease write to olga.wexholm@example.org today", "Hi Olga,\nthe plan", "WEXHOLM signed", "wexholm asked", "olga blue", None, "",
        "联系人:周晚\n好", "联系人:周清\n好", "周晚已经确认", "他说周清晚了。", "nothing here", "Olga" + "​" + " Wexholm",
    ]
    d = store(
        text_versions=[{"vrow": i, "device_id": "a", "id": i, "text": t} for i, t in enumerate(texts)] * 2,
        windows=[{"id": 1, "app_id": 1, "title": "Chat with Olga Wexholm [1]"}, {"id": 2, "app_id": 1, "title": None}],
        urls=[{"id": 1, "raw_locator": "https://a.test/q?n=Olga+Wexholm&m=o.w%40b.test"}],
    )
    found = {tuple(r) for r in personal.p1_found(spark, d).collect()}
    assert {i for f, i, k in found if f == "text" and k == "name"} == {0, 1, 2, 3, 7, 8, 9, 10, 12}
    assert ("text", 0, "email") in found and ("title", 1, "name") in found and ("url", 1, "name") in found and ("url", 1, "email") in found
    out = {(r["field"], r["record_id"]): r["text"] for r in personal.p1_redacted(spark, d).collect()}
    assert out["text", 0] == "From: [NAME]\nplease write to [EMAIL] today" and out["text", 11] == "nothing here"
    assert out["text", 5] is None and out["text", 6] == "" and out["title", 1] == "Chat with [NAME] [1]"
    assert out["url", 1] == "https://a.test/q?n=[NAME]&m=[EMAIL]"


# 2 runs
def test_runs_equal_the_loop(spark, store):
    r = random.Random(3)
    titles = {1: "Plan part 1", 2: "● Plan part 1 (saving)", 3: "Plan part 2", 4: None, 5: "(3) plan  part 1", 6: "[09:09]"}
    rows = [
        {"device_id": r.choice("ab"), "display_id": r.choice([1, None]), "id": i, "ts": r.choice([0, 21_600_000, r.randrange(60_000_000)]) if i % 3 else r.randrange(21_000_000, 22_000_000), "app_id": r.choice([1, 1, 1, None]), "window_id": r.choice([1, 2, 1, 5, 3, 4, None, 6])}
        for i in range(3000)
    ]
    d = store(observations=rows + rows[:100] + [{"device_id": "a", "id": 5000, "ts": None}], windows=[{"id": i, "app_id": 1, "title": t} for i, t in titles.items()])
    name = {1: "plan part 1", 2: "plan part 1", 5: "plan part 1", 3: "plan part 2", 4: None, 6: "[09:09]", None: None}
    want = []
    for key in {(x["device_id"], x["display_id"]) for x in rows}:
        last = None
        for x in sorted((x for x in rows if (x["device_id"], x["display_id"]) == key), key=lambda x: (x["ts"], x["id"])):
            now = (x["app_id"], name[x["window_id"]])
            if last and last[0] == now and x["ts"] - last[1] < 300_000:
                want[-1][2], want[-1][3] = x["id"], want[-1][3] + 1
            else:
                want.append([key[0], x["id"], x["id"], 1])
            last = (now, x["ts"])
    got = {(x["device_id"], x["first_id"], x["last_id"], x["n"]) for x in runs.screen_runs(spark, d).collect()}
    assert got == {tuple(w) for w in want}
    assert {tuple(x) for x in runs.p2_found(spark, d).collect()} == {tuple(w[:3]) for w in want if w[3] > 1}


# 3 scans
def test_page_edges():
    assert scans.edges("") == (None, []) and scans.edges("\n \n") == (None, [])
    assert scans.edges("QUARTZ MANUAL\ntext here\n[12]")[1] == [(2, "line", "12")]
    assert scans.edges("12   QUARTZ MANUAL\ntext")[1][0][1:] == ("left", "12")
    assert scans.edges("3.1 Heading\ntext")[0] is None
    assert scans.number_of("xlii") == ("roman", 42) and scans.number_of("l2") == ("arabic", 12)
    assert scans.form_of("L1NDEN MANUA1") == scans.form_of("Linden Manual")


def test_pages_are_found_and_repaired(spark, store):
    body = "The training module was approved by the network group, and the budget report\nwas moved to the follow-\ning sprint."
    pages = [f"QUARTZ {'MANUAL' if i else 'MANUA1'}\n{body.replace('module', 'm0dule') if i == 2 else body}\nLine {chr(97 + i)} ends.\n{i + 5}" for i in range(4)]
    other = ["training module following approved network budget manual well-known sprint quartz"] * 12
    texts = [{"vrow": i, "device_id": "a", "id": i, "text": t} for i, t in enumerate([*pages, "A well-\nknown page.", None, *other])]
    seen = [{"device_id": "a", "id": i, "ts": i, "file_id": 1 if i < 4 else 2, "capture_method": "ocr"} for i in range(6)]
    shown = [{"device_id": "a", "id": i, "observation_id": i, "text_version_id": i} for i in range(6)]
    d = store(text_versions=texts, observations=seen * 2, occurrences=shown * 2, files=[{"id": 1, "path": "/a.PDF"}, {"id": 2, "path": "/b.tif"}, {"id": 3, "path": None}])
    got = {tuple(r) for r in scans.p3_found(spark, d).collect()}
    assert got == {(i, k) for i in range(4) for k in ("header", "page_number", "hyphen")} | {(2, "glyph"), (0, "glyph")}
    out = {r["vrow"]: r["text"] for r in scans.p3_paragraphs(spark, d).collect()}
    assert out[2] == body.replace("follow-\ning", "following").replace("\n", " ") + " Line c ends." and out[4] == "A well-known page." and out[5] == ""


# 4 splitting
@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n，。é漢x", max_size=600), st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_the_text(text, capacity, overlap):
    b = np.frombuffer(text.encode(), np.uint8)
    nodes, end, succ = splitting.successors(b, capacity, overlap)
    cuts = splitting.doubled(succ, np.array([0]))
    pieces = [(int(nodes[c]), int(end[c])) for c in cuts]
    at, greedy = 0, []
    while True:  # one after the other gives the same cuts
        greedy.append((int(nodes[at]), int(end[at])))
        if succ[at] == at:
            break
        at = int(succ[at])
    assert pieces == greedy
    lists = [[{"at": a, "end": e} for a, e in pieces]]
    assert splitting.usable(np.array([len(b)]), [np.flatnonzero((b & 0xC0) == 0x80)], lists, capacity, overlap)[0]


def test_recorded_pieces(spark, store):
    t = "é" * 30  # 60 bytes
    bad = {"gap": [(0, 40), (32, 28)], "start": [(2, 40), (32, 28)], "end": [(0, 40), (20, 38)], "inside": [(0, 41), (21, 39)], "large": [(0, 60)], "none": [], "null": [(0, None)]}
    good = {"two": [(0, 40), (20, 40)], "three": [(0, 30), (20, 30), (40, 20)]}
    cases = {**bad, **good}
    texts = [{"vrow": i, "device_id": "a", "id": i, "text": t, "byte_len": 1} for i in range(len(cases))]
    texts += [{"vrow": 90, "device_id": "a", "id": 90, "text": "short"}, {"vrow": 91, "device_id": "a", "id": 91, "text": None}]
    chunks = [{"vrow": i * 10 + o, "device_id": "a", "text_version_id": i, "ord": o, "offset": x, "len": n} for i, c in enumerate(cases.values()) for o, (x, n) in enumerate(c)]
    d = store(text_versions=texts, chunks=chunks[::-1], size_limits=[{"name": "piece", "unit": "bytes", "capacity": 50, "overlap": 10}])
    assert {r["vrow"] for r in splitting.p4_found(spark, d).collect()} == set(range(len(bad)))
    out = splitting.p4_pieces(spark, d).groupBy("vrow").count().collect()
    assert {r["vrow"] for r in out} == set(range(len(cases)))


# 7 and 8 tokens and containers
TEXTS = ["a b", "", None, "<|endoftext|> is text", "  two  spaces\n\n", "word " * 3000, "naïve 漢字 🙂", "x" * 3000, "a b"]


def test_ids_equal_whole_encoding_and_decode(spark, store):
    d = store(documents=[{"doc_id": i, "text": t} for i, t in enumerate(TEXTS)])
    whole = tokens.encoder(tokens.place(tokens.VOCABULARY))
    got = {r["doc_id"]: r["ids"] for r in tokens.p7_ids(spark, d).collect()}
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in tokens.p7_decoded(spark, d).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_word_batches_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(words, "BATCH_CHARS", 10)
    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, None), (3, "")], "key long, text string")
    out = words.encoded(df, str.split)
    assert out.where("words is null").count() == 4 and words.dictionary(out).select("word").distinct().count() == 2


def test_containers(spark, store):
    d = store(
        documents=[{"doc_id": i, "text": t} for i, t in enumerate(TEXTS)] + [{"doc_id": 100 + i, "text": "w " * (i % 37)} for i in range(400)],
        size_limits=[{"name": "container", "unit": "tokens", "capacity": 64, "overlap": 0}, {"name": "piece", "unit": "bytes", "capacity": 9, "overlap": 1}],
    )
    rows = packing.p8_containers(spark, d).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(TEXTS)), *range(100, 500)} and {r["container"] for r in rows} == {"container"}
    load, size = {}, {}
    for r in rows:
        load[r["bin"]] = load.get(r["bin"], 0) + r["n_tokens"]
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 64 and sum(load.values()) == sum(size.values())
    parts = [r["doc_id"] for r in rows if r["part"] > 0]
    assert all(size[i] > 64 for i in parts)
    fill = packing.p8_fill(spark, d).first()
    assert fill["bins"] <= 1.1 * fill["fewest"] + 1


def test_packer_keeps_its_bound():
    p = packing.Packer(100, 0)
    r = random.Random(1)
    for _ in range(5000):
        p.put(r.randint(0, 100))
        assert p.count <= packing.OPEN


# 9 wrong encodings
@pytest.mark.parametrize("name", mojibake.SINGLE)
def test_round_trips(name):
    text = "Die Größe – naïve café “so”…"
    try:
        wrong = text.encode().decode(name)
    except UnicodeDecodeError:
        wrong = "".join(bytes([b]).decode(name) if b < 0x80 or name not in ("cp1252", "cp1250", "cp1251") else _read(b, name) for b in text.encode())
    assert mojibake.repaired(wrong) == (text, True)


def _read(b, name):
    try:
        return bytes([b]).decode(name)
    except UnicodeDecodeError:
        return chr(b)


def test_nested_and_lost_and_right_texts():
    twice = "déjà vu".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repaired(twice) == ("déjà vu", True)
    assert mojibake.repaired("it鈥檚 fine") == ("it’s fine", True)
    assert mojibake.repaired("Проверьте архив заметок".encode("cp1251").decode("latin-1")) == ("Проверьте архив заметок", True)
    assert mojibake.repaired("it�s")[1]
    for text in (None, "", "plain", "naïve café", "The export shows “Ã©” where “é” is expected.", "├──────┼────┤", "ещё… «да»", "请先看一下搜索索引", "é" * 5000):
        assert mojibake.repaired(text) == (text, False), text


def test_copies_count_each(spark, store):
    d = store(documents=[{"doc_id": i, "text": t} for i, t in enumerate(["cafÃ©", "cafÃ©", "ok", None, ""])])
    assert {r["doc_id"] for r in mojibake.p9_found(spark, d).collect()} == {0, 1}
    assert {r["text"] for r in mojibake.p9_repaired(spark, d).collect()} == {"café"}
