"""Recorded pieces that are no pieces of the text."""

import pytest

from traceloom.operators import vectors


def test_embedding_of_unusable_pieces(spark, store):
    text = "né à Köln 漢字 end"
    data = text.encode()
    at = [(0, len(data)), (2, 6), (0, data.index("漢".encode()) + 2), (3, len(data)), (-4, 3), (1 << 33, 2), (0, -1), (len(data), 0)]
    pieces = [{"vrow": i, "device_id": "a", "text_version_id": 1, "offset": a, "len": n} for i, (a, n) in enumerate(at)]
    pieces += [{"vrow": 90, "device_id": "a", "text_version_id": 2, "offset": 0, "len": 0}, {"vrow": 91, "device_id": "a", "text_version_id": 1, "offset": 0, "len": 2, "embedded_at": 1}]
    d = store(text_versions=[{"device_id": "a", "id": 1, "text": text}, {"device_id": "a", "id": 2, "text": None}], chunks=pieces)
    got = {r["vrow"]: r["v"] for r in vectors.embedded(spark, d).collect()}
    assert set(got) == {*range(len(at)), 90}
    for i, (a, n) in enumerate(at):
        inside = a >= 0 and n >= 0 and a + n <= len(data)
        assert got[i] == pytest.approx(vectors.hashed(data[a : a + n].decode(errors="replace") if inside else ""))
    assert any(got[1]) and any(got[2]) and not any(got[3]) and not any(got[90])
