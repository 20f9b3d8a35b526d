"""Deletion on values that small tables don't have."""

from traceloom.operators import deletion


def test_quota_beyond_32_bits(spark, store):
    d = store(text_versions=[{"device_id": "a", "id": 1, "text": "abcd"}], observations=[{"device_id": "a", "id": 1, "ts": 1}], occurrences=[{"device_id": "a", "id": 1, "observation_id": 1, "text_version_id": 1}])
    for quota in (300_000_000, 3_000_000_000):  # eight times each is more than an int holds
        assert [tuple(r) for r in deletion.expiry(spark, d, quota).select("used", "expired", "level").collect()] == [(4, 0, "ok")]
    assert [tuple(r) for r in deletion.expiry(spark, d, 2).select("used", "expired", "level").collect()] == [(4, 200, "warn")]
