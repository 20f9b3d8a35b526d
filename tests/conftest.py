import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


OBSERVATIONS = "device_id string, id long, ts long, display_id long, app_id long, window_id long, url_id long, file_id long, `trigger` string, capture_method string, completeness string, visible_range string, source_state string, frame_hash string, thumb_ref string, deleted_at long, origin_device string, origin_id long, task int, block long"


SCHEMAS = {
    "observations": OBSERVATIONS,
    "apps": "id long, bundle_id string, name string, task int",
    "windows": "id long, app_id long, title string, salt int",
    "urls": "id long, raw_locator string, canonical_url string, host string, kind string",
    "files": "id long, path string",
    "text_versions": "vrow long, device_id string, id long, sha256 binary, text string, byte_len long, created_at long, key long",
    "occurrences": "device_id string, id long, observation_id long, text_version_id long, region string, ord int, confidence double, note string",
    "chunks": "vrow long, device_id string, text_version_id long, ord int, offset long, len long, chars long, embedded_at long, model string",
    "documents": "doc_id long, text string, lang string, title string, captured_at timestamp_ntz, key long, batch long",
    "size_limits": "name string, unit string, capacity long, overlap long",
}


def write(spark, path, rows):
    for name, schema in SCHEMAS.items():
        cols = [c.split()[0].strip("`") for c in schema.split(", ")]
        data = [tuple(r.get(c) for c in cols) for r in rows.get(name, [])]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_store(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture
def store(spark, tmp_path):
    """Writes small tables: store(observations=[{...}], windows=[...]); returns their folder. The tables have columns
    that no operator knows, with names that operators use inside."""
    return lambda **rows: write(spark, tmp_path, rows)
