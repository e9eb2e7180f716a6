import pytest


@pytest.fixture
def frame(spark):
    """documents with clashing extra columns, from a list of (doc_id, text)."""

    def make(rows):
        full = [(k, t, "slot", 1.5, "x") for k, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, score string, shard double, hit_spans string")

    return make


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables to a folder as the driver's are, and return it."""

    def make(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
