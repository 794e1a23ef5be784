import pytest


@pytest.fixture(scope="session")
def documents():
    """Whole texts of the small documents table, by id."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}
