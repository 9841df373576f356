from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from codeloom.llm.storage import ship

    ship(spark)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """doc_id and text of all documents at the smallest scale."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
