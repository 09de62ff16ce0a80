"""Queries against their SQL, and the registration."""

import ast
import re
from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from holdfast.llm import queries as registered

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_same_as_sql(spark, name):
    assert differences(registered.QUERIES[name](spark, SF), connect(SF), registered.ORACLE[name]) is None


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {re.match(r"op\d+", n)[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "repeated_lines", "near_copies", "benchmark", "tokens"]
    rows = corpus_pipeline.run(spark, SF)
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * total < rows.count() < total and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_nothing_else_imports_the_package():
    for path in (ROOT / "holdfast").rglob("*.py"):
        if "llm" not in path.parts:
            assert "holdfast.llm" not in path.read_text(), path


def test_no_local_files_or_row_collections():
    """Collected are only rows of a written bound: labelled samples, weights, alphabets and contexts, benchmark blocks, buckets, codebooks."""
    collects = {}
    for path in (ROOT / "holdfast" / "llm").glob("*.py"):
        source = path.read_text()
        ast.parse(source)
        assert not re.search(r"localCheckpoint|toPandas|\.rdd\b|crossJoin", source), path
        collects[path.name] = len(re.findall(r"\.collect\(\)|\.toLocalIterator\(\)|\.toArrow\(\)", source))
    assert {k: v for k, v in collects.items() if v} == {
        "decontaminate.py": 1, "html_region.py": 1, "importance.py": 1, "quality.py": 1, "suffix_tree.py": 1, "vector_codes.py": 3}
