import pytest
from pyspark.sql import functions as F

from lodestrata.operators import lines, scoring
from lodestrata.plans import reader
from lodestrata.schema import SearchOptions

FIELDS = "chunk_id string, path string, start_line int, end_line int, text string, symbol string, chunk_kind string"


def chunks(spark, *rows):
    return spark.createDataFrame([(*r, *([None] if len(r) == 5 else []), "function") for r in rows], FIELDS)


def vectors(spark, **found):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in found.items()], "chunk_id string, vector array<float>")


def search(spark, table, vecs, queries, **options):
    q = reader.query_table(spark, [t for t, _ in queries], [v for _, v in queries])
    return [r["chunk_id"] for r in reader.semantic_hits(table, vecs, q, SearchOptions(**options)).collect()]


@pytest.fixture()
def three(spark):
    table = chunks(spark, ("impl", "src/billing.py", 10, 20, "a"), ("test", "tests/test_billing.py", 30, 40, "b"), ("doc", "docs/billing.md", 1, 5, "c"))
    return table, vectors(spark, impl=[0.65, 0.76, 0], test=[0.7, 0.71, 0], doc=[0.69, 0.72, 0])


def test_tests_and_docs_are_demoted_unless_asked_for(spark, three):
    assert search(spark, *three, [("ranking", [1, 0, 0])], top_k=3)[0] == "impl"
    assert search(spark, *three, [("test ranking", [1, 0, 0])], top_k=3)[0] == "test"
    assert search(spark, *three, [("documentation ranking", [1, 0, 0])], top_k=3)[0] == "doc"


def test_best_score_over_queries_and_exclusion(spark, three):
    found = search(spark, *three, [("a", [1, 0, 0]), ("b", [0, 1, 0])], top_k=3, exclude_paths=("tests/%",))
    assert found == ["impl", "doc"]


def test_overlap_limit(spark):
    vecs = vectors(spark, a=[1, 0, 0], b=[0.99, 0.14, 0], c=[0.98, 0.2, 0])
    dropped = chunks(spark, ("a", "x.py", 1, 12, ""), ("b", "x.py", 8, 14, ""), ("c", "x.py", 40, 50, ""))
    assert search(spark, dropped, vecs, [("q", [1, 0, 0])]) == ["a", "c"]
    kept = chunks(spark, ("a", "x.py", 1, 12, ""), ("b", "x.py", 11, 21, ""))
    assert search(spark, kept, vecs, [("q", [1, 0, 0])]) == ["a", "b"]


def test_zero_vector_gives_nan(spark):
    row = scoring.score_blocks(vectors(spark, z=[0, 0, 0]), [[1, 0, 0]]).first()
    assert row["raw"] != row["raw"]


def test_line_matches(spark):
    table = chunks(spark, ("a", "x.py", 1, 3, "one\nTwo\nthree"), ("b", "x.py", 2, 4, "Two\nthree\nfour"), ("c", "y.py", 5, 40, "two\nx"))
    found = [tuple(r) for r in reader.find_text_lines(table, "two").select("path", "line_number", "text", "exact_line").collect()]
    assert found == [("x.py", 2, "Two", True), ("y.py", 5, "two", False)]


def test_outline_collapses_windows_but_not_unnamed(spark):
    table = chunks(spark, ("a", "x.py", 1, 20, "", "load"), ("b", "x.py", 19, 40, "", "load"), ("c", "x.py", 42, 50, "", "save"), ("d", "x.py", 60, 61, "", None), ("e", "x.py", 62, 63, "", None))
    found = [(r["symbol"], r["start_line"], r["end_line"]) for r in lines.outline(table).orderBy("start_line").collect()]
    assert found == [("load", 1, 40), ("save", 42, 50), (None, 60, 61), (None, 62, 63)]


def test_source_lines_are_rebuilt_once(spark):
    table = chunks(spark, ("a", "x.py", 1, 3, "1\n2\n3"), ("b", "x.py", 3, 5, "3\n4\n5"), ("c", "x.py", 2, 9, "wrong"))
    found = [(r["line_number"], r["text"]) for r in lines.source_lines(table, 2, 4).orderBy("line_number").collect()]
    assert found == [(2, "2"), (3, "3"), (4, "4")]


def test_arguments_are_checked(spark):
    table = chunks(spark, ("a", "x.py", 1, 3, ""))
    with pytest.raises(ValueError):
        reader.get_chunks(table, "x.py", 5, 2)
    with pytest.raises(ValueError):
        reader.find_paths(table, "x", 0)


def test_like_has_no_escape(spark):
    from lodestrata.functions.text import like

    rows = spark.createDataFrame([("a_b",), ("axb",), ("a\\_b",)], "path string")
    assert {r[0] for r in rows.where(like(F.col("path"), "a\\_b")).collect()} == {"a\\_b"}
    assert rows.where(like(F.col("path"), "a_b")).count() == 2
