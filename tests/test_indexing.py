import argparse

import pytest

from lodestrata import cli, toon
from lodestrata.embed import Embedder, HashingEmbedder, RetryWithSmallerBatch, encode_sorted, make_embedder
from lodestrata.plans.indexer import build_index
from lodestrata.plans.reader import SourceReader
from lodestrata.sources.discovery import count_source_files, gated_files
from lodestrata.sources.gitignore import compile_patterns, ignored


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_gates(spark, tmp_path):
    write(tmp_path, {
        "README.md": "# A\n", "config/eval.json": "{}", "pyproject.toml": "[a]\n", "src/pay.py": "x = 1\n", "node_modules/a.js": "", "secrets/env.json": "{}",
        "package-lock.json": "{}", "logo.png": b"\x89", ".gitignore": "secrets/\n*.log\n", "fixtures/a.json": "{}", "a.log": "",
    })
    found = sorted(r["path"] for r in gated_files(spark, str(tmp_path)).collect())
    assert found == ["README.md", "config/eval.json", "pyproject.toml", "src/pay.py"]
    assert count_source_files(spark, str(tmp_path)) == 4


@pytest.mark.parametrize("path, expected", [("a.log", True), ("x/a.log", True), ("secrets/k", True), ("secretsx", False), ("keep.log", False), ("doc/a/b.txt", True)])
def test_gitignore(path, expected):
    assert ignored(path, compile_patterns("*.log\n!keep.log\nsecrets/\ndoc/**/b.txt\n")) is expected


def test_incremental_life_cycle(spark, tmp_path):
    root, index = tmp_path / "repo", str(tmp_path / "index")
    write(root, {"keep.py": "def keep():\n    return 1\n", "gone.py": "def gone():\n    return 1\n", "bad.py": b"def bad():\n    return '\xff'\n"})
    embedder = HashingEmbedder(32)
    first = build_index(spark, str(root), index, embedder, repo="r")
    assert (first.added, first.deleted, first.embedded) == (3, 0, 3)
    again = build_index(spark, str(root), index, embedder, repo="r")
    assert (again.added, again.changed, again.unchanged, again.embedded) == (0, 0, 3, 0)
    (root / "gone.py").unlink()
    old = (root / "keep.py").read_text()
    write(root, {"keep.py": "def kept():\n    return 2\n"})
    third = build_index(spark, str(root), index, embedder, repo="r")
    assert (third.changed, third.deleted) == (1, 1)
    with SourceReader(spark, index) as reader:
        assert reader.index_info().chunks == 2 and reader.index_info().vectors == 2
        assert [e.symbol for e in reader.get_outline("keep.py")] == ["kept"]
        assert reader.find_paths("KEEP") == ["keep.py"]
        assert reader.semantic_search(["kept return"], embedder=embedder)[0].path == "keep.py"
        ids = [c.chunk_id for c in reader.get_chunks("keep.py")]
        assert set(reader.get_chunks_by_ids([*ids, "missing"])) == set(ids)
        with pytest.raises(RuntimeError):
            reader.semantic_search(["x"], embedder=HashingEmbedder(8))
        with pytest.raises(ValueError):
            reader.semantic_search(["  "], embedder=embedder)
        assert [x.text for x in reader.get_source_lines("keep.py", start_line=1, end_line=1)] == ["def kept():"]
    write(root, {"keep.py": old})  # back to older content: the chunks follow
    build_index(spark, str(root), index, embedder, repo="r")
    assert [e.symbol for e in SourceReader(spark, index).get_outline("keep.py")] == ["keep"]
    other = tmp_path / "second"
    write(other, {"new.py": "def new():\n    return 1\n"})
    build_index(spark, str(other), index, embedder, repo="s")  # another repository keeps the first one's rows
    assert SourceReader(spark, index).index_info().files == 3
    full = build_index(spark, str(root), index, embedder, repo="r", full=True)
    assert full.added == 2
    args = cli._parser().parse_args(["explore", "chunks", "keep.py", "--prose", "--db-path", index])
    assert "function  keep" in cli.run(args, spark, embedder)


def test_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SourceReader(spark, str(tmp_path / "none"))


class Picky(Embedder):
    dims, model_id = 1, "picky"

    def encode_documents(self, texts):
        if len(texts) > 2:
            raise RetryWithSmallerBatch
        return [[float(len(t))] for t in texts]


def test_length_order_and_halving():
    texts = ["x" * n for n in (50, 3, 900, 12, 7, 400, 1, 65, 30, 8, 200, 2)]
    assert [v[0] for v in encode_sorted(Picky(), texts)] == [float(len(t)) for t in texts]


def test_registry():
    assert make_embedder("HASHING").dims == 768
    with pytest.raises(ValueError):
        make_embedder("none")


def test_toon():
    assert toon.dumps({"rows": [{"a": 1, "b": "x,y"}]}) == 'rows[1]{a,b}:\n  1,"x,y"'
    assert isinstance(cli._parser(), argparse.ArgumentParser)
