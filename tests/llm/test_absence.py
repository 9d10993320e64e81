"""The rest of the library doesn't need this subpackage, and the pipeline doesn't hide its absence."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "chunkloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
        assert not any(n.startswith("chunkloom.llm") for n in names), path


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for i in range(1, 11) for n in names if n.startswith(f"op{i}_")].__len__() == 10 and "pipeline" in names
    assert {"op3_voronoi_knn", "op4_jaccard_join", "op5_exact_dedup"} <= set(__spark_entry__.oracle_sql())


def test_no_import_error_is_swallowed_outside_the_entry():
    for path in [ROOT / "corpus_pipeline.py", *(ROOT / "chunkloom" / "llm").glob("*.py")]:
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.ExceptHandler) and node.type is not None:
                assert "ImportError" not in ast.unparse(node.type)
