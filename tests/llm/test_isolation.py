from __future__ import annotations

import pathlib
import re


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("moraine/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts and path.exists():
            assert not re.search(r"^\s*(from|import)\s+moraine\.llm", path.read_text(), re.M), path
