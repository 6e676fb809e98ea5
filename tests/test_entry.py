import ast
import os

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_nothing_outside_uses_the_subpackage():
    for folder, _, names in os.walk(os.path.join(HERE, "palimpsest")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    for node in ast.walk(ast.parse(f.read())):
                        imported = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any(m.startswith("palimpsest.llm") for m in imported), name
