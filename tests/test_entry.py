"""The driver's contract, and that nothing outside the subpackage for language-model data needs it."""

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql():
    names, sql = set(entry.queries()), entry.oracle_sql()
    assert set(sql) <= names and len(names) > 50 and all(isinstance(s, str) and s.strip() for s in sql.values())


def test_flagship_plans_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS l_orderkey", "int(id % 8) AS l_linenumber", "double(id) AS l_quantity", "0.1D AS l_discount", "'A' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["rules_fused_lineitem"](spark, str(tmp_path))
    assert df.count() == 6 and df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    fused, alone = (sorted(map(tuple, entry.queries()[q](spark, str(tmp_path)).collect())) for q in ("rules_fused_lineitem", "rules_individual_lineitem"))
    assert fused == alone


def test_the_rest_imports_without_the_subpackage():
    code = "import sys; sys.modules['assaykit.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rules_fused_lineitem' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "assaykit").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            modules = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in m for m in modules), path
