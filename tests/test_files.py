"""Classes of files, rule by rule, and files read from a folder."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import files as fl
from quarryline.sources.records import read_files

CASES = [
    ("wwwroot/lib/jquery.min.js", "vendor", "javascript"), ("a/packages/Lib.1.2.3/x.cs", "vendor", "csharp"), ("packages/app/x.ts", "source", "typescript"), ("obj/x.cs", "generated", "csharp"), ("x/bin/Debug/y.txt", "generated", "text"), ("bin/www", "other", "unknown"),
    ("Api.Designer.cs", "generated", "csharp"), ("yarn.lock", "lockfile", "unknown"), ("a.min.css", "minified", "css"), ("logo.PNG", "binary", "unknown"), ("img/logo.svg", "asset", "svg"), ("static/data", "asset", "unknown"), ("static/app.js", "source", "javascript"), ("public/manifest.json", "config", "json"),
    ("openapi.v1.yaml", "api_contract", "yaml"), ("Dockerfile", "infra", "dockerfile"), ("k8s/x.yml", "infra", "yaml"), (".github/workflows/x.yml", "infra", "yaml"), ("charts/a/x.tpl", "infra", "unknown"), ("pom.xml", "build_manifest", "xml"), ("x/App.csproj", "build_manifest", "xml"), ("src/test/java/X.java", "test", "java"),
    ("Shop.UnitTests/x.cs", "test", "csharp"), ("a.spec.ts", "test", "typescript"), ("LICENSE", "docs", "unknown"), ("docs/x.md", "docs", "markdown"), (".env", "config", "dotenv"), ("conf/x", "config", "unknown"), ("Conf/x.py", "source", "python"), ("x.PY", "source", "python"), ("noext", "other", "unknown"), (".hidden", "other", "unknown"), ("Makefile", "build_manifest", "make"), ("", "other", "unknown"),
]


def test_every_class_by_its_rule(spark):
    rows = spark.createDataFrame(CASES, "path string, want string, tongue string").withColumn("c", fl.classify_file(F.col("path"), F.lit(5)))
    assert [(r.path, r.c["class"], r.c.language) for r in rows.where("c.class != want or c.language != tongue").collect()] == []


def test_modes_sizes_and_first_bytes(spark):
    rows = [("a.py", 1, "160000", None, "submodule"), ("a.py", 1, "120000", b"\0", "symlink"), ("a.py", 1, "100644", b"x\0y", "binary"), ("a.py", 2_000_000, None, None, "large"), ("x.yaml", 1, None, b"apiVersion: v1\nkind: Pod", "infra"), ("x.yaml", 1, None, b"kind: Pod", "config"), ("x.py", None, None, b"\xff\xfe", "source")]
    got = spark.createDataFrame(rows, "path string, size long, mode string, head binary, want string").withColumn("c", fl.classify_file(F.col("path"), F.col("size"), F.col("mode"), F.col("head")))
    assert got.where("c.class != want").count() == 0
    assert [r.c.status for r in got.where("want in ('large', 'source', 'submodule')").orderBy("want").collect()] == ["skipped:large", "pending", "skipped:submodule"]
    assert spark.range(1).select(fl.classify_file(F.lit(None).cast("string"), F.lit(1))).first()[0] is None


def test_files_of_a_folder(spark, tmp_path):
    for name, data in (("src/a b.py", b"print()"), ("img/x.dat2", b"\0" * 9000), ("README", b"r"), ("empty", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.size, len(r.head), r.c["class"]) for r in read_files(spark, f"file://{tmp_path}").withColumn("c", fl.classify_file(F.col("path"), F.col("size"), head=F.col("head"))).collect()}
    assert got == {"src/a b.py": (7, 7, "source"), "img/x.dat2": (9000, 8192, "binary"), "README": (1, 1, "docs")}


@pytest.mark.parametrize(("names", "name", "met"), [(["*.a.b"], "x.a.b", True), (["*.a.b"], "xab", False), (["a+*"], "a+1", True), (["a"], "aa", False)])
def test_globs(names, name, met, spark):
    assert spark.range(1).select(F.lit(name).rlike(fl.one_of(names))).first()[0] is met
