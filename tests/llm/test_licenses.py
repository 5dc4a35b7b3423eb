from pyspark.sql import functions as F

from pitlake.llm.licenses import scan_licenses

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/b/code", "some words here\nand there"),
    ("a/b/c/apache", "x y z " * 50 + "\n# Licensed under the Apache License, Version 2.0 (the \"License\")\n" + "q r s " * 500),
    ("a/b/c/LICENSE", "Licensed under CC BY-NC 4.0."),
    ("a/b/c/d/deep", "nothing"),
    ("e/none", "the work of the public under no terms at all"),
    ("e/empty", ""),
    ("e/null", None),
    ("top", "alone"),
    (None, "Released under the MIT License."),
]


def test_headers_files_and_inheritance(spark):
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(FILES)], "doc_id long, file string, text string, license string")
    got = {r.path: (r.license, r.found, r.from_dir) for r in scan_licenses(df, F.col("file")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "file", None), "a/b/code": ("MIT", "inherited", "a"), "a/b/c/apache": ("Apache-2.0", "header", None), "a/b/c/LICENSE": ("CC-BY-NC-4.0", "file", None),
        "a/b/c/d/deep": ("CC-BY-NC-4.0", "inherited", "a/b/c"), "e/none": (None, None, None), "e/empty": (None, None, None), "e/null": (None, None, None), "top": (None, None, None),
        None: ("MIT", "file", None),
    }


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a/x", "Released under the MIT License.")] * 3, "doc_id long, file string, text string")
    assert [r.license for r in scan_licenses(df, F.col("file")).collect()] == ["MIT"] * 3
    assert scan_licenses(df.limit(0), F.col("file")).collect() == []


def test_null_and_shared_paths(spark):
    """Texts without a path, or with the same one, don't lend each other their licences."""
    rows = [(1, None, "plain words of a story"), (2, None, "Released under the MIT License."), (None, None, "more plain words"), (3, "a/x", "Released under the ISC License\n" + "tale " * 200), (4, "a/x", "tale " * 30)]
    df = spark.createDataFrame([(i, p, t, 1, "m") for i, p, t in rows], "doc_id long, file string, text string, line int, mark string")
    got = {r.doc_id: (r.license, r.found) for r in scan_licenses(df, F.col("file")).collect()}
    assert got == {1: (None, None), 2: ("MIT", "file"), None: (None, None), 3: ("ISC", "header"), 4: (None, None)}
