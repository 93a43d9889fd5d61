"""Resolving what files say about each other: paths, imports, tests and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.relational import first_existing

#: What an import without extension may mean, tried in this order (fixed values).
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".rs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/mod.rs", "/__init__.py")


def plain_path(path: Column, root: str = "") -> Column:
    """With forward slashes, without the root and without ./ in front."""
    out = F.translate(path, "\\", "/")
    if root:
        out = F.when(out.startswith(root.rstrip("/") + "/"), F.substring(out, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(out)
    return F.regexp_replace(out, r"^(\./)+", "")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def joined_path(folder: Column, relative: Column) -> Column:
    """folder/relative with its . and .. steps taken; what would leave the root stays at it."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def match_paths(requests: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(request, path): the file that is meant, by the plain path, else by the ending where one file alone has it."""
    asked = requests.select("request", plain_path(F.col("request"), root).alias("plain")).distinct()
    known = files.select("path").distinct()
    exact = asked.join(known.withColumnRenamed("path", "plain"), "plain", "left_semi").select("request", F.col("plain").alias("path"))
    left = asked.join(exact.select("request"), "request", "left_anti")
    # A path has as many endings as folders above it; each meets the requests that are just that ending.
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    endings = known.filter(F.size(parts) > 1).select("path", F.explode(ends).alias("plain"))
    met = left.join(endings, "plain").groupBy("request").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    return exact.union(met.filter("n = 1").select("request", "path"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, spec, found) of relative imports (source, spec): the first file that exists among the spec's endings."""
    near = imports.filter(F.col("spec").rlike(r"^\.{1,2}/")).select("source", "spec", joined_path(folder_of(F.col("source")), F.col("spec")).alias("base"))
    rows = near.select("source", "spec", F.concat_ws("|", "source", "spec").alias("key"), F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS]).alias("candidates"))
    return rows.select("key", "source", "spec").join(first_existing(rows, "key", "candidates", files, "path"), "key").select("source", "spec", "found")


def test_candidates(path: Column) -> Column:
    """Where the tests of a file may stand, most likely first."""
    folder, file = folder_of(path), F.substring_index(path, "/", -1)
    base, ext = F.regexp_replace(file, r"\.[^.]*$", ""), F.substring_index(file, ".", -1)
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    beside = [of(folder, "/", base, mark, ext) for mark in (".test.", ".spec.", "_test.")]
    return F.array(
        *beside, of(folder, "/__tests__/", base, ".test.", ext), of(folder, "/tests/", base, "_test.", ext),
        of(folder, "/test_", base, ".", ext), of("tests/test_", base, ".", ext), of("tests/", base, "_test.", ext),
    )


def test_coverage(files: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, test_path, n_tests, covered) of every file (path, own): its own tests and those of the first test file that exists.

    tests: (path, n), how many tests each test file holds.
    """
    rows = files.select("path", "own", test_candidates(F.col("path")).alias("candidates"))
    paired = first_existing(rows, "path", "candidates", tests, "path").withColumnRenamed("found", "test_path")
    met = rows.select("path", "own").join(paired, "path", "left").join(tests.select(F.col("path").alias("test_path"), "n"), "test_path", "left")
    n = F.col("own") + F.coalesce("n", F.lit(0))
    return met.select("path", "test_path", n.alias("n_tests"), (n > 0).alias("covered"))


def canonical_symbol(language: Column, path: Column, text: Column, alias: dict[str, str] | None = None) -> Column:
    """The full name of what an import says: modules of Rust with ::, packages of Python with dots, paths of TypeScript.

    Rust: crate::, self:: and super:: (any number) against the file's module; Python: leading dots against its package;
    TypeScript: relative paths against its folder, and the first alias (prefix to path) that fits.
    """
    module = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"(/mod)?\.rs$", "")
    here = F.split(module, "/")
    supers = F.regexp_count(F.regexp_extract(text, r"^((super::)*)", 1), F.lit("super::"))
    rest = F.regexp_replace(text, r"^(super::)+", "")
    above = F.slice(here, 1, F.greatest(F.size(here) - supers, F.lit(0)))
    rust = (
        F.when(text.startswith("crate::"), F.substring(text, 8, 1 << 30)).when(text.startswith("self::"), F.concat_ws("::", F.array_join(here, "::"), F.substring(text, 7, 1 << 30)))
        .when(supers > 0, F.concat_ws("::", F.nullif(F.array_join(above, "::"), F.lit("")), rest)).otherwise(text)
    )
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    folder = F.split(folder_of(path), "/")
    package = F.slice(folder, 1, F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    python = F.when(dots > 0, F.concat_ws(".", F.nullif(F.array_join(package, "."), F.lit("")), F.regexp_replace(text, r"^\.+", ""))).otherwise(text)
    typescript = F.when(text.rlike(r"^\.{1,2}/"), joined_path(folder_of(path), text))
    for prefix, target in (alias or {}).items():
        typescript = typescript.when(text.startswith(prefix), F.concat(F.lit(target), F.substring(text, len(prefix) + 1, 1 << 30)))
    typescript = F.regexp_replace(typescript.otherwise(text), r"\.(tsx?|jsx?)$", "")
    return F.when(language == "rs", rust).when(language == "py", python).when(language.isin("ts", "tsx", "js", "jsx"), typescript).otherwise(text)


def doc_summary(text: Column, name: Column) -> Column:
    """The first sentence of the first doc comment, else what the first signature says, else the name."""
    comment = F.trim(F.regexp_extract(text, r"(?m)^\s*///\s*([^\n]*)", 1))
    first = F.regexp_extract(comment, r"^[^.!?]*[.!?]?", 0)
    signature = F.regexp_extract(text, r"(?m)^\s*((?:async )?(?:fn|def|function|class)\s+[A-Za-z0-9_]+)", 1)
    return F.when(first != "", first).when(signature != "", F.concat(F.lit("Defines "), signature, F.lit("."))).otherwise(name)


#: Words that a shape keeps (fixed values).
SHAPE_WORDS = ("fn", "function", "class", "struct", "enum", "impl", "trait", "interface", "type", "const", "let", "var", "if", "else", "for", "while", "match", "switch", "return", "async", "await", "import", "export", "use", "pub", "def")


def shape(text: Column, most: int = 512) -> Column:
    """Keywords and delimiters alone, at most so many characters: texts of one shape differ in names only."""
    found = F.regexp_extract_all(text, F.lit(r"\b(?:" + "|".join(SHAPE_WORDS) + r")\b|[{}()\[\];]"), 0)
    return F.substring(F.array_join(found, " "), 1, most)
