"""Source trees, manifests, Markdown, logs and transcripts as tables; snapshots, audited appends and exports as sinks."""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.relational import is_ignored_path

#: Languages by file extension (fixed values).
LANGUAGES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash",
    "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "html": "html", "css": "css", "lua": "lua", "sql": "sql",
}


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, language, bytes, text) of the text files under a folder; ignored folders and binary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(~is_ignored_path("path")).filter(~F.contains("content", F.lit(b"\x00")))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]
    return files.select("path", ext.alias("extension"), language.alias("language"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


NODE = "record string, kind string, name string, source string, target string, file_path string, line_start int, line_end int"


def _extract(path: str, text: str) -> list[tuple]:
    """Nodes and edges of one Python file."""
    ident = lambda start, kind: hashlib.sha256(f"{path}:{start}:{kind}".encode()).hexdigest()[:16]
    file_id = ident(0, "file")
    out = [("node", "file", path.rsplit("/", 1)[-1], file_id, None, path, 1, text.count("\n") + 1)]
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return out

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            below = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                below = ident(f"{child.lineno}.{child.col_offset}", kind)
                out.append(("node", kind, child.name, below, None, path, child.lineno, child.end_lineno))
                out.append(("edge", "contains", None, owner, below, path, child.lineno, child.lineno))
                for base in getattr(child, "bases", []):
                    out.append(("edge", "inherits", None, below, ast.unparse(base), path, child.lineno, child.lineno))
                for d in child.decorator_list:
                    out.append(("edge", "decoratedby", None, below, ast.unparse(d), path, d.lineno, d.lineno))
            elif isinstance(child, ast.Import):
                out.extend(("edge", "imports", None, owner, a.name, path, child.lineno, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("edge", "imports", None, owner, "." * child.level + (child.module or ""), path, child.lineno, child.lineno))
            elif isinstance(child, ast.Call):
                out.append(("edge", "calls", None, owner, ast.unparse(child.func), path, child.lineno, child.lineno))
            walk(child, below)

    walk(tree, file_id)
    return out


def syntax_graph(files: DataFrame) -> DataFrame:
    """Node and edge records of Python files (path, text)."""

    def each(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"]) for r in _extract(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")]).astype({"line_start": "int32", "line_end": "int32"})

    return files.select("path", "text").mapInPandas(each, NODE)


def commits(log: DataFrame) -> DataFrame:
    """(sha, author, committed_at, message) from lines `sha|author|ISO time|message`."""
    parts = F.split("value", r"\|", 4)
    at = F.try_to_timestamp(F.element_at(parts, 3))
    return log.filter(F.size(parts) == 4).select(parts[0].alias("sha"), parts[1].alias("author"), at.alias("committed_at"), parts[3].alias("message"))


def commit_files(numstat: DataFrame) -> DataFrame:
    """(sha, path, additions, deletions) from rows (sha, value) of numstat lines; - (binary) counts 0."""
    parts = F.split("value", "\t")
    n = lambda i: F.coalesce(F.expr(f"try_cast(split(value, '\t')[{i}] as bigint)"), F.lit(0))
    return numstat.filter(F.size(parts) == 3).select("sha", parts[2].alias("path"), n(0).alias("additions"), n(1).alias("deletions"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, package, version, is_dev) from package.json, requirements.txt and Cargo.toml texts (path, text)."""
    name = F.substring_index("path", "/", -1)
    npm = files.filter(name == "package.json")

    def section(field: str, dev: bool) -> DataFrame:
        deps = F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>")
        return npm.select("path", F.explode(deps).alias("package", "version"), F.lit(dev).alias("is_dev"))

    lines = files.filter(name == "requirements.txt").select("path", F.explode(F.split("text", "\n")).alias("line"))
    pip = lines.filter(F.col("line").rlike(r"^\s*[A-Za-z0-9_.\-]+")).select(
        "path", F.regexp_extract("line", r"^\s*([A-Za-z0-9_.\-]+)", 1).alias("package"), F.trim(F.regexp_extract("line", r"(?:[=<>~!]=?)\s*([^\s;#]+)", 1)).alias("version"), F.lit(False).alias("is_dev")
    )
    blocks = files.filter(name == "Cargo.toml").select("path", F.explode(F.expr("regexp_extract_all(text, '(?ms)^\\\\[((?:dev-)?dependencies)\\\\]\\n(.*?)(?=^\\\\[|\\\\z)', 0)")).alias("block"))
    cargo = blocks.select("path", F.col("block").startswith("[dev-").alias("is_dev"), F.explode(F.split("block", "\n")).alias("line")).filter(F.col("line").rlike("^[A-Za-z0-9_-]+\\s*="))
    cargo = cargo.select("path", F.regexp_extract("line", "^([A-Za-z0-9_-]+)", 1).alias("package"), F.regexp_extract("line", '"([^"]*)"', 1).alias("version"), "is_dev")
    return section("dependencies", False).union(section("devDependencies", True)).union(pip).union(cargo)


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, level, title, body): Markdown cut at its headings of one to three #; what stands before the first is left out."""
    parts = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"(?s)\n(#{1,3} [^\n]*(?:(?!\n#{1,3} ).)*)"), 1)
    each = docs.select(key, F.posexplode(parts).alias("pos", "part"))
    head = F.substring_index("part", "\n", 1)
    return each.select(
        key, "pos", F.length(F.regexp_extract(head, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(head, "^#+", "")).alias("title"),
        F.trim(F.expr("substring(part, length(substring_index(part, '\n', 1)) + 1)"), F.lit("\n ")).alias("body"),
    )


def markdown_parts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, links array<struct<label, target>>, code_blocks array<string>)."""
    labels = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)"), 1)
    targets = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)"), 2)
    code = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)
    return docs.select(key, F.arrays_zip(labels.alias("label"), targets.alias("target")).alias("links"), code.alias("code_blocks"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, turn, role, text) from lines of JSON."""
    return spark.read.schema("session string, turn long, role string, text string").json(path)


def append_once(rows: DataFrame, path: str, key: str, audit_path: str | None = None) -> int:
    """Append the rows whose key the table doesn't hold yet, and an audit row with a digest of each; how many there were."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
        if audit_path:
            digest = F.sha2(F.to_json(F.struct(*new.columns)), 256)
            new.select(F.col(key).cast("string").alias("key"), digest.alias("digest"), F.current_timestamp().alias("at")).write.mode("append").parquet(audit_path)
    new.unpersist()
    return n


def snapshot(tables: dict[str, DataFrame], path: str, version: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{version}/{name}")


def restore(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{version}/{name}")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML body: nodes, then edges."""
    def esc(c):
        out = F.col(c)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    n = nodes.select(F.lit(0).alias("ord"), F.format_string('<node id="%s"><data key="kind">%s</data></node>', esc("qualified_name"), esc("kind")).alias("value"))
    e = edges.select(F.lit(1), F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', esc("source"), esc("target"), esc("kind")))
    return n.union(e).orderBy("ord", "value").select("value")


def cypher_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.lit(0).alias("ord"), F.concat(F.lit("CREATE (:Node {id: "), q(F.col("qualified_name")), F.lit(", kind: "), q(F.col("kind")), F.lit("});")).alias("value"))
    e = edges.select(F.lit(1), F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) CREATE (a)-[:"), F.upper("kind"), F.lit("]->(b);")))
    return n.union(e).orderBy("ord", "value").select("value")


def jsonld_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.to_json(F.struct(F.col("qualified_name").alias("@id"), F.col("kind").alias("@type"), "name")).alias("value"))
    e = edges.select(F.to_json(F.struct(F.col("source").alias("@id"), F.col("kind").alias("relation"), F.col("target"))).alias("value"))
    return n.union(e)


READ_ONLY = re.compile(r"^\s*(select|with)\b", re.I)
WRITES = re.compile(r"^\s*(insert|update|delete)\b", re.I)


def allowed_sql(sql: str, writing: bool = False) -> bool:
    """One statement without comments that begins as a query, or, if writing, as an insert, update or delete."""
    text = re.sub(r"'(?:[^']|'')*'", "''", sql)
    body = text.strip().rstrip(";")
    return bool((WRITES if writing else READ_ONLY).match(body)) and ";" not in body and "--" not in body and "/*" not in body
