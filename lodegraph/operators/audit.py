"""Rule scans over texts: a table of rules against documents gives findings with line and column."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodegraph.functions.names import style

FINDING = "doc_key string, rule_id string, scanner string, severity string, line int, column int, snippet string"
RULE = "rule_id string, severity string, kind string, extensions array<string>, pattern string"

#: Rules on program text: (id, severity, extensions, pattern), fixed values.
CODE_RULES = [
    ("security.openai-key", "critical", None, r"\bsk-[A-Za-z0-9_\-]{16,}\b"),
    ("security.aws-key", "critical", None, r"\bAKIA[0-9A-Z]{16}\b"),
    ("security.github-token", "critical", None, r"\bGH_PAT_[A-Za-z0-9_]{20,}\b"),
    ("security.password", "critical", None, r"""(?i)\bpassword\s*[:=]\s*["'][^"'\s]{4,}["']"""),
    ("security.dynamic-eval", "critical", ["ts", "tsx", "js", "jsx"], r"\beval\s*\("),
    ("security.new-function", "critical", ["ts", "tsx", "js", "jsx"], r"\bnew\s+Function\s*\("),
    ("security.inner-html", "error", ["ts", "tsx", "js", "jsx"], r"\bdangerouslySetInnerHTML\b"),
    ("security.rust-unsafe", "warning", ["rs"], r"\bunsafe\s*(?:\{|fn\b)"),
    ("ts.any-annotation", "error", ["ts", "tsx"], r":\s*any\b"),
    ("ts.as-any", "error", ["ts", "tsx"], r"\bas\s+any\b"),
    ("ts.non-null-assertion", "warning", ["ts", "tsx"], r"(?<=[A-Za-z0-9_$])!\s*[.(\[]"),
    ("ts.default-export", "error", ["ts", "tsx"], r"(?m)^\s*export\s+default\b"),
    ("theme.hardcoded-hex", "warning", ["css", "tsx", "jsx", "html"], r"#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{4}|[0-9a-fA-F]{3})\b"),
    ("theme.hardcoded-css-fn", "warning", ["css", "tsx", "jsx", "html"], r"\b(?:rgb|rgba|hsl|hsla)\s*\([^)]+\)"),
    ("perf.sync-io", "error", ["ts", "tsx", "js", "jsx"], r"\b(?:readFileSync|writeFileSync|existsSync|statSync|readdirSync)\s*\("),
    ("perf.keys-foreach", "info", ["ts", "tsx", "js", "jsx"], r"\bObject\.keys\s*\([^)]*\)\s*\.forEach\s*\("),
    ("a11y.img-alt", "error", ["tsx", "jsx", "html", "vue", "svelte"], r"""<img\b(?![^>]*\balt\s*=\s*["'])[^>]*>"""),
    ("a11y.anchor-href", "error", ["tsx", "jsx", "html", "vue", "svelte"], r"""<a\b(?![^>]*\bhref\s*=\s*["'])[^>]*>"""),
    ("security.sql-concat", "critical", ["ts", "tsx", "js", "jsx", "py", "rs"], r"""(?i)["'`](?:select|insert|update|delete)\b[^"'`\n]*["'`]\s*\+"""),
    ("ts.untyped-param", "warning", ["ts", "tsx"], r"\bfunction\s+\w+\s*\(\s*\w+\s*[,)]"),
    ("theme.missing-dark-variant", "warning", ["tsx", "jsx", "html"], r"""\bclass(?:Name)?=["'](?=[^"']*\b(?:bg|text)-(?:white|black)\b)(?![^"']*\bdark:)[^"']*["']"""),
    ("a11y.button-focus", "warning", ["tsx", "jsx", "html", "vue", "svelte"], r"<button\b(?![^<]*focus-visible)[^<]*>"),
    ("perf.array-from-in-loop", "warning", ["ts", "tsx", "js", "jsx"], r"\b(?:for|while)\s*\([^)]*\)\s*\{[^}]*\bArray\.from\s*\("),
    ("perf.unwrap-in-async", "warning", ["rs"], r"\basync\s+fn\b[^{]*\{[^}]*\.unwrap\(\)"),
    ("perf.many-state-updates", "info", ["ts", "tsx", "js", "jsx"], r"\bset[A-Z]\w*\((?:(?!\bset[A-Z])[\s\S]){0,100}\bset[A-Z]\w*\((?:(?!\bset[A-Z])[\s\S]){0,100}\bset[A-Z]\w*\("),
    ("secrets.jwt", "critical", None, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

#: Rules on prose: secrets, personal data and licence lines.
PROSE_RULES = [
    ("secrets.hex-token", "critical", None, r'token = "[0-9a-f]{40}"'),
    ("privacy.email", "warning", None, r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    ("privacy.ipv4", "info", None, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("privacy.card", "error", None, r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b"),
]


def _closing(text: str, at: int, pair: str = "()") -> int:
    """The place of the bracket that closes the one at `at`; -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    return -1


def _effects_without_deps(text: str):
    for m in re.finditer(r"\buseEffect\s*\(", text):
        end = _closing(text, m.end() - 1)
        if end >= 0 and not re.search(r",\s*\[[^\]]*\]\s*$", text[m.end() : end]):
            yield m


def _handlers_without_checks(text: str, ahead: int = 400):
    for m in re.finditer(r"\bipcMain\.(?:handle|on)\s*\(", text):
        if not re.search(r"\.(?:safeParse|parse|validate)\s*\(|\b(?:assert|is)[A-Z]\w*\s*\(", text[m.end() : m.end() + ahead]):
            yield m


def _icon_buttons(text: str):
    for m in re.finditer(r"<button\b([^<]*)>([\s\S]*?)</button>", text):
        if "aria-label" not in m[1] and not re.sub(r"<[^>]*>", "", m[2]).strip():
            yield m


#: Rules that one pattern can't say: (id, severity, extensions, text -> matches).
CODE_CHECKS = [
    ("perf.effect-without-deps", "warning", ["ts", "tsx", "js", "jsx"], _effects_without_deps),
    ("security.unchecked-handler", "error", ["ts", "tsx", "js", "jsx"], _handlers_without_checks),
    ("a11y.icon-button", "error", ["tsx", "jsx", "html", "vue", "svelte"], _icon_buttons),
]


def rules_table(spark: SparkSession, rules: list[tuple], kind: str = "forbidden") -> DataFrame:
    return spark.createDataFrame([(i, s, kind, e, p) for i, s, e, p in rules], RULE)


def _plan(rules: list[tuple], required: list[tuple] = ()) -> list[tuple]:
    finder = lambda p: p if callable(p) else re.compile(p).finditer
    return [(i, s, e, finder(p), True) for i, s, e, p in rules] + [(i, s, e, finder(p), False) for i, s, e, p in required]


def _found(plan: list[tuple], text: str | None, extension: str | None):
    """(rule_id, scanner, severity, line, column, snippet) of one text."""
    text = text or ""
    for rule, severity, extensions, matches, forbidden in plan:
        if extensions and extension not in extensions:
            continue
        scanner = rule.split(".")[0]
        if not forbidden:
            if next(iter(matches(text)), None) is None:
                yield rule, scanner, severity, 1, 0, ""
            continue
        line, seen = 1, 0
        for m in matches(text):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            yield rule, scanner, severity, line, m.start() - (text.rfind("\n", 0, m.start()) + 1), m[0][:80]


def scan(docs: DataFrame, rules: list[tuple], required: list[tuple] = (), extension: str | None = None) -> DataFrame:
    """Findings of docs (doc_key, text[, extension]): one for each match of a forbidden rule, one at line 1 for a required rule without a match.

    A rule with extensions looks at those alone.  Positions count lines from 1 and characters from 0.
    """

    def look(batches):
        plan = _plan(rules, required)
        for batch in batches:
            out = [(key, *f) for key, text, ext in zip(batch["doc_key"], batch["text"], batch["extension"]) for f in _found(plan, text, ext)]
            yield pd.DataFrame(out, columns=["doc_key", "rule_id", "scanner", "severity", "line", "column", "snippet"])

    ext = F.col(extension) if extension else F.lit(None).cast("string")
    return docs.select(F.col("doc_key").cast("string").alias("doc_key"), "text", ext.alias("extension")).mapInPandas(look, FINDING)


def _named(rules: str) -> list[tuple]:
    """Rules by `code`, `prose`, `all` or the names of scanners, with commas between."""
    every = CODE_RULES + CODE_CHECKS + PROSE_RULES
    sets = {"code": CODE_RULES + CODE_CHECKS, "prose": PROSE_RULES, "all": every}
    out = []
    for name in filter(None, (n.strip() for n in rules.split(","))):
        of = sets.get(name) or [r for r in every if r[0].split(".")[0] == name]
        if not of:
            raise ValueError(f"no rules are named {name}")
        out += [r for r in of if r not in out]
    return out


class ScanText:
    """scan_text(text, extension, rules): a row for each finding; rules are as in `_named` and must be a constant.

    A null text has no findings, a null extension those of the rules for any text; `analyze` refuses unknown rules before anything runs.
    """

    def __init__(self, analyzed=None) -> None:
        self.plan = _plan(_named(analyzed.rules))

    @staticmethod
    def analyze(text: AnalyzeArgument, extension: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        if not rules.isConstantExpression or rules.value is None:
            raise ValueError("the third argument of scan_text names rules and must be a constant")
        _named(rules.value)
        schema = T.StructType()
        for column in FINDING.split(", ")[1:]:
            name, kind = column.split()
            schema = schema.add(name, {"string": T.StringType(), "int": T.IntegerType()}[kind])
        return ScanRules(schema=schema, rules=rules.value)

    def eval(self, text, extension, rules):
        yield from _found(self.plan, text, extension)


@dataclass
class ScanRules(AnalyzeResult):
    rules: str = ""


def register(spark: SparkSession) -> None:
    """Make scan_text known to SQL."""
    spark.udtf.register("scan_text", F.udtf(ScanText))


def counts(docs: DataFrame, rules: list[tuple], key: str, text: str = "text") -> DataFrame:
    """(key, rule_id, n): how often each rule matches, without positions and so without Python."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for i, _, _, p in rules]))
    return docs.select(key, each.alias("r")).select(key, "r.rule_id", F.col("r.n").cast("long").alias("n")).filter("n > 0")


def dead_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_key, path): paths in back-ticks or links, with a slash, that no file has; addresses and anchors are left out."""
    ticks = F.regexp_extract_all("text", F.lit(r"`([./A-Za-z0-9_\-/]{2,256})`"), 1)
    links = F.regexp_extract_all("text", F.lit(r"\]\(([./A-Za-z0-9_\-/]{2,256})\)"), 1)
    each = docs.select("doc_key", F.explode(F.array_distinct(F.concat(ticks, links))).alias("raw"))
    each = each.filter(F.col("raw").contains("/") & ~F.col("raw").rlike("^(https?:|mailto:|#)")).withColumn("path", F.regexp_replace("raw", r"^\./", ""))
    return each.join(files.select("path").distinct(), "path", "left_anti").select("doc_key", "path")


def undeclared_channels(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """Channels that are used but nowhere declared."""
    return uses.join(declared.select("channel").distinct(), "channel", "left_anti")


#: Where channels are handled, called and declared, and the scripts that may do so (fixed values).
HANDLER = r"""\bipcMain\.(?:handle|on)\s*\(\s*['"]([^'"]+)['"]"""
CALL = r"""\bipcRenderer\.(?:invoke|send|on)\s*\(\s*['"]([^'"]+)['"]"""
BRIDGE = r"contextBridge\.exposeInMainWorld\s*\("
BRIDGE_KEY = r"(?m)^\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*:"
DECLARED = r"""['"]([a-z][a-z0-9:_\-./]*)['"]"""
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def declared_channels(types: DataFrame, text: str = "text") -> DataFrame:
    """(channel): the quoted channel names of files of types, each once."""
    return types.select(F.explode(F.regexp_extract_all(text, F.lit(DECLARED), 1)).alias("channel")).distinct()


def _named_at(docs: DataFrame, pattern: str) -> DataFrame:
    """docs with (channel, line) of each match of a pattern; lines are counted in what stands between the matches, and in those."""
    lines = lambda c: F.transform(c, lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"))))
    found = docs.withColumn("channels", F.regexp_extract_all("text", F.lit(pattern), 1)).filter(F.size("channels") > 0)
    found = found.withColumns({"between": lines(F.split("text", pattern, -1)), "within": lines(F.regexp_extract_all("text", F.lit(pattern), 0))})
    each = found.select("*", F.posexplode("channels").alias("pos", "channel"))
    before = "aggregate(slice(between, 1, pos + 1), 1, (x, n) -> x + n) + aggregate(slice(within, 1, pos), 0, (x, n) -> x + n)"
    return each.withColumn("line", F.expr(before)).drop("channels", "between", "within", "pos")


def channel_findings(docs: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_key, rule_id, severity, channel, line) of scripts (doc_key, extension, text) against the declared channels.

    Found are calls of a channel that is neither declared nor a key of a bridge in the same file, and handlers of channels that
    are not declared.  Without any declared channel nothing is found.
    """
    scripts = docs.filter(F.lower("extension").isin(*SCRIPTS)).select("doc_key", "text")
    keys = F.when(F.col("text").rlike(BRIDGE), F.regexp_extract_all("text", F.lit(BRIDGE_KEY), 1)).otherwise(F.array().cast("array<string>"))
    calls = _named_at(scripts.withColumn("keys", keys), CALL).filter(~F.array_contains("keys", F.col("channel")))
    row = lambda df, rule, severity: df.select("doc_key", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "channel", "line")
    both = row(calls, "ipc.unknown-channel", "error").union(row(_named_at(scripts, HANDLER), "ipc.handler-not-in-types", "warning"))
    return undeclared_channels(both, declared).join(declared.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_semi").select(*both.columns)


def unused_imports(docs: DataFrame) -> DataFrame:
    """(doc_key, name): imported names that stand in the text only once."""
    each = docs.select("doc_key", "text", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^import\s+\{?\s*([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name"))
    times = F.size(F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda w: w == F.col("name")))
    return each.filter(times <= 1).select("doc_key", "name")


def unreachable_functions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_key, name): functions whose name stands once in all texts, where it is declared."""
    names = docs.select("doc_key", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:function|fn|def)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("name"))
    words = docs.select(F.explode(F.split(text, "[^A-Za-z0-9_]+")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(words.filter("n = 1"), "name").select("doc_key", "name")


def unreferenced_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_key, name): types whose name stands once in all texts."""
    names = docs.select("doc_key", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:interface|struct|enum|class|type)\s+([A-Z][A-Za-z0-9_]*)"), 1))).alias("name"))
    words = docs.select(F.explode(F.split(text, "[^A-Za-z0-9_]+")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(words.filter("n = 1"), "name").select("doc_key", "name")


def renames(docs: DataFrame, text: str = "text", extension: str = "extension") -> DataFrame:
    """(doc_key, name, style): functions that are not named as their language does: camel in scripts, snake in Rust and Python."""
    each = docs.select("doc_key", extension, F.explode(F.regexp_extract_all(text, F.lit(r"\b(?:function|fn|def)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name"))
    script = F.col(extension).isin("ts", "tsx", "js", "jsx")
    wrong = F.when(script, F.col("name").contains("_")).otherwise(F.col("name").rlike("[A-Z]"))
    return each.filter(wrong).select("doc_key", "name", style(F.col("name")).alias("style"))


def open_findings(findings: DataFrame, rank, limit: int = 500) -> DataFrame:
    """Unresolved findings, worst first."""
    return findings.filter("resolved_at IS NULL").orderBy(F.desc(rank), "doc_key", "line", "column", "rule_id").limit(limit)
