"""A source tree made from the star-schema tables, so that operators on files have paths, extensions and texts to work on.

Each statement is plain SQL over {part} or {supplier} and says the same in Spark and elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodegraph.operators.text import spread as spread_out
from lodegraph.sources.tables import table

#: (id, folder, extension, path, text): one file for each part; what a file holds goes by remainders of its id.
FILES = """
SELECT id, folder, extension, concat(folder, '/f', id, '.', extension) AS path,
  CASE WHEN extension IN ('ts', 'tsx') THEN concat_ws(chr(10),
      CASE WHEN id % 8 = 0 THEN '// @intent: frozen - kept for the importer' END,
      concat('/// Reads part ', id, '. It is quick.'),
      concat('import { load', id, ' } from "./f', id + 20, '"'),
      CASE WHEN id % 3 = 0 THEN 'const value: any = 1' END,
      CASE WHEN id % 4 = 0 THEN 'const other = value as any' END,
      CASE WHEN id % 6 = 0 THEN 'eval(code)' END,
      CASE WHEN id % 7 = 0 THEN 'const key = "sk-abcdefghijklmnop1234"' END,
      CASE WHEN id % 9 = 0 THEN 'const rows = query("SELECT name FROM users WHERE id = " + id)' END,
      CASE WHEN id % 10 = 0 THEN 'useEffect(() => { start(a, b) })' END,
      CASE WHEN id % 10 = 1 THEN 'useEffect(() => { start() }, [a])' END,
      CASE WHEN id % 11 = 0 THEN 'setA(1); setB(2); setC(3);' END,
      CASE WHEN id % 12 = 0 THEN '<img src="a.png">' END,
      CASE WHEN id % 12 = 1 THEN '<button onClick={go}><Icon /></button>' END,
      CASE WHEN id % 12 = 2 THEN '<button className="focus-visible:ring" onClick={go}>Go</button>' END,
      CASE WHEN id % 13 = 0 THEN '<div className="bg-white text-black">' END,
      CASE WHEN id % 13 = 1 THEN '<div className="bg-white dark:bg-black">' END,
      CASE WHEN id % 14 = 0 THEN 'for (const a of b) { const c = Array.from(a) }' END,
      CASE WHEN id % 15 = 0 THEN 'ipcMain.handle("save", (event, data) => { write(data) })' END,
      CASE WHEN id % 15 = 1 THEN 'ipcMain.handle("open", (event, data) => { schema.parse(data) })' END,
      concat('function ', CASE WHEN id % 5 = 0 THEN 'read_' ELSE 'read' END, CASE WHEN id % 2 = 0 THEN 'All' ELSE 'all' END, id, '(x) { return ', CASE WHEN id % 17 = 0 THEN '1' ELSE concat('load', id, '(x)') END, ' }'),
      CASE WHEN id % 4 = 1 THEN concat('use(', CASE WHEN id % 5 = 0 THEN 'read_' ELSE 'read' END, 'all', id, ')') END,
      CASE WHEN id % 16 = 0 THEN concat('interface Shape', id, ' { a: number }') END)
    WHEN extension = 'rs' THEN concat_ws(chr(10),
      concat('/// Stores part ', id, '. It is safe.'),
      concat('use crate::m', id % 4, '::f', id + 20, ';'),
      CASE WHEN id % 3 = 0 THEN 'unsafe { read() }' END,
      CASE WHEN id % 4 = 0 THEN 'async fn go() { let a = b.unwrap(); }' END,
      concat('fn store', id, '(x: u32) {}'))
    WHEN extension = 'py' THEN concat_ws(chr(10),
      CASE WHEN id % 7 = 0 THEN '# deprecated: use the other one' END,
      concat('from .f', id + 20, ' import load'),
      concat('class Part', id, ':'),
      CASE WHEN id % 2 = 0 THEN '    openWidget = 1' ELSE '    max_size = 1' END,
      '    def run(self):', '        return load()')
    ELSE concat_ws(chr(10), concat('# Part ', id), concat('See `src/m', id % 4, '/f', id + 15, '.md` and [it](src/none/x', id, '.md).'),
      '## Use', 'Call it.', '## Limits', CASE WHEN id % 2 = 0 THEN 'None known.' END) END AS text
FROM (SELECT CAST(p_partkey AS BIGINT) AS id, concat('src/m', p_partkey % 4) AS folder,
        CASE p_partkey % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'tsx' WHEN 2 THEN 'rs' WHEN 3 THEN 'py' ELSE 'md' END AS extension FROM {part}) p
"""

#: (path, n): test files next to some of the files, with how many tests they hold.
TESTS = """
SELECT CASE WHEN extension IN ('ts', 'tsx') AND id % 2 = 0 THEN concat(folder, '/f', id, '.test.', extension)
            WHEN extension IN ('ts', 'tsx') THEN concat(folder, '/__tests__/f', id, '.test.', extension)
            WHEN extension = 'py' THEN concat('tests/test_f', id, '.py') ELSE concat('tests/f', id, '_test.rs') END AS path, 1 + id % 4 AS n
FROM (SELECT CAST(p_partkey AS BIGINT) AS id, concat('src/m', p_partkey % 4) AS folder,
        CASE p_partkey % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'tsx' WHEN 2 THEN 'rs' WHEN 3 THEN 'py' ELSE 'md' END AS extension FROM {part}) p
WHERE id % 3 = 0 AND extension <> 'md'
"""

#: (path, text): a manifest for each supplier, of one of three kinds.
MANIFESTS = """
SELECT concat('s', s_suppkey, '/', CASE s_suppkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' ELSE 'Cargo.toml' END) AS path,
  CASE s_suppkey % 3 WHEN 0 THEN concat('{"dependencies":{"lib', s_suppkey % 7, '":"1.', s_suppkey % 4, '"},"devDependencies":{"kit":"2.0"}}')
    WHEN 1 THEN concat_ws(chr(10), concat('lib', s_suppkey % 7, '==1.', s_suppkey % 4), '# a remark', 'other>=3')
    ELSE concat_ws(chr(10), '[package]', 'name = "x"', '[dependencies]', concat('lib', s_suppkey % 7, ' = "1.', s_suppkey % 4, '"'), '[dev-dependencies]', 'kit = "2.0"', '') END AS text
FROM {supplier}
"""


#: (path, text): for each customer a script that handles channels, calls them, or lays them open by a bridge.
CHANNEL_SCRIPTS = """
SELECT concat('app/c', c_custkey, '.ts') AS path, CASE c_custkey % 3
  WHEN 0 THEN concat_ws(chr(10), concat('ipcMain.handle("', lower(c_mktsegment), '", load)'), '', concat('ipcMain.on( ', chr(39), 'c', c_custkey, chr(39), ', save)'), 'ipcMain.handle("Upper", f)')
  WHEN 1 THEN concat_ws(chr(10), concat('const a = await ipcRenderer.invoke("load', c_custkey, '")'), 'ipcRenderer.send(', concat('  ', chr(39), lower(c_mktsegment), chr(39), ')'), 'ipcRenderer.on("done", f)')
  ELSE concat_ws(chr(10), 'contextBridge.exposeInMainWorld("api", {', concat('  load', c_custkey, ': () => ipcRenderer.invoke("load', c_custkey, '"),'), concat('  other: () => ipcRenderer.send("gone', c_custkey, '"),'), '})') END AS text
FROM {customer}
"""

#: (path, text): the types of channels, a file for each nation.
CHANNEL_TYPES = """
SELECT concat('types/n', n_nationkey, '.ts') AS path, concat('export type N', n_nationkey, ' = "load', 3 * n_nationkey + 1, '" | ', chr(39), 'c', 3 * n_nationkey, chr(39), ' | "Upper" | "building"') AS text FROM {nation}
"""

TABLES = ("nation", "part", "supplier", "orders", "events", "customer", "documents")


def made(spark: SparkSession, sf_dir: str, statement: str, spread: bool = False) -> DataFrame:
    """One of the statements above over the tables of sf_dir; with spread, keys are dealt to all cores before texts are made of
    them, for work in Python on tables of few splits."""
    for t in TABLES:
        if "{" + t + "}" in statement:
            view = f"made_{t}_{uuid.uuid4().hex}"
            rows = table(spark, sf_dir, t)
            (spread_out(rows) if spread else rows).createOrReplaceTempView(view)
            statement = statement.replace("{" + t + "}", view)
    return spark.sql(statement)


def for_sql(statement: str) -> str:
    """The statement with the tables' own names."""
    for t in TABLES:
        statement = statement.replace("{" + t + "}", t)
    return statement
