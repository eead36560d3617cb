"""Commands of shell text, calls of code, and the references that they hold.

A task reads each text once (`functions.scan`) and gives its syntax nodes, each an interval of the text with a level: commands, substitutions, calls, imports. Everything behind that is declared on columns.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsift.functions import paths, scan

# Commands whose arguments are files.
FILE_COMMANDS = ["cat", "cp", "mv", "ln", "touch", "mkdir", "rm", "chmod", "chown", "open", "exec", "read"]
# Calls that fetch an address, and calls on files.
FETCH_CALLS = r"^(?:fetch|axios\.(?:get|post|put|delete|patch|head)|XMLHttpRequest|request|got|superagent)$"
FILE_CALLS = r"^fs\.(?:readFile|writeFile|appendFile|open|access|stat|unlink|mkdir|rmdir|rename|copyFile)$"
_ROWS = 2000
_SHAPE = pa.struct([("form", pa.string()), ("keys", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])
_FOUND = pa.schema([
    ("kind", pa.string()), ("line", pa.int32()), ("line_end", pa.int32()), ("cmd_seq", pa.int32()), ("words", pa.list_(pa.string())), ("pipe_to", pa.list_(pa.string())), ("redirect_to", pa.string()), ("first", pa.string()),
    ("shapes", pa.list_(_SHAPE)), ("statements", pa.int32()), ("node_start", pa.int64()), ("node_end", pa.int64()), ("level", pa.int32()),
])
_SQL = (
    "kind string, line int, line_end int, cmd_seq int, words array<string>, pipe_to array<string>, redirect_to string, first string, "
    "shapes array<struct<form: string, `keys`: array<string>, `values`: array<string>>>, statements int, node_start bigint, node_end bigint, level int"
)


def _rows(grammar: str, text: str) -> list[tuple]:
    if grammar == "bash":
        commands, inside = scan.shell_nodes(text)
        found = [("call", a, b, n, words, pipe, to, None, None, None, start, end, level) for n, (a, b, words, pipe, to, start, end, level) in enumerate(commands)]
        return found + [("substitution", a, b, n, [mark, held], None, None, None, None, statements, start, end, level) for n, (a, b, mark, statements, held, start, end, level) in enumerate(inside)]
    calls, imports = scan.code_nodes(text, grammar)
    shape = lambda arg: None if arg[1] is None else dict(zip(("form", "keys", "values"), arg[1:]))
    found = [("call", a, b, n, [name, *(x[0] for x in args)], None, None, first, [shape(x) for x in args], None, start, end, level) for n, (a, b, name, args, first, start, end, level) in enumerate(calls)]
    return found + [(word, line, line, n, [name], *[None] * 8) for n, (line, word, name) in enumerate(imports)]


def _cut(grammar: str, batches):
    """For each row (keys, content) its nodes."""
    for b in batches:
        keys, rows, at = b.drop_columns(["content"]), [], []

        def out():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)]
            return pa.RecordBatch.from_arrays([*keys.take(pa.array(at)).columns, *columns], names=[*keys.schema.names, *_FOUND.names])

        for i, text in enumerate(b.column("content")):
            found = _rows(grammar, text.as_py() or "")
            for k in range(0, len(found), _ROWS):
                rows += found[k : k + _ROWS]
                at += [i] * len(found[k : k + _ROWS])
                if len(rows) >= _ROWS:
                    yield out()
                    rows, at = [], []
        if rows:
            yield out()


def nodes(texts: DataFrame, keys: list[str], grammar: str) -> DataFrame:
    """texts: keys (they tell rows apart) and content. Returns keys, and of each node: kind (`call`, `substitution`, or the word of an import), line, line_end, cmd_seq (its number among the nodes of its kind, by place), words (of a
    command; of a call its name, then the arguments as they stand; of a substitution its mark and what is within), pipe_to (the words it is piped to), redirect_to, first (the first string within a call), shapes (of arguments that are
    objects or keywords), statements (of a substitution), and its interval: node_start, node_end, level."""
    own = texts.select(*keys, "content")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "content")
    return own.mapInArrow(partial(_cut, grammar), f"{kinds}, {_SQL}")


def commands(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The commands of shell text."""
    return nodes(texts, keys, "bash").where("kind = 'call'").drop("kind")


def calls(texts: DataFrame, keys: list[str], grammar: str = "javascript") -> DataFrame:
    """The calls of code."""
    return nodes(texts, keys, grammar).where("kind = 'call'").drop("kind")


def _refs(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """values: references of a command or call in order; `rank` of df, where it has one, comes before the place."""
    each = df.select(*keys, "line", "cmd_seq", (F.col("rank") if "rank" in df.columns else F.lit(0)).alias("rank"), F.posexplode(values).alias("no", "r"))
    seq = F.shiftleft(F.col("rank").cast("long"), 56) + F.shiftleft(F.col("cmd_seq").cast("long"), 28) + F.col("no")
    return each.select(*keys, seq.alias("ref_seq"), "r.ref_path", "line", "r.via")


def shell_references(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ref_seq, ref_path, line, via of shell text: includes, fetched addresses, host files, script paths and path-like first arguments."""
    head, rest = F.get("words", 0), F.slice("words", F.lit(2), F.size("words"))
    first = F.get("words", 1)
    tag = lambda p, via: F.struct(p.alias("ref_path"), F.lit(via).alias("via"))
    some = lambda values, via: F.transform(values, lambda p: tag(p, via))
    one = lambda ok, p, via: F.when(ok, F.array(tag(p, via))).otherwise(F.array().cast("array<struct<ref_path:string,via:string>>"))
    path = lambda p: F.coalesce(paths.looks_like_path(p) & ~paths.is_url(p), F.lit(False))
    values = (
        F.when(head.isin("source", "."), one(F.coalesce(paths.looks_like_path(first), F.lit(False)), first, "source"))
        .when(head.isin("curl", "wget"), some(F.filter(rest, paths.is_url), "url"))
        .when(head.isin(FILE_COMMANDS), some(F.filter(rest, lambda w: ~F.startswith(w, F.lit("-")) & paths.is_host_path(w)), "bare-path"))
        .otherwise(F.concat(one(path(head), head, "bare-path"), one(path(first), first, "bare-path")))
    )
    return _refs(commands(texts, keys), keys, values)


def _code_references(texts: DataFrame, keys: list[str], grammar: str, kinds: list[tuple]) -> DataFrame:
    """kinds, in order: (which rows, whether the reference counts, via). Of a call the first string within is the reference."""
    found = nodes(texts, keys, grammar)
    ref = F.when(F.col("kind") == "call", F.col("first")).otherwise(F.get("words", 0))
    rank, via = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (which, ok, name) in reversed(list(enumerate(kinds))):
        hit = which & F.coalesce(ok(ref), F.lit(False))
        rank, via = F.when(hit, i).otherwise(rank), F.when(hit, name).otherwise(via)
    each = found.select(*keys, "line", "cmd_seq", ref.alias("ref_path"), rank.alias("rank"), via.alias("via")).where("rank is not null")
    return _refs(each, keys, F.array(F.struct("ref_path", "via")))


def _named(pattern: str) -> Column:
    return (F.col("kind") == "call") & F.rlike(F.get("words", 0), F.lit(pattern))


def _any(ref: Column) -> Column:
    return ref != ""


def python_references(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Imports, opened host paths and requested addresses of Python code."""
    kind = F.col("kind")
    return _code_references(texts, keys, "python", [(kind == "import", _any, "import"), (kind == "from", _any, "import"), (_named("^open$"), paths.is_host_path, "bare-path"), (_named("^(?:requests|urllib)"), paths.is_url, "url")])


def script_references(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Imports, re-exports, requires, fetched addresses and host files of JavaScript and TypeScript code."""
    kind = F.col("kind")
    kinds = [(kind == "import", _any, "import"), (kind == "export", _any, "import"), (_named("^require$"), _any, "import"), (_named(FETCH_CALLS), paths.is_url, "url"), (_named(FILE_CALLS), paths.is_host_path, "bare-path")]
    return _code_references(texts, keys, "javascript", kinds)
