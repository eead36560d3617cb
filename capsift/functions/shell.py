"""Shell text: words, tools, command-likeness, permission arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsift.functions.paths import looks_like_path, trim

# Words that are no tools.
RESERVED = [
    "if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "select", "time", "coproc",
    "let", "declare", "typeset", "local", "readonly", "export", "unset", "alias", "unalias", "source", "true", "false",
]
# Tools that make an inline snippet a command. One more, a product's own command line, is left out: its snippets are commands only by a rule.
CONTEXT_TOOLS = [
    "git", "gh", "npm", "pnpm", "yarn", "bun", "deno", "node", "python", "python3", "pip", "pip3", "docker", "docker-compose", "kubectl", "curl", "wget", "bd", "bash", "sh", "zsh",
]
# Captures that become arguments, in order.
ARGUMENT_KEYS = ["subcommand", "command", "url", "path", "file", "key", "value", "method", "host", "data", "header", "token", "tool"]
MAX_ARGUMENTS = 4


def strip_quotes(text: Column) -> Column:
    """One quote at either end goes, paired or not, then closing marks behind it, then white space."""
    # The quotes and the closing marks.
    out = F.regexp_replace(F.regexp_replace(text, "^['\"`]", ""), r"['\"`]\z", "")
    return trim(F.rtrim(out, F.lit(";,)")))


def normalize_tool(raw: Column) -> Column:
    """The tool's name, or null for what can't be one."""
    # The marks around a tool's name, its form and its greatest length.
    bare = F.lower(F.regexp_replace(F.regexp_replace(trim(raw), r"^['\"`(\[{]+", ""), r"[)\]}'\"`:,;]+$", ""))
    return F.when(F.rlike(bare, F.lit(r"^[a-z][a-z0-9+._-]*\z")) & (F.length(bare) <= 32) & ~bare.isin(RESERVED), bare)


def likely_tools(line: Column) -> Column:
    """In lower case what stands at the start of a line's commands; none for a comment, list item, sentence, assignment or literal."""
    text = trim(line)
    # What makes a line prose or a sentence.
    prose = F.rlike(text, F.lit(r"^(?:#|(?:[-*]|[0-9]+[.)])\s+|[A-Z]|[A-Za-z0-9_][A-Za-z0-9_.-]*\s*=|[{\[\"'])"))
    sentence = F.rlike(text, F.lit(r"^[A-Za-z0-9_][^$]*[.!?]\z")) & F.contains(text, F.lit(" "))
    starts = F.transform(F.split(text, r"[;&|()]\s*"), lambda c: F.lower(F.regexp_extract(c, r"^\S*", 0)))
    return F.when((F.length(text) > 0) & ~prose & ~sentence, F.array_distinct(starts)).otherwise(F.array().cast("array<string>"))


def likely_command_line(line: Column, tool: Column) -> Column:
    """Whether the tool stands at the start of a command of a line that looks like commands."""
    return F.array_contains(likely_tools(line), F.lower(tool))


def permission_args(metadata: Column, tool: Column) -> Column:
    """Up to four captured values in a fixed order; without any, the pattern's second word."""
    values = F.transform(F.array(*(F.lit(k) for k in ARGUMENT_KEYS)), lambda k: F.struct(k.alias("k"), trim(F.try_element_at(metadata, k)).alias("v")))
    usable = F.filter(values, lambda x: x["v"].isNotNull() & (x["v"] != "") & ~F.startswith(x["v"], F.lit("$")) & ~((x["k"] == "tool") & (F.lower(x["v"]) == tool)))
    found = F.slice(F.array_distinct(F.transform(usable, lambda x: x["v"])), F.lit(1), F.lit(MAX_ARGUMENTS))
    second = F.get(F.split(trim(F.try_element_at(metadata, F.lit("pattern"))), r"\s+"), 1)
    return F.when(F.size(found) > 0, found).when(second.isNotNull() & ~F.startswith(second, F.lit("$")), F.array(second)).otherwise(F.array().cast("array<string>"))


def allowed_tools(text: Column) -> Column:
    """array of struct(name, args) from a list such as `Read Bash(git:*)`."""
    token = r"^(\w+)(?:\(([^)]+)\))?$"
    parts = F.filter(F.split(trim(text), r"\s+"), lambda t: F.rlike(t, F.lit(token)))

    def parse(t: Column) -> Column:
        args = F.filter(F.split(F.regexp_extract(t, token, 2), r"[:\s,]+"), lambda a: a != "")
        return F.struct(F.regexp_extract(t, token, 1).alias("name"), F.when(F.size(args) > 0, args).otherwise(F.array(F.lit("*"))).alias("args"))

    return F.transform(parts, parse)


def inline_snippets(line: Column) -> Column:
    """What stands between single back quotes."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit("`([^`\n]+)`"), F.lit(1)), trim), lambda s: s != "")


def likely_inline_command(snippet: Column, line: Column, matches_rule: Column, known_tools: list[str]) -> Column:
    """Whether an inline snippet is a command: by a rule, or a known tool with arguments or beside a verb of execution."""
    # What is formatting, and the verbs of execution.
    bare = trim(F.regexp_replace(F.regexp_replace(trim(snippet), "^`+", ""), "`+$", ""))
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    formatting = F.rlike(bare, F.lit(r"^[*]{1,2}[^*]+[*]{1,2}$|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"))
    known = F.lower(F.get(tokens, 0)).isin(*CONTEXT_TOOLS, *known_tools)
    verb = F.rlike(F.coalesce(line, F.lit("")), F.lit(r"(?i)(?:^|[^A-Za-z0-9_])(?:run|execute|invoke|call|terminal|shell|command|cmd|bash|zsh|sh)(?:[^A-Za-z0-9_]|$)"))
    one = F.size(tokens) == 1
    return F.coalesce((bare != "") & ~formatting & ~(one & looks_like_path(bare)) & (matches_rule | (known & (~one | verb))), F.lit(False))
