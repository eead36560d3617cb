"""The rule table and its match: commands and calls joined with patterns by their first word.

A pattern is a row of that table: what its words must be, one by one, before and behind a run of any words. It is compared with the nodes of `commands.nodes`, word by word and field by field; no expression runs over
joined words, so the time of a match is linear in the node. `| sh` asks for what the command is piped to, `> $FILE` for what it is written to, `$($CMD)` for a substitution of one statement. The table is of fixed size, so it
is broadcast and joined on (grammar, first word), never tried rule by rule.

The secret rule and its word list are this project's own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.functions import shell
from capsift.operators import commands as source
from capsift.operators import patterns
from capsift.plans.tables import materialize

GENERIC = "shell-generic-command"
SECRET = "secret-bash-env-read-plain"
_PROMPT = ("PROMPT:prompt_override", "Prompt override attempt detected")

# Fixed values: (rule, grammar, patterns, tool, permission, scope, risk code, severity, message, which capture each value comes from), in order. `$NAME` captures one word or a
# part of it, `$$$NAME` stands for any number of words.
RULES = [
    ("net-curl", "bash", ["curl $URL", "curl -X $METHOD $URL", "curl --request $METHOD $URL", "curl $$$FLAGS -H $HEADER $$$REST", "curl $$$FLAGS --header $HEADER $$$REST", "curl $$$FLAGS $URL?token=$TOKEN"], "curl", "fetch", "net", "dynamic", "", "", {"method": "METHOD", "url": "URL", "header": "HEADER", "token": "TOKEN"}),
    ("net-wget", "bash", ["wget $URL", "wget --post-data=$DATA $URL"], "wget", "fetch", "net", "dynamic", "", "", {"url": "URL", "data": "DATA"}),
    ("net-pipe-shell", "bash", ["curl $$$ARGS | bash", "curl $$$ARGS | sh", "wget $$$ARGS | bash"], "bash", "shell", "sys", "NETWORK:remote_code_execution", "critical", "Remote output piped to shell", {}),
    ("fs-read-cat", "bash", ["cat $FILE", "less $FILE", "head $FILE", "tail $FILE"], "cat", "read", "fs", "", "", "", {"file": "FILE"}),
    ("fs-rm-rf", "bash", ["rm -rf $PATH", "rm -fr $PATH"], "rm", "write", "fs", "DESTRUCTIVE:destructive_behavior", "critical", "Recursive delete detected", {"path": "PATH"}),
    ("fs-chmod-777", "bash", ["chmod 777 $PATH", "chmod -R 777 $PATH"], "chmod", "write", "fs", "DESTRUCTIVE:permission_weakening", "warning", "Overly permissive chmod detected", {"path": "PATH"}),
    ("shell-git", "bash", ["git status", "git add $PATH", "git commit $$$ARGS", "git pull $$$ARGS", "git push $$$ARGS", "git checkout $BRANCH", "git merge $BRANCH", "git rebase $BRANCH", "git clone $URL", "git fetch $$$ARGS", "git log $$$ARGS"], "git", "shell", "sys", "", "", "", {"url": "URL", "branch": "BRANCH", "path": "PATH"}),
    ("shell-gh", "bash", ["gh pr $$$ARGS", "gh issue $$$ARGS", "gh repo $$$ARGS", "gh api $$$ARGS", "gh auth $$$ARGS"], "gh", "shell", "sys", "", "", "", {}),
    ("shell-npm", "bash", ["npm $SUB $$$ARGS"], "npm", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-pnpm", "bash", ["pnpm $SUB $$$ARGS"], "pnpm", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-yarn", "bash", ["yarn $SUB $$$ARGS"], "yarn", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-deno", "bash", ["deno $SUB $$$ARGS"], "deno", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-node", "bash", ["node $FILE $$$ARGS"], "node", "shell", "sys", "", "", "", {"file": "FILE"}),
    ("shell-pip", "bash", ["pip $SUB $$$ARGS", "pip3 $SUB $$$ARGS"], "pip", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-docker", "bash", ["docker run $$$ARGS", "docker exec $$$ARGS", "docker build $$$ARGS", "docker pull $$$ARGS", "docker push $$$ARGS"], "docker", "shell", "sys", "", "", "", {}),
    ("shell-docker-compose", "bash", ["docker-compose up $$$ARGS", "docker-compose down $$$ARGS", "docker compose up $$$ARGS", "docker compose down $$$ARGS"], "docker-compose", "shell", "sys", "", "", "", {}),
    ("shell-bd", "bash", ["bd ready", "bd show $ID", "bd update $ID $$$ARGS", "bd close $ID", "bd sync", "bd create $$$ARGS"], "bd", "shell", "sys", "", "", "", {"id": "ID"}),
    ("shell-sudo", "bash", ["sudo $CMD $$$ARGS"], "sudo", "sudo", "sys", "PRIVILEGE:privilege_escalation", "critical", "Privilege escalation via sudo", {"command": "CMD"}),
    ("shell-eval", "bash", ["eval $CMD", "eval \"$CMD\"", "eval '$CMD'"], "eval", "shell", "sys", "", "", "", {"command": "CMD"}),
    ("shell-sh-c", "bash", ["sh -c $CMD", "sh -c \"$CMD\"", "sh -c '$CMD'"], "sh", "shell", "sys", "", "", "", {"command": "CMD"}),
    ("shell-bash-c", "bash", ["bash -c $CMD", "bash -c \"$CMD\"", "bash -c '$CMD'"], "bash", "shell", "sys", "", "", "", {"command": "CMD"}),
    ("shell-source", "bash", ["source $FILE", ". $FILE"], "source", "read", "fs", "", "", "", {"file": "FILE"}),
    ("shell-openspec", "bash", ["openspec $SUB $$$ARGS"], "openspec", "shell", "sys", "", "", "", {"subcommand": "SUB"}),
    ("shell-cron", "bash", ["crontab $FILE", "echo $ENTRY | crontab -"], "crontab", "shell", "sys", "PERSISTENCE:persistence", "warning", "Persistence mechanism detected", {"file": "FILE"}),
    (GENERIC, "bash", ["$TOOL $$$ARGS"], "detected", "shell", "sys", "", "", "", {"tool": "TOOL"}),
    ("destructive-format", "bash", ["mkfs $DEVICE", "format $DEVICE"], "format", "write", "fs", "", "", "", {"device": "DEVICE"}),
    ("destructive-config-write", "bash", ["echo $VALUE > $FILE"], "write", "write", "fs", "", "", "", {"file": "FILE"}),
    ("inject-substitution", "bash", ["$($CMD)", "`$CMD`"], "bash", "shell", "sys", "INJECTION:command_injection", "warning", "Command substitution can enable injection", {"command": "CMD"}),
    (SECRET, "bash", ["$KEY"], "env", "read", "env", "SECRETS:secret_access", "warning", "Secret read from the environment", {"key": "KEY"}),
    ("net-fetch", "javascript", ["fetch($URL)", "fetch($URL, { method: $METHOD })", "fetch($URL, { headers: $HEADERS })", "fetch($URL, { method: $METHOD, headers: $HEADERS })"], "fetch", "fetch", "net", "dynamic", "", "", {"url": "URL", "method": "METHOD", "headers": "HEADERS"}),
    ("fs-read-js", "javascript", ["Deno.readTextFile($FILE)", "Deno.readFile($FILE)", "readFileSync($FILE)"], "read", "read", "fs", "", "", "", {"file": "FILE"}),
    ("fs-write-js", "javascript", ["Deno.writeTextFile($FILE, $CONTENT)", "Deno.writeFile($FILE, $CONTENT)"], "write", "write", "fs", "", "", "", {"file": "FILE"}),
    ("inject-eval", "javascript", ["eval($CODE)", "new Function($CODE)", "exec($CODE)"], "eval", "shell", "sys", "INJECTION:command_injection", "critical", "Dynamic code execution detected", {"code": "CODE"}),
    ("shell-subprocess-js", "javascript", ["Deno.Command($CMD)", "spawn($CMD)", "exec($CMD)"], "subprocess", "subprocess", "sys", "", "", "", {"command": "CMD"}),
    ("net-requests", "python", ["requests.get($URL)", "requests.post($URL, data=$DATA)", "requests.put($URL, data=$DATA)", "requests.patch($URL, data=$DATA)"], "requests", "fetch", "net", "dynamic", "", "", {"url": "URL", "data": "DATA"}),
]
# Rules on single lines of prose. Word boundaries are spelt out, so that every engine agrees.
_EDGE, _AFTER = r"(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
PROMPT_RULES = [
    ("prompt-ignore-previous", r"(?i)ignore previous instructions?", "critical"),
    ("prompt-forget-rules", r"(?i)forget (?:all )?(?:previous|earlier) rules", "critical"),
    ("prompt-reveal-system-prompt", rf"(?i)(?:reveal|show|print|dump|leak|disclose|output){_AFTER}(?:.{{0,79}}[^A-Za-z0-9_])?(?:system prompt|hidden instructions?)", "warning"),
    ("prompt-ignore-and-reveal", rf"(?i){_EDGE}(?:ignore|forget){_AFTER}(?:.{{0,79}}[^A-Za-z0-9_])?(?:previous|earlier){_AFTER}(?:.{{0,79}}[^A-Za-z0-9_])?(?:instructions?|rules?|system prompt)", "critical"),
]
#: Of each prompt rule, literals of which every match holds one.
PROMPT_LITERALS = {
    "prompt-ignore-previous": ["ignore previous instruction"],
    "prompt-forget-rules": ["previous rules", "earlier rules"],
    "prompt-reveal-system-prompt": ["system prompt", "hidden instruction"],
    "prompt-ignore-and-reveal": ["ignore", "forget"],
}
#: Own design: parts of the names of secrets.
SECRET_NAMES = r"(?i)(?:^|_)(?:token|secret|password|passwd|pwd|credentials?|api_?key|access_?key|private_?key|auth)(?:_|$)"
#: Tools that specific rules know.
KNOWN_TOOLS = sorted({r[3] for r in RULES if r[1] == "bash" and r[3] not in ("detected", "env")})


def secret_like(name: Column) -> Column:
    return F.rlike(name, F.lit(SECRET_NAMES))


_ITEM = "struct<kind: string, text: string, names: array<string>, fields: array<string>>"


def _item(word: str, names: dict) -> tuple:
    """What one word or argument of a pattern asks for: kind, text, the metadata that its captures become (null: none), the fields of an object."""
    captures = [names.get(n) for n in re.findall(r"\$([A-Z]+)", word)]
    if word.startswith("{"):  # an object with exactly these fields
        return "object", None, captures, [f.split(":")[0].strip() for f in word.strip("{}").split(",")]
    if not captures:
        return "is", word, [], None
    if re.fullmatch(r"\$[A-Z]+", word):
        return "any", None, captures, None
    if m := re.fullmatch(r"([\"'])\$[A-Z]+\1", word):
        return "quoted", m[1], captures, None
    if m := re.fullmatch(r"(\w+)=\$[A-Z]+", word):
        return "keyword", m[1], captures, None
    if m := re.fullmatch(r"(.*?=)\$[A-Z]+", word) if not word.startswith("$") else None:
        return "after", m[1], captures, None
    return "split", re.fullmatch(r"\$[A-Z]+(.+?)\$[A-Z]+", word)[1], captures, None


def compile_pattern(pattern: str, grammar: str, names: dict | None = None) -> dict:
    """head; before: items of the first words; middle: items behind a run of any words; run: whether there is one; open: whether any words may follow; pipe (words); redirect (metadata)."""
    if grammar == "bash":
        body, _, pipe = pattern.partition(" | ")
        body, _, redirect = body.partition(" > ")
        head, *rest = body.split(" ")
    else:
        (head, _, inside), pipe, redirect = pattern[:-1].partition("("), "", ""
        rest = re.split(r", (?![^{]*\})", inside)
    runs = [i for i, w in enumerate(rest) if w.startswith("$$$")]
    first = runs[0] if runs else len(rest)
    middle = [w for w in rest[first:] if not w.startswith("$$$")]
    names = names or {}
    items = lambda words: [_item(w, names) for w in words]
    return {"head": head, "before": items(rest[:first]), "middle": items(middle), "run": bool(runs), "open": bool(runs) and rest[-1].startswith("$$$"), "pipe": pipe.split(" ") if pipe else None, "redirect": names.get(redirect[1:])}


def rule_table(spark: SparkSession) -> DataFrame:
    """rule_seq, rule_id, grammar, tool, permission, scope, risk, severity, message: a row for each rule, TypeScript's too."""
    rows = [(i, r[0], r[1], *r[3:9]) for i, r in enumerate(RULES)]
    rows += [(len(RULES) + i, rule, "prompt", "", "", "", _PROMPT[0], severity, _PROMPT[1]) for i, (rule, _, severity) in enumerate(PROMPT_RULES)]
    return spark.createDataFrame(rows, "rule_seq int, rule_id string, grammar string, tool string, permission string, scope string, risk string, severity string, message string")


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = []
    for i, r in enumerate(RULES):
        if r[0] in (GENERIC, SECRET, "inject-substitution"):
            continue
        for j, p in enumerate(r[2]):
            c = compile_pattern(p, r[1], {v: k for k, v in r[9].items()})
            rows.append((i, r[0], r[1], j, c["head"], c["before"], c["middle"], c["run"], c["open"], c["pipe"], c["redirect"], p))
    return spark.createDataFrame(rows, f"rule_seq int, rule_id string, grammar string, pattern_seq int, head string, before array<{_ITEM}>, middle array<{_ITEM}>, run boolean, open boolean, pipe array<string>, redirect string, pattern string")


def _fits(item: Column, word: Column, shape: Column) -> Column:
    """Whether a word or argument is what an item asks for."""
    kind, text, n = item["kind"], item["text"], F.length(word)
    at = F.call_function("locate", text, word, F.lit(2))  # from the second character on: what stands before isn't empty
    ok = F.when(kind == "is", word == text).when(kind == "any", n > 0).when(kind == "quoted", (n > 2) & F.startswith(word, text) & F.endswith(word, text)).when(kind == "after", F.startswith(word, text) & (n > F.length(text)))
    ok = ok.when(kind == "split", (at > 1) & (n >= at + F.length(text))).when(kind == "object", (shape["form"] == "{") & (shape["keys"] == item["fields"]))
    return F.coalesce(ok.when(kind == "keyword", (shape["form"] == "=") & (F.get(shape["keys"], F.lit(0)) == text)), F.lit(False))


def _values(item: Column, word: Column, shape: Column) -> Column:
    """What an item's captures hold, in order."""
    kind, text = item["kind"], item["text"]
    at = F.call_function("locate", text, word, F.lit(2))
    cut = lambda a, n: F.substring(word, a, n)
    found = F.when(kind == "any", F.array(word)).when(kind == "quoted", F.array(cut(F.lit(2), F.length(word) - 2))).when(kind == "after", F.array(cut(F.length(text) + 1, F.length(word))))
    return found.when(kind == "split", F.array(cut(F.lit(1), at - 1), cut(at + F.length(text), F.length(word)))).when(kind.isin("object", "keyword"), shape["values"]).otherwise(F.array().cast("array<string>"))


def _captured(items: Column, at: Column) -> Column:
    """key and value of each capture of items that stand at a place of the arguments."""
    each = F.transform(items, lambda item, i: F.struct(item["names"].alias("names"), _values(item, F.get("words", at + i + 1), F.get("shapes", at + i)).alias("values")))
    pairs = F.flatten(F.transform(each, lambda e: F.transform(e["names"], lambda n, k: F.struct(n.alias("key"), shell.strip_quotes(F.get(e["values"], k)).alias("value")))))
    return F.filter(pairs, lambda p: p["key"].isNotNull() & (p["value"] != ""))


def match(found: DataFrame, keys: list[str], grammar: str) -> DataFrame:
    """found: the output of commands() or calls(). Returns keys, line, line_end, rule_seq, rule_id, pattern_seq, cmd_seq, extracted."""
    rules = F.broadcast(pattern_table(found.sparkSession).where(F.col("grammar") == grammar).drop("grammar"))
    each = found.withColumn("head", F.get("words", 0)).join(rules, "head")
    # arguments are read where they stand: a column of them alone would be built anew within each lambda
    n, first, more = F.size("words") - 1, F.size("before"), F.size("middle")
    all_fit = lambda items, at: F.forall(F.transform(items, lambda item, i: _fits(item, F.get("words", at + i + 1), F.get("shapes", at + i))), lambda ok: ok)
    each = each.where(F.when(F.col("run"), n >= first + more).otherwise(n == first)).where(all_fit(F.col("before"), F.lit(0)))
    each = each.where(F.col("pipe").isNull() | (F.col("pipe_to") == F.col("pipe"))).where(F.col("redirect").isNull() | F.col("redirect_to").isNotNull())
    # the first place where what stands behind the run fits
    places = F.when(more == 0, F.array(first)).when(F.col("open"), F.sequence(first, F.greatest(n - more, first))).otherwise(F.array(n - more))
    each = each.withColumn("at", F.when(more == 0, first).otherwise(F.get(F.filter(places, lambda p: all_fit(F.col("middle"), p)), 0))).where("at is not null")
    written = F.when(F.col("redirect").isNotNull(), F.array(F.struct(F.col("redirect").alias("key"), shell.strip_quotes(F.col("redirect_to")).alias("value"))))
    captured = F.concat(_captured(F.col("before"), F.lit(0)), _captured(F.col("middle"), F.col("at")), F.coalesce(written, F.array().cast("array<struct<key:string,value:string>>")))
    pairs = F.concat(captured, F.array(F.struct(F.lit("pattern").alias("key"), F.col("pattern").alias("value"))))
    # a repeated name keeps its first value
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return each.select(*keys, "line", "line_end", "rule_seq", "rule_id", "pattern_seq", "cmd_seq", F.map_from_entries(first).alias("extracted"))


def _index(rule: str) -> int:
    return next(i for i, r in enumerate(RULES) if r[0] == rule)


def generic_matches(found: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Any command whose line looks like one: the tool is its first word. Lines that do are joined by their tools, so no command carries its line."""
    lines = texts.select(*keys, F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "text"))
    starts = lines.select(*keys, (F.col("i") + 1).alias("line"), F.explode(shell.likely_tools(F.col("text"))).alias("tool"))
    each = found.withColumn("tool", shell.normalize_tool(F.get("words", 0))).where(F.col("tool").isNotNull()).join(starts, [*keys, "line", "tool"], "left_semi")
    extracted = F.create_map(F.lit("tool"), F.col("tool"), F.lit("pattern"), F.lit("$TOOL $$$ARGS"))
    return each.select(*keys, "line", "line_end", F.lit(_index(GENERIC)).alias("rule_seq"), F.lit(GENERIC).alias("rule_id"), F.lit(0).alias("pattern_seq"), "cmd_seq", extracted.alias("extracted"))


def _line_matches(texts: DataFrame, keys: list[str], rule: str, pattern: str, name: str, shown: str) -> DataFrame:
    each = texts.select(*keys, F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "text")).where(~F.rlike("text", F.lit(r"^\s*#")))
    each = each.select(*keys, (F.col("i") + 1).alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("cmd_seq", "value")).where("value <> ''")
    extracted = F.create_map(F.lit(name), shell.strip_quotes(F.col("value")), F.lit("pattern"), F.lit(shown))
    return each.select(*keys, "line", F.col("line").alias("line_end"), F.lit(_index(rule)).alias("rule_seq"), F.lit(rule).alias("rule_id"), F.lit(0).alias("pattern_seq"), "cmd_seq", extracted.alias("extracted"), "value")


def substitution_matches(found: DataFrame, keys: list[str]) -> DataFrame:
    """found: shell nodes. Substitutions that hold one statement, be it a pipe; those in back quotes on one line only, since a fence is a run of back quotes."""
    each = found.where("kind = 'substitution' and statements = 1 and (words[0] = '$(' or (words[0] = '`' and line = line_end))")
    dollar = F.get("words", 0) == "$("
    extracted = F.create_map(F.lit("command"), shell.strip_quotes(F.get("words", 1)), F.lit("pattern"), F.when(dollar, "$($CMD)").otherwise("`$CMD`"))
    return each.select(*keys, "line", "line_end", F.lit(_index("inject-substitution")).alias("rule_seq"), F.lit("inject-substitution").alias("rule_id"), F.when(dollar, 0).otherwise(1).alias("pattern_seq"), "cmd_seq", extracted.alias("extracted"))


def secret_matches(texts: DataFrame, keys: list[str]) -> DataFrame:
    each = _line_matches(texts, keys, SECRET, r"\$\{?([A-Za-z_][A-Za-z0-9_]*)", "key", "$KEY")
    return each.where(secret_like(F.col("value"))).drop("value")


def without_generic_duplicates(matches: DataFrame, keys: list[str]) -> DataFrame:
    """A generic match goes where a specific rule has matched the same line with the same tool."""
    rules = F.broadcast(rule_table(matches.sparkSession).select("rule_id", "tool"))
    specific = matches.where(F.col("rule_id") != GENERIC).join(rules, "rule_id").select(*keys, "line", F.lower("tool").alias("tool")).distinct()
    generic = matches.where(F.col("rule_id") == GENERIC).withColumn("tool", F.lower(F.try_element_at("extracted", F.lit("tool"))))
    return matches.where(F.col("rule_id") != GENERIC).unionByName(generic.join(specific, [*keys, "line", "tool"], "left_anti").select(*matches.columns))


def shell_matches(texts: DataFrame, keys: list[str]) -> DataFrame:
    found = materialize(source.nodes(texts, keys, "bash"), "nodes")  # read four times below, cut once
    calls = found.where("kind = 'call'")
    every = match(calls, keys, "bash").unionByName(generic_matches(calls, texts, keys)).unionByName(substitution_matches(found, keys)).unionByName(secret_matches(texts, keys))
    return without_generic_duplicates(materialize(every, "hits"), keys)  # read three times there


def code_matches(texts: DataFrame, keys: list[str], grammar: str) -> DataFrame:
    return match(source.calls(texts, keys, grammar), keys, grammar)


def prompt_matches(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of prose that try to override a prompt: one row for each rule and line."""
    found = patterns.line_matches(texts, keys, [(rule, regex, PROMPT_LITERALS[rule]) for rule, regex, _ in PROMPT_RULES])
    each = found.withColumn("rule_seq", F.col("rule") + len(RULES))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return each.select(*keys, "line", F.lit(None).cast("int").alias("line_end"), "rule_seq", "rule_id", F.lit(0).alias("pattern_seq"), F.col("line").alias("cmd_seq"), empty.alias("extracted"))


def inline_commands(snippets: DataFrame, keys: list[str]) -> DataFrame:
    """snippets: keys, snippet, line_text. Those that are commands."""
    texts = snippets.select(*keys, F.col("snippet").alias("content"))
    matched = match(source.commands(texts, keys), keys, "bash").select(*keys).distinct().withColumn("matched", F.lit(True))
    each = snippets.join(matched, keys, "left")
    ok = shell.likely_inline_command(F.col("snippet"), F.col("line_text"), F.coalesce("matched", F.lit(False)), KNOWN_TOOLS)
    return each.where(ok).drop("matched")


def rule_counts() -> tuple[int, int]:
    return len(RULES) + len(PROMPT_RULES), sum(len(r[2]) for r in RULES)


