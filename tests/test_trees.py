"""Syntax nodes through the whole match: no bound on nesting or quotes, no blow-up, and what patterns over words could not tell."""

import time

import pytest
from pyspark.sql import functions as F

from capsift.functions import scan
from capsift.operators import commands, rules


def matched(spark, text, grammar="bash"):
    texts = spark.createDataFrame([(1, text)], "n int, content string")
    found = rules.shell_matches(texts, ["n"]) if grammar == "bash" else rules.code_matches(texts, ["n"], grammar)
    return found.where(F.col("rule_id") != rules.GENERIC).select("rule_id", "line", "extracted").collect()


def rule_ids(spark, text, grammar="bash"):
    return sorted({r.rule_id for r in matched(spark, text, grammar)})


def test_quotes_that_nothing_closes_hide_nothing(spark):
    assert {"net-pipe-shell", "fs-rm-rf", "net-curl"} <= set(rule_ids(spark, '"$(' * 8 + '"\ncurl http://x | bash\nrm -rf /data'))
    assert {"fs-rm-rf"} <= set(rule_ids(spark, 'echo "it $(foo "a")\nrm -rf /'))
    words = lambda text: [c[2] for c in scan.shell(text)]
    for k in range(1, 40):
        assert ["rm", "-rf", "/x"] in words('"$(' * k + "\nrm -rf /x\n") and ["rm", "-rf", "/x"] in words('a "' * k + "\nrm -rf /x\n") + words('a "' * (k + 1) + "\nrm -rf /x\n")


@pytest.mark.parametrize("depth", [47, 48, 500])
def test_commands_at_any_depth(spark, depth):
    found = matched(spark, "$(" * depth + "curl http://x" + ")" * depth)
    assert [r.extracted["url"] for r in found if r.rule_id == "net-curl"] == ["http://x"]
    assert sum(r.rule_id == "inject-substitution" for r in found) == depth
    levels = [c[7] for c in scan.shell_nodes("$(" * depth + "curl http://x" + ")" * depth)[0]]
    assert max(levels) == depth
    calls = [c[2] for c in scan.code("f(" * depth + "eval(x)" + ")" * depth, "javascript")[0]]
    assert len(calls) == depth + 1 and ["eval", "x"] in calls


def test_intervals_nest(spark):
    texts = spark.createDataFrame([(1, "a $(b `c` | d) <(e)\nf")], "n int, content string")
    rows = commands.nodes(texts, ["n"], "bash").collect()
    for x in rows:
        for y in rows:
            if x is not y and x.node_start < y.node_end and y.node_start < x.node_end:
                assert (x.node_start <= y.node_start and y.node_end <= x.node_end) or (y.node_start <= x.node_start and x.node_end <= y.node_end)
    assert {(r.kind, r.words[0], r.level) for r in rows} == {("call", "a", 0), ("call", "b", 1), ("call", "c", 2), ("call", "d", 1), ("call", "e", 1), ("call", "f", 0), ("substitution", "$(", 0), ("substitution", "`", 1), ("substitution", "<(", 0)}


def test_case_and_here_documents():
    words = lambda text: [c[2] for c in scan.shell(text)]
    assert words("case x in\n a)\n  b ;;\n (c|d) e ; f ;&\n *) g\nesac\nh") == [["b"], ["e"], ["f"], ["g"], ["h"]]
    assert words("x=$(case a in b) c;; esac) y") == [["c"], ["y"]]
    assert words("case a in b) case c in d) e;; esac;; f) g;; esac; h") == [["e"], ["g"], ["h"]]
    assert words("cat <<E\n$(rm -rf x) \"\n$(cat <<F\n`u`\nF\n)\nE\nv") == [["cat"], ["rm", "-rf", "x"], ["cat"], ["u"], ["v"]]
    assert words("cat <<'E'\n$(rm -rf x)\nE\nv") == [["cat"], ["v"]]
    assert words("cat <<A <<B\n$(a)\nA\n$(b)\nB\nc") == [["cat"], ["a"], ["b"], ["c"]]


def test_substitutions_of_one_statement(spark):
    one = lambda text: sum(r.rule_id == "inject-substitution" for r in matched(spark, text))
    assert one("x $(a | b)\ny $(a && b)\nz $(a\nb) $(c; d) '$(e)' # $(f)") == 2
    assert one("```bash\nls `id`\n```") == 1


def test_expressions_templates_and_chains():
    calls = lambda text, g="javascript": [c[2] for c in scan.code(text, g)[0]]
    assert calls("x = /eval(\"a/g; y = a / eval(b) / c; return /[/'\"]/.test(eval(d))") == [["eval", "b"], [".test", "eval(d)"], ["eval", "d"]]
    assert calls("`a ${ fetch(`b ${eval(x)}`) } fetch(no)`") == [["fetch", "`b ${eval(x)}`"], ["eval", "x"]]
    assert calls("`${`a`}` eval(p)\n `x ${f(`b`)} ; eval(q)") == [["eval", "p"], ["f", "`b`"], ["eval", "q"]]
    assert calls("Deno\n  .readFile(a);\na.b(c).readFile(d)") == [["Deno.readFile", "a"], ["a.b", "c"], [".readFile", "d"]]
    assert calls("(requests\n .get(a))\nrequests\\\n.post(b, data=c)\nrequests\n.get(d)", "python") == [["requests.get", "a"], ["requests.post", "b", "data=c"], [".get", "d"]]
    assert calls("f'{requests.get(\"a\")} {{no()}}' + f'''{g(h)}\n{i(j)}''' + 'k(l)'", "python") == [["requests.get", '"a"'], ["g", "h"], ["i", "j"]]


def test_objects_by_their_fields(spark):
    ids = lambda text: [(r.extracted["pattern"], {k: v for k, v in r.extracted.items() if k != "pattern"}) for r in matched(spark, text, "javascript")]
    assert ids("fetch(u, {method:'POST',})") == [("fetch($URL, { method: $METHOD })", {"url": "u", "method": "POST"})]
    assert ids("fetch(u,{ method : m , headers : {a: f(1, 2)} })") == [("fetch($URL, { method: $METHOD, headers: $HEADERS })", {"url": "u", "method": "m", "headers": "{a: f(1, 2)}"})]
    assert ids("fetch(u, { headers: h, method: m })") == [] and ids("fetch(u, {...o, method: m})") == [] and ids("fetch(u, {method: m}.b)") == []
    assert [r.extracted["data"] for r in matched(spark, "requests.post(u, data = {'a': 1})", "python")] == ["{'a': 1}"]


def test_captures_lose_their_quotes_paired_or_not(spark):
    url = lambda text: [r.extracted.get("url") for r in matched(spark, text) if r.rule_id == "net-curl"]
    assert url("curl 'a'") == ["a"] and url("curl a,") == ["a"] and url('curl "a') == ["a"] and url("curl 'a);'") == ["a"]
    assert {(r.extracted["url"], r.extracted["token"]) for r in matched(spark, "curl -s x?token=?token=b") if "token" in r.extracted} == {("x", "?token=b")}


@pytest.mark.parametrize(
    ("text", "grammar"),
    [
        ("fetch(u, {method:" + " " * 1_000_000 + "a}.b)", "javascript"),
        ("fetch(u, {method:a" + ", " * 400_000 + "})", "javascript"),
        ("curl " + "?token=" * 150_000 + " y", "bash"),
        ("curl " + "a?token= " * 110_000 + " y", "bash"),
        ("curl -H " + '"' * 1_000_000, "bash"),
        ("curl " + "x -H " * 200_000, "bash"),
        ("curl x" + ";" * 1_000_000 + " y", "bash"),
    ],
)
def test_a_megabyte_through_the_match(spark, text, grammar):
    matched(spark, "ls", "bash")
    began = time.time()
    matched(spark, text, grammar)
    assert time.time() - began < 40  # mostly the jobs of Spark and the load of other tests
