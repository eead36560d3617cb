import time

import pytest
from pyspark.sql import functions as F

from capsift import config as cfg
from capsift.functions import ids, paths, risk, scan, shell, urls


def values(spark, rows, function, schema="a string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(function(*(F.col(c) for c in df.columns)).alias("x")).collect()]


def one(spark, items, function):
    return values(spark, [(x,) for x in items], function)


def test_file_types_and_roles(spark):
    assert one(spark, ["a.MD", "x/y.tsx", "bash", "p.tar", "q", "n.ini", None], paths.file_type) == ["markdown", "typescript", "bash", "binary", "unknown", "config", "unknown"]
    got = one(spark, ["SKILL.md", "d/skill.MD", "a/references/x", "references/x", "License.txt", "docs/README", "a/scripts/r", "scripts/r", ".env.example", "z.py"], paths.file_role)
    assert got == ["entrypoint", "entrypoint", "reference", "regular", "license", "readme", "script", "regular", "config", "regular"]
    assert one(spark, [" PY ", "sh", "rust", None], paths.fence_type) == ["python", "bash", None, None]


def test_host_paths_and_references(spark):
    assert one(spark, ["~/a", "$HOME/x", "/etc", "$home/x", "a/b"], paths.is_host_path) == [True, True, True, False, False]
    assert one(spark, ["/a\\b ", "///x", " y"], paths.normalize_path) == ["a/b", "x", "y"]
    assert one(spark, ["see ./a/b.md, c-d.tar.gz or e"], paths.bare_paths) == [["./a/b.md", "c-d.tar.gz"]]
    assert [x and tuple(x) for x in one(spark, ["a:b:2-3", "a:0-3", "a:5-4", "a"], paths.decode_block_path)] == [("a:b", 2, 3), None, None, None]


def _hash(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits.rjust(6, "0")[:6]


def test_ids(spark):
    texts = ["", "a", "hello world", "été 🎉", "x" * 300]
    assert one(spark, texts, ids.short_hash) == [_hash(t) for t in texts]
    assert one(spark, ["Read ~/A_b", "--x--", "a*b.c"], ids.slug) == ["read-a-b", "x", "a*b.c"]
    df = spark.createDataFrame([("git", ["a", 'b"'], {"pattern": "p", "z": "1", "b": "2"})], "t string, a array<string>, m map<string,string>")
    got = df.select(ids.permission_id(F.col("t"), F.col("a"), F.col("m")), ids.permission_id(F.col("t"), F.lit(None).cast("array<string>"))).first()
    assert list(got) == ["git-a-b-" + _hash('{args:["a","b\\""],metadata:{b:"2",z:"1"}}'), "git-*"]


def test_destinations(spark):
    hosts = one(spark, ["HTTPS://A.com:1/x", "'b.org'", "http://u:p@c.net?q", "[::1]/x", "", None], urls.host)
    assert hosts == ["a.com", "b.org", "c.net", "[::1]", None, None]
    assert one(spark, ["localhost", "a.local", "10.1.1.1", "172.32.0.1", "172.16.0.1", "x.org"], urls.destination) == ["loopback", "internal", "internal", "external", "internal", "external"]
    assert [x and tuple(x) for x in one(spark, ["https://github.com/o/r.git", "https://www.github.com/o/r/", "https://github.com/o", "https://github.com/o/r/t", "https://x.org/o/r"], urls.repository)] == [("o", "r"), ("o", "r"), None, None, None]


def test_words_of_commands():
    words = lambda text: [c[2] for c in scan.shell(text)]
    assert words("A=1 B=2 curl -X 'a b' \"c;d\" $(e f) # g") == [["curl", "-X", "'a b'", '"c;d"', "$(e f)"], ["e", "f"]]
    assert words("if true; then rm -rf x && ls|wc >o 2>&1; fi") == [["true"], ["rm", "-rf", "x"], ["ls"], ["wc"]]
    assert scan.shell('echo "x | y" | sh -s > o') == [(1, 1, ["echo", '"x | y"'], ["sh", "-s"], None), (1, 1, ["sh", "-s"], None, "o")]
    assert words("FOO=1") == [] and words("") == []
    assert words("f() { g; }\ncase $x in a|b) h i;; esac\n[[ -f x && -d y ]] || j") == [["g"], ["h", "i"], ["[[", "-f", "x", "&&", "-d", "y", "]]"], ["j"]]


def test_commands_over_lines():
    assert scan.shell("cat <<-'EOF' | sh\nrm -rf /\n\tEOF\nls \\\n  -l\n") == [(1, 1, ["cat"], ["sh"], None), (1, 1, ["sh"], None, None), (4, 5, ["ls", "-l"], None, None)]
    assert scan.shell('x "a\nb" $(c\nd)') == [(1, 3, ["x", '"a\nb"', "$(c\nd)"], None, None), (2, 2, ["c"], None, None), (3, 3, ["d"], None, None)]
    assert [c[2] for c in scan.shell("say \"no end\nls <<GONE\nit's")] == [["say", '"no', "end"], ["ls"], ["it's"]]


def test_calls_and_imports():
    calls, imports = scan.code("import {\n a } from 'x';\nexport const q = 'no';\nexport * from \"./z\";\nf(g(1,\n [2, 3]), {k: 'v'}) // h(1)\nfunction i(j) {}\nnew Function('k')", "javascript")
    assert imports == [(1, "import", "x"), (4, "export", "./z")]
    assert calls == [(5, 6, ["f", "g(1,\n [2, 3])", "{k: 'v'}"], "v"), (5, 6, ["g", "1", "[2, 3]"], None), (8, 8, ["new Function", "'k'"], "k")]
    calls, imports = scan.code("import os.path, re\nfrom . import a\nx = \"\"\"open('no')\"\"\"\nopen(\n  '/etc/x')\ndef g(a): pass", "python")
    assert imports == [(1, "import", "os.path"), (2, "from", ".")] and calls == [(4, 5, ["open", "'/etc/x'"], "/etc/x")]


@pytest.mark.parametrize("unit", ['"a" ', "word ", "'", '"', '\\"', "$(", "`", "${", "(", "<<a\n", "$((a", '"$(', "a|", "f('a',", "f(", "/*", '"""a', "import a\n", "([{", "(]", "`\\"])
def test_time_grows_with_the_text_alone(unit):
    """A quarter of a megabyte of what makes patterns recurse or search again; nesting that is closed, too."""
    closed = {"$(": ")", "f(": ")", "([{": "}])"}.get(unit, "")
    n = (1 << 18) // len(unit)
    text = unit * n + closed * n
    begin = time.process_time()
    scan.shell(text)
    scan.code(text, "javascript")
    scan.code(text, "python")
    assert time.process_time() - begin < 20


def test_tools_and_command_lines(spark):
    assert one(spark, ["`Git`:", "if", "2x", "x" * 33, "(npm)"], shell.normalize_tool) == ["git", None, None, None, "npm"]
    rows = [("git push", "git"), ("# git", "git"), ("- git x", "git"), ("Git x", "git"), ("x = git", "git"), ("a sentence that ends.", "a"), ("cd x && git y", "git"), ("push git", "git"), ("", "git")]
    assert values(spark, rows, shell.likely_command_line, "a string, b string") == [True, False, False, False, False, False, True, False, False]
    assert [[(t.name, t.args) for t in x] for x in one(spark, [" Read Bash(git:*, x) bad( Y(a)"], shell.allowed_tools)] == [[("Read", ["*"]), ("Y", ["a"])]]
    assert one(spark, ["say `a b` and ` c `"], shell.inline_snippets) == [["a b", "c"]]


def test_levels_and_summaries(spark):
    t = cfg.DEFAULTS["riskReport"]["thresholds"]
    assert values(spark, [(x,) for x in (0.0, 1.0, 3.0, 5.0, 7.0, 99.0)], lambda s: risk.risk_level(s, t), "s double") == ["safe", "caution", "attention", "risky", "avoid", "avoid"]
    assert values(spark, [("risky", ["a", "b", "c", "d"]), ("safe", ["a"]), ("avoid", [])], risk.summary, "l string, t array<string>") == ["Elevated risk: a, b, c.", risk.NO_RISKS, risk.NO_RISKS]


def test_config():
    got = cfg.resolve({"scan": {"maxFileCount": 3}, "allowlist": {"network": {"domains": ["a"]}, "languages": {"python": {"imports": ["x", "os"]}}}, "riskReport": {"uplift": {"Z": 1}}})
    assert got["scan"] == {"maxFileSize": 1_000_000, "maxFileCount": 3, "maxScanDepth": 5}
    assert got["allowlist"]["languages"]["python"]["imports"] == [*cfg.PYTHON_IMPORTS, "x"] and got["allowlist"]["network"]["domains"] == ["a"]
    assert got["riskReport"]["uplift"]["Z"] == 1 and got["riskReport"]["uplift"]["NETWORK:credential_leak"] == 7
    assert cfg.lookup(got, "scan.maxFileCount") == 3
    with pytest.raises(KeyError):
        cfg.lookup(got, "scan.none")
    for bad in ([], {"scan": {"x": 1}}, {"scan": {"maxFileCount": True}}, {"denylist": {"network": {"domains": "a"}}}):
        with pytest.raises(ValueError):
            cfg.validate(bad)


def test_hosts_as_a_parser_gives_them(spark):
    # Spellings and their hosts.
    cases = {
        "http://2130706433/": "127.0.0.1", "http://0x7f.1/": "127.0.0.1", "http://017700000001": "127.0.0.1", "http://0177.0.0.01": "127.0.0.1", "https://<file>": None, "http://0x/": "0.0.0.0", "http://1.2.3.4.": "1.2.3.4", "http://1..2": None, "http://256.1.1.1": None, "http://1.2.3.08": None, "http://a.0x": None,
        "http://[::1]": "[::1]", "http://[0:0:0:0:0:0:0:1]": "[::1]", "http://[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "http://[1::2::3]": None, "http://[::127.0.0.1]/": "[::7f00:1]", "http://[12345::]": None, "http://[::]": "[::]", "http://[1:2:3:4:5:6:7:8]:90": "[1:2:3:4:5:6:7:8]", "http://[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]",
        "localhost:3000/a@b": "localhost", "user@h.org": "h.org", "http://h.org:": "h.org", "http://h.org:00080": "h.org", "http://h.org:99999": None, "a b": None, "": None, "x_y.org": "x_y.org", "HTTP://%4C%6fcalhost": "localhost", "http://a%00b": None, "http://a%2Fb": None, "http://h+x.org": "h+x.org", "http://...": "...", "http://.": ".", "http://1e3": "1e3",
    }
    assert dict(zip(cases, one(spark, list(cases), urls.host))) == cases
