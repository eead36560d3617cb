"""Fences, paragraphs and code spans within block quotes and list items, by tables of expected rows."""

import time

import pytest
from pyspark.sql import functions as F

from capsift.functions import prose
from capsift.operators import markdown, permissions

TEXTS = {
    "item": ("- a `x\n  y` b\n\n  ```sh\n  curl u\n    z\n  ```\n- b\nlazy `c d`\n\nend", [(4, 7, "curl u\n  z", "sh")], [(1, 1, "x\ny"), (9, 8, "c d")]),
    "quote": ("> q\n> ```py\n> import os\n> > x\nafter `ls`\n", [(2, 4, "import os\n> x", "py")], [(5, 5, "ls")]),
    "nested": ("1. one\n   > - ~~~\n   >   body\n   >   ~~~\n2. `two`", [(2, 4, "body", "")], [(5, 5, "two")]),
    "tab": ("-\tx\n\n\t```\n\tq\n\t```\n", [(3, 5, "q", "")], []),
    "open": ("- ```\n  a\n\n  b\n\nout `p`", [(1, 5, "a\n\nb\n", "")], [(6, 6, "p")]),
    "headings": ("T `a`\n===\n# H `b`\n***\n    code `c`\n- - -\n`d`\n\n      `e`", [], [(1, 1, "a"), (3, 3, "b"), (7, 7, "d")]),
    "numbers": ("para `a\n2. b`\n1. `c`", [], [(1, 1, "a\n2. b"), (3, 3, "c")]),
    "ticks": ("\\`a` b` ``c`d`` `e", [], [(1, 1, " b"), (1, 1, "c`d")]),
    "marks": ("``` bad`info\n\n  ```js\n   x\n ```\n", [(3, 5, " x", "js")], []),
    "windows": ("> ~~~ sh\r\n> a\r\n> ~~~\r\n`b`\r\n", [(1, 3, "a\r", " sh")], [(4, 4, "b")]),
    "empty": ("", [], []),
    "blank": ("\n \n>\n-\n\n", [], []),
}


@pytest.mark.parametrize("name", TEXTS)
def test_containers(name):
    text, fences, spans = TEXTS[name]
    rows = list(prose.read(text))
    assert [(r[1], r[2], r[4], r[5]) for r in rows if r[0] == "fence"] == fences
    assert [(r[1], r[3], r[4]) for r in rows if r[0] == "span"] == spans


def test_blocks_and_references_within_containers(spark):
    text = "- see `sh run.sh\n  docs/a.md` and\n  [`go`](x/go.sh)\n\n  > ```bash\n  > cat lib/in.txt\n  > ```\n"
    df = spark.createDataFrame([("s", "a.md", text), ("s", "none.md", None)], "skill_key string, path string, content string")
    assert [(r.language, r.content, r.start_line, r.end_line) for r in markdown.fenced_blocks(df).collect()] == [("bash", "cat lib/in.txt", 5, 7)]
    assert [(r.content, r.start_line) for r in markdown.inline_blocks(df).orderBy("block_seq").collect()] == [("sh run.sh\ndocs/a.md", 1), ("go", 1)]
    refs = lambda by_line: sorted((r.ref_path, r.line, r.via) for r in markdown.references(df, by_line).collect())
    assert refs(False) == [("docs/a.md", 1, "inline-code"), ("run.sh", 1, "inline-code"), ("x/go.sh", 1, "markdown-link")]
    assert refs(True) == [("docs/a.md", 1, "inline-code"), ("run.sh", 1, "inline-code"), ("x/go.sh", 3, "markdown-link")]


def test_fences_in_quotes_are_scanned_without_their_marks(spark):
    text = "> - ```sh\n>   curl https://x.example.org/a\n>   cat b > c\n>   ```\n\n1. ~~~sh\n   rm -rf /data\n   ~~~\n"
    files = spark.createDataFrame([("s", "SKILL.md", text)], "skill_key string, path string, content string")
    queue = spark.createDataFrame([("s", "SKILL.md:1-4", 0), ("s", "SKILL.md:6-8", 1)], "skill_key string, path string, queue_seq int")
    queue = queue.withColumns({"source_type": F.lit("local"), "file_type": F.lit("bash"), "role": F.lit("script"), "via": F.lit("code-block"), "ref_type": F.lit("script")})
    got = {r.queue_seq: r.content for r in permissions.scan_targets(queue, files).where("type = 'script'").collect()}
    assert got == {0: " ```sh\n  curl https://x.example.org/a\n  cat b > c\n  ```", 1: " ~~~sh\n   rm -rf /data\n   ~~~"}


def test_a_megabyte_of_marks_is_read_in_linear_time():
    n = 1_000_000
    for text in (">" * n, "- " * (n // 2) + "x", "- " * (n // 4) + "x" + "\n" * (n // 2), "` " * (n // 2), "`a``" * (n // 4), "\\`" * (n // 2), "> " * (n // 2) + "\nx" * (n // 4), "1) " * (n // 3) + "x", "- ```\n" * (n // 6), " " * n, "\t" * n):
        began = time.time()
        for _ in prose.read(text):
            pass
        assert time.time() - began < 15, text[:8]
