import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs; extra: columns with clashing names."""

    def table(rows, extra=False):
        full = [(i, t, ["en", "fr", None][(i or 0) % 3], f"src{(i or 0) % 4}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", "1 as k", "'x' as fp", "2 as n_words", "3 as spans", "4 as h1", "'y' as no", "5 as line", "6 as domain", "7 as id", "8 as ids", "9 as component_id", "10 as n_lines", "11 as n_removed", "12 as kept", "13 as text_", "14 as sig", "15 as row", "16 as n")
        return df

    return table


@pytest.fixture(scope="session")
def texts():
    """Documents with nulls, empty and long texts, exact and near copies, shared passages, repeated lines and rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "naïve", "日本", "x y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), say(9)
    out = [(0, None), (1, ""), (2, " \t\n\x0b\f\r "), (3, "one"), (4, "one two three")]
    for i in range(5, 40):
        out.append((i, "\n".join(say(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))))
    out += [(40, say(20) + "\n" + passage + "\n" + say(20)), (41, passage), (42, say(7) + " " + passage[5:-5]), (43, say(3000)), (44, "a b " * 200)]
    out += [(45, line + "\n" + say(9)), (46, line), (47, line.replace(line.split()[4], "changed")), (48, line + " more"), (49, " ".join(line.split()[1:])), (50, " ".join(line.split()[2:]))]
    copy = out[10][1]
    out += [(i, copy) for i in range(51, 61)] + [(i, copy.replace("w1", "w2", 1)) for i in range(61, 66)]
    out += [(5, out[5][1]), (None, "null id " + say(12)), (None, None)]
    return out
