"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0); the rules look at different evidence: characters, words, lines, repetition, letter
case, sentence ends, word lengths. A rule has two
unknown rates: how often it votes bad on good and on bad documents. Expectation-maximisation finds these rates and the
share of good documents from the votes of the whole corpus, without labels; a document's posterior
probability of being good, given its votes, is the verdict. EM runs on the table of distinct vote patterns (3 to the number
of rules, 6561 rows, at most, whatever the corpus); one aggregate over the corpus counts them, and the rounds run on the driver over these counts until the posterior density per document stands still.

Rates have Beta priors that weigh as much as a stated share of the documents, so they act alike at every size: two percent for how seldom a rule votes bad on good documents, a thousandth for how much of the junk it sees. So a bad vote counts by what the corpus shows the rule to be worth: one that sees most of the junk and nothing else decides alone, and one that votes bad on a
few documents that all others call good does not.

Two hard rules come before it (`base_failed`): fewer than 50 words, or over half of the words in repeated
windows of three words.

Defined cases: null or empty texts have no words and fail the base rules; null ids and repeated rows are
scored like any other; in scripts without spaces the rules on word lengths abstain; an empty table gives no rows; other columns stay as they are in `score`, whatever their names.
One row's words and windows are arrays in memory: some 150 bytes a word.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: At most so many rounds; fewer if the objective per document changes by less than this.
ROUNDS, STILL = 30, 1e-10
THRESHOLD = 0.5
#: Letters of scripts that put no spaces between words.
SPACELESS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF)))
#: What is neither letter, mark, digit, white space nor the punctuation of prose.
ODD = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'\"()\[\]{}…–—-]+"
#: A line that ends like a sentence.
ENDED = r"[.!?:;…。！？][\"')\]»”]*[\x20\x09-\x0D]*\z"
#: (name, statistic in SQL over the counts, bad if over this percent of the base, good if under that percent of it, base, whether spaceless scripts abstain)
RULES = [
    # one kind of evidence, so one rule: symbols (over a tenth of the words) are odd runs (over a quarter), too
    ("symbols", "greatest(5 * n_symbols, 2 * n_odd_runs)", 50, 15, "n_words", False),
    ("dup_lines", "n_dup_lines", 30, 10, "n_lines", False),
    ("repeats", "n_repeat_words", 30, 15, "n_words", False),
    ("shouting", "n_upper_runs", 30, 5, "n_words", False),
    ("exclaiming", "n_exclamations", 20, 5, "n_words", False),
    ("unended", "n_unended", 12, 5, "n_lines", False),
    ("long_words", "word_chars", 1000, 800, "n_words", True),
    ("few_short", "n_long", 92, 86, "n_words", True),
]
#: What EM starts from: share of good documents, rate of bad votes on good and on bad ones.
START = (0.85, 0.05, 0.4)
#: Beta priors: (mean, weight as a share of the documents) of a rule's rate of bad votes on good and on bad documents; the same of the share of good documents.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE = (0.01, 0.02), (0.4, 0.001), (0.9, 1.0)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_odd_runs", "n_upper_runs", "n_exclamations", "n_unended", "n_long", "n_spaceless"]
_OWN = "__capsift_quality"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, a struct of counts of each text."""
    steps = [f"{_OWN}_{i}" for i in range(6)]
    text, words, sorted_, where, lines, _ = map(F.col, steps)
    df = docs.withColumn(steps[0], F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(steps[1], common.words(text)).withColumn(steps[4], F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(common.WS))) > 0))
    # hashes of all windows of three words with their places, equal ones side by side
    windows = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn(steps[2], F.sort_array(F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))))
    twice = F.filter(sorted_, lambda x, k: F.coalesce(F.get(sorted_, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn(steps[3], F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(where, lambda i, k: F.least(F.coalesce(F.get(where, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    n = F.size(words)
    counts = {
        "n_words": n,
        "word_chars": _without(text, common.WS),
        "n_symbols": F.length(text) - _without(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_upper_runs": F.size(F.regexp_extract_all(text, F.lit("[A-Z]{3,}"), 0)),
        "n_odd_runs": F.size(F.regexp_extract_all(text, F.lit(ODD), F.lit(0))),
        "n_exclamations": F.length(text) - _without(text, "!"),
        "n_unended": F.size(F.filter(lines, lambda x: ~F.rlike(x, F.lit(ENDED)))),
        # all but short words in lower case, which prose in any language with spaces has
        "n_long": F.size(F.filter(words, lambda w: (F.length(w) > 3) | (w != F.lower(w)))),
        "n_spaceless": F.when(F.rlike(text, F.lit(f"[{SPACELESS}]")), F.length(text) - F.length(F.regexp_replace(text, f"[{SPACELESS}]+", ""))).otherwise(0),
    }
    return df.withColumn(_OWN, F.struct(*(counts[c].cast("long").alias(c) for c in COUNTS))).drop(*steps)


def _vote(rule: tuple, at: str) -> Column:
    _, stat, bad, good, base, spaced = rule
    x, n = F.expr(re.sub(r"[a-z]+_[a-z_]+", lambda m: f"{at}.{m[0]}", stat)) * 100, F.col(f"{at}.{base}")
    abstains = (n == 0) | (F.col(f"{at}.n_spaceless") * 5 > F.col(f"{at}.word_chars")) if spaced else n == 0
    return F.when(abstains, 0).when(x > bad * n, -1).when(x < good * n, 1).otherwise(0)


def base_failed(at: str = _OWN) -> Column:
    n = F.col(f"{at}.n_words")
    return (n < MIN_WORDS) | (F.col(f"{at}.n_repeat_words") * 100 > MAX_REPEAT_PERCENT * n)


def _log_odds(votes: list[Column], model: tuple) -> Column:
    prior, rates = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, (on_good, on_bad) in zip(votes, rates):
        odds = odds + F.when(v == -1, F.lit(math.log(on_good / on_bad))).when(v == 1, F.lit(math.log((1 - on_good) / (1 - on_bad)))).otherwise(F.lit(0.0))
    return odds


def fit(patterns: list[tuple], rounds: int = ROUNDS) -> tuple:
    """patterns: (votes, documents) of each distinct pattern. Returns (share of good documents, [(rate of bad votes on good, on bad)])."""
    patterns = sorted(patterns)  # sums are the same in every run
    n, k = float(sum(c for _, c in patterns)), len(RULES)
    model, before = (START[0], [START[1:]] * k), -math.inf
    for _ in range(rounds if n else 0):
        share, rates = model
        odds = math.log(share / (1 - share))
        on = [{-1: (math.log(g), math.log(b)), 1: (math.log(1 - g), math.log(1 - b)), 0: (0.0, 0.0)} for g, b in rates]
        bad_votes, all_votes, good_n, density = [[0.0, 0.0] for _ in rates], [[0.0, 0.0] for _ in rates], 0.0, 0.0
        for votes, count in patterns:
            good, bad = (sum(on[i][v][y] for i, v in enumerate(votes)) for y in (0, 1))
            ratio = odds + good - bad
            p = 1.0 / (1.0 + math.exp(-ratio))
            good_n += p * count
            # the density of a pattern: that of a bad document by these votes, times (1 + odds)
            density += (math.log(1 - share) + bad + math.log1p(math.exp(ratio))) * count
            for i, v in enumerate(votes):
                for y, w in ((0, p * count), (1, (1 - p) * count)):
                    bad_votes[i][y] += w * (v == -1)
                    all_votes[i][y] += w * (v != 0)
        now = density / n + _log_prior(model)
        if abs(now - before) < STILL:
            break
        rate = lambda i, y, prior: (bad_votes[i][y] + prior[0] * prior[1] * n) / (all_votes[i][y] + prior[1] * n)  # noqa: B023, E731
        model, before = ((good_n + PRIOR_SHARE[0] * PRIOR_SHARE[1] * n) / (n + PRIOR_SHARE[1] * n), [(rate(i, 0, PRIOR_GOOD), rate(i, 1, PRIOR_BAD)) for i in range(k)]), now
    return model


def _log_prior(model: tuple) -> float:
    """Of the rates, per document."""
    pairs = [(model[0], PRIOR_SHARE)] + [(x, p) for rates in model[1] for x, p in zip(rates, (PRIOR_GOOD, PRIOR_BAD))]
    return sum(weight * (mean * math.log(x) + (1 - mean) * math.log(1 - x)) for x, (mean, weight) in pairs)


def accuracies(spark: SparkSession, model: tuple) -> DataFrame:
    """What EM has found: rule, bad_on_good, bad_on_bad."""
    return spark.createDataFrame([(r[0], *rates) for r, rates in zip(RULES, model[1])], "rule string, bad_on_good double, bad_on_bad double")


def _model(stats: DataFrame, rounds: int) -> tuple:
    """Of the output of statistics()."""
    votes = [_vote(r, _OWN).alias(f"v{i}") for i, r in enumerate(RULES)]
    patterns = stats.where(~base_failed()).select(*votes).groupBy(*(f"v{i}" for i in range(len(RULES)))).agg(F.count("*").alias("n"))
    return fit([(tuple(r[:-1]), r[-1]) for r in patterns.collect()], rounds)


def _judged(stats: DataFrame, model: tuple) -> DataFrame:
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds([_vote(r, _OWN) for r in RULES], model)))
    parts = [F.col(f"{_OWN}.{c}").alias(c) for c in COUNTS]
    failed = base_failed()
    return stats.withColumn(_OWN, F.struct(*parts, failed.alias("base_failed"), F.when(failed, F.lit(0.0)).otherwise(posterior).alias("posterior"), (~failed & (posterior >= THRESHOLD)).alias("kept")))


def score(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with a struct column `__capsift_quality`: the counts, base_failed, posterior, kept. The counts are written once."""
    stats = statistics(docs, text_col)
    found = common.materialize(stats.select(*([*docs.columns] if keep is None else keep), _OWN), "quality")
    return _judged(found, _model(found, rounds))


def filter_quality(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that are kept, with its columns."""
    return score(docs, text_col, rounds).where(F.col(f"{_OWN}.kept")).select(*docs.columns)


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *(F.col(f"{_OWN}.{n}").alias(n) for n in names))


def _sql_log_odds(prior: str, rate) -> str:
    terms = [f"ln({prior} / (1 - {prior}))"]
    for i in range(len(RULES)):
        g, b = rate(i, "g"), rate(i, "b")
        terms.append(f"CASE v{i} WHEN -1 THEN ln({g} / {b}) WHEN 1 THEN ln((1 - {g}) / (1 - {b})) ELSE 0.0 END")
    return " + ".join(terms)


def stats_sql(docs: str = "documents") -> str:
    """CTEs up to `votes`: the counts, base_failed and the votes of each document. Ids must be unique."""
    skip = " OR n_spaceless * 5 > word_chars"
    votes = ", ".join(f"CASE WHEN {base} = 0{skip if spaced else ''} THEN 0 WHEN {stat} * 100 > {bad} * {base} THEN -1 WHEN {stat} * 100 < {good} * {base} THEN 1 ELSE 0 END AS v{i}" for i, (_, stat, bad, good, base, spaced) in enumerate(RULES))
    odd, ended = ODD.replace("'", "''"), ENDED.replace("'", "''")
    return f"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '{odd}'))::BIGINT AS n_odd_runs, len(regexp_extract_all(t, '[A-Z]{{3,}}'))::BIGINT AS n_upper_runs, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
  len(list_filter(l, lambda x: NOT regexp_matches(x, '{ended}')))::BIGINT AS n_unended, len(list_filter(w, lambda x: length(x) > 3 OR x <> lower(x)))::BIGINT AS n_long,
  (length(t) - length(regexp_replace(t, '[{SPACELESS}]+', '', 'g')))::BIGINT AS n_spaceless FROM w LEFT JOIN r USING (doc_id)),
votes AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {votes} FROM s)"""


def em_sql() -> str:
    """CTEs from `votes` to `verdicts` (doc_id, all counts, base_failed, kept)."""
    k, names = len(RULES), ", ".join(f"v{i}" for i in range(len(RULES)))
    out = [f"p AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM votes WHERE NOT base_failed GROUP BY ALL)"]
    out.append("m0 AS (SELECT " + f"{START[0]}::DOUBLE AS prior, " + ", ".join(f"{START[1]}::DOUBLE AS g{i}, {START[2]}::DOUBLE AS b{i}" for i in range(k)) + ")")
    odds = _sql_log_odds("prior", lambda i, y: f"{y}{i}")
    for r in range(ROUNDS):
        n = "(SELECT sum(n) FROM p)"
        rate = lambda i, y, prior: f"(coalesce(sum(CASE WHEN v{i} = -1 THEN {y} ELSE 0.0 END), 0) + {prior[0] * prior[1]} * {n}) / (coalesce(sum(CASE WHEN v{i} <> 0 THEN {y} ELSE 0.0 END), 0) + {prior[1]} * {n})"
        rates = ", ".join(f"{rate(i, 'gw', PRIOR_GOOD)} AS g{i}, {rate(i, 'bw', PRIOR_BAD)} AS b{i}" for i in range(k))
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT (coalesce(sum(gw), 0) + {PRIOR_SHARE[0] * PRIOR_SHARE[1]} * {n}) / ({1 + PRIOR_SHARE[1]} * {n}) AS prior, {rates} FROM (SELECT {names}, q * n AS gw, (1 - q) * n AS bw FROM (SELECT {names}, n, 1.0 / (1.0 + exp(-({odds}))) AS q FROM p, m{r})))")
    out.append(f"verdicts AS (SELECT votes.*, NOT base_failed AND 1.0 / (1.0 + exp(-({odds}))) >= {THRESHOLD} AS kept FROM votes, m{ROUNDS})")
    return ",\n".join(out)


def sql() -> str:
    return f"WITH {stats_sql()},\n{em_sql()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts"
