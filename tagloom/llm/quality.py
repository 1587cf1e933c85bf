"""Quality rules as weak supervision: rules vote or abstain, and their agreement tells how far each is to be trusted.

A rule votes that a text is good, that it is bad, or not at all. Expectation-maximisation over the counts of vote patterns
estimates each rule's accuracy and the share of good texts; a text is kept by its posterior probability, so one failed
rule does not drop it where better ones speak for it. All of it is SQL expressions: texts are measured inside their row,
and of the corpus only the counts of patterns are left, of which there are at most three to the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import settle

LEAST_WORDS = 50
STEPS = 60  # of expectation-maximisation
# first guesses: the share of good texts, and the shares of a rule's votes that are right on good and on bad texts
PRIOR, ON_GOOD, ON_BAD = 0.8, 0.99, 0.3
# rules are made to hardly ever fail a good text, and may miss most kinds of bad ones; none is beyond doubt
WITHIN_GOOD, WITHIN_BAD = (0.99, 0.999), (0.02, 0.99)
LEAST_POSTERIOR = 0.5

_BLANK = r"\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Conditions over the measured columns; whichever holds is the vote, the bad one first, neither is none."""

    name: str
    bad: str
    good: str


# limits are per word or per line, so they hold for texts of any length
RULES = (
    Rule("length", f"n_words < {LEAST_WORDS}", "n_words >= 100"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines < n_lines"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words < 10 * n_words"),
    Rule("stops", "10 * n_stops > 4 * n_words", "100 * n_stops between n_words and 25 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals < 15 * word_chars"),
)


def _without(chars: str) -> Column:
    return F.char_length(F.translate("t", chars, ""))


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once: a lambda's variable is, while a column may be put in wherever it is used."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# words in windows of three that come twice or more. Windows whose hash another one shares are candidates: hashes are
# sorted as numbers with their place in the low bits. Candidates are compared as texts, so no collision counts: those
# equal to a neighbour are repeated, and each covers the words up to the next repeated window's first, three at most
_PLACE = 30  # bits
_HASHES = "transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> xxhash64(w, get(ws, i + 1), get(ws, i + 2)))"
_PACKED = f"sort_array(transform(hashes, (h, i) -> shiftleft(shiftrightunsigned(h, {_PLACE}), {_PLACE}) | cast(i as bigint)))"
_ALIKE = (
    f"transform(filter(p, (x, j) -> (j > 0 and shiftright(x, {_PLACE}) = shiftright(get(p, j - 1), {_PLACE}))"
    f" or coalesce(shiftright(x, {_PLACE}) = shiftright(get(p, j + 1), {_PLACE}), false)), x -> cast(x & {(1 << _PLACE) - 1}L as int))"
)
_SORTED = "sort_array(transform(c, i -> struct(concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as s, i as i)))"
_AGAIN = (
    "sort_array(transform(filter(transform(t, (x, j) -> struct(x.i as i,"
    " (j > 0 and x.s = get(t, j - 1).s) or coalesce(x.s = get(t, j + 1).s, false) as again)), x -> x.again), x -> x.i))"
)
_COVERED = "aggregate(transform(d, (x, j) -> least(3, coalesce(get(d, j + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
_EXACT = f"if(size(c) = 0, 0L, {_bind(_SORTED, 't', _bind(_AGAIN, 'd', _COVERED))})"
_CANDIDATES = f"if(size(array_distinct(hashes)) = size(hashes), cast(array() as array<int>), {_bind(_PACKED, 'p', _ALIKE)})"
_REPEATED = _bind("words", "ws", _bind(_HASHES, "hashes", _bind(_CANDIDATES, "c", _EXACT)))


def measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and what rules look at, of every row: figures of the whole text, null texts being empty.

    ``n_repeat_words`` counts words that stand in any window of three words that the text has twice or more, each once.
    """
    out = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("words", F.expr(f"regexp_extract_all(t, '[^{_BLANK}]+', 0)")).withColumn("n_words", F.size("words").cast("bigint"))
    out = out.withColumn("lines", F.expr(f"filter(split(t, '\\n'), x -> x rlike '[^{_BLANK}]')"))
    return out.select(
        "key", "n_words", _without(_BLANKS).cast("bigint").alias("word_chars"),
        (F.char_length("t") - _without(_SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"), (F.char_length("t") - _without(".!?")).cast("bigint").alias("n_stops"),
        F.char_length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("bigint").alias("n_capitals"),
    )


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One character a rule: ``-`` bad, ``+`` good, ``0`` no vote. A text without words has no votes."""
    each = [F.when(F.expr("n_words = 0"), "0").when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0") for r in rules]
    return F.concat(*each)


def _posterior(n: int, model: str, pattern: str) -> str:
    """The probability that a text with a pattern's votes is good: rules err on their own, those without a vote say nothing."""

    def product(up: str, down: str) -> str:
        return " * ".join(f"case substr({pattern}, {j + 1}, 1) when '+' then {up.format(j)} when '-' then {down.format(j)} else 1D end" for j in range(n))

    good = f"{model}.prior * {product(f'{model}.on_good[{{0}}]', f'(1 - {model}.on_good[{{0}}])')}"
    bad = f"(1 - {model}.prior) * {product(f'(1 - {model}.on_bad[{{0}}])', f'{model}.on_bad[{{0}}]')}"
    return f"({good}) / ({good} + {bad})"


def fit(voted: DataFrame, n: int, steps: int = STEPS) -> DataFrame:
    """One row, ``model`` with ``prior, on_good, on_bad``: what expectation-maximisation finds for ``n`` rules from all rows' votes.

    Rows are counted by pattern first; the steps run over these counts, in the patterns' order, in one expression.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def summed(x: str) -> str:
        return f"aggregate(q, 0D, (a, x) -> a + {x})"

    def held(x: str, least: float, most: float) -> str:
        return f"least(greatest({x}, {least}D), {most}D)"

    def learnt(j: int, right: str, chance: str, first: float, within: tuple[float, float]) -> str:
        vote = f"substr(x.votes, {j + 1}, 1)"
        of = summed(f"if({vote} = '0', 0D, x.n * {chance})")
        return held(f"coalesce(try_divide({summed(f"if({vote} = '{right}', x.n * {chance}, 0D)")}, {of}), {first}D)", *within)

    prior = held(f"coalesce(try_divide({summed('x.n * x.g')}, {summed('x.n')}), {PRIOR}D)", 0.01, 0.99)
    on_good = ", ".join(learnt(j, "+", "x.g", ON_GOOD, WITHIN_GOOD) for j in range(n))
    on_bad = ", ".join(learnt(j, "-", "(1 - x.g)", ON_BAD, WITHIN_BAD) for j in range(n))
    expected = f"transform(p, x -> struct(x.votes as votes, x.n as n, {_posterior(n, 's', 'x.votes')} as g))"
    step = f"element_at(transform(array({expected}), q -> struct({prior} as prior, array({on_good}) as on_good, array({on_bad}) as on_bad)), 1)"
    start = f"struct({PRIOR}D as prior, array_repeat({ON_GOOD}D, {n}) as on_good, array_repeat({ON_BAD}D, {n}) as on_bad)"
    return one.select(F.expr(f"aggregate(sequence(1, {steps}), {start}, (s, i) -> {step})").alias("model"))


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", least: float = LEAST_POSTERIOR) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, votes`` of every row.

    ``base_failed``: fewer than 50 words, or over half of them repeated in windows of three; such rows are not kept.
    Others are kept where ``quality``, the posterior probability that they are good, is ``least`` or more. The rules are
    trusted by what all rows that pass the base say of them. Null and empty texts fail; repeated rows are judged alike and count as often as
    they come. An empty table has an empty result; columns besides the two are not looked at.
    """
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")
    measured = settle(measures(df, key, text).withColumn("votes", votes(rules)).withColumn("base_failed", failed))
    model = fit(measured.where("not base_failed"), len(rules))  # one row
    quality = F.round(F.expr(_posterior(len(rules), "model", "votes")), 6)
    out = measured.crossJoin(F.broadcast(model)).withColumn("quality", quality)
    kept = ~F.col("base_failed") & (F.col("quality") >= least)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("key").alias(key), *figures, kept.alias("kept"), "quality", "votes")
