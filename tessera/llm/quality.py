"""Quality rules: a threshold table compiled into one projection of built-in functions.

``Rule`` rows bound a metric from below, above or both. ``compile_rules`` turns them into one boolean column, so all
rules of a document are evaluated in the scan's own stage: no shuffle, no user function.

Defined results: a null text has no words, so it fails the base rules; words are runs of anything but space and
\\t..\\r; a null text keeps its row. Rows are independent, so repeated rows get equal verdicts. Columns of the input
are kept by name; those of the output that clash replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous ont ou par pas pour que qui se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so über um und von war wie wird zu zum zur "
    "al como con del el ella entre era esta este la las lo los más no nos o para pero por su sus una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; an open side is None."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The default threshold table, on ratios so that it behaves alike at every length.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_ratio", high=0.10),
    Rule("stop_word_ratio", low=0.06),
    Rule("dup_line_ratio", high=0.50),
    Rule("repeat_word_ratio", high=0.50),
    Rule("shout_ratio", high=0.40),
)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows are sorted by a hash; neighbours with equal hashes are compared word by word.
    """

    def windows(w: Column) -> Column:
        gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))

    def positions(w: Column, s: Column) -> Column:
        n = F.size(s)

        def equal(a: Column, b: Column) -> Column:
            x, y = F.get(s, a), F.get(s, b)
            same = x["g"] == y["g"]
            for k in range(3):
                same = same & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
            return same

        twin = lambda k: F.when(k > 0, equal(k - 1, k)).otherwise(False) | F.when(k < n - 1, equal(k, k + 1)).otherwise(False)
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), twin), lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda a, k: a + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(p) == 0, 0).when(F.size(p) == 1, 3).otherwise(gaps)

    return F.when(F.size(words) < 3, 0).otherwise(_let(windows(words), lambda s: _let(positions(words, s), covered)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "shout_ratio": ("n_shouts", "word_chars"),
}


def counts(text: Column) -> Column:
    """A struct of the base counts; words and lines are split once."""
    stops = sorted(set(STOP_WORDS))

    def of(t: Column, w: Column, lines: Column) -> Column:
        made = (
            F.size(w),
            F.length(F.translate(t, SPACES, "")),
            F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            F.length(F.regexp_replace(t, r"[^!\p{Lu}]+", "")),
            F.size(lines),
            F.size(lines) - F.size(F.array_distinct(lines)),
            _repeats(w),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))),
        )
        return F.struct(*[c.cast("long").alias(n) for n, c in zip(COUNTS, made, strict=True)])

    worded = lambda line: F.length(F.translate(line, SPACES, "")) > 0
    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: _let(F.filter(F.split(t, "\n"), worded), lambda lines: of(t, w, lines))))


def metrics(text: Column) -> Column:
    """A struct of the counts and the ratios that rules may bound; a ratio of nothing is 0."""
    per = lambda m, x, of: F.when(m[of] > 0, m[x] / m[of]).otherwise(F.lit(0.0))
    return _let(counts(text), lambda m: F.struct(*[m[c].alias(c) for c in COUNTS], *[per(m, *of).alias(r) for r, of in RATIOS.items()]))


def compile_rules(rules: tuple[Rule, ...], measured: Column) -> Column:
    """True where every rule holds of a struct of metrics."""
    held = F.lit(True)
    for r in rules:
        if r.low is not None:
            held = held & (measured[r.metric] >= F.lit(r.low))
        if r.high is not None:
            held = held & (measured[r.metric] <= F.lit(r.high))
    return held


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the metrics, ``base_failed`` and ``kept``: one expression, whose parts are each computed once."""
    names = (*COUNTS, *RATIOS)

    def of(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*[m[n].alias(n) for n in names], base.alias("base_failed"), (~base & compile_rules(rules, m)).alias("kept"))

    return _let(metrics(text), of)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds the metrics, ``base_failed`` and ``kept``; columns of the input with such names, in any case, give way to them."""
    names = (*COUNTS, *RATIOS, "base_failed", "kept")
    taken = {c.lower() for c in docs.columns}
    made = "_verdict"
    while made in taken:
        made += "_"
    ours = {n.lower() for n in names}
    found = docs.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() not in ours], verdict(F.col(text_col), rules).alias(made))
    return found.select(*["`" + c.replace("`", "``") + "`" for c in found.columns if c != made], *[F.col(made)[n].alias(n) for n in names])


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns, whatever their names."""
    return docs.where(verdict(F.col(text_col), rules)["kept"])
