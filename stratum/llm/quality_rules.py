"""Quality rules: a threshold table compiled into one projection of built-in functions.

apply(df) adds one column per metric, `failed` (names of the broken rules, joined by
commas in table order, empty if none) and `keep`. No shuffle, no Python worker: the
plan is one scan and one projection.

Defined results: a null text counts as empty; an empty or blank text has no words,
every ratio is 0 and only `too_few_words` fails; ratios that need a longer text to
mean anything have `least_words`, below which the rule passes. Very long texts are
measured whole and no rule is about size. Repeated rows are judged alike, each on its
own. In apply(), columns of the input that have the name of an added column, in any
case, are replaced; accepted() returns the columns of df, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import fresh, without

SYMBOLS = "#$%&*|<>{}[]\\~^=_@+"
STOP_WORDS = (
    "the of and a to in is that with for on it was as at by this are be from "
    "der die das und ist nicht von zu den mit im für ein eine "
    "le la les des et un une que du qui dans pour "
    "el los las de y en se por con para lo su do"
).split()


@dataclass(frozen=True)
class Rule:
    """metric must be at least `low` and at most `high`; judged only on texts of `least_words` words or more."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


RULES = (
    Rule("too_few_words", "n_words", low=1),
    Rule("word_length_low", "mean_word_chars", low=2.0, least_words=20),
    Rule("word_length_high", "mean_word_chars", high=12.0, least_words=20),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("shouting", "exclaim_ratio", high=0.1),
    Rule("few_stop_words", "stop_word_ratio", low=0.05, least_words=30),
    Rule("repeated_lines", "repeated_line_ratio", high=0.4),
    Rule("repeated_words", "repeated_word_ratio", high=0.2, least_words=10),
)
METRICS = ("n_words", "n_lines", "mean_word_chars", "symbol_ratio", "exclaim_ratio", "stop_word_ratio", "repeated_line_ratio", "repeated_word_ratio")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def parts(text: Column) -> dict[str, Column]:
    """What metrics() counts in: the text, its words in lower case and its lines."""
    t = F.coalesce(text, F.lit(""))
    flat = F.lower(t)
    for c in "\t\n\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return {"text": t, "words": F.array_remove(F.split(flat, " "), ""), "lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")}


def counts(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """What is counted in parts()."""
    stripped = lambda chars: F.length(t) - F.length(F.regexp_replace(t, _class(chars), ""))
    return {
        "n_words": F.size(words).cast("long"), "n_lines": F.size(lines).cast("long"),
        "solid": F.length(F.regexp_replace(t, "[ \\t\\n\\r]+", "")), "symbols": stripped(SYMBOLS), "exclaims": stripped("!?"),
        "stops": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))), "distinct": F.size(F.array_distinct(lines)),
        "again": F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))),
    }


def metrics(n: dict[str, Column]) -> dict[str, Column]:
    """The metric columns of counts()."""
    return {
        "n_words": n["n_words"],
        "n_lines": n["n_lines"],
        "mean_word_chars": _ratio(n["solid"], n["n_words"]),
        "symbol_ratio": _ratio(n["symbols"], n["solid"]),
        "exclaim_ratio": _ratio(n["exclaims"], n["solid"]),
        "stop_word_ratio": _ratio(n["stops"], n["n_words"]),
        "repeated_line_ratio": _ratio(n["n_lines"] - n["distinct"], n["n_lines"]),
        "repeated_word_ratio": _ratio(n["again"], n["n_words"]),
    }


def broken(rule: Rule, get=F.col) -> Column:
    """Whether the row breaks a rule; the metrics are columns."""
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (get(rule.metric) < rule.low)
    if rule.high is not None:
        bad = bad | (get(rule.metric) > rule.high)
    return bad & (get("n_words") >= rule.least_words) if rule.least_words else bad


def _measured(df: DataFrame, rules: tuple[Rule, ...], text: str) -> tuple[DataFrame, dict[str, str], str]:
    """df with the metrics and the names of broken rules under temporary names, and these.

    Three projections, one on another: parts, counts and ratios. What the next one uses
    more than once is made once, as the optimizer then doesn't merge them.
    """

    def added(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
        to = dict(zip(columns, fresh(df, *(f"__{c}" for c in columns)), strict=True))
        return df.withColumns({to[c]: x for c, x in columns.items()}), to

    own = [F.col(f"`{c}`") for c in df.columns]
    df, at = added(df, parts(F.col(f"`{text}`")))
    found = counts(*(F.col(at[k]) for k in ("text", "words", "lines")))
    df, at = added(df, found)
    df, to = added(df.select(*own, *(F.col(c) for c in at.values())), metrics({k: F.col(c) for k, c in at.items()}))
    df, failed = added(df, {"failed": F.concat_ws(",", *(F.when(broken(r, lambda k: F.col(to[k])), F.lit(r.name)) for r in rules))})
    return df, to, failed["failed"]


def apply(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with the metrics, `failed` and `keep`."""
    out, names, failed = _measured(df, rules, text)
    own = [F.col(f"`{c}`") for c in without(df, [*names, "failed", "keep"])]
    return out.select(*own, *(F.col(n).alias(m) for m, n in names.items()), F.col(failed).alias("failed"), (F.col(failed) == "").alias("keep"))


def accepted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of df that break no rule, with the columns of df."""
    out, _, failed = _measured(df, rules, text)
    # the row number keeps the condition above the projection, where every metric is computed once
    (row,) = fresh(out, "__row")
    out = out.withColumn(row, F.monotonically_increasing_id())
    return out.where((F.col(failed) == "") & (F.col(row) >= 0)).select(*(F.col(f"`{c}`") for c in df.columns))


def sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for apply() on a table of doc_id and text."""
    stop = ",".join(f"'{w}'" for w in STOP_WORDS)
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    space = "' ' || chr(9) || chr(10) || chr(13)"

    def bad(r: Rule) -> str:
        parts = ([f"{r.metric} < {r.low}"] if r.low is not None else []) + ([f"{r.metric} > {r.high}"] if r.high is not None else [])
        return f"CASE WHEN ({' OR '.join(parts)}) AND n_words >= {r.least_words} THEN '{r.name}' END"

    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
a AS (SELECT doc_id, t,
    list_filter(regexp_split_to_array(lower(t), '[ \\t\\n\\r]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS lines,
    length(translate(t, {space}, '')) AS solid FROM t),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
    {ratio("solid", "len(words)")} AS mean_word_chars,
    {ratio(f"(length(t) - length(translate(t, '{SYMBOLS}', '')))", "solid")} AS symbol_ratio,
    {ratio("(length(t) - length(translate(t, '!?', '')))", "solid")} AS exclaim_ratio,
    {ratio(f"len(list_filter(words, lambda w: w IN ({stop})))", "len(words)")} AS stop_word_ratio,
    {ratio("(len(lines) - len(list_distinct(lines)))", "len(lines)")} AS repeated_line_ratio,
    {ratio("len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))", "len(words)")} AS repeated_word_ratio FROM a)
SELECT *, failed = '' AS keep FROM (SELECT *, concat_ws(',', {", ".join(bad(r) for r in rules)}) AS failed FROM m)"""
