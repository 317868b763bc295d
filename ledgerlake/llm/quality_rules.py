"""Quality rules: a table of thresholds compiled into one projection.

``measure`` adds one column per measured quantity and ``judge`` compiles a table of
``Rule`` rows into a boolean over them. Everything is built-in expressions: no user
function runs, nothing is shuffled, and a row needs only its own text, so a task's
memory is bounded by its longest text.

Defined results: a null text counts as an empty one and fails ``min_words``; an empty
table gives an empty table; repeated rows are judged one by one; other columns are
kept, and working columns start with ``_q_`` so that they clash with none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
WORD = "[^\\\\x20\\\\x09-\\\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the four languages served; matched as they stand, in lower case.
STOP_WORDS = {
    "en": "a and are as at be by for from in is it of on or that the this to was with".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une".split(),
    "de": "als auf das dem den der des die ein eine ist in mit nicht sich sie und von zu".split(),
    "es": "al con de del el en es la las los no para por que se su un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a denominator of None is 1, and 0 / 0 is 0."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: What a document must fulfil before the table of rules is asked.
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30

RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_to_words", "n_exclaims", "n_words", None, 0.5),
    Rule("letter_words", "n_alpha_words", "n_words", 0.7, None),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("repeated_neighbours", "n_echo_words", "n_words", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE_COLUMNS, "n_lines", "n_exclaims", "n_alpha_words", "n_stop_words", "n_echo_words", "n_bullet_lines", "n_ellipsis_lines")


def _repeat_words(hashes: str) -> str:
    """SQL: words that lie in a window whose hash occurs twice or more among ``hashes``.

    Only a text with such a window pays for the sort: positions ordered by hash put
    equal windows side by side, and the windows kept, ordered by position, cover
    ``min(WINDOW, distance to the next)`` words each.
    """
    ordered = f"transform(array(array_sort(transform({hashes}, (h, p) -> struct(h AS h, p AS p)))), s -> filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)))[0]"
    places = f"array_sort(transform({ordered}, x -> x.p))"
    covered = f"transform(array({places}), q -> aggregate(transform(q, (p, i) -> if(i < size(q) - 1, least({WINDOW}, q[i + 1] - p), {WINDOW})), 0L, (a, x) -> a + x))[0]"
    return f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE {covered} END"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a long column for each of MEASURES.

    Windows are compared by 64-bit hashes of 64-bit word hashes: two different windows
    of one text count as equal with a probability below 1e-10 for 20,000 words.
    """
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    window = ", ".join(f"_q_hashes[i + {k}]" if k else "_q_hashes[i]" for k in range(WINDOW))
    step = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn("_q_words", F.expr(f"regexp_extract_all(_q_text, '{WORD}+', 0)"))
    step = step.withColumn("_q_lines", F.expr(f"filter(split(_q_text, '\\n'), l -> l RLIKE '{WORD}')"))
    step = step.withColumn("_q_hashes", F.expr("transform(_q_words, w -> xxhash64(w))"))
    step = step.withColumn(
        "_q_windows",
        F.expr(f"CASE WHEN size(_q_hashes) < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_q_hashes) - {WINDOW}), i -> xxhash64({window})) END"),
    )
    space_free = "length(regexp_replace(_q_text, '" + SPACE + "+', ''))"
    measured = {
        "n_words": "CAST(size(_q_words) AS bigint)",
        "word_chars": f"CAST({space_free} AS bigint)",
        "n_symbols": "CAST(length(_q_text) - length(translate(_q_text, '#*$%&|<>', '')) AS bigint)",
        "n_dup_lines": "CAST(size(_q_lines) - size(array_distinct(_q_lines)) AS bigint)",
        "n_repeat_words": _repeat_words("_q_windows"),
        "n_lines": "CAST(size(_q_lines) AS bigint)",
        "n_exclaims": "CAST(length(_q_text) - length(replace(_q_text, '!', '')) AS bigint)",
        "n_alpha_words": "CAST(regexp_count(_q_text, '(?<![^\\\\x20\\\\x09-\\\\x0D])[^\\\\x20\\\\x09-\\\\x0D\\\\p{L}]*+\\\\p{L}') AS bigint)",
        "n_stop_words": f"CAST(size(filter(_q_words, w -> w IN ({stop}))) AS bigint)",
        "n_echo_words": "CAST(size(filter(_q_hashes, (h, i) -> i > 0 AND h = _q_hashes[i - 1])) AS bigint)",
        "n_bullet_lines": "CAST(size(filter(_q_lines, l -> l RLIKE '^[ \\\\t]*[-*\\u2022|]')) AS bigint)",
        "n_ellipsis_lines": "CAST(size(filter(_q_lines, l -> l RLIKE '(\\\\.\\\\.\\\\.|\\u2026)[ \\\\t\\\\r]*$')) AS bigint)",
    }
    return step.withColumns({k: F.expr(v) for k, v in measured.items()}).drop("_q_text", "_q_words", "_q_lines", "_q_hashes", "_q_windows")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression, true where every rule of the table holds."""
    parts = []
    for r in rules:
        ratio = F.col(r.numerator) if r.denominator is None else F.when(F.col(r.denominator) == 0, F.lit(0.0)).otherwise(F.col(r.numerator) / F.col(r.denominator))
        parts += [ratio >= F.lit(r.low)] if r.low is not None else []
        parts += [ratio <= F.lit(r.high)] if r.high is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``base_failed`` and ``kept`` for rows that ``measure`` has measured."""
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The row travels whole in one struct, so columns that are named like measures stay. A
    column that the optimizer may not evaluate twice keeps the filter above the measures;
    pushed below, it would compute them once for each use.
    """
    row = docs.select(F.col(f"`{text}`").alias("_q_in"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"))
    measured = measure(row, "_q_in").withColumn("_q_once", F.monotonically_increasing_id())
    return judge(measured, rules).where("kept").where("_q_once >= 0").select("_q_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five base measures, base_failed, kept and the further measures of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(measure(docs)).select("doc_id", *BASE_COLUMNS, "base_failed", "kept", *MEASURES[len(BASE_COLUMNS):])


def oracle() -> str:
    """The query in DuckDB's SQL, with the rules compiled from the same table."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    ratios = [(f"(CASE WHEN {r.denominator} = 0 THEN 0.0 ELSE {r.numerator} / {r.denominator} END)" if r.denominator else r.numerator, r) for r in RULES]
    rules = " AND ".join([f"{x} >= {r.low}" for x, r in ratios if r.low is not None] + [f"{x} <= {r.high}" for x, r in ratios if r.high is not None])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS c FROM dup),
rep AS (SELECT rid, sum(c) AS c FROM cov GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.c, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
    CAST(len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS BIGINT) AS n_alpha_words,
    CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(list_zip(words[2:], words[:-2]), lambda x: x[1] = x[2])) AS BIGINT) AS n_echo_words,
    CAST(len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t]*[-*\x{{2022}}|]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, {", ".join(BASE_COLUMNS)}, base_failed, NOT base_failed AND {rules} AS kept, {", ".join(MEASURES[len(BASE_COLUMNS):])} FROM b
"""
