"""Quality rules, line first: lines that fail a rule go, then documents that lose too much.

DataFrame functions only. Every line of a document meets three rules:

* punctuation: too large a part of its characters is neither letter, digit nor white space;
* navigation: menu separators between its items, or a short line without an end mark;
* boilerplate: it holds a phrase of site furniture.

A document fails when its failing lines hold more than `max_loss` of its word characters, or
when no line with a word is left. The base rules of the contract (too few words, too many
words in repeated windows) come on top.

Defined results: a null text has no words, no lines and fails; an empty text likewise. Repeated
rows and ids are each judged by themselves; extra columns are ignored by `measure` and passed
on by `clean`. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import SPACE

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Our own thresholds of the line rules.
MAX_PUNCT = 0.2
MIN_SEPARATORS = 3
SHORT_LINE_WORDS = 4
MAX_LOSS = 0.5
SEPARATORS = "|»›·•"
END_MARKS = ".!?…:;,。！？\"'”’»)]"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here", "sign up now",
    "skip to content", "skip to main content", "share on facebook", "share on twitter",
    "powered by wordpress", "accept cookies", "accept all cookies", "back to top",
)
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def any_phrase(text: Column) -> Column:
    # the lambda lets the lower-cased text be made once
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE]))


def line_fails(line: Column, furniture: Column) -> Column:
    """Whether a line breaks one of the rules; lines without a word never do.

    furniture: whether the document holds a boilerplate phrase at all.
    """
    marks = F.length(F.regexp_replace(F.regexp_replace(line, r"[A-Za-z0-9\x20\x09-\x0D]+", ""), r"[\p{L}\p{M}\p{N}]+", ""))
    menu = line.rlike(f"(?:[{SEPARATORS}][^{SEPARATORS}]*){{{MIN_SEPARATORS}}}")
    long_enough = line.rlike(rf"^{SPACE}*(?:[^\x20\x09-\x0D]+{SPACE}+){{{SHORT_LINE_WORDS - 1}}}[^\x20\x09-\x0D]")
    trimmed = F.rtrim(line, F.lit(BLANKS))
    no_end = (trimmed != "") & (F.instr(F.lit(END_MARKS), F.substring(trimmed, -1, 1)) == 0)
    return (marks > MAX_PUNCT * F.length(line)) | menu | (~long_enough & no_end) | (furniture & any_phrase(line))


def measure(docs: DataFrame, max_loss: float = MAX_LOSS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the counts and the verdicts; `keep` names further columns of `docs` to pass on.

    `cleaned` is the text without its failing lines.
    """
    at = F.col
    own = [F.col(c).alias(f"_in_{c}") for c in keep or []]
    d = docs.select("doc_id", *own, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumns(
        {"_words": words_of(at("_t")), "_lines": F.split("_t", "\n"), "_furniture": any_phrase(at("_t"))}
    )
    bad = lambda x: line_fails(x, at("_furniture"))
    d = d.withColumns(
        {
            "_n": F.size("_words"),
            "_full": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_wins": F.when(
                F.size("_words") >= WINDOW,
                F.transform(
                    F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
                ),
            ),
            "_bad": F.filter("_lines", bad),
        }
    )
    d = d.withColumns(
        {
            "_sorted": F.when(
                F.size(F.array_distinct("_wins")) < F.size("_wins"),
                F.sort_array(F.transform("_wins", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
            ),
        }
    )
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["w"] == x["w"], F.lit(False))
    d = d.withColumn(
        "_starts",
        F.when(
            at("_sorted").isNotNull(),
            F.sort_array(
                F.transform(F.filter("_sorted", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])
            ),
        ),
    )
    d = d.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform(
                    "_starts",
                    lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW))),
                ),
                F.lit(0),
                lambda a, x: a + x,
            ),
            F.lit(0),
        ).cast("long"),
    )
    d = d.withColumns(
        {
            "n_words": at("_n").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "lost_chars": F.when(
                F.size("_bad") > 0, F.length(F.regexp_replace(F.array_join("_bad", ""), f"{SPACE}+", ""))
            )
            .otherwise(0)
            .cast("long"),
            "n_bad_lines": F.size("_bad").cast("long"),
        }
    )
    d = d.withColumn(
        "base_failed",
        (at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEAT_PERCENT * at("n_words")),
    ).withColumn(
        "kept",
        ~at("base_failed") & (at("lost_chars") < at("word_chars")) & (at("lost_chars") <= max_loss * at("word_chars")),
    )
    cleaned = F.when(F.size("_bad") > 0, F.array_join(F.filter("_lines", lambda x: ~bad(x)), "\n")).otherwise(
        at("_t")
    )
    passed = [cleaned.alias("cleaned"), *(at(f"_in_{c}").alias(c) for c in keep or [])] if keep is not None else []
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_chars", "n_bad_lines", *passed,
    )


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of `docs`."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    found = measure(packed, max_loss, keep=["row"])
    # a filter on a row number can't be moved below the measures, where it would repeat them per use
    found = found.withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0")
    kinds = dict(docs.dtypes)
    new = {"text": F.col("cleaned"), "doc_id": F.col("doc_id")} | {c: F.col("row")[c] for c in rest}
    if "n_chars" in kinds:
        new["n_chars"] = F.length("cleaned").cast(kinds["n_chars"])
    return found.select(*[new[c].alias(c) for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs)


_PHRASES = "|".join(BOILERPLATE)
_BAD = rf"""(length(regexp_replace(x, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) > 0.2 * length(x)
    OR length(regexp_replace(x, '[^|»›·•]+', '', 'g')) >= 3
    OR (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) BETWEEN 1 AND 3
        AND NOT regexp_matches(x, '[.!?…:;,。！？"''”’»)\]][\x20\x09-\x0D]*$'))
    OR regexp_matches(lower(x), '{_PHRASES}'))"""

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      string_split(t, chr(10)) AS ls FROM d),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
hot AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS p FROM hot) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
   - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(length(regexp_replace(array_to_string(list_filter(ls, lambda x: {_BAD}), ''), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS lost_chars,
  len(list_filter(ls, lambda x: {_BAD}))::BIGINT AS n_bad_lines
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars < word_chars AND lost_chars <= 0.5 * word_chars AS kept,
  lost_chars, n_bad_lines
FROM m
"""
