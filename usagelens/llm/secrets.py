"""Secret scans: fixed patterns plus sliding-window Shannon entropy. DataFrame functions only.

Base kinds are matched leftmost without overlap and then filtered by length (see `BASE`).
On top, runs of token characters are candidates. Each belongs to a class (hexadecimal,
alphanumeric, base64), whose window entropy is followed by incremental counts: a window of
WINDOW characters slides over the run, the sum of c*log2(c) over its character counts c changes
only by the character that leaves and the one that enters, and the entropy is
log2(WINDOW) - sum / WINDOW. Windows at or over the class's threshold are merged into spans of
kind `entropy`. A name glued to a secret does not change its class: the letters and digits of a
run between its other signs, and hexadecimal digits between other letters, are candidates too.
An allow-list suppresses candidates that are no secrets: UUIDs, digits or letters alone, and
runs of the alphabet or of digits and stated examples, of which only windows that touch them are
passed over and the rest of the run is looked at. It never touches base spans.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has
no spans; repeated rows are each scanned; spans of two kinds may overlap; an empty table gives
an empty result. `scan` ignores extra columns, `redact` passes them on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group whose length counts, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # shorter runs of hexadecimal digits can't be matches, so the length stands in the pattern
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Within runs: letters and digits next to another sign, hexadecimal digits next to another letter.
PARTS = [
    r"(?<=[+/_=-])[A-Za-z0-9]{20,}+|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{20,}+(?=[+/_=-])",
    r"(?<=[G-Zg-z])[0-9a-fA-F]{20,}+|(?<![A-Za-z0-9])[0-9a-fA-F]{20,}+(?=[G-Zg-z])",
]
WINDOW = 20
#: Bits per character from which a window is suspicious, by class.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.8}
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"^[A-Z]?[a-z_=+/-]+$",
    r"^[A-Z_=+/-]+$",
    r"(?i)example|placeholder|changeme|xxxxxx",
    r"(?i)0123456789|abcdefghij",
]
#: The words of the last two, by which a run is cut.
STATED = ["example", "placeholder", "changeme", "xxxxxx", "0123456789", "abcdefghij"]
MASK = "[SECRET]"


def located(text: Column, pattern: str, group: int) -> tuple[Column, Column]:
    """Arrays that together locate the matches: the pieces between them, and (match, group)."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return pieces, F.arrays_zip(whole.alias("m"), part.alias("g"))


#: Matches are summed up in parts of this many, so that the work on very many of them stays linear.
PART = 256


def running(numbers: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """Sums, or another way to join whole numbers from 0 on, of an array through each place."""
    none = F.expr("CAST(array() AS array<int>)")
    last = lambda xs: F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(0))
    through = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(joined(last(acc), x))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(numbers) - 1), F.lit(PART))
    inner = F.transform(starts, lambda i: through(F.slice(numbers, i + 1, PART)))
    before = lambda each: F.slice(F.concat(F.array(F.lit(0)), through(F.transform(each, last))), 1, F.size(each))
    # the transform over a one-element array lets the inner sums be made once
    both = F.transform(F.array(inner), lambda each: F.zip_with(each, before(each), lambda xs, b: F.transform(xs, lambda x: joined(b, x))))
    return F.flatten(F.flatten(both))


def placed(pieces: Column, matches: Column) -> Column:
    """array<struct<s, e, m, g>> of all matches, by running lengths."""
    sizes = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, z: F.length(p) + F.length(z["m"]))
    return F.zip_with(
        running(sizes, lambda a, b: a + b), matches, lambda end, z: F.struct((end - F.length(z["m"])).alias("s"), end.alias("e"), z["m"].alias("m"), z["g"].alias("g"))
    )


#: What a candidate is made of: a character's place here is that of its count.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."
ZERO = ord("A")


def counted(counts: Column, place: Column) -> Column:
    """The count at a place of a string of counts, A for none."""
    return F.ascii(F.substring(counts, place, 1)) - ZERO


def changed(counts: Column, place: Column, n: Column) -> Column:
    return F.overlay(counts, F.chr(n + ZERO), place, F.lit(1))


def xlogx(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)


def entropy_spans(run: Column, threshold: Column, window: int = WINDOW) -> Column:
    """array<struct<s, e>>: merged windows of the ASCII string `run` at or over the threshold.

    The state holds the window, to tell which character leaves, and how often each is in it: at each
    step the one that comes in goes one up, the one that leaves one down, and the entropy's sum follows both.
    """
    # s and e are the span still open (e is -1 before the first); the threshold is worked out once, not at each step
    kinds = "struct<i:int,w:string,n:string,sum:double,s:int,e:int,out:array<struct<s:int,e:int>>,t:double>"
    state = F.struct(F.lit(0), F.lit(""), F.lit(chr(ZERO) * len(LETTERS)), F.lit(0.0), F.lit(-1), F.lit(-1), F.array(), threshold).cast(kinds)
    place = lambda char: F.position(char, F.lit(LETTERS))

    def named(acc: Column, char: Column) -> Column:
        """Places of the characters that come and leave (0 if the window isn't full yet)."""
        full = acc["i"] >= window
        return F.struct(
            place(char).alias("come"), F.when(full, place(F.substring(acc["w"], 1, 1))).otherwise(0).alias("gone"),
            F.concat(F.when(full, F.substring(acc["w"], 2, window)).otherwise(acc["w"]), char).alias("w"),
        )

    def leave(acc: Column, at: Column) -> Column:
        n = counted(acc["n"], at["gone"])
        full = at["gone"] > 0
        return F.struct(
            at["w"].alias("w"), at["come"].alias("come"), F.when(full, changed(acc["n"], at["gone"], n - 1)).otherwise(acc["n"]).alias("n"),
            F.when(full, acc["sum"] - xlogx(n) + xlogx(n - 1)).otherwise(acc["sum"]).alias("sum"),
        )

    def enter(left: Column) -> Column:
        n = counted(left["n"], left["come"])
        return F.struct(left["w"].alias("w"), changed(left["n"], left["come"], n + 1).alias("n"), (left["sum"] - xlogx(n) + xlogx(n + 1)).alias("sum"))

    closed = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))

    def note(acc: Column, now: Column) -> Column:
        end = acc["i"] + 1
        begin = end - window
        hot = (end >= window) & (F.log2(F.lit(float(window))) - now["sum"] / window >= acc["t"] - 1e-9)
        apart = hot & (acc["e"] < begin)
        return F.struct(
            end.alias("i"), now["w"].alias("w"), now["n"].alias("n"), now["sum"].alias("sum"), F.when(apart, begin).otherwise(acc["s"]).alias("s"),
            F.when(hot, end).otherwise(acc["e"]).alias("e"), F.when(apart & (acc["e"] >= 0), closed(acc)).otherwise(acc["out"]).alias("out"), acc["t"].alias("t"),
        )

    def step(acc: Column, char: Column) -> Column:
        # each inner transform over a one-element array gives a name to what it holds
        left = F.transform(F.array(named(acc, char)), lambda x: leave(acc, x))
        return F.get(F.transform(F.transform(left, enter), lambda x: note(acc, x)), F.lit(0))

    chars = F.filter(F.split(run, ""), lambda c: c != "")
    return F.aggregate(chars, state, step, lambda acc: F.when(acc["e"] >= 0, closed(acc)).otherwise(acc["out"]))


def long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.length(x["g"]) >= least)


def suspicious(found: Column) -> Column:
    """Entropy spans of the placed candidates, in the text's positions."""

    def of(x: Column) -> Column:
        run = x["m"]
        bits = (
            F.when(run.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"])
            .when(run.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"])
            .otherwise(THRESHOLDS["base64"])
        )
        return F.transform(
            entropy_spans(run, bits), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"))
        )

    allowed = lambda x: reduce(lambda a, b: a | b, [x["m"].rlike(p) for p in ALLOWED])
    return F.flatten(F.transform(F.filter(found, lambda x: ~allowed(x)), of))


def joined(spans: Column) -> Column:
    """array<struct<s, e>> in order, those that meet made one.

    Ends so far by running maxima; a span opens where it begins behind all ends before it. Linear in the spans.
    """
    def opened(xs: Column, tops: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(-1)), tops), 1, F.size(xs))
        with_top = F.zip_with(xs, tops, lambda x, t: F.struct(x["s"].alias("s"), t.alias("t")))
        return F.zip_with(with_top, before, lambda x, b: F.struct(x["s"].alias("s"), x["t"].alias("t"), (x["s"] > b).alias("opens")))

    def of(rows: Column) -> Column:
        # a span ends at the running maximum before the next one opens, or at the last of all
        following = F.slice(F.concat(F.transform(rows, lambda r: r["opens"]), F.array(F.lit(True))), 2, F.size(rows))
        ends = F.filter(F.zip_with(rows, following, lambda r, n: F.struct(r["t"].alias("t"), n.alias("n"))), lambda r: r["n"])
        return F.zip_with(F.filter(rows, lambda r: r["opens"]), ends, lambda r, e: F.struct(r["s"].alias("s"), e["t"].alias("e")))

    # each transform over a one-element array lets what it holds be made once
    sides = F.transform(F.array(F.sort_array(spans)), lambda xs: F.struct(xs.alias("x"), running(F.transform(xs, lambda x: x["e"]), F.greatest).alias("t")))
    return F.get(F.transform(F.transform(sides, lambda z: opened(z["x"], z["t"])), of), F.lit(0))


def without_stated(text: Column) -> Column:
    """The text with blanks, as many as characters, for each stated word."""
    cut = reduce(lambda t, w: F.regexp_replace(t, f"(?i){w}", " " * len(w)), STATED, text)
    return F.when(text.rlike("(?i)" + "|".join(STATED)), cut).otherwise(text)


def spans_of(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base and all spans (arrays of kind, start, end); `keep` as named."""
    at = F.col
    own = [at(c).alias(f"_in_{c}") for c in keep or []]
    d = docs.select("doc_id", *own, F.coalesce("text", F.lit("")).alias("_t"))
    kinds = [*BASE, ("entropy", CANDIDATE, 0, WINDOW)]
    d = d.withColumn("_c", F.when(at("_t").rlike(CANDIDATE), without_stated(at("_t"))))
    levels = [(f"run{i}", "_c", pattern, 0) for i, pattern in enumerate([CANDIDATE, *PARTS])]
    sought = [*[(kind, "_t", pattern, group) for kind, pattern, group, _ in BASE], *levels]
    new = {}
    for kind, source, pattern, group in sought:
        pieces, matches = located(at(source), pattern, group)
        hit = at(source).rlike(pattern)
        new |= {f"_p_{kind}": F.when(hit, pieces), f"_m_{kind}": F.when(hit, matches)}
    d = d.withColumns(new)
    d = d.withColumns({f"_f_{k}": F.when(at(f"_m_{k}").isNotNull(), placed(at(f"_p_{k}"), at(f"_m_{k}"))) for k, *_ in sought})
    no_runs = F.expr("CAST(array() AS array<struct<s:int,e:int,m:string,g:string>>)")
    runs = F.concat(*[F.coalesce(f"_f_{k}", no_runs) for k, *_ in levels])
    d = d.withColumn("_f_entropy", F.when(at("_f_run0").isNotNull(), runs))
    within = reduce(lambda a, b: a | b, [at(f"_f_{k}").isNotNull() for k, *_ in levels[1:]])
    d = d.withColumn("_hot", F.when(at("_f_entropy").isNotNull(), suspicious(at("_f_entropy"))))
    d = d.withColumn("_hot", F.when(within, joined(at("_hot"))).otherwise(at("_hot")))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)")

    def spans(found: Column, rank: int, kind: str) -> Column:
        return F.coalesce(
            F.transform(
                found,
                lambda x: F.struct(
                    x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end")
                ),
            ),
            none,
        )

    d = d.withColumns(
        {
            f"_{kind}": spans(long_enough(at(f"_f_{kind}"), least), rank, kind)
            for rank, (kind, _, _, least) in enumerate(BASE)
        }
        | {
            "_entropy": spans(at("_hot"), len(BASE), "entropy")
        }
    )
    base = F.sort_array(F.concat(*[at(f"_{k}") for k, *_ in BASE]))
    d = d.withColumn("_base", base).withColumn(
        "_all", F.when(F.size("_entropy") > 0, F.sort_array(F.concat("_base", "_entropy"))).otherwise(at("_base"))
    )
    return d.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in kinds],
        at("_base").alias("base_spans"),
        at("_all").alias("all_spans"),
        *[at(f"_in_{c}").alias(c) for c in keep or []],
    )


def told(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    return spans_of(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_entropy",
        F.sha2(told(F.col("base_spans")), 256).alias("base_sha256"), told(F.col("all_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """`docs` with every span of a secret replaced by the mask, n_chars brought up to date."""
    kinds = dict(docs.dtypes)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    found = spans_of(packed, keep=["row", "text"])
    # the ends of all spans so far: a span that begins before the last of them is part of the mask before it
    upto = running(F.transform("all_spans", lambda x: x["end"]), F.greatest)
    found = found.withColumns({"_upto": F.when(F.size("all_spans") > 0, upto), "_chars": F.when(F.size("all_spans") > 0, F.split("text", ""))})
    before = lambda i: F.coalesce(F.get("_upto", i - 1), F.lit(0))
    cut = lambda begin, end: F.array_join(F.slice("_chars", begin + 1, F.greatest(F.lit(0), end - begin)), "")
    piece = lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(cut(before(i), x["start"]), F.lit(mask))).otherwise("")
    last = F.get("_upto", F.size("_upto") - 1)
    masked = F.concat(F.array_join(F.transform("all_spans", piece), ""), cut(last, F.size("_chars")))
    masked = F.when(F.size("all_spans") > 0, masked).otherwise(F.col("text"))
    found = found.withColumn("_masked", masked)
    new = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("_masked")}
    if "n_chars" in kinds:
        new["n_chars"] = (
            F.when(F.size("all_spans") > 0, F.length("_masked")).otherwise(F.col("row")["n_chars"]).cast(kinds["n_chars"])
        )
    return found.select(*[new[c].alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
