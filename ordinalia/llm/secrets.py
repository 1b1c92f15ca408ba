"""Secret scans [native]: known patterns, and a battery of randomness tests for tokens that no pattern names.

Three base kinds are found by pattern.  Every other long token gets an inferred encoding and three tests: is its
alphabet used uniformly (chi-squared), do its symbols cross the middle of the alphabet as often as random ones
(runs), are neighbours uncorrelated (serial correlation)?  The uniformity statistic is judged against what ordinary
text of the *same length* in that alphabet would give, so that a short token, on which the test has little power,
has a large p-value; a Benjamini-Hochberg bound per (encoding, length band), counted over all tokens of the corpus,
decides which are reported.  Runs and serial correlation must not contradict randomness.

Everything is an expression over built-in functions.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ordinalia.llm.common import restored, shielded, text_of, written
from ordinalia.runtime import checked_broadcast, cut

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds (ASCII letters only are folded).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
#: encoding -> (what the token looks like, alphabet in order); the first that fits is taken, others are not tested.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (
        "base64url",
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    ),
    (
        "base64",
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    ),
)
#: Sum of squared symbol shares in ordinary text written in letters and digits.
TEXT_COLLISION = 0.065
#: Share of false reports allowed per (encoding, length band); smallest p-value of the other two tests.
FDR, NOT_RANDOM = 0.01, 0.001
#: Upper ends of the length bands, and p-value bins per factor of ten.
BANDS, BINS, LAST_BIN = (24, 32, 48, 96), 20, 6000


def _spans(text: Column, pattern: str, kind: int, shortest: int = 0) -> Column:
    """Spans of the leftmost matches that do not overlap; those with a group 2 under ``shortest`` are dropped."""
    group = 2 if shortest else 0
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        found.alias("m"),
        F.slice(between, F.lit(1), F.size(found)).alias("b"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.when(F.length(x["g"]) < shortest, acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["b"])).alias("start"),
                            F.lit(kind).alias("kind"),
                            (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"),
                        )
                    ),
                )
            )
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


#: Fixed values of the published polynomial for the normal distribution function; levels of the continued fraction.
_POLYNOMIAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
LEVELS = 12


def normal_cdf(z: Column) -> Column:
    """Normal distribution function; its lower tail has a small relative error, for that is what false discovery compares.

    Below -2 the continued fraction of the Mills ratio (relative error under 0.001), above a polynomial (absolute error
    under 1e-7).
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    ratio = x
    for level in range(LEVELS, 0, -1):
        ratio = x + level / ratio
    t = 1 / (1 + 0.2316419 * x)
    polynomial = F.lit(0.0)
    for c in reversed(_POLYNOMIAL):
        polynomial = (polynomial + c) * t
    tail = F.when(x > 2, density / ratio).otherwise(density * polynomial)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _alphabet(encoding: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, alphabet in ENCODINGS:
        out = F.when(encoding == name, F.lit(alphabet)).otherwise(out)
    return out


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``encoding`` (null: none fits, not tested), ``p_text``, ``p_runs`` and ``p_serial`` to a table of tokens.

    ``p_text``: probability that ordinary text of this length and alphabet looks at least as uniform.  ``p_runs``,
    ``p_serial``: two-sided, under randomness.
    """
    body = F.regexp_replace(F.col(token), "=+$", "")
    kind = F.lit(None).cast("string")
    for name, shape, _ in reversed(ENCODINGS):
        kind = F.when(body.rlike(shape), F.lit(name)).otherwise(kind)
    symbols = F.split("_body", "")
    places = F.transform("_symbols", lambda c: F.instr(F.col("_alphabet"), c).cast("double"))
    df = (
        tokens.withColumn("encoding", kind)
        .withColumn("_body", F.when(F.col("encoding").isNotNull(), body).otherwise(""))
        .withColumn("_alphabet", _alphabet(F.col("encoding")))
        .withColumn("_a", F.length("_alphabet").cast("double"))
        .withColumn("_n", F.length("_body").cast("double"))
        .withColumn("_symbols", F.filter(symbols, lambda c: c != ""))
        .withColumn("_at", F.when(F.col("encoding").isNotNull(), places).otherwise(F.array().cast("array<double>")))
    )
    squares = F.aggregate(
        F.array_distinct("_symbols"),
        F.lit(0.0),
        lambda acc, c: acc + F.pow(F.col("_n") - F.length(F.replace(F.col("_body"), c)), F.lit(2.0)),
    )
    chi = squares * F.col("_a") / F.col("_n") - F.col("_n")
    shift = F.col("_n") * (F.col("_a") * TEXT_COLLISION - 1)
    spread = F.sqrt(2 * (F.col("_a") - 1) + 4 * shift)
    upper = lambda x: (x > F.col("_a") / 2).cast("double")
    high = F.aggregate("_at", F.lit(0.0), lambda acc, x: acc + upper(x))
    after = F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0)))
    before = F.slice("_at", F.lit(1), F.greatest(F.size("_at") - 1, F.lit(0)))
    crossings = F.aggregate(
        F.zip_with(before, after, lambda x, y: (upper(x) != upper(y)).cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    mean = F.aggregate("_at", F.lit(0.0), lambda acc, x: acc + x) / F.col("_n")
    df = df.withColumn("_mean", F.when(F.col("_n") > 0, mean)).withColumn("_high", high).withColumn("_runs", crossings + 1)
    centred = lambda x: x - F.col("_mean")
    lagged = F.aggregate(F.zip_with(before, after, lambda x, y: centred(x) * centred(y)), F.lit(0.0), lambda acc, x: acc + x)
    power = F.aggregate("_at", F.lit(0.0), lambda acc, x: acc + centred(x) * centred(x))
    low = F.col("_n") - F.col("_high")
    both = 2 * F.col("_high") * low
    expected = both / F.col("_n") + 1
    deviation = F.sqrt(both * (both - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1)))
    two_sided = lambda z: 2 * (1 - normal_cdf(F.abs(z)))
    tested = F.col("encoding").isNotNull() & (F.col("_n") > 1)
    return (
        df.withColumn("p_text", F.when(tested, normal_cdf((chi - (F.col("_a") - 1) - shift) / spread)))
        .withColumn(
            "p_runs",
            F.when(tested & (both > F.col("_n")), two_sided((F.col("_runs") - expected) / deviation)).when(tested, F.lit(0.0)),
        )
        .withColumn(
            "p_serial",
            F.when(tested & (power > 0), two_sided((lagged / power + 1 / F.col("_n")) * F.sqrt("_n"))).when(tested, F.lit(0.0)),
        )
        .drop("_body", "_alphabet", "_a", "_n", "_symbols", "_at", "_mean", "_high", "_runs")
    )


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        out = F.when(length <= end, i).otherwise(out)
    return out


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """First p-value bin that is reported, by (encoding, band): Benjamini-Hochberg over all tested tokens.

    ``tested``: encoding, band, bin.  The counts per bin are at most 25 strata x 6,001 bins; the dictionary has a
    row per stratum.  A stratum without any report is absent.
    """
    stratum = ["encoding", "band"]
    tally = tested.groupBy(*stratum, "bin").count()
    over = W.partitionBy(*stratum)
    rows = (
        tally.withColumn("rank", F.sum("count").over(over.orderBy(F.desc("bin"))))
        .withColumn("all", F.sum("count").over(over))
        .where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= fdr * F.col("rank") / F.col("all"))
        .groupBy(*stratum)
        .agg(F.min("bin").alias("bin"))
    )
    return {(r["encoding"], r["band"]): r["bin"] for r in rows.collect()}


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR, with_text: bool = False) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of struct(start, kind, end), sorted; ``kind`` is the place in KINDS.

    The text column is dropped unless ``with_text`` is set, other columns stay.  ``spans`` holds the base spans and the random tokens that touch
    no base span.  A null or empty text has no spans; repeated rows stay repeated.
    """
    docs, back = shielded(docs, text, "base", "spans")
    t = F.col("_t")
    base = F.sort_array(F.concat(_spans(t, ASSIGN, 0, ASSIGN_LENGTH), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    found = (
        docs.withColumn("_t", text_of(text))
        .withColumn("base", base)
        .withColumn("_tokens", _spans(t, TOKEN, 3))
        .withColumn(
            "_tokens",
            F.filter("_tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))),
        )
        .withColumn(
            "_tokens",
            F.transform(
                "_tokens",
                lambda x: F.struct(
                    x["start"], x["kind"], x["end"], F.substring(F.col("_t"), x["start"] + 1, x["end"] - x["start"]).alias("token")
                ),
            ),
        )
        .drop("_t", *([] if with_text else [text]))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    found = written(found) if with_text else cut(found)  # row numbers are stored with the rows
    tokens = found.select("_row", F.explode("_tokens").alias("x")).select("_row", "x.*")
    tested = (
        battery(tokens)
        .where("encoding IS NOT NULL")
        .withColumn("band", _band(F.length("token")))
        .withColumn("bin", F.floor(F.least(F.lit(float(LAST_BIN)), -F.log10(F.greatest("p_text", F.lit(1e-300))) * BINS)).cast("int"))
        .drop("token")
    )
    tested = cut(tested)
    first = thresholds(tested, fdr)
    report = F.lit(False)
    for (encoding, band), at in sorted(first.items()):
        report = report | ((F.col("encoding") == encoding) & (F.col("band") == band) & (F.col("bin") >= at))
    added = (
        tested.where(report & (F.least("p_runs", "p_serial") >= NOT_RANDOM))
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("_added"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = (
        found.drop("_tokens")
        .join(checked_broadcast(cut(added)), "_row", "left")
        .withColumn("spans", F.sort_array(F.concat("base", F.coalesce("_added", none))))
        .drop("_row", "_added")
    )
    return restored(out, back)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans are replaced together."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] >= acc["at"]),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    )
