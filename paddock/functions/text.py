"""Token-level expressions for the text pipeline (array functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English stop words (alphabetic entries of the common NLTK list),
# then the domain additions and the three words kept because they carry meaning.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
DOMAIN_STOP_WORDS = ("op", "tchd", "final", "furlong")
KEPT_WORDS = ("no", "up", "off")

PUNCT_PATTERN = r'[,;:?!()\[\]{}"]'
TRAILING_PERIODS = r"\.+$"
CONTRACTION_SUFFIX = r"('s|'re|'ve|'ll|'d|'m|n't)$"
ALPHA = r"^\p{L}+$"
# the same two token-end rules applied to whole text (tokens end at whitespace)
TEXT_PERIODS = r"\.+(?=\s|$)"
TEXT_CONTRACTIONS = r"('s|'re|'ve|'ll|'d|'m|n't)(?=\s|$)"


def stop_words() -> list[str]:
    words = [w for w in ENGLISH_STOP_WORDS if w not in KEPT_WORDS]
    return sorted(set(words) | set(DOMAIN_STOP_WORDS))


def tokenize(text: Column, stops: list[str] | None = None) -> Column:
    """Lower, split punctuation and contractions, keep alphabetic non-stop tokens."""
    stops = stop_words() if stops is None else stops
    s = F.regexp_replace(F.lower(text), PUNCT_PATTERN, " ")
    s = F.regexp_replace(F.regexp_replace(s, TEXT_PERIODS, ""), TEXT_CONTRACTIONS, "")
    # isin over many literals becomes a hash-set lookup (InSet)
    return F.filter(F.split(s, r"\s+"), lambda t: t.rlike(ALPHA) & ~t.isin(*stops))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs as array<struct<a, b>>."""
    return F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"),
                        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b"))


def greedy_merge_flags(tokens: Column, flagged: Column, joiner: str = "_") -> Column:
    """Greedy left-to-right merge given a 0/1 flag per adjacent pair.

    Inside a run of flagged pairs the greedy scan takes every other pair,
    starting with the first.  Writing the flags as a string, replacing "11"
    by "10" left to right (non-overlapping) marks exactly the taken pairs.
    The taken marks, the next token and the previous mark are zipped with the
    tokens, so the per-element lambda only reads its own struct: O(n) per
    clause (nothing inside the lambda rescans the row).
    """
    return greedy_merge_marks(tokens, F.array_join(F.transform(flagged, lambda b: F.when(b, "1").otherwise("0")), ""), joiner)


def position_marks(positions: Column, n: Column) -> Column:
    """A string of ``n`` marks, "1" at each of the sorted, distinct ``positions`` (from 0), "0" elsewhere; linear."""
    before = F.concat(F.array(F.lit(-1)), positions)
    gaps = F.zip_with(positions, F.slice(before, 1, F.greatest(F.size(positions), F.lit(0))), lambda h, p: F.concat(F.repeat(F.lit("0"), h - p - 1), F.lit("1")))
    head = F.array_join(gaps, "")
    return F.concat(head, F.repeat(F.lit("0"), n - F.length(head)))


def greedy_merge_marks(tokens: Column, flagstr: Column, joiner: str = "_") -> Column:
    """``greedy_merge_flags`` for pair flags given as a string of 0 and 1."""
    n = F.size(tokens)
    taken = F.split(F.regexp_replace(flagstr, "11", "10"), "")
    prev = F.concat(F.array(F.lit("0")), taken)
    nxt = F.slice(tokens, 2, F.greatest(n - 1, F.lit(1)))
    z = F.arrays_zip(tokens.alias("t"), nxt.alias("nx"), taken.alias("tk"), prev.alias("pv"))
    emit = F.transform(z, lambda e: F.when(
        e["tk"] == "1", F.concat(e["t"], F.lit(joiner), e["nx"])
    ).when(e["pv"] == "1", F.lit(None).cast("string")).otherwise(e["t"]))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.filter(emit, lambda x: x.isNotNull()))


def greedy_merge(tokens: Column, flags: Column, joiner: str = "_") -> Column:
    """Left-to-right merge: where pair (i, i+1) is flagged and token i is free,
    emit ``a_b`` and consume both tokens; otherwise emit token i."""
    flags = F.coalesce(flags, F.array().cast("array<int>"))
    init = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc, i):
        tok = F.element_at(tokens, i + 1)
        nxt = F.element_at(tokens, i + 2)
        merge = F.array_contains(flags, i)
        return F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["out"].alias("out"))).otherwise(
            F.when(merge, F.struct(F.lit(True).alias("skip"),
                                   F.array_append(acc["out"], F.concat(tok, F.lit(joiner), nxt)).alias("out")))
            .otherwise(F.struct(F.lit(False).alias("skip"), F.array_append(acc["out"], tok).alias("out"))))

    n = F.size(tokens)
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(
        F.aggregate(F.sequence(F.lit(0), n - 1), init, step)["out"])
