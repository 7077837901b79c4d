"""Text quality score in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The common words that count as real ones.
COMMON_WORDS = """
the be to of and a in that have i
it for not on with he as you do at
this but his by from they we say her she
or an will my one all would there their what
so up out if about who get which go me
when make can like time no just him know take
people into year your good some could them see other
than then now look only come its over think also
back after use two how our work first well way
even new want because any these give day most us
is are was were been has had did does done
said made found used called may each own should here
where more very through long little while still find
part being much too many those such before same right
mean different move between must need might try world again
place great show every last never old under keep let
begin seem help always home both around off end against
high few important until next without public another read number
word page chapter section figure table document file data information
system process method result analysis example following based using include
however therefore although within during since provide according available report
form service case study research development program company business market
product customer management project support review application user group level
value change control test performance quality standard policy issue problem
""".split()
# Weights of the total, and the bounds above which a recognised text counts as useful.
WEIGHTS = {"real_word_ratio": 0.35, "content_score": 0.30, "gibberish_penalty": 0.20, "punctuation_score": 0.15}
USEFUL_SCORE, USEFUL_WORD_RATIO = 0.2, 0.2
# Deltas beyond which a file's quality improved or regressed.
IMPROVED, REGRESSED = 0.02, -0.02

# Patterns of gibberish.
REPEATED = r"(?d)(.)\1{3,}"
CLUSTER = r"(?iu)[bcdfghjklmnpqrstvwxz]{5,}"
NO_VOWELS = r"(?iuU)\b[bcdfghjklmnpqrstvwxz]{5,}\b"
ARTIFACTS = "(?iu)â€|Ã©|Ã¨|Ã |ï»¿|�|\\\\x[0-9a-f]{2}"
NON_PRINTABLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
BLANK = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]*$"

METRICS = ("real_word_ratio", "content_score", "gibberish_penalty", "punctuation_score", "total_score", "word_count")


def is_blank(text: Column) -> Column:
    """Nothing but white space of any script; null counts as blank."""
    return F.coalesce(text, F.lit("")).rlike(BLANK)


def english_words(text: Column) -> Column:
    """Lower-case words of the letters a to z only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"), F.lit(0))


def gibberish_count(text: Column) -> Column:
    """Hits of all gibberish patterns; a run of consonants that is a whole word counts twice."""
    hits = [F.regexp_count(text, F.lit(p)) for p in (REPEATED, CLUSTER, NO_VOWELS, ARTIFACTS, NON_PRINTABLE)]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def with_quality(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the six metrics of a text column; blank and null texts have zeros throughout.

    The word list is found once per row in a column of its own, everything else is arithmetic on it.
    """
    t = F.col(text)
    staged = df.withColumn("_w", F.when(is_blank(t), F.array().cast("array<string>")).otherwise(english_words(t)))
    staged = staged.withColumn("_n", F.size("_w")).withColumn(
        "_c", F.size(F.filter("_w", lambda w: w.isin(COMMON_WORDS)))
    )
    staged = staged.withColumn("_g", F.when(F.col("_n") > 0, gibberish_count(t)).otherwise(0)).withColumn(
        "_s", F.when(F.col("_n") > 0, F.regexp_count(t, F.lit("[.!?]"))).otherwise(0)
    )
    n = F.col("_n").cast("double")
    live = F.col("_n") > 0
    real = F.when(live, F.col("_c") / n).otherwise(0.0)
    content = F.when(live, F.least(F.lit(1.0), F.log10(n + 1) / 4.0)).otherwise(0.0)
    gibberish = F.when(live, F.least(F.lit(1.0), F.col("_g") / F.greatest(n / 10, F.lit(1.0)))).otherwise(0.0)
    punctuation = F.when(live, F.least(F.lit(1.0), F.col("_s") / (n / 15))).otherwise(0.0)
    staged = staged.withColumns(
        {
            f"{prefix}real_word_ratio": real, f"{prefix}content_score": content,
            f"{prefix}gibberish_penalty": gibberish, f"{prefix}punctuation_score": punctuation,
        }
    )
    w = WEIGHTS
    total = (
        F.col(f"{prefix}real_word_ratio") * w["real_word_ratio"]
        + F.col(f"{prefix}content_score") * w["content_score"]
        - F.col(f"{prefix}gibberish_penalty") * w["gibberish_penalty"]
        + F.col(f"{prefix}punctuation_score") * w["punctuation_score"]
    )
    return staged.withColumn(f"{prefix}total_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).withColumn(
        f"{prefix}word_count", F.col("_n")
    ).drop("_w", "_n", "_c", "_g", "_s")


def is_useful(total: Column, real_ratio: Column, text: Column) -> Column:
    """Whether a recognised text was worth recognising."""
    return ~is_blank(text) & (total > USEFUL_SCORE) & (real_ratio > USEFUL_WORD_RATIO)


def delta_class(delta: Column) -> Column:
    """improved, unchanged or regressed; null for an unknown delta."""
    return (
        F.when(delta > IMPROVED, "improved").when(delta < REGRESSED, "regressed").when(delta.isNotNull(), "unchanged")
    )
