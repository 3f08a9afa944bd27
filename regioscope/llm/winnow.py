"""Document fingerprints by winnowing, in DataFrame functions only.

Text is lower-cased. A gram is ``k`` characters, of any script and with the blanks between them. Grams begin at every word start and, as
unspaced text (Chinese, Thai, encoded data) has none, at every character that has ``deep`` or more characters without white space before it.
Whether a gram begins at a place is told by the few characters before it, never by where a run ends. The grams' hashes stand in order;
of every window of ``w`` hashes the least is kept, the rightmost of equals, with its position (the number of its gram).
Two texts that share a passage in which ``w`` grams begin and end thus share a fingerprint, the grams that begin in its first ``deep``
characters set aside: k + w characters and deep more without white space, some 140 in prose. A fingerprint is packed as 36 bits of hash over 27 bits of reversed position, so that a
least number is the least hash at the rightmost place; windows are reduced by doubling.

``with_neighbour`` pairs each document with the next one in descending id (the last with the first)
without a global sort: ids fall into ranges by approximate quantiles, an id that fills several quantiles
(such as no id at all) is dealt over as many ranges by the hash of its texts, a window runs inside each
range, and the first document of every range is lent to the range before it. The number of ranges
follows the rows, and only their heads' ids reach the driver.

Edge cases: null text counts as empty, text without a character besides white space gives an empty fingerprint; text without a whole gram gives one
hash of it all; fewer than w hashes give one minimum; null ids come last; equal ids follow each
other in the order of a text hash; a single document is its own neighbour; empty tables give none.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = -(1 << 63)
#: Characters of a gram, grams of a window, characters without white space after which every place begins a gram.
K, W, DEEP = 32, 16, 16
POS = 27
_MASK = (1 << POS) - 1


def _packed(h: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - 36), POS).bitwiseOR(F.lit(_MASK) - i)


def fingerprints(df: DataFrame, text: str, out: str, k: int, w: int, deep: int = DEEP) -> DataFrame:
    """Adds ``out``: packed fingerprints in order of position."""
    grams, keys = f"{out}_g", f"{out}_h"
    begins = rf"(?s)(?:(?<!\S)|(?<=\S{{{deep}}}))(?=(\S.{{{k - 1}}}))\S"
    df = df.withColumn(grams, F.regexp_extract_all(F.lower(text), F.lit(begins), F.lit(1)))
    whole = F.array(_packed(F.xxhash64(F.lower(text)), F.lit(0).cast("bigint")))
    packed = F.transform(grams, lambda g, i: _packed(F.xxhash64(g), i.cast("bigint")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(keys, F.when(F.size(grams) > 0, packed).when(F.col(text).rlike(r"\S"), whole).otherwise(none)).drop(grams)
    df = df.withColumn(out, F.when(F.size(keys) >= w, F.col(keys)).when(F.size(keys) > 0, F.array(F.array_min(keys))).otherwise(none)).drop(keys)
    wide = 1  # every entry is the least of so many; short arrays are reduced already
    while wide < w:
        step = min(wide, w - wide)
        left = F.size(out) - step
        joined = F.zip_with(F.slice(out, F.lit(1), left), F.slice(out, F.lit(step + 1), left), lambda a, b: F.least(a, b))
        df = df.withColumn(out, F.when(left > 0, joined).otherwise(F.col(out)))
        wide += step
    return df.withColumn(out, F.array_distinct(out))


def hashes(fp: str) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, POS)))


def rendered(fp: str) -> Column:
    """``hash@position`` in order of position, comma-joined."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, POS))), F.lit("@"), (F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def place(o: Column, tie: Column, cuts: list[int]) -> Column:
    """Range of a row in the order of descending o, then tie (63 bits): cuts above o, and for an o that is several cuts a share of tie."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    le = lambda values: F.size(F.filter(values, lambda c: c <= o))
    block = le(F.lit(cuts[::step]))  # two levels: not every cut is compared with every row
    upto = F.when(block > 0, (block - 1) * step + le(F.slice(F.lit(cuts), (block - 1) * step + 1, F.lit(step)))).otherwise(0)
    repeated = {c: n for c, n in Counter(cuts).items() if n > 1}
    at = F.lit(len(cuts)) - upto
    for c, n in sorted(repeated.items()):
        at = F.when(o == c, at + F.least(F.lit(n - 1), F.floor(tie / F.lit(2.0**63) * n))).otherwise(at)
    return at.cast("int")


def in_ranges(df: DataFrame, key: str, rows_a_range: int = 2000, most_ranges: int = 8192) -> DataFrame:
    """The rows with their range r, and the first row of each range once more as ghost 1 of the range before it; o and tie are their order."""
    o, tie = F.coalesce(F.col(key), F.lit(LEAST)), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    df = df.withColumns({"o": o, "tie": tie})
    total = df.count()
    n = max(1, min(most_ranges, total // rows_a_range))
    cuts = sorted(df.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 100 * n)).first()[0]) if n > 1 else []
    df = df.withColumn("r", place(F.col("o"), F.col("tie"), cuts))
    first = F.max(F.struct("o", (-F.col("tie")).alias("tie")))
    heads = [(h.r, h.first.o, -h.first.tie) for h in sorted(df.groupBy("r").agg(first.alias("first")).collect())]
    lend = df.sparkSession.createDataFrame([(heads[k - 1][0], o, t) for k, (_, o, t) in enumerate(heads)], "to int, o bigint, tie bigint")
    ghosts = df.join(F.broadcast(lend), ["o", "tie"]).dropDuplicates(["to"]).withColumn("r", F.col("to")).drop("to").withColumn("ghost", F.lit(1))
    return df.withColumn("ghost", F.lit(0)).unionByName(ghosts)


def following(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next row of the range for the carried columns."""
    w = Window.partitionBy("r").orderBy("ghost", F.desc("o"), "tie")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})


def with_neighbour(df: DataFrame, key: str, carried: list[str], rows_a_range: int = 2000, most_ranges: int = 8192) -> DataFrame:
    """Adds ``next_<column>`` of the next row in descending key for the carried columns."""
    return following(in_ranges(df, key, rows_a_range, most_ranges), carried).where("ghost = 0").drop("o", "r", "tie", "ghost")


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Rows are dealt to ranges once, with their texts; a text and its edited text are fingerprinted once each, in the range.
    """
    df = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    df = following(in_ranges(df, "doc_id"), ["text"])
    n = F.char_length("text")
    cutoff = F.floor(n / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cutoff), F.substring("next_text", F.lit(1), cutoff))).withColumn("n_chars", n.cast("bigint")).drop("next_text")
    df = fingerprints(fingerprints(df, "text", "fp", k, w).drop("text"), "edited", "efp", k, w)
    df = df.withColumns({"edited_sha256": F.sha2("edited", 256), "a": hashes("fp"), "b": hashes("efp")}).drop("edited")
    df = following(df, ["a"]).where("ghost = 0")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", rendered("fp").alias("fingerprint"), rendered("efp").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "next_a").alias("near_next"),
    )
