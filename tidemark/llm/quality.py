"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.
A policy is a versioned set of rule names, so applying, comparing or ablating policies only touches the
ledger's bits and never the texts again.

Defined cases: a null text has no words, lines or symbols; an empty text likewise; rows are judged one by one,
so repeated rows give repeated results and an empty table an empty ledger. Columns of the input pass through;
those that clash with the ledger's names are replaced by the ledger's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spare, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: name, SQL condition of failure over the measurements. A rule's bit is its place here; append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("many_repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
)

#: The versions stay as they were published; a new choice of rules is a new version.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
    # one or two repeated lines alone do not reject a short clean text
    "v2": ("few_words", "repeated_windows", "symbols", "many_repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def _repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; found: array of words.

    Hashes of the windows are compared first; only texts with a repeat sort (hash, place) pairs and mark places.
    """

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: F.get(s, k)["h"] == F.get(s, k + j)["h"]
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, 1), F.lit(False)) | F.coalesce(F.when(k > 0, same(k, -1)), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.get(s, k)["i"] + d)))))

        return let(pairs, places)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(found, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements; each text is read once for its words and once for its lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    own = spare(docs, "measures")
    held = docs.withColumn(own, both)
    found = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}
    return held.withColumns({name: F.col(f"{own}.{found[name]}") for name in MEASURES}).drop(own)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with measurements and failed_bits, a bit for each rule of RULES that the text fails."""
    bits = [F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, sql) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, text_col).withColumn("failed_bits", total.cast("long"))


def passes(policy: str, bits: Column | None = None) -> Column:
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(judged: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails (kept without the rule).

    One aggregation over the ledger with map-side partial sums; the result has a row for each rule.
    """
    names = [name for name, _ in RULES if name in POLICIES[policy]]
    bit = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    inside = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count_if(inside.bitwiseAND(F.lit(bit[n])) != 0).alias(f"f{k}") for k, n in enumerate(names)]
    sums += [F.count_if(inside == bit[n]).alias(f"o{k}") for k, n in enumerate(names)]
    one = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside == 0).alias("kept"), F.bit_or("failed_bits").alias("seen_bits"), *sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_failed_alone")) for k, n in enumerate(names)])
    return one.select(F.explode(rows).alias("r"), "n", "kept", "seen_bits").select(F.lit(policy).alias("policy"), "r.*", F.col("n").alias("n_documents"), F.col("kept").alias("n_kept"), "seen_bits")
