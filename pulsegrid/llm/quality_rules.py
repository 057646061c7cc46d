"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps one failure bit a rule beside the measurements. Policies
(named, versioned masks) are then applied to the bits without touching the text again, and ablations ("how many
documents would a policy keep without rule r, how many fail by r alone") come from sums over the few distinct masks.

Defined results: a null text counts as empty; an empty text has no words and fails ``few_words``; a repeated row gets its
own ledger row; an empty table gives an empty ledger; columns other than the key are left behind, so clashing names of
the input cannot occur in the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD

#: Bit by bit, in this order for good: a rule's name and the SQL over the measurements that is true if it fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("exclaiming", "10 * n_exclaims > n_words"),
    ("too_many_words", "n_words > 1000000"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document; a changed set gets a new version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
#: Length alone rejects no document: too_many_words stays in the ledger for policies that name it.
WEB = Policy("web", 2, tuple(r for r in BITS if r != "too_many_words"))


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key and what the rules compare.

    Repeated three-word windows are found in the row, in n log n steps: each window becomes one long (hash bits above,
    position bits below), the longs are sorted, and windows whose hash bits another one shares are compared word by word.
    """
    t = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    w = t.select("_k", "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.split("_t", "\n").alias("_l"))
    w = w.withColumn("_n", F.size("_w")).withColumn("_worded", F.filter("_l", lambda x: x.rlike(WORD)))
    w = w.withColumn("_pb", F.length(F.bin(F.col("_n").cast("long"))))
    w = w.withColumn(
        "_s",
        F.sort_array(
            F.expr(
                "CASE WHEN _n < 3 THEN cast(array() AS array<bigint>) ELSE "
                "transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _pb) | i) END"
            )
        ),
    )
    # windows whose hash bits equal a neighbour's
    same = "shiftright({a}, _pb) <=> shiftright(get({of}, {j}), _pb)"
    w = w.withColumn("_d", F.expr(f"filter(_s, (k, j) -> ({same.format(a='k', of='_s', j='j + 1')}) OR (j > 0 AND {same.format(a='k', of='_s', j='j - 1')}))"))
    # these are sorted once more, by their words, so that equal windows stand side by side whatever their hash bits
    at = "cast(k & (shiftleft(1L, _pb) - 1) AS int)"
    w = w.withColumn("_p", F.sort_array(F.expr(f"transform(_d, k -> struct(get(_w, {at}) AS a, get(_w, {at} + 1) AS b, get(_w, {at} + 2) AS c, {at} AS at))")))
    equal = "(p.a = {o}.a AND p.b = {o}.b AND p.c = {o}.c)"
    twice = f"(j + 1 < size(_p) AND {equal.format(o='get(_p, j + 1)')}) OR (j > 0 AND {equal.format(o='get(_p, j - 1)')})"
    w = w.withColumn("_r", F.sort_array(F.expr(f"transform(filter(_p, (p, j) -> {twice}), p -> p.at)")))
    covered = F.expr(
        "CASE WHEN size(_r) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(_r, 2, size(_r) - 1), slice(_r, 1, size(_r) - 1), "
        "(b, a) -> least(3, b - a)), 0L, (x, y) -> x + y) END"
    )
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    return w.select(
        F.col("_k").alias(key),
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_worded").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        count("!").alias("n_exclaims"),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set if rule i fails."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, key, text).withColumn("fail_bits", bits)


def kept(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds the verdict of one policy and its version."""
    return rows.withColumn("kept", kept(policy)).withColumn("policy", F.lit(f"{policy.name}/{policy.version}"))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and kept if it were dropped."""
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias
    return each.groupBy("rule", "bit").agg(total(hit)("n_failed"), total(hit & rest)("n_only"), total(rest)("n_kept_without"))


def quality_rules(docs: DataFrame, policy: Policy = WEB, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = ledger(docs, key, text)
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    out = apply_policy(rows.withColumn("base_failed", base), policy)
    return out.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def keep(docs: DataFrame, policy: Policy = WEB, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that pass both the base rules and the policy."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("_text"))
    # the row number keeps the filter above the measurements: pushed below, it would repeat them inside its condition
    found = quality_rules(whole, policy, key="_doc", text="_text").withColumn("_row", F.monotonically_increasing_id())
    return found.where("kept AND _row >= 0").select("_doc.*")
