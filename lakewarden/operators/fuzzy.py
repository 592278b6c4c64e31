"""Mapping names to a catalog by similarity, without comparing all pairs.

Score = 0.5 * indel ratio + 0.3 * Jaccard of name tokens + 0.2 * common prefix share, accepted from a
threshold that depends on the name's length. The threshold bounds each part from below, which gives
exact candidate filters: a common prefix of known minimal length and ``TOGETHER`` shared tokens out of the few
rarest ones. Names are joined on both; where they meet, the tokens they share and their lengths say how much of the budget
is left for the prefix, which is compared as far as that. No pair above the threshold is lost.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import top_per_key

# Weights, thresholds by name length, gap between best and second candidate.
W_INDEL, W_JACCARD, W_PREFIX = 0.5, 0.3, 0.2
THRESHOLDS = ((10, 0.95), (26, 0.90), (None, 0.85))
CLEAR_GAP = 0.05
_EPS = 1e-9
TOGETHER = 3  # rare tokens that two names have to share at once, where they have to share that many
WORD = 62  # characters whose matches fit a word of the common subsequence, with room for a carry


def normal_name(name: Column, owner_prefixes: str | None = None) -> Column:
    """Lower case, last part of a dotted name, extra underscores removed; ``owner_prefixes`` is a pattern of prefixes to drop."""
    last = F.element_at(F.split(F.lower(F.trim(name)), r"\."), -1)
    bare = F.regexp_replace(last, f"^(?:{owner_prefixes})", "") if owner_prefixes else last
    return F.trim(F.regexp_replace(bare, "_+", "_"), F.lit("_"))


def threshold(name: Column) -> Column:
    size = F.length(name)
    return F.when(size < 10, F.lit(0.95)).when(size <= 25, F.lit(0.90)).otherwise(F.lit(0.85))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.split(name, "_"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens of two token arrays."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(sizes, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def prefix_share(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(common_prefix(a, b) / longest)


def _subsequence_by_rows(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one table row at a time over the characters of ``a``; for any length."""
    width = F.length(b)
    start = F.array_repeat(F.lit(0), width + 1)

    def next_row(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda done, j: F.array_append(
                done,
                F.when(F.substring(b, j, F.lit(1)) == ch, F.element_at(row, j) + 1)
                .otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(done, -1))),
            ),
        )

    chars = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)))
    table = F.aggregate(chars, start, next_row)
    return F.when((F.length(a) == 0) | (width == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def _subsequence_by_words(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence for ``a`` of at most WORD characters, a table row in one 64-bit word.

    Bit i of the word is 0 where the row's length rises at character i of ``a``. A character of ``b`` moves the row on by an addition, whose
    carries run through the gaps, and counting zeros gives the length.
    """
    letters = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)))
    shift = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    full = shift(F.length(a)) - 1

    def moved(word: Column, ch: Column, chars: Column) -> Column:
        marks = F.transform(chars, lambda x, i: F.when(x == ch, shift(i)).otherwise(F.lit(0).cast("bigint")))
        match = F.aggregate(marks, F.lit(0).cast("bigint"), lambda m, v: m.bitwiseOR(v)).bitwiseAND(word)
        return let(match, lambda u: (word + u).bitwiseOR(word - u).bitwiseAND(full))

    def over(chars: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(b, i, F.lit(1)))
        return F.aggregate(steps, full, lambda word, ch: moved(word, ch, chars))

    return F.length(a) - F.bit_count(let(letters, over))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    found = F.when(F.length(short) <= WORD, _subsequence_by_words(short, long)).otherwise(_subsequence_by_rows(a, b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(found)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * common subsequence / total length; equal empty texts give 1."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_subsequence(a, b) / total)


def similarity(a: Column, b: Column) -> Column:
    return W_INDEL * indel_ratio(a, b) + W_JACCARD * jaccard(tokens(a), tokens(b)) + W_PREFIX * prefix_share(a, b)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where the optimizer would repeat it for each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _combinations(ts: Column, k: Column) -> Column:
    """The tokens one, two or three at a time (``k``), in their order, joined."""
    after = lambda i: F.slice(ts, i + 2, F.size(ts))
    pairs = lambda rest, x: F.transform(rest, lambda y: F.concat_ws("_", x, y))
    two = F.flatten(F.transform(ts, lambda x, i: pairs(after(i), x)))
    three = F.flatten(F.transform(ts, lambda x, i: F.flatten(F.transform(after(i), lambda y, j: pairs(F.slice(ts, i + j + 3, F.size(ts)), F.concat_ws("_", x, y))))))
    return F.when(k == 1, ts).when(k == 2, two).otherwise(three)


def _signatures(names: DataFrame, frequency: DataFrame, own: str, partner: str) -> DataFrame:
    """Each name with the combinations of tokens of which any partner within the threshold must share one, per partner size.

    Sets of p and q tokens with Jaccard >= t have at least c = ceil(t / (1 + t) * (p + q)) tokens in
    common. In any common order of tokens, the first k of them lie before the last c - k tokens of either name that the catalog
    knows, so both names offer the combinations of k = TOGETHER (or c, if that is less) of their other tokens. Rare tokens come first, which
    keeps the groups small. ``own`` and ``partner`` name the two set sizes, which are part of the key.
    """
    parts = names.withColumn(own, F.size(tokens(F.col("norm")))).withColumn("token", F.explode(tokens(F.col("norm"))))
    ordered = parts.join(frequency, "token", "inner").groupBy(*names.columns, own).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "token"))), lambda e: e["token"]).alias("ts")
    )
    need = 1.0 - (1.0 - F.col("cut")) / W_JACCARD
    fewest, most = F.ceil(need * F.col(own) - _EPS).cast("int"), F.floor(F.col(own) / need + _EPS).cast("int")
    sized = ordered.withColumn(partner, F.explode(F.sequence(F.greatest(fewest, F.lit(1)), most)))
    common = F.ceil(need / (1.0 + need) * (F.col(own) + F.col(partner)) - _EPS).cast("int")
    at_once = F.least(F.greatest(common, F.lit(1)), F.lit(TOGETHER))
    kept = sized.withColumn("k", at_once).withColumn("keep", F.size("ts") - F.greatest(common, F.lit(1)) + F.col("k")).filter("keep >= k")
    some = kept.withColumn("ts", F.slice("ts", F.lit(1), F.col("keep")))
    return some.select(*names.columns, own, partner, F.explode(_combinations(F.col("ts"), F.col("k"))).alias("token"))


def _shortest_head(cut: float, size: int) -> int:
    """The shortest common prefix that leaves names of at least this length within the threshold."""
    return max(1, ceil((1.0 - (1.0 - cut) / W_PREFIX) * size - _EPS))


def candidate_pairs(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (norm, cat_norm, cut) pairs that can reach the threshold of ``norm``. Both inputs hold ``norm``."""
    source = names.select("norm").distinct().withColumn("cut", threshold(F.col("norm")))
    target = catalog.select("norm").distinct()
    seen = target.select(F.explode(tokens(F.col("norm"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    # Every catalog name is offered to each threshold class; the join uses the class's shortest common prefix.
    starts = (0, *[upto for upto, _ in THRESHOLDS if upto is not None])
    classes = [(cut, _shortest_head(cut, start)) for start, (_, cut) in zip(starts, THRESHOLDS)]
    head_size = F.lit(1)
    for cut, k in classes:
        head_size = F.when(F.col("cut") == cut, F.lit(k)).otherwise(head_size)
    offered = target.select("norm", F.explode(F.array(*[F.lit(cut) for cut, _ in classes])).alias("cut"))
    keys = ["cut", "size", "cat_size", "head", "token"]
    left = _signatures(source, seen, "size", "cat_size").withColumn("head", F.substring(F.col("norm"), F.lit(1), head_size))
    right = _signatures(offered, seen, "cat_size", "size").withColumn("head", F.substring(F.col("norm"), F.lit(1), head_size))
    right = right.select(F.col("norm").alias("cat_norm"), *keys)
    a, b = F.length("norm"), F.length("cat_norm")
    # The three losses share one budget: what the lengths and the tokens that differ cost is no longer there for the prefix.
    indel_most = 2.0 * F.least(a, b) / (a + b)
    shared = jaccard(tokens(F.col("norm")), tokens(F.col("cat_norm")))
    share_needed = (F.col("cut") - W_INDEL * indel_most - W_JACCARD * shared) / W_PREFIX
    need_head = F.ceil(share_needed * F.greatest(a, b) - _EPS).cast("int")
    same_head = F.substring(F.col("norm"), F.lit(1), need_head) == F.substring(F.col("cat_norm"), F.lit(1), need_head)
    similar = share_needed <= 1.0 + _EPS
    return left.select("norm", *keys).join(right, keys, "inner").filter(similar & same_head).select("norm", "cat_norm", "cut").distinct()


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Candidates that may reach the threshold, with their score.

    Sizes and tokens are tested first, then the common prefix. The common subsequence is only computed
    where a bound on it still allows the threshold, and only over the middle that is left when the
    common prefix and suffix, which always belong to it, are cut off.
    """
    a, b = F.col("norm"), F.col("cat_norm")
    n, m = F.length(a), F.length(b)
    jac = W_JACCARD * jaccard(tokens(a), tokens(b))
    likely = pairs.filter(W_INDEL * 2.0 * F.least(n, m) / (n + m) + jac + W_PREFIX >= F.col("cut") - _EPS)

    def middle_score(s: Column) -> Column:
        total = lambda inner: W_INDEL * 2.0 * (s["h"] + s["t"] + inner) / (n + m) + jac + W_PREFIX * s["h"] / F.greatest(n, m)
        most = F.least(F.length(s["a"]), F.length(s["b"])) - s["t"]
        inner = F.when(most == 0, F.lit(0)).otherwise(
            common_subsequence(F.substr(s["a"], s["t"] + 1), F.substr(s["b"], s["t"] + 1))
        )
        return F.when(total(most) >= F.col("cut") - _EPS, F.round(total(inner), 9))

    rest = lambda c, h: F.reverse(F.substr(c, h + 1))
    score = let(
        common_prefix(a, b),
        lambda h: let(
            F.struct(h.alias("h"), rest(a, h).alias("a"), rest(b, h).alias("b")),
            lambda r: let(
                F.struct(r["h"].alias("h"), r["a"].alias("a"), r["b"].alias("b"), common_prefix(r["a"], r["b"]).alias("t")),
                middle_score,
            ),
        ),
    )
    return likely.select("norm", "cat_norm", "cut", score.alias("score")).filter(F.col("score").isNotNull())


def map_names(names: DataFrame, name: str, catalog: DataFrame, full_name: str) -> DataFrame:
    """Each distinct name with its catalog match and a status: EXACT, MATCHED, AMBIGUOUS or NO_MATCH."""
    src = names.select(F.col(name).alias("name")).distinct().withColumn("norm", normal_name(F.col("name")))
    # Two catalog entries with one normal name: the greatest full name stands for both.
    cat = catalog.groupBy(normal_name(F.col(full_name)).alias("norm")).agg(F.max(full_name).alias("match"))
    exact = src.join(cat, "norm", "inner").select(
        "name", "match", F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("runner_up"), F.lit("EXACT").alias("status")
    )
    rest = src.join(cat.select("norm"), "norm", "left_anti")
    # The threshold is applied after the ranking: as a filter below it the score would be computed twice.
    ranked = top_per_key(scored_pairs(candidate_pairs(rest, cat)), ["norm"], [F.desc("score"), F.asc("cat_norm")], 2)
    two = ranked.filter(F.col("score") >= F.col("cut") - _EPS)
    w = Window.partitionBy("norm").orderBy("_rn")
    best = two.withColumn("runner_up", F.lead("score").over(w)).filter("_rn = 1")
    clear = F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") > CLEAR_GAP + _EPS)
    found = best.withColumn("status", F.when(clear, F.lit("MATCHED")).otherwise(F.lit("AMBIGUOUS"))).join(
        cat.withColumnRenamed("norm", "cat_norm"), "cat_norm", "left"
    )
    fuzzy = rest.join(found.select("norm", "match", "score", "runner_up", "status"), "norm", "left").select(
        "name", F.when(F.col("status") == "MATCHED", F.col("match")).alias("match"), "score", "runner_up",
        F.coalesce("status", F.lit("NO_MATCH")).alias("status"),
    )
    return exact.unionByName(fuzzy)
