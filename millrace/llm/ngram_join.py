"""Exact Jaccard self-join of documents on word n-grams, with several global token orders.

Two documents link when ``100 * |A and B| >= 85 * |A or B|`` for their sets of n-grams. A pair that
links must share a token of its prefixes under *every* global order of tokens, so candidates
pass several of them before their sets are compared:

1. Order of hashes: ``sketches`` keeps a longer prefix, of which linked documents share several
   tokens. ``sharing`` counts in one join how many tokens of its prefix a set shares with any
   other set, and drops sets that share too few.
2. Rarest first: over the sets that remain, tokens are ordered by how many sets hold them.
   ``rare_index`` keeps the prefix under this order; widespread lines and passages come last
   and hardly ever enter it.
3. The smallest and the largest hashes: two more orders. A pair that has met under the second one goes on only
   if its prefixes under these two overlap as well; whole sets are fetched for what all orders let through.

Pairs meet only if two bounds allow a link: the numbers of tokens that any other set holds and, where a token has
several pivots, the parity bits of both sets (``BITS`` bits, one flipped by every token): sets differ in at least
as many tokens as bits.

Pairs are never listed within a group of copies. Equal sets are one class from the start. In each round
every token picks a few pivots, those with the fewest tokens of their own. The other sets under the token
are compared with these unless their numbers of common tokens rule a link out, and linked sets join one component; tokens all of whose sets are in one component are done.
Pivots are compared with everything under their token and then leave it, so the rounds end with no pair
unseen that could connect two components. Their number grows from round to round.

Cases: a null text is empty; a document without words has no set, links with nothing and is its
own component. With fewer words than n, the whole sequence is one token. Repeated rows share a
class. A null id never names a component; sets that only rows without id hold link with nothing.
Tokens and classes are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.common import ascii_lower, text_or_empty
from millrace.session import cut_lineage, scratch_dir

# Words in a token and the least similarity, in percent.
WORDS = 4
PERCENT = 85
# The prefix of the first filter is longer by this share of the set (in percent), and as many tokens must be shared.
MORE_PERCENT = 5

# Every round has so many times the pivots of the round before.
PIVOT_GROWTH = 16

# Fixed value: runs of these characters are words.
WORD = r"[^\x20\x09-\x0D]+"

# Parity bits of a set, in longs of 64.
BITS = 1024
LONGS = BITS // 64

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def token_set(text: Column, size: int = WORDS) -> Column:
    """Sorted distinct hashes of the n-grams of a text."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))

    def grams(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
        )
        whole = F.array(F.xxhash64(w, F.lit("whole")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= size, F.sort_array(F.array_distinct(hashed))).when(F.size(w) > 0, whole).otherwise(none)

    # The words are bound to a name, so that they are cut once.
    return F.get(F.transform(F.array(words), grams), 0)


def _may_miss(size: Column, percent: int) -> Column:
    """How many tokens of a set a linked set can lack."""
    return size - F.floor((size * percent + 99) / 100).cast("int")


def sketches(docs: DataFrame, key: str, column: str, percent: int, size: int) -> DataFrame:
    """``doc, text_hash, cls, check, n, prefix`` of every row; ``cls`` and ``check`` are hashes of the whole set.

    ``prefix`` holds the smallest hashes of the set: the tokens a linked set can lack, and the
    number that must be shared on top.
    """
    text = text_or_empty(column)
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), token_set(text, size).alias("tokens")
    )
    n = F.size("tokens")
    length = _may_miss(n, percent) + F.floor(n * MORE_PERCENT / 100).cast("int") + 1
    return rows.select(
        "doc",
        "text_hash",
        F.xxhash64("tokens").alias("cls"),
        F.xxhash64(F.lit("check"), "tokens").alias("check"),
        n.alias("n"),
        F.when(n > 0, F.slice("tokens", F.lit(1), F.least(length, n))).alias("prefix"),
    )


def sharing(classes: DataFrame, percent: int) -> DataFrame:
    """The classes that share enough tokens of their prefix with other classes."""
    rows = classes.select("cls", "n", F.explode("prefix").alias("token"))
    shared = cut_lineage(rows.groupBy("token").count().where("count > 1").select("token"))
    # A linked set has at least this share of this set's size, so at least so many tokens are shared.
    least = F.floor(F.floor((F.col("n") * percent + 99) / 100) * MORE_PERCENT / 100) + 1
    return rows.join(shared, "token").groupBy("cls", "n").count().where(F.col("count") >= least).select("cls")


def rare_index(sets: DataFrame, percent: int) -> DataFrame:
    """``token, cls, n, common``: the prefixes under the order of rarest tokens first, without tokens of one set.

    ``n`` is the size of the set and ``common`` how many of its tokens another set holds too.
    """
    rows = sets.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = cut_lineage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    common = rows.join(counts, "token").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("held", "token"))).alias("common")
    )
    # Tokens of one set come first in the order and can't be shared.
    room = _may_miss(F.col("n"), percent) + 1 - (F.col("n") - F.size("common"))
    kept = common.where(room > 0).select(
        "cls", "n", F.size("common").alias("common"), F.explode(F.slice("common", F.lit(1), room)).alias("t")
    )
    return kept.select("cls", "n", "common", F.col("t.token").alias("token"))


def parity(sets: DataFrame) -> DataFrame:
    """``cls, bits``: every token flips one of the bits of its set."""
    rows = sets.select("cls", F.explode("tokens").alias("token"))
    place = F.pmod(F.xxhash64("token"), F.lit(BITS))
    rows = rows.select("cls", F.floor(place / 64).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(token), {BITS}) % 64 AS int))").alias("bit"))
    flips = [F.bit_xor(F.when(F.col("at") == i, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{i}") for i in range(LONGS)]
    return rows.groupBy("cls").agg(*flips).select("cls", F.struct(*[f"b{i}" for i in range(LONGS)]).alias("bits"))


def _may_link(percent: int, by_bits: bool) -> Column:
    """Whether two sets can link, by the numbers of their tokens that other sets hold at all, and by their bits.

    Sets of a and b tokens link if at most ``(a + b) * (100 - percent) / (100 + percent)`` tokens are in one of them only.
    """
    most = F.least("common", "pivot_common")
    size = F.col("n") + F.col("pivot_n")
    allowed = most * 100 >= (size - most) * percent
    if not by_bits:
        return allowed
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.bit_count(F.col("bits")[f"b{i}"].bitwiseXOR(F.col("pivot_bits")[f"b{i}"]))
    return allowed & (differ * (100 + percent) <= size * (100 - percent))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, n, head, tail``: the size and the prefixes under the orders of smallest and of largest hashes."""
    n = F.size("tokens")
    length = _may_miss(n, percent) + 1
    head, tail = F.slice("tokens", F.lit(1), length), F.slice("tokens", n - length + 1, length)
    return sets.where(n > 0).select("cls", n.alias("n"), head.alias("head"), tail.alias("tail"))


def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs with the columns of both classes; those of the pivot are called ``pivot_...``."""
    other = of.withColumnsRenamed({c: "pivot" if c == "cls" else f"pivot_{c}" for c in of.columns})
    return pairs.select("cls", "pivot").join(of, "cls").join(other, "pivot")


def intersected(pairs: DataFrame, orders: DataFrame, percent: int) -> DataFrame:
    """The pairs ``cls, pivot`` whose sizes allow a link and whose prefixes overlap under both orders of hashes."""
    less, more = F.least("n", "pivot_n"), F.greatest("n", "pivot_n")
    share = F.arrays_overlap("head", "pivot_head") & F.arrays_overlap("tail", "pivot_tail")
    return _both(pairs, orders).where((less * 100 >= more * percent) & share).select("cls", "pivot")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``cls, pivot`` that link, by their whole sets."""
    both = F.size(F.array_intersect("tokens", "pivot_tokens"))
    size = F.size("tokens") + F.size("pivot_tokens")
    return _both(pairs, sets.select("cls", "tokens")).where(both * 100 >= (size - both) * percent).select("cls", "pivot")


class Rounds:
    """Tables of the current round, in a folder of its own; those of the round before last are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.tables = spark, [scratch_dir(spark, "round")], 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Store ``df`` and read it back."""
        self.tables += 1
        path = f"{self.folders[-1]}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def turn(self) -> None:
        """Start a round. What it needs is stored in the folder of the round before."""
        if len(self.folders) > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop(0))
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.folders.append(scratch_dir(self.spark, "round"))


def contract(edges: DataFrame, rounds: Rounds) -> DataFrame | None:
    """``node, root`` for every node of the edges ``x, y``: the smallest node of its component.

    Each round moves every node to its smallest neighbour's smallest neighbour and maps the
    edges along, until none is left.
    """
    edges = edges.where("x != y").distinct()
    moves: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = rounds.cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("y")))
        if step.isEmpty():
            return moves
        twice = step.alias("s").join(step.alias("t"), F.col("s.y") == F.col("t.x")).select(
            F.col("s.x").alias("node"), F.col("t.y").alias("root")
        )
        twice = rounds.cut(twice)
        if moves is None:
            moves = twice
        else:
            moves = rounds.cut(_moved(moves, "root", twice))
        edges = _moved(_moved(edges, "x", twice), "y", twice).where("x != y").distinct()


def _moved(rows: DataFrame, column: str, moves: DataFrame | None) -> DataFrame:
    """Rows with the nodes in a column replaced by their roots, where they have one."""
    if moves is None:
        return rows
    found = moves.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(found, column, "left").select(
        *[F.coalesce("_root", F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns]
    )


def _open_tokens(index: DataFrame) -> DataFrame:
    """One token for each group of sets that is held by tokens and not yet in one component.

    Tokens of one passage often lie in exactly the same sets. Their groups are told by the number of sets
    and two sums of hashes, and one of the tokens finds the same pairs as all of them.
    """
    low = F.xxhash64("cls").bitwiseAND(F.lit((1 << 31) - 1))
    groups = index.groupBy("token").agg(
        F.min("at").alias("lo"),
        F.max("at").alias("hi"),
        F.count(F.lit(1)).alias("sets"),
        F.sum(low).alias("one"),
        F.bit_xor(F.xxhash64("cls", F.lit("two"))).alias("two"),
    )
    return groups.where("lo != hi").groupBy("sets", "one", "two").agg(F.min("token").alias("token")).select("token")


def components(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``cls, root`` of every indexed class that is linked to a smaller one."""
    # `at` is the component that a class belongs to so far.
    rounds = Rounds(sets.sparkSession)
    bits: DataFrame | None = None
    index = rounds.cut(index.withColumn("at", F.col("cls")))
    whole: DataFrame | None = None
    pivots_each = 1
    while True:
        rounds.turn()
        live = rounds.cut(index.join(_open_tokens(index), "token"))
        if live.isEmpty():
            break
        # Later rounds read the sets of the classes that are left, not those of all.
        sets = _sets_of(live.select("cls"), sets, rounds)
        # The first round has one pivot for each token, so its pairs are no more than the rows of the index.
        # The bits travel only with what it leaves open.
        crowded = pivots_each > 1
        if crowded and bits is None:
            bits = cut_lineage(parity(sets))
        marked = live.join(bits, "cls") if crowded else live
        part = F.pmod(F.xxhash64("cls", F.lit(pivots_each)), F.lit(pivots_each))
        # The set with the fewest tokens of its own is nearest to all others.
        known = ["n", "cls", "at", "common", *(["bits"] if crowded else [])]
        central = F.struct((F.col("n") - F.col("common")).alias("own"), *known)
        pivots = marked.groupBy("token", part.alias("part")).agg(F.min(central).alias("p")).select(
            "token", *[F.col(f"p.{name}").alias("pivot" if name == "cls" else f"pivot_{name}") for name in known]
        )
        met = marked.join(pivots, "token").where((F.col("at") != F.col("pivot_at")) & _may_link(percent, crowded))
        pairs = rounds.cut(met.groupBy("cls", "at", "pivot", "pivot_at").agg(F.count(F.lit(1)).alias("shared")))
        # First each class with the pivot it shares most with, then what is still apart.
        best = pairs.groupBy("cls").agg(F.max(F.struct("shared", "pivot", "at", "pivot_at")).alias("p"))
        first = best.select("cls", "p.pivot", "p.at", "p.pivot_at")
        moves = _joined(first, sets, percent, rounds)
        rest = pairs.join(first.select("cls", "pivot"), ["cls", "pivot"], "left_anti").drop("shared")
        rest = rounds.cut(_moved(_moved(rest, "at", moves), "pivot_at", moves).where("at != pivot_at"))
        if not rest.isEmpty():
            more = _joined(rest, sets, percent, rounds)
            moves = _composed(moves, more, rounds)
        whole = _composed(whole, moves, rounds)
        gone = pivots.select("token", F.col("pivot").alias("cls"))
        index = rounds.cut(_moved(live.join(gone, ["token", "cls"], "left_anti"), "at", moves))
        pivots_each *= PIVOT_GROWTH
    if whole is None:
        return index.select("cls", F.col("cls").alias("root")).limit(0)
    return whole.select(F.col("node").alias("cls"), "root")


def _sets_of(classes: DataFrame, sets: DataFrame, rounds: Rounds) -> DataFrame:
    """The sets of some classes, stored in this round. Joins with few classes move few sets, however many there are."""
    return rounds.cut(sets.join(rounds.cut(classes.distinct()), "cls", "left_semi"))


def _joined(pairs: DataFrame, sets: DataFrame, percent: int, rounds: Rounds) -> DataFrame | None:
    """Moves of components after the pairs ``cls, at, pivot, pivot_at`` have been compared."""
    met = _sets_of(pairs.select("cls").unionByName(pairs.select(F.col("pivot").alias("cls"))), sets, rounds)
    left = rounds.cut(intersected(pairs, prefixes(met, percent), percent))
    links = verified(left, met, percent).join(pairs, ["cls", "pivot"])
    return contract(rounds.cut(links.select(F.col("at").alias("x"), F.col("pivot_at").alias("y")).distinct()), rounds)


def _composed(first: DataFrame | None, then: DataFrame | None, rounds: Rounds) -> DataFrame | None:
    """The moves of ``first`` followed by those of ``then``, stored in this round."""
    if first is None or then is None:
        one = then if first is None else first
        return None if one is None else rounds.cut(one)
    moved = _moved(first, "root", then)
    added = then.join(first.select("node"), "node", "left_anti")
    return rounds.cut(moved.unionByName(added))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", column: str = "text", percent: int = PERCENT, size: int = WORDS
) -> DataFrame:
    """``doc, text_hash, n_shingles, cls, root, component_id`` for every row of ``docs``.

    ``text_hash`` tells rows with one id apart, ``cls`` is the class of equal sets and ``root`` the class that
    stands for the component: with repeated ids two components can have the same smallest id.
    """
    spark = docs.sparkSession
    before = _clean_shuffles(spark)
    try:
        rows, by_class = _classes(docs, key, column, percent, size)
    finally:
        _restore(spark, before)
    result = rows.drop("prefix", "check").join(by_class, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return result.select(
        "doc", "text_hash", F.col("n").cast("bigint").alias("n_shingles"), "cls", "root", own.alias("component_id")
    )


def _classes(docs: DataFrame, key: str, column: str, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The stored sketches of all rows, and ``cls, root, component_id`` of every class with words."""
    rows = cut_lineage(sketches(docs, key, column, percent, size))
    classes = cut_lineage(
        rows.where("n > 0")
        .groupBy("cls", "check", "n")
        .agg(
            F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "text_hash"))).alias("first"),
            F.any_value("prefix").alias("prefix"),
        )
        .select("cls", "n", "first.doc", "first.text_hash", "prefix")
    )
    some = cut_lineage(sharing(classes, percent))
    # Only the first document of each class that is left is read again for its whole set. Repeated
    # rows of it meet in the join's own partitions.
    wanted = classes.join(some, "cls").select("doc", "text_hash", "cls")
    text = text_or_empty(column)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = texts.join(wanted, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"])
    sets = cut_lineage(found.select("cls", token_set(F.col("text"), size).alias("tokens")))
    index = cut_lineage(rare_index(sets, percent))
    roots = components(index, sets, percent)
    placed = classes.select("cls", "doc").join(roots, "cls", "left").select("cls", "doc", F.coalesce("root", "cls").alias("root"))
    named = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rows, cut_lineage(placed.join(named, "root").select("cls", "root", "component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of linked ones: the one with the smallest id.

    Documents without words are in no group and stay. Of rows that repeat the id that stays,
    one is kept.
    """
    found = cut_lineage(jaccard_components(docs, key, column))
    words = found.where("n_shingles > 0")
    first = words.where(F.col("doc").eqNullSafe(F.col("component_id"))).groupBy("root")
    stays = cut_lineage(first.agg(F.min(F.struct("doc", "text_hash")).alias("f")).select("f.doc", "f.text_hash"))
    text = text_or_empty(column)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), F.col(f"`{key}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), text.rlike(WORD).alias("worded"))
    same = F.col("r.doc").eqNullSafe(F.col("s.doc")) & F.col("r.text_hash").eqNullSafe(F.col("s.text_hash"))
    kept = rows.where("worded").alias("r").join(stays.alias("s"), same, "left_semi").dropDuplicates(["doc", "text_hash"])
    return kept.select("row.*").unionByName(rows.where("NOT worded").select("row.*"))


def _clean_shuffles(spark: SparkSession) -> str | None:
    """Have shuffle files of the finished steps removed; every step reads stored tables only."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    return before


def _restore(spark: SparkSession, before: str | None) -> None:
    if before is None:
        spark.conf.unset(CLEAN_SHUFFLES)
    else:
        spark.conf.set(CLEAN_SHUFFLES, before)
