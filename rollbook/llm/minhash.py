"""MinHash near-dedup with tensored banding.

Documents with equal shingle sets form one class, represented by its smallest
id, so copies cost nothing further.  A class has two small collections of
``groups`` short min-hash groups (``rows`` hashes each); a table key is a pair
of one group from each, so ``2 * groups * rows`` min-hashes feed ``groups**2``
tables of ``2 * rows`` hashes.  At similarity s a pair meets in some table with
probability (1 - (1 - s**rows)**groups)**2: 0.9994 at 0.8 for 8 groups of 2,
more above.

Pairs are compared so that a large group whose members resemble each other
well costs a few comparisons a member.  Each id is first held against the
weightiest leader of its buckets (the weight of an id is the number of others it
meets, so the middle of a group leads), then, where the components of the links
found so far differ, against the leaders of all its buckets.  Of what still lies
in one bucket but in several components, buckets of up to ``SMALL`` ids compare
all such pairs.  For the sets of the ids of larger ones, shingles are placed by
the number of these sets that hold them, rarest first.  Two sets whose first
common shingle leaves too few places behind it cannot reach the similarity; so a
shingle's place bounds the sizes of the sets it has to meet, and as what a page
has for itself alone takes its first places, pages clearly below the similarity
of each other hardly meet.  This step leaves out no link.

A family of pages just *below* the similarity is not so cheap if less than about
a ninth of each page's shingles is its own.  Where a shingle and pair of sizes
would cost more than ``HELD`` pairs a row across components, its ids go into
``STEEP`` further tables of ``LONG`` hashes, where a pair at 0.8 meets with
probability 0.996, one at 0.7 with 0.48, one at 0.6 with 0.05.  There each id is
held against one id of each of its buckets, which joins a family with many links
into few components at a cost in proportion to its ids, and only then are pairs
of different components compared.

Before texts are fetched, pairs go whose set sizes alone rule the similarity
out, or whose signatures agree in so few places that, at the threshold, this
has a chance below ``1e-5``.  The rest is confirmed on full shingle sets, the
texts of a leader's members dealt over several tasks and streamed.

Spark sizes an exploded table as the one before, and a stored one by its compressed
file.  So that neither is broadcast for small, joins of such tables are sort-merge
joins (``hint("merge")``), or the table is dealt out first (``components``,
``known``), which tells Spark its size.

Defined results: A-Z are lower-cased, words are separated by ASCII white space.
A document with fewer words than a shingle has one shingle, the whole sequence.
Without words (or a null text) the set is empty: ``n_shingles`` 0, linked with
nothing, kept.  A null id takes no part: ``component_id`` null, kept.  Rows of
one id are compared text by text, and repeated rows get equal results.  An
empty table gives an empty result.  Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rollbook.llm.common import Bounded, known, small_batches, spread, stored, text_of
from rollbook.llm.components import SALTS, components

TARGET_MEMBERS = 512  # members of one leader in one streamed group
SMALL = 16  # ids of a bucket that are all compared
STEEP, LONG = 200, 16  # tables for the ids of larger ones, hashes in a key
BLOCK = 256  # ids of a key in one block of the join
BAND, FINE = 1.05, 16  # from one band of set sizes to the next; parts of a band
HELD = 16  # pairs a row of one shingle and pair of bands that are all compared


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.hashes = words, Bounded(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode().lower().split()  # bytes: ASCII case and white space only
        if not found:
            return np.empty(0, dtype=np.uint64)
        h = np.array([self.hashes[w] for w in found], dtype=np.uint64)
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            out = _mix(out + h[i:len(h) - size + 1 + i])
        return np.unique(out)


def _signatures(batches, words: int, hashes: int):
    shingler = Shingler(words)
    random = np.random.default_rng(9)
    factors = random.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 1 << 63, hashes, dtype=np.uint64)
    for batch in batches:
        n, digests, signatures = [], [], []
        for t in batch.column(2):
            s = shingler(t.as_py())
            n.append(len(s))
            if len(s):
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = [int((s * a + b).min() >> np.uint64(32)) for a, b in zip(factors, terms)]
                signatures.append((np.array(low, dtype=np.uint32).view(np.int32)))
            else:
                digests.append(None)
                signatures.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
            names=["id", "tk", "n", "digest", "sig"])


def least_matches(hashes: int, similarity: float, chance: float = 1e-5) -> int:
    """The most equal places such that fewer have a chance below ``chance``."""
    total = 0.0
    for k in range(hashes + 1):
        total += math.comb(hashes, k) * similarity ** k * (1 - similarity) ** (hashes - k)
        if total >= chance:
            return k
    return hashes


def _confirm(batches, words: int, percent: int):
    """Rows (a, part, role, id, text), sorted so that a leader's texts (role 0)
    come before its members': the confirmed pairs."""
    shingler, leader, sets = Shingler(words), None, []
    for batch in batches:
        left, right = [], []
        for a, part, role, b, text in zip(*batch.columns):
            key = (a.as_py(), part.as_py())
            if key != leader:
                leader, sets = key, []
            s = shingler(text.as_py())
            if role.as_py() == 0:
                sets.append(s)
                continue
            for other in sets:
                common = len(np.intersect1d(s, other, assume_unique=True))
                if common and 100 * common >= percent * (len(s) + len(other) - common):
                    left.append(key[0])
                    right.append(b.as_py())
                    break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    # Whatever the number of pairs, texts are joined by a sort-merge join, never a broadcast.  Every pair has its
    # leader: of a left join only the leaders, which come from a shuffle, can be broadcast.
    leaders = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TARGET_MEMBERS).cast("int").alias("parts"))
    members = pairs.join(leaders, "a", "left").select(F.col("b").alias("id"), "a", F.expr("pmod(hash(b), parts)").alias("part"), F.lit(1).alias("role"))
    heads = leaders.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = members.unionByName(heads).join(texts.hint("merge"), "id").select("a", "part", "role", "id", "text")
    dealt = wanted.repartition(spread(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(lambda batches: _confirm(batches, words, percent), "a long, b long")


def _steep_keys(batches, words: int):
    """Rows (id, c, text): the keys of each text in ``STEEP`` tables of ``LONG`` hashes."""
    shingler = Shingler(words)
    random = np.random.default_rng(90)
    factors = random.integers(1, 1 << 63, (STEEP, LONG), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 1 << 63, (STEEP, LONG), dtype=np.uint64)
    for batch in batches:
        columns = [[np.empty(0, dtype=np.int64)] for _ in range(3)]
        for i, c, t in zip(*batch.columns):
            s = shingler(t.as_py())
            key = np.arange(STEEP, dtype=np.uint64)
            for h in range(LONG):
                low = np.full(STEEP, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(s), 1000):  # a bounded block of a long text's shingles at a time
                    low = np.minimum(low, (s[at:at + 1000] * factors[:, h:h + 1] + terms[:, h:h + 1]).min(axis=1))
                key = _mix(key + (low >> np.uint64(32)))
            for column, x in zip(columns, (key.view(np.int64), *(np.full(STEEP, y) for y in (i.as_py(), c.as_py())))):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "id", "c"])


def _sets(batches, words: int):
    """Rows (id, c, text) with the hashes of their shingles instead of the text."""
    shingler = Shingler(words)
    for batch in batches:
        found = [shingler(t.as_py()).view(np.int64) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["id", "c", "tk", "n", "s"])


def _several(rows: DataFrame) -> DataFrame:
    """The rows (key, id, c) of keys that hold ids of different components,
    with ``members``."""
    met = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("members")).where("c0 < c1")
    return rows.join(met.select("key", "members"), "key")


def _across(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of unequal c that share a key; a key of many ids is
    joined block with block."""
    dealt = _several(rows).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.hash("id"), "blocks"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("key", F.col("own").alias("x"), each.alias("y"), F.col("id").alias("a"), F.col("c").alias("ca"))
    right = dealt.select("key", each.alias("x"), F.col("own").alias("y"), F.col("id").alias("b"), F.col("c").alias("cb"))
    return left.hint("merge").join(right, ["key", "x", "y"]).where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def _band(size: str, parts: int = 1):
    """The number of the band of set sizes, each of ``parts`` parts."""
    return F.ceil(F.log(F.col(size)) * (parts / math.log(BAND)))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (key, id, c, n, room, most, side), one for each shingle of a set (its rows
    told apart by id and ``tk``) and each band of sizes with which it can be the
    first common one.  Shingles are placed by the number of sets that hold them,
    rarest first; ``room`` is the number of shingles from this one on, ``most``
    the size of the largest other set it is enough for, ``side`` whether the
    other set's band is above, the same or below."""
    shingles = sets.select("id", "c", "tk", "n", F.explode("s").alias("shingle"))
    held = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    own = Window.partitionBy("id", "tk")
    # Shingles that no other set holds come first and need no rows.
    placed = shingles.hint("merge").join(held, "shingle").withColumn(
        "room", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("held", "shingle")) + 1)

    # A common part of at most ``room`` is enough for other sets of least to most shingles.
    reach = (placed.withColumn("least", F.expr(f"(n * {percent} + 99) div 100"))
             .withColumn("most", F.expr(f"({100 + percent} * room - {percent} * n) div {percent}")).where("most >= least"))
    each = reach.withColumn("band", _band("n")).withColumn("other", F.explode(F.sequence(_band("least"), _band("most"))))
    key = F.xxhash64("shingle", F.least("band", "other"), F.greatest("band", "other"))
    return each.select(key.alias("key"), "id", "c", "n", "room", "most", F.signum(F.col("other") - F.col("band")).cast("int").alias("side"))


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of ``_prefixes`` with keys of finer bands, of those that occur with
    the key.  The rows of one key are dealt over ``SALTS`` tasks."""
    banded = rows.withColumn("band", _band("n", FINE)).withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    there = banded.groupBy("key").agg(F.collect_set(F.struct("band", "side")).alias("there"))  # FINE + 2 bands of each side at most
    reached = F.filter("there", lambda x: (x["side"] + F.col("side") == 0) & (x["band"] <= _band("most", FINE)))
    salted = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = banded.hint("merge").join(salted, ["key", "salt"]).withColumn("other", F.explode(F.transform(reached, lambda x: x["band"])))
    key = F.xxhash64("key", F.least("band", "other"), F.greatest("band", "other"))
    return each.select(key.alias("key"), "id", "c", "n", "room", F.signum(F.col("other") - F.col("band")).cast("int").alias("side"))


def _crossing(rows: DataFrame) -> DataFrame:
    """The rows of keys under which ids of different components meet, with
    ``members``, the number of such ``pairs`` (those of one band twice) and the
    component ``main`` that has most rows."""
    of_component = rows.groupBy("key", "c").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col("side") >= 0).alias("low"), F.count_if(F.col("side") <= 0).alias("high"))
    keys = of_component.groupBy("key").agg(
        F.sum("m").alias("members"), (F.sum("low") * F.sum("high") - F.sum(F.col("low") * F.col("high"))).alias("pairs"),
        F.max_by("c", F.struct("m", "c")).alias("main"))
    return rows.join(keys.where("pairs > 0"), "key")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows of ``_crossing`` whose places leave room for
    enough common shingles.  The ids outside the main component, which are few
    where pairs are few, meet all others block by block."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    row = F.struct("id", "c", "n", "room")
    left = dealt.where("c <> main").select("key", (-F.col("side")).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), row.alias("x"))
    right = dealt.select("key", "side", F.pmod(F.hash("id"), "blocks").alias("block"), row.alias("y"))
    met = left.hint("merge").join(right, ["key", "side", "block"]).where(
        f"x.c <> y.c and {100 + percent} * least(x.room, y.room) >= {percent} * (x.n + y.n)")
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, groups: int = 8, rows: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``tk`` (hash of the row's text), ``n_shingles``,
    ``component_id`` (smallest id reachable by links of ``percent`` % or more)
    and ``kept`` of every row."""
    small_batches(docs.sparkSession)
    hashes = 2 * groups * rows
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    signed = stored(
        source.select("id", F.xxhash64("text").alias("tk"), "text")
        .mapInArrow(lambda batches: _signatures(batches, words, hashes), "id long, tk long, n long, digest binary, sig array<int>"), "signatures")
    with_set = signed.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = with_set.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    # Without the digest: of columns beside it Spark would count a signature as one number, and broadcast all of them.
    nodes = stored(classes.select("rep", "n", "sig"), "classes")

    # Table keys: one group from each of the two collections.
    def group(i):
        return F.struct(*[F.col("sig")[i * rows + r].alias(f"r{r}") for r in range(rows)])

    collections = [F.array(*[F.xxhash64(F.lit(i), group(i)) for i in range(c * groups, (c + 1) * groups)]) for c in (0, 1)]
    hashed = nodes.select("rep", collections[0].alias("g0"), collections[1].alias("g1"))
    keys = (hashed.select("rep", F.explode("g0").alias("first"), "g1").select("rep", "first", F.explode("g1").alias("second"))
            .select(F.xxhash64("first", "second").alias("key"), F.col("rep").alias("id")))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = stored(keys.hint("merge").join(sizes.select("key", "size"), "key"), "buckets")  # buckets of two or more ids
    # How many others an id meets; the middle of a group meets most of it.
    weight = stored(shared.groupBy("id").agg(F.sum("size").alias("w")), "weights")
    shared = shared.join(known(weight, "id"), "id")

    # Every id with the id ``a`` (its weight ``wa``) that leads its bucket.
    heads = shared.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("minus"))).alias("head"))
    heads = heads.select("key", (-F.col("head.minus")).alias("a"), F.col("head.w").alias("wa"))
    led = stored(shared.select("key", "id").join(heads, "key"), "led")
    least = least_matches(hashes, percent / 100)

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        pairs = pairs.distinct()
        both = (pairs.join(nodes.toDF("a", "na", "sa"), "a").join(nodes.toDF("b", "nb", "sb"), "b")
                .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
        equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        likely = stored(both.where(equal >= least).select("a", "b"), f"{label}-pairs")
        return stored(_confirmed(likely, source, words, percent).distinct(), f"{label}-links")

    # 1. Every id against the weightiest leader of its buckets: one pair an id.
    one = led.where("id <> a").groupBy(F.col("id").alias("b")).agg(F.max(F.struct("wa", (-F.col("a")).alias("minus"))).alias("top"))
    links = confirmed(one.select((-F.col("top.minus")).alias("a"), "b"), "top")

    # 2. Against the leaders of all buckets, where the components differ.
    labels = components(links)
    heads = (led.groupBy("key").agg(F.min("a").alias("a"))  # one a bucket
             .join(labels.toDF("a", "ca"), "a", "left").withColumn("ca", F.coalesce("ca", "a")))
    members = led.select("key", "id").join(labels, "id", "left").withColumn("c", F.coalesce("c", "id")).join(heads, "key")
    found = members.where("c <> ca").select("a", F.col("id").alias("b"))

    # 3. Buckets that still hold several components: all pairs of the small ones.
    def across(small: DataFrame) -> DataFrame:
        left, right = small.select("key", F.col("id").alias("a"), F.col("c").alias("ca")), small.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
        return left.hint("merge").join(right, "key").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b")

    of_several = stored(_several(members.select("key", "id", "c")), "mixed")
    found = found.unionByName(across(of_several.where(F.col("members") <= SMALL)))
    links = stored(links.unionByName(confirmed(found, "rest")).distinct(), "all-links")
    labels = components(links)

    # 4. The ids of the large ones that do so even now: pairs whose rarest
    # shingles meet, of shingles with up to ``HELD`` pairs a row.
    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))

    large = with_component(of_several.where(F.col("members") > SMALL).select("key", "id"))
    ids = stored(_several(large).select("id", "c").distinct(), "large-ids")
    if not ids.isEmpty():
        texts = ids.join(source.hint("merge"), "id").select("id", "c", "text", F.xxhash64("text").alias("tk")).dropDuplicates(["id", "tk"])
        sets = stored(texts.repartition(spread(docs.sparkSession)).mapInArrow(
            lambda batches: _sets(batches, words), "id long, c long, tk long, n long, s array<long>"), "sets")
        rarest = stored(_several(_prefixes(sets, percent)), "rarest")
        small = F.col("members") <= SMALL
        crossing = stored(_crossing(rarest.where(small).drop("members", "most").unionByName(_finer(rarest.where(~small)))), "crossing")
        few = F.col("pairs") <= HELD * F.col("members")
        links = stored(links.unionByName(confirmed(_meeting(crossing.where(few), percent), "rarest")).distinct(), "links-rarest")
        labels = components(links)
        ids = stored(_several(with_component(crossing.where(~few).select("key", "id"))).select("id", "c").distinct(), "held-ids")

    # 5. The ids of shingles with more, in steeper tables: each against the first
    # of its buckets, then what is left across components.
    if not ids.isEmpty():
        texts = ids.join(source.hint("merge"), "id").select("id", "c", "text").repartition(spread(docs.sparkSession))
        keyed = stored(texts.mapInArrow(lambda batches: _steep_keys(batches, words), "key long, id long, c long"), "steep-keys")
        steep = stored(_several(keyed.hint("merge")), "steep")
        first = steep.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "c")).alias("first"))
        led = steep.hint("merge").join(first, "key").where(F.col("c") != F.col("first.c")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
        links = stored(links.unionByName(confirmed(led, "led-steep")).distinct(), "links-led-steep")
        labels = components(links)
        rest = _across(with_component(steep.select("key", "id").distinct()))
        links = stored(links.unionByName(confirmed(rest, "steep")).distinct(), "links-steep")
        labels = components(links)

    of_class = (with_set.groupBy("digest").agg(F.min("id").alias("rep")).join(labels.toDF("rep", "c"), "rep", "left")
                .select("digest", F.coalesce("c", "rep").alias("c")))
    out = signed.join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), "tk", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that a document with a smaller id stands for,
    and one of the rows that repeat one id and text (the one with the smallest
    hash of all columns).  Rows without an id go if a row with an id has the
    same text, and one stays of those with one text; without words they all
    stay, as nothing tells whether they are copies."""
    found = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(
        F.col(id_col).alias("id_"), F.col("tk").alias("tk_"), "n_shingles", "kept"), "near-found")
    # One narrow row per (id, text); repeated ones are combined before the shuffle.
    texts = found.groupBy("id_", "tk_").agg(F.min("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    with_id = texts.where(F.col("id_").isNotNull()).select(F.col("tk_").alias("same")).distinct()
    nameless = texts.where(F.col("id_").isNull() & (F.col("n") > 0))
    gone = (texts.where(~F.col("kept")).unionByName(nameless.join(with_id, F.col("tk_") == F.col("same"), "left_semi"))
            .select("id_", "tk_"))
    repeated = texts.where((F.col("rows") > 1) & (F.col("id_").isNotNull() | (F.col("n") > 0))).select("id_", "tk_")
    fate = stored(gone.withColumn("gone", F.lit(True)).unionByName(
        repeated.join(gone.toDF("g", "gtk"), F.col("id_").eqNullSafe(F.col("g")) & (F.col("tk_") == F.col("gtk")), "left_anti").withColumn("gone", F.lit(False))), "fate")
    fate = known(fate, "tk_")

    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*columns)
    keyed = plain.withColumn("id_", F.col(f"c{names.index(id_col)}").cast("long")).withColumn("tk_", F.xxhash64(text_of(f"c{names.index(text_col)}")))
    same = keyed["id_"].eqNullSafe(fate["id_"]) & (keyed["tk_"] == fate["tk_"])
    single = keyed.join(fate, same, "left_anti").select(*columns)
    again = known(fate.where(~F.col("gone")), "tk_")
    if again.isEmpty():
        return single.toDF(*names)
    # Aggregated before the shuffle, so a row repeated a million times is one row of each task.
    several = keyed.join(again.select(F.col("id_").alias("i"), F.col("tk_").alias("t")), F.col("id_").eqNullSafe(F.col("i")) & (F.col("tk_") == F.col("t")), "left_semi")
    one = several.groupBy("id_", "tk_").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return single.unionByName(one).toDF(*names)
