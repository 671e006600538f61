"""Similarity join of documents on the Jaccard index of their word n-grams.

Documents with equal sets form a class and are one row from then on. A count-min sketch of one row (see
``sketch``) gives each n-gram an estimated number of documents, the same for all documents; sets
are ordered by it, the rarest first (ties by hash), and a pair that is similar enough shares an
n-gram of both prefixes (Xiao et al., PPJoin+, 2008). An n-gram estimated in one document links
nothing, so most documents leave here: those whose prefix has no other.

Classes that share a prefix n-gram are candidates. The lists of all n-grams with the same smallest
class are one group; its ``PIVOTS`` first members, that class and others by hash, meet all members
whose length allows it, each pair verified once on the whole sets. A group of few is done with that. In a larger one
most near copies are now linked to one of the pivots. Blocks of what is still in another component than
most of its group meet blocks of the group, without pairs being made: matrices of the prefixes and of
the spreads tell by the length, position and suffix filters, and the triangle inequality of the Jaccard
distance to the first pivot, which pairs of two components can be similar at all. These are verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import as_bytes, chunks, join_hot, packed, select_texts, split_by_marks, unpacked
from tablewright.llm.components import components
from tablewright.llm.sketch import BUCKET_BYTES, Estimates, Shape, Windows, bucketed, shape_for, shared_cells
from tablewright.session import cut_lineage

NGRAM_WORDS, PERCENT = 5, 75
SPREAD = 64  # hash partitions of a set
PIVOTS = 16  # members of a group that meet all others
MEMBERS_A_TASK = 500
DESCRIBED = (
    "doc_id long, n_shingles long, set_id binary, shingles binary, prefix array<long>, spread array<int>, text_sha256 binary"
)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _describe(shape: Shape, percent: int, digests: bool):
    """For each document the size of its set; for one that may have a partner also the set, its
    digest, the n-grams of its prefix that others may have, its spread over hash partitions and,
    with ``digests``, the digest of its text."""

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        import xxhash

        estimates = Estimates(right, shape)
        out = [[] for _ in range(7)]
        if left.num_rows:
            for ids, texts in chunks(left["doc_id"].to_pylist(), as_bytes(left["text"].combine_chunks())):
                w = Windows.of(texts, shape)
                one = w.of_documents()
                hashes = tuple(h[one] for h in w.hashes)
                counts = estimates.counts(hashes)
                edges = np.searchsorted(w.doc[one], np.arange(len(texts) + 1))
                for doc, text, i, j in zip(ids, texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    n = j - i
                    row = [doc, n, None, None, None, None, None]
                    own = counts[i:j]
                    p = prefix_length(n, percent)
                    if n and int((own == 1).sum()) < p:
                        h = hashes[0][i:j]
                        order = np.lexsort((h, own))
                        head = [k for k in range(p) if own[order[k]] > 1]
                        data = h.tobytes()  # sorted by hash
                        row[2:] = (
                            xxhash.xxh3_128_digest(data), data, h[order[head]].view(np.int64).tolist(),
                            np.bincount((h & np.uint64(SPREAD - 1)).astype(np.int64), minlength=SPREAD).tolist(),
                            hashlib.sha256(text).digest() if digests else None,
                        )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [f.split()[0] for f in DESCRIBED.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return describe


def _near_pairs(percent: int):
    """Pairs ``a, b`` of two blocks of a group that may be similar, though they are in different
    components, by what is known without their sets.

    Length; triangle inequality: similar sets are about as far from the group's first pivot. Position:
    of the members up to the end of the prefix that ends first all shared ones are in both prefixes, and
    what follows is at most the rest of that set. Suffix: of a hash partition at most the smaller
    number of members is shared.
    """

    def find(own: pa.Table, others: pa.Table) -> pa.Table:
        found = [], []
        if own.num_rows and others.num_rows:
            one, two = _Traits(own), _Traits(others)
            grams = np.unique(np.concatenate([one.grams, two.grams]))
            right = two.incidence(grams)
            step = max(1, 8_000_000 // (SPREAD * len(two.n)))
            for start in range(0, len(one.n), step):
                part = slice(start, start + step)
                n, m = one.n[part, None], two.n[None, :]
                fits = (100 * n >= percent * m) & (100 * m >= percent * n) & (one.root[part, None] != two.root[None, :])
                fits &= ~(np.abs(one.distance[part, None] - two.distance[None, :]) > 1 - percent / 100 + 1e-9)
                need = -(-percent * (n + m) // (100 + percent))
                rest = np.maximum(n * percent // 100, m * percent // 100)
                shared = one.incidence(grams, part) @ right.T
                fits &= shared + rest >= need
                fits &= np.minimum(one.spread[part, None, :], two.spread[None, :, :]).sum(axis=2) >= need
                i, j = np.nonzero(fits)
                for x, y in zip((i + start).tolist(), j.tolist(), strict=True):
                    for column, value in zip(found, sorted((one.node[x], two.node[y])), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, pa.binary()) for c in found], ["a", "b"])

    return find


class _Traits:
    """What a block of classes is told by: size, root, distance from the pivot, prefix and spread."""

    def __init__(self, table: pa.Table):
        column = lambda name: table[name].combine_chunks()
        self.node = column("node").to_pylist()
        self.n = column("n").to_numpy()
        self.root = np.array(column("root").to_pylist(), object)
        self.distance = column("distance").fill_null(np.nan).to_numpy()
        prefix = column("prefix")
        self.lengths, self.grams = prefix.value_lengths().to_numpy(), prefix.flatten().to_numpy()
        self.spread = column("spread").flatten().to_numpy().reshape(len(self.n), SPREAD)

    def incidence(self, grams: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        """A row for each class, a column for each n-gram: 1 if it is in the prefix."""
        ends = np.cumsum(self.lengths)
        rows = np.arange(len(self.n))[part]
        out = np.zeros((len(rows), len(grams)), np.float32)
        first, last = ends[rows[0]] - self.lengths[rows[0]], ends[rows[-1]]
        out[np.repeat(np.arange(len(rows)), self.lengths[rows]), np.searchsorted(grams, self.grams[first:last])] = 1
        return out


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, distance, linked`` of the pairs ``pivot, a, b``: one minus their Jaccard index, and whether they are
    similar enough. The set of ``b`` goes once to a task with all its ``a`` of a pivot's group, and
    those once to each task of the group."""
    whole = sets.select("set_id", "shingles")
    wanted = pairs.groupBy("pivot", "b").agg(F.collect_list("a").alias("with"))  # at most PIVOTS, or those of one join
    counts = wanted.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    salted = join_hot(wanted, counts, ["pivot"]).withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS_A_TASK)).cast("int")
    )
    salted = cut_lineage(salted.select("pivot", "salt", "b", "with"))
    ones = salted.select("pivot", "salt", F.explode("with").alias("one")).distinct()
    left = ones.join(whole.withColumnRenamed("set_id", "one"), "one").select(
        F.col("pivot").alias("one_pivot"), F.col("salt").alias("one_salt"), "one", F.col("shingles").alias("one_shingles")
    )
    right = salted.join(whole.withColumnRenamed("set_id", "b"), "b")

    def verify(some: pa.Table, many: pa.Table) -> pa.Table:
        found = [], [], [], []
        read = lambda v: np.frombuffer(v.as_buffer(), np.uint64)
        known = dict(zip(some["one"].to_pylist(), map(read, some["one_shingles"]), strict=True))
        for b, ones, shingles in zip(many["b"].to_pylist(), many["with"].to_pylist(), many["shingles"], strict=True):
            y = read(shingles)
            for a in ones:
                x = known[a]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    union = len(x) + len(y) - both
                    row = a, b, 1 - both / union, 100 * both >= percent * union
                else:
                    row = a, b, None, False
                for column, value in zip(found, row, strict=True):
                    column.append(value)
        kinds = (pa.binary(), pa.binary(), pa.float64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["a", "b", "distance", "linked"])

    return left.groupBy("one_pivot", "one_salt").cogroup(right.groupBy("pivot", "salt")).applyInArrow(
        verify, "a binary, b binary, distance double, linked boolean"
    )


def similar_groups(docs: DataFrame, *, words: int = NGRAM_WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                   text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A document's set: its distinct runs of ``words`` words with A-Z in lower case; of fewer words
    the whole sequence. Two documents link if ``percent`` per cent of the union are shared. The
    component is the smallest id reachable by links, the row's own included. Rows without words
    (null, empty, white space) link with nothing; a null id is linked like others, but names a
    component only if no row there has an id. Repeated rows are in one component.
    """
    described, roots = _described_and_roots(docs, words, percent, id_col, text_col, bucket_bytes, False)
    some = described.filter(F.col("set_id").isNotNull())
    classes = some.groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"))
    classes = _rooted(classes, roots)
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = join_hot(classes, least, ["root"]).select("set_id", "component_id")
    found = join_hot(some.select("set_id", "doc_id", "n_shingles"), named, ["set_id"]).drop("set_id")
    rest = described.filter(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select(*rest.columns).unionByName(rest)


def _described_and_roots(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, bucket_bytes: int,
                         digests: bool) -> tuple[DataFrame, DataFrame]:
    """What ``_describe`` tells of every row, and ``node, root`` of the classes that link."""
    rows = select_texts(docs, id_col, text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    shape = shape_for(rows, words, lower=True, short=True, bucket_bytes=bucket_bytes, sketch_rows=1)
    dealt = bucketed(rows, shape)
    shared = shared_cells(dealt, shape)
    described = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_describe(shape, percent, digests), DESCRIBED)
    described = cut_lineage(described)
    some = described.filter(F.col("set_id").isNotNull())
    whole = some.select("set_id", "shingles", "prefix", "spread", "n_shingles")
    # any row of a class has its set
    sets = cut_lineage(_one_of_each(whole))
    return described, _class_roots(sets, percent)


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``classes`` with their root: their own ``set_id`` if they link with no other."""
    classes = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    return classes.withColumn("root", F.coalesce("root", "set_id"))


def _one_of_each(whole: DataFrame) -> DataFrame:
    """A row of each class, with what it has in common."""
    value = F.struct("shingles", "prefix", "spread", "n_shingles")
    one = whole.groupBy("set_id").agg(F.first(value).alias("v"))
    return one.select("set_id", "v.*")


def _groups(sets: DataFrame) -> DataFrame:
    """``pivot, node, place``: the members of each group, itself the first by ``place``, up to
    ``PIVOTS``; the others have no place."""
    posted = sets.select(F.col("set_id").alias("node"), F.explode("prefix").alias("gram"))
    lists = posted.groupBy("gram").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = cut_lineage(join_hot(posted, lists.drop("held"), ["gram"]).select("pivot", "node").distinct())
    order = Window.partitionBy("pivot").orderBy(F.col("node") != F.col("pivot"), F.xxhash64("pivot", "node"), "node")
    first = members.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
    return join_hot(members, cut_lineage(first), ["pivot", "node"], "left")


def _class_roots(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the classes that link with others."""
    groups = cut_lineage(_groups(sets))
    firsts = groups.filter("place is not null").select("pivot", F.col("node").alias("one"))
    met = join_hot(groups, firsts, ["pivot"]).filter("node <> one")
    # a pair of two groups, or of two pivots, is verified once
    once = met.groupBy(F.least("one", "node").alias("x"), F.greatest("one", "node").alias("y")).agg(
        F.min(F.struct("pivot", "one", "node")).alias("v")
    )
    pairs = cut_lineage(once.select("v.pivot", F.col("v.one").alias("a"), F.col("v.node").alias("b")))
    scored = cut_lineage(_verify(pairs, sets, percent))
    linked = scored.filter("linked").select("a", "b")
    roots = components(linked)
    rooted = join_hot(groups, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    counts = rooted.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("held"))
    split = counts.groupBy("pivot").agg(
        F.max_by("root", F.struct("held", "root")).alias("main"), F.max("held").alias("most"), F.sum("held").alias("all")
    ).filter((F.col("all") > F.col("most")) & (F.col("all") > PIVOTS))  # a smaller group has met itself
    blocks = [F.ceil(c / MEMBERS_A_TASK).cast("int") for c in (F.col("all") - F.col("most"), F.col("all"))]
    split = cut_lineage(split.select("pivot", "main", blocks[0].alias("own_blocks"), blocks[1].alias("blocks")))
    if split.isEmpty():
        return roots
    named = join_hot(rooted.filter("place is null"), split, ["pivot"])
    # the distance of each member from the group's first pivot, where their lengths allow a link
    ends = scored.filter("distance is not null").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "distance")
    named = named.withColumn("x", F.least("pivot", "node")).withColumn("y", F.greatest("pivot", "node"))
    named = join_hot(named, ends, ["x", "y"], "left").drop("x", "y")
    traits = sets.select(F.col("set_id").alias("node"), F.col("n_shingles").alias("n"), "prefix", "spread")
    named = cut_lineage(named.join(traits, "node"))
    # blocks outside the main component meet all blocks; a member goes to as many tasks as there are others
    columns = ["pivot", "own", "other", "node", "root", "distance", "n", "prefix", "spread"]
    apart = named.filter("root <> main").select(
        "*", F.pmod(F.xxhash64("node", F.lit(1)), "own_blocks").cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    others = named.select(
        "*", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int").alias("other"),
        F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("own"),
    )
    place = ["pivot", "own", "other"]
    near = apart.select(*columns).groupBy(*place).cogroup(others.select(*columns).groupBy(*place))
    left = near.applyInArrow(_near_pairs(percent), "a binary, b binary").distinct().withColumn("pivot", F.col("a"))
    more = _verify(cut_lineage(left), sets, percent).filter("linked").select("a", "b")
    return components(linked.unionByName(more))


def drop_near_copies(docs: DataFrame, *, words: int = NGRAM_WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                     text_col: str = "text", bucket_bytes: int = BUCKET_BYTES // 2) -> DataFrame:
    """``docs`` with exactly one row of each component of ``similar_groups``, all columns as they
    were: that of the smallest id (a null id comes last), then of the smallest digest of the text.

    Rows are told apart by id and text: a null id is no shelter for copies, and texts that only
    share an id do not drop each other. Of rows alike in both, the smallest by the other columns
    stays. Rows without words link with nothing and all stay, repeated ones too. Whole rows that may go
    or have copies travel to be compared with those that do, the others stay where they are. An empty table
    stays empty; columns may have any names. Buckets are half as large as elsewhere, since a stage
    finds its workers with what earlier stages left in them.
    """
    described, roots = _described_and_roots(docs, words, percent, id_col, text_col, bucket_bytes, True)
    some = described.filter(F.col("set_id").isNotNull()).select(
        "set_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256").alias("place")
    )
    # one row for each id and text, with its copies
    each = some.groupBy("set_id", "place").agg(F.count(F.lit(1)).alias("copies"))
    classes = _rooted(each.groupBy("set_id").agg(F.min("place").alias("best"), F.sum("copies").alias("held")), roots)
    best = classes.groupBy("root").agg(F.min("best").alias("best"), F.sum("held").alias("held")).filter("held > 1")
    named = join_hot(classes.select("set_id", "root"), best, ["root"]).select("set_id", "best")
    met = join_hot(each, named, ["set_id"]).withColumn("kept", F.col("place") == F.col("best"))
    met = cut_lineage(met.filter("not kept or copies > 1").select("place", "kept"))
    own = docs[id_col].cast("long")
    place = F.struct(own.isNull().alias("none"), own.alias("doc_id"), F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)).alias("text_sha256"))
    held = packed(docs, place.alias("place"))
    rest, held = split_by_marks(held, met, "place")
    found = rest.unionByName(held.join(met, "place", "left_anti")).select("row")
    twice = met.filter("kept")
    if not twice.isEmpty():
        alike = held.join(twice, "place", "left_semi")
        found = found.unionByName(alike.groupBy("place").agg(F.min("row").alias("row")).select("row"))
    return unpacked(found)
