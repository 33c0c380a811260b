"""Near-duplicate groups from bottom-k sketches of one hash function, with exact Jaccard links.

1. Each text's set of word shingles is hashed; its ``INDEX`` least hashes are retained. Texts with the same words are one
   node, so that exact copies weigh nothing from here on.
2. Inverted lists of the retained values: ordered by how many nodes have them, rarest first, a node is listed under its
   first n - s + 1 of n values, so two nodes that share s of their values meet in a list. For a text contained in the other,
   the worst case, fewer than s = 0.4 n (13 of 32) shared values have a probability of 1.9e-7 at a similarity of 0.8 and
   1.2e-9 at 0.85. So very frequent values (a passage in a third of all texts) list few nodes but those that consist of them.
3. A list's hub is its most typical node, whose values most nodes have. Every other node of the list is held against the hub,
   not against its like: first on the sketch of their union, which sends texts with under ``LEAST`` of 32 values in common to
   the next level; then on the full sets. A hub's nodes are dealt out in blocks of a bounded size, each with a copy of the
   hub, and stream through a task. A node is linked to the hub or to one of a few other leaders of its block, by one row.
4. Links join nodes to components. Pairs of different components that have a hub in common are found by what they differ in
   from it: with X the symmetric difference of a set and the hub's, that of two sets is the one of their X. If i isn't linked
   to the hub, a link i - j needs more than about half of j's X to be in i's, so the rarer half of j's X is an inverted list
   (AllPairs prefix), and the exact overlap of the X of such pairs confirms or rejects the link. Near copies differ from
   their hub by edits of their own, so such lists are short where lists of whole sets would hold the group.
5. Nodes less similar than ``NEAR`` to their hub, and those that could be linked to such a node (by the triangle inequality of
   the Jaccard distance), make up the lists of the next level, with hubs of their own. What is left after ``LEVELS`` is
   compared by prefixes of whole sets. So no pair of a list goes unexamined, and none is emitted but for likely links.

A pair on the limit is lost if it meets in no list (see 2). The filter of 3 can lose it only if it meets in one list, one
text is half like the hub or more and shares under 4 of 32 values with it (1.3e-6), the other one is over 0.65 like it.
``exact=True`` retains whole sets, lists nodes under the exact prefix and skips the sketch filter: nothing is lost, at the
cost of a posting for each shingle.

Nothing of all documents goes to the driver, components included; tables that are used up are deleted. Defined cases. Null
or empty text: no shingles, linked with nothing, a component of its own. Fewer words than a shingle: the whole sequence is
one. Very long texts: a set is 8 bytes a distinct shingle, and a task holds those of a hub and 16 leaders. Repeated rows: the
same node. Ties between hubs go by a hash of the row; they don't change links. Rows of one id with different texts are
different nodes; a component's id is its least document id, nulls aside. An empty table: no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, free_name, stored
from .words import BLANK_WORD, Words, mix, pieces, window_hashes

SHINGLE = 3
PERCENT = 85
INDEX = 32
SHARED = 0.4
LEAST = 4  # of INDEX values of the union, in both
NEAR = 0.5  # a node this similar to its hub is compared through what differs
LEVELS = 3
BLOCK = 1 << 16  # shingles of a hub's nodes in one block
INNER, OUTER = 4, 12  # leaders of a block: nodes linked to the hub, and not
SLICE_BYTES = 1 << 20
_TOP = np.uint64(1 << 63)  # signed order of flipped values is their order as hashes


def shingle_sets(w: Words, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = w.hashes()
    runs = mix(window_hashes(h, shingle))
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.per_text.tolist()):
        if n >= shingle:
            out.append(np.unique(runs[a : a + n - shingle + 1]))
        elif n:
            out.append(mix(window_hashes(h[a : a + n], n)))
        else:
            out.append(runs[:0])
    return out


def _node(w: Words, d: int) -> bytes | None:
    n = int(w.per_text[d])
    return hashlib.blake2b(w.slice(int(w.first[d]), n), digest_size=16).digest() if n else None


def sketch(docs: DataFrame, doc_id: str, text: str, shingle: int, exact: bool) -> DataFrame:
    """(row, id, node, size, retained) of each row; row is a number of its own."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[doc_id].dataType), T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("retained", T.ArrayType(T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = Words(texts, BLANK_WORD, lower=True)
                sets = shingle_sets(w, shingle)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(sets))), part.column(0), pa.array([_node(w, d) for d in range(len(sets))], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([((s if exact else s[:INDEX]) ^ _TOP).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ], names=schema.names)
                row += len(sets)

    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(scan, schema)


def posted_lists(nodes: DataFrame, share: float) -> DataFrame:
    """(key, row, size, typical): nodes under each of the first values of their prefix that another node has, too."""
    values = nodes.select("row", "size", F.size("retained").alias("n"), F.explode("retained").alias("key"))
    often = stored(values.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    by_node = Window.partitionBy("row")
    prefix = F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    rank = F.row_number().over(by_node.orderBy("often", "key"))
    met = values.join(often, "key").withColumn("place", F.col("n") - F.count(F.lit(1)).over(by_node) + rank).withColumn("typical", F.sum("often").over(by_node))
    listed = stored(met.filter(F.col("place") <= prefix).select("key", "row", "size", "typical"))
    dropped(often)
    return listed


def fetched(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, packed): the compressed words of each node."""
    ids = nodes.select("row", F.col("id").alias("_id"), "node")
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = source.join(ids, F.col("id").eqNullSafe(F.col("_id"))).select("row", "node", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = Words(texts, BLANK_WORD, lower=True)
                row, node = part.column(0).to_pylist(), part.column(1).to_pylist()
                keep = [d for d, x in enumerate(node) if _node(w, d) == x]  # an id may have several texts
                yield pa.RecordBatch.from_arrays([pa.array([row[d] for d in keep], pa.int64()), pa.array([pack(w.slice(int(w.first[d]), int(w.per_text[d]))) for d in keep], pa.binary())], names=["row", "packed"])

    return joined.mapInArrow(scan, "row long, packed binary").dropDuplicates(["row"])


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(c, row, size, typical, block): each node of a list with the list's hub, once, and one of the hub's blocks."""
    score = F.shiftleft("typical", 20) + F.pmod(F.xxhash64("row"), F.lit(1 << 20))
    sums = lists.groupBy("key").agg(F.max_by("row", score).alias("c"), F.ceil(F.sum(F.col("size").cast("long")) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("members"))
    hubs = stored(sums.filter("members > 1").drop("members"))
    block = F.max_by(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"), "blocks").alias("block")  # as its largest list deals it
    out = stored(lists.join(hubs, "key").filter("row != c").groupBy("c", "row", "size", "typical").agg(block))
    dropped(hubs)
    return out


def near_pairs(pairs: DataFrame, nodes: DataFrame, exact: bool) -> DataFrame:
    """Pairs with near: their full sets are worth a comparison."""
    a = nodes.select(F.col("row").alias("c"), F.col("size").alias("c_size"), F.col("retained").alias("ra"))
    both = pairs.join(nodes.select("row", F.col("retained").alias("rb")), "row").join(a, "c")
    near = F.least("size", "c_size") >= NEAR * F.greatest("size", "c_size")
    if not exact:
        union = F.slice(F.array_sort(F.array_union("ra", "rb")), 1, INDEX)
        common = F.size(F.array_intersect(union, F.array_intersect("ra", "rb")))
        near &= common * INDEX >= LEAST * F.size(union)
    return stored(both.select(*pairs.columns, near.alias("near")))


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted sets: for each value of b whether it is in a, and the places in a of those."""
    at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
    there = a[at] == b if len(a) else np.zeros(len(b), dtype=bool)
    return there, at[there]


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Each pair's full sets: (c, row, typical, size, c_size, common, leader, x). leader: a node that row is linked to, c before others; x: in one set only, from NEAR on."""
    members = pairs.select("c", "block", F.lit(1).alias("turn"), "typical", "row")
    hubs = pairs.select("c", "block").distinct().select("c", "block", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("typical"), F.col("c").alias("row"))
    dealt = members.unionByName(hubs).join(texts, "row").repartition("c", "block").sortWithinPartitions("c", "block", "turn", F.desc("typical"), "row")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        hub, leaders, inner, outer = np.zeros(0, dtype=np.uint64), [], 0, 0
        linked = lambda both, a, b: 100 * both >= percent * (len(a) + len(b) - both)
        for batch in batches:
            for part, packed in pieces(batch, "packed", SLICE_BYTES):
                c, turn, row, typical = (part.column(part.schema.get_field_index(n)).to_numpy() for n in ("c", "turn", "row", "typical"))
                sets = shingle_sets(Words([unpack(x) for x in packed], BLANK_WORD, lower=False), shingle)
                out: dict[str, list] = {n: [] for n in ("c", "row", "typical", "size", "c_size", "common", "leader", "x")}
                for i, own in enumerate(sets):
                    if turn[i] == 0:
                        hub, leaders, inner, outer = own, [], 0, 0
                        continue
                    there, at = _overlap(hub, own)
                    n = len(at)
                    to = int(c[i]) if linked(n, hub, own) else None
                    if to is not None:
                        if inner < INNER:
                            inner += 1
                            leaders.append((int(row[i]), own))
                    else:
                        for who, other in leaders:
                            if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)) and linked(len(_overlap(other, own)[1]), other, own):
                                to = who
                                break
                        else:
                            if outer < OUTER:
                                outer += 1
                                leaders.append((int(row[i]), own))
                    x = None
                    if n >= NEAR * (len(hub) + len(own) - n):
                        gone = np.ones(len(hub), dtype=bool)
                        gone[at] = False
                        x = np.concatenate([own[~there], hub[gone]]).view(np.int64)
                    for name, v in zip(out, (int(c[i]), int(row[i]), int(typical[i]), len(own), len(hub), n, to, x)):
                        out[name].append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(out[n], pa.int64()) for n in list(out)[:-1]), pa.array(out["x"], pa.list_(pa.int64()))], names=list(out))

    return stored(dealt.mapInArrow(scan, "c long, row long, typical long, size long, c_size long, common long, leader long, x array<long>"))


def whole_sets(lists: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(c, row, size, x): whole sets of the nodes of lists that no level has resolved."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, packed in pieces(batch, "packed", SLICE_BYTES):
                sets = shingle_sets(Words([unpack(x) for x in packed], BLANK_WORD, lower=False), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["c", "row", "size", "x"])

    return lists.select("row", F.col("key").alias("c")).join(texts, "row").select("c", "row", "packed").mapInArrow(scan, "c long, row long, size long, x array<long>")


def differing(found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(level, c, row, size, n, label, probes, prefix, x) of the nodes of hubs with several components. n: values of x.

    prefix: so many of a node's rarest values can hold the first one in common with a node that isn't linked to the hub;
    probes: of such a node the same for its partners, else 0.
    """
    l = (100 - percent) / (100 + percent)
    of = lambda name, c: labels.select(F.col("row").alias(c), F.col("label").alias(name))
    z = found.filter("x is not null")
    apart = z.filter("leader is null or leader != c").select("level", "c", "row").join(of("a", "row"), "row", "left").join(of("b", "c"), "c", "left")
    apart = stored(apart.filter(F.coalesce("a", "row") != F.coalesce("b", "c")).select("level", "c", "row", F.lit(True).alias("outer")))
    hubs = stored(apart.select("level", "c").distinct())
    n = F.size("x").cast("long")
    prefix = n - F.floor((n + l * (F.col("c_size") - F.col("size"))) / 2 - 1e-9)
    probes = n - F.ceil((n - l * (F.col("c_size") + F.col("size"))) / (1 + l) - 1e-9) + 1
    some = z.join(hubs, ["level", "c"], "left_semi").join(apart, ["level", "c", "row"], "left").join(of("label", "row"), "row", "left")
    out = stored(some.select("level", "c", "row", "size", n.alias("n"), F.coalesce("label", "row").alias("label"), F.when(F.col("outer"), F.greatest(F.lit(1), F.least(n, probes))).otherwise(0).cast("long").alias("probes"), prefix.cast("long").alias("prefix"), "x"))
    dropped(hubs, apart)
    return out


def likely_pairs(sides: DataFrame, percent: int) -> DataFrame:
    """(level, c, a, b): pairs of different components of one hub that share a value of their prefixes and may share enough."""
    l = (100 - percent) / (100 + percent)
    posted = sides.select("level", "c", "row", "size", "n", "label", "probes", "prefix", F.explode("x").alias("value"))
    key = ["level", "c", "value"]
    often = stored(posted.groupBy(*key).agg(F.count(F.lit(1)).alias("often"), F.max("probes").alias("asked")).filter("often > 1"))
    by_node = Window.partitionBy("level", "c", "row")
    met = posted.join(often, key).withColumn("place", F.col("n") - F.count(F.lit(1)).over(by_node) + F.row_number().over(by_node.orderBy("often", "value")))
    met = stored(met.filter("asked > 0 and place <= greatest(prefix, probes)").drop("asked", "often"))
    names = ("row", "size", "n", "label", "place")
    side = lambda s, limit: met.filter(F.col("place") <= F.col(limit)).select(*key, *(F.col(c).alias(f"{c}_{s}") for c in names))
    a, b = side("a", "probes"), side("b", "prefix")
    need = (F.col("n_a") + F.col("n_b") - l * (F.col("size_a") + F.col("size_b"))) / 2 - 1e-9
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    sizes = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    pairs = a.join(b, key).filter((F.col("label_a") != F.col("label_b")) & (rest >= need) & sizes)
    out = stored(pairs.select("level", "c", F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct())
    dropped(often, met)
    return out


def confirmed(pairs: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs whose full sets are similar enough, from what each differs in from its hub."""
    of = lambda s: sides.select("level", "c", F.col("row").alias(s), F.col("size").alias(f"size_{s}"), F.col("x").alias(f"x_{s}"))
    both = pairs.join(of("a"), ["level", "c", "a"]).join(of("b"), ["level", "c", "b"])
    apart = F.col("size_a") + F.col("size_b")
    # of n values in all, twice those in both are n less those in one only
    twice = apart - (F.size("x_a") + F.size("x_b") - 2 * F.size(F.array_intersect("x_a", "x_b")))
    return both.filter(100 * twice >= percent * (2 * apart - twice)).select("a", "b").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(row, label) of every linked node; label: the least node of its component. Contraction by least neighbours.

    With the labels of other links, those are joined by the links (and must cover their nodes that aren't single).
    """

    def mapped(edges: DataFrame, up: DataFrame) -> DataFrame:
        at = lambda c: up.select(F.col("row").alias(c), F.col("label").alias(f"{c}_label"))
        both = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        return both.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def further(up: DataFrame, name: str) -> DataFrame:
        return up.select(F.col("row").alias("label"), F.col("label").alias(name))

    edges = stored(mapped(links, labels) if labels is not None else links.select("a", "b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("row")).agg(F.least(F.col("row"), F.min("b")).alias("label")))
        moved = True
        while moved:  # to the end of each chain, two steps at once
            step = up.join(further(up, "x"), "label", "left").select("row", F.coalesce("x", "label").alias("label"))
            jumped = stored(step.join(further(up, "x"), "label", "left").select("row", F.coalesce("x", "label").alias("label"), (F.col("x") < F.col("label")).alias("moved")))
            dropped(up)
            up, moved = jumped.select("row", "label"), not jumped.filter("moved").isEmpty()
        fewer = stored(mapped(edges, up))
        dropped(edges)
        edges = fewer
        if labels is None:
            labels = up
        else:
            old = labels.join(further(up, "x"), "label", "left").select("row", F.coalesce("x", "label").alias("label"))
            new = stored(old.unionByName(up.join(labels.select("row"), "row", "left_anti")))
            dropped(labels, up)
            labels = new
    return labels if labels is not None else edges.select(F.col("a").alias("row"), F.col("b").alias("label"))


def near_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """(id, n_shingles, component) of every row: its number of shingles, and the least id of its component."""
    rows = stored(sketch(docs, doc_id, text, shingle, exact))
    canon = stored(rows.filter("node is not null").groupBy("node").agg(F.min("row").alias("row")))
    named = stored(rows.select("id", "node", "size").join(canon.withColumnRenamed("row", "_row"), "node", "left").select("id", F.col("_row").alias("row"), F.col("size").cast("long").alias("n_shingles")))
    lists = posted_lists(rows.join(canon.select("row"), "row", "left_semi"), percent / 100 if exact else SHARED)
    pairs = hub_pairs(lists)
    nodes = stored(rows.join(pairs.select("row").unionByName(pairs.select(F.col("c").alias("row"))).distinct(), "row", "left_semi"))
    dropped(rows, canon, lists)
    texts = stored(fetched(docs, nodes, doc_id, text))
    found: list[DataFrame] = []
    apart = (1 - percent / 100) + NEAR  # a node linked to one under NEAR is under this
    for level in range(LEVELS):
        if level:
            pairs = hub_pairs(lists)
            dropped(lists)
        tried = near_pairs(pairs, nodes, exact)
        z = compared(tried.filter("near"), texts, shingle, percent)
        found.append(z.withColumn("level", F.lit(level)))
        again = z.filter(F.col("leader").isNull() | (F.col("common") < apart * (F.col("size") + F.col("c_size") - F.col("common"))))
        far = tried.filter("not near")
        lists = stored(_union(*(df.select(F.col("c").alias("key"), "row", F.col("size").cast("int").alias("size"), "typical") for df in (again, far))))
        dropped(pairs, tried)
        if lists.isEmpty():
            break
    z = _union(*found)
    links = stored(z.filter("leader is not null").select(F.col("leader").alias("a"), F.col("row").alias("b")))
    labels = components(links)
    sides = [differing(z, labels, percent)]
    dropped(*found, links)
    if not lists.isEmpty():
        n = F.col("size")
        prefix = (n - F.ceil(percent / 100 * n - 1e-9) + 1).cast("long")
        whole = whole_sets(lists, texts, shingle).join(labels, "row", "left")
        sides.append(stored(whole.select(F.lit(LEVELS).alias("level"), "c", "row", "size", n.alias("n"), F.coalesce("label", "row").alias("label"), prefix.alias("probes"), prefix.alias("prefix"), "x")))
    dropped(texts, nodes, lists)
    both = _union(*sides)
    likely = likely_pairs(both, percent)
    fresh = stored(confirmed(likely, both, percent))
    dropped(likely, *sides)
    labels = components(fresh, labels)
    dropped(fresh)
    full = stored(named.join(labels, "row", "left").select("id", "n_shingles", F.coalesce("label", "row").alias("label")))
    dropped(named, labels)
    least = stored(full.filter("label is not null").groupBy("label").agg(F.min("id").alias("component")))
    return full.join(least, "label", "left").select("id", "n_shingles", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def _union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df)
    return first


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group stays, the one of the least id, with its columns as they were; repeated ids stay together."""
    found = near_components(docs, doc_id=doc_id, text=text, **options)
    kept = free_name(docs, "_kept")
    stay = found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias(kept)).distinct()
    return docs.join(stay, docs[doc_id].eqNullSafe(stay[kept]), "left_semi")


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
