"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its runs of `words` consecutive words
(lower-cased ASCII): a shingle weighs its count in the text times an inverse
document frequency, log(1 + 1 / share) to the power `damp`, as a part of what a
shingle has of which the share `common` of documents know.  The share comes from a
count sketch of fixed size over all different texts, so a group of exact copies
counts once.  Without the power, what a large group of near copies shares would
weigh so much less than that in which its members differ that they fall apart: with
it, in a group that holds 5 % of all texts, members of plain similarity 0.85 have 0.8.

Improved consistent weighted sampling draws rows * bands + extra samples of a
document; two documents agree in a sample with the probability of their weighted
Jaccard similarity.  Documents that agree in all samples of a band are
candidates, and worth an exact comparison if they agree in the share `agree` of
all samples, which lies more than three deviations below the threshold.

Equal texts are one node from the start.  In each band's bucket all nodes are
compared with two hubs, the node that shares most buckets with others and the
least one, so a group of any size costs a comparison or two a
member; whatever is then connected needs no further comparison.  The rest, pairs
of one bucket that lie in different components, is compared too, each in the
first bucket that both have.  Buckets in which more than `crowd` nodes are left
are cut into blocks that carry their texts, and the similarities of all pairs of
two blocks are found at once, by products of matrices of the shingles; these are
the same pairs and similarities.  Every link is verified by the weighted Jaccard
similarity of the two whole texts, and the classes are the connected components.

A text of fewer than `words` words is one shingle.  Null and empty texts are
nobody's duplicate: such a row is its own class.  Null identifiers count as larger than
all others.  Repeated rows are exact copies.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, thinned, without
from .textbatch import SPACE, U64, buffers, mix, signed, slices, tokenize, windows

SLOTS = 1 << 16
BLOCK = 1 << 13
PARTS = 64
FILTER_SLOTS = 1 << 20
#: Shingles in a product of matrices.
COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    rows: int = 3
    bands: int = 9
    common: float = 1e-5
    damp: float = 0.25
    crowd: int = 64
    block: int = 512
    block_bytes: int = 4 << 20
    extra: int = 37
    agree: float = 0.64

    @property
    def samples(self) -> int:
        return self.rows * self.bands + self.extra


_LOG12 = -np.log((np.arange(1 << 12) + 0.5) / (1 << 12)).astype(np.float32)
_LOG14 = -np.log((np.arange(1 << 14) + 0.5) / (1 << 14)).astype(np.float32)


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text's index, hash, count), in the order of the texts."""
    tokens = tokenize(data, bounds, SPACE, lower=True)
    hashes, at = windows(tokens, words)
    owner = tokens.owners()[at]
    short = np.flatnonzero((tokens.counts > 0) & (tokens.counts < words))
    if len(short):
        extra = np.array([_whole(tokens.hashes[tokens.offsets[i] : tokens.offsets[i + 1]]) for i in short], U64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    count = np.zeros(len(h), np.int32)
    count[order[first]] = np.diff(np.append(first, len(h)))
    keep = count > 0
    return owner[keep], hashes[keep], count[keep]


def _whole(h: np.ndarray) -> np.uint64:
    total = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            total = total * U64(0x9FB21C651E98DF25) + x
    return mix(np.array([total]))[0]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(8)).astype(np.int64) & (SLOTS - 1), (h >> U64(40)).astype(np.int64) & (SLOTS - 1)


class Frequencies:
    """Document frequencies of all shingles, from a count sketch with two rows of fixed length."""

    def __init__(self, counts: np.ndarray, documents: int, settings: Settings):
        self.counts, self.documents, self.common, self.damp = counts - counts.mean(axis=1, keepdims=True), max(documents, 1), settings.common, settings.damp

    def weights(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b = _slots(h)
        share = np.maximum(np.minimum(self.counts[0][a], self.counts[1][b]) / self.documents, self.common)
        return (count * (np.log1p(1 / share) / np.log1p(1 / self.common)) ** self.damp).astype(np.float32)


def different(keyed: DataFrame) -> DataFrame:
    """The different texts of keyed (text, node).  Only texts that have copies are shuffled, one of each task."""
    copied = saved(keyed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "copied")
    own = keyed.select("node", "text")
    again = thinned(own, ["node"], copied, ["node"]).join(copied, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return without(own, copied).select("text").unionByName(again.select("text"))


def frequencies(texts: DataFrame, settings: Settings) -> Frequencies:
    """Document frequencies in the texts, which are counted as they come."""

    def counted(batches):
        total, n = np.zeros((2, SLOTS), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, data, bounds in slices(batch):
                _, h, _ = shingles(data, bounds, settings.words)
                for row, slot in zip(total, _slots(h)):
                    row += np.bincount(slot, minlength=SLOTS)
        blocks = total.reshape(-1, BLOCK)
        part = TaskContext.get().partitionId() % PARTS
        for i, b in enumerate(blocks):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([n if i == 0 else 0], pa.int64()), "counts": pa.array([b.tobytes()], pa.binary())})

    def added(key, table):
        total = np.zeros(BLOCK, np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(b, np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, n long, counts binary"
    parts = texts.mapInArrow(counted, "block int, part int, n long, counts binary").groupBy("block", "part").applyInArrow(added, schema)
    total, n = np.zeros((2 * SLOTS // BLOCK, BLOCK), np.int64), 0
    for r in parts.groupBy("block").applyInArrow(added, schema).collect():  # a fixed number of rows
        total[r.block] = np.frombuffer(r.counts, np.int64)
        n += r.n
    return Frequencies(total.reshape(2, SLOTS).astype(np.float64), n, settings)


def sample(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """k consistent weighted samples of each text, as 64-bit hashes; 0 for a text without shingles."""
    out = np.zeros((texts, k), U64)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(first, len(h)))
    log_w = np.log(weight)
    for j in range(k):
        x = mix(h + U64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = _LOG12[(x & U64(0xFFF)).astype(np.int16)] + _LOG12[((x >> U64(12)) & U64(0xFFF)).astype(np.int16)]
        beta = ((x >> U64(24)) & U64(0xFFF)).astype(np.float32) * np.float32(1 / 4096)
        c = _LOG14[((x >> U64(36)) & U64(0x3FFF)).astype(np.int16)] + _LOG14[(x >> U64(50)).astype(np.int16)]
        t = np.floor(log_w / r + beta)
        score = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(least, sizes))
        which, at = np.unique(owner[hit], return_index=True)
        hit = hit[at]
        out[which, j] = mix(h[hit] ^ mix(t[hit].astype(np.int64).view(U64) + U64(j)))
    return out


def signatures(texts: DataFrame, carry: list[str], settings: Settings, freq: Frequencies) -> DataFrame:
    """The columns in `carry`, the samples' low 32 bits as `sig` and a hash for each band as `bands`; both null without words."""
    shared = texts.sparkSession.sparkContext.broadcast(freq)
    k, r = settings.samples, settings.rows

    def run(batches):
        for batch in batches:
            for part, data, bounds in slices(batch, most=1 << 20):
                owner, h, count = shingles(data, bounds, settings.words)
                n = part.num_rows
                s = sample(owner, h, shared.value.weights(h, count), n, k)
                none = np.bincount(owner, minlength=n) == 0
                keys = np.zeros((n, settings.bands), U64)
                for b in range(settings.bands):  # the extra samples belong to no band
                    total = np.full(n, b, U64)
                    for x in s[:, b * r : b * r + r].T:
                        total = mix(total * U64(0xFF51AFD7ED558CCD) + x)
                    keys[:, b] = total
                lists = _lists((s & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), none), _lists(signed(keys), none)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *lists], names=[*carry, "sig", "bands"])

    ddl = ", ".join([*(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carry), "sig array<int>", "bands array<long>"])
    return texts.mapInArrow(run, ddl)


def _lists(values: np.ndarray, none: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, null where `none` is true."""
    n, k = values.shape
    starts = pa.array(np.arange(n + 1, dtype=np.int32) * k)
    return pa.ListArray.from_arrays(starts, pa.array(values.reshape(-1)), mask=pa.array(none))


def similarity(a: pa.Array, b: pa.Array, settings: Settings, freq: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of the texts a[i] and b[i]."""
    sides = [shingles(*buffers(x), settings.words) for x in (a, b)]
    owner = np.concatenate([s[0] for s in sides])
    h = np.concatenate([s[1] for s in sides])
    weight = np.concatenate([freq.weights(s[1], s[2]) for s in sides]).astype(np.float64)
    n = len(a)
    both = np.zeros(n)
    if len(h):
        order = np.lexsort((h, owner))
        h, o, w = h[order], owner[order], weight[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1]))
        both = np.bincount(o[same], np.minimum(w[same], w[same + 1]), n)
    total = np.bincount(owner, weight, n)
    return both / np.maximum(total - both, 1e-12)


def node_of(text: Column) -> Column:
    """What equal texts share: 128 bits of hash; null texts count as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def agreement(a: str, b: str) -> Column:
    """The number of samples in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def similarities(texts: pa.Array, x: np.ndarray, y: np.ndarray, settings: Settings, freq: Frequencies) -> np.ndarray:
    """The weighted Jaccard similarity of each text of x with each of y, both as indexes."""
    owner, h, count = shingles(*buffers(texts), settings.words)
    weight = freq.weights(h, np.ones(len(h), np.int32)).astype(np.float64)
    total = np.bincount(owner, weight * count, len(texts))
    # a shingle that a text has k times is k items, so that what two texts share is a product of 0 and 1
    at = np.repeat(np.arange(len(h)), count)
    number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    keys = mix(h[at] + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    columns, first, n = np.unique(keys, return_index=True, return_counts=True)
    columns, worth = columns[n > 1], weight[at[first[n > 1]]]
    place = np.minimum(np.searchsorted(columns, keys), max(len(columns) - 1, 0))
    hit = np.flatnonzero(columns[place] == keys) if len(columns) else np.zeros(0, np.int64)
    place, row = place[hit], owner[at[hit]]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    both = np.zeros((len(x), len(y)))
    for low in range(0, len(columns), COLUMNS):
        some = slice(*np.searchsorted(place, (low, low + COLUMNS)))
        m = np.zeros((len(texts), min(COLUMNS, len(columns) - low)))
        m[row[some], place[some] - low] = 1
        both += (m[x] * worth[low : low + COLUMNS]) @ m[y].T
    return both / np.maximum(total[x][:, None] + total[y][None, :] - both, 1e-12)


def _in_blocks(settings: Settings, shared):
    """For applyInArrow: the links between two blocks of a bucket (or of one with itself) that lie in different components
    and have this bucket as their first common one."""

    def run(key, table):
        bucket, i, j = (k.as_py() for k in key)
        block, comp = table.column("block").to_numpy(), table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        flat = table.column("bands").combine_chunks()
        bands = flat.flatten().to_numpy().reshape(len(flat), -1)
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = similarities(table.column("text").combine_chunks(), x, y, settings, shared.value) >= settings.threshold - 1e-9
        a, b = np.nonzero(linked & (comp[x][:, None] != comp[y][None, :]))
        a, b = x[a], y[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        own = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            own[at : at + (1 << 16)] = bands[p, (bands[p] == bands[q]).argmax(axis=1)] == bucket
        node = table.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(a[own])), "b": node.take(pa.array(b[own]))})

    return run


class _Graph:
    """Candidate pairs of nodes, their verification, and the components of the links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, settings: Settings, freq: Frequencies):
        self.docs, self.nodes, self.settings, self.freq = docs, nodes, settings, freq
        self.shared = docs.sparkSession.sparkContext.broadcast(freq)
        self.sigs = nodes.select("node", "sig")
        self.least = int(settings.agree * settings.samples)

    def texts(self, some: DataFrame) -> DataFrame:
        """(node, text) of some different nodes.  A broadcast of at most FILTER_SLOTS numbers thins the documents before the join."""
        wanted = some.join(self.nodes.select("node", "first_id"), "node").toDF("w_node", "w_id")

        def slot(column: str) -> Column:
            return F.pmod(F.xxhash64(column), F.lit(FILTER_SLOTS)).cast("int").alias("slot")

        own = self.docs.select("doc_id", "node", "text", slot("node"))
        thin = own.join(F.broadcast(wanted.select(slot("w_node")).distinct()), "slot", "left_semi")
        found = thin.join(wanted, (F.col("node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
        return saved(found.dropDuplicates(["node"]), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the threshold."""
        pairs = saved(pairs, "pairs")
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        settings, shared = self.settings, self.shared

        def run(batches):
            for batch in batches:
                at = 0
                sizes = np.diff(buffers(batch.column("x"))[1]) + np.diff(buffers(batch.column("y"))[1])
                ends = np.cumsum(sizes)
                while at < batch.num_rows:
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (4 << 20), "right")))
                    part = batch.slice(at, to - at)
                    ok = similarity(part.column("x"), part.column("y"), settings, shared.value) >= settings.threshold - 1e-9
                    yield part.select(["a", "b"]).filter(pa.array(ok))
                    at = to

        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return saved(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "links")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose samples agree often enough to be worth a comparison."""
        s = self.sigs
        both = pairs.distinct().join(s.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        return both.where(agreement("sa", "sb") >= self.least).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links (a, b) connect each node to.

    In each round a node goes over to its least neighbour, and on to that one's; then only the links between what is
    left are kept, so the rounds after the first see few of them.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    labels = saved(ends.distinct().withColumn("comp", F.col("node")), "labels")
    while not edges.isEmpty():
        least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))  # those that have a smaller neighbour
        least = saved(least, "least")
        moves = saved(least.join(least.toDF("to", "on"), "to", "left").select("node", F.coalesce("on", "to").alias("to")), "moves")
        mapped = edges.join(moves.toDF("a", "to_a"), "a", "left").join(moves.toDF("b", "to_b"), "b")  # the larger end always moves
        ends_ = mapped.select(F.coalesce("to_a", "a").alias("a"), F.col("to_b").alias("b")).where("a <> b")
        edges = saved(ends_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = saved(labels.join(moves.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
    return labels


def classes(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, class_id, class_node, first_id, copies): for each distinct text its class, and the least identifier that has it.

    class_node is the text that has the class' least identifier.  Texts without words are left out.
    """
    own = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    keyed = own.withColumn("node", node_of(F.col("text")))
    freq = frequencies(different(keyed), settings)
    signed_ = signatures(keyed, ["doc_id", "node"], settings, freq).where("sig is not null")
    nodes = saved(signed_.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    graph = _Graph(keyed, nodes, settings, freq)

    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    counted = saved(members.join(sizes, "bucket"), "members")
    central = counted.join(counted.groupBy("node").agg(F.sum("n").alias("reach")), "node")
    hubs = central.groupBy("bucket").agg(F.min("node").alias("low"), F.max(F.struct("reach", "node")).alias("high")).withColumn("high", F.col("high.node"))
    shared = saved(counted.join(hubs, "bucket"), "hubs")
    pairs = shared.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    first = graph.verified(graph.likely(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))))
    comp = components(first)

    placed = shared.select("bucket", "node", "low", "high").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
    left = saved(placed.join(open_.select("bucket", "n"), "bucket").join(nodes.select("node", "sig", "bands"), "node"), "left")
    crowded = F.col("n") > settings.crowd
    rest = left.where(~crowded).select("bucket", "node", "low", "high", "comp", "sig", "bands")
    x, y = (rest.select(*(F.col(c).alias(f"{c}_{s}") for c in rest.columns)) for s in "xy")
    seen = F.col("node_x").isin(F.col("low_x"), F.col("high_x")) | F.col("node_y").isin(F.col("low_x"), F.col("high_x"))
    own_bucket = F.array_intersect("bands_x", "bands_y")[0]
    apart = (F.col("node_x") < F.col("node_y")) & (F.col("comp_x") != F.col("comp_y")) & ~seen & (F.col("bucket_x") == own_bucket)
    cross = x.join(y, (F.col("bucket_x") == F.col("bucket_y")) & apart & (agreement("sig_x", "sig_y") >= graph.least))
    cross = cross.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    large = left.where(crowded & ~F.col("node").isin(F.col("low"), F.col("high"))).select("bucket", "node", "comp", "bands")
    large = large.join(graph.texts(large.select("node").distinct()), "node")
    blocks = F.ceil(F.greatest(F.count("*") / settings.block, F.sum(F.octet_length("text")) / settings.block_bytes)).cast("int")
    large = large.join(large.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    large = large.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "bands", "text")
    found = large.groupBy("bucket", "i", "j").applyInArrow(_in_blocks(settings, graph.shared), "a binary, b binary")
    more = saved(graph.verified(cross.distinct()).unionByName(found), "more")
    comp = components(saved(first.union(more), "links")) if not more.isEmpty() else comp

    named = nodes.select("node", "first_id", "copies").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    order = F.struct(F.col("first_id").isNull(), "first_id", "node")
    least = named.groupBy("comp").agg(F.min(order).alias("least"))
    return saved(named.join(least, "comp").select("node", F.col("least.first_id").alias("class_id"), F.col("least.node").alias("class_node"), "first_id", "copies"), "classes")


def near_dedup(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (the least identifier of its class), copies (rows with the same text)."""
    found = classes(docs, settings, ident, text).select("node", "class_id", "copies")
    own = docs.select(F.col(ident).alias("doc_id"), node_of(F.col(text)).alias("node"))
    return own.join(found, "node", "left").select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def kept(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one for each class: that with the least identifier.  Rows without words all stay."""
    found = classes(docs, settings, ident, text)
    keyed = docs.withColumn("__node", node_of(F.col(text)))
    stays = (F.col("node") == F.col("class_node")) & F.col(ident).eqNullSafe(F.col("first_id"))
    rows = keyed.select(ident, "__node").join(found, F.col("__node") == F.col("node"))
    losers = saved(rows.where(~stays).select(ident, "__node"), "losers")
    rest = without(keyed, losers)
    if not rows.where(stays).groupBy("__node").count().where("count > 1").isEmpty():  # repeated rows
        words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        rest = rest.where(words).dropDuplicates(["__node"]).unionByName(rest.where(~words))
    return rest.drop("__node")


def op9_near_dedup(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))


__all__ = ["Settings", "classes", "components", "different", "frequencies", "kept", "near_dedup", "op9_near_dedup"]
