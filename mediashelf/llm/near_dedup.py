"""Near-duplicate detection by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.llm.common import components, small, staged, text_digest, without_rows

HASHES = 96  # minwise tokens of a document
TREES = 16  # independent trees, each starting at a token position of its own
SKETCHED = 64  # tokens that the sketch holds four bits of
NODE_LIMIT = 4_096  # a node of so many sets or fewer is compared exhaustively, in one place
NODE_SHINGLES = 2_000_000  # shingles of sets that are compared in one place, about
PROBES = 32  # sets of a crowded node that the others' mean similarity to it is estimated from
DENSE = 0.9  # a set this part as similar to its node as linked ones, on average, leaves the node
RENEWED = 0.1  # labels are renewed once new links could join this part of the crowded sets
ID_ROWS = 1_000_000  # ids (8 bytes each) broadcast at most
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RANDOM = np.random.default_rng(20_240_607)
_FACTOR = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words, computed once for each word a worker meets."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles of a text.

    A-Z count as a-z; words are runs of anything but space and the bytes 9 to 13.  A text of
    fewer words is one shingle, a text without words the empty set.
    """
    # splitting bytes cuts at exactly those six characters, and lower() changes A-Z only
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"")
    found = data.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(ids))
    value = np.full(len(ids) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        value = _mixed(value * _GOLDEN + ids[i:len(ids) - size + 1 + i])
    return np.unique(value)


def tokens_of(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of sets that are not empty, a row each."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    joined = np.concatenate(sets)
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        hashed = ((joined * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def missed(similarity: float, levels: int, percent: int = 80) -> float:
    """The chance that a pair meets in no node any more after so many crowded levels.

    Trees start at tokens of their own and branch by the same other tokens, so it is computed
    for every number of those that the pair may share, and weighted by how likely that is.
    """
    others, total, more = HASHES - TREES, 0.0, 100 / percent - 1
    for shared in range(others + 1):
        p, lost = shared / others, 0.0
        for _ in range(levels):
            lost = (1 - p + p * lost) * (1 - more * p + more * p * lost)
        chance = comb(others, shared) * similarity**shared * (1 - similarity) ** (others - shared)
        total += chance * (1 - similarity * (1 - lost)) ** TREES
    return total


def _summaries(words: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 512):
                few = part.slice(a, 512)
                sets = [shingle_set(t, words) for t in few.column(1).cast(pa.binary()).to_pylist()]
                filled = [i for i, s in enumerate(sets) if len(s)]
                tokens = np.zeros((len(sets), HASHES), dtype=np.uint32)
                if filled:
                    tokens[filled] = tokens_of([sets[i] for i in filled])
                # four bits of each sketched token, packed into four numbers
                bits = (tokens[:, :SKETCHED] & 15).reshape(len(sets), 4, 16).astype(np.uint64)
                packed = (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(
                    axis=2, dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    few.column(0), few.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(
                        pa.array(tokens.astype(np.int32).reshape(-1)), HASHES
                    ).cast(pa.list_(pa.int32())),
                    *[pa.array(packed[:, i]) for i in range(4)],
                ], names=["id", "digest", "n", "c", "tokens", *SKETCH])

    return batches


def set_key(members: np.ndarray) -> bytes:
    """What a set is known by: 128 bits of a hash of all its shingles."""
    return xxhash.xxh3_128_digest(members.tobytes())


SKETCH = ["s0", "s1", "s2", "s3"]  # four bits of each of the first tokens
SIGMAS = 4.5  # pairs that agree in fewer tokens than linked ones do by so many deviations are out
_EVERY_FOURTH = np.uint64(0x1111111111111111)


def least_agreement(percent: int) -> int:
    """Sketched tokens whose bits agree in linked sets, less SIGMAS deviations."""
    share = percent / 100 + (1 - percent / 100) / 16
    return int(SKETCHED * share - SIGMAS * (SKETCHED * share * (1 - share)) ** 0.5)


def _agreement(x: list, y: list):
    """Tokens whose four bits agree, by columns of two sketches."""
    total = F.lit(SKETCHED)
    for a, b in zip(x, y, strict=True):
        v = a.bitwiseXOR(b)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        total = total - F.bit_count(v.bitwiseAND(F.lit(int(_EVERY_FOURTH))))
    return total


def whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by ``group``, cut between groups only."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        group = part.column("group").to_numpy()
        first = int(np.searchsorted(group, group[-1]))  # where the last group starts
        if first or held and held[-1].column("group")[-1].as_py() != group[0]:
            yield pa.Table.from_batches([*held, part.slice(0, first)])
            held = []
        held.append(part.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _by_group(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of every group, several groups at a time; all groups are bounded."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(parts):
            yield from run(table).to_batches()

    return frame.repartition("group").sortWithinPartitions("group").mapInArrow(batches, schema)


def _met(percent: int) -> Callable:
    """Rows of sets that may be linked to another set of their group, by size and sketch.  Pairs
    of one component are left out, and pairs that met in a small root of an earlier tree."""
    least = least_agreement(percent)

    def run(table: pa.Table) -> pa.Table:
        column = {k: table.column(k).to_numpy() for k in ("group", "n", "tree", "few", "open", *SKETCH)}
        group, n, tree, few = (column[k] for k in ("group", "n", "tree", "few"))
        sketch = [column[k].view(np.uint64) for k in SKETCH]
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        roots = table.column("roots").combine_chunks().flatten().to_numpy().reshape(len(n), TREES)
        hit, step, many = np.zeros(len(n), dtype=bool), 1, len(n)
        i = np.arange(many - 1)
        i = i[group[i + 1] == group[i]]
        while len(i):
            j = i + step
            like = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            like &= (label[i] != label[j]) & (column["open"][i] | column["open"][j])
            x, y = i[like], j[like]
            apart = np.zeros(len(x), dtype=np.uint8)
            for s in sketch:
                v = s[x] ^ s[y]
                v |= v >> np.uint64(1)
                v |= v >> np.uint64(2)
                apart += np.bitwise_count(v & _EVERY_FOURTH)
            near = SKETCHED - apart.astype(np.int64) >= least
            x, y = x[near], y[near]
            if len(x):
                before = np.arange(TREES) < tree[x][:, None]
                before &= (few[x][:, None] >> np.arange(TREES)) & 1 == 1
                new = ~((roots[x] == roots[y]) & before).any(axis=1)
                hit[x[new]] = hit[y[new]] = True
            step += 1
            i = i[i + step < many]
            i = i[group[i + step] == group[i]]
        return table.select(["group", "c", "n"]).filter(pa.array(hit))

    return run


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets just as all links between them do, confirmed on all members:
    pairs with ``100 * intersection >= percent * union``, none between sets joined already."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root, found = np.zeros(len(values), dtype=np.int32), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        other = np.arange(i + 1, len(sets))
        other = other[(root[other] != root[i]) & (
            100 * np.minimum(sizes[i], sizes[other]) >= percent * np.maximum(sizes[i], sizes[other]))]
        if not len(other):
            continue
        own = codes[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        if 2 * len(other) > len(sets) - i:
            shared = np.add.reduceat(mark[codes[starts[i + 1]:]], starts[i + 1:] - starts[i + 1])[other - i - 1]
        else:
            shared = np.array([mark[codes[starts[j]:starts[j] + sizes[j]]].sum() for j in other])
        mark[own] = 0
        for j in other[100 * shared >= percent * (sizes[i] + sizes[other] - shared)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((i, int(j)))
    return found


def _links(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        group, names = table.column("group").to_numpy(), table.column("c").to_pylist()
        members = [np.frombuffer(m.as_buffer(), np.uint64) for m in table.column("members")]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        a, b = [], []
        for start, end in zip(starts, [*starts[1:], len(group)], strict=True):
            for i, j in linked(members[start:end], percent) if end - start > 1 else ():
                a.append(names[start + i])
                b.append(names[start + j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _confirmed(work: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join what all links within the groups of ``work`` join.

    Sketches name the sets that may be linked at all; only those sets are made again from their
    texts, once, and travel to their groups.  A group of very many shingles is cut into parts
    that meet pairwise.
    """
    met = staged(_by_group(work, _met(percent), "group bigint, c binary, n bigint"), "met")
    ids = met.select("c").distinct().join(classes.select("c", "id"), "c")
    ids = staged(ids.select("id").distinct(), "ids")

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(t, words) for t in part.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["c", "members"])

    texts = docs.join(small(ids, ID_ROWS), "id", "left_semi").select("t")
    sets = texts.mapInArrow(made, "c binary, members binary").dropDuplicates(["c"])
    loads = met.groupBy("group").agg(F.sum("n").alias("load")).where(F.col("load") > NODE_SHINGLES)
    dealt = met.join(loads, "group", "left").withColumn(
        "parts", F.coalesce(F.ceil(F.col("load") / NODE_SHINGLES), F.lit(1)))
    part = F.pmod(F.xxhash64("c", F.lit(5)), F.col("parts"))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda other: F.when(
        F.col("parts") == 1, F.col("group")).otherwise(
        F.xxhash64("group", F.least(part, other), F.greatest(part, other))))
    meeting = dealt.select("c", F.explode(meets).alias("group")).distinct()
    together = meeting.join(sets, "c").select("group", "c", "members")
    return staged(_by_group(together, _links(percent), "a binary, b binary"), "links")


CARRIED = ["c", "label", "n", *SKETCH, "roots", "few"]


def _blocks(size):
    return F.ceil(size / NODE_LIMIT)


def _block(c):
    return F.pmod(F.xxhash64(c, F.lit(7)), _blocks(F.col("size")))


def _sized(nodes: DataFrame) -> DataFrame:
    """Rows of the nodes that hold sets of more than one component, with the node's size and the
    hash of a member of its own."""
    sizes = nodes.groupBy("node").agg(
        F.count("*").alias("size"), F.min(F.xxhash64("c")).alias("first"),
        F.min(F.xxhash64("label")).alias("lo"), F.max(F.xxhash64("label")).alias("hi"))
    return nodes.join(staged(sizes.where("lo <> hi").drop("lo", "hi"), "sizes"), "node")


def _roots(classes: DataFrame) -> DataFrame:
    """Level 0: every set in the root that its first token of each tree names.  Sets that share
    no root are left out; the others carry their roots, and which of those are small."""
    first = F.slice("tokens", 1, TREES)
    nodes = classes.select("c", F.posexplode(first).alias("tree", "token")).select(
        F.xxhash64("tree", "token").alias("node"), "c", "tree")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min(F.xxhash64("c")).alias("first"))
    at = nodes.join(staged(sizes.where("size > 1"), "sizes"), "node").groupBy("c").agg(
        F.collect_list(F.struct("node", "tree", "size", "first")).alias("at"))
    few = F.aggregate(F.filter("at", lambda a: a["size"] <= NODE_LIMIT), F.lit(0), lambda bits, a: (
        bits.bitwiseOR(F.call_function("shiftleft", F.lit(1), a["tree"]))))
    known = at.join(classes.select("c", "n", *SKETCH, first.alias("roots")), "c").withColumn("few", few)
    return known.withColumn("label", F.col("c")).select(*CARRIED, F.inline("at"))


def _small_and_diagonal(level: DataFrame) -> DataFrame:
    """What a level compares: small nodes whole, crowded ones in blocks that each hold the
    node's first member too, so that copies of one text are joined across blocks."""
    carried = [*CARRIED, "tree", F.lit(True).alias("open")]
    few = level.where(F.col("size") <= NODE_LIMIT).select(F.col("node").alias("group"), *carried)
    many = level.where(F.col("size") > NODE_LIMIT)
    block = F.xxhash64("node", _block("c"))
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), _blocks(F.col("size")) - 1),
                        lambda b: F.xxhash64("node", b))
    first = F.xxhash64("c") == F.col("first")
    groups = F.when(first, every).otherwise(F.array(block))
    return few.unionByName(many.select(F.explode(groups).alias("group"), *carried))


def _labelled(many: DataFrame, links: DataFrame) -> DataFrame:
    """Crowded nodes with labels by the links so far."""
    names = components(links).select(F.col("id").alias("c"), F.col("component").alias("found"))
    named = many.drop("label").join(names, "c", "left")
    return staged(named.withColumn("label", F.coalesce("found", "c")).drop("found"), "crowded")


def _with_density(many: DataFrame, percent: int) -> DataFrame:
    """Crowded nodes that hold several components, and whether a set is ``dense``: its mean
    similarity to the node is near that of linked sets."""
    probe = F.struct(*SKETCH)
    probes = many.where(F.pmod(F.xxhash64("c", F.lit(11)), F.col("size")) < PROBES).groupBy("node").agg(
        F.collect_list(probe).alias("probes"))
    mixed = many.groupBy("node").agg(
        F.min(F.xxhash64("label")).alias("lo"), F.max(F.xxhash64("label")).alias("hi")).where("lo <> hi")
    seen = F.aggregate("probes", F.lit(0), lambda total, p: total + _agreement(
        [F.col(s) for s in SKETCH], [p[s] for s in SKETCH])) / F.size("probes") / SKETCHED
    alike = F.coalesce((seen - 1 / 16) / (15 / 16), F.lit(0.0))
    return many.join(mixed.select("node").join(probes, "node", "left"), "node").withColumn(
        "dense", alike >= DENSE * percent / 100).drop("probes")


def _across(crowded: DataFrame) -> DataFrame:
    """Blocks of crowded nodes against each other, as far as dense sets are in them."""
    kept = crowded.join(crowded.where("dense").select("node").distinct(), "node", "left_semi")
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), _blocks(F.col("size")) - 1),
                      lambda b: b != _block("c"))
    groups = F.transform(others, lambda b: F.xxhash64(
        "node", F.least(_block("c"), b), F.greatest(_block("c"), b), F.lit(13)))
    return kept.select(F.explode(groups).alias("group"), *CARRIED, "tree", F.col("dense").alias("open"))


def _branches(crowded: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The sets that stay, in the nodes of the next level: which tokens a node branches by is
    drawn from the node, 100 / percent of them on average."""
    most, share = 100 / percent, 1 << 20
    drawn = [F.when(F.pmod(F.xxhash64("node", F.lit(k + 100)), F.lit(share)) < int((most - k) * share),
                    (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(HASHES - TREES)) + TREES).cast("int"))
             for k in range(int(np.ceil(most)))]
    at = F.array_distinct(F.array_compact(F.array(*drawn)))
    rest = crowded.where("NOT dense").withColumn("at", F.explode(at)).withColumn("tree", F.lit(TREES))
    token = F.element_at("tokens", F.col("at") + 1)
    return rest.join(classes.select("c", "tokens"), "c").select(
        F.xxhash64("node", "at", token).alias("node"), *CARRIED, "tree")


def judged(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """``id, digest, n, component, component_id`` of every row: the digest of its text, what its
    component is known by, and the smallest id in it."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = dict(docs.dtypes)["id"]
    numbers = ", ".join(f"{s} bigint" for s in SKETCH)
    rows = staged(docs.select("id", "t", text_digest(F.col("t")).alias("digest")).mapInArrow(
        _summaries(words),
        f"id {kind}, digest binary, n bigint, c binary, tokens array<int>, {numbers}"), "sets")
    usable = "n > 0 AND id IS NOT NULL"
    classes = staged(rows.where(usable).groupBy("c").agg(
        F.min(F.struct("id", "n", "tokens", *SKETCH)).alias("one")).select("c", "one.*"), "classes")
    links: list[DataFrame] = []
    level = staged(_roots(classes), "nodes")
    work, new = _small_and_diagonal(level), 0
    while True:
        links.append(_confirmed(work, docs, classes, words, percent))
        many = level.where(F.col("size") > NODE_LIMIT)
        crowded = many.count()
        if not crowded:
            break
        new += links[-1].count()
        if new >= RENEWED * crowded:
            many, new = _labelled(many, _all(links)), 0
        many = staged(_with_density(many, percent), "dense")
        level = staged(_sized(staged(_branches(many, classes, percent), "branches")), "nodes")
        work = _small_and_diagonal(level).unionByName(_across(many))
    names = components(_all(links)).select(F.col("id").alias("c"), "component")
    named = staged(classes.select("c", "id").join(names, "c", "left").withColumn(
        "component", F.coalesce("component", "c")), "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.join(least, "component").select("c", "component", "component_id")
    out = rows.select("id", "digest", "n", "c").join(known, "c", "left")
    smallest = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "digest", "n", "component", F.when(F.col("id").isNotNull(), smallest).alias("component_id"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Documents are linked if the sets of their distinct ``words``-word shingles have
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id that links
    reach, and rows with that id are kept.  Empty and null texts link with nothing, and a null
    id links with nothing.  Rows that share an id are judged each by its own text.  Empty
    tables give empty results.

    Equal sets are merged first and stand for all their copies.  Every tree deals the sets into
    nodes by one minwise token.  A node of NODE_LIMIT sets or fewer is compared exhaustively, by
    sketches first; the sets that may be linked are confirmed on all their shingles.  In a
    crowded node blocks are compared, each with one set that all blocks share; a node whose sets
    are all in one component then is done.  Otherwise sets that are about as similar to the node
    as linked sets are compared with all of it, block by block, and leave it, and the others
    branch by further tokens, 100 / percent of them on average, so that linked pairs stay
    together in about one node of every tree while others part.  It goes on until no crowded
    node is left.  Nodes are random, so a pair can part in all of them: ``missed`` gives the
    chance by the number of crowded levels.
    """
    found = judged(docs, doc_id, text, words, percent)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates; all columns as they were.

    The smallest id of a group stays.  If rows of different texts share that id, the one with
    the smallest digest of its text stays; of rows equal in id and text any one.  Rows without
    an id or without words always stay.
    """
    found = staged(judged(docs, doc_id, text, words, percent), "judged").where("n > 0 AND id IS NOT NULL")
    keepers = found.where("id = component_id").groupBy("component").agg(
        F.min("digest").alias("first"), F.count("*").alias("rows"))
    keepers = staged(keepers, "keepers")
    gone = found.join(keepers, "component").where("id <> component_id OR digest <> first")
    again = found.join(keepers.where("rows > 1"), "component").where(
        "id = component_id AND digest = first").groupBy("id", "digest").count().where("count > 1")
    return without_rows(docs, doc_id, text, gone.select("id", "digest").distinct(), again.select("id", "digest"))
