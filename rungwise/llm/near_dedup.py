"""Near-duplicate components by MinHash with sequential Bayesian verification.

1. One pass over the texts makes each document's set of word shingles, its MinHash signature and a
   128-bit digest of the set. Documents with equal sets form a class; only classes are compared.
2. Bands of the signature are bucketed. Each bucket is compared around its best connected member.
3. A pair's signatures are compared batch by batch. It is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below ``miss``.
4. Survivors are checked on the full shingle sets, and the links are joined to components.
5. Buckets whose members still lie in several components are compared in full, in blocks of
   bounded size. A block pair applies steps 3 and 4 to pairs of different components and gives out
   only links that join two of them, so a large group never turns into all its pairs.

Nothing is capped: step 5 is the exact way for large buckets. The places of a signature agree with the
chance of the similarity, and their number spreads less than with independent hashes; taking them as
independent, with 32 bands of 4 rows a pair of similarity 0.8 shares no band with probability 5e-8
(0.5904 ** 32), and step 3 drops it with about 1e-6.

Defined results: a text that is null, empty or has no word has no shingles and is linked with
nothing; its component is its own id. Rows with equal texts and ids are links of one component. A
null id takes part; it is never the component's id unless the component has no other. Only the id
and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize

WIDTH = 5
BANDS = 32
ROWS = 4
BATCH = 16
MISS = 1e-7
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 2_000
_ROUND_BITS = 12
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct word shingles of a text.

    Bytes are lower-cased and split as ASCII, so only A-Z change and only ASCII white space splits.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    taken = min(width, len(words))
    made = np.full(len(words) - taken + 1, taken, np.uint64)
    for i in range(taken):
        # A polynomial of the words' hashes.
        made = made * _MIX[0] + numbers[i : len(numbers) - taken + 1 + i]
    made = np.sort(_scramble(made))
    return made[np.append(True, made[1:] != made[:-1])]


def signature(shingles: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """One value per bin, from rounds of one hash each (fast similarity sketching).

    Each round deals all shingles over the bins by their leading bits. A bin holds the least value of
    the first round that put any shingle into it, so a set of many shingles needs one round, and one of
    few as many as fill all bins. Two sets agree in a bin with the chance of their similarity, and the
    number of agreeing bins spreads no further than that of as many independent hashes.
    """
    bits = hashes.bit_length() - 1
    if 1 << bits != hashes:
        raise ValueError("the number of hashes must be a power of two")
    down, short = np.uint64(64 - bits), np.uint64(_ROUND_BITS)
    least = np.zeros(hashes, np.uint32)
    empty = np.arange(hashes, dtype=np.uint64)
    first, rounds = 0, -(-8 * hashes // max(1, len(shingles)))
    while len(empty):
        if first == 0 and rounds == 1:
            # The numbers are hashes, and sorted.
            keys, value = shingles, short
        else:
            turns = np.arange(rounds, dtype=np.uint64)
            drawn = _scramble(np.add.outer((turns + np.uint64(first)) * _MIX[0], shingles))
            if first == 0:
                drawn[0] = shingles
            # Bin, round, then the hash as far as it fits.
            keys = (drawn >> down << down) | (drawn << np.uint64(bits) >> np.uint64(bits + _ROUND_BITS))
            keys |= (turns << np.uint64(64 - bits - _ROUND_BITS))[:, None]
            keys, value = np.sort(keys, axis=None), np.uint64(0)
        at = np.searchsorted(keys, empty << down)
        filled = at < len(keys)
        filled[filled] = keys[at[filled]] >> down == empty[filled]
        least[empty[filled].astype(np.int64)] = (keys[at[filled]] >> value).astype(np.uint32)
        empty = empty[~filled]
        first, rounds = first + rounds, min(1 << _ROUND_BITS, -(-2 * hashes // max(1, len(shingles))))
    return least


def least_matches(threshold: float, hashes: int, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """Matches that a pair needs after each batch to stay in.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m + 1,
    n - m + 1), and its mass above t is the chance of at most m successes in n + 1 trials of t.
    """
    needed = []
    for n in range(batch, hashes + 1, batch):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return needed


def survivors(left: np.ndarray, right: np.ndarray, needed: list[int], batch: int = BATCH) -> np.ndarray:
    """Positions of the signature pairs that no batch rules out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(needed):
        span = slice(k * batch, (k + 1) * batch)
        matches = matches + (left[alive, span] == right[alive, span]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _signatures(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def features(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sig) of each document row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), width)
                n.append(len(shingles))
                if len(shingles):
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    sigs.append(signature(shingles, hashes).tobytes())
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sig"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        make, f"doc_id {id_type}, text_key bigint, n_shingles bigint, set_key binary, sig binary"
    )


def band_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit number per signature and band; equal bands of two signatures have equal numbers."""
    parts = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = _scramble(key * _MIX[0] + parts[:, :, i])
    return key.view(np.int64)


def _band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_signatures(batch.column("sig"), bands * rows), bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("cid").to_numpy(), bands))],
                names=["bucket", "cid"],
            )

    return classes.select("cid", "sig").mapInArrow(make, "bucket bigint, cid bigint")


def _sift(pairs: DataFrame, classes: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """The pairs (a, b) whose signatures survive."""
    needed = least_matches(threshold, hashes)
    sigs = classes.select("cid", "sig")
    with_sigs = (
        pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
    )

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = survivors(_signatures(batch.column("sig_a"), hashes), _signatures(batch.column("sig_b"), hashes), needed)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return with_sigs.mapInArrow(sift, "a bigint, b bigint")


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    if len(left) > len(right):
        left, right = right, left
    # The common part is at most the smaller set.
    if 100 * len(left) < percent * len(right):
        return False
    at = np.searchsorted(right, left)
    common = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return 100 * common >= percent * (len(left) + len(right) - common)


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text) of the classes in ``wanted``, from one row of each."""
    found = materialize(wanted.join(classes.select("cid", "loc"), "cid"), "near-wanted")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    located = keyed["doc_id"].eqNullSafe(found["loc"]["doc_id"]) & (keyed["text_key"] == found["loc"]["text_key"])
    return materialize(keyed.join(found.hint("merge"), located).select("cid", "text"), "near-texts")


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are similar on the full sets."""
    both = (
        pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}

        def known(cid: int, text: pa.Scalar) -> np.ndarray:
            if cid not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[cid] = shingle_set(text.as_py(), width)
            return recent[cid]

        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"))
            good = [i for i, (a, b, text_a, text_b) in enumerate(rows) if similar(known(a, text_a), known(b, text_b), percent)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return materialize(both.mapInArrow(check, "a bigint, b bigint").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every end of a link (a, b); ``comp`` is the least id reachable.

    Alternates between joining larger neighbours to the least one and joining all smaller ones to
    it, until every node hangs on its component's least id. Each pass is a grouped minimum and
    one join; rounds grow with the logarithm of the longest chain, and each is stored.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near-least")
        # Larger neighbours of a node hang on the least of its neighbourhood.
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "near-large")
        floor = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "near-floor")
        # All smaller neighbours of a node, and the node itself, hang on the least of them.
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        small = materialize(small, "near-small")
        changed = not small.exceptAll(edges).isEmpty() or not edges.exceptAll(small).isEmpty()
        edges = small
        if not changed:
            break
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("comp")).union(edges.select(F.col("b"), F.col("b")).distinct())


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, comp) of every class."""
    comps = components(links)
    return classes.select("cid").join(comps, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"))


def _joining(ids: np.ndarray, comps: np.ndarray, pairs: Iterator[tuple[int, int]], linked) -> list[tuple[int, int]]:
    """Of the pairs of positions, those that are linked and join two components not joined before."""
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    made = []
    for x, y in pairs:
        one, two = root(int(comps[x])), root(int(comps[y]))
        if one != two and linked(x, y):
            parent[two] = one
            made.append((int(ids[x]), int(ids[y])))
    return made


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group as one batch, from rows sorted by group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.concat_batches(held)


def _rest(
    members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, bands: int, rows: int, block: int
) -> DataFrame:
    """Links (a, b) that join the components which meet in a bucket.

    A bucket is cut into blocks of bounded members and shingles, and each pair of blocks is one
    group. A pair of classes is compared only in the bucket of the first band they share. Groups are
    first compared by signatures alone; only members with a surviving partner get their texts.
    """
    hashes = bands * rows
    needed = least_matches(percent / 100, hashes)
    placed = materialize(
        members.join(labels, "cid").join(classes.select("cid", "n_shingles"), "cid").select("bucket", "cid", "comp", "n_shingles"),
        "near-placed",
    )
    mixed = materialize(
        placed.groupBy("bucket")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"))
        .filter("low < high")
        .select("bucket", F.ceil(F.greatest(F.col("n") / block, F.col("all") / (block * BLOCK_SHINGLES))).alias("blocks")),
        "near-mixed",
    )
    tiles = (
        placed.join(mixed, "bucket")
        .select("bucket", "cid", "comp", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("own"))
        .select("bucket", "cid", "comp", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "comp")
    )

    def candidates(comps, own, sigs, bucket: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Positions of pairs of different components that survive and share no earlier band."""
        keys = band_keys(sigs, bands)
        for x in np.flatnonzero(own == i):
            others = np.flatnonzero((comps != comps[x]) & (own == j))
            if i == j:
                others = others[others > x]
            if len(others):
                shared = keys[others] == keys[x]
                others = others[keys[x][shared.argmax(axis=1)] == bucket]
                for y in others[survivors(np.broadcast_to(sigs[x], (len(others), hashes)), sigs[others], needed)]:
                    yield int(x), int(y)

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each group that have a candidate. Rows come sorted by group."""
        for group in _groups(batches, ["bucket", "i", "j"]):
            bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            comps, own = np.asarray(group.column("comp")), np.asarray(group.column("own"))
            if (comps != comps[0]).any():
                found = {p for pair in candidates(comps, own, _signatures(group.column("sig"), hashes), bucket, i, j) for p in pair}
                if found:
                    yield group.drop_columns("sig").take(pa.array(sorted(found), pa.int64()))

    def compare(key, group):
        import pandas as pd

        bucket, i, j = (int(k) for k in key)
        # Repeated rows of one document can give its text twice.
        group = group.drop_duplicates("cid").sort_values("cid", ignore_index=True)
        ids, comps, own = (group[c].to_numpy() for c in ("cid", "comp", "own"))
        sigs = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, hashes)
        sets: dict[int, np.ndarray] = {}

        def known(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(group["text"].iloc[x], width)
            return sets[x]

        pairs = candidates(comps, own, sigs, bucket, i, j)
        made = _joining(ids, comps, pairs, lambda x, y: similar(known(x), known(y), percent))
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")

    sigs = classes.select("cid", "sig")
    held = "bucket bigint, i bigint, j bigint, own bigint, cid bigint, comp bigint"
    sorted_tiles = tiles.join(sigs, "cid").select("bucket", "i", "j", "own", "cid", "comp", "sig").repartition("bucket", "i", "j")
    found = materialize(sorted_tiles.sortWithinPartitions("bucket", "i", "j", "cid").mapInArrow(promising, held), "near-promising")
    return materialize(
        found.join(sigs, "cid")
        .join(texts, "cid")
        .groupBy("bucket", "i", "j")
        .applyInPandas(compare, "a bigint, b bigint")
        .distinct(),
        "near-rest",
    )


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK_MEMBERS,
) -> DataFrame:
    """One row per document row: doc_id, text_key, n_shingles, component_id, kept, component_key.

    Documents are linked when 100 * common >= ``percent`` * all shingles of both sets.
    ``component_id`` is the smallest id of the component, and ``kept`` marks the document with it.
    ``component_key`` names the component whatever the ids (null without shingles).
    """
    threshold, hashes = percent / 100, bands * rows
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(features(docs, width, hashes), "near-features")
    classes = materialize(
        found.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "text_key")).alias("loc"),
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("sig").alias("sig"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "near-classes",
    )
    banded = _band_rows(classes, bands, rows)
    buckets = materialize(
        banded.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("low"), F.max("cid").alias("high"))
        .filter("n > 1 and low < high"),
        "near-buckets",
    )
    members = materialize(banded.join(buckets.filter("n > 2").select("bucket", "n"), "bucket"), "near-members")
    met = materialize(members.groupBy("cid").agg(F.sum("n").alias("met")), "near-met")
    pivots = materialize(
        members.join(met, "cid").groupBy("bucket").agg(F.max(F.struct("met", "cid"))["cid"].alias("pivot")), "near-pivots"
    )
    stars = members.join(pivots, "bucket").filter("cid <> pivot")
    pairs = (
        stars.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
        .union(buckets.filter("n = 2").select("low", "high"))
        .distinct()
    )
    first = materialize(_sift(pairs, classes, threshold, hashes), "near-first")
    wanted = first.select(F.col("a").alias("cid")).union(first.select("b")).union(met.select("cid")).distinct()
    texts = _texts(wanted, classes, docs)
    links = _links(first, texts, width, percent)
    labels = materialize(_labels(classes, links), "near-labels")
    more = _rest(members.drop("n"), labels, classes, texts, width, percent, bands, rows, block)
    if not more.isEmpty():
        labels = materialize(_labels(classes, links.union(more)), "near-labels")
    named = classes.join(labels, "cid").select("set_key", "comp", "least_id")
    least = materialize(named.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min("set_key").alias("component_key")), "near-least-id")
    by_set = materialize(named.join(least, "comp").select("set_key", "component_id", "component_key"), "near-by-set")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.drop("sig").join(by_set, "set_key", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "component_key",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component left, all columns as they came."""
    named = near_components(docs, id_col, text_col, **options)
    # Ids may repeat, so one (id, text) is chosen in each component; texts without shingles are alone.
    alone = named.filter("component_key is null").select("doc_id", "text_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")
    chosen = named.filter("component_key is not null").groupBy("component_key").agg(least, F.count_if("kept").alias("n_kept"))
    one = chosen.select("least.doc_id", "least.text_key", "n_kept")
    once = materialize(alone.withColumn("n_kept", F.lit(1).cast("bigint")).union(one), "near-kept")
    repeated = not once.filter("n_kept > 1").isEmpty() or not once.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    once = once.select("doc_id", "text_key").distinct()
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_key"),
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )
    left = rows.join(once.hint("merge"), rows["_id"].eqNullSafe(once["doc_id"]) & (rows["_key"] == once["text_key"]), "left_semi")
    if repeated:
        # Rows that repeat the least id of their component: any one of them stays.
        left = left.groupBy("_id", "_key").agg(F.any_value("_row").alias("_row"))
    return left.select("_row.*")
