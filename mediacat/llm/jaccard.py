"""Similarity join of job logs on their word shingles, and the groups that its links make."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm import blocks as B
from mediacat.llm.links import components
from mediacat.llm.shared import shared_folder, written
from mediacat.llm.words import LOWER, Words, mix, spans

WIDTH = 5
PERCENT = 75
EXTRA_PERCENT = 15
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 128
BATCH_BYTES = 1 << 20
TILE = 512
COLUMNS = 2048
SEEDS = (0x1B873593, 0xCC9E2D51, 0x85EBCA6B, 0x27D4EB2F)

ENTRIES = "bucket int, ids binary, owners binary, keys binary, facts binary"
COUNTS = "job_id bigint, shared bigint, n bigint, digest binary"
SETS = "job_id bigint, n bigint, u bigint, keys array<bigint>, m0 bigint, m1 bigint, m2 bigint, m3 bigint"


def least_overlap(n):
    """Shingles that a set of n has in common with any set it links to, at least."""
    return -(-PERCENT * n // 100)


def extra(n):
    return np.maximum(1, -(-EXTRA_PERCENT * n // 100))


def incidence(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The incidence rows of a batch: owner and key of each distinct shingle, by owner and key; set sizes.

    A shingle is five words in a row, A-Z in lower case; a shorter text is one shingle, one without words
    none.
    """
    w = Words(texts, LOWER)
    h = w.hashes()
    at, keys = w.windows(h, WIDTH)
    few = np.flatnonzero((w.counts > 0) & (w.counts < WIDTH))
    owners = np.concatenate([w.text[at], few])
    keys = np.concatenate([keys, spans(h, w.first[few], w.first[few + 1], 1)])
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    owners, keys = owners[new], keys[new]
    return owners, keys, np.bincount(owners, minlength=len(texts))


def _column_blocks(buckets: int):
    """Incidence columns of each batch, cut into blocks by key, prefixes only."""
    limit = BATCH_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, 1, limit):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                owners, keys, n = incidence(part.column(1).to_pylist())
                first = np.cumsum(n) - n
                rank = np.arange(len(keys)) - first[owners]
                prefix = rank < (n - least_overlap(n) + extra(n))[owners]
                digests = [hashlib.blake2b(keys[f : f + k].tobytes(), digest_size=16).digest() for f, k in zip(first, n)]
                own, key = owners[prefix], keys[prefix]
                order = np.argsort(key, kind="stable")
                own, key = own[order], key[order]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                lone = head.copy()
                lone[:-1] &= head[1:]
                shared = np.bincount(own[~lone], minlength=len(n))
                facts = np.zeros(len(n), [("shared", "<i8"), ("n", "<i8"), ("digest", "V16")])
                facts["shared"], facts["n"], facts["digest"] = shared, n, np.array(digests, "V16")
                # Of equal columns in a batch one row goes on: a shingle that everybody has is a few entries.
                own, key, lone = own[head], key[head], lone[head]
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                own = (own * 2 + lone)[order].astype("<u4")
                key = key[order].astype("<u8")
                rows = [(int(ids[0] if len(ids) else 0) % buckets, ids.tobytes(), b"", b"", facts.tobytes())]
                for b, (start, end) in enumerate(zip(ends - np.bincount(bucket, minlength=buckets), ends)):
                    if end > start:
                        used, local = np.unique(own[start:end] >> 1, return_inverse=True)
                        mark = (local * 2 + (own[start:end] & 1)).astype("<u4")
                        rows.append((b, ids[used].tobytes(), mark.tobytes(), key[start:end].tobytes(), b""))
                for at in range(0, len(rows), 32):
                    columns = list(zip(*rows[at : at + 32]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                        names=["bucket", "ids", "owners", "keys", "facts"],
                    )

    return cut


def _count_shared(table: pa.Table) -> pa.Table:
    """Of a block of columns: how many of each log's keys other batches have too; facts pass through."""
    ids, owners, keys, n, size = [], [], [], 0, []
    out: list[tuple[np.ndarray, np.ndarray, list, list]] = []
    for i, o, k, f in zip(*[table.column(c).to_pylist() for c in ("ids", "owners", "keys", "facts")]):
        own = np.frombuffer(i, np.int64)
        if f:
            facts = np.frombuffer(f, [("shared", "<i8"), ("n", "<i8"), ("digest", "V16")])
            out.append((own, facts["shared"], facts["n"].tolist(), [bytes(d) for d in facts["digest"]]))
            continue
        owners.append(np.frombuffer(o, "<u4").astype(np.int64) + 2 * n)
        keys.append(np.frombuffer(k, "<u8"))
        ids.append(own)
        n += len(own)
    if ids:
        own, key, name = np.concatenate(owners), np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        counts = np.bincount(own[again & (own % 2 == 1)] >> 1, minlength=n)
        hit = np.flatnonzero(counts)
        out.append((name[hit], counts[hit], [None] * len(hit), [None] * len(hit)))
    return pa.table(
        [
            pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
            pa.array([x for o in out for x in o[2]], pa.int64()), pa.array([x for o in out for x in o[3]], pa.binary()),
        ],
        names=["job_id", "shared", "n", "digest"],
    )


def _keys_of(blocks: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in blocks:
        for i in range(len(batch)):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            yield row, *incidence(B.texts_of(row["sizes"], row["body"]))


def _shared_sets(candidates: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Of each candidate the keys that others have too, where they are enough for a link: job_id, n, u
    (how many), keys, and the smallest key under four hash orders."""
    blocks = B.in_blocks(candidates, folder, "job_id", "log")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, owners, keys, _ in _keys_of(batches):
            yield from B.entries(row["block"], B.Distinct(keys, owners), buckets)

    told = B.ask(blocks.mapInArrow(ask, B.ENTRIES), B.held_elsewhere, folder, "columns")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, owners, keys, n in _keys_of(batches):
            distinct = B.Distinct(keys, owners)
            (elsewhere,) = B.answers_for(distinct, row["answers"], buckets)
            shared = (elsewhere | (distinct.low != distinct.high))[distinct.back]
            u = np.bincount(owners[shared], minlength=len(n))
            enough = (u >= least_overlap(n)) & (n > 0)
            shared &= enough[owners]
            keys, u, n = keys[shared], u[enough], n[enough]
            offsets = np.concatenate([[0], np.cumsum(u)])
            least = []
            for seed in SEEDS:
                order = mix(keys ^ np.uint64(seed)).view(np.int64)
                least.append(np.minimum.reduceat(order, offsets[:-1]) if len(u) else order)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))
            ids = np.array(row["ids"], np.int64)[enough]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(n.astype(np.int64)), pa.array(u.astype(np.int64)), lists, *[pa.array(m) for m in least]],
                names=["job_id", "n", "u", "keys", "m0", "m1", "m2", "m3"],
            )

    return written(blocks.join(told, "block", "left").mapInArrow(keep, SETS), folder, "sets")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = lists.flatten().to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), values


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The incidence product for a block of pairs: overlap counts from one sort of both sides' columns."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            (pa_, ka), (pb, kb) = _flat(part.column(2)), _flat(part.column(3))
            pair, key = np.concatenate([pa_, pb]), np.concatenate([ka, kb])
            order = np.lexsort((key, pair))
            pair, key = pair[order], key[order]
            both = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1])
            overlap = np.bincount(pair[1:][both], minlength=len(part))
            na, nb = part.column(4).to_numpy(), part.column(5).to_numpy()
            linked = 100 * overlap >= PERCENT * (na + nb - overlap)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], names=["a", "b"]
            )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by their exact overlap."""
    own = sets.select("job_id", "n", "keys")
    return (
        pairs.join(own.withColumnsRenamed({"job_id": "a", "n": "na", "keys": "ka"}), "a")
        .join(own.withColumnsRenamed({"job_id": "b", "n": "nb", "keys": "kb"}), "b")
        .select("a", "b", "ka", "kb", "na", "nb").mapInArrow(_overlaps, "a bigint, b bigint")
    )


def _may_link(n: str, u: str, m: str, w: str) -> Column:
    """Whether sets of sizes n and m, with u and w keys that others have, can link: the overlap is at most
    the smaller of u and w."""
    return F.least(F.col(u), F.col(w)) * (100 + PERCENT) >= (F.col(n) + F.col(m)) * PERCENT


def _rarest(sets: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """key, job_id, n, u, g (its group so far), short: of each set the rarest keys, of which any link needs one.

    A set's keys in order of frequency, rarest first: two sets that link share one of the first
    n - least overlap + 1 of each. Keys that no other set has come before those listed. With a set of its own
    size or more a set has more in common, so there its first few will do: those are `short`.
    """
    entries = sets.select("job_id", "n", "u", F.explode("keys").alias("key"))
    frequency = entries.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        entries.join(frequency, "key").groupBy("job_id", "n", "u")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    )
    length = F.col("u") - F.ceil(F.col("n") * PERCENT / 100) + 1
    few = F.col("u") - F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT))
    rows = (
        ordered.select("job_id", "n", "u", F.posexplode(F.slice("keys", F.lit(1), length.cast("int"))).alias("at", "k"))
        .join(groups, F.col("job_id") == F.col("node"), "left")
        .select("k.key", "job_id", "n", "u", F.coalesce("component", "job_id").alias("g"), (F.col("at") <= few).alias("short"))
    )
    return written(rows, folder, "rarest")


def _linked(owner: np.ndarray, keys: np.ndarray, n: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The incidence product of the sets `rows` and the sets `columns`: where the overlap is enough for a link.

    Only keys that both sides have are looked at, in blocks of columns; overlap counts add up over the
    blocks, and pairs below what their sizes require are discarded.
    """
    number = np.full((2, len(n)), -1)
    number[0, rows], number[1, columns] = np.arange(len(rows)), np.arange(len(columns))
    common = np.intersect1d(keys[number[0, owner] >= 0], keys[number[1, owner] >= 0])
    place = np.searchsorted(common, keys)
    place[place == len(common)] = 0
    used = common[place] == keys if len(common) else np.zeros(len(keys), bool)
    owner, place = owner[used], place[used]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    overlap = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, len(common), COLUMNS):
        low, high = np.searchsorted(place, (at, at + COLUMNS))
        parts = []
        for side in (0, 1):
            mine = number[side, owner[low:high]]
            part = np.zeros((overlap.shape[side], COLUMNS), np.float32)
            part[mine[mine >= 0], place[low:high][mine >= 0] - at] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    return overlap.astype(np.int64) * (100 + PERCENT) >= PERCENT * (n[rows][:, None] + n[columns][None, :])


def _tile_product(table: pa.Table) -> pa.Table:
    """Links between a tile's rows (side 0) and columns (side 1)."""
    side = table.column("side").to_numpy()
    ids, n = table.column("job_id").to_numpy(), table.column("n").to_numpy()
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    r, c = np.nonzero(_linked(*_flat(table.column("keys").combine_chunks()), n, rows, columns))
    return pa.table([pa.array(ids[rows[r]]), pa.array(ids[columns[c]])], names=["a", "b"])


def _any_of_one_id(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same id as one: the rows, and where each id is first."""
    _, first, back = np.unique(ids, return_index=True, return_inverse=True)
    if len(first) == len(ids):
        return linked[first], first
    one = np.zeros((len(first), linked.shape[1]), bool)
    np.logical_or.at(one, back, linked)
    return one, first


def _tile_counts(table: pa.Table) -> pa.Table:
    """Of a tile of one group, how many logs each set's own links lead to. A tile without columns is a slice of the
    group against itself."""
    side = table.column("side").to_numpy()
    ids, n, copies = [table.column(c).to_numpy() for c in ("job_id", "n", "copies")]
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    itself = not len(columns)
    columns = rows if itself else columns
    linked = _linked(*_flat(table.column("keys").combine_chunks()), n, rows, columns)
    linked, r = _any_of_one_id(linked, ids[rows])
    linked, c = _any_of_one_id(linked.T, ids[columns])
    linked, rows, columns = linked.T, rows[r], columns[c]
    if itself:
        linked[np.arange(len(rows)), np.arange(len(rows))] = False
    name, count = ids[rows], linked @ copies[columns]
    if not itself:
        name, count = np.concatenate([name, ids[columns]]), np.concatenate([count, linked.T @ copies[rows]])
    return pa.table([pa.array(name[count > 0]), pa.array(count[count > 0])], names=["job_id", "links"])


def _counts_within(sets: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """job_id, links: how many logs each set links to among the sets of its own group.

    A group is cut into slices of about TILE sets; each two slices meet in a tile, and a tile gives a row a
    set at most, so no pairs are formed.
    """
    shape = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("slices"))
    members = sets.join(groups, F.col("job_id") == F.col("node")).join(shape, "component")
    copies = classes.select(F.col("first").alias("job_id"), "copies")
    own = F.pmod(F.xxhash64("job_id"), F.col("slices")).cast("int")
    rows = members.join(copies, "job_id").select(
        "component", "job_id", "n", "copies", "keys", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    )
    rows = rows.select(
        "component", "job_id", "n", "copies", "keys", F.least("own", "other").alias("d"), F.greatest("own", "other").alias("a"),
        (F.col("other") < F.col("own")).cast("int").alias("side"),
    )
    return rows.groupBy("component", "d", "a").applyInArrow(_tile_counts, "job_id bigint, links bigint")


def _counts_between(links: DataFrame, classes: DataFrame) -> DataFrame:
    """job_id, links: how many logs each set links to by `links` (a, b)."""
    pairs = links.distinct()
    ways = pairs.select(F.col("a").alias("job_id"), F.col("b").alias("first")).union(pairs.select("b", "a"))
    return ways.join(classes.select("first", "copies"), "first").groupBy("job_id").agg(F.sum("copies").alias("links"))


def _links_between(sets: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """Links of different groups (a, b): every set of a smaller group against those of a larger one that
    has one of its rarest keys.

    No pairs are formed: a group's sets and all sets asked against it meet in tiles of TILE by TILE, and
    only links come out of a tile.
    """
    rarest = _rarest(sets, groups, folder)
    placed = sets.join(groups, F.col("job_id") == F.col("node"), "left").select(
        "job_id", "n", "u", "keys", F.coalesce("component", "job_id").alias("g")
    )
    size = placed.groupBy("g").agg(
        F.count(F.lit(1)).alias("members"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("u").alias("most_u")
    )
    mixed = rarest.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key")
    x = rarest.join(mixed, "key").join(size, "g")
    large = x.groupBy("key", F.col("g").alias("into")).agg(
        F.max("members").alias("many"), F.max("least_n").alias("into_n"), F.max("most_n").alias("into_most"),
        F.max("most_u").alias("into_u"), F.max("short").alias("into_short"),
    )
    smaller = F.struct("members", "g") < F.struct("many", F.col("into").alias("g"))
    near = (F.col("short") & (F.col("n") <= F.col("into_most"))) | (F.col("into_short") & (F.col("n") >= F.col("into_n")))
    asked = (
        x.join(large, "key").where(smaller & near & _may_link("n", "u", "into_n", "into_u"))
        .select("job_id", "into", "many").distinct()
    )
    asked = written(asked, folder, "asked")
    shape = asked.groupBy("into").agg(
        F.ceil(F.max("many") / TILE).cast("int").alias("down"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("across")
    )

    def spread(sides: int, own: str, other: str) -> list[Column]:
        mine = F.pmod(F.xxhash64("job_id"), F.col(own)).cast("int").alias(own[0])
        return [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]), F.lit(sides).alias("side")]

    rows = placed.join(shape, F.col("g") == F.col("into")).select("into", "job_id", "n", "keys", *spread(0, "down", "across"))
    columns = asked.select("job_id", "into").join(shape, "into").join(placed.drop("g"), "job_id")
    columns = columns.select("into", "job_id", "n", "keys", *spread(1, "across", "down"))
    tiles = rows.unionByName(columns).groupBy("into", "d", "a")
    return tiles.applyInArrow(_tile_product, "a bigint, b bigint")


def link_logs(logs: DataFrame, job_id: str = "job_id", log: str = "log", counts: bool = False) -> DataFrame:
    """Job logs with a shingle similarity of 0.75 or more, as groups: job_id, n_shingles, component_id.

    The document by shingle incidence matrix is multiplied with its transpose in blocks, but only where
    sizes allow a link. (1) Columns, cut into blocks by key: only the first keys of each log, in hash
    order, that no linked log can miss (n - least overlap, and EXTRA_PERCENT more), are looked at; a log
    that has fewer of them in common with all others together than any link needs is done. (2) Logs
    with the same set are one row of the matrix, and of a row only the keys that another row has
    matter: rows with fewer than a link needs are done too. (3) Rows that share a smallest key under
    one of four hash orders are multiplied with the one of them that has most in common with others:
    the large groups fall together without their pairs being formed. (4) What may still link two
    different groups shares one of its rarest keys: there the smaller group's rows are multiplied
    with the larger group, tile by tile. Every link is counted exactly (64-bit keys stand for shingles);
    component_id is the smallest job id that links lead to.

    With `counts` there is also n_links, the number of logs that a log links to itself, copies included: (5) the
    rows of a group of step 3 are multiplied with each other tile by tile, and only the counts leave a tile.

    NULL, empty and blank logs have no shingles and no links. Rows with the same job id give one row and
    link as any of them does. No rows give no rows; other columns are not looked at.
    """
    spark = logs.sparkSession
    folder = shared_folder(spark)
    logs = logs.select(F.col(job_id).cast("bigint").alias("job_id"), F.col(log).alias("log")).where(F.col("job_id").isNotNull())
    size = logs.agg(F.sum(F.octet_length("log")).alias("bytes")).first()["bytes"] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    counted = written(
        logs.mapInArrow(_column_blocks(buckets), ENTRIES).groupBy("bucket").applyInArrow(_count_shared, COUNTS), folder, "counts"
    )
    every = written(
        counted.groupBy("job_id").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"), F.max("digest").alias("digest")),
        folder, "logs",
    )
    some = every.where("n > 0")
    classes = written(some.groupBy("n", "digest").agg(
        F.min("job_id").alias("first"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("copies")
    ), folder, "classes")
    other = -(-F.col("n") * PERCENT / 100)
    needed = F.greatest(F.lit(1), F.ceil(F.ceil(other) * EXTRA_PERCENT / 100))
    rows = classes.where(F.col("shared") >= needed).select(F.col("first").alias("job_id"))
    sets = _shared_sets(logs.join(rows, "job_id"), folder, buckets)

    stars = None
    rank = F.struct((F.col("u") / F.col("n")).alias("share"), "u", (-F.col("job_id")).alias("neg"), "job_id", "n")
    for m in ("m0", "m1", "m2", "m3"):
        centres = sets.groupBy(m).agg(F.max(rank).alias("c")).select(
            m, F.col("c.job_id").alias("a"), F.col("c.n").alias("na"), F.col("c.u").alias("ua")
        )
        star = sets.select(m, F.col("job_id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub")).join(centres, m)
        star = star.where((F.col("a") != F.col("b")) & _may_link("na", "ua", "nb", "ub")).select("a", "b")
        stars = star if stars is None else stars.union(star)
    links = written(_verified(stars.distinct(), sets), folder, "stars")
    groups = components(links, folder, "star-groups")
    more = written(_links_between(sets, groups, folder), folder, "rest")
    final = components(links.union(more), folder, "groups")

    named = classes.join(final, classes["first"] == final["node"], "left").select(
        "first", "n", "digest", "copies", F.coalesce("component", "first").alias("component_id")
    )
    found = ["job_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "job_id").alias("component_id")]
    if counts:
        each = _counts_within(sets, groups, classes).unionByName(_counts_between(more, classes))
        each = each.groupBy(F.col("job_id").alias("first")).agg(F.sum("links").alias("links"))
        named = named.join(each, "first", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        found.append(F.coalesce("links", F.lit(0)).alias("n_links"))
    return every.join(named, ["n", "digest"], "left").select(*found)
