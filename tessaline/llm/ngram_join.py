"""N-gram Jaccard join with set-relation skipping.

Two documents link when the sets of their word n-grams have a Jaccard similarity of `percent` / 100 or
more. Equal sets are one set from the start. The rest is prefix-filtered: in one order of all n-grams,
rare ones first, two similar sets share an n-gram of both their prefixes. The order is by the number of
sets that hold an n-gram (its power of two), counted over all documents, then by fingerprint; so a
passage that many documents share stands last and hardly ever is in a prefix, and a set whose prefix
holds only n-grams of its own needs no candidate at all.

Set relations save the rest of the work:

* Index level. The list of an n-gram is cut in blocks of sets of one size that hold it at one place of
  their order. Size and place bound the overlap of a whole block with another set, so blocks are
  skipped together.
* Answer level. For each list one leader, the set nearest to all others (its n-grams are the most
  common ones), is compared with the whole list. Answers of its followers, the sets that link with it, are
  derived from its own: two followers are already in one class, and the overlap of a follower f with any set r
  that the leader L met is that of L and r, less the n-grams of L that f lacks and r has, plus those that f has beyond
  L and r has too. Only these two short lists are looked up in r; the follower's set does not travel again. Without
  any lookup, overlaps and the Jaccard distance, a metric, rule out pairs that cannot link.

Only pairs without such an answer, between different classes and within all bounds, are compared by
whole sets. No list, class or bucket is capped.

Scale: n-grams go to buckets as 32 bits each, packed by block of texts, and a few bits come back;
full sets travel only for sets that share a prefix n-gram. A set is known by 128 bits, an n-gram by 64.

Defined cases: null, empty and white-space texts have the empty set and link with nothing, their class
is their own doc_id; texts of fewer than n words have one n-gram, the whole sequence; repeated rows
are one class; a class without any doc_id has a null class; texts are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.llm.blocks import BLOCK_ROWS, blocks, bucket_count, deal, over, unzip_bytes, with_answers, zip_bytes
from tessaline.operators.components import connected_components
from tessaline.session import written

U64 = np.uint64
#: Blocks of an index list are cut further by the set's id, so that equal copies don't gather in one row.
LIST_SALT = 32


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, n-grams, borders) for some texts at a time: sorted distinct n-grams of each text."""
    for a, b, w in K.of_array(texts, fold=K.LOWER):
        prints = w.fingerprints()
        starts = K.window_starts(w.first, n)
        grams = K.window_fingerprints(prints, n)[starts[: max(0, len(starts) - n + 1)]]
        owner = w.text_of_word()[starts]
        short = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
        if len(short):
            whole = [K.window_fingerprints(prints[w.first[i] : w.first[i + 1]], int(w.first[i + 1] - w.first[i])) for i in short]
            grams, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield a, grams, np.searchsorted(owner, np.arange(b - a + 1))


def _base(block_id: int, rows: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    sizes, keys = [], ([], [])
    for _, grams, borders in sets_of(rows.column("text"), n):
        sizes.append(np.diff(borders))
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            total = np.concatenate(([U64(0)], np.cumsum(K.mix(grams ^ U64(salt)))))
            keys[k].append(total[borders[1:]] - total[borders[:-1]])
    size = np.concatenate(sizes)
    empty = size == 0
    yield pa.RecordBatch.from_pydict({
        "doc_id": rows.column("doc_id").combine_chunks(),
        "n_shingles": pa.array(size, pa.int64()),
        "k1": pa.array(np.concatenate(keys[0]).view(np.int64), mask=empty),
        "k2": pa.array(np.concatenate(keys[1]).view(np.int64), mask=empty),
        "uid": pa.array(block_id * BLOCK_ROWS + np.arange(len(size)), pa.int64()),
    })


def _planes(values: np.ndarray) -> bytes:
    return zip_bytes(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unplanes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(unzip_bytes(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _dealt(rows: pa.Table, chosen: np.ndarray, n: int, buckets: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen sets, and their distinct n-grams with how many of the sets hold each, dealt to buckets."""
    sets = []
    for a, grams, borders in sets_of(rows.column("text"), n):
        for i in np.flatnonzero(chosen[a : a + len(borders) - 1]):
            if borders[i + 1] > borders[i]:
                sets.append((a + int(i), grams[borders[i] : borders[i + 1]]))
    distinct, held = np.unique(np.concatenate([g for _, g in sets]) if sets else np.zeros(0, U64), return_counts=True)
    order, used, borders = deal(distinct, buckets)
    return sets, distinct, held, order, np.stack([used, borders[:-1], borders[1:]], axis=1) if len(used) else np.zeros((0, 3), np.int64)


def _chosen(rows: pa.Table, places: pa.Table) -> np.ndarray:
    chosen = np.zeros(rows.num_rows, dtype=bool)
    for x in places.to_pylist():
        chosen[np.frombuffer(x, dtype="<i4")] = True
    return chosen


def _send(block_id: int, rows: pa.Table, answers: pa.Table, n: int, buckets: int) -> pa.Table:
    _, distinct, held, order, parts = _dealt(rows, _chosen(rows, answers.column("bits")), n, buckets)
    out: dict[str, list] = {"bucket": [], "block_id": [], "grams": [], "held": []}
    for bucket, a, b in parts.tolist():
        mine = order[a:b]
        out["bucket"].append(bucket)
        out["block_id"].append(block_id)
        out["grams"].append(_planes((distinct[mine] // U64(buckets)) & U64(0xFFFFFFFF)))
        out["held"].append(zip_bytes(np.minimum(held[mine], 65535).astype("<u2").view(np.uint8)))
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("grams", pa.binary()), ("held", pa.binary())]))


def _count(rows: pa.Table) -> pa.Table:
    grams = [_unplanes(x.as_py()) for x in rows.column("grams")]
    held = np.concatenate([np.frombuffer(unzip_bytes(x.as_py()), dtype="<u2") for x in rows.column("held")]).astype(np.float64)
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    level = np.log2(np.bincount(inverse, weights=held)).astype(np.uint8)[inverse]
    bits, at = [], 0
    for g in grams:
        bits.append(zip_bytes(level[at : at + len(g)]))
        at += len(g)
    # level 0: one set only
    return pa.table({"block_id": rows.column("block_id"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})


ACTIVE = "uid long, n int, hub double, grams binary, post_gram array<long>, post_place array<int>"


def _activate(block_id: int, rows: pa.Table, answers: pa.Table, n: int, buckets: int, percent: int) -> pa.Table:
    by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
    chosen = np.zeros(rows.num_rows, dtype=bool)
    if -1 in by_bucket:
        chosen[np.frombuffer(by_bucket[-1], dtype="<i4")] = True
    sets, distinct, _, order, parts = _dealt(rows, chosen, n, buckets)
    level = np.zeros(len(distinct), dtype=np.uint8)
    for bucket, a, b in parts.tolist():
        level[order[a:b]] = np.frombuffer(unzip_bytes(by_bucket[bucket]), dtype=np.uint8)
    out: dict[str, list] = {k: [] for k in ("uid", "n", "hub", "grams", "post_gram", "post_place")}
    for place, grams in sets:
        mine = level[np.searchsorted(distinct, grams)]
        size = len(grams)
        prefix = size - -(-percent * size // 100) + 1
        if (mine == 0).sum() >= prefix:
            continue
        by_rank = np.lexsort((grams, mine))[:prefix]
        shared = np.flatnonzero(mine[by_rank] > 0)
        out["uid"].append(block_id * BLOCK_ROWS + place)
        out["n"].append(size)
        out["hub"].append(float(mine.mean()))
        out["grams"].append(grams.tobytes())
        out["post_gram"].append(grams[by_rank[shared]].view(np.int64))
        out["post_place"].append(shared.astype(np.int32))
    return pa.table(out, schema=pa.schema([("uid", pa.int64()), ("n", pa.int32()), ("hub", pa.float64()), ("grams", pa.binary()), ("post_gram", pa.list_(pa.int64())), ("post_place", pa.list_(pa.int32()))]))


def _both(some: np.ndarray, grams: np.ndarray) -> int:
    """How many of some n-grams are among the sorted ones of a set."""
    at = np.searchsorted(grams, some)
    at[at == len(grams)] = 0
    return int((grams[at] == some).sum()) if len(grams) else 0


def _overlaps(percent: int):
    """Overlap of each pair, and of linked ones what x lacks of y (`less`) and has beyond it (`plus`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, less, plus = [], [], []
            for x, y in zip(batch.column("x_grams"), batch.column("y_grams")):
                one, two = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                n = len(np.intersect1d(one, two, assume_unique=True))
                linked = 100 * n >= percent * (len(one) + len(two) - n)
                both.append(n)
                less.append(np.setdiff1d(two, one, assume_unique=True).tobytes() if linked else None)
                plus.append(np.setdiff1d(one, two, assume_unique=True).tobytes() if linked else None)
            out = {k: batch.column(k) for k in ("x", "y", "x_n", "y_n")}
            yield pa.RecordBatch.from_pydict(out | {"both": pa.array(both, pa.int64()), "less": pa.array(less, pa.binary()), "plus": pa.array(plus, pa.binary())})

    return run


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of r with a follower, from that with its leader."""
    for batch in batches:
        both = []
        for n, less, plus, grams in zip(batch.column("both").to_pylist(), batch.column("less"), batch.column("plus"), batch.column("grams")):
            r = np.frombuffer(grams.as_buffer(), dtype=U64)
            both.append(n - _both(np.frombuffer(less.as_buffer(), dtype=U64), r) + _both(np.frombuffer(plus.as_buffer(), dtype=U64), r))
        out = {k: batch.column(k) for k in ("x", "y", "x_n", "y_n")}
        yield pa.RecordBatch.from_pydict(out | {"both": pa.array(both, pa.int64())})


def _judged(found: DataFrame, percent: int) -> DataFrame:
    union = F.col("x_n") + F.col("y_n") - F.col("both")
    return found.withColumn("linked", 100 * F.col("both") >= percent * union).withColumn("distance", 1 - F.col("both") / union)


def _verified(pairs: DataFrame, active: DataFrame, percent: int, label: str) -> DataFrame:
    """x, y, x_n, y_n, both, less, plus, linked, distance of each pair (x, y), by their whole sets."""
    one = active.select(F.col("uid").alias("x"), F.col("n").alias("x_n"), F.col("grams").alias("x_grams"))
    two = active.select(F.col("uid").alias("y"), F.col("n").alias("y_n"), F.col("grams").alias("y_grams"))
    full = pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "x_n", "y_n", "x_grams", "y_grams")
    return written(_judged(full.mapInArrow(_overlaps(percent), "x long, y long, x_n int, y_n int, both long, less binary, plus binary"), percent), label)


def _by_leaders(pairs: DataFrame, led: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """x, y, linked of those pairs one of which follows a leader that the other one met: their answers follow from the leader's."""
    either = pairs.select(F.col("x").alias("r"), F.col("y").alias("f")).unionAll(pairs.select(F.col("y").alias("r"), F.col("x").alias("f")))
    follows = led.where("linked").select(F.col("x").alias("f"), F.col("y").alias("leader"), F.col("x_n").alias("f_n"), "less", "plus")
    met = led.select(F.col("x").alias("r"), F.col("y").alias("leader"), F.col("x_n").alias("r_n"), "both")
    found = either.join(follows.select("f", "leader"), "f").join(met.select("r", "leader"), ["r", "leader"])
    found = found.groupBy(F.least("r", "f").alias("x"), F.greatest("r", "f").alias("y")).agg(F.min(F.struct("leader", "r", "f")).alias("by")).select("x", "y", "by.*")
    found = written(found.join(follows, ["f", "leader"]).join(met, ["r", "leader"]), "derived")
    # what the follower has beyond its leader may all be in r: if that is too little, no lookup is needed
    most = F.col("both") + F.octet_length("plus") / 8
    near = found.where((100 + percent) * most >= percent * (F.col("f_n") + F.col("r_n")))
    near = near.join(active.select(F.col("uid").alias("r"), "grams"), "r").select("x", "y", F.col("r_n").alias("x_n"), F.col("f_n").alias("y_n"), "both", "less", "plus", "grams")
    answers = _judged(near.mapInArrow(_derived, "x long, y long, x_n int, y_n int, both long"), percent).select("x", "y", "linked")
    return written(found.select("x", "y").join(answers, ["x", "y"], "left").select("x", "y", F.coalesce("linked", F.lit(False)).alias("linked")), "answers")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the classes of documents that links connect."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = blocks(rows, label="grams")
    buckets = bucket_count(packed)
    base = written(over(packed, lambda i, t: _base(i, t, n), "doc_id long, n_shingles long, k1 long, k2 long, uid long"), "sets")
    sets = base.where("k1 is not null").groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least_doc"))
    place = F.pmod("uid", F.lit(BLOCK_ROWS)).cast("int")
    chosen = (
        sets.select(F.shiftright("uid", 16).alias("block_id"), place.alias("place"))
        .groupBy("block_id")
        .agg(F.array_sort(F.collect_list("place")).alias("places"))
        .mapInArrow(_pack_places, "block_id long, bucket int, bits binary")
    )
    chosen = written(chosen, "chosen")
    sent = with_answers(packed, chosen, lambda i, t, x: _send(i, t, x, n, buckets), "bucket int, block_id long, grams binary, held binary")
    levels = sent.groupBy("bucket").applyInArrow(_count, "block_id long, bucket int, bits binary")
    active = written(with_answers(packed, levels.unionByName(chosen), lambda i, t, x: _activate(i, t, x, n, buckets, percent), ACTIVE), "active")

    # The index: lists of n-grams, cut in blocks of one size and place.
    posts = active.select("uid", "n", "hub", F.explode(F.arrays_zip("post_gram", "post_place")).alias("p")).select("uid", F.col("n").cast("long").alias("n"), "hub", F.col("p.post_gram").alias("gram"), F.col("p.post_place").cast("long").alias("place"))
    index = written(
        posts.groupBy("gram", "n", "place", F.pmod(F.xxhash64("uid"), F.lit(LIST_SALT)).alias("salt"))
        .agg(F.collect_list("uid").alias("members"), F.max(F.struct("hub", "uid")).alias("head")),
        "index",
    )
    leaders = index.groupBy("gram").agg(F.max(F.struct("head", "n", "place")).alias("l"), F.sum(F.size("members")).alias("length")).where("length > 1")
    leaders = leaders.select("gram", F.col("l.head.uid").alias("y"), F.col("l.n").alias("y_n"), F.col("l.place").alias("y_place"))
    may = lambda n1, p1, n2, p2: F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) * (100 + percent) >= percent * (F.col(n1) + F.col(n2))
    stars = (
        index.join(leaders, (index["gram"] == leaders["gram"]) & may("n", "place", "y_n", "y_place"))
        .select(F.explode("members").alias("x"), "y")
        .where("x <> y")
        .distinct()
    )
    led = _verified(stars, active, percent, "led")
    links = led.where("linked")
    classes = written(connected_components(links, "x", "y"), "classes")

    # What no leader has settled: pairs of a list that are in different classes.
    listed = posts.join(classes.withColumnRenamed("node", "uid"), "uid", "left").select("gram", "uid", "n", "place", F.coalesce("component", "uid").alias("class"))
    listed = written(listed, "listed")
    main = listed.groupBy("gram", "class").count().groupBy("gram").agg(F.max(F.struct("count", "class")).alias("m"), F.count("*").alias("classes")).where("classes > 1")
    main = main.select("gram", F.col("m.class").alias("main"))
    rest = listed.join(main, "gram").where("class <> main").select("gram", F.col("uid").alias("r"), F.col("n").alias("r_n"), F.col("place").alias("r_place"), F.col("class").alias("r_class"))
    other = listed.join(main, "gram", "left_semi")
    left = (
        rest.join(other, (rest["gram"] == other["gram"]) & (F.col("class") != F.col("r_class")) & may("n", "place", "r_n", "r_place"))
        .select(F.least("r", "uid").alias("x"), F.greatest("r", "uid").alias("y"))
        .distinct()
    )
    done = led.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    left = left.join(done, ["x", "y"], "left_anti")
    # Distances from one leader that differ by more than 1 - t rule a pair out.
    far = led.select(F.col("x").alias("m"), F.col("y").alias("leader"), "distance")
    ruled = (
        left.join(far.select(F.col("m").alias("x"), "leader", F.col("distance").alias("d1")), "x")
        .join(far.select(F.col("m").alias("y"), "leader", F.col("distance").alias("d2")), ["y", "leader"])
        .where(F.abs(F.col("d1") - F.col("d2")) > (100 - percent) / 100 + 1e-9)
        .select("x", "y")
        .distinct()
    )
    left = written(left.join(ruled, ["x", "y"], "left_anti"), "left")
    answers = _by_leaders(left, led, active, percent)
    more = _verified(left.join(answers, ["x", "y"], "left_anti"), active, percent, "more")
    linked = [links.select("x", "y"), *(found.where("linked").select("x", "y") for found in (answers, more))]
    classes = connected_components(linked[0].unionAll(linked[1]).unionAll(linked[2]), "x", "y")

    grouped = sets.join(classes.withColumnRenamed("node", "uid"), "uid", "left").select("k1", "k2", "least_doc", F.coalesce("component", "uid").alias("class"))
    grouped = written(grouped, "grouped")
    least = grouped.groupBy("class").agg(F.min("least_doc").alias("component_id"))
    named = grouped.join(least, "class").select("k1", "k2", "component_id")
    return (
        base.join(named, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _pack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.asarray(x.values, dtype="<i4").tobytes() for x in batch.column("places")]
        yield pa.RecordBatch.from_pydict({"block_id": batch.column("block_id"), "bucket": pa.array([-1] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})
