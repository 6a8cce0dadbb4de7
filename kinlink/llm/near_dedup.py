"""Near-duplicate detection: MinHash banding, verification, connected components.

1. Each text becomes a set of word shingles and a signature of universal hash minima; equal sets
   form a class that from then on is represented by its smallest document id.
2. Bands of the signature are grouped by value. Buckets with the same members are taken once.
3. Members of a bucket are compared in blocks of bounded size: signatures first, then the full
   sets. A block reports a head for each of its members, never all pairs of a group.
4. Buckets of several blocks go on with heads: one member of each group is compared with those of the others, as long as
   that joins most of them. What then still lies outside the largest group of its bucket is compared with all of the
   bucket, block by block. A group of near copies thus costs rows in proportion to its size; only texts that share a
   band and are not linked cost more, as each of them has to be compared with the whole bucket.
5. Alternating large-star and small-star turns links into components.

Two steps are probabilistic: a pair at the threshold itself shares no bucket with a probability below 1e-5 (see plan_bands),
and pairs above it still less; and sets are not compared where signatures agree in six standard deviations less than they would at the
threshold, which a linked pair does with a probability of about 1e-9.

Defined results: a null, empty or blank text has an empty set and is linked with nothing, even
with other empty ones; a text with fewer words than the shingle width is one shingle of all its
words; texts of any length are read whole; repeated rows share one id and hence one result; a row without a doc_id is linked
with nothing, has a null component and is kept; columns of the input other than the id and the text stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bitmap, textkit
from kinlink.llm.components import connected_components
from kinlink.llm.workdir import bound_batches, materialize, trimmed

N_HASHES = 252
BLOCK_ROWS = 256
BLOCK_SHINGLES = 200_000
SEED = 20_11
#: Most bits of the bitmaps that are broadcast (16 MB), and bits for each entry below that.
BITMAP_BITS, BITS_AN_ENTRY = 1 << 27, 16
#: Going on with heads of components pays while it leaves at most this share of them.
WORTH = 0.5
BROADCAST_IDS = 1_000_000


def plan_bands(threshold: float, n_hashes: int = N_HASHES, miss: float = 1e-5) -> tuple[int, int]:
    """(rows, bands): the longest bands by which a pair at the threshold is missed less often than `miss`."""
    for rows in range(16, 0, -1):
        bands = n_hashes // rows
        if (1 - threshold**rows) ** bands < miss:
            return rows, bands
    raise ValueError("the threshold is too low for the number of hashes")


def hash_family(n_hashes: int = N_HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the functions a*x + b modulo 2**32."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        t = np.multiply.outer(a, x[at : at + 2048])
        t += b[:, None]
        np.minimum(least, t.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = textkit.mix(np.arange(1, bands + 1, dtype=np.uint64))
    parts = least[: rows * bands].reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        key = textkit.mix(key * textkit.ODD + parts[:, k])
    return key


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        one, two = (textkit.mix(shingles ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x51ED270B, 0xA0761D6478BD642F))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _texts_of(batch, id_name: str, text_name: str, width: int):
    """(id, set of shingles) of each row of an Arrow batch."""
    ids = batch.column(id_name).to_pylist()
    raw, offsets = textkit.arrow_bytes(batch.column(text_name))
    for lo, hi in textkit.slices_of(np.diff(offsets)):
        words, first = textkit.word_hashes(raw, offsets[lo : hi + 1])
        for k in range(lo, hi):
            yield ids[k], textkit.shingles(words[first[k - lo] : first[k - lo + 1]], width)


def _signer(width: int, rows: int, bands: int):
    def run(batches):
        import pyarrow as pa

        a, b = hash_family()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]
        )
        for batch in batches:
            out = {name: [] for name in schema.names}
            for doc, s in _texts_of(batch, "doc_id", "text", width):
                k1, k2 = set_digest(s)
                keys = band_keys(signature(s, a, b), rows, bands).view(np.int64) if len(s) else None
                for name, v in zip(schema.names, (doc, len(s), k1, k2, keys), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _band_filter(bits):
    """Band keys of each class that may be shared with another class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("bands")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            hit = bitmap.holds(bits.value, flat)
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(rows), batch.column("n").take(rows), pa.array(flat[hit])], names=["rep", "n", "key"]
            )

    return run


def _setter(width: int, bits):
    """Set and short signature of texts that may be among those to be compared."""

    def run(batches):
        import pyarrow as pa

        a, b = hash_family()
        schema = pa.schema(
            [("rep", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.binary()), ("items", pa.binary())]
        )
        for batch in batches:
            hit = bitmap.holds(bits.value, batch.column("h").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(hit))
            out = {name: [] for name in schema.names}
            for doc, s in _texts_of(batch, "doc_id", "text", width):
                k1, k2 = set_digest(s)
                sig = (signature(s, a, b) >> np.uint32(24)).astype(np.uint8)
                for name, v in zip(schema.names, (doc, k1, k2, sig.tobytes(), s.tobytes()), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def link_block(reps: list[int], sides: list[int], labels: list[int], sigs: list[bytes], items: list[bytes], percent: int, cross: bool) -> list[int]:
    """For each row the least rep that it is connected with: by equal labels, or links, pairs with 100 * common >= percent * united.

    cross: only pairs from different sides count.
    """
    n = len(reps)
    sig = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(n, -1)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in items]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    t = percent / 100
    least = sig.shape[1] * (t - 6 * math.sqrt(t * (1 - t) / sig.shape[1]))
    root, side = np.unique(labels, return_inverse=True)[1], np.array(sides)
    flag = np.zeros(int(ids.max()) + 1, dtype=np.int8)
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[root[later] != root[i]]
        if cross:
            later = later[side[later] != side[i]]
        later = later[100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])]
        later = later[(sig[later] == sig[i]).sum(axis=1) >= least]
        if not len(later):
            continue
        flag[ids[starts[i] : starts[i + 1]]] = 1
        for j in later:
            common = int(flag[ids[starts[j] : starts[j + 1]]].sum(dtype=np.int64))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common) and root[i] != root[j]:
                root[root == root[j]] = root[i]
        flag[ids[starts[i] : starts[i + 1]]] = 0
    heads = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(heads, root, np.array(reps))
    return heads[root].tolist()


def _linker(percent: int):
    """Streams rows sorted by bucket and block pair; each such group has a bounded size. b2 is -1 for a block by itself."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("head", pa.int64())])
        now, rows = None, {}

        def done():
            sides, reps = zip(*rows, strict=True)
            heads = link_block(list(reps), list(sides), *map(list, zip(*rows.values(), strict=True)), percent, now[2] >= 0) if len(rows) > 1 else list(reps)
            return pa.RecordBatch.from_pydict({"key": [now[0]] * len(reps), "rep": list(reps), "head": heads}, schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "b1", "b2", "side", "rep", "label", "sig", "items"))
            for key, b1, b2, side, rep, label, sig, items in zip(*columns, strict=True):
                if (key, b1, b2) != now:
                    if rows:
                        yield done()
                    now, rows = (key, b1, b2), {}
                rows[side, rep] = (label, sig, items)
        if rows:
            yield done()

    return run


def _bits(rows: DataFrame, column: str):
    """A broadcast bitmap of a written column, sized by its number of rows."""
    n = min(BITMAP_BITS, 1 << max(16, (BITS_AN_ENTRY * rows.count()).bit_length()))
    return rows.sparkSession.sparkContext.broadcast(bitmap.build(rows, column, n))


def _blocks(n, total):
    """How many blocks n sets with total shingles make."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK_ROWS, total / BLOCK_SHINGLES))).cast("int")


def _place(salt: int, blocks: str):
    return F.pmod(F.xxhash64("rep", "key", F.lit(salt)), F.col(blocks)).cast("int")


def _compared(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(key, rep, head) of written rows (key, b1, b2, side, rep, label), of which each (key, b1, b2) is compared in one place."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    grouped = rows.join(sets_of(materialize(rows.select("rep").distinct(), "wanted")), "rep").select("key", "b1", "b2", "side", "rep", "label", "sig", "items")
    grouped = grouped.repartition(parts, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return materialize(grouped.mapInArrow(trimmed(_linker(percent)), "key long, rep long, head long"), "heads")


def _alone(rows: DataFrame, salt: int) -> DataFrame:
    """rows (key, rep, label, blocks) dealt to the blocks of their bucket."""
    return rows.select("key", _place(salt, "blocks").alias("b1"), F.lit(-1).alias("b2"), F.lit(0).alias("side"), "rep", "label")


def _bucket_heads(large: DataFrame, found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, made: list[DataFrame]) -> DataFrame:
    """(key, rep, n, label) of members (key, rep, n) of buckets with several blocks: label is the head of the group they are put in.

    found: (key, rep, head) of the comparisons within blocks. One head of each group goes on to be compared, while that
    joins most of them; each comparison's (key, rep, head) is added to made.
    """
    now, before, salt = materialize(large.join(found, ["key", "rep"]).select("key", "rep", "n", F.col("head").alias("label")), "labels"), None, 0
    while True:
        groups = now.groupBy("key", "label").agg(F.min("rep").alias("rep"), F.min_by("n", "rep").alias("n"), F.count("*").alias("members"))
        several = groups.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.sum("members").alias("size")).where("groups > 1")
        left = several.agg(F.sum("groups"), F.sum("size")).first()
        if not left[0] or left[0] > WORTH * (before or left[1]):
            return now
        before, salt = left[0], salt + 1
        heads = groups.join(several.select("key", _blocks(F.col("groups"), F.col("total")).alias("blocks")), "key").select("key", "rep", "label", "blocks")
        again = _compared(materialize(_alone(heads, salt), "asked"), sets_of, percent)
        made.append(again)
        renamed = heads.select("key", "rep", "label").join(again, ["key", "rep"]).select("key", "label", F.col("head").alias("next"))
        now = materialize(now.join(renamed, ["key", "label"], "left").select("key", "rep", "n", F.coalesce("next", "label").alias("label")), "labels")


def _rest_of_large(named: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame | None:
    """(key, rep, head): whatever is not in the largest group of its bucket of several blocks meets all of the bucket.

    named: key, rep, n, label, of buckets with several blocks.
    """
    groups = named.groupBy("key", "label").agg(F.count("*").alias("members"))
    several = groups.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("members", "label")).alias("most")).where("groups > 1")
    several = materialize(several.select("key", F.col("most.label").alias("largest")), "several")
    n_buckets = several.count()
    if not n_buckets:
        return None
    # One row for each bucket: broadcast up to a checked number, so that no bucket's members are dealt to one task to be joined.
    small = F.broadcast if n_buckets <= BROADCAST_IDS else lambda df: df
    named = named.join(small(several), "key").withColumn("minor", F.col("label") != F.col("largest"))
    minor_n = F.when(F.col("minor"), F.col("n"))
    counts = named.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.count(minor_n).alias("minors"), F.coalesce(F.sum(minor_n), F.lit(0)).alias("minor_total"))
    plan = counts.select("key", _blocks(F.col("size"), F.col("total")).alias("all_blocks"), _blocks(F.col("minors"), F.col("minor_total")).alias("minor_blocks"))
    planned = named.join(small(materialize(plan, "plan")), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = planned.select("key", _place(0, "all_blocks").alias("b1"), every("minor_blocks").alias("b2"), F.lit(0).alias("side"), "rep", "label")
    two = planned.where("minor").select("key", every("all_blocks").alias("b1"), _place(0, "minor_blocks").alias("b2"), F.lit(1).alias("side"), "rep", "label")
    return _compared(materialize(one.union(two), "asked"), sets_of, percent)


def find_links(docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): pairs of class representatives that connect all that are linked, and nothing else.

    docs: doc_id, text. classes: rep, n, k1, k2, bands.
    """
    shared = materialize(
        classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"),
        "shared",
    )
    banded = classes.select("rep", "n", "bands").mapInArrow(_band_filter(_bits(shared, "key")), "rep long, n long, key long")
    members = materialize(banded.join(shared, "key"), "members")
    # The same members often meet in several bands; one such bucket is enough.
    buckets = (
        members.groupBy("key", "size")
        .agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("fp"), F.sum("n").alias("total"))
        .groupBy("size", "lo", "hi", "fp", "total")
        .agg(F.min("key").alias("key"))
    )
    blocks = _blocks(F.col("size"), F.col("total")).alias("blocks")
    members = materialize(members.select("key", "rep", "n").join(buckets.select("key", blocks), "key"), "members")
    hashed = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))

    def sets_of(reps: DataFrame) -> DataFrame:
        """(rep, sig, items) of some classes, made anew from the texts: nothing of the size of the corpus is written or shuffled."""
        made = hashed.mapInArrow(trimmed(_setter(width, _bits(reps.select(F.xxhash64("rep").alias("h")), "h"))), "rep long, c1 long, c2 long, sig binary, items binary")
        return made.join(reps.join(classes.select("rep", "k1", "k2"), "rep"), "rep").where("c1 = k1 and c2 = k2").select("rep", "sig", "items")

    made = [_compared(_alone(members.withColumn("label", F.col("rep")), 0), sets_of, percent)]
    large = members.where("blocks > 1")
    if not large.isEmpty():
        named = _bucket_heads(large, made[0], sets_of, percent, made)
        if (rest := _rest_of_large(named, sets_of, percent)) is not None:
            made.append(rest)
    return _pairs(made)


def _pairs(made: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, made).where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row.

    Rows are linked if 100 * (shingles in both) >= percent * (shingles in either); component_id is
    the smallest id reachable over links, and the row with that id is kept.
    """
    plain = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, bands = plan_bands(percent / 100)
    signed = materialize(
        plain.mapInArrow(trimmed(_signer(width, rows, bands)), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "signed"
    )
    classes = materialize(
        signed.where("n > 0 and doc_id is not null")
        .groupBy("n", "k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    parts = connected_components(find_links(plain, classes, percent, width)).select(F.col("node").alias("rep"), "component")
    named = classes.select("n", "k1", "k2", "rep").join(parts, "rep", "left")
    named = named.select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast("long").alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs without the documents that are not the first of their component; columns as they are."""
    found = near_duplicates(docs, id_col, text_col, percent)
    dropped = materialize(found.where("not kept").select(F.col(id_col).alias("dropped")).distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    inner = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    ids = F.col(inner[docs.columns.index(id_col)]).cast("long")
    return plain.join(dropped, ids == F.col("dropped"), "left_anti").toDF(*docs.columns)


def near_dedup_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, percent=85)


#: The exact set join. Pairs are sought by their rarest shingles only: of two sets with 85 in 100 alike, each has one of the other's
#: among its first, by rarity, n - ceil(85 n / 100) + 1.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(s) AS s FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM words)
), classes AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s
), items AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), ranked AS (
  SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY f, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM items)
), prefixes AS (
  SELECT rep, n, x FROM ranked WHERE place <= n - CAST(ceil(n * 85 / 100) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM pairs p JOIN classes c ON c.rep = p.a JOIN classes d ON d.rep = p.b
  WHERE 100 * len(list_intersect(c.s, d.s)) >= 85 * (c.n + d.n - len(list_intersect(c.s, d.s)))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(node, least) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT e.b, r.least FROM reached r JOIN both_ways e ON e.a = r.node WHERE r.least < e.b
), components AS (
  SELECT node, min(least) AS component FROM reached GROUP BY node
), named AS (
  SELECT c.s, k.component FROM classes c JOIN components k ON k.node = c.rep
)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(m.component, t.doc_id) AS component_id, coalesce(m.component, t.doc_id) IS NOT DISTINCT FROM t.doc_id AS kept
FROM sets t LEFT JOIN named m ON m.s = t.s AND t.doc_id IS NOT NULL
"""
