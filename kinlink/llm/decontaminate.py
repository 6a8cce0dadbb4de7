"""Benchmark decontamination with spaced seeds.

A seed hashes the words at the kept positions of a fixed mask and ignores the others, so two
texts share seeds although single words differ. Seeds of the benchmark and of the documents are joined;
around each hit the words are compared along its diagonal, with substitutions allowed.

1. The benchmark's seeds are also written into a bitmap of bounded size, the only thing broadcast.
2. Documents are scanned once. Where a seed may be in the bitmap, the words around it are
   kept as a region: overlapping surroundings make one region, so nothing is stored twice.
3. The regions' seeds are joined with the benchmark's, giving (region, item, diagonal).
4. Each diagonal is verified on word hashes, and the best overlap of a document with an item returned.

Words are runs of ASCII letters and digits and of non-ASCII bytes, lower-cased in A-Z.

Which masks an item has follows from its length (see MASKS), so that every overlap of up to 25 words holds a seed whichever
words are replaced; masks that no item has are not looked for in documents.

Defined results: null, empty and wordless texts overlap with nothing; items with fewer words than min_words
must be found whole (four fifths of it, like any overlap); repeated documents or items each give their rows; of equally good overlaps
the shorter, then the first is reported; rows without an id are reported with a null id, and drop_contaminated judges every row by its text,
with or without an id; texts of any length are read whole; columns of the input other than the id and the text stay as they are, whatever
their names; an empty benchmark or corpus gives an empty result, and nothing is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bitmap, textkit
from kinlink.llm.workdir import bound_batches, materialize, trimmed

#: Fixed masks, 1 for a position that counts, by the least number of words of the items that have them.
MASKS = {1: ("1",), 2: ("11",), 3: ("111", "1101", "1011"), 13: ("11111", "1101011", "110010101", "1010011001")}
#: Bits of the bitmap for each seed of the benchmark, and in all; a fuller one makes more regions, never other results.
BITS_A_SEED, BITMAP_BITS = 128, 1 << 27
NEAR = 40  # words kept on both sides of a hit
BROADCAST_TEXTS = 1_000_000


def mask_class(n_words: int) -> int:
    """The key in MASKS of the masks of an item."""
    return max((k for k in MASKS if k <= n_words), default=0)


def seeds_of(words: np.ndarray, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) for every mask of the classes at every place where it fits."""
    at, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for kind in classes:
            for number, mask in enumerate(MASKS[kind]):
                n = len(words) - len(mask) + 1
                if n <= 0:
                    continue
                total = np.full(n, np.uint64(kind * 16 + number + 1), dtype=np.uint64)
                for k, bit in enumerate(mask):
                    if bit == "1":
                        total = total * textkit.ODD + words[k : k + n]
                        total ^= total >> np.uint64(31)
                at.append(np.arange(n))
                seeds.append(textkit.mix(total))
    return np.concatenate(at), np.concatenate(seeds)


def _texts(batch):
    raw, offsets = textkit.arrow_bytes(batch.column("text"))
    for lo, hi in textkit.slices_of(np.diff(offsets)):
        words, first = textkit.word_hashes(raw, offsets[lo : hi + 1], textkit.PUNCT)
        for k in range(lo, hi):
            yield k, words[first[k - lo] : first[k - lo + 1]]


def _benchmark_reader(batches):
    import pyarrow as pa

    schema = pa.schema(
        [("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("kind", pa.int32()), ("at", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))]
    )
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        rows = [(ids[k], w, mask_class(len(w)), *seeds_of(w, [mask_class(len(w))])) for k, w in _texts(batch) if len(w)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array([w.view(np.int64) for w in columns[1]], schema.field("words").type),
                pa.array(columns[2], pa.int32()),
                pa.array([x.astype(np.int32) for x in columns[3]], schema.field("at").type),
                pa.array([x.view(np.int64) for x in columns[4]], schema.field("seeds").type),
            ],
            schema=schema,
        )


REGION = "doc_id long, key long, row long, start long, words array<long>, at array<int>, seeds array<long>"


def _region_finder(bits, classes: list[int]):
    span = max(len(m) for k in classes for m in MASKS[k])

    def run(batches):
        import pyarrow as pa

        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("key", pa.int64()),
                ("row", pa.int64()),
                ("start", pa.int64()),
                ("words", pa.list_(pa.int64())),
                ("at", pa.list_(pa.int32())),
                ("seeds", pa.list_(pa.int64())),
            ]
        )
        for batch in batches:
            ids, doc_keys, rows = (batch.column(c).to_pylist() for c in ("doc_id", "key", "row"))
            out = {n: [] for n in schema.names}
            for k, words in _texts(batch):
                at, seeds = seeds_of(words, classes)
                hit = bitmap.holds(bits.value, seeds)
                if not hit.any():
                    continue
                at, seeds = at[hit], seeds[hit]
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * NEAR) + 1):
                    lo, hi = max(0, at[part[0]] - NEAR), min(len(words), at[part[-1]] + NEAR + span)
                    for name, v in (
                        ("doc_id", ids[k]),
                        ("key", doc_keys[k]),
                        ("row", rows[k]),
                        ("start", int(lo)),
                        ("words", words[lo:hi].view(np.int64)),
                        ("at", (at[part] - lo).astype(np.int32)),
                        ("seeds", seeds[part].view(np.int64)),
                    ):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, need: int, percent: int) -> tuple[int, int, int]:
    """(length, matches, start in doc) of the longest run on a diagonal with enough equal words; zeros if none.

    diagonal: place in doc minus place in item. A run begins and ends with equal words.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < need:
        return 0, 0, 0
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    where = np.flatnonzero(same)
    if not len(where):
        return 0, 0, 0
    # excess[k]: how far the matches up to place k are ahead of the required share. A run from a to b is good if it does not fall.
    excess = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    best_after = np.maximum.accumulate(excess[where + 1][::-1])[::-1]
    last = len(where) - 1 - np.searchsorted(best_after[::-1], excess[where])
    lengths = where[last] - where + 1
    k = int(lengths.argmax())
    if lengths[k] < need:
        return 0, 0, 0
    return int(lengths[k]), int(last[k] - k + 1), int(where[k]) + lo + diagonal


def _verifier(min_words: int, percent: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("doc_id", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("length", pa.int64()), ("matched", pa.int64()), ("at", pa.int64())]
        )
        for batch in batches:
            out = {n: [] for n in schema.names}
            columns = {c: batch.column(c) for c in ("doc_id", "key", "row", "start", "words", "item_id", "item_words", "diagonals")}
            for i in range(batch.num_rows):
                doc, key, row, start, item = (columns[c][i].as_py() for c in ("doc_id", "key", "row", "start", "item_id"))
                words, of_item = (columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("words", "item_words"))
                need = min(min_words, -(-len(of_item) * percent // 100))
                found = [best_overlap(words, of_item, d, need, percent) for d in columns["diagonals"][i].as_py()]
                length, matched, at = max(found, key=lambda x: (x[1], -x[0], -x[2]))
                if length:
                    for n, v in zip(schema.names, (doc, key, row, item, length, matched, at + start), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int, percent: int) -> DataFrame:
    """(doc_id, key, item_id, n_words, n_matched, word_start) of docs (doc_id, key, text): key only goes through."""
    spark = bound_batches(docs).sparkSession
    items = materialize(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _benchmark_reader, "item_id long, words array<long>, kind int, at array<int>, seeds array<long>"
        ),
        "items",
    ).select("*", F.xxhash64("item_id", "words").alias("item_key"))
    kinds = items.groupBy("kind").agg(F.sum(F.size("seeds")).alias("n")).collect()
    if not kinds:
        return docs.limit(0).selectExpr("doc_id", "key", "0L item_id", "0L n_words", "0L n_matched", "0L word_start")
    item_seeds = items.select("item_key", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(
        "item_key", F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at")
    )
    n_bits = min(BITMAP_BITS, 1 << max(16, (BITS_A_SEED * sum(r.n for r in kinds)).bit_length()))
    bits = spark.sparkContext.broadcast(bitmap.build(item_seeds, "seed", n_bits))
    # A row's number only tells rows with equal ids apart; it is fixed once the regions are written.
    numbered = docs.select("doc_id", "key", "text", F.monotonically_increasing_id().alias("row"))
    regions = materialize(numbered.mapInArrow(trimmed(_region_finder(bits, sorted(r.kind for r in kinds))), REGION), "regions")
    region_seeds = regions.select("row", "start", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(
        "row", "start", F.col("s.seeds").alias("seed"), F.col("s.at").alias("doc_at")
    )
    hits = (
        region_seeds.join(item_seeds, "seed")
        .select("row", "start", "item_key", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
        .groupBy("row", "start", "item_key")
        .agg(F.collect_set("diagonal").alias("diagonals"))
    )
    named = items.dropDuplicates(["item_id", "item_key"]).select("item_id", "item_key", F.col("words").alias("item_words"))
    pairs = hits.join(named, "item_key").join(regions.select("doc_id", "key", "row", "start", "words"), ["row", "start"])
    found = pairs.select("doc_id", "key", "row", "start", "words", "item_id", "item_words", "diagonals").mapInArrow(
        _verifier(min_words, percent), "doc_id long, key long, row long, item_id long, length long, matched long, at long"
    )
    best = found.groupBy("row", "item_id").agg(
        F.max(F.struct("matched", -F.col("length"), -F.col("at"))).alias("b"), F.first("doc_id").alias("doc_id"), F.first("key").alias("key")
    )
    return best.select(
        "doc_id", "key", "item_id", (-F.col("b.col2")).alias("n_words"), F.col("b.matched").alias("n_matched"), (-F.col("b.col3")).alias("word_start")
    )


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 12,
    percent: int = 80,
) -> DataFrame:
    """(id, item_id, n_words, n_matched, word_start): the best overlap of each document with each item.

    An overlap runs along one diagonal over at least min_words words, or four fifths (percent) of a shorter item, and begins and ends
    with equal words; at least `percent` in a hundred of its words are equal.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = _overlaps(plain, benchmark, min_words, percent)
    return found.select(F.col("doc_id").alias(id_col), "item_id", "n_words", "n_matched", "word_start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, percent: int = 80) -> DataFrame:
    """docs without those that overlap with a benchmark item; columns as they are.

    Texts are judged by two 64-bit hashes of them, whatever their id, so documents are read again but not shuffled or written,
    unless very many are dropped.
    """
    inner = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    text = F.col(inner[docs.columns.index(text_col)]).cast("string")
    one, two = F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)
    found = _overlaps(plain.select(one.alias("doc_id"), two.alias("key"), text.alias("text")), benchmark, min_words, percent)
    leaked = materialize(found.select(F.col("doc_id").alias("h1"), F.col("key").alias("h2")).distinct(), "leaked")
    leaked = F.broadcast(leaked) if leaked.count() <= BROADCAST_TEXTS else leaked
    return plain.withColumns({"h1": one, "h2": two}).join(leaked, ["h1", "h2"], "left_anti").select(*inner).toDF(*docs.columns)


def decontamination_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, n_matched, word_start and contaminated (true) for each leaked pair."""
    return find_overlaps(docs, benchmark).withColumn("contaminated", F.lit(True))
