"""Quality classifier: perplexity under interpolated modified Kneser-Ney n-gram models of trusted text, one for each language.

Trained on all trusted texts: the n-grams are of ORDER characters and run across words, white space being one blank. Continuation
counts, discounts (Chen and Goodman 1998) and interpolated probabilities of every order are made by grouping and joining
count tables in Spark; nothing of them is gathered but histograms and a table of bounded size.

Texts fall into two folds by a hash of the text, and each is scored by the models trained on the other fold, so no text is ever
judged by counts of its own, and the thresholds come from held-out texts. All trusted texts train one of the two models.

Scoring joins the texts' events (a character and the ORDER - 1 before it) with the counts. The entries of the most frequent contexts, at most
HOT_ENTRIES of them, are broadcast. An event whose context is not among them is emitted, and the distinct ones of the whole corpus
are joined with the whole count tables, sharded by model and string. What is broadcast therefore only decides where an event is
looked up, never its value, and neither the driver nor a task holds more as the model grows.

A document has two figures: its perplexity, and that of its WORST least likely words, which shows single foul or foreign words in
long texts. It is kept if neither exceeds the quantile of the held-out trusted texts of its language.

Defined results: null, empty and blank texts have no perplexity (null) and are not kept; a language without trusted text in the other
fold is scored by the model of all languages together ("*"), as are texts without a language, and if the other fold has no
trusted text at all, its own fold's models serve; repeated rows are scored alike; ties with a threshold are kept; texts of any length are
read whole, in pieces, and words longer than a piece are cut; without any trusted text nothing has a perplexity and nothing
is kept; columns of the input other than doc_id, lang and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm import bitmap, textkit
from kinlink.llm.workdir import bound_batches, held, materialize, release, trimmed

ORDER = 5
FOLDS = 2
HOT_ENTRIES = 3_000_000  # most entries that are broadcast
FIRST_ENTRIES = 1 << 16  # n-grams looked up first, in a table that fits a processor's cache
BITMAP_BITS = 1 << 26
BROADCAST_IDS = 1_000_000
WORST = 4
QUANTILE = 0.995
PIECE = 1 << 19  # characters worked on at once
FLUSH = 600_000  # distinct events held while counting
ANY = "*"


def pieces(text: str | None):
    """Parts of a text of bounded length, each led by the ORDER - 1 characters before it and ended by a blank."""
    before, at = " " * (ORDER - 1), 0
    text = text or ""
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        body = " ".join(text[at:end].split())
        if body:
            part = before + body.replace("\0", "�") + " "
            yield part
            before = part[1 - ORDER :]
        at = end


def _laid_out(rows):
    """Groups of rows (tag, text) as (tags, owners, code points, events).

    All pieces of a group lie end to end: owners says whose a character is, and events which characters are predicted.
    """
    tags, parts, owners, total = [], [], [], 0
    for tag, text in rows:
        tags.append(tag)
        for part in pieces(text):
            parts.append(part)
            owners.append(len(tags) - 1)
            total += len(part)
            if total >= PIECE:
                yield _arrays(tags, parts, owners)
                tags, parts, owners, total = [tag], [], [], 0
    if parts:
        yield _arrays(tags, parts, owners)


def _arrays(tags: list, parts: list[str], owners: list[int]):
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    events = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        events[starts + k] = False
    return tags, np.repeat(np.array(owners), sizes), codes, events


def _fold(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * textkit.ODD
        h += c
        h += np.uint64(1)
        h ^= h >> np.uint64(29)
        return h


def _seed(models: list[str]) -> np.ndarray:
    """The key of the empty string of each model."""
    made = {m: int.from_bytes(hashlib.blake2b(m.encode(), digest_size=8).digest(), "little") for m in set(models)}
    return np.array([made[m] for m in models], dtype=np.uint64)


def _chain(seeds: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """Keys of the strings of length 0 to ORDER that end at each character; strings that reach over the start are meaningless."""
    keys, padded = [seeds], np.concatenate([np.zeros(ORDER, np.uint64), codes])
    for n in range(ORDER):
        keys.append(_fold(keys[-1], padded[ORDER - n : len(padded) - n]))
    return keys


def _string_keys(models: list[str], strings: list[str]) -> np.ndarray:
    """The keys of whole strings of at most ORDER characters, as _chain makes them."""
    out = _seed(models)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    points = np.array([s[::-1] for s in strings] + ["." * ORDER], dtype=f"U{ORDER}").view(np.uint32).reshape(-1, ORDER)[:-1]
    for n in range(ORDER):
        rows = length > n
        out[rows] = _fold(out[rows], points[rows, n])
    return out


def _count_events(flush_at: int = FLUSH):
    """(model, ctx, c, n) of the texts of a task, added up before they are sent."""

    def run(batches):
        import pyarrow as pa

        held: dict[str, list] = {}

        def merged(parts):
            keys, counts, strings = (np.concatenate([p[k] for p in parts]) for k in range(3))
            uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return uniq, np.bincount(inverse, weights=counts).astype(np.int64), strings[first]

        def flush():
            for model, parts in held.items():
                _, counts, strings = merged(parts)
                ctx = np.ascontiguousarray(strings[:, :-1]).view(f"U{ORDER - 1}").ravel()
                c = np.ascontiguousarray(strings[:, -1:]).view("U1").ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model] * len(counts), pa.string()), pa.array(ctx.tolist(), pa.string()), pa.array(c.tolist(), pa.string()), pa.array(counts)],
                    names=["model", "ctx", "c", "n"],
                )
            held.clear()

        for batch in batches:
            rows = zip(batch.column("model").to_pylist(), batch.column("text").to_pylist(), strict=True)
            by_model: dict[str, list] = {}
            for model, text in rows:
                by_model.setdefault(model, []).append((model, text))
            for model, mine in by_model.items():
                for _, _, codes, events in _laid_out(mine):
                    at = np.flatnonzero(events)
                    keys, first, counts = np.unique(_chain(np.zeros(len(codes), np.uint64), codes)[ORDER][at], return_index=True, return_counts=True)
                    strings = codes[at[first][:, None] + np.arange(1 - ORDER, 1)]
                    parts = held.setdefault(model, [])
                    parts.append((keys, counts, strings))
                    if len(parts) > 8:
                        held[model] = [merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > flush_at:
                yield from flush()
        yield from flush()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(x, 0.05), k + 0.9) for k, x in enumerate(d))


def _discounted(table: DataFrame) -> DataFrame:
    """table (model, ctx, c, n, seen) with the discount d of each count."""
    steps = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = [(r.model, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in table.groupBy("model").agg(*steps).collect()]
    rates = table.sparkSession.createDataFrame(found, "model string, d1 double, d2 double, d3 double")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return table.join(F.broadcast(rates), "model").select("model", "ctx", "c", "n", "seen", d.alias("d"))


def count(trusted: DataFrame) -> DataFrame:
    """(model, ctx, c, n): how often each character follows each context of ORDER - 1 characters.

    trusted: fold, lang, text. Models are named fold:lang, and those of texts without a language fold:*.
    """
    named = bound_batches(trusted).select(F.concat("fold", F.lit(":"), F.coalesce("lang", F.lit(ANY))).alias("model"), "text")
    top = named.mapInArrow(trimmed(_count_events()), "model string, ctx string, c string, n long")
    return materialize(top.groupBy("model", "ctx", "c").agg(F.sum("n").alias("n")), "events")


def count_for(top: DataFrame, used: DataFrame) -> DataFrame:
    """The counts of the used models (model) only, where fold:* has those of all languages of the fold."""
    fold = F.concat(F.substring_index("model", ":", 1), F.lit(":" + ANY))
    wanted = F.broadcast(used)
    own = top.where(F.col("model") != fold).join(wanted, "model", "left_semi")
    if used.where(F.col("model").endswith(":" + ANY)).isEmpty():
        return own
    every = top.withColumn("model", fold).join(wanted, "model", "left_semi").groupBy("model", "ctx", "c").agg(F.sum("n").alias("n"))
    return materialize(own.union(every), "counts")


def train(top: DataFrame) -> DataFrame:
    """The model tables as one: (model, s, logp, back_off, level), from counts (model, ctx, c, n).

    For a string s, logp is that of its last character after the others, back_off the weight of s as a context in logarithms; where s
    is a context and an n-gram it has a row for each. The row of the empty string has the logp of a character never seen. level says
    how frequent the context is, in eighths of octaves: no shorter ending of a context has a lower one.
    """
    tables, written = [top.withColumn("seen", F.col("n"))], []

    def kept(df: DataFrame, what: str) -> DataFrame:
        written.append(materialize(df, what))
        return written[-1]

    # n is how often an n-gram counts, in shorter ones how many different characters come before it; seen is how often it stands in the texts.
    for _ in range(ORDER - 1):
        shorter = tables[0].groupBy("model", F.substring("ctx", 2, ORDER).alias("ctx"), "c").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))
        tables.insert(0, kept(shorter, "counts"))
    made, below = [], None
    for table in tables:
        table = _discounted(table)
        contexts = table.groupBy("model", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"), F.floor(F.log2(F.sum("seen")) * 8).cast("int").alias("level"))
        own = table.join(contexts, ["model", "ctx"])
        own = own.select("model", "ctx", "c", "level", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), (F.col("mass") / F.col("total")).alias("gamma"))
        if below is None:
            # Below single characters: evenly over those seen and one unseen.
            kinds = table.groupBy("model").agg((1 / (F.count("*") + 1)).alias("even"))
            now = own.join(F.broadcast(kinds), "model").withColumn("q", F.col("even"))
            unseen = contexts.join(F.broadcast(kinds), "model").select("model", F.lit("").alias("s"), F.log(F.col("mass") / F.col("total") * F.col("even")).alias("logp"), "level")
            made.append(unseen.select("model", "s", "logp", F.lit(None).cast("double").alias("back_off"), "level"))
        else:
            lower = below.select("model", F.col("ctx").alias("short"), "c", F.col("p").alias("q"))
            now = own.withColumn("short", F.substring("ctx", 2, ORDER)).join(lower, ["model", "short", "c"])
            made.append(contexts.select("model", F.col("ctx").alias("s"), F.lit(None).cast("double").alias("logp"), F.log(F.col("mass") / F.col("total")).alias("back_off"), "level"))
        below = kept(now.select("model", "ctx", "c", "level", (F.col("p") + F.col("gamma") * F.col("q")).alias("p")), "probabilities")
        made.append(below.select("model", F.concat("ctx", "c").alias("s"), F.log("p").alias("logp"), F.lit(None).cast("double").alias("back_off"), "level"))
    logs = [F.col(c).cast("float").alias(c) for c in ("logp", "back_off")]
    model = materialize(reduce(DataFrame.union, made).select("model", "s", *logs, "level"), "model")
    for table in written:
        release(table)
    return model


class KeyTable:
    """Values of 64-bit keys in arrays, found by open addressing. An empty place has the key 0, which no entry has but by a chance of 2**-64."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        left, slot = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[left[won]], values[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; the value is 0 where none is found."""
        slot = self._place(keys)
        there = self.keys[slot]
        found = there == keys
        values = np.where(found, self.values[slot], 0)
        left = np.flatnonzero(~found & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at = slot[left]
            there = self.keys[at]
            hit = there == keys[left]
            found[left[hit]], values[left[hit]] = True, self.values[at[hit]]
            left = left[~hit & (there != 0)]
        return found, values


class Scorer:
    """Log-probabilities of events by the broadcast entries.

    rest: a bitmap of the contexts that have entries elsewhere (None: there are none); what is neither here nor there was
    never seen. begun: the entries of the empty context are here.
    """

    def __init__(self, keys: np.ndarray, logp: np.ndarray, back_off: np.ndarray, rest: bytes | None, begun: bool):
        gram, context = ~np.isnan(logp), ~np.isnan(back_off)
        first = np.flatnonzero(gram)[:FIRST_ENTRIES]
        self.first = KeyTable(keys[first], logp[first])
        self.grams, self.contexts = KeyTable(keys[gram], logp[gram]), KeyTable(keys[context], back_off[context])
        self.rest, self.begun = rest, begun

    def __call__(self, seeds: np.ndarray, codes: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, order) of each event. order is the length of the shortest of its contexts whose entries may be elsewhere, and
        value then what the shorter ones give; it is -1 where value is the event's log-probability.
        """
        chain, at = _chain(seeds, codes), np.flatnonzero(events)
        value, order = np.zeros(len(at)), np.full(len(at), -1, np.int8)
        found, value[:] = self.first.look_up(chain[ORDER][at])
        left = np.flatnonzero(~found)
        for n in range(ORDER - 1, -1, -1):
            found, logp = self.grams.look_up(chain[n + 1][at[left]])
            value[left] += logp
            left = left[~found]
            if n:
                keys = chain[n][at[left] - 1]
                known, back = self.contexts.look_up(keys)
                value[left] += back
                if self.rest is not None:
                    unknown = np.flatnonzero(~known)
                    order[left[unknown[bitmap.holds(self.rest, keys[unknown])]]] = n
            else:
                value[left] += self.grams.look_up(seeds[at[left]])[1]
                if not self.begun:
                    order[left] = 0
        return value, order


def _with_keys(batches):
    import pyarrow as pa

    for batch in batches:
        keys = _string_keys(batch.column("model").to_pylist(), batch.column("s").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns[2:]], names=["key", *batch.schema.names[2:]])


def hot_entries(model: DataFrame, most: int) -> tuple:
    """(keys, logp, back_off, rest, begun) for Scorer: all entries of the contexts from some level up, `most` of them or fewer,
    and a bitmap of the other contexts, of 8 MB or less. A full bitmap only makes more events open.
    """
    levels = model.where("s <> ''").groupBy("level").agg(F.count("*").alias("entries"), F.count("back_off").alias("contexts")).orderBy(F.desc("level")).collect()
    cut, room = None, most
    for r in levels:
        if r.entries > room:
            break
        cut, room = r.level, room - r.entries
    chosen = (F.col("s") == "") | (F.col("level") >= F.lit(cut)) if cut is not None else F.col("s") == ""
    keyed = "key long, logp float, back_off float, often float"
    # How often a whole n-gram is seen, in logarithms; the most frequent ones are put first.
    often = F.when((F.length("s") == ORDER) & F.col("logp").isNotNull(), F.col("logp") + F.col("level") * (math.log(2) / 8)).otherwise(-1e9).cast("float").alias("often")
    table = model.where(chosen).select("model", "s", "logp", "back_off", often).mapInArrow(_with_keys, keyed).toArrow()
    rank = -table.column("often").to_numpy()
    order = np.argpartition(rank, min(FIRST_ENTRIES, len(rank) - 1)) if len(rank) else np.zeros(0, np.int64)
    keys, logs = table.column("key").to_numpy().view(np.uint64)[order], [table.column(c).to_numpy().astype(np.float32)[order] for c in ("logp", "back_off")]
    rest = None
    if levels and cut != levels[-1].level:
        others = sum(r.contexts for r in levels if cut is None or r.level < cut)
        bits = min(BITMAP_BITS, 1 << max(6, (16 * others).bit_length()))
        cold = model.where(~chosen & F.col("back_off").isNotNull()).select("model", "s", "logp", "back_off", often)
        rest = bitmap.build(cold.mapInArrow(_with_keys, keyed), "key", bits)
    return keys, *logs, rest, cut is not None


SCORED = (
    "doc_id long, trusted boolean, model string, logp double, n long, worst array<double>, "
    "words array<struct<w:int,logp:double,n:int>>, events array<struct<w:int,s:string,o:int,v:double>>"
)


def _score_rows(shared):
    """For each row the sum of its events and the rates of its WORST least likely words; then its words that have open events, and these.

    w numbers words within a batch, o and v are order and value as of Scorer, and v is part of the logp of the word and the row.
    """

    def run(batches):
        import pyarrow as pa

        scorer = held(shared[0], lambda: Scorer(*shared[1].value))

        def lists(of: list[np.ndarray], n_rows: int, names: list[str], columns: list):
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(of), minlength=n_rows) if of else np.zeros(n_rows, int))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=names))

        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        for batch in batches:
            rows, texts = batch.num_rows, batch.column("text").to_pylist()
            seeds = _seed(batch.column("model").to_pylist())
            logp, n, numbered = np.zeros(rows), np.zeros(rows, np.int64), 0
            worst: list[np.ndarray] = [np.zeros(0)] * rows
            word_of, word_id, word_logp, word_n, event_of, event_word, strings, orders, values = ([] for _ in range(9))
            for tags, owners, codes, events in _laid_out(enumerate(texts)):
                tags = np.array(tags)
                value, order = scorer(seeds[tags[owners]], codes, events)
                at = np.flatnonzero(events)
                of, ends = tags[owners[at]], codes[at] == 32
                logp += np.bincount(of, weights=value, minlength=rows)
                n += np.bincount(of, minlength=rows)
                word = np.cumsum(ends) - ends
                sums, sizes, owner = np.bincount(word, weights=value), np.bincount(word), of[np.flatnonzero(ends)]
                open_ = order >= 0
                partly = np.zeros(len(sums), bool)
                partly[word[open_]] = True
                rate = np.where(partly, np.inf, sums / sizes)
                by = np.lexsort((rate, owner))
                starts = np.flatnonzero(np.diff(owner[by], prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
                    mine, k = rate[by[a : min(b, a + WORST)]], owner[by[a]]
                    worst[k] = np.sort(np.concatenate([worst[k], mine[np.isfinite(mine)]]))[:WORST]
                if not open_.any():
                    continue
                some = np.flatnonzero(partly)
                word_of.append(owner[some])
                word_id.append(some + numbered)
                word_logp.append(sums[some])
                word_n.append(sizes[some])
                event_of.append(of[open_])
                event_word.append(word[open_] + numbered)
                orders.append(order[open_])
                values.append(value[open_])
                strings.append(np.ascontiguousarray(codes[at[open_][:, None] + np.arange(1 - ORDER, 1)]).view(f"U{ORDER}").ravel())
                numbered += len(sums)
            words = lists(word_of, rows, ["w", "logp", "n"], [join(word_id, pa.int32()), join(word_logp, pa.float64()), join(word_n, pa.int32())])
            open_events = [join(event_word, pa.int32()), pa.array(np.concatenate(strings).tolist() if strings else [], pa.string()), join(orders, pa.int32()), join(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "trusted", "model")),
                    pa.array(logp),
                    pa.array(n),
                    pa.array([w.tolist() for w in worst], pa.list_(pa.float64())),
                    words,
                    lists(event_of, rows, ["w", "s", "o", "v"], open_events),
                ],
                names=["doc_id", "trusted", "model", "logp", "n", "worst", "words", "events"],
            )

    return run


def open_values(strings: DataFrame, model: DataFrame) -> DataFrame:
    """(model, s, whole, gain) of open events (model, s, o) that any of the count tables has more about.

    The endings of a string from o + 1 characters on are joined with the tables as n-grams, and its contexts from o characters on. The
    longest n-gram found gives its log-probability (whole), else what shorter contexts gave stands; the longer contexts give
    their back-off weights (gain).
    """
    chain = strings.select("model", "s", F.explode(F.sequence(F.col("o"), F.lit(ORDER - 1))).alias("k"))
    grams = chain.select("model", F.col("s").alias("string"), F.expr("right(s, k + 1)").alias("s"), "k")
    contexts = chain.where("k > 0").select("model", F.col("s").alias("string"), F.expr(f"substring(s, {ORDER} - k, k)").alias("s"), "k")
    known = grams.join(model.where("logp is not null").select("model", "s", "logp"), ["model", "s"]).withColumn("back_off", F.lit(None).cast("float"))
    backs = contexts.join(model.where("back_off is not null").select("model", "s", "back_off"), ["model", "s"]).withColumn("logp", F.lit(None).cast("float"))
    both = known.select("model", "string", "k", "logp", "back_off").union(backs.select("model", "string", "k", "logp", "back_off"))
    found = both.groupBy("model", F.col("string").alias("s")).agg(
        F.max(F.when(F.col("logp").isNotNull(), F.struct("k", "logp"))).alias("top"),
        F.collect_list(F.when(F.col("back_off").isNotNull(), F.struct("k", "back_off"))).alias("backs"),
    )
    longer = F.filter("backs", lambda x: x.k > F.coalesce(F.col("top.k"), F.lit(-1)))
    gain = F.aggregate(longer, F.lit(0.0), lambda a, x: a + x.back_off)
    return found.select("model", "s", F.col("top.logp").cast("double").alias("whole"), gain.alias("gain"))


def score(docs: DataFrame, model: DataFrame, most: int | None = None) -> DataFrame:
    """(row, doc_id, trusted, model, logp, n, worst): log-probability and number of predicted characters of each text, and the mean
    log-probability by character of its WORST least likely words.

    docs: doc_id, trusted, model, text. most: how many entries are broadcast (None: HOT_ENTRIES).
    """
    hot = hot_entries(model, HOT_ENTRIES if most is None else most)
    shared = uuid.uuid4().hex, bound_batches(docs).sparkSession.sparkContext.broadcast(hot)
    partial = docs.select("doc_id", "trusted", "model", "text").mapInArrow(trimmed(_score_rows(shared)), SCORED)
    partial = materialize(partial.withColumn("row", F.monotonically_increasing_id()), "partial")
    made = ["row", "doc_id", "trusted", "model", "logp", "n", "worst"]
    if hot[-2] is None:
        return partial.select(*made[:-1], _mean("worst"))
    events = partial.select("row", "model", F.explode("events").alias("e")).select("row", "model", "e.w", "e.s", "e.o", "e.v")
    values = open_values(events.groupBy("model", "s").agg(F.first("o").alias("o")), model)
    step = F.coalesce("gain", F.lit(0.0)) + F.coalesce(F.col("whole") - F.col("v"), F.lit(0.0))
    gains = events.join(materialize(values, "open"), ["model", "s"]).groupBy("row", "w").agg(F.sum(step).alias("gain"))
    words = partial.select("row", F.explode("words").alias("x")).select("row", "x.w", "x.logp", "x.n").join(gains, ["row", "w"], "left")
    gain = F.coalesce("gain", F.lit(0.0))
    by_row = words.groupBy("row").agg(F.sum(gain).alias("gain"), F.sort_array(F.collect_list((F.col("logp") + gain) / F.col("n"))).alias("rates"))
    rates = F.sort_array(F.concat("worst", F.coalesce(F.slice("rates", 1, WORST), F.array().cast("array<double>"))))
    whole_rows = partial.select(*made).join(by_row, "row", "left")
    return whole_rows.withColumns({"worst": F.slice(rates, 1, WORST), "logp": F.col("logp") + gain}).select(*made[:-1], _mean("worst"))


def _mean(name: str) -> Column:
    return (F.aggregate(name, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(name), F.lit(1))).alias(name)


def choose_models(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs (fold, lang, ...) with the name of the model that scores each; null where there is no model at all.

    names: model. A text's model is its language's of the other fold, or else "*" of that fold; if the other fold has no model, its
    own fold's serve.
    """
    folds = {r.fold for r in names.select(F.substring_index("model", ":", 1).cast("int").alias("fold")).distinct().collect()}
    serving = F.lit(None).cast("string")
    for k in range(FOLDS):
        others = [f for f in (*range(k + 1, FOLDS), *range(k + 1)) if f in folds]
        if others:
            serving = F.when(F.col("fold") == k, F.lit(str(others[0]))).otherwise(serving)
    known = F.broadcast(names.select(F.col("model").alias("__known")))
    joined = docs.join(known, F.concat(serving, F.lit(":"), "lang") == F.col("__known"), "left")
    return joined.withColumn("model", F.coalesce("__known", F.concat(serving, F.lit(":" + ANY)))).drop("__known")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, worst, worst_threshold, trusted, kept) of each document.

    docs: doc_id, text, lang. labels: doc_id, quality, toxic; trusted are documents of quality 1 that are not toxic. worst is the perplexity of the
    document's WORST least likely words. The thresholds are the quantile of both figures over the trusted documents whose texts
    the same language's models of the other fold scored (over all trusted ones, where there are none).
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    good = good.where("q = 1 and x = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted"))
    good = materialize(good, "trusted")
    # Ids of texts are broadcast up to a checked number; beyond it the texts are shuffled to them.
    near = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    top = count(plain.join(near, "doc_id", "left_semi").where("text is not null").select("fold", "lang", "text"))
    names = materialize(top.select("model").distinct(), "names")
    asked = docs.select(F.col("lang").cast("string").alias("lang")).distinct().withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS)))))
    used = materialize(choose_models(asked, names).where("model is not null").select("model").distinct(), "used")
    model = train(count_for(top, used))
    named = choose_models(plain.join(near, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))), names)
    modelled = F.coalesce("model", F.lit("0:" + ANY))
    scored = score(named.select("doc_id", "trusted", modelled.alias("model"), F.when(F.col("model").isNotNull(), F.col("text")).alias("text")), model)
    lang = F.expr("substring(model, length(substring_index(model, ':', 1)) + 2)")
    judged = scored.select("doc_id", "trusted", lang.alias("lang"), F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"), F.when(F.col("n") > 0, F.exp(-F.col("worst"))).alias("worst"))
    judged = materialize(judged, "judged")
    least = [F.percentile_approx(c, quantile, 10_000).alias(t) for c, t in (("perplexity", "threshold"), ("worst", "worst_threshold"))]
    held = judged.where("trusted and perplexity is not null")
    limits, overall = held.groupBy("lang").agg(*least), held.agg(*least).first()
    judged = judged.join(F.broadcast(limits), "lang", "left")
    for name in ("threshold", "worst_threshold"):
        judged = judged.withColumn(name, F.coalesce(name, F.lit(overall[name]).cast("double")))
    kept = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold")), F.lit(False))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "worst", "worst_threshold", "trusted", kept.alias("kept"))


def quality_lm_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
