"""Language identification: words first, shorter and shorter character n-grams after.

The model is a table of log frequencies by language. A word that is known scores by its own frequency in each language.
An unseen word is scored by its character n-grams of the greatest length of which any is known: first 4, then 3, 2, 1.
Each word gives the languages a bounded vote, and a document's score is the posterior share of its best language.

Counting covers all training documents: each task counts words by language before the shuffle, and the
n-grams are counted from the distinct words. All words, n-grams and languages count in scoring. The most frequent words
(MAX_WORDS of each language, with their counts in all) are broadcast, the others joined; n-grams of words never seen are looked
up in packs that are broadcast in turn. Counts fall into eight levels an octave, and the highest levels that fit as a whole are broadcast.

Defined results: a null text or one without a letter is "und" with score 0; training rows without a language
or text are skipped; without any training row everything is "und" with score 0; ties between
languages go to the first by name; repeated rows are scored alike; texts of any length are read whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm import textkit
from kinlink.llm.workdir import bound_batches, held, materialize, trimmed

MAX_WORDS = 50_000  # of each language are broadcast; the others are joined
COMMON_VALUES = 8_000_000  # most numbers broadcast for them; with many languages fewer words are
PACK_VALUES = 4_000_000
BROADCAST_TEXTS = 1_000_000
ORDERS = (4, 3, 2, 1)
VOTE = 4.0  # the most by which one word may part two languages, as a natural logarithm
UNDETERMINED = "und"

def _letters_and_marks() -> str:
    """A pattern of runs of letters and combining marks, so that marks do not cut words of scripts that write vowels with them."""
    inside = [unicodedata.category(chr(k))[0] in "LM" for k in range(sys.maxunicode + 1)]
    edges = [k for k in range(1, len(inside)) if inside[k] != inside[k - 1]]
    ranges = zip(edges[::2], [e - 1 for e in edges[1::2]] + [sys.maxunicode] * (len(edges) % 2), strict=False)
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+"


_LETTERS = re.compile(_letters_and_marks())
#: The same for texts without characters from U+0300 on, and much faster.
_LATIN_LETTERS, _BEYOND = re.compile(r"[^\W\d_²³¹¼½¾]+"), re.compile("[\u0300-\U0010ffff]")


def words_in(text: str | None) -> list[str]:
    """Runs of letters and marks, lower-cased. A run of marks alone is no word: see has_letter."""
    text = (text or "").lower()
    return (_LETTERS if _BEYOND.search(text) else _LATIN_LETTERS).findall(text)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; for n = 1 its letters."""
    if n == 1:
        return list(word)
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _count_words(flush_at: int = 200_000):
    def run(batches):
        import pyarrow as pa

        counts: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if has_letter(w)]
            counts.clear()
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_in(text))
                if sum(map(len, counts.values())) > flush_at:
                    yield flush()
        yield flush()

    return run


def _count_grams(flush_at: int = 200_000):
    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()

        def flush():
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in rows], pa.string()),
                    pa.array([k[1] for k, _ in rows], pa.int32()),
                    pa.array([k[2] for k, _ in rows], pa.string()),
                    pa.array([n for _, n in rows], pa.int64()),
                ],
                names=["lang", "size", "gram", "n"],
            )

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in ORDERS:
                    for g in grams_of(word, size):
                        counts[lang, size, g] += n
                if len(counts) > flush_at:
                    yield flush()
        yield flush()

    return run


def _binary(rows: np.ndarray):
    """An Arrow column with the bytes of each row."""
    import pyarrow as pa

    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _log_counts(found: list, langs: list[str], totals: dict[tuple[str, int], int], sizes: list[int]) -> np.ndarray:
    """Log frequencies, a row over the languages for each entry. found: (languages, counts) of each entry; where it was not counted it is as if seen half a time."""
    at = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((len(found), len(langs)))
    for k, (where, n) in enumerate(found):
        counts[k, [at[lang] for lang in where]] = n
    total = {size: np.log([totals.get((lang, size), 0) + 2 for lang in langs]) for size in set(sizes)}
    return np.log(counts + 0.5) - np.array([total[size] for size in sizes]).reshape(counts.shape)


def _votes(scores: np.ndarray) -> np.ndarray:
    return np.maximum(scores - scores.max(axis=1, keepdims=True), -VOTE)


def _gram_keys(names: list[str], size: int) -> np.ndarray:
    return textkit.string_keys(list(np.array(names, dtype=f"U{size}").view(np.uint32).reshape(-1, size).T))


def gram_sums(grams: dict[int, tuple[np.ndarray, np.ndarray]], words: list[str], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word and n-gram length the sum of the log frequencies of its n-grams in grams (sorted keys, rows), and their number."""
    sums, hits = np.zeros((len(words), len(ORDERS), n_langs)), np.zeros((len(words), len(ORDERS)), np.int64)
    for o, size in enumerate(ORDERS):
        if not words or size not in grams:
            continue
        framed = [f" {w} " if size > 1 else w for w in words]
        chars = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in framed])
        end = len(chars) - size + 1
        if end <= 0:
            continue
        keys, table = grams[size]
        wanted = textkit.string_keys([chars[k : k + end] for k in range(size)])
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = (owner[:end] == owner[size - 1 :]) & (keys[at] == wanted)
        of, at = owner[:end][hit], at[hit]
        hits[:, o] = np.bincount(of, minlength=len(words))
        for j in range(n_langs):
            sums[:, o, j] = np.bincount(of, weights=table[at, j], minlength=len(words))
    return sums, hits


def _longest_known(sums: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Scores from the greatest length of which an n-gram is known; zeros where none is."""
    first, some = (hits > 0).argmax(axis=1), (hits > 0).any(axis=1)
    rows = np.arange(len(hits))
    return np.where(some[:, None], sums[rows, first] / np.maximum(hits[rows, first], 1)[:, None], 0.0)


class LanguageModel:
    """Counts of words and n-grams by language, as tables of Spark; the most frequent words are held in memory too.

    words: word, lang, n. grams: size, gram, langs, ns. common: the words in memory and their log frequencies, a row over the languages for each.
    """

    def __init__(self, langs: list[str], totals: dict | None = None, words: DataFrame | None = None, grams: DataFrame | None = None, common: tuple | None = None):
        self.langs, self.totals, self.words, self.grams = langs, totals or {}, words, grams
        self.common = common or ([], np.zeros((0, len(langs))))

    @cached_property
    def tables(self) -> dict[int, tuple[list[str], np.ndarray]]:
        """Entries and their rows by n-gram length; 0 has the common words. Brings all n-grams to the driver: for small models."""
        out = {0: self.common}
        for size in ORDERS:
            rows = self.grams.where(F.col("size") == size).collect() if self.grams is not None else []
            out[size] = [r.gram for r in rows], _log_counts([(r.langs, r.ns) for r in rows], self.langs, self.totals, [size] * len(rows))
        return out

    @cached_property
    def index(self) -> dict[int, dict[str, int]]:
        return {size: {g: k for k, g in enumerate(names)} for size, (names, _) in self.tables.items()}

    def vote(self, word: str) -> np.ndarray:
        """How far each language is behind the best for a common word or one never seen, VOTE at most. For small models."""
        score, k = None, self.index[0].get(word)
        if k is not None:
            score = self.tables[0][1][k]
        else:
            for size in ORDERS:
                index = self.index[size]
                known = [k for g in grams_of(word, size) if (k := index.get(g)) is not None]
                if known:
                    score = self.tables[size][1][known].sum(axis=0) / len(known)
                    break
        if score is None:
            return np.zeros(len(self.langs))
        return np.maximum(score - score.max(), -VOTE)

    def gram_packs(self):
        """The n-grams with their log frequencies, in packs of about PACK_VALUES numbers: sorted keys and rows by length."""
        langs, totals = self.langs, self.totals

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                sizes, names, where, ns = (batch.column(c).to_pylist() for c in ("size", "gram", "langs", "ns"))
                keys = np.zeros(len(names), np.uint64)
                for size in set(sizes):
                    rows = [k for k, x in enumerate(sizes) if x == size]
                    keys[rows] = _gram_keys([names[k] for k in rows], size)
                made = _log_counts(list(zip(where, ns, strict=True)), langs, totals, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array(keys.view(np.int64)), _binary(made)], names=["size", "key", "logs"])

        n = -(-self.grams.count() * len(langs) // PACK_VALUES)
        for p in range(n):
            mine = self.grams.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == p)
            got = mine.mapInArrow(run, "size int, key long, logs binary").toArrow()
            sizes, keys = (got.column(c).to_numpy() for c in ("size", "key"))
            table = np.frombuffer(b"".join(got.column("logs").to_pylist())).reshape(-1, len(langs))
            pack = {}
            for size in np.unique(sizes).tolist():
                k = keys[sizes == size].view(np.uint64)
                order = np.argsort(k)
                pack[size] = k[order], table[sizes == size][order]
            yield pack


class Predictor:
    """Votes of many words under a small model, made together with array operations."""

    def __init__(self, model: LanguageModel):
        self.model, self.grams = model, {}
        for size in ORDERS:
            names, table = model.tables[size]
            if names:
                keys = _gram_keys(names, size)
                order = np.argsort(keys)
                self.grams[size] = keys[order], table[order]

    def scores(self, words: list[str]) -> np.ndarray:
        """What LanguageModel.vote gives, for many words."""
        out = _longest_known(*gram_sums(self.grams, words, len(self.model.langs)))
        known = np.array([self.model.index[0].get(w, -1) for w in words])
        out[known >= 0] = self.model.tables[0][1][known[known >= 0]]
        return _votes(out)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count words and n-grams of all rows with a language and a text."""
    known = bound_batches(rows).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = known.mapInArrow(trimmed(_count_words()), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "words")
    grams = words.mapInArrow(trimmed(_count_grams()), "lang string, size int, gram string, n long")
    grams = grams.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    grams = materialize(grams.groupBy("size", "gram").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns")), "grams")
    levels = words.groupBy("lang", "level").agg(F.count("*").alias("entries"), F.sum("n").alias("n")).collect()
    totals, cuts = {}, {}
    n_langs = len({r.lang for r in levels})
    if not n_langs:
        return LanguageModel([])
    most = min(MAX_WORDS, COMMON_VALUES // n_langs**2)
    for r in sorted(levels, key=lambda r: -r.level):
        totals[r.lang, 0] = totals.get((r.lang, 0), 0) + r.n
        left, cut = cuts.get(r.lang, (most, r.level + 1))
        cuts[r.lang] = (left - r.entries, r.level) if left >= r.entries else (-1, cut)
    flat = grams.select("size", F.explode(F.arrays_zip("langs", "ns")).alias("x")).groupBy("size", "x.langs").agg(F.sum("x.ns").alias("n"))
    totals |= {(r.langs, r.size): r.n for r in flat.collect()}
    langs = sorted(cuts)
    # A word that is common in one language is held with its counts in all.
    least = words.sparkSession.createDataFrame([(lang, cut) for lang, (_, cut) in cuts.items()], "lang string, cut int")
    chosen = words.join(F.broadcast(least), "lang").where("level >= cut").select("word").distinct()
    table = words.join(F.broadcast(chosen), "word").select("word", "lang", "n").toArrow()
    by_word: dict[str, tuple[list, list]] = {}
    for word, lang, n in zip(*(table.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True):
        where, ns = by_word.setdefault(word, ([], []))
        where.append(lang)
        ns.append(n)
    common = list(by_word), _log_counts(list(by_word.values()), langs, totals, [0] * len(by_word))
    return LanguageModel(langs, totals, words.select("word", "lang", "n"), grams, common)


def _kept_index(shared) -> tuple[dict[str, int], np.ndarray]:
    """The broadcast common words and their votes."""

    def make():
        names, votes = shared[1].value
        return {w: k for k, w in enumerate(names)}, votes

    return held(shared[0], make)


def _tally(text: str | None) -> Counter:
    counts = Counter(words_in(text))
    if counts and not any(map(str.isalpha, counts)):
        counts = Counter({w: n for w, n in counts.items() if has_letter(w)})
    return counts


def _sum_common(shared, kept: list[str], n_langs: int):
    """Rows with the sum of their common words' votes, and their other words."""

    def run(batches):
        import pyarrow as pa

        index, votes = _kept_index(shared)
        for batch in batches:
            sums, rare, ns = np.zeros((batch.num_rows, n_langs)), [], []
            some = []
            for k, text in enumerate(batch.column("__text").to_pylist()):
                counts = _tally(text)
                at = np.fromiter((index.get(w, -1) for w in counts), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                known = at >= 0
                sums[k] = n[known].astype(float) @ votes[at[known]]
                names = list(counts)
                rare.append([names[i] for i in np.flatnonzero(~known)])
                ns.append(n[~known].tolist())
                some.append(bool(counts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(some), _binary(sums), pa.array(rare, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int64()))],
                names=[*kept, "__some", "__sums", "__rare", "__ns"],
            )

    return run


def _votes_of_counted(langs: list[str], totals: dict):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(zip(batch.column("langs").to_pylist(), batch.column("ns").to_pylist(), strict=True))
            made = _votes(_log_counts(found, langs, totals, [0] * len(found))) if found else np.zeros((0, len(langs)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), _binary(made)], names=["word", "votes"])

    return run


def _sums_of_pack(shared, n_langs: int):
    step = max(1, PACK_VALUES // (4 * len(ORDERS) * n_langs))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, step):
                words = batch.column("word").slice(k, step)
                sums, hits = gram_sums(shared.value, words.to_pylist(), n_langs)
                yield pa.RecordBatch.from_arrays([words, _binary(sums), _binary(hits)], names=["word", "sums", "hits"])

    return run


def _votes_of_unseen(n_langs: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.zeros((batch.num_rows, n_langs))
            for k, (sums, hits) in enumerate(zip(batch.column("sums").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                whole = np.frombuffer(b"".join(sums)).reshape(len(sums), len(ORDERS), n_langs).sum(axis=0)
                out[k] = _longest_known(whole[None], np.frombuffer(b"".join(hits), np.int64).reshape(len(hits), -1).sum(axis=0)[None])[0]
            yield pa.RecordBatch.from_arrays([batch.column("word"), _binary(_votes(out))], names=["word", "votes"])

    return run


def _rare_votes(words: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, votes) of distinct words by the whole tables: by their counts, or if never seen by their n-grams."""
    n_langs, spark = len(model.langs), words.sparkSession
    counted = words.join(model.words, "word", "left").groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"))
    counted = materialize(counted, "looked-up")
    votes = counted.where(F.size("langs") > 0).mapInArrow(trimmed(_votes_of_counted(model.langs, model.totals)), "word string, votes binary")
    unseen = counted.where(F.size("langs") == 0).select("word")
    if unseen.isEmpty():
        return votes
    parts = [unseen.mapInArrow(trimmed(_sums_of_pack(spark.sparkContext.broadcast(pack), n_langs)), "word string, sums binary, hits binary") for pack in model.gram_packs()]
    sums = reduce(DataFrame.union, parts).groupBy("word").agg(F.collect_list("sums").alias("sums"), F.collect_list("hits").alias("hits"))
    return votes.union(sums.mapInArrow(trimmed(_votes_of_unseen(n_langs)), "word string, votes binary"))


def _decide(kept: list[str], langs: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for some, sums, ns, votes in zip(*(batch.column(c).to_pylist() for c in ("__some", "__sums", "__n", "__votes")), strict=True):
                if not some:
                    found.append((UNDETERMINED, 0.0))
                    continue
                total = np.frombuffer(sums)
                if ns:
                    total = total + np.array(ns, float) @ np.frombuffer(b"".join(votes)).reshape(len(ns), -1)
                share = np.exp(total - total.max())
                best = int(total.argmax())
                found.append((langs[best], float(share[best] / share.sum())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; columns of these names are replaced.

    Common words are broadcast. The others are written with the columns of docs, joined with the whole tables as distinct words,
    and their votes joined with the rows, so nothing that is broadcast or held grows with the input.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    if not model.langs:
        return docs.select(*names).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    # Inner names, so that no column of docs clashes with the ones made here.
    kept = [f"c{k}" for k in range(len(names))]
    docs = docs.select(*[docs[c].alias(k) for c, k in zip(names, kept, strict=True)], docs[text_col].cast("string").alias("__text"))
    common, logs = model.common
    shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((common, _votes(logs) if len(logs) else logs))
    source = bound_batches(docs)
    fields = [docs.schema[c] for c in kept]
    first = T.StructType([*fields, *T._parse_datatype_string("__some boolean, __sums binary, __rare array<string>, __ns array<long>").fields])
    partial = source.mapInArrow(trimmed(_sum_common(shared, kept, len(model.langs))), first)
    partial = materialize(partial.withColumn("__row", F.monotonically_increasing_id()), "partial")
    rare = partial.select("__row", F.explode(F.arrays_zip("__rare", "__ns")).alias("x")).select("__row", F.col("x.__rare").alias("word"), F.col("x.__ns").alias("n"))
    votes = _rare_votes(rare.select("word").distinct(), model)
    summed = rare.join(votes, "word").groupBy("__row").agg(F.collect_list("n").alias("__n"), F.collect_list("votes").alias("__votes"))
    whole = partial.drop("__rare", "__ns").join(summed, "__row", "left").select(*kept, "__some", "__sums", "__n", "__votes")
    made = whole.mapInArrow(trimmed(_decide(kept, model.langs)), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return made.toDF(*names, "lang_pred", "score")


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id_digest(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", "text", "lang", held_out(docs).alias("held_out"))
    model = train(marked.where("not held_out"))
    return predict_languages(marked.select("doc_id", "held_out", "text"), model, keep_text=False)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """docs without those whose language stays undetermined or scores below min_score; columns as they are.

    Texts are judged by two 64-bit hashes of them, so documents are read again but not shuffled or written, unless very many are dropped.
    """
    inner = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    text = F.col(inner[docs.columns.index(text_col)]).cast("string")
    keys = {"__h1": F.xxhash64(F.lit(1), text), "__h2": F.xxhash64(F.lit(2), text)}
    judged = predict_languages(plain.select(text.alias("text"), *[k.alias(n) for n, k in keys.items()]).select("__h1", "__h2", "text"), model, keep_text=False)
    unclear = judged.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_score)).select("__h1", "__h2").distinct()
    unclear = materialize(unclear, "unclear")
    unclear = F.broadcast(unclear) if unclear.count() <= BROADCAST_TEXTS else unclear
    return plain.withColumns(keys).join(unclear, ["__h1", "__h2"], "left_anti").select(*inner).toDF(*docs.columns)
