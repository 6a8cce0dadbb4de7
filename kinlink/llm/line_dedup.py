"""Line-level deduplication across a corpus.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines over
the threshold are dropped everywhere but in the largest document id, and the rest is
reassembled by position. Only 16-byte hashes and positions are shuffled for the counting; the
texts move once, in the final join, and only where the list of positions is too large to broadcast.

Defined results: a null or empty text is one empty line; rows without a doc_id count together as
one further document, ranked below all ids; repeated rows (same id and text) are one document and
all get the same result; a line that occurs several times in the largest document stays
there every time; texts of any length are read whole; a text that loses all its lines becomes empty; columns of the input other than
the id and the text pass through untouched, whatever their names, except that columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.workdir import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def line_key(line: Column) -> Column:
    """What makes two lines equal: stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def find_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(r1, r2, drops): positions to drop for each document row that loses lines.

    r1 and r2 are the two hashes of the row, see row_hashes().
    """
    lines = docs.select(
        *row_hashes(docs, id_col, text_col),
        F.col(id_col).alias("id"),
        F.posexplode(F.transform(split_lines(F.col(text_col)), line_key)).alias("pos", "key"),
    ).where(F.length("key") >= min_chars)
    keyed = lines.select("r1", "r2", "id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # A document holding a line many times is counted once: documents are first made distinct per line.
    per_doc = keyed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    # Written, so that the join below has both sides freshly dealt and may split a line that very many documents share.
    common = materialize(
        per_doc.groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "last"),
        "common-lines",
    )
    dropped = keyed.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    placed = materialize(dropped.select("r1", "r2", "pos"), "dropped-lines")
    return placed.groupBy("r1", "r2").agg(F.collect_set("pos").alias("drops"))


def row_hashes(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes naming a row by id and text, null-safe."""
    return [
        F.xxhash64(F.lit(s), F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias(f"r{s}") for s in (1, 2)
    ]


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """docs with the text cleaned, and n_lines and n_dropped added.

    A line's key (see line_key) of at least min_chars code points found in at least min_docs
    documents is dropped from all but the largest document id that holds it.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Inner names, so that no column of docs clashes with the ones made here; the text goes through the join as its lines.
    inner = {c: f"c{k}" for k, c in enumerate(kept)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in inner.items()])
    drops = find_repeated_lines(plain, inner[id_col], inner[text_col], min_chars, min_docs)
    text = F.col(inner[text_col])
    marked = plain.select(*[c for c in inner.values() if c != inner[text_col]], F.split(text, "\n", -1).alias("lines"), *row_hashes(plain, inner[id_col], inner[text_col]))
    joined = marked.join(drops, ["r1", "r2"], "left")
    size = F.greatest(F.size("lines"), F.lit(1))
    places = F.array_except(F.sequence(F.lit(0), size - 1), F.coalesce("drops", F.array().cast("array<int>")))
    left = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return joined.select(
        *[(F.array_join(left, "\n") if c == text_col else F.col(n)).alias(c) for c, n in inner.items()],
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated lines dropped from the texts; a column for their length, if there is one, is kept true."""
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]
    cleaned = dedup_lines(docs.toDF(*inner), inner[names.index(id_col)], inner[names.index(text_col)]).select(*inner)
    if length_col in names:
        at = inner[names.index(length_col)]
        cleaned = cleaned.withColumn(at, F.length(inner[names.index(text_col)]).cast(docs.schema[length_col].dataType))
    return cleaned.toDF(*names)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays of each text."""
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, (c.k IS NOT NULL AND l.doc_id <> c.last_doc) AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
