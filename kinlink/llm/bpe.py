"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no vocabulary token can never end up in one token,
because every merge makes a token. Such pairs are certain cuts: the fragments between them are encoded
independently, and their ids concatenated. A word's last byte is a symbol of its own (the vocabulary
marks word ends), and no symbol follows it inside a token, so words are fragments at least.

The tokenizer file, whose path is a parameter, is read by the driver and broadcast; it may have MAX_FILE bytes.

Defined results: a null text is encoded like an empty one, to no ids; the strings of the special
tokens become their ids, wherever they stand; columns named like the outputs are replaced; rows
are independent, so repeated rows give equal results and very long texts only take time in proportion.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinlink.llm.workdir import bound_batches, held, trimmed

DEFAULT_FILE = "word_bpe_49k.json"
MAX_FILE = 64 << 20
CACHE_WORDS = 250_000
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}

# The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _piece_pattern(letter: str, number: str) -> str:
    """Contractions, runs of letters, single numerals, runs of anything else but white space."""
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE_SPACE}{letter}{number}]+"


def _latin_classes() -> tuple[str, str]:
    """Letters and numerals below U+0250, for Python's faster regular expressions."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(0x250)}
    return tuple("".join(re.escape(chr(c)) for c, k in kinds.items() if k == want) for want in "LN")


class WordCodec:
    """Encoder and decoder of one vocabulary with marked word ends."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self._check(spec, model)
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.symbols = byte_symbols()
        inner = [vocab[s] for s in self.symbols]
        self.symbol_ids = inner, [vocab[s + END] for s in self.symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.joined = self._pairs_inside(vocab)
        latin = _latin_classes()
        self.latin = re.compile(_piece_pattern(*latin))
        import regex

        self.general = regex.compile(_piece_pattern(r"\p{L}", r"\p{N}"))
        self.beyond_latin = re.compile("[^\x00-ɏ]")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.words = _WordCache(self)

    @staticmethod
    def _check(spec: dict, model: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-casing BPE vocabulary with marked word ends")

    def _pairs_inside(self, vocab: dict[str, int]) -> np.ndarray:
        """joined[x, y]: whether symbol y follows x inside a token; word-final symbols are numbered from 256."""
        number = {s: b for b, s in enumerate(self.symbols)}
        joined = np.zeros((512, 512), dtype=bool)
        for token in vocab:
            final = token.endswith(END) and token != END
            s = [number[c] for c in (token.removesuffix(END) if final else token)]
            if final:
                s[-1] += 256
            joined[s[:-1], s[1:]] = True
        return joined

    def fragments(self, word: bytes) -> list[list[int]]:
        """A word's symbols, cut where no token can reach across."""
        s = list(word)
        s[-1] += 256
        cuts = [i + 1 for i in range(len(s) - 1) if not self.joined[s[i], s[i + 1]]]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def encode_fragment(self, fragment: list[int]) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        inner, final = self.symbol_ids
        ids = [inner[x] if x < 256 else final[x - 256] for x in fragment]
        merges = self.merges
        none = (1 << 40, 0)
        while len(ids) > 1:
            found = [merges.get(ids[k] << 20 | ids[k + 1], none) for k in range(len(ids) - 1)]
            best = min(found)
            if best is none:
                break
            out, k = [], 0
            while k < len(ids):
                if k < len(found) and found[k] == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def encode_word(self, word: str) -> bytes:
        """Ids of a normalised word, as little-endian unsigned 32-bit integers."""
        ids = [i for f in self.fragments(word.encode("utf-8")) for i in self.encode_fragment(f)]
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # every sigma alike, whether at a word's end or not
        pattern = self.general if self.beyond_latin.search(text) else self.latin
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._encode_plain(text)
        return b"".join(
            np.array([self.specials[part]], dtype="<u4").tobytes() if part in self.specials else self._encode_plain(part)
            for part in self.special_pattern.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The tokens of ids with blanks between them, as this vocabulary, which names no decoder, has it."""
        return " ".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def to_text(self, ids: bytes) -> str:
        """Readable text: word ends become blanks, symbols become bytes again."""
        number = {s: b for b, s in enumerate(self.symbols)}
        tokens = (self.token_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist())
        raw = b"".join(bytes(number.get(c, 63) for c in t.removesuffix(END)) + b" " * t.endswith(END) for t in tokens)
        return raw.decode("utf-8", "replace").rstrip(" ")


class _WordCache(dict):
    """Ids by word, filled when asked; emptied when full, so that memory stays bounded."""

    def __init__(self, codec: WordCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.codec.encode_word(word)
        return ids


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        file = f.read(MAX_FILE + 1)
    if len(file) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    return file


def codec(path: str) -> WordCodec:
    return WordCodec(read_file(path))


def encode_documents(
    docs: DataFrame,
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    keep: tuple[str, ...] | None = None,
    path: str | None = None,
) -> DataFrame:
    """The kept columns (None: all) and the chosen OUTPUTS of each row's text, encoded and decoded again."""
    file = read_file(path or default_path())
    name, shared = hashlib.sha256(file).hexdigest(), docs.sparkSession.sparkContext.broadcast(file)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    # The last column is the text; in Python columns go by place, whatever their names.
    source = bound_batches(docs).select(*[docs[c].alias(f"c{k}") for k, c in enumerate(kept)], docs[text_col].cast("string").alias("text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])

    def run(batches):
        import pyarrow as pa

        words = held(name, lambda: WordCodec(shared.value))
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [words.encode(t) for t in batch.column(len(kept)).to_pylist()]
                made = {"n_tokens": [len(x) // 4 for x in ids]} if "n_tokens" in outputs else {}
                if "ids" in outputs:
                    made["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                if {"decoded", "decoded_sha256"} & set(outputs):
                    texts = [words.decode(x) for x in ids]
                    made["decoded"] = texts
                    made["decoded_sha256"] = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    batch.columns[: len(kept)] + [pa.array(made[o], type=kinds.get(o, pa.string())) for o in outputs],
                    names=[*kept, *outputs],
                )

    return source.mapInArrow(trimmed(run), schema)


def bpe_digest(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))
