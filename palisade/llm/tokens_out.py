"""Token ids as Parquet list columns that can be read selectively.

Files are written by Spark in ascending document order, with a bounded row group size, small pages with page indexes
(so a reader skips to the pages of a document range) and the metadata columns apart from the ids, which are
dictionary-encoded while few distinct ids are in a row group and delta-encoded (format version 2) beyond.

Encoding goes through the tokenizers library. It is called on the distinct runs of non-white characters of each batch:
the tokenizer drops white space and never joins across it, so a text's ids are those of its runs, one after another.

Nulls: a null text is an empty one, with the end id alone. Null ids sort first. Rows of equal id keep an order given
by a hash of their text.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_path

END_ID = 1
MEMO_SIZE = 250_000
#: Fixed value: how the vocabulary marks tokens that end a word. Marks that may follow a word (none that contractions or
#: special tokens have); words in one text.
WORD_END, TAILS, GROUP = "</w>", b".,;:!?*#%&$@^~+=-_/()[]{}", 256
#: Letters below are in every version of Unicode, with the same case and composition.
LATIN_END = "\u0250"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Parquet layout: row groups of 32 MB, pages of 64 KB with column and offset indexes, dictionaries of up to 1 MB.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "parquet.columnindex.truncate.length": "64", "compression": "zstd"}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, with the ids of runs of non-white characters remembered in a table of bounded size."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the memo before; frequent runs come back from it
        # For words that normalisation leaves alone: the same model, words cut at spaces.
        self.bare = Tokenizer.from_file(path)
        self.bare.no_truncation()
        self.bare.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers."""
        split = [_runs(t or "") for t in texts]
        if len(self.memo) > MEMO_SIZE:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        need, tails, known = set(), [], older.get

        def ask(w: bytes) -> None:
            packed = known(w)
            if packed is None:
                need.add(w)
            else:
                memo[w] = packed

        for w in set().union(*split).difference(memo):
            word = w.rstrip(TAILS)
            if len(word) < len(w) and word and word[-1] in LETTERS:
                # A letter and the marks after it are never one token: the run's ids are those of its parts.
                packed = known(w)
                if packed is not None:
                    memo[w] = packed
                    continue
                mark = w[len(word) :]
                tails.append((w, word, mark))
                if word not in memo:
                    ask(word)
                if mark not in memo:
                    ask(mark)
            else:
                ask(w)
        self._encode(list(need))
        for w, word, mark in tails:
            memo[w] = memo[word] + memo[mark]
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    def _encode(self, runs: list[bytes]) -> None:
        """Ids of new runs by the library. Runs of letters alone are one word each, so many go in one text, cut at word ends."""
        bare, plain, other = [], [], []
        for w in runs:
            if w.isalpha() and w.islower():  # of bytes: a-z only
                bare.append(w)
                continue
            t = w.decode()
            if not t.isalpha():
                other.append(w)
            elif max(t) < LATIN_END and t == t.lower() and unicodedata.is_normalized("NFC", t):
                bare.append(w)
            else:
                plain.append(w)
        other += self._encode_words(bare, self.bare) + self._encode_words(plain, self.tokenizer)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Ids of words, GROUP to a text; returns those that were letters to Python but aren't to the tokenizer."""
        left, memo = [], self.memo
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(group) or at[-1] != len(ids):
                left += group
                continue
            packed = ids.tobytes()
            bounds = [0, *(4 * at).tolist()]
            for w, i, j in zip(group, bounds, bounds[1:], strict=False):
                memo[w] = packed[i:j]
        return left


def _runs(text: str) -> list[bytes]:
    """The text's runs of characters other than ASCII white space, A-Z in lower case where that changes no id.

    The tokenizer lowers letters itself, but after composing them with the marks that follow (lead bytes CC and CD), and
    not within special tokens.
    """
    data = text.encode()
    if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
        data = data.lower()
    return data.split()


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes doc_id, part, start_in_part, n_tokens, tokens of every document to Parquet files in ascending doc_id order."""
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = Encoder.of(tokenizer), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in pieces(batch, "text"):
                packed = [p + end for p in encoder.encode_all(part.column("text").to_pylist())]
                lengths = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + ends - lengths), pa.array(lengths), ids], names=["doc_id", "start_in_part", "n_tokens", "tokens"])
                start += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    out = ordered.drop("tie").mapInArrow(run, f"doc_id {kind}, start_in_part long, n_tokens long, tokens array<int>")
    out.withColumn("part", F.spark_partition_id()).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens from the files; start counts all ids of documents before. Columns that aren't used aren't read."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))  # one row a file: as many as there were write tasks
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows from read_tokens()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tokens")
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            at = [4 * x for x in ids.offsets.to_pylist()]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of docs to the shared folder and returns the digest columns read back from them."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return checksums(read_tokens(docs.sparkSession, path))
