"""Encoding of a whole corpus with a public byte-level BPE tokenizer, each distinct word encoded once.

1. Texts are split into pre-tokens by one regular expression, JVM-side. Blocks of documents turn their
   pre-tokens into (distinct words of the block, position of each pre-token's word among them), so the
   shuffle that follows moves each word once a block instead of once an occurrence.
2. The distinct words of all blocks are shuffled together and encoded once each.
3. The ids are joined back to the words, gathered per block in word order, joined to the block's
   documents, and laid out by position.

Defined cases: null, empty and unencodable texts give an empty list; texts are taken whole, whatever
their length; a text with characters that Java's Unicode tables lack is split by the tokenizer's own
splitter; repeated documents and ids are encoded each; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

TOKENIZERS = "/opt/tokenizers"

#: The published splitting rule of byte-level BPE; white space is Unicode's, spelled out for Java.
_SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'(?:[sdmt]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Documents and pre-tokens of one block: more give fewer distinct words in all, fewer give smaller rows. One longer document is a block of its own.
BLOCK, BLOCK_WORDS = 4096, 1 << 21


def split_words(text: Column) -> Column:
    """Pre-tokens of a text in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def _cuts(sizes: list[int]) -> list[int]:
    """Where the blocks of a batch begin, and its end, for documents of ``sizes`` pre-tokens."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes):
        if i > cuts[-1] and (i - cuts[-1] >= BLOCK or held + n > BLOCK_WORDS):
            cuts.append(i)
            held = 0
        held += n
    return [*cuts, len(sizes)]


def _blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, splitter = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            # a text for the tokenizer's own splitter counts by its characters, which are no fewer than its pre-tokens
            sizes = [n or m or 0 for n, m in zip(pc.list_value_length(batch.column(1)).to_pylist(), pc.utf8_length(batch.column(2)).to_pylist(), strict=True)]
            for start, end in zip((cuts := _cuts(sizes))[:-1], cuts[1:], strict=True):
                piece = batch.slice(start, end - start)
                ids, words, odd = piece.column(0), piece.column(1), piece.column(2)
                if odd.null_count < len(odd):
                    if splitter is None:
                        from tokenizers import Tokenizer

                        splitter = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json").pre_tokenizer
                    words = pa.array([w if o is None else [o[a:b] for _, (a, b) in splitter.pre_tokenize_str(o)] for w, o in zip(words.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
                coded = words.flatten().dictionary_encode()
                lengths = np.diff(words.offsets.to_numpy())
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                n, m, block = len(ids), len(coded.dictionary), (part << 32) + number
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + m, block)), pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                    pa.concat_arrays([pa.ListArray.from_arrays(offsets, coded.indices), pa.nulls(m, pa.list_(pa.int32()))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                    pa.concat_arrays([pa.nulls(n, pa.string()), coded.dictionary.cast(pa.string())]),
                ], names=["block", "doc", "at", "pos", "word"])
    return run


def blocked(docs: DataFrame, id_column: str, text_column: str, folder: str = TOKENIZERS) -> DataFrame:
    """The written table of blocks: rows (block, doc, at) for documents, rows (block, pos, word) for words."""
    text = F.coalesce(text_column, F.lit(""))
    odd = F.when(text.rlike(r"\p{Cn}"), text)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    split = docs.select(F.col(id_column).alias("doc"), F.when(odd.isNull(), split_words(text)).otherwise(F.array().cast("array<string>")).alias("words"), odd.alias("odd"))
    return materialize(split.mapInArrow(_blocks(folder), f"block bigint, doc {kind}, at array<int>, pos int, word string"), "blocks")


def _ranks(folder: str) -> dict[bytes, int]:
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _encode(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a pre-token is one piece: the pattern keeps it whole, the merges are the file's
        encoding = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(folder), special_tokens={})
        for batch in batches:
            ids = [encoding.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])
    return run


def encoded_words(blocks: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(word, ids) of every distinct word of the corpus, encoded once."""
    words = blocks.where("word is not null").select("word").distinct()
    return words.mapInArrow(_encode(folder), "word string, ids array<int>")


def _dictionaries(blocks: DataFrame, folder: str, value: str) -> DataFrame:
    """(block, entries): ``value`` of each word of the block, by position."""
    words = blocks.where("word is not null").select("block", "pos", "word")
    valued = words.join(encoded_words(blocks, folder).select("word", F.expr(value).alias("value")), "word")
    return valued.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("e")).select("block", F.col("e.value").alias("entries"))


def _documents(blocks: DataFrame) -> DataFrame:
    return blocks.where("word is null").select("block", "doc", "at")


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id_column, ids): every document's token ids without special tokens."""
    blocks = blocked(docs, id_column, text_column, folder)
    ids = F.flatten(F.transform("at", lambda i: F.get("entries", i)))
    joined = _documents(blocks).join(_dictionaries(blocks, folder, "ids"), "block", "left")
    return joined.select(F.col("doc").alias(id_column), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id_column, n_tokens): the lengths that :func:`encode` gives, without laying the ids out."""
    blocks = blocked(docs, id_column, text_column, folder)
    total = F.aggregate("at", F.lit(0).cast("bigint"), lambda acc, i: acc + F.get("entries", i))
    joined = _documents(blocks).join(_dictionaries(blocks, folder, "size(ids)"), "block", "left")
    return joined.select(F.col("doc").alias(id_column), F.coalesce(total, F.lit(0).cast("bigint")).alias("n_tokens"))


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """(id_column, text): the texts that the ids spell; an empty list gives ''.

    The token-byte table has as many rows as the vocabulary, so it is broadcast; pieces are put
    together by position. Documents are kept apart by their row, also where ids repeat.
    """
    spark = encoded.sparkSession
    tokens = F.broadcast(spark.createDataFrame([(rank, bytearray(token)) for token, rank in _ranks(folder).items()], "id int, bytes binary"))
    rows = materialize(encoded.select(id_column, ids_column).withColumn("row_no", F.monotonically_increasing_id()), "encoded")
    pieces = rows.select("row_no", F.posexplode(ids_column).alias("pos", "id")).join(tokens, "id")
    texts = pieces.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("hex")))).alias("p")).select("row_no", F.decode(F.unhex(F.array_join("p.hex", "")), "utf-8").alias("text"))
    return rows.join(texts, "row_no", "left").select(id_column, F.coalesce("text", F.lit("")).alias("text"))
