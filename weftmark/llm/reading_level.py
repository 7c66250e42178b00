"""Reading bands of documents by harmonic propagation over the graph of prose sentences and words.

Graded examples are clamped at their band. A word's difficulty is the mean of the sentences that hold
it; a sentence's difficulty is the mean of its words, each weighted by how little its sentences
disagree. Rounds of this carry difficulty from the examples into words that only the corpus has, until
the words, weighted by their occurrences, move by less than ``tolerance`` on average.

The graph is never built as pairs. Blocks of documents hold their sentences as positions in the block's
own dictionary of distinct words. In each round the table of words (word, difficulty, weight), spread by
word, is joined with the dictionaries, each block gets the values of its words, adds up the difficulties
of its sentences per word, and only these sums are shuffled. Words are keyed by their text, so no two
share a value, and nothing but the mean movement and the bands' thresholds comes to the driver.

At the end each sentence gets the band between whose thresholds (midway between the mean scores of
the examples' sentences, by band) its score lies, and the document the band with most words.

Prose is what remains without fenced code, tables, list and heading lines and paths: sentences of
three words or more that end in a stop. Defined cases: a document without such a sentence is scored
by all its words; without any known word it gets band 2; null, empty and blank texts yield no row;
a tie between bands goes to the lower one; repeated documents and ids yield a row each; no examples:
every document gets band 2; no documents: no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import BucketedTable, materialize

BANDS = np.arange(1, 5)
#: Share of the examples in a word's difficulty, where both examples and corpus have the word. A share, not a weight a
#: sentence, so that a corpus of any size is bound to the examples alike and the rounds do not grow with it.
ANCHOR = 0.8
#: Variance that is added to every word's, so that few agreeing sentences do not count without bound.
SPREAD = 0.05
#: A block ends after so many documents or bytes of text; one longer text is a block of its own.
BLOCK_DOCUMENTS, BLOCK_BYTES = 8192, 8 << 20

def _replace(texts: pa.Array, pattern: str, by: str) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern, by)


Sentences = tuple[pa.Array, np.ndarray, np.ndarray]


def prose_words(texts: pa.Array) -> Sentences:
    """Sentences of prose: (words of all sentences, words per sentence, sentences per text)."""
    t = _replace(texts, r"(?s)```.*?(?:```|\z)", "\n\n")
    t = _replace(t, r"\n[ \t]*(?:[|>*-]|\d+[.)])+[ \t]*", "\n\n")
    t = _replace(t, r"(?m)^[ \t]*#+[ \t]*", "")
    t = _replace(t, r"[.!?…][\"'»”)\]]*(?:\s+|\z)", "\x01")
    t = _replace(t, r"[^\x01]*\n[ \t\r]*\n", "")
    return _pieces(t, 3)


def all_words(texts: pa.Array) -> Sentences:
    """Every text as one sentence, for texts without prose."""
    return _pieces(pc.binary_join_element_wise(_replace(texts, "\x01", " "), "", "\x01"), 1)


def _pieces(marked: pa.Array, least: int) -> Sentences:
    """Words of the pieces that end in \\x01 and have at least ``least`` words; names of files and figures are no words."""
    t = _replace(marked, r"[^\s\x01]*[_/\d][^\s\x01]*", " ")
    t = pc.utf8_lower(_replace(t, r"[^\p{L}\x01]+", " "))
    pieces = pc.split_pattern(t, "\x01")
    ends = pieces.offsets.to_numpy()[1:] - pieces.offsets.to_numpy()[0]
    closed = np.ones(len(pieces.flatten()), bool)
    closed[ends - 1] = False  # what follows the last stop
    words = pc.split_pattern(pieces.flatten(), " ")
    flat, size = words.flatten(), np.diff(words.offsets.to_numpy())
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    piece = np.repeat(np.arange(len(size)), size)
    size = np.bincount(piece[real], minlength=len(size))
    kept = closed & (size >= least)
    text = np.repeat(np.arange(len(marked)), np.diff(np.concatenate([[0], ends])))
    return flat.filter(pa.array(real & kept[piece])), size[kept], np.bincount(text[kept], minlength=len(marked))


def _starts(texts: pa.Array) -> list[int]:
    """Where the blocks of a batch begin, and its end."""
    size = pc.binary_length(texts).to_numpy()
    starts, held = [0], 0
    for i, n in enumerate(size.tolist()):
        if i > starts[-1] and (held + n > BLOCK_BYTES or i - starts[-1] >= BLOCK_DOCUMENTS):
            starts.append(i)
            held = 0
        held += n
    return [*starts, len(size)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its documents, their bands and numbers of sentences, the sentences' sizes, and their words by place in the dictionary."""
    part, number = TaskContext.get().partitionId(), 0
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    for batch in batches:
        for start, end in zip((cut := _starts(batch.column("text")))[:-1], cut[1:], strict=True):
            ids, texts, band = batch.slice(start, end - start).columns
            words, sizes, sentences = prose_words(texts)
            if not sentences.all():
                bare, has = np.flatnonzero(sentences == 0), np.flatnonzero(sentences)
                more, more_sizes, more_sentences = all_words(texts.take(pa.array(bare)))
                order = pa.array(np.concatenate([has, bare]))
                words, sizes, sentences = pa.concat_arrays([words, more]), np.concatenate([sizes, more_sizes]), np.concatenate([sentences[has], more_sentences])
                ids, band = ids.take(order), band.take(order)
            coded = words.dictionary_encode()
            ints = [pa.array(x.astype(np.int32)) for x in (sentences, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([band.null_count < len(band)]), *map(listed, [ids, band, *ints, coded.indices.cast(pa.int32()), coded.dictionary])],
                names=["block", "graded", "docs", "bands", "sentences", "sizes", "words", "vocabulary"],
            )
            number += 1


def _scores(words: np.ndarray, sizes: np.ndarray, difficulty: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean difficulty of each sentence's words; nan where none is known."""
    k = weight[words]
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(sentence, k, len(sizes))
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, np.bincount(sentence, k * difficulty[words], len(sizes)) / total, np.nan)


def _scored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block's row with (y per sentence, band per sentence (0: none), difficulty per dictionary entry)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].values for name in ("docs", "bands", "sentences", "sizes", "words", "vocabulary", "entries") if name in batch.schema.names and batch.column(name)[i].is_valid}
            sizes, per_doc, words = (row[c].to_numpy() for c in ("sizes", "sentences", "words"))
            difficulty, weight = np.zeros(len(row["vocabulary"])), np.zeros(len(row["vocabulary"]))
            if "entries" in row:
                at, d, w = (row["entries"].field(c).to_numpy() for c in ("pos", "difficulty", "weight"))
                difficulty[at], weight[at] = d, w
            y = _scores(words, sizes, difficulty, weight)
            yield row, y, np.repeat(row["bands"].fill_null(0).to_numpy(), per_doc), np.where(weight > 0, difficulty, np.nan)


_SUMS = [f"{c}_{of}" for of in ("given", "corpus") for c in ("n", "s", "ss")]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of a block: number, sum and sum of squares of the difficulties of the sentences that hold it, examples apart, and its own so far."""
    for row, y, band, was in _scored_blocks(batches):
        y = np.where(band > 0, band, y)
        sizes, words, size = row["sizes"].to_numpy(), row["words"].to_numpy(), len(row["vocabulary"])
        graded, known = np.repeat(band > 0, sizes), np.repeat(~np.isnan(y), sizes)
        y = np.repeat(y, sizes)
        sums = []
        for of in (known & graded, known & ~graded):
            at, ys = words[of], y[of]
            sums += [np.bincount(at, v, size).astype(float) for v in (np.ones(len(ys)), ys, ys * ys)]
        held = np.flatnonzero(sums[0] + sums[3])
        yield pa.RecordBatch.from_arrays([row["vocabulary"].take(pa.array(held)), *(pa.array(x[held]) for x in sums), pa.array(was[held], from_pandas=True)], names=["word", *_SUMS, "was"])


class _Corpus:
    """The blocks, spread by block, and their dictionaries, spread by word."""

    def __init__(self, texts: DataFrame):
        spark = texts.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.kind = texts.schema["doc"].dataType.simpleString()
        schema = f"block bigint, graded boolean, docs array<{self.kind}>, bands array<int>, sentences array<int>, sizes array<int>, words array<int>, vocabulary array<string>"
        # a task has few blocks, so each goes straight into its bucket, without a shuffle
        self.blocks = BucketedTable.write(texts.select("doc", "text", "band").mapInArrow(_blocks, schema), "reading_blocks", ["block"], self.buckets)
        entries = self.blocks.read().select("block", F.posexplode("vocabulary").alias("pos", "word"))
        self.entries = BucketedTable.write(entries.repartition(self.buckets, "word"), "reading_words", ["word"], self.buckets)

    def with_values(self, words: DataFrame) -> DataFrame:
        """The blocks with the values of their words; those without a known word too."""
        value = F.struct("pos", "difficulty", "weight")
        gathered = self.entries.read().join(words.select("word", "difficulty", "weight"), "word").groupBy("block").agg(F.collect_list(value).alias("entries"))
        return self.blocks.read().join(gathered, "block", "left")

    def summed(self, blocks: DataFrame) -> BucketedTable:
        """The next table of words, from what the blocks' sentences say."""
        sums = blocks.drop("graded", "docs", "block").mapInArrow(_add_up, f"word string, {', '.join(f'{c} double' for c in _SUMS)}, was double")
        total = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("was").alias("was"))
        given = F.when(F.col("n_given") == 0, 0.0).when(F.col("n_corpus") == 0, 1.0).otherwise(ANCHOR)
        mean = lambda c: given * F.coalesce(F.try_divide(f"{c}_given", "n_given"), F.lit(0.0)) + (1 - given) * F.coalesce(F.try_divide(f"{c}_corpus", "n_corpus"), F.lit(0.0))
        total = total.select("word", "was", (F.col("n_given") + F.col("n_corpus")).alias("n"), mean("s").alias("difficulty"), mean("ss").alias("square"))
        spread = F.greatest(F.col("square") - F.col("difficulty") * F.col("difficulty"), F.lit(0.0))
        # a word that no sentence had told anything about before counts as moved by a whole band
        moved = F.col("n") * F.coalesce(F.abs(F.col("difficulty") - F.col("was")), F.lit(1.0))
        return BucketedTable.write(total.select("word", "difficulty", (1 / (spread + SPREAD + 1 / F.col("n"))).alias("weight"), "n", moved.alias("moved")), "word_difficulty", ["word"], self.buckets)

    def drop(self) -> None:
        self.blocks.drop()
        self.entries.drop()


def word_difficulty(corpus: _Corpus, tolerance: float = 0.001) -> tuple[BucketedTable, int]:
    """(word, difficulty, weight) at rest, and the rounds it took; the first sees the examples alone.

    At rest means that the words' difficulties, weighted by occurrences, moved by less than ``tolerance``
    of a band on average. The means contract, so the rounds end.
    """
    words, rounds = corpus.summed(corpus.blocks.read().where("graded")), 1
    while True:
        following = corpus.summed(corpus.with_values(words.read()))
        words.drop()
        words, rounds = following, rounds + 1
        moved = words.read().agg(F.sum("moved") / F.sum("n")).first()[0] or 0.0
        if moved < tolerance:
            return words, rounds


def _sentence_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, y, _, _ in _scored_blocks(batches):
        offsets = pa.array(np.concatenate([[0], np.cumsum(row["sentences"].to_numpy())]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(y, from_pandas=True), row["sizes"])]
        yield pa.RecordBatch.from_arrays([row["docs"], row["bands"], *lists], names=["doc", "band", "y", "sizes"])


def thresholds(scored: DataFrame) -> np.ndarray:
    """Midpoints between the mean scores of the examples' sentences, by band; bands without examples lie between their neighbours."""
    rows = scored.where("band is not null").select("band", F.explode("y").alias("y")).where("y is not null").groupBy("band").agg(F.avg("y")).collect()  # at most one row a band
    means = dict(rows) or {int(b): float(b) for b in BANDS}
    line = np.maximum.accumulate(np.interp(BANDS, sorted(means), [means[b] for b in sorted(means)]))
    return (line[1:] + line[:-1]) / 2


def _assign(limits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("y")
            per_text = np.diff(lists.offsets.to_numpy())
            y, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(float), batch.column("sizes").flatten().to_numpy()
            band = np.searchsorted(limits, np.nan_to_num(y, nan=-1.0), "right")
            known = ~np.isnan(y)
            text = np.repeat(np.arange(batch.num_rows), per_text)
            votes = np.bincount((text * 4 + band)[known], sizes[known], batch.num_rows * 4).reshape(-1, 4)
            y_sum, n = np.bincount(text[known], (y * sizes)[known], batch.num_rows), votes.sum(1)
            level = np.where(n > 0, y_sum / np.maximum(n, 1), 2.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.where(n > 0, votes.argmax(1) + 1, 2).astype(np.int32)), pa.array(level)], names=["doc", "reading_band", "difficulty"])
    return run


def reading_bands(docs: DataFrame, examples: DataFrame, id_column: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """(id_column, reading_band, difficulty) of every document with text; examples have (text, reading_band)."""
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    given = examples.where("text is not null and reading_band is not null").select(F.lit(None).cast(kind).alias("doc"), "text", F.col("reading_band").cast("int").alias("band"))
    blank = F.regexp_replace("text", r"[\p{Z}\s\u0085\u001c-\u001f]+", "") == ""
    own = docs.where(F.col("text").isNotNull() & ~blank).select(F.col(id_column).alias("doc"), "text", F.lit(None).cast("int").alias("band"))
    corpus = _Corpus(own.unionByName(given))
    try:
        words, _ = word_difficulty(corpus, tolerance)
        scored = materialize(corpus.with_values(words.read()).drop("graded", "block").mapInArrow(_sentence_scores, f"doc {kind}, band int, y array<double>, sizes array<int>"), "scored")
        words.drop()
    finally:
        corpus.drop()
    return scored.where("band is null").drop("band").mapInArrow(_assign(thresholds(scored)), f"doc {kind}, reading_band int, difficulty double").withColumnRenamed("doc", id_column)
