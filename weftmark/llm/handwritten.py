"""Which source files were written by hand, and which were generated, minified, vendored or are data.

Each file gets evidence from its own text: what its leading comment says of where it comes from, how
regular its lines are, how densely they are set, how much of it is literals, and whether other repos or
known libraries hold the same text (identical word sequences first, of any length; then near copies:
five-word shingles, Jaccard 0.8 or more). Belief propagation then runs over every repo's directory tree:
files send messages up to their folder and folders to their parents, with a compatibility that prefers
equal kinds; folder names add weak evidence; the way down gives each file what its siblings and parents
say. A tree has no loops, so one pass up and one down are exact.

Texts are read once and never shuffled: a task turns them into findings, a key of the word sequence, a
short signature and the shingles; shingles move only for pairs that the signatures cannot rule out.

Defined cases: repeated rows of a file count once (the latest change, then the greatest text key); null
texts yield no row; empty ones count as written by hand; a null repo is a repo of its own, other than '';
paths are split at '/', where a leading or repeated '/' or './' says nothing; a null path is a file at the
root; empty tables yield no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize
from ..plans.skew import join_groups, sieved

KINDS = ["handwritten", "generated", "minified", "vendored", "blob"]

#: Where the leading comment of a file ends, and quoted words in it, which name a thing without being it.
_HEADER = re.compile(r"(?:\s*(?:(?://|--|;|#(?![\[!]|include\b|define\b|if|pragma\b|import\b))[^\n]*|/\*.*?\*/|<!--.*?-->|<\?php|#!\S[^\n]*))*", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|`[^`\n]*`")
#: What tools write about their output, in the languages of the corpus.
_GENERATED = re.compile(
    r"(?im)@generated\b|\b(?:auto|machine)[- ]?(?:generated|written|made|created)\b|\bautomatically (?:generated|created|produced|written)\b"
    r"|\bgenerated automatically\b|\bgenerated (?:by|from|with) (?!this\b|our\b|these\b|%)\S|\b(?:produced|emitted) by (?:the )?[\w.-]+(?: compiler| generator|:)"
    r"|\bdo not (?:edit|modify|change)\b|\b(?:edits|changes) (?:\w+ ){0,3}(?:overwritten|lost|discarded)"
    r"|\b(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)\b|\bgénérée? (?:automatiquement|par)\b|\bgenerado (?:automáticamente|por)\b"
)
#: What speaks for another project as the source: a release number, a holder, a licence, a way it came.
_VENDORED = re.compile(
    r"(?im)^\W*(?:vendored|bundled|copied|taken|imported|forked|ported|adapted|derived)\b[^\n]*\b(?:from|of)\b|^\W*upstream\b|^\W*this file is part of \w"
    r"|\bcopyright\b[^\n]*\b(?:contributors|authors|project|foundation|inc|ltd)\b|@(?:version|license|preserve)\b|\bv?\d+\.\d+\.\d+\b|\bv\d+\.\d+\b"
    r"|\b(?:released|distributed) under the [^\n]*licen[cs]e\b"
)
#: A comment anywhere that tells of a change to somebody else's file (for RE2).
_PATCHED = r"(?mi)^[ \t]*(?://|#|/?\*|--|;)[ \t]*local(?:ly)? (?:patch(?:ed)?|modif(?:ied|ications?))\b"
#: Literals (for RE2, which takes repeated groups without recursion), and bytes that carry no word.
_LITERALS = r"(?s)\"\"\".*?\"\"\"|`(?:[^`\\]|\\.)*`|r#\".*?\"#|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0x[0-9A-Fa-f]+"
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f\v"))
_WORDLESS = _SPACE | np.isin(np.arange(256), list(b"0123456789,;:.[](){}=+-")) | (np.arange(256) & 0xC0 == 0x80)
#: File names that tools give.
_GENERATED_NAME = r"(?i)(?:_pb2(?:_grpc)?\.py|\.pb\.(?:go|cc|h)|\.gen\.\w+|\.g\.\w+|grpc\.java|\.tab\.[ch]|\.generated\.\w+|_generated\.\w+)$"
_MINIFIED_NAME = r"(?i)(?:[.-]min\.\w+|\.[0-9a-f]{8,}\.\w+|\.bundle\.\w+)$"
#: Folder names as (kind, name, log evidence).
FOLDERS = [
    ("vendored", r"(?i)^(?:vendor|vendored|third[_-]?party|node_modules|bower_components|deps|extern|externals?|compat)$", 1.5),
    ("generated", r"(?i)^(?:gen|generated|autogen|protos?|migrations|out|target)$", 1.0),
    ("minified", r"(?i)^(?:dist|public|static|js|min|web)$", 0.5),
    ("blob", r"(?i)^(?:data|assets|tables|fixtures|resources)$", 0.5),
]
#: Kind of a child given its folder's, and the kinds' shares to begin with.
SAME, OTHER = 0.8, 0.05
PRIOR = [0.76, 0.08, 0.05, 0.07, 0.04]
SIMILAR = 0.8
#: Buckets of a text's signature: how many of its shingles fall into each. Shared shingles are at most the sum of the lesser counts.
BUCKETS = 128
#: Shingles whose frequency in a sample of the texts puts them last; the order saves time and loses no pair.
HOT_SHINGLES, SAMPLED = 100_000, 16


#: A number for each byte and an odd multiplier, from which words get theirs; drawn once, by a fixed seed.
_BYTE_NUMBERS = np.random.default_rng(20260901).integers(0, 2**64, 256, np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of words: ASCII letters, figures, the underscore, and all of other scripts.
_WORD_BYTES = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")) | (np.arange(256) >= 128)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the words of all texts, and the number of words per text.

    A word's number is that of its bytes as digits to the base _STEP, taken from running sums over all bytes.
    """
    inside = np.concatenate([[False], _WORD_BYTES[data], [False]])
    edge = inside[1:] != inside[:-1]
    edge[at] |= inside[1:][at] & inside[:-1][at]  # a text's end parts words that touch the next text
    cut = np.flatnonzero(edge)
    starts = cut[inside[1:][cut]]
    ends = np.append(cut[1:], len(data))[inside[1:][cut]] if len(cut) else starts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int((ends - starts).max()) if len(starts) else 0, _STEP))
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if len(starts) and starts[0] == 0 else None
        if place is None:
            place = np.zeros(len(data), np.int64)
            if len(starts):
                place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        part = np.where(inside[1:-1], _BYTE_NUMBERS[data] * powers[np.minimum(place, max(len(powers) - 1, 0))], np.uint64(0)) if len(powers) else np.zeros(len(data), np.uint64)
        numbers = np.add.reduceat(part, starts) if len(starts) else np.zeros(0, np.uint64)
        numbers = (numbers ^ (numbers >> np.uint64(29))) * _MIX
        numbers ^= numbers >> np.uint64(32)
    return numbers, np.diff(np.searchsorted(starts, at))


def shingle_sets(words: np.ndarray, sizes: np.ndarray, length: int = 5) -> list[np.ndarray]:
    """Distinct shingles of each text, as 64-bit numbers; a shorter text has none."""
    total = np.zeros(max(len(words) - length + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - length + 1 + i]
    ends = np.cumsum(sizes)
    return [np.unique(total[e - n : max(e - length + 1, e - n)]) if n >= length else np.zeros(0, np.uint64) for e, n in zip(ends, sizes, strict=True)]


def _prefixes(hot: np.ndarray):
    """Each text's rarest shingles, as many as any text at SIMILAR or more must share one of: (shingle, text_key, n, place).

    Shingles stand in one order for all texts: those not in ``hot`` first, then the hot ones, most frequent
    last; ``place`` is the shingle's number in that order within its text.
    """
    values, rank = np.sort(hot), len(hot) - np.argsort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.columns
            flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            text = np.repeat(np.arange(len(size)), size)
            late = np.zeros(len(flat), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                late = np.where(values[at] == flat, rank[at], 0)
            order = np.lexsort((flat, late, text))
            least = np.ceil(SIMILAR * size - 1e-9).astype(np.int64)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            kept = place <= np.repeat(size - least, size)
            owner = text[order][kept]
            columns = [pa.array(flat[order][kept]), keys.take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (size[owner], place[kept]))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "text_key", "n", "place"])

    return run


def regular_shares(texts: pa.Array) -> np.ndarray:
    """Share of each text's characters in lines whose shape (words and figures blotted out) it has six times or more."""
    split = pc.split_pattern_regex(texts, r"\r\n|\n|\r")
    lines, text = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(lines, r"-?(?:0x[0-9A-Fa-f]+|\d+(?:\.\d+)?)", "0"), r"[\p{L}_][\p{L}\p{N}_]*", "w")
    shapes = pc.replace_substring_regex(shapes, r"(?:[w0](?:, ?)?){4,}", "s").dictionary_encode()
    _, code, count = np.unique(text * len(shapes.dictionary) + shapes.indices.to_numpy(), return_inverse=True, return_counts=True)
    size = pc.utf8_length(pc.utf8_trim_whitespace(lines)).to_numpy()
    return np.bincount(text, size * (count[code] >= 6), len(texts)) / np.maximum(np.bincount(text, size, len(texts)), 1)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each text begins and ends."""
    kept = pa.concat_arrays([texts]).cast(pa.large_string())
    _, offsets, data = kept.buffers()
    at = np.frombuffer(offsets, np.int64)[kept.offset : kept.offset + len(kept) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _setting(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each text: characters, characters a line that is not blank, characters but white space, and share of characters outside literals, figures and marks."""
    inner = (data & 0xC0) == 0x80
    n = np.maximum(_per_text(~inner, at), 1)
    solid = ~_SPACE[data]
    # lines begin after a line feed and where a text does; one is not blank if a solid byte is in it
    begins = np.union1d(np.flatnonzero(data == 10) + 1, at)[:-1] if len(data) else at[:0]
    filled = np.add.reduceat(solid, begins, dtype=np.int64) > 0 if len(begins) else np.zeros(0, bool)
    n_lines = np.diff(np.concatenate([[0], np.cumsum(filled)])[np.searchsorted(begins, at)])
    bare, bare_at = _bytes(pc.replace_substring_regex(texts, _LITERALS, ""))
    return [n, n / np.maximum(n_lines, 1), _per_text(solid & ~inner, at), _per_text(~_WORDLESS[bare], bare_at) / n]


_FEATURES = (
    "scope string, repo string, source_file string, modified_at timestamp, text_key string, n_words int, shingles array<bigint>, signature binary, regular double, "
    "n bigint, line double, solid bigint, bare double, marked boolean, taken boolean"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            *own, texts = batch.slice(start, 512).columns
            data, offsets = _bytes(texts)
            words, sizes = _words(data, offsets)
            sets = shingle_sets(words, sizes)
            ends = np.cumsum(sizes)
            keys = [xxhash.xxh128_hexdigest(words[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
            signatures = [np.bincount((x >> np.uint64(33)).astype(np.int64) % BUCKETS, minlength=BUCKETS).clip(max=65535).astype(np.uint16).tobytes() for x in sets]
            headers = [_QUOTED.sub("", _HEADER.match(t).group(0)) for t in texts.to_pylist()]
            patched = pc.match_substring_regex(texts, _PATCHED).to_numpy(zero_copy_only=False)
            found = [[bool(p.search(h)) for h in headers] for p in (_GENERATED, _VENDORED)]
            columns = [pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            columns += [pa.array(x) for x in (regular_shares(texts), *_setting(texts, data, offsets), np.array(found[0], bool), np.array(found[1], bool) | patched)]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[x.split()[0] for x in _FEATURES.split(", ")])


def _not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures allow SIMILAR; a bucket at its highest count allows anything."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS).astype(np.int64) for c in ("signature", "lead_signature"))
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "lead_n"))
        most = np.minimum(one, two).sum(1) if batch.num_rows else np.zeros(0)
        open_ended = ((one == 65535) | (two == 65535)).any(1)
        kept = pa.array(open_ended | (most >= SIMILAR * (n + m - most) - 1e-6))
        yield batch.select(["text_key", "lead"]).filter(kept)


def _alike(likely: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (text_key, lead) that are at SIMILAR or more by their shingles, and whether two repos or a library hold them."""
    wanted = materialize(_ends(likely), "wanted")
    held = sieved(sets, wanted, ["text_key"]).join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    held = materialize(held.join(texts.select("text_key", "repo", "shared"), "text_key"), "compared_sets")
    lead = held.select(F.col("text_key").alias("lead"), F.col("repo").alias("lead_repo"), F.col("shingles").alias("held"))
    sizes = materialize(likely.groupBy("lead").agg(F.count(F.lit(1)).alias("size")).join(lead, "lead"), "centres")
    compared = join_groups(likely.join(held, "text_key"), sizes, ["lead"], likely.count())
    both = F.size(F.array_intersect("shingles", "held"))
    spread = F.col("shared") | ~F.col("repo").eqNullSafe(F.col("lead_repo"))
    return materialize(compared.where(both >= SIMILAR * (F.size("shingles") + F.size("held") - both)).select("text_key", "lead", spread.alias("spread")), "near_copies")


def near_pairs(texts: DataFrame, sets: DataFrame, first_leads: int = 64) -> DataFrame:
    """Pairs (text_key, lead, spread) at SIMILAR or more of ``texts`` (text_key, repo, shared, signature), enough to settle every text.

    ``sets`` holds (text_key, shingles) of these texts, once or several times. Texts are alike only if they share a shingle of their prefixes,
    so members of a prefix shingle are candidates. A text is open until a pair shows that another repo or a
    library holds it too. In each round a shingle's first open texts lead: each is compared with all other
    members, then leaves the shingle. So a text that stays open has met all its candidates, and the many
    copies of one text, settled by their first common lead, make no pairs among themselves.

    Before shingles are compared, candidates are ruled out that cannot be alike: by their sizes, by the places
    of the shingle in both (what follows the first shared one bounds what is shared), and by their signatures.
    """
    sample = sets.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0).select(F.explode("shingles").alias("shingle"))
    hot = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).select("shingle").toArrow()
    prefixes = materialize(sets.select("text_key", "shingles").mapInArrow(_prefixes(hot["shingle"].to_numpy()), "shingle bigint, text_key string, n int, place int"), "prefixes")
    # most shingles stand in one text only: they are sifted out before anything else moves
    several = prefixes.groupBy("shingle").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    several = materialize(several.select("shingle", "size"), "several")
    common = materialize(sieved(prefixes, several.select("shingle"), ["shingle"]), "common")
    met = join_groups(common, several, ["shingle"]).distinct()
    members = materialize(met.join(broadcast_if_small(texts.select("text_key", (~F.col("shared")).alias("open"))), "text_key"), "members")

    def alive(rows: DataFrame) -> DataFrame:
        count = F.count(F.lit(1)).alias("size")
        held = materialize(rows.groupBy("shingle").agg(count, F.max("open").alias("any")).where("any and size > 1").select("shingle", "size"), "held")
        return materialize(join_groups(rows, held, ["shingle"]), "members")

    leads, found = first_leads, []
    while not members.isEmpty():
        turn = F.row_number().over(Window.partitionBy("shingle").orderBy("text_key"))
        leading = members.where("open").withColumn("turn", turn).where(F.col("turn") <= leads)
        sized = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"))
        groups = leading.groupBy("shingle").agg(F.collect_list(F.struct("text_key", "n", "place")).alias("leads")).join(sized, "shingle")
        groups = materialize(groups, "leads")
        met = join_groups(members, groups, ["shingle"]).select("text_key", "n", "place", "open", F.explode("leads").alias("l"))
        # an open member before a lead leads itself, so each pair of leads is met from one side
        met = met.where((F.col("text_key") > F.col("l.text_key")) | ~F.col("open")).where(F.col("text_key") != F.col("l.text_key"))
        met = met.where(F.least("n", "l.n") >= SIMILAR * F.greatest("n", "l.n") - 1e-6)
        met = met.where(F.least(F.col("n") - F.col("place"), F.col("l.n") - F.col("l.place")) >= SIMILAR / (1 + SIMILAR) * (F.col("n") + F.col("l.n")) - 1e-6)
        pairs = materialize(met.select("text_key", F.col("l.text_key").alias("lead"), "n", F.col("l.n").alias("lead_n")).distinct(), "pairs")
        by_lead = texts.select(F.col("text_key").alias("lead"), F.col("signature").alias("lead_signature"))
        led = materialize(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("size")).join(by_lead, "lead"), "led")
        signed = join_groups(pairs.join(texts.select("text_key", "signature"), "text_key"), led, ["lead"], pairs.count())
        likely = materialize(signed.mapInArrow(_not_ruled_out, "text_key string, lead string"), "likely")
        near = likely.limit(0).withColumn("spread", F.lit(False)) if likely.isEmpty() else _alike(likely, texts, sets)
        found.append(near)
        settled = materialize(_ends(near.where("spread")).withColumn("settled", F.lit(True)), "settled")
        led_by = groups.select("shingle", F.explode("leads.text_key").alias("text_key"))
        rest = members.join(led_by, ["shingle", "text_key"], "left_anti").join(broadcast_if_small(settled), "text_key", "left")
        members = alive(rest.select("shingle", "text_key", "n", "place", (F.col("open") & F.col("settled").isNull()).alias("open")))
        leads *= 4
    return reduce(DataFrame.unionByName, found) if found else texts.limit(0).select("text_key", F.col("text_key").alias("lead"), F.col("shared").alias("spread"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("text_key", "lead")).alias("text_key")).distinct()


def copied_texts(holders: DataFrame, table: DataFrame, least_words: int = 20) -> DataFrame:
    """Keys of texts that two repos or a library hold, alike or nearly, and of near copies of those in a repo: (text_key).

    ``holders`` says who holds a text (scope, text_key), where a null scope is a library; ``table`` has the texts
    (text_key, n_words, shingles, signature), once or several times. Identical texts are collapsed first, of any
    length that has words; near copies are sought from ``least_words`` on.
    """
    held = holders.groupBy("text_key").agg(F.min("scope").alias("repo"), F.max("scope").alias("high"), F.max(F.col("scope").isNull()).alias("library"))
    known = table.where("n_words > 0").groupBy("text_key").agg(F.first("signature").alias("signature"), F.max("n_words").alias("n_words"))
    shared = (F.col("library") | (F.col("repo") != F.col("high"))).alias("shared")
    texts = materialize(held.join(known, "text_key").select("text_key", "repo", shared, "signature", "n_words"), "texts")
    near = near_pairs(texts.where(F.col("n_words") >= least_words).drop("n_words"), table.where(F.col("n_words") >= least_words).select("text_key", "shingles"))
    spread = materialize(texts.where("shared").select("text_key").unionByName(_ends(near.where("spread"))).distinct(), "spread")
    inner = near.where("not spread").select(F.explode(F.array(F.struct("text_key", F.col("lead").alias("by")), F.struct(F.col("lead").alias("text_key"), F.col("text_key").alias("by")))).alias("p")).select("p.*")
    return inner.join(spread.withColumnRenamed("text_key", "by"), "by", "left_semi").select("text_key").unionByName(spread).distinct()


def _log_evidence() -> list[Column]:
    """Log likelihood of a file's findings under each kind."""
    col = F.col
    name = F.element_at(F.split("source_file", "/"), -1)
    tool_name, short_name = (F.coalesce(name.rlike(p), F.lit(False)) for p in (_GENERATED_NAME, _MINIFIED_NAME))
    dense = (col("line") > 80) & (col("solid") > 0.9 * col("n")) & (col("bare") > 0.3)
    data = (col("bare") < 0.08) & (col("solid") > 20)
    regular = col("regular") > 0.6
    at = lambda c, yes, no=0.0: F.when(c, F.lit(float(yes))).otherwise(F.lit(float(no)))
    hand = at(col("marked"), -5) + at(col("taken"), -4) + at(dense, -5) + at(data, -5) + at(regular, -5) + at(col("copied"), -5)
    generated = at(col("marked") | regular, 5, -2) + at(col("marked") & regular, 1) + at(tool_name, 1.5)
    minified = at(dense, 6, -5) + at(short_name, 1.5)
    vendored = at(col("copied"), 5, -1.5) + at(col("taken"), 4, -1)
    blob = at(data, 6, -3)
    return [x.alias(k) for x, k in zip([hand, generated, minified, vendored, blob], KINDS, strict=True)]


def _message(prefix: str = "") -> list[Column]:
    """What a child's log values say about the kind of its folder, or a folder's about its child: the compatibility is symmetric."""
    values = F.array(*[F.col(f"{prefix}{k}") for k in KINDS])
    top = F.array_max(values)
    # as functions of an array the terms stay short enough for the JVM to compile what surrounds them
    terms = F.transform(values, lambda v: F.exp(v - top))
    whole = F.aggregate(terms, F.lit(0.0), lambda x, t: x + t)
    said = F.transform(terms, lambda t: F.log(whole * OTHER + t * (SAME - OTHER)) + top)
    return [said[i].alias(k) for i, k in enumerate(KINDS)]


def propagate(files: DataFrame) -> DataFrame:
    """(repo, source_file, kind, handwritten .. blob) from files with a ``scope``, a ``folder`` and log evidence per kind.

    ``scope`` stands for the repo and is never null; ``folder`` has no empty part, so every folder is at one depth.

    One step per level of the deepest tree, each over that level's folders alone. A folder with any
    number of files is summed before the shuffle; on the way down its files join it by :func:`join_groups`.
    """
    name = F.element_at(F.split("folder", "/"), -1)
    weak = {k: F.lit(0.0) for k in KINDS}
    for kind, pattern, value in FOLDERS:
        weak[kind] = weak[kind] + F.when(name.rlike(pattern), value).otherwise(0.0)
    sums = [F.sum(k).alias(k) for k in KINDS]
    up = files.select("scope", "folder", *_message()).groupBy("scope", "folder").agg(*sums, F.count(F.lit(1)).alias("size"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    folders = materialize(up.withColumn("depth", depth), "folders")
    deepest = folders.agg(F.max("depth")).first()[0] or 0
    parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise("")
    levels: dict[int, DataFrame] = {}
    rising = None
    for level in range(deepest, -1, -1):
        own = folders.where(F.col("depth") == level).drop("depth")
        if rising is not None:
            own = own.unionByName(rising.select("scope", F.col("parent").alias("folder"), *KINDS, F.lit(0).cast("bigint").alias("size")))
        summed = own.groupBy("scope", "folder").agg(*sums, F.sum("size").alias("size")).withColumns({k: F.col(k) + weak[k] for k in KINDS})
        said = [m.alias(f"up_{k}") for m, k in zip(_message(), KINDS, strict=True)]
        levels[level] = materialize(summed.select("scope", "folder", parent.alias("parent"), "size", *KINDS, *said), "level")
        rising = levels[level].select("scope", "parent", *[F.col(f"up_{k}").alias(k) for k in KINDS])
    beliefs = levels[0].select("scope", "folder", "size", *[(F.col(k) + math.log(p)).alias(k) for k, p in zip(KINDS, PRIOR, strict=True)])
    done = beliefs
    for level in range(1, deepest + 1):
        above = beliefs.select("scope", F.col("folder").alias("parent"), *[F.col(k).alias(f"above_{k}") for k in KINDS])
        joined = levels[level].join(above, ["scope", "parent"]).withColumns({f"down_{k}": F.col(f"above_{k}") - F.col(f"up_{k}") for k in KINDS})
        heard = [m.alias(f"heard_{k}") for m, k in zip(_message("down_"), KINDS, strict=True)]
        beliefs = materialize(joined.select("scope", "folder", "size", *KINDS, *heard).select("scope", "folder", "size", *[(F.col(k) + F.col(f"heard_{k}")).alias(k) for k in KINDS]), "beliefs")
        done = done.unionByName(beliefs)
    said = files.select("scope", "repo", "source_file", "folder", *KINDS, *[m.alias(f"up_{k}") for m, k in zip(_message(), KINDS, strict=True)])
    joined = join_groups(said, materialize(done.select("scope", "folder", "size", *[F.col(k).alias(f"above_{k}") for k in KINDS]), "tree"), ["scope", "folder"])
    joined = joined.withColumns({f"down_{k}": F.col(f"above_{k}") - F.col(f"up_{k}") for k in KINDS})
    heard = [m.alias(f"heard_{k}") for m, k in zip(_message("down_"), KINDS, strict=True)]
    posterior = joined.select("repo", "source_file", *KINDS, *heard).select("repo", "source_file", *[(F.col(k) + F.col(f"heard_{k}") + math.log(p)).alias(k) for k, p in zip(KINDS, PRIOR, strict=True)])
    best = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when(F.col(k) == best, k) for k in KINDS])
    return posterior.withColumn("kind", kind)


def file_evidence(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """The written table of files with log evidence per kind: (scope, repo, source_file, folder, copied, regular, handwritten .. blob)."""
    none = F.lit(None).cast("string")
    scope = F.coalesce(F.concat(F.lit("repo "), F.col("repo")), F.lit("no repo"))
    own = files.where("file_text is not null").select(scope.alias("scope"), "repo", "source_file", F.col("modified_at").cast("timestamp").alias("modified_at"), "file_text")
    known = libraries.where("file_text is not null").select(none.alias("scope"), none.alias("repo"), F.col("file_name").alias("source_file"), F.lit(None).cast("timestamp").alias("modified_at"), "file_text")
    table = materialize(own.unionByName(known).mapInArrow(_features, _FEATURES).withColumn("row_no", F.monotonically_increasing_id()), "features")
    findings = ["text_key", "regular", "n", "line", "solid", "bare", "marked", "taken"]
    last = table.where("scope is not null").groupBy("scope", "repo", "source_file").agg(F.max(F.struct("modified_at", *findings, "row_no")).alias("row"))
    standing = materialize(last.select("scope", "repo", "source_file", *[F.col(f"row.{c}").alias(c) for c in [*findings, "row_no"]]), "standing")
    # texts of rows that do not stand are left out; a text key tells, so that no shingles move for it
    known_keys = standing.select("text_key").unionByName(table.where("scope is null").select("text_key")).distinct()
    stale = materialize(table.select("text_key").distinct().join(known_keys, "text_key", "left_anti"), "stale_texts")
    holders = standing.select("scope", "text_key", "row_no").unionByName(table.where("scope is null").select("scope", "text_key", "row_no"))
    fresh = table.select("text_key", "n_words", "shingles", "signature", "row_no")
    fresh = fresh if stale.isEmpty() else fresh.join(broadcast_if_small(stale), "text_key", "left_anti")
    copied = materialize(copied_texts(holders, fresh).withColumn("found", F.lit(True)), "copied")
    sized = standing.groupBy("text_key").agg(F.count(F.lit(1)).alias("size")).join(copied, "text_key", "left")
    sized = materialize(sized.select("text_key", "size", F.coalesce("found", F.lit(False)).alias("copied")), "copied_sizes")
    path = F.regexp_replace(F.regexp_replace("source_file", r"^(?:\.?/)+", ""), r"/(?:\.?/)+", "/")
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    looked = join_groups(standing, sized, ["text_key"])
    return materialize(looked.select("scope", "repo", "source_file", folder.alias("folder"), "copied", "regular", *_log_evidence()), "evidence")


def file_kinds(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(repo, source_file, kind, ...) of every code file given with its text."""
    return propagate(file_evidence(files, libraries))
