"""The operators on texts against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pytest

from weftmark.llm import encode, handwritten, packing, reading_level

ODD = ["", None, "   ", "\n\n \t x", "don't we'll I'VE", "naïve Züge 🙂🚀 👩‍💻", "a\u00a0b\u3000c\u2028d\u0085e", "x" * 30000, "1234567 ½ ²", "\ufffd\u0000\u200b", "𞥇𞤨 \U0001e5d0\U00016d40 ꟍ", "<|endoftext|> end", "tab\tand  two   spaces \n", "éé", "```py\nprint('x')\n```\r\n"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encode_equals_the_tokenizer_and_decodes(spark):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(ODD[3] + "aé ' \n1🙂") for _ in range(draw.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids", "'x' as word").repartition(3)
    got = encode.encode(docs)
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert [ids[i] for i in range(len(texts))] == reference_ids(texts)
    back = {r.doc_id: r.text for r in encode.decode(got).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(docs).collect()} == {i: len(x) for i, x in ids.items()}
    assert encode.encode(docs.limit(0)).count() == 0


def test_blocks_end_by_documents_and_by_words():
    big = encode.BLOCK_WORDS
    assert encode._cuts([]) == [0, 0] and encode._cuts([big + 5]) == [0, 1]
    assert encode._cuts([1, big, 1, big - 1, 0, 1]) == [0, 1, 2, 5, 6]
    assert encode._cuts([0] * (encode.BLOCK * 2 + 1)) == [0, encode.BLOCK, encode.BLOCK * 2, encode.BLOCK * 2 + 1]


def placed(spark, sizes, capacities):
    frame = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    return packing.pack(frame, capacities).toPandas()


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_places_everything_once(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = [(i, int(n)) for i, n in enumerate(np.concatenate([draw.integers(0, 40, 300), np.full(250, 7), draw.integers(90, 1000, 20)]))] + [(5, 64), (5, 64), (900, None)]
    got = placed(spark, sizes, {1: 64, 2: 100})
    for window, capacity in ((1, 64), (2, 100)):
        own = got[got.window_id == window]
        total = sum(n or 0 for _, n in sizes)
        assert own.n_tokens.sum() == total
        pieces = own[own.n_tokens > 0].sort_values(["window_no", "position"])
        assert pieces.n_tokens.max() <= capacity and not pieces.duplicated(["window_no", "position"]).any()
        for _, held in pieces.groupby("window_no"):
            assert held.n_tokens.sum() <= capacity
            assert held.position.tolist() == list(range(len(held)))
            assert held.token_offset.tolist() == [0, *np.cumsum(held.n_tokens)[:-1].tolist()]
        windows = int(pieces.window_no.max()) + 1
        assert sorted(pieces.window_no.unique()) == list(range(windows))
        assert windows <= -(-total // capacity) + 2
        whole = own[own.doc_id.isin([i for i, n in sizes if i != 5 and (n or 0) <= capacity])]
        assert (whole.piece_no == 0).all() and len(whole) == len({i for i, n in sizes if i != 5 and (n or 0) <= capacity})
        assert own[own.n_tokens == 0].window_no.isna().all()
    assert len(placed(spark, [], {1: 64})) == 0


def test_fitted_counts_do_not_exceed_the_histogram():
    histogram = {3: 5, 4: 7, 6: 2, 10: 4}
    used = {}
    for n, pattern in packing.plan(histogram, 10):
        assert sum(x * k for x, k in pattern) <= 10 and n > 0
        for x, k in pattern:
            used[x] = used.get(x, 0) + n * k
    assert used == histogram


EASY, HARD = "We like my map. The bag is red. Look at the list first.", "The methodological underdetermination of diachronic criteria necessitates a principled formalisation. The ontological status of inferred relations substantiates the argument."


def test_reading_bands(spark):
    examples = spark.createDataFrame([(EASY, 1), (EASY + " You see our pen.", 1), (HARD, 4), (HARD + " The irreducible contingency attenuates the argument.", 4), (None, 2), ("x", None)], "text string, reading_band int")
    docs = [
        (1, "Look at the red list. We like the bag."), (2, "# Title\n\n| a | b |\n|---|---|\n\n" + HARD), (3, "We like my map. " + HARD), (4, None), (5, " \n\u3000"), (6, "no prose here"), (7, "the red map"),
        (8, "```py\n# We like my map. The bag is red.\n```\n\n" + HARD), (9, "%%%"), (1, "We like my map. The bag is red. Look at the list first."), (10, "- src/a_b.py\n- x_y/z.rs\n\n" + EASY), (11, "The criteria of\nontological underdetermination\nsubstantiates the argument."),
    ]
    got = reading_level.reading_bands(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'?' as band", "0 as words"), examples)
    bands = sorted((r.doc_id, r.reading_band) for r in got.collect())
    assert [x for x in bands if x[0] in (1, 2, 3, 7, 8, 10, 11)] == [(1, 1), (1, 1), (2, 4), (3, 4), (7, 1), (8, 4), (10, 1), (11, 4)]
    assert {x[0] for x in bands} == {1, 2, 3, 6, 7, 8, 9, 10, 11} and dict(bands)[9] == 2


def test_reading_bands_on_held_out_examples(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/reading_samples.parquet")
    docs = given.where("sample_id % 4 = 0").selectExpr("cast(sample_id as bigint) as doc_id", "text", "reading_band as truth")
    got = reading_level.reading_bands(docs, given.where("sample_id % 4 <> 0")).join(docs, "doc_id")
    assert got.where("truth = reading_band").count() >= 0.95 * docs.count()


def test_word_difficulty_against_brute_force(spark):
    """The same rounds over dictionaries of sentences; five blocks."""
    draw = random.Random(4)
    text = lambda: " ".join(" ".join(draw.choice("abcdefghijklmnop") * 2 for _ in range(draw.randrange(3, 8))) + "." for _ in range(draw.randrange(1, 4)))
    rows = [(None, text(), 1 + i % 4) for i in range(6)] + [(i, text(), None) for i in range(40)]
    corpus = reading_level._Corpus(spark.createDataFrame(rows, "doc bigint, text string, band int").repartition(5))
    words, rounds = reading_level.word_difficulty(corpus, 0.001)
    got = {r.word: (r.difficulty, r.weight) for r in words.read().collect()}
    words.drop()
    corpus.drop()
    sentences = [(part.split(), band) for _, t, band in rows for part in t.rstrip(".").split(". ")]
    sentences = [([w.strip(".") for w in ws], band) for ws, band in sentences]
    known = {}
    for _ in range(rounds):
        sums = {}
        for ws, band in sentences:
            weights = [(known[w][1], known[w][0]) for w in ws if w in known]
            if band is None and not weights:
                continue
            y = band or sum(k * d for k, d in weights) / sum(k for k, _ in weights)
            for w in ws:
                n, s, ss = sums.setdefault(w, {}).get(bool(band), (0, 0, 0))
                sums[w][bool(band)] = (n + 1, s + y, ss + y * y)
        known = {}
        for w, of in sums.items():
            share = {True: reading_level.ANCHOR, False: 1 - reading_level.ANCHOR} if len(of) == 2 else dict.fromkeys(of, 1.0)
            mean, square = (sum(share[g] * v[i] / v[0] for g, v in of.items()) for i in (1, 2))
            known[w] = (mean, 1 / (max(square - mean * mean, 0) + reading_level.SPREAD + 1 / sum(v[0] for v in of.values())))
    assert rounds > 2 and got.keys() == known.keys()
    assert all(np.allclose(got[w], known[w]) for w in known)


PY = "import a\n\ndef read_{0}(x):\n    # keep the {0} of every row\n    for item in x:\n        if item > {1}:\n            return item * {1}\n    return None\n\nclass {0}Store:\n    def __init__(self, path):\n        self.path = path\n\n    def size(self):\n        return len(self.path) + {1}\n"


def test_file_kinds(spark):
    library = "def pack(items, limit):\n    out = []\n    total = 0\n    for value in items:\n        if total + value > limit:\n            yield out\n            out, total = [], 0\n        out.append(value)\n        total += value\n    yield out\n"
    rows = [("r", f"src/m{i}.py", PY.format(f"name{i}", i)) for i in range(12)]
    rows += [
        ("r", "src/gen/a.py", "# Code generated by protoc. DO NOT EDIT.\n" + PY.format("gen", 3)), ("r", "src/tool.py", "# Writes the banner:\n# \"Code generated by %s. DO NOT EDIT.\"\n" + PY.format("tool", 4)),
        ("r", "web/x.min.js", "!function(a){var b=1,c=a;for(var d=0;d<c.length;d++)b+=c[d];return b}(this);" * 20), ("r", "assets/t.py", "T = [\n" + "  0x1f, 0x2e, 0x3d, 0x4c,\n" * 40 + "]\n"),
        ("r", "lib/p.py", "\r\n".join(x.replace("    ", "\t") for x in library.split("\n"))), ("s", "lib/q.py", library.replace("limit", "limit") + "# end\n"), ("r", "src/m1.py", PY.format("name1", 1)), ("r", "src/empty.py", ""), ("r", "src/none.py", None), (None, "a.py", PY.format("solo", 9)), ("s", None, PY.format("nowhere", 8)),
    ]
    files = spark.createDataFrame([(*r, None, 1) for r in rows], "repo string, source_file string, file_text string, modified_at timestamp, kind int")
    libraries = spark.createDataFrame([("pack.py", library), ("none.py", None)], "file_name string, file_text string")
    got = {(r.repo, r.source_file): r.kind for r in handwritten.file_kinds(files, libraries).collect()}
    other = {k: v for k, v in got.items() if v != "handwritten"}
    assert other == {("r", "src/gen/a.py"): "generated", ("r", "web/x.min.js"): "minified", ("r", "assets/t.py"): "blob", ("r", "lib/p.py"): "vendored", ("s", "lib/q.py"): "vendored"}
    assert len(got) == 21 and ("r", "src/none.py") not in got
    assert handwritten.file_kinds(files.limit(0), libraries.limit(0)).count() == 0


def kinds_of(spark, rows, libraries=()):
    files = spark.createDataFrame([(*r, None) for r in rows], "repo string, source_file string, file_text string, modified_at timestamp")
    known = spark.createDataFrame([(f"l{i}", x) for i, x in enumerate(libraries)], "file_name string, file_text string")
    return [(r.repo, r.source_file, r.kind) for r in handwritten.file_kinds(files, known).collect()]


def test_every_file_comes_once_whatever_its_repo_and_path(spark):
    """Null and empty repos are different ones; leading and repeated slashes and ./ make no second folder."""
    rows = [(repo, path, PY.format(f"n{i}{j}", j)) for i, repo in enumerate((None, "", "r")) for j, path in enumerate(("src/n.py", "n.py", "src/deep/er/n.py", None))]
    rows += [("s", "/b.py", PY.format("b", 1)), ("s", "a//c.py", PY.format("c", 2)), ("s", "./a/d.py", PY.format("d", 3)), ("s", "a/./e.py", PY.format("e", 4)), *(("s", f"/a/f{i}.py", PY.format(f"f{i}", i)) for i in range(400))]
    got = kinds_of(spark, rows)
    assert len(got) == len(rows)
    assert {(r, p) for r, p, _ in got} == {(r, p) for r, p, _ in rows} and {k for *_, k in got} == {"handwritten"}


def test_short_identical_copies_and_quoted_marks(spark):
    short = "let total = first + second * third - fourth;"
    rows = [("r", "lib/x.js", short), ("s", "lib/y.js", short.replace(" ", "  ")), ("r", "lib/z.js", short.replace("first", "other"))]
    rows += [("t", "a.py", "# Tells readers that \"Code generated by a tool. DO NOT EDIT.\" stands there.\n" + PY.format("a", 1)), ("t", "b.py", PY.format("b", 2) + "# Code generated by no tool at all\n")]
    rows += [("t", "c.py", "# generated by widgetgen 3\n" + PY.format("c", 3)), ("t", "d.py", "# Copyright (c) 2019 the otherlib contributors\n# otherlib v2.4.1\n" + PY.format("d", 4))]
    got = {(r, p): k for r, p, k in kinds_of(spark, rows, [short])}
    assert got[("r", "lib/x.js")] == got[("s", "lib/y.js")] == "vendored" and got[("r", "lib/z.js")] == "handwritten"
    assert [got[("t", f"{x}.py")] for x in "abcd"] == ["handwritten", "handwritten", "generated", "vendored"]


def test_words_and_settings_against_plain_python():
    import re

    import pyarrow as pa

    draw = random.Random(9)
    for texts in (["", "abc", "def ghi", "", "x", "y z\n\n  \nq", "ü_1 é", "", "\n", "a"], [""], [" ", "  a"], ["".join(draw.choice("ab_1 .\n\té") for _ in range(draw.randrange(40))) for _ in range(300)]):
        array = pa.array(texts)
        data, at = handwritten._bytes(array)
        words, n_words = handwritten._words(data, at)
        plain = [re.findall(rb"[A-Za-z0-9_\x80-\xff]+", t.encode()) for t in texts]
        assert n_words.tolist() == [len(x) for x in plain]
        numbers = {}
        assert all(numbers.setdefault(w, x) == x for w, x in zip([w for x in plain for w in x], words.tolist(), strict=True)) and len(set(numbers.values())) == len(numbers)
        n, line, solid, _ = handwritten._setting(array, data, at)
        assert n.tolist() == [max(len(t), 1) for t in texts]
        assert np.allclose(line, [max(len(t), 1) / max(sum(bool(x.strip()) for x in t.split("\n")), 1) for t in texts])
        assert solid.tolist() == [len("".join(t.split())) for t in texts]


def alike(x, y):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
    return bool(x | y) and len(x & y) >= handwritten.SIMILAR * len(x | y)


def test_every_patched_copy_is_found(spark):
    """Copies of a library text patched each for itself, below the limit to each other, and smaller families without a library."""
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]

    def patched(text, n):
        return [f"p{draw.randrange(10**6)}" if i in at else w for at in [draw.sample(range(5, len(text) - 5, 6), n)] for i, w in enumerate(text)]

    kept = words(300)
    texts = [(None, kept), *((f"r{i}", patched(kept, 6)) for i in range(40))]
    for family in range(30):
        start = words(draw.choice([20, 60, 150]))
        texts += [(f"r{draw.randrange(4)}", patched(start, draw.randrange(len(start) // 20 + 1) % 4)) for _ in range(4)]
    texts += [("r1", ["short", "words"]), ("r2", ["short", "words"]), ("r1", ["of", "one"]), ("r1", []), ("r2", [])]
    unlike = sum(not alike(x, y) for _, x in texts[1:41] for _, y in texts[1:41])
    assert all(alike(kept, x) for _, x in texts[:41]) and unlike > 1000
    near = [[j for j, (_, y) in enumerate(texts) if x and (x == y or alike(x, y))] for _, x in texts]
    spread = {i for i, js in enumerate(near) if any(texts[j][0] is None or texts[j][0] != texts[i][0] for j in js)}
    expected = {i for i, js in enumerate(near) if i in spread or spread & set(js)} - {0}
    files = spark.createDataFrame([(r, f"f{i}", " ".join(t), None) for i, (r, t) in enumerate(texts) if r], "repo string, source_file string, file_text string, modified_at timestamp")
    libraries = spark.createDataFrame([("kept", " ".join(kept))], "file_name string, file_text string")
    got = {int(r.source_file[1:]) for r in handwritten.file_evidence(files, libraries).where("copied").collect()}
    assert got == expected and set(range(1, 41)) < got < set(range(1, len(texts)))


def test_shingles_against_brute_force():
    words = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9, 9], np.uint64)
    sets = handwritten.shingle_sets(words, np.array([11, 2, 0]))
    assert [len(s) for s in sets] == [6, 0, 0]  # seven windows, of which the first and last are alike


def test_queries_are_registered():
    from weftmark.llm import queries

    assert {"p3_found", "p5_found", "p6_ids", "p7_windows", "p8_found"} <= set(queries.QUERIES)
    assert set(queries.SQL) <= set(queries.QUERIES)
