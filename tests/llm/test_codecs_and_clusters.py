"""Byte-level BPE, fill-in-middle and ball-tree clustering against libraries and plain code."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import ball_tree, byte_bpe, fill_in_middle

DOC = "doc_id long, text string"
RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(df):
    """With strangers named like columns that operators use inside."""
    return df.withColumns({"ids": F.lit(1), "output": F.lit("x"), "units": F.lit("y"), "n": F.lit(2), "cluster": F.lit(3), "v": F.lit(None).cast("string")})


TEXTS = [None, "", " ", "a", "The quick brown fox's 12 jumps\n\n  over", "<P>not<S>for<M>filling", "é😀漢字 नमस्ते \U0010ffff", "x" * 5000, "ab " * 3000 + "\n", "same text", "same text", "a\x00b\x1c\x85 c", "<", ">", "<<P", "ü̈" * 40]


# ---------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_every_token_is_its_own_encoding(codec):
    assert not codec.merges.orphans
    assert all(codec.machine.encode(token) == [rank] for token, rank in codec.merges.ranks.items())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("etaoin shr'ld12\n", max_size=120), st.text("ab", max_size=80), st.lists(st.sampled_from(["ation", " the", "ing", "'s", "  ", "é", "ß", "中"]), max_size=30).map("".join)))
def test_ids_are_the_librarys(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text


def test_transducer_waits_no_longer_than_the_longest_token(codec):
    longest = max(map(len, codec.merges.ranks))
    rng, run, out, fed = random.Random(5), codec.machine.start(), [], b""
    for _ in range(600):
        piece = "".join(rng.choice("etaoinshrdlu") for _ in range(3)).encode()
        fed += piece
        out += run.feed(piece)
        assert len(fed) - sum(len(codec.merges.bytes[x]) for x in out) <= 2 * longest
    out += run.finish()
    assert b"".join(codec.merges.bytes[x] for x in out) == fed and out == codec.machine.encode(fed)


def test_forgetting_steps_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEPS", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "LISTED", 20)
    monkeypatch.setattr(byte_bpe, "BLOCK", 2)
    small = byte_bpe.Codec(RANKS, PATTERN)
    for text in TEXTS[1:]:
        assert small.encode(text) == library.encode_ordinary(text)
        assert small.decode(small.encode(text)) == text


def test_a_vocabulary_with_tokens_that_merges_cannot_make():
    ranks = {bytes([x]): x for x in range(256)} | {b"ab": 256, b"abcd": 257, b"cde": 258, b"xyz": 259}
    codec = byte_bpe.Merges(ranks)
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe.Transducer(codec)
    assert set(codec.orphans) == {b"abcd", b"cde", b"xyz"}
    for text in ("abcd", "abcde", "xyz", "xyzab", "aabab", "abab"):
        data = text.encode()
        assert ([codec.orphans[data]] if data in codec.orphans else machine.encode(data)) == own.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=40), st.text(max_size=20).map(lambda t: t.encode()[1:]), st.text(max_size=20).map(lambda t: t.encode()[:-1])))
def test_streaming_decoder_is_pythons(codec, data):
    ids = [codec.merges.ranks[data[i : i + 1]] for i in range(len(data))]
    run = codec.decoder()
    assert "".join(run.feed([x]) for x in ids) + run.finish() == data.decode(errors="replace")


def test_byte_bpe_rows(spark, library):
    df = odd(spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "no id")], DOC))
    want = []
    for i, text in [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id")]:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    got = [tuple(r) for r in byte_bpe.digest(df, RANKS, PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    there = byte_bpe.encode(df, RANKS, PATTERN)
    assert {r.doc_id: list(r.ids) for r in there.where("doc_id IS NOT NULL").collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in byte_bpe.decode(there, RANKS, PATTERN).where("doc_id IS NOT NULL").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe.digest(df.limit(0), RANKS, PATTERN).count() == 0


# ---------------------------------------------------------------- 12


def filled(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_is_plain_code(spark):
    rng = random.Random(8)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice("ab é\n😀<>PSM") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, "a second text of one id"), (None, "no id"), (900, "long é " * 200_000)]
    df = odd(spark.createDataFrame(rows, DOC)).repartition(3)
    got = fill_in_middle.transform(df).collect()
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == sorted((str(i), n, f, str(a), str(m), o) for i, t in rows for n, f, a, m, o in [filled(i, t)])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = fill_in_middle.transform(df, fill_in_middle.DIGESTS).collect()
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in digests) == sorted((str(i), sha(filled(i, t)[4]), sha(t or "")) for i, t in rows)
    back = fill_in_middle.restore(fill_in_middle.transform(df)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert fill_in_middle.transform(df.limit(0)).count() == 0
    assert fill_in_middle.restore(spark.createDataFrame([(1, None, "psm")], "doc_id long, output string, form string")).first().text is None


def test_fill_in_middle_by_words(spark):
    df = spark.createDataFrame([(i, f"some words stand here {i} and there") for i in range(40)] + [(99, "a-b")], DOC)
    rows = fill_in_middle.transform(df, unit=r"\s*\w+", rate=100, spm_rate=50).collect()
    assert {r.n for r in rows if r.doc_id != 99} == {7}
    assert {r.form for r in rows if r.doc_id == 99} == {"plain"}  # the pattern does not reach the hyphen
    assert {r.form for r in rows if r.doc_id != 99} == {"psm", "spm"}
    back = fill_in_middle.restore(spark.createDataFrame([(r.doc_id, r.output, r.form) for r in rows], "doc_id long, output string, form string"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in df.collect()}


# ---------------------------------------------------------------- 13


def lloyd(vectors, k, rounds, scale=64):
    """Plain rounds over [(id, components)], in Python's integers."""
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in vectors]
    start = sorted(x, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        of = [nearest(v)[0] for _, v in x]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(x, of) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, *nearest(v)) for i, v in x]
    whole = sum(d for _, _, d in out)
    return sorted((i, c, d, sum(e for _, b, e in out if b == c), whole, sha(",".join(map(str, centroids[c])))) for i, c, d in out)


@pytest.mark.parametrize("shape", ["random", "clusters", "copies", "far"])
def test_ball_tree_is_plain_lloyd(spark, monkeypatch, shape):
    monkeypatch.setattr(ball_tree, "BLOCK_ROWS", 97)
    rng = np.random.default_rng(4)
    n, width = 400, 8
    x = rng.normal(size=(n, width)) if shape == "random" else rng.normal(size=(5, width))[rng.integers(0, 5, n)] * 20 + rng.normal(size=(n, width)) * 0.05
    if shape == "copies":
        x[: n // 2] = x[0]
        x[n // 2 : n // 2 + 50] = 0.0
    if shape == "far":
        x *= 4_000.0
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (5, (x[5] + 1).tolist())]
    bad = [(1000, None), (1001, [1.0] * 7), (1002, [1.0] * 9), (1003, [None] + [1.0] * 7), (1004, [float("nan")] + [1.0] * 7), (1005, [float("-inf")] + [1.0] * 7), (1006, []), (1007, [1e30] * 8)]
    df = odd(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).repartition(3)
    got = ball_tree.report(*ball_tree.cluster(df, k=6, dimensions=width))
    assert sorted(tuple(r) for r in got.collect()) == lloyd(rows, 6, 3)


def test_balls_are_used_and_leaves_are_exact():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(6, 16)) * 2000).astype(np.int64)[rng.integers(0, 6, 3000)] + rng.integers(-5, 6, (3000, 16))
    row = ball_tree.pack(list(range(3000)), x)
    batch = ball_tree.pa.RecordBatch.from_pylist([row], ball_tree._ARROW)
    ids, block = next(iter(ball_tree.unpacked(batch)))
    assert (block["vectors"] == x[ids.to_numpy()]).all()
    centroids = x[:6]
    balls, of, rows, clusters = ball_tree.descend(block, centroids)
    cluster = np.full(3000, -1)
    for a, b, c in zip(block["start"][balls], block["stop"][balls], of):
        assert (cluster[a:b] == -1).all()
        cluster[a:b] = c
    assert (cluster[rows] == -1).all()
    cluster[rows] = clusters
    assert (cluster == ball_tree.distances(block["vectors"], centroids).argmin(1)).all()
    assert len(rows) < 1500  # most vectors go by whole balls
    for i in range(len(block["start"])):
        own = block["vectors"][block["start"][i] : block["stop"][i]]
        assert (block["total"][i] == own.sum(0)).all() and np.sqrt(ball_tree.distances(own, block["pivot"][i][None]).max()) <= block["radius"][i] + 1e-9


def test_ball_tree_of_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.report(*ball_tree.cluster(empty)).count() == 0
    one = spark.createDataFrame([(7, [0.5] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    rows = ball_tree.report(*ball_tree.cluster(one, k=1)).orderBy(F.col("vec_id").desc_nulls_last()).collect()
    # Both in the cluster of vector 7, whose centroid moves to the floor of the mean.
    assert [(r.vec_id, r.cluster, r.distance) for r in rows] == [(7, 0, 64 * 16**2), (None, 0, 64 * 16**2)]
    two = ball_tree.report(*ball_tree.cluster(one)).collect()
    assert sorted(r.distance for r in two) == [0, 0] and {r.inertia for r in two} == {0}
