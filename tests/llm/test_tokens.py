"""Packing and token counts against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kiln.llm import packing, pretoken, textcodes, tokencount

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "it's 'the ''s don't I'll we've x're\n's 's\t'll", "a\n\nb\n", "<|endoftext|> hi<|startoftext|>",
       "İstanbul Σίσυφος ΣΑΣ", "été été", "123 4567 a1b2 ½ ٣", "😀 hello 日本語 テキスト", "x" * 3000 + " " + "ab" * 400,
       "\x00\x1c a\x85b　c '", "'", "'s", "a'", "a's", "  's", "foo'lL 'LL 'S", " " * 50, "\n \n a", "tab\tx", "a b", "_x_ %% $$'s", "won't" * 90]
TABLE = "doc_id long, text string, n_tokens string, start string"


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    library = Tokenizer.from_file(path)
    enc = pretoken.Encoder(path)
    texts = ODD + ["word piece " * 60_000 + "end"]
    got = {i: [] for i in range(len(texts))}
    for i, ids in enc.encode(texts):
        got[i] += ids.tolist()
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_with_a_cache_that_is_emptied(path):
    library = Tokenizer.from_file(path)
    enc = pretoken.Encoder(path, cache_words=8)
    texts = [" ".join(f"w{k}x{i}" for k in range(30)) for i in range(20)]
    for i, ids in enc.encode(texts):
        assert ids.tolist() == library.encode(texts[i], add_special_tokens=False).ids


def test_hash_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 300_000, dtype=np.uint64))
    table = textcodes.HashTable(4)
    for part in np.array_split(np.arange(len(keys)), 7):
        table.put(keys[part], part)
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def thue_morse(a, b, n=256):
    word = "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    return [word, word.translate({ord(a): b, ord(b): a})]


COLLIDING = [w for a, b in ("榶縄", "泛余") for w in thue_morse(a, b)]


def test_words_of_one_hash_are_told_apart(spark):
    block = textcodes.Block(COLLIDING, list(range(4)))
    h = textcodes.span_hash(textcodes.prefix_hash(block.codes), block.begin, block.end)
    assert h[0] == h[1] and h[2] == h[3]  # the case this test is about
    for path in (BYTES, WORDS):
        for order in (COLLIDING, COLLIDING[::-1], COLLIDING + COLLIDING):
            enc = pretoken.Encoder(path)
            assert [ids.tolist() for _, ids in enc.encode(order)] == [ids_of(path, t) for t in order]
    df = spark.createDataFrame(list(enumerate(COLLIDING + COLLIDING[:2])), "doc_id long, text string").coalesce(1)
    for entries in (1, 2, 100):
        got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(df, BYTES, entries=entries).collect()}
        assert got == {i: len(ids_of(BYTES, t)) for i, t in enumerate(COLLIDING + COLLIDING[:2])}
    words, number = textcodes.words_of(["ab", *COLLIDING, "cd", "ab"])
    assert sorted(number.tolist()).count(-1) == 2 and words.text(int(number[0])) == "ab"
    check_pack([(i, t) for i, t in enumerate(COLLIDING)], packing.pack(df.where("doc_id < 4"), WORDS).collect())


def test_frequent_words_are_counted_over_all_documents(spark):
    texts = [" rare", " the cat", " the dog", " the the", " cat"] * 3 + [" b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert tokencount.frequent_words(df, BYTES, entries=3) == [" the", " cat", " dog"]  # ties by text


def test_count_tokens(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id", None, None), (7, None, None, None), (7, ODD[7], "x", "y")]
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    got = sorted(map(tuple, tokencount.count_tokens(df, BYTES, limit=100, entries=5).collect()), key=str)
    want = [(i, len((t or "").encode()), len(ids_of(BYTES, t)), len(ids_of(BYTES, t)) > 100) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(df.limit(0), BYTES).collect() == []


def check_pack(rows, pieces):
    """Every id in exactly one piece, sequences without gaps."""
    want = sorted((str(i), tuple(ids_of(WORDS, t) + [packing.END_ID])) for i, t in rows)
    tokens = sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert tokens == sorted((i, len(x)) for i, x in want)
    by_id = {}
    for i, x in want:
        by_id.setdefault(i, set()).add(x)
    for p in pieces:
        part = [zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for x in by_id[str(p["doc_id"])] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in part and p["length"] > 0
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in want)
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    return at


def test_pack(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, n))) for i, n in enumerate(rng.integers(0, 900, 120))]
    rows += [(200, "long " * 20_000), (201, None), (None, "no id"), (202, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], TABLE).repartition(2)
    pieces = packing.pack(df, WORDS, buffer_tokens=20_000).collect()
    sizes = check_pack(rows, pieces)
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())
    assert sum(n in packing.TIERS for n in sizes.values()) > 0.9 * len(sizes) - 24
    groups = {}
    for p in pieces:
        groups[p["step_group"]] = groups.get(p["step_group"], 0) + p["length"]
    assert max(groups.values()) <= packing.STEP_TOKENS + 4096
    assert packing.pack(df.limit(0), WORDS).collect() == []


def test_packer_fills_long_windows_from_shorter_tiers():
    packer = packing.Packer()
    done = packer.pack([(0, 3000), (1, 700), (2, 400), (3, 90)], True)
    windows = {n: sorted(x[1] for x in pieces) for n, _, pieces in done if n == 4096}
    assert windows == {4096: [0, 1, 2]} or windows == {4096: [0, 1, 2, 3]}
    assert sum(n for n, _, _ in done) == 4190
