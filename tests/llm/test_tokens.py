import random

import pytest

from folioflow.llm import bpe_encode as E, fill_containers as FC, split_texts as ST
from folioflow.llm.token_sizes import rank_encoding

from .conftest import needs_tokenizers

ODD = ["", " ", "a", "Hello, world's end", "  two  spaces \n\n tail  ", "各Nefapufana試料は7.6パーセント", "naïve — ±5 µm", "<|endoftext|> ok", "🙂𝑥²", "ก้าวที่ 3", "\x00\x01", "x" * 3000, "á​", "1234567890" * 20, "'s 'S can't"]


@pytest.fixture(scope="module")
def encoder():
    return E.encoder_for(f"{E.TOKENIZERS_DIR}/byte_bpe_50k.tiktoken")


@needs_tokenizers
def test_ids_equal_the_public_tokenizer(encoder):
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 900), r.randrange(0x3040, 0x30FF), r.randrange(0x4E00, 0x9FFF), 0x20])) for _ in range(60)) for _ in range(300)]
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert encoder.encode_many(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@needs_tokenizers
def test_decoding_gives_the_text_back(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    for t in ODD:
        assert b"".join(back[i] for i in encoder.encode_many([t])[0]).decode() == t


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = E.PerfectHash(keys)
    assert sorted(h.slot_of.tolist()) == list(range(5000)) and h.find(keys, keys).tolist() == list(range(5000))
    assert h.find([b"absent", b""], keys).tolist() == [-1, -1]
    assert E.PerfectHash([]).find([b"x"], []).tolist() == [-1]


@needs_tokenizers
def test_column_keeps_rows_nulls_and_repeats(spark, tables):
    d = tables(documents=[{"doc_id": 1, "text": None}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": "a b"}, {"doc_id": 3, "text": "a b"}])
    got = sorted((r.doc_id, list(r.ids)) for r in E.p7_ids(spark, d).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert E.p7_ids(spark, tables()).collect() == []


def least_containers(sizes, cap):
    """Fewest containers by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k >= sizes[i]:
                rest = list(bins)
                rest.remove(k)
                go(i + 1, [*rest, k - sizes[i]])
        go(i + 1, [*bins, cap - sizes[i]])

    go(0, [])
    return best[0]


def test_packing_is_valid_and_close_to_the_least():
    r = random.Random(2)
    worse = 0
    for _ in range(150):
        cap = r.choice([10, 20, 50])
        sizes = [r.randrange(1, cap + 1) for _ in range(r.randrange(1, 10))]
        hist = {s: sizes.count(s) for s in sizes}
        patterns, _ = FC.pack_histogram(hist, cap)
        got = [s for p, c in patterns for s in p * c]
        assert sorted(got) == sorted(sizes) and all(sum(p) <= cap for p, _ in patterns)
        used, least = sum(c for _, c in patterns), least_containers(sizes, cap)
        assert used <= least + 1
        worse += used > least
    assert worse <= 8


def test_reduction_alone_never_costs_a_container():
    r = random.Random(3)
    for _ in range(120):
        cap = 24
        sizes = [r.randrange(3, cap + 1) for _ in range(r.randrange(2, 9))]
        pool = FC.Pool({s: sizes.count(s) for s in sizes})
        fixed = FC.reduce_instance(pool, cap)
        rest = [s for s, c in pool.n.items() for _ in range(c)]
        assert sum(c for _, c in fixed) + least_containers(rest, cap) == least_containers(sizes, cap)


def test_fill_divides_only_what_is_too_large(spark):
    rows = [(i, n) for i, n in enumerate([0, 0, 5, 10, 10, 23, 7, 3, 3, 3])]
    got = FC.fill(spark.createDataFrame([*rows, (9, 3)], "id int, size int"), "id", 10).collect()
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows) + 3
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 10
    assert sorted(r.n_tokens for r in got if r.id == 5) == [3, 10, 10] and {r.container for r in got if r.n_tokens == 0} == {0}
    assert FC.fill(spark.createDataFrame([], "id int, size int"), "id", 10).collect() == []


@needs_tokenizers
def test_containers_over_tables(spark, tables):
    lim = [{"limit_id": 1, "purpose": "FILL", "tokenizer": "byte_bpe_50k", "max_tokens": 8}]
    d = tables(documents=[{"doc_id": i, "text": t} for i, t in enumerate([None, "", "one two three", "a " * 30, "x"])], size_limits=lim)
    got = FC.p8_containers(spark, d).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4} and all(r.n_tokens <= 8 for r in got)
    assert FC.p8_containers(spark, tables(size_limits=lim)).collect() == [] and FC.p8_containers(spark, tables()).collect() == []


@pytest.fixture(scope="module")
def tool():
    import numpy as np

    e = rank_encoding("byte_bpe_50k", {"byte_bpe_50k": E.read_ranks(f"{E.TOKENIZERS_DIR}/byte_bpe_50k.tiktoken")})
    return e, np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], np.int64)


@needs_tokenizers
@pytest.mark.parametrize("overlap", [0, 5])
def test_pieces_give_the_text_back_within_the_limit(tool, overlap):
    r = random.Random(4)
    para = ["The first sentence stands here. A second one, for Fig. 3, follows! ", "各Nefapufana試料は低温でも安定している。", "คลังข้อความของเรา ", "word " * 30, "x" * 200, "🙂" * 40, "é" * 50, "\n\n2 Methods\nText goes on. ", "\n\n", "\r\n"]
    for _ in range(60):
        t = "".join(r.choice(para) for _ in range(r.randrange(1, 14)))
        got = ST.split_text(t, 40, overlap, *tool)
        n = len(tool[0].encode_ordinary(t))
        assert bool(got) == (n > 40)
        was, out = 0, ""
        for i, (a, b, k) in enumerate(got):
            assert k == len(tool[0].encode_ordinary(t[a:b])) and (k <= 40 or b - max(a, was) <= 1)
            assert a <= was < b and (a == was or i)
            out += t[was:b]
            was = b
        assert not got or out == t


@needs_tokenizers
def test_pieces_end_at_natural_places_and_share_the_overlap(tool):
    t = "\n\n".join(f"Paragraph {i} says this. It says that as well, in some more words than before." for i in range(12))
    got = ST.split_text(t, 60, 0, *tool)
    assert all(t[a:b].endswith("\n\n") for a, b, _ in got[:-1])
    got = ST.split_text(t, 60, 10, *tool)
    shared = [len(tool[0].encode_ordinary(t[a:z])) for (a, _, _), (_, z, _) in zip(got[1:], got)]
    assert min(shared) >= 10 and max(shared) <= 13
    assert ST.split_text(None, 5, 0, *tool) == [] and ST.split_text("", 5, 0, *tool) == []


@needs_tokenizers
def test_split_rows_over_tables(spark, tables):
    lim = [{"limit_id": 3, "purpose": "SPLIT", "tokenizer": "byte_bpe_50k", "max_tokens": 16, "overlap_tokens": 4}]
    d = tables(documents=[{"doc_id": 1, "text": "word " * 100}, {"doc_id": 2, "text": None}, {"doc_id": 3, "text": "short"}], size_limits=lim)
    got = sorted(ST.p9_pieces(spark, d).collect(), key=lambda r: r.piece_no)
    assert {r.doc_id for r in got} == {1} and "".join(r.piece[r.shared :] for r in got) == "word " * 100 and max(r.n_tokens for r in got) <= 16
    assert ST.p9_pieces(spark, tables()).collect() == []
