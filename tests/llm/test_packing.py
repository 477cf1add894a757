"""Cost-balanced packing."""
import random
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leakscope.llm.packing import LINEAR, Piece, Words, balanced, descending, pack_documents, sequences
from leakscope.llm.queries import balanced_packing, table

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, task string, start long"
ODD = ["", " ", "\n\n", "a", "It's  we'll", "<|endoftext|> x<|startoftext|>y", "é é ́x", "12 3４5", "日本語テキスト", "😀😀 a b c\u0085d", "ΑΣ ΟΔΟΣ", "a\x0bb\x0cc\x1cd", "İstanbul ǅ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 5) for i, t in rows], SCHEMA)


def test_ids_are_those_of_the_whole_text(tokenizer):
    random.seed(1)
    texts = [*ODD, "<|ENDOFTEXT|> A", *("".join(random.choices([*"aZ'st 1é́\n\t ςΣ", "<|endoftext|>", "'LL ", "Ab, "], k=60)) for _ in range(300))]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for words, stretch in ((Words(PATH), 1 << 20), (Words(PATH), 40), (Words(PATH), 7), (Words(PATH, limit=3000), 7)):
        assert [ids.tolist() for ids in words.ids(pa.array(texts), stretch)] == want
    assert len(words) < 60  # a full table starts anew
    assert list(words.ids(pa.array([], pa.string()))) == []
    assert [ids.tolist() for ids in words.ids(pa.array(["x", None, "", "\x01 a\x01"]).slice(1))] == [[], [], tokenizer.encode("\x01 a\x01").ids]


def test_query_holds_every_id_once(spark, sf, tokenizer):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    brute.check_packing([r.asDict() for r in balanced_packing(spark, sf).collect()], {i: encoded(tokenizer, t) for i, t in rows}, 4096)


@pytest.mark.parametrize("parts, group_tokens", [(1, 1 << 20), (7, 1 << 20), (7, 100)])
def test_several_blocks_tasks_and_groups(spark, tokenizer, parts, group_tokens):
    random.seed(parts)
    rows = [(i, " ".join(random.choices(["red", "ocean", "42", "unknowable", "x"], k=random.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "word " * 5000)]
    docs = docs_of(spark, rows).repartition(parts)
    out = pack_documents(docs, PATH, capacity=256, block_tokens=2000, group_tokens=group_tokens)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    sizes = brute.check_packing([r.asDict() for r in out.collect()], {i: encoded(tokenizer, t) for i, t in rows}, 256)
    assert sum(s < 256 for s in sizes) <= (1 if group_tokens > 100 else parts)


def test_null_and_repeated_ids_and_empty_table(spark, tokenizer):
    out = pack_documents(docs_of(spark, [(None, "a b"), (None, "a b"), (4, "c"), (4, "c"), (4, None)]), PATH).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in out) == [("4", 1), ("4", 2), ("4", 2), ("None", 3), ("None", 3)]
    assert len({r.sequence_id for r in out}) == 1 and sorted(r.offset for r in out)[0] == 0
    assert pack_documents(docs_of(spark, []), PATH).count() == 0


def pieces_of(sizes):
    return [Piece(i, 0, bytes(4 * n), n) for i, n in enumerate(sizes)]


def test_rule_like_plain_version():
    random.seed(5)
    for _ in range(50):
        sizes = [random.choice([1, 2, 3, 10, 50, 120]) for _ in range(random.randrange(1, 60))]
        room = [64] * (sum(sizes) // 64) + ([sum(sizes) % 64] if sum(sizes) % 64 else [])
        got = [(p.doc_id, p.start, p.size, s, at) for p, s, at in balanced(pieces_of(sizes), room, 100)]
        assert got == brute.balanced(sizes, room, 100)


@pytest.mark.parametrize("longest", [500, 1500])
def test_costs_are_closer_than_without_the_rule(longest):
    random.seed(9)
    sizes = [min(int(random.paretovariate(0.9) * 40), longest) for _ in range(6000)]
    room = [4096] * (sum(sizes) // 4096) + [sum(sizes) % 4096]

    def spread(placed):
        cost = defaultdict(int)
        for p, s, _ in placed:
            cost[s] += p.size * (LINEAR + p.size)
        costs = [cost[s] for s, n in enumerate(room) if n == 4096]
        return max(costs) - min(costs)

    def in_order(pieces):
        s, free = 0, list(room)
        for piece in pieces:
            while piece.size:
                head, piece = piece.cut(min(piece.size, free[s]))
                yield head, s, room[s] - free[s]
                free[s] -= head.size
                s += free[s] == 0

    ours = spread(balanced(pieces_of(sizes), room, LINEAR))
    assert ours < 0.2 * spread(in_order(pieces_of(sizes)))
    assert ours < 0.2 * spread(in_order(descending(pieces_of(sizes))))


def test_sequences_sum_tokens_and_cost(spark):
    df = spark.createDataFrame([(1, 10), (1, 5), (2, 3)], "sequence_id long, length long")
    got = {r.sequence_id: (r.tokens, r.pieces, r.cost) for r in sequences(df, linear=7).collect()}
    assert got == {1: (15, 2, 10 * 17 + 5 * 12), 2: (3, 1, 30)}
