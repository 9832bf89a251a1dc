"""Trie, repair and packing against plain versions, with odd rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from plain import cheapest, repairs, trie

from tideline.llm import conversation_repair, conversation_trie, packing, queries
from tideline.llm.turns import running

SMALL = "/root/testdata/sf0.001"
TALK = "conv_id bigint, turn bigint, role string, text string, digest string, pos string, name string, key string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
REPORT = (*conversation_repair.FOUND, "repaired_sha256")


def made(seed: int, convs: int) -> list[tuple]:
    """Conversations that share openings and repeat texts, with nulls, ties, repeated rows, odd roles and one long talk."""
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "\t \n", "", "é ü!", None, "Go on.\n", "So it is", "x" * 50_000 + "."]
    rows = []
    for c in [*range(convs), 4000, 4001, -7, -10]:
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t + rng.choice([0, 0, 0, 2]), rng.choice([role, role, role, "system", "tool", "", None]), texts[rng.randrange(4 if rng.random() < 0.7 else len(texts))]))
    rows += [(3, None, "user", "Well."), (3, None, None, None), (3, None, "user", "Well.")] * 2 + [(None, 1, "user", "Lost."), (None, None, None, None)]
    rows += [(5000, t, ("user", "assistant")[t % 2], "Turn %d." % (t % 7 if t > 40 else t)) for t in range(1500)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", "q", "q", "q") for r in rows], TALK)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_walk(spark, seed):
    rows = [r for r in made(seed, 40) if r[0] != 5000 or r[1] < 200]
    got = conversation_trie.opening_trie(frame(spark, rows).repartition(3), 5, 9)
    assert got.columns == list(NODE)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == trie(rows)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op11_trie(spark, SMALL).select(*NODE).collect()} == trie(rows)


def test_trie_of_little(spark):
    assert conversation_trie.opening_trie(frame(spark, []), 5, 9).count() == 0
    # 15 keeps none of its own turns and its opening is its own: crc32("15") % 9 turns of one
    assert {tuple(r) for r in conversation_trie.opening_trie(frame(spark, [(15, 0, "user", "a"), (16, 0, "user", "a")]), 5, 9).collect()} == trie([(15, 0, "user", "a"), (16, 0, "user", "a")])


def test_ends_in_many_pieces(spark):
    ids = [i * 3 for i in range(-3000, 9000)]
    rows = [(i, 0, "user", "same") for i in ids if zlib.crc32(str(i).encode()) % 9 == 0]
    got = conversation_trie.opening_trie(frame(spark, rows), 5, 9).where("depth = 1").collect()
    assert {tuple(r) for r in got} == {n for n in trie(rows) if n[1] == 1}


def test_running_sums_by_stretch(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.randint(-3, 3)) for k in (1, 2) for p in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "k bigint, p bigint, v bigint")
    from pyspark.sql import functions as F

    got = {(r["k"], r["p"]): r["s"] for r in running(df, "k", F.floor(F.col("p") / 64), [F.col("p")], F.col("v"), "s").collect()}
    assert got == {(k, p): sum(v for a, b, v in rows if a == k and b <= p) for k, p, _ in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_repair_equals_automaton(spark, seed):
    rows = made(seed, 60)
    df = frame(spark, rows).repartition(3)
    report, turns = conversation_repair.repair(conversation_repair.damaged(df), df)
    found = [tuple(r) for r in report.select(*REPORT).collect()]
    assert len(found) == len(set(found)) and set(found) == repairs(rows)
    by = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r["place"]):
        by[r["conv_id"]].append(r["role"][:1])
    for roles in by.values():
        said = "".join(roles)
        assert said.removeprefix("s") == "ua" * (len(said) // 2)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_repair(spark, SMALL).select(*REPORT).collect()} == repairs(rows)


def test_repair_of_nothing(spark):
    empty = frame(spark, [])
    assert conversation_repair.repair(conversation_repair.damaged(empty), empty)[0].count() == 0


@pytest.mark.parametrize("fold", [3, 256])
def test_chart_equals_automaton(monkeypatch, fold):
    monkeypatch.setattr(conversation_repair, "FOLD", fold)
    rng = random.Random(fold)
    for _ in range(1500):
        rows = [(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randint(0, 25))]
        said = "".join(conversation_repair.letter(*r) for r in rows)
        assert conversation_repair.parse(said) == cheapest([("sua-"[r], s > 1, s == 1) for r, s in rows])


def odd_texts() -> list[str]:
    rng = random.Random(9)
    signs = "aábcßÀÿŁſxyzİΣ中'stld0129 .,!_-<|>\n\t\x1c\x85×÷"
    return ["", " ", "It's we'LL <|endoftext|> a's'", "ΑΣΣΑΣ İi", "é́", "word " * 5000] + ["".join(rng.choice(signs[: rng.choice([8, 40])]) for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_word_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path(queries.WORD_VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = odd_texts() + [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for got, want in zip(packing.tokenizer(path).encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids


def test_every_token_is_made_by_its_merges():
    words = packing.tokenizer(P.path(queries.WORD_VOCABULARY))
    decode = words.merge.__self__.decode_single_token_bytes
    whole = [i for i in range(256 + 255, len(words.ids)) if decode(i).endswith(b" ")]
    text = b"".join(decode(i) for i in whole)
    try:
        said = text.decode()
    except UnicodeDecodeError:
        whole = [i for i in whole if decode(i).isascii()]
        said = b"".join(decode(i) for i in whole).decode()
    assert words.merge(said) == whole


@pytest.mark.parametrize("longest", [1, 64, 2048])
def test_packing(spark, longest):
    path = P.path(queries.WORD_VOCABULARY)
    texts = [*odd_texts()[:60], None, None]
    docs = spark.createDataFrame([(None if i == 5 else i % 50, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, length string")
    rows = packing.packed(docs.repartition(3), path, longest, keep_ids=True).collect()
    words = packing.tokenizer(path)
    want = sorted((-1 if i == 5 else i % 50, *words.encode([t or ""])[0].tolist(), 1) for i, t in enumerate(texts))
    assert sum(r["length"] for r in rows) == sum(len(w) - 1 for w in want)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_number = [r["bucket"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert by_number == sorted(by_number, reverse=True)
    for r in rows:
        assert r["offset"] == 0 and r["length"] == r["bucket"] == len(r["ids"]) <= longest and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    single = {d for d in range(50) if sum(w[0] == d for w in want) == 1}
    for d in single:
        mine = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == d)
        assert [x for _, ids in mine for x in ids] == list(next(w[1:] for w in want if w[0] == d))
        assert [s for s, _ in mine] == np.concatenate([[0], np.cumsum([len(i) for _, i in mine])])[:-1].tolist()


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string"), P.path(queries.WORD_VOCABULARY)).count() == 0
    with pytest.raises(ValueError):
        packing.cut_documents(spark.createDataFrame([], "doc_id bigint, text string"), "x", 100)
