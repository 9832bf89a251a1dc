"""The corpus operators on Spark, with odd rows, against plain versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, jaccard_join, langid, line_rules, maxent_lm, pii, quality, queries, secret_scan, substring_dedup
from tideline.llm.common import in_fold
from tideline.llm.graph import components
from tideline.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, label_id string, packed string, node string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, repeated and very long rows, and columns whose names clash."""
    long = "word " * 30_000
    rows = [(1, "a b c d", "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "fr", None, 4), (None, "lost id text here", "en", "s", 9), (5, long, "en", "s", 150_000),
            (6, "a b c d", "en", "s", 7), (6, "a b c d", "en", "s", 7), (7, "é" * 40_000, "fr", "t", 40_000), (8, "x", "en", "t", 1)]
    return spark.createDataFrame([(*r, "q", "q", "q", "q") for r in rows], ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


def rng_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def brute_components(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("boundary", [0, 15, 24])
def test_jaccard_join_at_any_boundary(spark, boundary):
    """Short sets on both sides of the boundary and across it, and texts of over 2,000 words."""
    rng = random.Random(boundary)
    words = ["w%d" % i for i in range(4000)]
    texts = {}
    for k, n in enumerate([9, 11, 12, 15, 17, 20, 21, 22, 24, 26, 30, 40, 2300] * 4):
        base = [rng.choice(words) for _ in range(n)]
        for i in range(4):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, n // 30])):
                at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
                w[at : at + rng.choice([0, 1])] = [] if rng.random() < 0.4 else [rng.choice(words)]
            texts[10 * k + i] = " ".join(w)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(df, boundary=boundary).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_equals_brute_force(spark):
    texts = dict(enumerate(rng_texts(400, 1)))
    texts |= {1000 + i: t for i, t in enumerate(rng_texts(60, 2)[:20] * 3)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_of_near_copies_around_a_base(spark):
    rng = random.Random(3)
    base = ["b%d" % i for i in range(150)]
    texts = {}
    for i in range(250):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(10_000)
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_links_large_sets_without_an_id(spark):
    """Near copies that only the rows without an id connect: one star of copies, one group around a pivot."""
    base, other = ["b%d" % i for i in range(150)], ["c%d" % i for i in range(130)]
    edit = lambda words, *at: " ".join("e%d" % i if i in at else w for i, w in enumerate(words))
    rows = [(None, " ".join(base)), (None, " ".join(base))] + [(10 + i, edit(base, 10 + 9 * i, 75 + 9 * i)) for i in range(7)]
    rows += [(None, edit(other, 5)), (None, edit(other, 60))] + [(50 + i, edit(other, 20 + 9 * i)) for i in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    got = jaccard_join.similarity_classes(df).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["n_shingles"] == 148} == {10}
    assert {r["component_id"] for r in got if r["n_shingles"] == 128} == {50}


def test_jaccard_join_odd_rows(odd, nothing):
    rows = jaccard_join.similarity_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[6]["component_id"] == 1 and by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
    assert by[2]["component_id"] == 2 and by[5]["n_shingles"] == 1 and by[8]["n_shingles"] == 1
    assert jaccard_join.similarity_classes(nothing).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 5), (7, 8), (8, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(61)}


def test_simple_scans_odd_rows(odd, nothing):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    for run in (
        lambda d: bpe.encode_documents(d, path, P.PATTERN), secret_scan.scan_documents, pii.scan_documents, line_rules.quality_rules,
        lambda d: decontaminate.contamination(d, odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1 or doc_id is null")),
    ):
        assert run(odd).count() == odd.count()
        assert run(nothing).count() == 0
    enc = {r["doc_id"]: r for r in bpe.encode_documents(odd, path, P.PATTERN).collect()}
    assert enc[2]["n_tokens"] == enc[3]["n_tokens"] == 0 and all(r["round_trip"] for r in enc.values())
    ids = bpe.encode_documents(odd, path, P.PATTERN).select("doc_id", bpe.decode_ids(F.col("ids"), path, P.PATTERN).cast("string").alias("t"))
    assert {r["doc_id"]: r["t"] for r in ids.collect()}[7] == "é" * 40_000
    rules = {r["doc_id"]: r for r in line_rules.quality_rules(odd).collect()}
    assert rules[2]["base_failed"] and rules[5]["base_failed"] and not rules[5]["kept"]
    con = {r["doc_id"]: r for r in decontaminate.contamination(odd, odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")).collect()}
    assert con[6]["contaminated"] and con[1]["n_hit"] == 4 and con[2]["n_words"] == 0 and not con[5]["contaminated"]


def test_decontamination_in_blocks_is_the_same(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = decontaminate.contamination(docs, items)
    many = decontaminate.contamination(docs, items, block_words=300, keep_text=True, source=F.col("source")).drop("text", "source")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_lines_over_the_limit_are_removed(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"cookie notice number {i % 10}\n{body(i)}", "h") for i in range(40)] + [(100 + i, "cookie notice number 1\n" * 30 + "end", "h") for i in range(3)]
    rows += [(200 + i, body(500), "h") for i in range(30)]
    out = {r["doc_id"]: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[0]["n_removed"] == 4 and out[0]["kept"]
    assert out[200]["n_removed"] == 0 and out[200]["kept"], "copies of one page are one document"
    assert not out[100]["kept"]


def test_common_lines_of_a_large_host_are_removed(spark):
    """A line in 15 of a host's 400 documents is over the limit, one in 10 of them is not."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    body = lambda i, n: " ".join(f"{name(i)}x{name(k)}" for k in range(n))
    rows = [(i, body(i, 60), "h") for i in range(370)] + [(1000 + i, " ".join("notice%s" % chr(97 + k // 8) * (1 + k % 8) for k in range(60)) + "\n" + body(i, 52), "h") for i in range(15)]
    rows += [(2000 + i, "rare line\n" + body(1000 + i, 60), "h") for i in range(10)] + [(3000 + i, "rare line\n" + body(1000, 60), "h") for i in range(5)]
    out = {r["doc_id"]: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert len(out) == len(rows)
    assert all(out[1000 + i]["n_removed"] == 60 and not out[1000 + i]["kept"] and not out[1000 + i]["base_failed"] for i in range(15))
    assert all(r["n_removed"] == 0 and r["kept"] for i, r in out.items() if i < 370 or i >= 2000)


def test_quality_classifier(spark, odd, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, ~in_fold(F.col("label_id"), 3, 1))
    out = quality.score(docs, model, held_out=in_fold(F.col("doc_id"), 3, 1)).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9
    assert out.score.between(0, 1).all()
    assert quality.score(odd, model).count() == odd.count() and quality.score(nothing, model).count() == 0
    empty = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.score(odd, empty).count() == odd.count()


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    out = langid.predict(docs, net, held_out=in_fold(F.col("doc_id"), 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.9
    got = {r["doc_id"]: r for r in langid.predict(odd, net).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert langid.predict(nothing, langid.fit(nothing, F.lit(True))).count() == 0
    assert langid.predict(odd, langid.fit(nothing, F.lit(True))).count() == odd.count()


def test_language_model(spark, odd, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = queries.op4_maxent(spark, SMALL).toPandas().set_index("doc_id")
    count: Counter = Counter()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, w in texts.items():
        r = out.loc[i]
        assert r.n_tokens == len(w) and r.n_known == sum(x in count for x in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()
    model = maxent_lm.fit(odd)
    assert maxent_lm.score(odd, model).count() == odd.count() and maxent_lm.score(nothing, model).count() == 0
    none = maxent_lm.fit(nothing)
    rows = maxent_lm.score(odd, none).collect()
    assert len(rows) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    seen = []
    for n in (1, 8, 32):
        dealt = docs.repartition(n)
        out = maxent_lm.score(dealt, maxent_lm.fit(dealt)).toPandas().sort_values("doc_id")
        seen.append(out.score.to_numpy())
        assert (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum() > 0.36
    assert max(abs(seen[0] - seen[1]).max(), abs(seen[0] - seen[2]).max()) < 1e-4 and (abs(seen[0] - seen[2]) / -seen[0]).max() < 1e-6


def test_repeated_passages(spark, odd, nothing):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(50)]
    rows += [(100 + i, f"{' '.join(word() for _ in range(rng.randint(1, 40)))} {passage} {' '.join(word() for _ in range(30))}") for i in range(5)]
    out = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(out) == {100, 101, 102, 103, 104}
    assert out[100]["spare_bytes"] == 0 and out[101]["spare_bytes"] > 200 and all(r["first_doc"] == 100 for r in out.values())
    assert substring_dedup.repeated_passages(odd).count() == 0 and substring_dedup.repeated_passages(nothing).count() == 0


def test_repeated_passages_equal_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs += [(docs[0][0], "same id, " + docs[1][1]), (None, docs[2][1]), (9_999_999, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    # the row without an id comes after all others
    chunks = [(math.inf if i is None else i, t, *substring_dedup.chunks_of(t)) for i, t in docs]
    holders: dict = {}
    for i, _, digests, _, _ in chunks:
        for d in digests:
            holders.setdefault(d, set()).add(i)
    want, texts = [], []
    for i, t, digests, ends, words in chunks:
        ends, starts, cut = [int(e) for e in ends], [0, *map(int, ends[:-1])], bytearray((t or "").encode())
        run, runs = [], []
        for k in range(len(digests) + 1):
            if k < len(digests) and len(holders[digests[k]]) > 1:
                run.append(k)
            else:
                if sum(words[x] for x in run) >= substring_dedup.MIN_WORDS:
                    runs.append(run)
                run = []
        inside = [k for r in runs for k in r]
        spare = [k for k in inside if min(holders[digests[k]]) != i]
        for k in reversed(spare):
            del cut[starts[k] : ends[k]]
        texts.append((i, t if t is None else cut.decode()))
        if inside:
            want.append((i, len(digests), sum(len(holders[d]) > 1 for d in digests), ",".join(f"{starts[r[0]]}:{ends[r[-1]]}" for r in runs), sum(ends[k] - starts[k] for k in inside), sum(ends[k] - starts[k] for k in spare), min(min(holders[digests[k]]) for k in inside)))
    got = [tuple(r)[:7] for r in substring_dedup.repeated_passages(df).collect()]
    got = [(math.inf if r[0] is None else r[0], *r[1:]) for r in got]
    assert sorted(got) == sorted(want) and len(want) > 20 and want[-1][0] == math.inf
    out = substring_dedup.deduplicated(df, lang=F.lit("x"))
    assert out.columns == ["doc_id", "lang", "text", "spare_bytes"]
    assert sorted(map(str, ((math.inf if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, texts))


def test_passages_of_rows_without_an_id(spark):
    rng = random.Random(6)
    said = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    one, two = said(70), said(70)
    texts = [f"{said(20)} {one} {said(20)}" for _ in range(3)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, f"{said(9)} {two} {said(9)}"), (None, f"{said(9)} {two}"), (None, said(80)), (8, said(80))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = substring_dedup.repeated_passages(df).collect()
    named = [r for r in out if r["first_doc"] == 7]
    assert sorted((r["doc_id"] or 0, r["spare_bytes"] > 0) for r in named) == [(0, True), (7, False)]
    # equal rows are one document; one of the three distinct ones keeps the passage
    alone = [r for r in out if r["first_doc"] is None]
    assert len(alone) == 4 and len({r["row"] for r in alone}) == 3 and len({r["row"] for r in alone if r["spare_bytes"] == 0}) == 1
    left = [r["text"] for r in substring_dedup.deduplicated(df).collect()]
    assert len(left) == len(rows) and sum(two[60:-60] in t for t in left) == 1 and len({t for t in left if one[60:-60] in t}) == 1


def plain_quality(text, vectors):
    """The features of a text, word by word."""
    words = (text or "").split()
    rows = [vectors.rows(w) for w in words]
    means = [sum(vectors.table[r[k]].astype(float) for r in rows) / len(rows) if rows else [0.0] * quality.DIM for k in (0, 1)]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    n = len(words)
    return [*means[0], *means[1], math.log1p(n) / 8, len({*words}) / n if n else 0, 1 - len({*lines}) / len(lines) if lines else 0, sum(a == b for a, b in zip(words, words[1:])) / n if n else 0, min(len(text or "") / n, 40) / 10 if n else 0]


def test_quality_scores_equal_a_plain_network(spark, odd):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels, ~in_fold(F.col("label_id"), 3, 1))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = {(r["doc_id"], r["text"]): r for r in quality.score(both, model, keep_text=True).collect()}
    a, b, c, d = (p.astype(float) for p in model.layers)
    for r in both.collect():
        x = [(v - m) / s for v, m, s in zip(plain_quality(r["text"], model.vectors), model.mean.tolist(), model.scale.tolist())]
        hidden = [max(0.0, sum(v * w for v, w in zip(x, a[:, j])) + b[j]) for j in range(len(b))]
        z = (sum(h * w for h, w in zip(hidden, c[:, 0])) + d[0]) / model.temperature
        row = got[r["doc_id"], r["text"]]
        assert abs(row["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-3 and row["predicted"] == (row["score"] >= 0.5)


def test_language_scores_equal_a_plain_network(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    some = docs.orderBy(F.length("text"), "doc_id").limit(25)
    got = {r["doc_id"]: r for r in langid.predict(some, net).collect()}
    for r in some.collect():
        raw = r["text"].encode()
        if not any(map(str.isalpha, r["text"])):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        total = [0.0] * len(net.languages)
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            window = part.ljust(langid.WINDOW)
            hidden = []
            for w in langid.WIDTHS:
                for f in range(langid.FILTERS):
                    top = max(sum(float(net.filters[w][k, window[i + k], f]) for k in range(w)) for i in range(langid.WINDOW - w + 1))
                    hidden.append(max(0.0, top + float(net.bias[w][f])))
            z = [sum(h * float(net.out[j, k]) for j, h in enumerate(hidden)) + float(net.out_bias[k]) for k in range(len(net.languages))]
            top = max(z)
            norm = top + math.log(sum(math.exp(v - top) for v in z))
            total = [t + (v - norm) * len(part) / len(raw) for t, v in zip(total, z)]
        best = max(range(len(total)), key=total.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == net.languages[best]
        assert abs(got[r["doc_id"]]["score"] - math.exp(total[best]) / sum(map(math.exp, total))) < 1e-3


def test_near_duplicate_stage_removes_rows_not_ids(spark, nothing):
    import corpus_pipeline as cp

    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (3, text("c")), (3, text("c")), (None, text("d")), (None, text("d")), (None, text("b") + " more"), (5, None), (5, None), (6, ""), (7, " \n"), (8, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = [(r["doc_id"], r["text"]) for r in cp.near_duplicate_stage(spark, docs, SMALL).collect()]
    want = [(1, text("a")), (1, text("b")), (3, text("c")), (None, text("d")), (5, None), (5, None), (6, ""), (7, " \n"), (8, text("e"))]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert cp.near_duplicate_stage(spark, nothing, SMALL).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    """Nulls, empty and very long texts, repeated rows, shared ids and extra columns; and empty tables."""
    import corpus_pipeline as cp

    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    leaks = spark.createDataFrame([(20, f"before {item} after", "en", "s", 1), (20, f"before {item} after", "en", "s", 1), (20, "clean text under the same id", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = odd.select(*cp.COLUMNS).unionByName(leaks)
    rows = lambda df: sorted(map(str, df.select("doc_id", F.md5("text").alias("m"), "lang", "source", "n_chars").collect()))
    # without a labelled document the classifier rejects none
    assert rows(cp.quality_stage(spark, docs.withColumn("predicted", F.lit("x")).withColumn("score", F.lit("y")), SMALL)) == rows(docs)
    kept = cp.decontamination_stage(spark, docs.withColumn("contaminated", F.lit("x")), SMALL)
    assert rows(kept) == rows(docs.where("text is null or not (doc_id = 20 and text like 'before%')"))
    one = cp.near_duplicate_stage(spark, docs.withColumn("component", F.lit("x")).withColumn("row", F.lit(1)), SMALL)
    texts = sorted(map(str, ((r["doc_id"], len(r["text"] or "")) for r in one.collect())))
    assert texts == sorted(map(str, [(1, 7), (2, 0), (3, 0), (4, 4), (None, 17), (5, 150_000), (7, 40_000), (8, 1), (20, len(item) + 13), (20, 28)]))
    assert rows(cp.secret_stage(spark, docs.withColumn("redacted", F.lit("x")), SMALL)) == rows(docs)
    coded = cp.encode_stage(spark, docs.withColumn("ids", F.lit("x")), SMALL).collect()
    assert len(coded) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in coded) and {r["n_tokens"] for r in coded if r["doc_id"] in (2, 3)} == {0}
    for name, stage in cp.STAGES:
        assert stage(spark, nothing.select(*cp.COLUMNS), SMALL).count() == 0, name


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "encode"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(1, "token = abcdefgh12345 rest", "en", "s", 26), (2, None, None, None, None)]
    secret = cp.secret_stage(spark, spark.createDataFrame(rows, docs.schema), SMALL).collect()
    assert [(r["text"], r["n_chars"]) for r in secret] == [("[assign] rest", 13), (None, None)]
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
    dup = cp.near_duplicate_stage(spark, docs, SMALL)
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in dup.select("doc_id").collect()} == {i for i, c in want.items() if i == c}
    out = cp.run(spark, SMALL)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} and 0 < out.count() < docs.count()


def test_samples_cut_rows_whatever_the_ids(spark):
    """Null ids, one id on many rows, equal rows, a rare language: the bounds hold, and each language is learned."""
    words = {"aa": "ba lo mi ne tu", "bb": "xq wz kj vh pf", "cc": "1 été çà où"}
    rows = [(None, f"{words['aa']} {i}", "aa") for i in range(3000)] + [(7, f"{words['bb']} {i}", "bb") for i in range(3000)] + [(8, f"{words['aa']} . {i // 2}", "aa") for i in range(3000)] + [(None, words["aa"], "aa")] * 3000 + [(9, words["cc"] + " " * i, "cc") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    known = docs.select(F.col("doc_id").alias("id"), "lang", "text")
    taken = {r["lang"]: r["count"] for r in langid.sample_of(known, 90).groupBy("lang").count().collect()}
    assert taken == {"aa": 30, "bb": 30, "cc": 3}
    assert langid.sample_of(known, 2).count() == 2
    net = langid.fit(docs, F.lit(True), sample=120)
    out = langid.predict(docs, net, lang=F.col("lang"))
    assert out.where("lang_pred <> lang").count() < 0.02 * len(rows)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    marked = labels.where("doc_id is not null").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    texts = docs.select(F.col("doc_id").alias("label_id"), "text")
    assert quality.sample_of(texts, marked, 50).count() == 50
    assert quality.sample_of(texts, marked, 50_000).count() == 6003
    assert quality.sample_of(texts.limit(0), marked, 50).count() == 0
    scored = quality.score(docs, quality.fit(docs, labels, F.lit(True), sample=400), lang=F.col("lang")).where("doc_id is not null").groupBy("lang").agg(F.avg("score").alias("s")).collect()
    means = {r["lang"]: r["s"] for r in scored}
    assert means["bb"] > 0.9 and means["aa"] < 0.1


def test_long_shapes_tell_all_their_signs():
    long = "".join(chr(33 + i) for i in range(15))
    assert quality.shape_of(long + "\u00a7" * 2) != quality.shape_of(long + "\u00b6" * 2)
