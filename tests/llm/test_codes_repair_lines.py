"""Vector codes, conversation repair and line quality on small tables, against plain versions."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from genostrata.llm import conversation_repair, line_quality, queries, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string"


def plain_codes(rows, parts, entries, rounds):
    """(codes by row, errors, books) of (vec_id, vector) by comparing all points with all entries."""
    width = -(-max((len(v) for _, v in rows), default=0) // parts) * parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(Fraction(c) * 4096) for c in v] + [0] * (width - len(v)) for _, v in rows]
    w = width // parts
    books = [[v[p * w : (p + 1) * w] for v in x[:entries]] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e)) for e in books[p]]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        own = [[nearest(v, p)[0] for v in x] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for v, o in zip(x, own[p]) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[nearest(v, p) for p in range(parts)] for v in x]
    return rows, [[c for c, _ in r] for r in last], [sum(d for _, d in r) for r in last], books


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "grid"])
def test_trees_give_what_all_pairs_give(kind):
    rng = np.random.default_rng(4)
    x = {
        "even": lambda: rng.integers(-900, 900, (1500, 3)),
        "clustered": lambda: rng.integers(-9000, 9000, (12, 8)).repeat(130, 0) + rng.integers(-30, 30, (1560, 8)),
        "copies": lambda: rng.integers(-50, 50, (5, 4)).repeat(300, 0),
        "grid": lambda: rng.integers(0, 4, (1000, 2)),
    }[kind]()
    tree = vector_codes.tree_of(x)
    assert sorted(tree.order) == list(range(len(x)))
    for i in range(len(tree.left)):
        own = x[tree.order[tree.begin[i] : tree.end[i]]]
        assert (tree.total[i] == own.sum(0)).all() and np.sqrt(((own - tree.pivot[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
    for entries in (x[:16], np.concatenate([x[:3], x[:3]]), x[:1]):
        want = vector_codes.distances(x, entries).argmin(1)
        owner, gains = vector_codes.assigned(x, tree, entries)
        assert (owner == want).all()
        for e in range(len(entries)):
            assert sum(n for k, _, n in gains if k == e) == (want == e).sum()
            assert (sum((s for k, s, _ in gains if k == e), np.zeros(x.shape[1], int)) == x[want == e].sum(0)).all()
    wide = vector_codes.assigned(np.random.default_rng(1).integers(-9000, 9000, (12, 8)).repeat(130, 0), vector_codes.tree_of(np.random.default_rng(1).integers(-9000, 9000, (12, 8)).repeat(130, 0)), x[:4] if x.shape[1] == 8 else np.zeros((4, 8), int))
    assert all(n >= 130 for _, _, n in wide[1])  # copies are owned as whole balls


def test_codes_against_plain(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    rng = np.random.default_rng(7)
    vectors = [(i // 2 if i < 40 else i, rng.normal(0, 1, 12).tolist()) for i in range(160)] + [(None, [0.5] * 12), (200, [0.25] * 5), (201, []), (202, [1e300] * 12), (203, [-3e305, 1.0])]
    vectors += [(500 + i, vectors[3][1]) for i in range(60)]
    broken = [(300, None, 1, "x"), (301, [1.0, None], 1, "x"), (302, [float("nan")] * 12, 1, "x"), (303, [float("inf")] * 12, None, "x")]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in vectors] + broken, VECTORS).repartition(5)
    got, books = vector_codes.compress(df, parts=4, entries=6, rounds=3)
    rows, codes, errors, want = plain_codes(vectors, 4, 6, 3)
    assert [[[int(c) for c in e] for e in part] for part in books.entries] == want
    found = sorted(((r["vec_id"], tuple(r["code"]), r["error"]) for r in got.collect()), key=repr)
    assert found == sorted(((i, tuple(c), e if e < 1 << 63 else None) for (i, _), c, e in zip(rows, codes, errors)), key=repr)


def test_codes_of_few_and_no_rows(spark, tmp_path):
    empty, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and books.written() == ""
    rows = [(1, [0.5] * 16, None, "a"), (1, [0.5] * 16, None, "a"), (2, [-0.1] * 16, 3, "a"), (None, None, 3, "b")]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "02" * 8, 0, 0)]
    text = ",".join(",".join(["2048"] * 2 + ["2048"] * 2 + ["-410"] * 2) for _ in range(8))
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


# ---- conversation repair ----

TURNS = "conv_id long, turn long, role string, text string, present boolean, cost string"
LEGAL = re.compile("(s?(ua)+)?")


def plain_repair(turns):
    """(counts, edits, digest) of (turn, role, text) rows by a search over all edits, cheapest and then least first."""
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in turns:
        core = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((r, x))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and LEGAL.fullmatch(roles):
            break
        if (i, roles[-2:]) in done:
            continue
        done.add((i, roles[-2:]))
        moves = []
        if i < len(turns):
            _, r, x = turns[i]
            moves.append((3, "D", 1, None))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                moves.append((cut, "K", 1, (r, x)))
                moves += [(2 + cut, "R", 1, (n, x)) for n in ("user", "assistant")]
        moves += [(2, "I", 0, (n, "")) for n in ("user", "assistant")]
        for c, e, step, line in moves:
            now = roles + (line[0][:1] or "?") if line else roles
            if any(LEGAL.fullmatch(now + end) for end in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, edits + e, i + step, now, (*lines, f"{line[0]}:{line[1]}") if line else lines))
    known = [t for t, _, _ in turns if t is not None]
    n = Counter(faults)
    odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, n["blank"], n["duplicate"], n["truncated"], odd, cost), edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_turns(rng, n):
    return [
        (rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "umbrella", None]), rng.choice(["Yes.", "No!", "And so", "", " \n", "What?\t", "a b.", "Why. not", None, "ü。"]))
        for _ in range(n)
    ]


def test_tables_against_search():
    tables, rng = conversation_repair.Tables(), random.Random(3)
    assert len(tables.vectors) < 30
    for n in list(range(12)) * 12:
        turns = random_turns(rng, n)
        counts, edits, digest = plain_repair(turns)
        kinds = bytes(rng.choice(range(9)) for _ in range(n))
        for block in (1, 3):
            assert conversation_repair.Tables(block).solved(kinds) == tables.solved(kinds) if n == 7 else True
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, full = set(), []
        for t, r, x in rows:
            core = x.strip(" \t\n\x0b\x0c\r")
            full.append((t, r, x, True, 1 if not core else 2 if (r, x) in seen else 3 if core[-1] not in ".!?" else 0))
            seen.add((r, x))
        got = conversation_repair.summary(tables, iter(full), 1 << 20)
        assert (tuple(got[0]), got[1], got[2]) == (counts, edits, digest), turns


def test_long_conversations_cost_what_their_parts_do():
    tables = conversation_repair.Tables()
    pair = bytes([conversation_repair.kind_of("u", 0), conversation_repair.kind_of("a", 0)])
    assert tables.solved(pair * 50_000) == (0, "KK" * 50_000)
    assert tables.solved(pair * 3 + pair[:1] + pair * 3) == (2, "KKKKKKIKKKKKKK"[:6] + "KI" + "KKKKKK")
    assert tables.solved(bytes([0]) * 1001)[0] == 3003


@pytest.mark.parametrize("held", [conversation_repair.HELD, 20])
def test_repair_of_tables(spark, held):
    rng = random.Random(8)
    rows = [(c, t, r, x, True, "c") for c in [*range(30), None] for t, r, x in random_turns(rng, rng.randrange(9))]
    rows += [(50, 1, "user", "gone", False, "c"), (51, None, None, None, True, None), (3, 0, "user", "gone", False, "c")]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    found = conversation_repair.repair(df, present="present", held=held)
    got = {r["conv_id"]: (tuple(r[c] for c in conversation_repair.COUNTS), r["edits"], r["digest"]) for r in found.collect()}
    want = {c: plain_repair([r[1:4] for r in rows if r[0] == c and r[4]]) for c in {r[0] for r in rows}}
    assert got == want and got[50] == ((0,) * 6, "", hashlib.sha256(b"").hexdigest())
    lines: dict = {}
    for r in conversation_repair.rewritten(df, found, present="present").orderBy("conv_id", "place").collect():
        assert r["place"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: x[2] for c, x in got.items() if c in lines}
    assert all(x[1].strip("D") == "" for c, x in got.items() if c not in lines)


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversations(spark, str(tmp_path)).collect() == []


# ---- line quality ----


def some_field(seed):
    rng = np.random.default_rng(seed)
    return line_quality.Field(rng.normal(0, 1, line_quality.WIDTH), rng.normal(0, 1, (2, 2)))


def weight_of(odds, labels, steps):
    return sum(o for o, y in zip(odds, labels) if y) + sum(steps[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_marginals_against_all_labellings(n):
    field = some_field(n)
    odds = np.random.default_rng(n + 50).normal(0, 2, n).tolist()
    w = {y: math.exp(weight_of(odds, y, field.steps)) for y in product((0, 1), repeat=n)}
    want = [sum(v for y, v in w.items() if y[i]) / sum(w.values()) for i in range(n)]
    assert np.allclose(line_quality.marginals(odds, field), want)
    assert line_quality.marginals([1e4, -1e4], field) == pytest.approx([1, 0], abs=1e-9)


def test_likelihood_and_gradient_against_all_labellings():
    rng = np.random.default_rng(2)
    counts, y = np.array([4, 3, 1]), np.array([1, 0, 1])
    x, field = rng.normal(0, 1, (8, line_quality.WIDTH)), some_field(3)
    value, gw, gs = line_quality.likelihood(x, counts, y, field)

    def plain(f):
        at, total = 0, 0.0
        for n, label in zip(counts, y):
            odds = (x[at : at + n] @ f.weights).tolist()
            z = math.log(sum(math.exp(weight_of(odds, l, f.steps)) for l in product((0, 1), repeat=int(n))))
            total, at = total + weight_of(odds, [label] * n, f.steps) - z, at + n
        return total / len(x)

    assert value == pytest.approx(plain(field))
    for i in range(0, line_quality.WIDTH, 7):
        step = np.eye(line_quality.WIDTH)[i] * 1e-5
        assert gw[i] == pytest.approx((plain(line_quality.Field(field.weights + step, field.steps)) - plain(line_quality.Field(field.weights - step, field.steps))) / 2e-5, abs=1e-6)
    for i in range(4):
        step = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert gs.ravel()[i] == pytest.approx((plain(line_quality.Field(field.weights, field.steps + step)) - plain(line_quality.Field(field.weights, field.steps - step))) / 2e-5, abs=1e-6)


def test_measures_and_neighbours():
    texts = ["One two two ok.\n\n##$$ HELLO\nOne two two ok.", None, "", " \t\n", "a" * 5]
    x, size, counts = line_quality.Meter().lines(texts)
    assert counts.tolist() == [3, 1, 1, 1, 1] and size.tolist() == [15, 10, 15, 0, 0, 0, 5]
    at = {n: i for i, n in enumerate(line_quality.MEASURES)}
    assert x[0, at["doubled"]] == pytest.approx(1 / 4) and x[0, at["ends_in_stop"]] == 1 and x[0, at["seen_before"]] == 0 and x[2, at["seen_before"]] == 1
    assert x[1, at["capitals"]] == 1 and x[1, at["symbols"]] == 1 and x[3:6, at["no_letter"]].all()
    n = len(line_quality.MEASURES)
    assert (x[1, n : 2 * n] == x[0, :n]).all() and (x[1, 2 * n : 3 * n] == x[2, :n]).all() and not x[0, n : 2 * n].any() and not x[2, 2 * n : 3 * n].any()
    assert x[:, -3].tolist() == [0, 1, 1, 0, 0, 0, 0] and x[:, -2].tolist() == [1, 1, 0, 0, 0, 0, 0]


def good_and_bad(n):
    rng = random.Random(6)
    words = ["river", "stone", "walks", "over", "the", "a", "green", "hill", "and", "sleeps"]
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))).capitalize() + "." for _ in range(rng.randrange(1, 7))]
        bad = i % 3 == 0
        if bad:
            lines[len(lines) // 2 :] = [rng.choice([x.upper() + "!!", " ".join(w + "$$#" for w in x.split()), " ".join([x.split()[0]] * 12)]) for x in lines[len(lines) // 2 :]]
        yield i, "\n".join(lines), int(not bad)


def test_quality_of_held_out_documents(spark, docs, empty, monkeypatch):
    rows = list(good_and_bad(900))
    table = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string").repartition(6)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (10**6, 0)], "doc_id long, quality int")
    field = line_quality.learned(table, labels)
    got = {r["doc_id"]: r for r in line_quality.judge(table, field, lines="lines").withColumn("out", line_quality.held_out(F.col("doc_id"))).collect()}
    held = [(y, got[i]["score"]) for i, _, y in rows if got[i]["out"]]
    assert len(held) > 150 and np.mean([(s >= 0.7) == y for y, s in held]) > 0.95
    for i, text, _ in rows[:40]:
        size = [len(x) for x in text.split("\n")]
        assert got[i]["score"] == pytest.approx(np.average(got[i]["lines"], weights=size))
    again = line_quality.judge(docs, field)
    assert again.columns == [*docs.columns, "score"] and all(0 <= r["score"] <= 1 for r in again.collect()) and again.count() == docs.count()
    assert line_quality.judge(empty, field).collect() == []
    none = line_quality.learned(empty, labels.limit(0))
    assert {r["score"] for r in line_quality.judge(docs, none).collect()} == {0.5}
    # a third of all rows under one doc_id
    hot = table.limit(300).withColumn("doc_id", F.lit(1)).unionByName(table)
    monkeypatch.setattr(line_quality, "STEPS", 5)
    seen = []
    monkeypatch.setattr(line_quality, "train", lambda sample: seen.append(sample))
    line_quality.learned(hot, labels)
    assert len(seen[0]) <= sum(not r["out"] for r in got.values()) + line_quality.SAMPLE_COPIES
