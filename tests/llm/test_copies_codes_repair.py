"""Exact dedup, vector codes and conversation repair against brute force on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from ctxspark.llm import exact, repair, vectors

# --- exact dedup ---

DOCS = "doc_id long, text string, lang string, n long, p long, id long, full string"
TEXTS = [None, "", " ", "a  b", "a b", "a\tb", "a\n\n b", "a b", "ab", "b a", "x" * 200, "x" * 199 + "y", "x" * 200, "y" * 64 + "1", "y" * 64 + "2", "é" * 70, "é" * 70, "A b", "  ", "\r\n", "long " * 30000]


def brute_groups(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (k, _), t in zip(rows, norm, strict=True):
        ids[t].append(k)
    out = []
    for (k, _), t in zip(rows, norm, strict=True):
        least = min((i for i in ids[t] if i is not None), default=None)
        out.append((k, least, len(ids[t]), k == least, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "l", 1, 2, 3, "f") for k, t in rows], DOCS)


@pytest.mark.parametrize("slots", [(1 << 20, 1 << 25), (1, 1), (7, 32768)])
def test_exact_groups_are_brute_force(spark, slots):
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (None, "only"), (3, "a  b"), (5, "other"), (None, "null twice"), (None, "null twice"), (-4, "long " * 30000)]
    found = exact.exact_groups(docs_of(spark, rows), keep=("lang", "full"), length_slots=slots[0], prefix_slots=slots[1])
    got = [(r.id, r.keep_id, r.group_size, r.kept) for r in found.collect()]
    assert sorted(got, key=repr) == sorted((r[:4] for r in brute_groups(rows)), key=repr)
    assert {(r.k0, r.k1) for r in found.collect()} == {("l", "f")}


def test_whole_texts_are_hashed_for_survivors_only(spark):
    rows = [(1, "abc"), (2, "abd"), (3, "other length"), (4, "x" * 100 + "1"), (5, "x" * 100 + "2"), (6, "abc")]
    full = {r.id: r.full for r in exact.exact_groups(docs_of(spark, rows)).collect()}
    assert {k for k, v in full.items() if v} == {1, 4, 5, 6}  # 2 goes by its prefix, 3 by its length


def test_exact_query_and_removed_copies(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, "a  b"), (0, None)]
    docs_of(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = exact.op12_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)
    docs = docs_of(spark, rows)
    left = exact.remove_copies(docs)
    assert left.columns == docs.columns
    norm = Counter(re.sub(r"[ \t-\r]+", " ", r.text or "") for r in left.collect())
    assert set(norm.values()) == {1} and set(norm) == {re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows}
    assert exact.exact_groups(docs.limit(0)).count() == 0


# --- vector codes ---


def brute_codes(rows, rounds=4):
    """rows: (id, vector, label); the contract word for word, by whole numbers."""
    kept = [(k, [math.floor(1024 * x) for x in v], lab) for k, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept or len(kept[0][1]) % 4:
        return [], ""
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // 4
    parts = [[r[1][p * w : (p + 1) * w] for r in kept] for p in range(4)]
    books = [[x[:] for x in parts[p][:256]] for p in range(4)]

    def assign():
        out = []
        for p in range(4):
            own = []
            for x in parts[p]:
                d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
                own.append((d.index(min(d)), min(d)))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for e in range(len(books[p])):
                mine = [x for x, f in zip(parts[p], found[p], strict=True) if f[0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    out = [(r[0], "".join(f"{found[p][n][0]:02x}" for p in range(4)), sum(found[p][n][1] for p in range(4)), r[2]) for n, r in enumerate(kept)]
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((*r[:3], total[r[3]]) for r in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def vector_rows(n, size=8, spread=0.3, seed=1):
    r = random.Random(seed)
    pick = lambda: round(r.gauss(0, spread), 2)
    return [(k, [float(np.float32(pick())) for _ in range(size)], r.choice([0, 1, None])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 5, 330])
def test_codes_are_brute_force(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(vectors, "CHUNK", 400)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = vector_rows(n) + [(1000, None, 1), (1001, [], 1), (1002, [math.nan] * 8, 1), (1003, [1.0, None] * 4, 1), (1004, [math.inf] + [0.0] * 7, 0), (1005, [0.5] * 4, 1), (None, [0.25] * 8, 1), (0, [0.25] * 8, None)]
    rows += rows[:3]
    spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, v string, c int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.op13_vector_codes(spark, str(tmp_path)).collect()
    want, digest = brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_no_vectors(spark, tmp_path):
    for name, rows in (("none", []), ("odd", [(1, [0.5] * 6, 1)]), ("bad", [(1, None, 1)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert vectors.op13_vector_codes(spark, f"{tmp_path}/{name}").count() == 0


@pytest.mark.parametrize("scale", [5, 1 << 10, 1 << 27])
def test_nearest_entries_are_exact(scale):
    r = np.random.default_rng(3)
    entries, x = r.integers(-scale, scale, (40, 4)), r.integers(-scale, scale, (500, 4))
    entries[7] = entries[3]
    book = vectors.Codebook(entries, scale)
    assert book.kind is (np.int64 if scale == 1 << 27 else np.float64)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(500, np.int64), r.integers(0, 40, 500), d.argmin(1)):
        best, least = book.nearest(x, start)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_the_radius_leaves_entries_out():
    entries = np.arange(0, 25600, 100).reshape(-1, 1)
    book = vectors.Codebook(entries, 25600)
    reach = 4 * 30**2
    assert np.searchsorted(book.apart[100], reach, side="right") == 1
    best, least = book.nearest(np.array([[10030]]), np.array([100]))
    assert best[0] == 100 and least[0] == 900


def test_distances_beyond_63_bits_are_an_error():
    with pytest.raises(OverflowError):
        vectors.exact_type(16, 1 << 31)


# --- conversation repair ---

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_repair(turns):
    """(cost, audit) of (initial, fault) turns, by all edits."""

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(turns) and q in (0, 3) else []
        if inserted < 3:
            for c in "ua":
                if (q, c) in NEXT and (b := best(i, NEXT[q, c], inserted + 1)):
                    found.append((3 + b[0], "I" + b[1]))
        if i < len(turns):
            initial, fault = turns[i]
            if b := best(i + 1, q, 0):
                found.append((4 + b[0], "D" + b[1]))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for cost, edit, c in ((0, "K", initial), (3, "R", "u"), (3, "R", "a")):
                    if (q, c) in NEXT and (b := best(i + 1, NEXT[q, c], 0)):
                        found.append((cost + more + b[0], edit + b[1]))
        return min(found, default=None)

    return best(0, 0, 0)


def coded_turns(turns):
    return bytes(3 * repair.ROLES.get(c, 3) + {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}[f] for c, f in turns)


@pytest.mark.parametrize("steps", [2, 3, 4096])
def test_costs_and_audits_are_brute_force(monkeypatch, steps):
    monkeypatch.setattr(repair, "STEPS", steps)
    r = random.Random(steps)
    for _ in range(1500):
        faults = r.choice([["", "", "blank", "truncated"], [""], ["truncated"], ["blank"]])
        turns = tuple((r.choice("suat"[: r.randint(1, 4)]), r.choice(faults)) for _ in range(r.randint(0, 9)))
        assert repair.repaired(coded_turns(turns)) == brute_repair(turns), turns


def test_states_differ_by_seven_at_most():
    """All words that any conversation can lead to: the layers of a cheapest repair lie far inside a word."""
    seen, todo = set(), [repair._closed(repair.ACCEPTING)]
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        assert max(next(k for k in range(repair.LAYERS) if repair._layer(x, k) >> q & 1) for q in range(4)) <= 7
        todo += [repair.stepped(x, t)[0] for t in range(12)]
    assert len(seen) < 5000


def test_a_long_conversation():
    turns = coded_turns([("u", ""), ("a", "")] * 150_000 + [("u", "truncated")])
    assert repair.repaired(turns) == (4, "K" * 300_000 + "D")


def brute_report(rows):
    """The contract for (conv, turn, role, text) rows, word for word."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, count = set(), [], Counter()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            turns.append((role[:1], fault))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = brute_repair(tuple(turns))
        lines, at, length = [], 0, len(audit) - audit.count("D")
        for edit in audit:
            name = ("user", "assistant")[(len(lines) + length % 2) % 2]
            if edit == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = own[at]
            at += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else name}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_reports_are_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.choice([0, 1, 3, 9])):
            role = r.choice(["user", "assistant", "system", "tool", "", None, "umpire"]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 2]), role, r.choice([None, "", " \n", "Yes.", "no", "no", "Why? \t", f"t{turn}.", "é…", "long. " * 9000])))
    rows += rows[:9] + rows[:2]
    spark.createDataFrame([(*x, 5, "y") for x in rows], "conv_id long, turn long, role string, text string, copies int, head string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path)).select("conv_id", *repair._REPORT, "audit", "repaired_sha256").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_report(rows)


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op11_conversation_repair(spark, folder).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_report(rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "Ho."), (2, 0, "assistant", "Well."), (3, 0, "system", " ")], "conv_id long, turn long, role string, text string")
    got = repair.repaired_turns(repair.counted(rows)).orderBy("conv", "place").collect()
    assert [tuple(x) for x in got] == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Ho."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Well.")]
    empty = repair.counted(rows.limit(0))
    assert repair.reports(empty).count() == 0 and repair.repaired_turns(empty).count() == 0
