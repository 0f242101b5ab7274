"""Decontamination, packing, secrets, line dedup and near duplicates against brute force on small, awkward tables."""

import array
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import decontaminate, jaccard, lines, packing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, gone string"


def table_of(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, None, "s", None, 1, "x") for k, t in enumerate(texts)], DOCS)


# --- decontamination ---


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    wins = defaultdict(set)
    for key, t in items:
        w = word.findall(low(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[j : j + k])].add("null" if key is None else str(key))
    out = []
    for t in texts:
        w, hit, found = word.findall(low(t)), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if s := wins.get(tuple(w[j : j + k])):
                    found |= s
                    hit |= set(range(j, j + k))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination_is_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "Über", "x1", "é", "and"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice((2, 9, 10, 11, 30)))) for k in range(8)] + [(8, None), (9, "..."), (None, say(12)), (3, say(14))]
    texts = [None, "", "---", say(40), say(500), say(5)] + [say(3) + ", " + (items[k][1] or "") + "! " + say(4) for k in range(8)]
    texts += [texts[-1], (items[5][1] or "").upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(table_of(spark, texts).coalesce(1), bench).collect()
    want = brute_hits(texts, items)
    assert [(g.n_words, g.n_hit, sorted(g.items)) for g in sorted(got, key=lambda g: g.doc_id)] == want
    for g in got:
        assert sum(s.end - s.start for s in g.spans) == g.n_hit
    kept = decontaminate.remove_contaminated(table_of(spark, texts), bench)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(x.doc_id for x in kept.collect()) == [k for k, w in enumerate(want) if not w[1]]


def test_longest_match_and_place():
    block = decontaminate.block_of([("q", b"a b c d e f g h i j k l m n")])
    [r] = decontaminate.scan([b"z z c d e f g h i j k l m y"], block)
    assert r.longest == (("q", 2, 2, 11),)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(9)]
    texts = [items[2][1] + " and " + items[7][1], "nothing", items[0][1]]
    got = decontaminate.contamination(table_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(g.n_words, g.n_hit, sorted(g.items)) for g in sorted(got, key=lambda g: g.doc_id)] == brute_hits(texts, items)


def test_no_benchmark(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.contamination(table_of(spark, ["a b"]), empty).collect()] == [(0, 2, 0)]
    assert decontaminate.remove_contaminated(table_of(spark, ["a b"]), empty).count() == 1


def test_suffix_array():
    r = np.random.default_rng(1)
    for n in (1, 2, 50):
        text = r.integers(1, 4, n).astype(np.int32)
        order = decontaminate.suffix_array(text, n)
        assert [tuple(text[k:]) for k in order] == sorted(tuple(text[k:]) for k in range(n))


# --- packing ---


def check_packed(rows, texts, encode, capacity):
    by, seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
        seq[x.sequence_id].append(x)
    for k, t in enumerate(texts):
        ids, at = array.array("I", [*encode(t or ""), 2]), 0
        for x in sorted(by[k], key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    used = 0
    for own in seq.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
        used += at
    return len(seq), used


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(3)
    texts = [None, "", " ", "It's 3 <|endoftext|> o'clock\tÉTÉ Σσς", *(" ".join(r.choice(("the", "Of,", "étretion", "42", "x-y")) for _ in range(r.choice((1, 30, 200, 900)))) for _ in range(60)), "word " * 5000]
    made = packing.pack(table_of(spark, texts), packing.tokenizer_path()).collect()
    n, used = check_packed(made, texts, lambda t: tk.encode(t, add_special_tokens=False).ids, 4096)
    assert n <= used / 4096 * 1.1 + 1
    small = packing.pack(table_of(spark, texts), packing.tokenizer_path(), capacity=256, unit=8).collect()
    check_packed(small, texts, lambda t: tk.encode(t, add_special_tokens=False).ids, 256)


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    r = random.Random(2)
    texts = ["word " * r.choice((1, 50, 700, 3000, 9000)) + str(k % 40) for k in range(60)]
    df = table_of(spark, texts, [k % 50 for k in range(60)])
    found = [sorted(tuple(x) for x in packing.pack(df.repartition(n), packing.tokenizer_path()).collect()) for n in (3, 211)]
    assert found[0] == found[1] and len({(x[5], x[6]) for x in found[0]}) == len(found[0])


def test_packing_of_an_empty_table(spark):
    assert packing.pack(table_of(spark, []), packing.tokenizer_path()).collect() == []


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    tk, e, r = Tokenizer.from_file(packing.tokenizer_path()), packing.WordEncoder(packing.tokenizer_path()), random.Random(5)
    letters = " \n\t\x0b\x1c\x85\xa0aAbB'sSΣσς́éÉßİ1٣<|startoftext|>endof.,-—😀‍\x00日_"
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(("", "<|endoftext|>x"))
        assert e(t) == array.array("I", tk.encode(t, add_special_tokens=False).ids).tobytes()


def test_column_generation_reaches_the_bound():
    r = np.random.default_rng(2)
    for room in (16, 64):
        demand = np.zeros(room + 1, np.int64)
        demand[1:] = r.integers(0, 400, room)
        used = packing.plan(demand, room)
        held = sum(n * p for p, n in used)
        assert (held >= demand).all() and all((p * np.arange(room + 1)).sum() <= room for p, _ in used)
        rest = demand.copy()
        rest[room] = 0
        relaxed = sum(x for _, x in packing.column_generation(rest, room)) + demand[room]
        assert sum(n for _, n in used) <= relaxed + room
        assert relaxed >= (demand * np.arange(room + 1)).sum() / room - 1e-6


def test_best_pattern_is_brute_force():
    r = np.random.default_rng(7)
    for _ in range(20):
        v = np.concatenate([[0], r.random(7)])
        best, pattern = packing.best_pattern(v, 7)
        plain = [0.0]
        for c in range(1, 8):
            plain.append(max(plain[c - w] + v[w] for w in range(1, c + 1)))
        assert best == pytest.approx(plain[7]) and (pattern * np.arange(8)).sum() <= 7 and pattern @ v == pytest.approx(best)


# --- secrets ---


def brute_spans(t):
    assign = re.compile(secrets.RULES[0].pattern, re.A)
    s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(s)


def test_secrets_are_brute_force(spark):
    r = random.Random(6)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", "api-key", "=", ": ", '"', "'", " ", "AKIA", "AKIAABCDEFGH1234", "abcdefgh12", "short", "0123456789abcdef" * 2, "é", "😀", "\n", "K", "ſecret=abcdefgh9", "ghp_" + "a1" * 18, "İ"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(400)), "token=secret:abcdefgh12", "token=x" * 3000, "f" * 5000]
    texts += texts[5:9]
    got = {x.doc_id: x.spans for x in secrets.scan(table_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert [(s.start, s["rank"], s.span_end, s.kind) for s in got[k] if s.base] == brute_spans(t or ""), t
    assert any(s.kind == "forge" for spans in got.values() for s in spans)


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigram_queries_are_necessary(rule):
    samples = {
        "assign": ["password=abcdefgh", "API_KEY: 'abcdefgh1'", "apikey=abcdefgh", "Passwd = abcdefgh", "SECRET:abcdefgh", "token='abcdefgh"], "access": ["AKIAABCDEFGH1234"], "hex": ["0" * 32],
        "forge": ["gho_" + "a" * 36, "ghu_" + "Z" * 40], "chat": ["xoxb-1234567890", "xoxs-ABCDEFGHIJ"], "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], "jwt": ["eyJabcdefgh.eyJabcdefgh.abcdefgh"],
    }[rule.kind]
    query = secrets.trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    for s in samples:
        assert re.search(rule.pattern, s) and all(any(t in s.lower() for t in c) for c in query)


def test_trigrams_of_small_expressions():
    q = secrets.trigram_query
    assert q("abcd") == [["abc"], ["bcd"]] and q("ab?") == [] and q("(abc|abd)") == [["abc", "abd"]] and q("a.c") == [] and q("x*abc+") == [["abc"]]


# --- lines ---


def brute_lines(rows, min_docs=5, min_chars=40):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda s: low(s.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= min_chars and len(where[key(x)]) >= min_docs and max(where[key(x)]) != d)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_is_brute_force(spark, tmp_path):
    r = random.Random(9)
    pool = [f"{c} a line of text that is longer than forty characters {c}" for c in "abcdefgh"] + ["short", "", " " * 50, "É" * 40]
    rows = [(k, "\n".join(r.choice((" ", "", "\t")) + r.choice((str, str.upper))(r.choice(pool)) for _ in range(r.randint(0, 9)))) for k in range(40)]
    rows += [(40, None), (41, ""), (42, "\n"), rows[3], (43, pool[0] + "\r"), (44, ("x" * 60 + "\n") * 2000)]
    spark.createDataFrame([(a, b, "y") for a, b in rows], "doc_id long, text string, last string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, lines.op7_line_dedup(spark, str(tmp_path)).collect()))
    assert got == brute_lines(rows)


def test_removed_lines_keep_the_columns(spark):
    same = "this line is held by many documents and is long enough"
    df = table_of(spark, [same + f"\nown {k}" for k in range(6)] + [None, ""])
    got = {x.doc_id: x for x in lines.remove_lines(df).collect()}
    assert df.columns == lines.remove_lines(df).columns
    assert got[0].text == "own 0" and got[0].n_chars == 5 and got[5].text.startswith(same) and got[6].text is None
    assert lines.remove_lines(table_of(spark, [])).collect() == []


def test_runs_are_levelled(spark):
    runs = lines.LineRuns(spark, buckets=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, k), (2, k, k), (1, 1, k)], "h1 long, h2 long, doc long"))
    assert [len(x) for x in runs.fresh] == [1, 0, 1] and [len(x) for x in runs.more] == [0, 0, 1]
    once = [(x.h1, x.h2) for level in runs.fresh for name in level for x in spark.table(name).collect()]
    assert len(once) == len(set(once)) == 6  # a key lies in one run
    plan = runs.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {(x.h1, x.h2): (x.n, x["last"]) for x in runs.read().collect()}
    assert got[1, 1] == (5, 4) and got[2, 3] == (1, 3)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ctxspark_run")]


def test_hot_lines_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    r = random.Random(4)
    pool = ["A" * 50] * 30 + [f"{k} a line of text that is longer than forty characters {k}" for k in range(20)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(4))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "some" / "documents.parquet"))
    assert sorted(map(tuple, lines.op7_line_dedup(spark, str(tmp_path / "some")).collect())) == brute_lines(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert lines.op7_line_dedup(spark, str(tmp_path / "none")).collect() == []


# --- near duplicates ---


def brute_components(rows):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True))


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
    return w


@pytest.mark.parametrize("small", [{}, {"LONG": 3, "COMMON_KEPT": 7, "MERGED": 500}])
def test_components_are_brute_force(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    passage = r.sample(words, 60)
    rows = [None, "", "one two", "One  two", "a b c d e", "a b c d E f"]
    for n in (8, 30, 120):
        base = r.sample(words, n)
        rows += [" ".join(edited(r, base, r.choice((0, 1, 1, 2, 4)))) for _ in range(25)]
    rows += [" ".join([*passage, *r.sample(words, r.choice((4, 8, 14, 40)))]) for _ in range(40)]
    chain = r.sample(words, 100)
    for k in range(12):
        rows.append(" ".join(chain))
        chain = edited(r, chain, 1)
    rows += rows[10:14] + ["long " * 30_000]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, component long, k1 string")
    got = sorted(map(tuple, jaccard.components(df.repartition(3)).collect()))
    assert got == brute_components(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted({c for *_, c in got})


def test_ids_missing_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (5, "x"), (5, "y z")], "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles): x.component_id for x in jaccard.components(df).collect()}
    assert got == {(None, 2): None, (3, 2): 2, (2, 2): 2, (5, 1): 5}
    assert jaccard.components(df.where("doc_id = 99")).collect() == []
    assert jaccard.keep_one(df).where(F.col("doc_id").isNull()).count() == 1


def test_sets_are_those_of_plain_words(monkeypatch):
    def plain(raw):
        w = raw.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    r = random.Random(17)
    pool = ["a", "A", "b", "Été", "\x00", "x" * 9, "ab", "ba", "\x1c", "\xa0"]
    texts = [r.choice(["", " ", "\n\t"]).join(["", r.choice([" ", "\x0b\x0c "]).join(r.choice(pool) for _ in range(r.randint(0, 30))), ""]).encode() for _ in range(800)]
    sets = list(jaccard.sets_of(texts))
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
    known = {}
    for t, s in zip(texts, sets, strict=True):
        assert (np.diff(s.astype(float)) >= 0).all() and (jaccard.shingles(t) == s).all()
        assert known.setdefault(frozenset(plain(t)), s.tobytes()) == s.tobytes()
    assert len(set(known.values())) == len(known)
    long = b"w" * 100 + b" a b c d e f " + b"w" * 99 + b" a b"
    whole = jaccard.shingles(long)
    others = list(jaccard.sets_of(texts, 1))
    assert [len(s) for s in others] == [len(s) for s in sets]
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(sets, jaccard.sets_of(texts), strict=True)) and (jaccard.shingles(long) == whole).all()


def thue_morse(n):
    """Two words that differ in every letter and that sums of powers of a number cannot tell apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1, 8, 9, 16, 63, 64, 65, 1024, 2048, 4096, 1 << 20])
def test_words_of_one_sum_are_told_apart(n):
    for seed in (0, 1):
        a, b = (next(jaccard.sets_of([w.encode()], seed)) for w in thue_morse(n))
        assert len(a) == len(b) == 1 and a[0] != b[0]
        c, d = (next(jaccard.sets_of([f"x {w} y".encode()], seed)) for w in thue_morse(n))
        assert c[0] != d[0]


def test_words_are_hashed_apart():
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.choice((1, 3, 7, 8, 9, 15, 16, 17, 40, 64, 65, 70)))) for _ in range(20_000)}
    for seed in (0, 1):
        _, h = jaccard._words_of_any(np.frombuffer(" ".join(words).encode(), np.uint8), seed)
        assert len(set(h.tolist())) == len(words)
        assert 9000 < sum(x & 1 for x in h.tolist()) * 20_000 // len(words) < 11_000


def test_documents_of_such_words_are_not_linked(spark):
    rows = [(2 * n + k, w) for n in (1024, 2048, 4096, 700_000) for k, w in enumerate(thue_morse(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(x.component_id == x.doc_id and x.n_shingles == 1 for x in jaccard.components(df).collect())


def test_short_lists_hold_every_link():
    r = random.Random(13)
    hot = np.array(sorted(r.sample(range(1, 10**6), 50)), np.uint64)
    order = jaccard.Order(hot, np.array([r.randint(24, 90) for _ in hot]))
    for _ in range(400):
        n = r.randint(1, 90)
        a = set(r.sample(hot.tolist(), min(50, n // 2))) | {r.randrange(10**6) for _ in range(n)}
        b = set(r.sample(sorted(a), max(1, round(len(a) * r.uniform(0.8, 1))))) | {r.randrange(10**6) for _ in range(r.randint(0, 8))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        similar = 100 * len(a & b) >= 80 * len(a | b)
        assert jaccard.reaches(x, y) == similar
        if similar:
            shared = np.intersect1d(order.prefix(x)[0], order.prefix(y)[0])
            assert len(shared) >= min(jaccard.least_common(len(x)), jaccard.least_common(len(y)))
