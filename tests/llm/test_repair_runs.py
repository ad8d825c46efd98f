"""Structure repair, decontamination and periodic runs against brute force, on odd, repeated, empty and clashing rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contamination, queries, repair, runs

# ---- 11


def test_matrices_equal_a_search_over_every_short_conversation():
    codes = [i + f for i in "suax" for f in "dtk"]
    for n in (1, 2, 3):
        for row in itertools.product(codes, repeat=n):
            rows = [(c[0], c[1] == "d", c[1] == "t") for c in row]
            assert repair.cheapest(repair.tree([repair._row(c) for c in row])) == plain(rows), row


def plain(rows):
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def closed(best):
        for _ in range(3):
            for (i, r), j in go.items():
                if r != "s" and i in best:
                    best[j] = min(best.get(j, (1 << 60, "")), (best[i][0] + 3, best[i][1] + "I"))
        return best

    best = closed({0: (0, "")})
    for initial, gone, truncated in rows:
        after = {}
        for i, (c, a) in best.items():
            ways = [(i, c + 4, a + "D")]
            if not gone:
                ways += [(go[i, initial], c + 3 * truncated, a + "K")] if (i, initial) in go else []
                ways += [(go[i, r], c + 3 + 3 * truncated, a + "R") for r in "ua" if (i, r) in go]
            for j, *x in ways:
                after[j] = min(after.get(j, (1 << 60, "")), tuple(x))
        best = closed(after)
    return min(best[i] for i in (0, 3) if i in best)


def test_products_are_associative_whatever_the_tree():
    rng = np.random.default_rng(3)
    for _ in range(40):
        codes = [i + f for i, f in zip(rng.choice(list("suax"), 30), rng.choice(list("dtk"), 30), strict=True)]
        ms = [repair._row(c) for c in codes]
        left = ms[0]
        for m in ms[1:]:
            left = repair.product(left, m)
        cut = int(rng.integers(1, 29))
        assert left == repair.tree(ms) == repair.product(repair.tree(ms[:cut]), repair.tree(ms[cut:]))


def by_hand(rows):
    """(turn, role, text) of one conversation, nulls as they come -> the query's columns."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in rows:
        body = x.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = plain([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
    out, state, left = [], 0, iter(rows)
    for e in audit:
        _, r, x = next(left) if e != "I" else (None, None, "")
        if e == "D":
            continue
        r = r if e == "K" else "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[r[0]]
        out.append(f"{r}:{x}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    rng = np.random.default_rng(11)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [(c, int(rng.integers(0, 9)) if c % 7 else None, pick(["user", "assistant", "system", "tool", None, ""]), pick(["Yes.", "no", "", " \n", None, "Yes. ", "Why?"])) for c in range(60) for _ in range(int(rng.integers(1, 9)))]
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (-5, 1, "user", "same."), (-5, 1, "user", "same.")]
    rows += [(1000, t, "user" if t % 3 else "assistant", f"{t % 40}.") for t in range(3000)]  # over many partitions
    rows += [(1001, 7, "assistant", "again.")] * 500
    return rows


def test_audits_and_repaired_rows_equal_a_plain_pass(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("mine")).withColumn("conv", F.lit(1)).repartition(7)
    ordered = repair.ordered(df)
    audits = repair.audit(ordered)
    digests = {r.conv: r.sha256 for r in repair.repaired(ordered, audits, digest=True).collect()}
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv]) for r in audits.collect()}
    want = {c: by_hand([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    lines = {}
    for r in repair.repaired(ordered, audits).orderBy("conv", "position").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())
    assert repair.audit(repair.ordered(df.limit(0))).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(6)] + [(None, None, None, None), (4, None, "user", None)]
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        r, x = ("user" if code == 4 else r), ("" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x)
        want += [(c, t, r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert got == sorted(want, key=str)


# ---- 12


def contaminated_by_hand(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, t in items:
        ws = split(t)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        ws, hit, found = split(t), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if names := windows.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((d, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def benchmark_case():
    rng = np.random.default_rng(5)
    word = lambda n, k=12: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    items = [(i, word(int(rng.integers(1, 40)), 30)) for i in range(40)] + [(100, None), (101, "…"), (102, " .!"), (None, "Once UPON a-time"), (1, "again " + word(15)), (103, word(10)), (104, word(10))]
    items += [(200 + i, "the question is which of these answers holds for " + word(6, 50)) for i in range(30)]  # a template
    items += [(300, items[3][1]), (301, "w1"), (302, "w2 w3"), (303, "É ÉTÉ")]
    docs = [(i, word(int(rng.integers(0, 300)), 14)) for i in range(40)] + [(50, None), (51, ""), (52, "..."), (None, "x"), (53, "é ÉTÉ É été"), (54, "once upon A TIME, once-upon a time")]
    docs += [(60 + i, word(5) + " " + str(items[i][1]) + ", " + word(5)) for i in range(40)] + [(60, "twice"), (60, str(items[0][1]))]
    docs += [(150 + i, f"start{i} " + items[-10][1].upper() + f" end{i}") for i in range(300)]  # a passage of many documents
    docs.append((500, " ".join(str(t) for _, t in items) * 30))
    return docs, items


@pytest.mark.parametrize("width", [10, 3])
def test_contamination_equals_brute_force(spark, width):
    docs, items = benchmark_case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("uid", F.lit("mine")).withColumn("words", F.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("token", F.lit("mine"))
    got = contamination.find_items(d, b, width=width).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == contaminated_by_hand(docs, items, width)
    assert all(r.n_hit == sum(x.end - x.first for x in r.spans) and all(x.end < y.first for x, y in itertools.pairwise(r.spans)) for r in got)


def test_contamination_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b c")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert contamination.find_items(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in contamination.find_items(docs, items.limit(0)).collect()] == [(3, 0, [])]


# ---- 13


def runs_by_hand(w, least=24, exponent=3):
    n, best = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def test_runs_equal_brute_force_on_many_sequences():
    rng = np.random.default_rng(9)
    cases = [[0] * 500, [0] * 23, [0] * 24, [0, 1] * 100 + [2] + [0, 1] * 40, [*range(8)] * 3, [*range(9)] * 3, [*range(9)] * 2 + [*range(8)], []]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    cases.append([ord(c) for c in fib[-1]])
    for _ in range(250):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            piece = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 30))).tolist()
            parts += piece * int(rng.integers(1, 7)) + rng.integers(0, 40, int(rng.integers(0, 20))).tolist()
        cases.append(parts)
    for w in cases:
        for least, exponent in ((24, 3), (8, 2), (10, 4)):
            assert runs.find(w, least, exponent) == runs_by_hand(w, least, exponent), (w, least, exponent)
    assert sum(bool(runs_by_hand(w)) for w in cases) > 100


def test_z_function():
    for s in ([], [1], [1, 1, 1, 1], [1, 2, 1, 2, 1, 3, 1, 2, 1, 2], np.random.default_rng(0).integers(0, 2, 200).tolist()):
        want = [0 if i == 0 else next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s) == want


def test_runs_of_documents(spark):
    long = " ".join(f"u{i}" for i in range(2000)) + " " + " ".join(["x y z"] * 3000) + " end"
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a " * 30), (3, "a " * 30), (None, "é É " * 12), (4, "one two"), (5, long), (6, "a\x1cb " * 24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs_by_hand(w) if len(w) < 2000 else [(2000, 9000, 3)]
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        want.append((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=str)
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(df, exponent=1)


def test_strongest_run_compares_exactly(spark):
    rows = [([(5, 90, 30), (7, 27, 9), (9, 30, 3)],), ([(0, 100, 7), (200, 100, 7)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>")
    assert [r.b and tuple(r.b) for r in df.select(runs.strongest(F.col("runs")).alias("b")).collect()] == [(9, 30, 3), (0, 100, 7), None]


def test_planted_periods(spark):
    rows = [(i, " ".join(f"v{j}" for j in range(i % 90))) for i in range(300)] + [(None, "a b"), (3, None)]
    got = {r.doc_id: r.t for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", runs.plant(F.col("doc_id"), F.col("text"))).filter("text IS NOT NULL").collect()}
    for i, t in rows[:-1]:
        w = t.split()
        if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
        assert got[i].split() == w


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_decontamination", "op13_periodic_runs"])
def test_queries_run_over_their_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    table = "conversations" if name.startswith("op11") else "documents"
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    assert df.count() == (rows.select("conv_id").distinct().count() if table == "conversations" else rows.count())
