"""Every registered query of this package, and the pipeline, once over whole tables."""

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op7_packing", "quality_ablation")])
def test_a_row_for_each_row_of_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    ids = documents(spark).select("doc_id")
    if name == "op1_chat_formatting" or name == "op11_structure_repair":
        ids = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct()
    assert df.count() == ids.count() + (name == "op1_chat_formatting")


def test_packing_covers_every_document(spark):
    rows = queries.op7_packing(spark, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == documents(spark).count() and all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    norm = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)
    own = sorted(tuple(norm(r[k]) for k in names) for r in queries.QUERIES[name](spark, SF).collect())
    assert own == sorted(tuple(map(norm, r)) for r in found.fetchall())


def test_pipeline_from_end_to_end(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in documents(spark).select("doc_id").collect()}
    assert pieces and {p.doc_id for p in pieces} <= docs
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sum(n for _, n in x) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) for x in held.values())


def test_large_groups_in_many_cells_equal_brute_force(spark, monkeypatch):
    import numpy as np

    from tidemark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 20)  # several blocks of open and of closed members
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        keep = np.ones(150, bool)
        for a in rng.integers(0, 135, 3 if i % 3 else 0):
            keep[a : a + 15] = False
        words = [f"w{k}" for k in range(150) if keep[k]]
        words[int(rng.integers(len(words)))] = f"own{i}"
        rows.append((i, " ".join(words)))
    got = {r.id: r.component_id for r in ngram_join.group_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same) and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(rows))} and 10 < len(set(got.values())) < 250


def _batch_of_texts(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def test_a_worker_keeps_the_memo_of_one_operator_alone():
    import numpy as np

    from tidemark.llm import ngram_join, queries, tokens

    none = np.zeros(0, np.uint64)
    e = tokens.encoder(queries.tokenizer_path())
    e.one("x alpha, beta gamma.\ny")
    assert e.memo and e.parts
    list(ngram_join._rows_of(none, none)([_batch_of_texts(["a b c d e f"])]))
    assert ngram_join._WORDS and not e.memo and not e.older and not e.parts
    assert tokens.encoder(queries.tokenizer_path(), 5) is e and e.most == 5 and not ngram_join._WORDS
    assert tokens.encoder(queries.tokenizer_path()).most == tokens.MOST


def test_rows_of_parts_carry_half_a_name_and_pairs_leave_a_batch_once():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import ngram_join

    none, text = np.zeros(0, np.uint64), [f"w{k}" for k in range(400)]
    rows = pa.Table.from_batches(ngram_join._rows_of(none, none)([_batch_of_texts([" ".join(text), " ".join([*text[:-1], "z"])])]))
    parts = rows.filter(rows["key"].is_valid())
    assert parts.num_rows > 100 and parts["y"].null_count == parts.num_rows
    pairs = pa.Table.from_batches(ngram_join._groups(parts.sort_by("key").combine_chunks().to_batches()))
    assert pairs.num_rows <= 2 and {pairs["x"][0].as_py(), pairs["bx"][0].as_py()} == set(parts["x"].to_pylist())
