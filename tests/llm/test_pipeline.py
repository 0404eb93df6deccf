"""The pipeline against a brute-force version, and the registration of its queries."""

import inspect
import random
import re

import corpus_pipeline
from llm import decontaminate, queries
from tests.llm.test_operators import SCHEMA, VOCABULARY, least_reachable, near_copies, prose, shingle_sets


def write(spark, folder, docs, bench) -> str:
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def expected(docs, bench):
    """Ids that stay, stage by stage, from whole texts."""
    left = [(i, x) for i, x, *_ in docs if x is not None and re.search(r"[^\W\d_]", x)]
    seen, exact = set(), []
    for i, x in left:
        norm = re.sub(r"[\x20\x09-\x0d]+", " ", x)
        if norm not in seen:
            seen.add(norm)
            exact.append((i, x))
    roots = least_reachable(shingle_sets([x for _, x in exact]))
    near = [row for at, row in enumerate(exact) if roots[at] == at]
    runs = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    items = [decontaminate.words(x) for _, x in bench]

    def leaks(text):
        found = runs(decontaminate.words(text))
        for item in items:
            covered = {k + j for k in range(len(item) - 4) if tuple(item[k : k + 5]) in found for j in range(5)}
            if len(item) >= 5 and len(covered) >= 0.5 * len(item):
                return True
        return False

    return [(i, x) for i, x in near if not leaks(x)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rand = random.Random(12)
    bench = [(k, prose(500 + k, 30, 10**6)) for k in range(5)]
    texts = near_copies(21, 70) + [None, "", "12 34 !!", "same  text here", "same text here"]
    texts += [prose(900 + k, 60, 10**6) + " " + bench[k][1] + " " + prose(950 + k, 20, 10**6) for k in range(5)]
    rand.shuffle(texts)
    docs = [(i, x, rand.choice(["en", "de", None]), "s", len(x or "")) for i, x in enumerate(texts)]
    folder = write(spark, tmp_path, docs, bench)
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: library.encode(x, add_special_tokens=False).ids for i, x in expected(docs, bench)}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_pipeline_takes_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_every_operator_is_registered():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = registered()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == set(map(str, range(1, 14)))
    assert names["pipeline"] is corpus_pipeline.run and set(queries.ORACLE_SQL) <= set(oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(near_copies(3, 20))]
    folder = write(spark, tmp_path, docs, [(1, prose(1, 30))])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == list(corpus_pipeline.COLUMNS)
