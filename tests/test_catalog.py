"""Queries of the catalog on small tables."""

import re

import duckdb
import pytest

from palimpsest.plans import catalog

WORD = re.compile(r"\w+")
STOP = re.compile(r"[.!?…;:\n]+")
DOCUMENTS = [
    (1, "So it goes. He said: yes, it IS so; then the old river ran down to the sea again."),
    (2, "Yes\nthe river ran. No, never"),
    (3, None),
    (4, "the old   river, ran down to the sea"),
]
BENCHMARK = [(0, "So it goes! The old river ran down to the sea. It is so"), (1, "yes. The sea again; gone away"), (2, "one two three four five six seven")]
SEARCHES = ["search_full", "search_bidirectional", "search_mixed", "match_regions"]


def sentences(text):
    return [WORD.findall(s.lower()) for s in STOP.split(text or "") if WORD.search(s)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    words = sorted({w for _, text in DOCUMENTS for s in sentences(text) for w in s})
    vectors = [(k, [1.0 if i == k % 8 else 0.1 for i in range(8)]) for k in range(len(words))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(d / "embeddings.parquet"))
    return str(d)


def oracle(tables, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet/*.parquet')")
    return set(connection.execute(catalog.ORACLES[name]).fetchall())


def test_quotes_of_any_length_resolve(spark, tables):
    quotes = {i * 1000 + k: q for i, text in BENCHMARK for k, q in enumerate(sentences(text))}
    held = {(i, k): s for i, text in DOCUMENTS for k, s in enumerate(sentences(text))}
    inside = lambda q, s: any(s[a : a + len(q)] == q for a in range(len(s)))
    want = sorted((n, *at) for n, q in quotes.items() for at, s in held.items() if inside(q, s))
    assert {len(quotes[n]) for n, *_ in want} >= {1, 3, 8}
    assert sorted(map(tuple, catalog.quote_resolver(spark, tables).collect())) == want
    missing = set(quotes) - {n for n, *_ in want}
    assert {len(quotes[n]) for n in missing} == {2, 7}
    assert {r["query_id"] for r in catalog.unresolved_topics(spark, tables).collect()} == missing
    # the counterparts say the same
    assert oracle(tables, "quote_resolver") == set(want)
    assert oracle(tables, "unresolved_topics") == {(n,) for n in missing}


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_take_the_chosen_items(spark, tables, name, monkeypatch):
    """The sentences of items 0 and 100 are searched for, and each finds the sentence that it is."""
    rows = [*BENCHMARK, (100, "nothing. the river ran")]
    monkeypatch.setattr(catalog, "table", lambda s, d, n, own=catalog.table: s.createDataFrame(rows, "item_id long, text string") if n == "benchmark" else own(s, d, n))
    found = catalog.QUERIES[name](spark, tables).collect()
    assert {r["query_id"] for r in found} <= {0, 1, 2, 100_000, 100_001}
    assert {r["query_id"] for r in found} >= {0, 1, 100_001}
    best = {r["query_id"]: (r["doc_id"], r["sentence_id"]) for r in found if r["place"] == 1}
    assert best[0] == (1, 0)
    # without "the", document 4 holds the words of "the river ran" as well, and of equal scores the last stands first
    assert best[100_001] == ((4, 0) if name == "search_mixed" else (2, 1))


def test_the_evaluation_takes_every_topic(spark, tables):
    """Sentences of all items are topics, whether 100 divides their ids or not; the counterpart says the same."""
    found = {tuple(r) for r in catalog.evaluation_grid(spark, tables).collect()}
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet/*.parquet')")
    assert found == set(connection.execute(catalog.ORACLES["evaluation_grid"]).fetchall())
    held = {i * 1000 + k for i, text in BENCHMARK for k, q in enumerate(sentences(text)) if any(len(set(q) & set(s)) >= 4 for _, t in DOCUMENTS for s in sentences(t))}
    assert {query for _, query, *_ in found} == held


def test_topics_of_undivided_items_are_evaluated(spark, tables, monkeypatch):
    rows = [(7, "the old river ran down to the sea"), (8, "then yes, the old river ran")]
    monkeypatch.setattr(catalog, "table", lambda s, d, n, own=catalog.table: s.createDataFrame(rows, "item_id long, text string") if n == "benchmark" else own(s, d, n))
    assert {r["query_id"] for r in catalog.evaluation_grid(spark, tables).collect()} == {7000, 8000}
