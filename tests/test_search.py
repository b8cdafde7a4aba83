"""The two plans of a search against each other and against a search in plain Python."""

import itertools
import re

import numpy as np
import pytest

from palimpsest.functions import text as T
from palimpsest.operators import align, corpus
from palimpsest.plans import contextual
from palimpsest.plans import search as S

WORDS = ["the", "a", "red", "blue", "fish", "swims", "far", "away", "12", "zebra", "now"]
STOP, WORD = re.compile(r"[.!?…;:\n]+"), re.compile(r"\w+")


@pytest.mark.parametrize("seed", range(40))
def test_raw_scores_are_those_of_the_alignment(seed):
    rng = np.random.default_rng(seed)
    batch, len_s, len_t = 7, int(rng.integers(1, 9)), int(rng.integers(1, 8))
    scores = np.where(rng.random((batch, len_s, len_t)) < 0.5, 0, np.round(rng.random((batch, len_s, len_t)), 1))
    scores[rng.random(scores.shape) < 0.05] = np.nan
    lengths = rng.integers(1, len_s + 1, batch)
    for b, n in enumerate(lengths):
        scores[b, n:] = 0
    # a document's longest sentence is as long as this one at least
    costs = np.stack([align.gap_costs(max(len_s, len_t) + 1, int(rng.choice([-1, 0, 1, 5, 100])), int(n + rng.integers(0, 3))) for n in lengths])
    assert align.raw_scores(scores, lengths, costs).tolist() == align.align(scores, lengths, costs)[0].tolist()
    flat = np.where(np.isnan(scores), 0, scores)
    both = np.maximum(align.raw_scores(flat, lengths, costs), align.raw_scores(align.turned(flat, lengths), lengths, costs))
    assert both.tolist() == align.align_both_ways(flat, lengths, costs)[0].tolist()


@pytest.mark.parametrize("cutoff", [-1, 0, 1, 5])
def test_raw_scores_of_long_sentences(cutoff):
    """Longer than the gaps whose costs still grow, and of one cutoff, as a search has them."""
    rng = np.random.default_rng(9)
    lengths = np.array([330, 290, 3])
    scores = np.where(rng.random((3, 330, 3)) < 0.97, 0, rng.random((3, 330, 3)) * 3)
    for b, n in enumerate(lengths):
        scores[b, n:] = 0
    costs = np.stack([align.gap_costs(331, cutoff, int(n)) for n in (400, 290, 3)])
    assert align.raw_scores(scores, lengths, costs).tolist() == align.align(scores, lengths, costs)[0].tolist()


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    sentence = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, ". ".join(sentence(int(rng.integers(1, 9))) for _ in range(int(rng.integers(1, 7))))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "red fish. red fish. red fish"), (43, "...")]
    vectors = {w: np.abs(rng.standard_normal(6)) * (rng.random(6) < 0.6) for w in WORDS if w != "zebra"}
    vectors = {w: v / np.linalg.norm(v) for w, v in vectors.items() if np.linalg.norm(v)}
    vocab = [(w, 1.0 + k / 3, v.tolist()) for k, (w, v) in enumerate(vectors.items())]
    queries = [(1, "the red fish swims now"), (2, "zebra"), (3, "12 blue fish, far away zebra"), (4, "a")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(vocab, "token string, idf double, vec array<double>"),
        spark.createDataFrame(queries, "query_id long, query string"),
    )


def pos(word):
    return "DET" if word in T.DETERMINERS else "NUM" if word.isdigit() else "NOUN"


def cell(grid, done, u, v, cost):
    """The recurrence, cell by cell."""
    if (u, v) not in done:
        options = [align.FLOOR, grid[u][v] + (cell(grid, done, u - 1, v - 1, cost) if u and v else 0.0)]
        options += [cell(grid, done, k, v, cost) - cost(u - k) for k in range(u)]
        options += [cell(grid, done, u, k, cost) - cost(v - k) for k in range(v)]
        done[u, v] = max(options)
    return done[u, v]


def plain_search(tables, options):
    """One metric, no submatch weight: (query_id, place, doc_id, sentence_id, score)."""
    docs, vocab, queries = (x.collect() for x in tables)
    vec = {r["token"]: np.array(r["vec"]) for r in vocab}
    out = []
    for query in queries:
        needle = [w for w in WORD.findall(query["query"].lower()) if not (options.ignore_determiners and w in T.DETERMINERS)]
        if not needle:
            continue
        tag = lambda w: {"DET": "DT", "NUM": "CD", "NOUN": "NN"}[pos(w)]
        weights = [options.pos_weights.get(tag(w), 1.0) for w in needle]
        rows = []
        for doc in docs:
            sentences = [WORD.findall(s.lower()) for s in STOP.split(doc["text"] or "") if WORD.search(s)]
            longest = max(map(len, sentences), default=0)
            cost = lambda n: 1e10 if n >= longest else 0.0 if options.cutoff < 0 else 1.0 if options.cutoff == 0 else min(1.0, 1 - 2 ** (-n / options.cutoff))  # noqa: B023, E731
            first = None
            for k, words in enumerate(sentences):
                grid = []
                for w in words:
                    near = [1.0 if w == t else float(vec[w] @ vec[t]) if w in vec and t in vec else 0.0 for t in needle]
                    near = [x**options.similarity_falloff for x in near]
                    near = [x * y * (1 if pos(w) == pos(t) else 1 - options.pos_mismatch_penalty) for x, y, t in zip(near, weights, needle, strict=True)]
                    grid.append([x if x > options.similarity_threshold else 0.0 for x in near])
                grids = [grid, [row[::-1] for row in grid[::-1]]] if options.bidirectional else [grid]
                raw = max(cell(g, done, u, v, cost) for g in grids for done in [{}] for u, v in itertools.product(range(len(words)), range(len(needle))))
                score = raw / sum(weights)
                if score > options.min_score and (first is None or score > first):
                    rows.append((score, doc["doc_id"], k))
                if score > options.min_score and first is None:
                    first = score
        rows.sort(reverse=True)
        out += [(query["query_id"], n, d, k, pytest.approx(s)) for n, (s, d, k) in enumerate(rows[: options.max_matches], 1)]
    return out


PLAIN = [
    S.Options(),
    S.Options(similarity_threshold=0.3, pos_mismatch_penalty=0.5, mismatch_length_penalty="off"),
    S.Options(bidirectional=True, mismatch_length_penalty=0, similarity_falloff=2.0),
    S.Options(ignore_determiners=True, pos_weights={"NN": 0.9, "CD": 0.5}, max_matches=17, min_score=0.4),
]


@pytest.mark.parametrize("options", PLAIN)
def test_search_equals_the_plain_one(tables, options):
    found = S.search_corpus(*tables, options).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["place"], r["doc_id"], r["sentence_id"], r["score"]) for r in found] == plain_search(tables, options)


COLUMNS = ["query_id", "place", "doc_id", "sentence_id", "metric_no", "score", "match", "similarities", "weights", "origins"]


@pytest.mark.parametrize(
    "options",
    [
        *PLAIN,
        S.Options(submatch_weight=2.0, bidirectional=True, similarity_threshold=0.2),
        S.Options(submatch_weight=0.5, floor="none"),
        S.Options(metrics=("cosine", ("cosine", "p-norm", 0.25)), idf_weight=0.5, similarity_falloff=2.0, pos_mismatch_penalty=0.5, max_matches=30),
    ],
)
def test_both_plans_agree(tables, options, monkeypatch):
    docs, vocab, queries = tables
    one = S.search_corpus(docs.repartition(3), vocab, queries, options).select(COLUMNS).orderBy("query_id", "place").collect()
    other = S.search(corpus.sentences(docs), vocab, queries, options).select(COLUMNS).orderBy("query_id", "place").collect()
    assert one
    assert one == other
    monkeypatch.setattr(S, "TABLE_CELLS", 10)
    assert S.search_corpus(docs, vocab, queries, options).select(COLUMNS).orderBy("query_id", "place").collect() == other


def test_no_documents_no_needles(tables):
    docs, vocab, queries = tables
    assert S.search_corpus(docs.limit(0), vocab, queries).count() == 0
    assert S.search_corpus(docs, vocab, queries.limit(0)).count() == 0
    assert S.search_corpus(docs, vocab.limit(0), queries.where("query_id = 3")).count() > 0


@pytest.fixture
def encoder():
    def encode(sentences):
        """Two layers: what a token is, and what stands before it."""
        out = []
        for tokens in sentences:
            own = [[len(t), t.count("e"), 1.0] for t in tokens]
            before = [[0.0, 0.0, 0.0], *own[:-1]]
            out.append(np.array([own, before]))
        return out

    return encode


def test_contextual_search(spark, tables, tmp_path, encoder):
    docs, _, queries = tables
    sentences = corpus.sentences(docs)
    contextual.build(sentences, encoder, str(tmp_path / "store"), variants=2)
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.count() == 2 * sentences.count()
    options = S.Options(min_score=0.3, floor="none", max_matches=10_000)
    found = {(r["query_id"], r["doc_id"], r["sentence_id"]): r for r in contextual.search(store, queries, encoder, options).collect()}
    needles = {r["query_id"]: contextual.layer_mean(encoder([WORD.findall(r["query"].lower())])[0]) for r in queries.collect()}
    want = {}
    for r in sentences.collect():
        own = contextual.layer_mean(encoder([r["tokens"]])[0])
        cost = lambda n: 1e10 if n >= r["max_len_s"] else min(1.0, 1 - 2 ** (-n / 5))  # noqa: B023, E731
        for query, needle in needles.items():
            grid = (own @ needle.T).tolist()
            raw = max(cell(grid, done, u, v, cost) for done in [{}] for u, v in itertools.product(range(len(own)), range(len(needle))))
            if raw / len(needle) > 0.3:
                want[query, r["doc_id"], r["sentence_id"]] = raw / len(needle)
    assert {k: r["score"] for k, r in found.items()} == pytest.approx(want)
    assert {r["variant"] for r in found.values()} == {0}
    with pytest.raises(ValueError, match="too many"):
        contextual.NEEDLE_NUMBERS, kept = 1, contextual.NEEDLE_NUMBERS
        try:
            contextual.search(store, queries, encoder)
        finally:
            contextual.NEEDLE_NUMBERS = kept


@pytest.mark.parametrize("options", [S.Options(), S.Options(max_matches=5, min_score=0.7), S.Options(floor="none", bidirectional=True), S.Options(submatch_weight=2.0, max_matches=20)])
def test_contextual_search_of_documents_is_that_of_a_store(spark, tables, tmp_path, encoder, options, monkeypatch):
    docs, _, queries = tables
    contextual.build(corpus.sentences(docs), encoder, str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    rows = lambda found: {(r["query_id"], r["doc_id"], r["sentence_id"]): r for r in found.collect()}
    want = rows(contextual.search(store, queries, encoder, options))
    monkeypatch.setattr(contextual, "BLOCK", 500)
    found = rows(contextual.search_documents(docs, queries, encoder, options))
    # a store's scores come from products of matrices, which differ in the last digit: of equal ones another may come first
    assert len(want) and sorted(r["score"] for r in found.values()) == pytest.approx(sorted(r["score"] for r in want.values()))
    last = {q: min(r["score"] for r in want.values() if r["query_id"] == q) for q in {k[0] for k in want}}
    for k, r in want.items():
        if r["score"] > last[k[0]] + 1e-9:
            assert found[k]["match"] == r["match"] and found[k]["score"] == pytest.approx(r["score"])


@pytest.mark.parametrize("seed", range(20))
def test_upper_scores_are_none_less(seed):
    rng = np.random.default_rng(seed)
    batch, len_s, len_t = 9, int(rng.integers(1, 40)), int(rng.integers(1, 30))
    cutoff = int(rng.choice([-1, 0, 1, 5, 100]))
    scores = np.where(rng.random((batch, len_s, len_t)) < 0.5, 0, rng.random((batch, len_s, len_t)))
    lengths = rng.integers(1, len_s + 1, batch)
    scores[np.arange(len_s)[None] >= lengths[:, None]] = 0
    costs = np.stack([align.gap_costs(max(len_s, len_t) + 1, cutoff, n) for n in lengths])
    raw = align.raw_scores(scores, lengths, costs)
    upper = align.upper_scores(lambda v: scores[:, :, v].T.astype(np.float32), len_t, cutoff)
    assert (upper >= raw).all()
    assert (upper <= raw + 0.3 * (len_t + len_s)).all()


def test_needles_beyond_the_table_are_scanned_in_parts(tables, monkeypatch):
    """None is joined to the tokens of the corpus unless its table alone is too large, and no table comes to the driver as rows."""
    docs, vocab, queries = tables
    options = S.Options(metrics=("cosine", ("cosine", "p-norm", 0.25)), similarity_threshold=0.2, max_matches=9)
    want = S.search_corpus(docs, vocab, queries, options).select(COLUMNS).orderBy("query_id", "place").collect()
    needle = S.needles(queries, options)
    widest = max(r["count"] for r in needle.groupBy("query_id").count().collect())
    monkeypatch.setattr(S, "TABLE_CELLS", (vocab.count() + needle.select("t_token").distinct().count() + 1) * widest * 2)
    assert len(S.needle_parts(needle, vocab, options)) > 1
    monkeypatch.setattr(S, "search", None)
    assert S.search_corpus(docs, vocab, queries, options).select(COLUMNS).orderBy("query_id", "place").collect() == want


def test_texts_of_all_kinds_are_found(spark, tables):
    _, vocab, _ = tables
    texts = ["red fish\n", "Красная red fish\u2028", "red fish now\u0085", "red fish \u6c34. ΟΔΟΣ", None, "", "été red fish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fish"), (2, "οδος"), (3, "Été")], "query_id long, query string")
    found = [S.search_corpus(docs, vocab, queries, S.Options(similarity_threshold=0.3, min_score=0.9)), S.search(corpus.sentences(docs), vocab, queries, S.Options(similarity_threshold=0.3, min_score=0.9))]
    one, other = (x.select(COLUMNS).orderBy("query_id", "place").collect() for x in found)
    assert one == other
    assert {r["doc_id"] for r in one if r["query_id"] == 1} == {0, 1, 2, 3, 6}
    assert {(r["query_id"], r["doc_id"]) for r in one} >= {(2, 3), (3, 6)}


def test_plain_texts_have_the_same_tokens(spark):
    """Characters that are tokenised in Python are so as in the JVM."""
    safe = re.compile(f"[{S.PLAIN}]")
    chars = [chr(k) for k in range(0x2030) if safe.match(chr(k))]
    texts = ["".join(chars), *(f"A{c}b {c}{c if safe.match(c.upper()) is None else c.upper()} 1{c}_" for c in chars), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    told = rows.select("k", S.F.transform(T.sentence_array(S.F.col("text")), T.token_array).alias("words")).collect()
    assert [r["words"] for r in sorted(told)] == [S.plain_words(t) for t in texts]


def test_a_floor_below_the_last_place_drops_nothing(spark, tables):
    """A document's first sentence is its floor, also where it is known to be below the last place and was not scored."""
    _, vocab, _ = tables
    docs = spark.createDataFrame([(k, "far. red. now. red") for k in range(2000)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red")], "query_id long, query string")
    found = S.search_corpus(docs, vocab, queries, S.Options(similarity_threshold=0.9, max_matches=5)).orderBy("place").collect()
    assert [(r["doc_id"], r["sentence_id"]) for r in found] == [(1999, 3), (1999, 1), (1998, 3), (1998, 1), (1997, 3)]


MADE = [S.Options(similarity_threshold=0.3), S.Options(metrics=("cosine", ("p-norm", "maximum", 0.25)), idf_weight=0.5, similarity_falloff=2.0, pos_mismatch_penalty=0.5, similarity_threshold=0.05)]


@pytest.mark.parametrize("options", MADE)
def test_no_pair_of_words_leaves_the_executors(tables, options, monkeypatch):
    docs, vocab, queries = tables
    needle = S.needles(queries, options)
    old = S.word_table(S.scored_vocabulary(needle, S.similarities(vocab, needle, options), options), needle, options)
    new = S.table_of(S.lexicon(needle, vocab, options, None), tuple(old.needles), options)
    assert (new.names, new.needles) == (old.names, old.needles)
    for word, k in new.words.items():
        own = old.words.get(word, 0)
        assert new.likeness[k] == pytest.approx(old.likeness[own], rel=1e-12)
        assert (new.origins[k] == old.origins[own]).all() and (new.other[k] == old.other[own]).all()
    monkeypatch.setattr(S, "similarities", None)  # would store a row for each pair, 30 bytes or more
    assert S.search_corpus(docs, vocab, queries, options).count() > 0


def test_alignments_up_to_a_place(tables):
    options = S.Options(similarity_threshold=0.3)
    every = S.search_corpus(*tables, options).orderBy("query_id", "place").collect()
    some = S.search_corpus(*tables, options, told=2).orderBy("query_id", "place").collect()
    assert some == [r for r in every if r["place"] <= 2]
    none = S.search_corpus(*tables, options, told=0).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["place"], r["doc_id"], r["sentence_id"], r["score"], r["match"]) for r in none] == [(r["query_id"], r["place"], r["doc_id"], r["sentence_id"], r["score"], None) for r in every]


def test_parts_share_one_scan_of_few_tasks(tables, monkeypatch):
    """What tasks let out for the final cut doesn't grow with parts or with partitions of the documents."""
    docs, vocab, queries = tables
    options = S.Options(similarity_threshold=0.2, max_matches=9)
    told = ["query_id", "place", "doc_id", "sentence_id", "score"]
    want = S.search(corpus.sentences(docs), vocab, queries, options).select(told).orderBy("query_id", "place").collect()
    needle = S.needles(queries, options)
    widest = max(r["count"] for r in needle.groupBy("query_id").count().collect())
    monkeypatch.setattr(S, "TABLE_CELLS", (vocab.count() + needle.select("t_token").distinct().count() + 1) * widest)
    assert len(S.needle_parts(needle, vocab, options)) > 1
    found = S.search_corpus(docs.repartition(50), vocab, queries, options, told=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert "Repartition" in plan.split("MapInPandas")[1].replace("Repartition 50", "", 1)
    monkeypatch.setattr(S, "WAITING", 1000)
    assert want
    assert S.search_corpus(docs.repartition(5), vocab, queries, options, told=0).select(told).orderBy("query_id", "place").collect() == want


def test_bounds_are_none_less_and_the_floor_needs_no_alignment(monkeypatch):
    rng = np.random.default_rng(5)
    likeness = np.where(rng.random((40, 9)) < 0.2, rng.random((40, 9)), 0.0)
    likeness[0] = 0
    table = S.Table({}, likeness, likeness < 0, np.zeros(likeness.shape, np.int8), [None], {1: (0, [1.0] * 2), 2: (2, [1.0] * 7)})
    scan = S.Scan(table, S.Options())
    sizes = [rng.integers(1, 12, 30) for _ in range(5)]
    rows = S.Rows.of(tuple(range(5)), tuple(sizes), rng.integers(0, 40, sum(int(x.sum()) for x in sizes)))
    bounds = scan.bounds(rows)
    for k, (first, weights) in enumerate(scan.needles.values()):
        for i, n in enumerate(rows.length):
            cells = likeness[rows.flat[rows.start[i] : rows.start[i] + n], first : first + len(weights)][None]
            raw = float(align.raw_scores(cells, np.array([n]), align.gap_costs(20, 5, 12)[None])[0])
            assert bounds[k, i] >= raw
            assert (bounds[k, i] == align.FLOOR) == (not cells.any())
    aligned = []
    monkeypatch.setattr(align, "raw_scores", lambda s, n, c, f=align.raw_scores: (aligned.extend(np.abs(s).reshape(len(s), -1).max(axis=1)), f(s, n, c))[1])
    for d, size in enumerate(sizes):
        scan.add(d, size.astype(np.int64), np.concatenate([rows.flat[rows.start[i] : rows.start[i] + rows.length[i]] for i in range(30 * d, 30 * d + 30)]))
    assert len(list(scan.found())) > 50
    assert aligned
    assert min(aligned) > 0


def test_vectors_are_laid_out_without_another_copy_of_all():
    import tracemalloc

    import pyarrow as pa

    chunk = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * 2000 + 1, 16, dtype=np.int32)), pa.array(np.arange(32000.0)))
    column = pa.chunked_array([chunk] * 20)
    tracemalloc.start()
    out, sizes = S._laid_out(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out == np.tile(np.arange(32000.0).reshape(-1, 16), (20, 1))).all()
    assert (sizes == 16).all()
    assert peak < 1.5 * out.nbytes
    rows = pa.chunked_array([pa.array([[1.0, None], None, [], [3.0]], pa.list_(pa.float32())), pa.array([[5.0]], pa.list_(pa.float32()))])
    out, sizes = S._laid_out(rows)
    assert np.array_equal(out, [[1, np.nan], [0, 0], [0, 0], [3, 0], [5, 0]], equal_nan=True)
    assert sizes.tolist() == [2, 0, 0, 1, 1]
