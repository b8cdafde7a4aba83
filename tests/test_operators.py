import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators import corpus, embeddings, evaluate, regions, similarity
from palimpsest.plans import search as S
from palimpsest.sources import readers, writers
from palimpsest.streaming import incremental


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def plain_acronym(title, length, ignored):
    parts = [p for p in title.upper().split(" ") if p not in ignored and p[:1].isalpha()]
    letters = [1] * len(parts)
    order = [(k, i) for k in range(2, length + 1) for i in range(len(parts))]
    while order and sum(min(len(p), n) for p, n in zip(parts, letters, strict=True)) < length:
        k, i = order.pop(0)
        letters[i] = k
    return "".join(p[:n] for p, n in zip(parts, letters, strict=True))[:length].ljust(length, "X")


@pytest.mark.parametrize("title", ["", "The Tempest", "A Midsummer Night's Dream", "of and", "x", "King Henry the Fourth part one two", "12 monkeys", "Ab C Defgh"])
@pytest.mark.parametrize("length", [4, 6])
def test_acronym(spark, title, length):
    assert column(spark, T.acronym(F.lit(title), length)) == plain_acronym(title, length, T.IGNORED_IN_TITLES)


def test_signatures(spark):
    digest = hashlib.sha1(b"An Author:The Title:text").hexdigest()
    got = column(spark, T.document_signature(F.lit("An Author"), F.lit("The Title"), F.lit("text")))
    assert got == f"AUTH-TITL-{digest[::4].upper()}"


def test_location(spark):
    at = lambda *x, **k: column(spark, T.location(*[F.lit(v) for v in x], **k))
    assert at(1, 2, 3, 4) == "II.2, line 4"
    assert at(1, 2, 3, 4, compat=False) == "I.2, line 4"
    assert at(-1, 2, 3, 4) == "line 4"
    assert at(-1, 2, -1, 4) == "Chapter 2, par. 4"
    assert at(1, 2, -1, 4) == "Book 1, Chapter 2, par. 4"
    assert at(-1, -1, -1, 4) == "par. 4"


def test_byte_offsets(spark):
    docs = spark.createDataFrame([(1, "Été, là. Und… so"), (2, None), (3, "")], "doc_id long, text string")
    rows = corpus.tokens(docs).orderBy("idx").collect()
    raw = "Été, là. Und… so".encode()
    assert [raw[r["idx"] : r["idx"] + r["len"]].decode().lower() for r in rows] == [r["token"] for r in rows] == ["été", "là", "und", "so"]
    assert corpus.sentences(docs).count() == 3


def test_measures(spark):
    a, b = F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.0))
    assert column(spark, V.cosine(a, b)) == pytest.approx(0.6)
    assert column(spark, V.sqrt_cosine(a, b)) == pytest.approx(0.6**0.5 / 1.4)
    assert column(spark, V.scaled(F.array(F.lit(0.0)), F.lit(0.0))) is None
    steps = F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))
    assert [column(spark, V.ranked(F.lit(x), steps)) for x in (-1.0, 0.25, 0.5, 2.0)] == pytest.approx([0, 0.25, 0.5, 1])
    with pytest.raises(ValueError, match="unknown"):
        V.measure("none")


def test_ranks_prefer_later_ties(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],)], "embedding array<double>")
    assert embeddings.component_ranks(rows).first()["ranks"] == [3, 2, 1]


def test_neighbour_means_keep_the_divisor(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], "vec_id long, vec array<double>")
    got = {r["j"]: r["mean"] for r in embeddings.neighbour_means(rows).where("vec_id = 1").collect()}
    assert got == {0: 1.0, 1: 4.0}


def test_composite_ends(spark):
    kind = "token string, t_token string, similarity double"
    a, b = spark.createDataFrame([("x", "t", 0.5)], kind), spark.createDataFrame([("x", "t", 0.9), ("y", "t", 0.1)], kind)
    ends = [{r["token"]: (r["similarity"], r["origin"]) for r in similarity.composite(a, b, t).collect()} for t in (0.0, 1.0)]
    assert ends[0]["x"] == (0.5, "a")
    assert ends[1] == {"x": (0.9, "b"), "y": (0.1, "b")}
    assert similarity.metric_name("a", "b", 0.2) == "a + b @0.20"


@pytest.fixture
def small(spark):
    docs = spark.createDataFrame([(1, "red fish swim. blue fish swim far away. nothing here at all"), (2, "red birds fly"), (3, None)], "doc_id long, text string")
    vocab = spark.createDataFrame([("red", 1.0, [1.0, 0.0]), ("blue", 2.0, [0.8, 0.6]), ("fish", 1.0, [0.0, 1.0])], "token string, idf double, vec array<double>")
    return corpus.sentences(docs), vocab


def found(spark, small, text, **options):
    queries = spark.createDataFrame([(1, text)], "query_id long, query string")
    return S.search(*small, queries, S.Options(**options)).orderBy("place").collect()


def test_search_ranks_the_nearest_first(spark, small):
    rows = found(spark, small, "red fish swim now")
    assert (rows[0]["doc_id"], rows[0]["sentence_id"], rows[0]["match"]) == (1, 0, [0, 1, 2, -1])
    assert rows[0]["score"] == pytest.approx(3 / 4)
    assert rows[1]["doc_id"] == 2


def test_later_sentences_must_beat_the_first(spark, small):
    none = found(spark, small, "swim fish far away", floor="none")
    order = found(spark, small, "swim fish far away")
    assert {(r["doc_id"], r["sentence_id"]) for r in order} <= {(r["doc_id"], r["sentence_id"]) for r in none}
    first = min((r for r in none if r["doc_id"] == 1), key=lambda r: r["sentence_id"])
    assert all(r["score"] > first["score"] for r in order if r["doc_id"] == 1 and r["sentence_id"] != first["sentence_id"])


def test_short_needles_return_empty_alignments(spark, small):
    rows = found(spark, small, "zebra")
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert all(r["score"] == 0.5 and r["match"] == [-1] for r in rows)


def test_idf_weight_is_a_switch_and_combine_has_no_effect(spark, small):
    scores = [[r["score"] for r in found(spark, small, "red fish swim", **o)] for o in ({"idf_weight": 0.1}, {"idf_weight": 1.0}, {"idf_weight": 1.0, "cost_combine_function": "max"})]
    assert scores[0] == pytest.approx(scores[1])
    assert scores[1] == pytest.approx(scores[2])
    with pytest.raises(ValueError, match="cost_combine"):
        S.Options(cost_combine_function="other")


def test_regions(spark, small):
    queries = spark.createDataFrame([(1, "red swim zebra")], "query_id long, query string")
    options = S.Options()
    best = S.search(*small, queries, options).where("place = 1")
    row = regions.regions(best, small[0], S.needles(queries, options)).first()
    # "red fish swim": the gap costs 1 - 2 ** (-1 / 5), and the free diagonal to "far" is not taken
    assert [(x["s"], x["t"]) for x in row["regions"]] == [("red", "red"), ("fish ", None), ("swim", "swim"), ("blue fish swim far away\n nothing here at all", None)]
    assert row["omitted"] == ["zebra"]
    assert {x["metric"] for x in row["regions"] if x["t"]} == {"cosine"}


def test_regions_are_cut_from_the_text(spark):
    text = "One.  İki, (Two) three... A RED -- very Old;\nfish the Swims!  End of it, said he: five six seven eight nine TEN eleven."
    docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    kind = "query_id long, place int, doc_id long, sentence_id int, score double, match array<int>, similarities array<double>"
    # sentences: One / İki, (Two) three / A RED -- very Old / fish the Swims / ...
    rows = spark.createDataFrame([(1, 1, 1, 2, 0.9, [0, 1, -1, 3], [0.5, 1.0, 0.0, 1.0]), (1, 2, 1, 3, 0.8, [0, 2, -1, -1], [1.0, 1.0, 0.0, 0.0])], kind)
    queries = spark.createDataFrame([(1, "one red zebra old")], "query_id long, query string")
    needle = S.needles(queries, S.Options())
    found = {r["place"]: r for r in regions.regions(rows, corpus.sentences(docs), needle, docs=docs).collect()}
    first = found[1]["regions"]
    assert [x["s"] for x in first] == ["One.  İki, (Two) three... ", "A", "RED", "very ", "Old", "fish the Swims!  End of it, said he: five six "]
    assert [(x["pos_s"], x["pos_t"]) for x in first if x["t"]] == [("DET", "NOUN"), ("NOUN", "NOUN"), ("NOUN", "NOUN")]
    assert (found[1]["omitted"], [x["mismatch_penalty"] is None for x in first]) == (["zebra"], [False, True, True, False, True, True])
    assert first[0]["mismatch_penalty"] == 0
    # İ is one token of the text and two of its lower case
    assert [x["s"] for x in found[2]["regions"]][1:] == ["fish", "the ", "Swims", "End of it, said he: five six seven eight nine "]
    short = spark.createDataFrame([(1, 1, 2, 0, 0.9, [0, -1, -1, -1], [0.5, 0.0, 0.0, 0.0])], kind)
    assert [x["s"] for x in regions.regions(short, corpus.sentences(docs), needle, docs=docs).first()["regions"]] == ["other"]


def test_relevance_measures(spark):
    rows = spark.createDataFrame([("q", r, i) for r, i in enumerate("abcd", 1)], "q string, rank int, item string")
    truth = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z")], "q string, item string")
    judged, n = evaluate.judged(rows, truth, ["q"], "item"), evaluate.relevant(truth, ["q"], "item")
    value = lambda df: df.first()["value"]
    assert value(evaluate.precision_at_k(judged, ["q"], 2)) == 0.5
    assert value(evaluate.average_precision(judged, n, ["q"], 4)) == pytest.approx((1 + 2 / 3) / 3)
    assert value(evaluate.discounted_cumulative_gain(judged, ["q"], 3)) == pytest.approx(1 + 1 / 2)
    assert value(evaluate.r_precision(judged, n, ["q"])) == pytest.approx(2 / 3)
    assert evaluate.measure_name({"type": "average_precision", "n": 10}) == "ap@10"


def test_merge_dimensions(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1)], "p string, q string, value int")
    assert evaluate.merge_all_dimensions(rows, ["p", "q"]).collect() == [("a, b", "x, y", 1)]


def test_chapters(spark):
    def chapters(text):
        return [tuple(x) for x in column(spark, readers.chapters(F.lit(text)))]

    text = "front\n\n\nChapter 1\n\none\n\n\nChapter 2\n\ntwo\n\n\nChapter 1\n\nagain"
    assert [(b, c) for b, c, _ in chapters(text)] == [(-1, -1), (1, 1), (1, 2), (2, 1)]
    assert "".join(x for _, _, x in chapters(text)) == text
    contents = "c\n\n\nChapter 1\n\n\n\nChapter 1\n\none\n\n\nChapter 2\n\ntwo"
    assert [(b, c) for b, c, _ in chapters(contents)] == [(-1, -1), (-1, 1), (-1, 2)]
    longer = "c\n\n\nChapter 1\n\n\n\n\nChapter 1\n\none\n\n\nChapter 2\n\ntwo"
    assert chapters(longer) == [(-1, -1, "c\n\n\nChapter 1\n\n"), (-1, 1, "\n\n\nChapter 1\n\none"), (-1, 2, "\n\n\nChapter 2\n\ntwo")]
    for bad in ("x\n\n\nChapter 3\n\ny", "x\n\n\nChapter 1\n\ny\n\n\nChapter 3\n\nz", "x\n\n\nChapter 99999999999\n\ny", "plain", ""):
        assert chapters(bad) == [(-1, -1, bad)]
    # only contents of one chapter each: the last one is the text
    assert [(b, c) for b, c, _ in chapters("\n\n\nchapter 1\n\n\n\n\nCHAPTER 1: x\n\nend")] == [(-1, -1), (-1, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "novel").mkdir()
    (tmp_path / "novel" / "n.txt").write_text("front\n\n\nChapter 1\n\none\n\ntwo")
    rows = readers.novels(spark, str(tmp_path / "novel")).collect()
    assert [r["text"] for r in rows if r["chapter"] == 1][-2:] == ["one\n\n", "two"]
    (tmp_path / "play.xml").write_text(
        '<play><title>Hear</title><personae><persname short="Bob">Robert</persname></personae><scene actnum="1" num="2"><speech><speaker>Bob</speaker><line globalnumber="7">Hear</line><line globalnumber="8">me</line></speech>'
        '<speech><speaker>Ann</speaker><line globalnumber="9">No</line></speech></scene></play>'
    )
    rows = sorted(readers.plays(spark, str(tmp_path / "play.xml")).collect(), key=lambda r: r["location"])
    assert [(r["book"], r["chapter"], r["speaker"], r["location"], r["text"], r["name"]) for r in rows] == [(1, 2, 1, 7, "Hear me", "Robert"), (1, 2, 2, 9, "No", "Ann")]
    (tmp_path / "script").mkdir()
    (tmp_path / "script" / "s.txt").write_text("  [door]\nkirk: go\n  all wait\nSpock [low]: yes: sir\n\nOriginal Airdate: x\n")
    rows = readers.screenplays(spark, str(tmp_path / "script")).orderBy("location").collect()
    assert [(r["speaker"], r["name"], r["text"]) for r in rows] == [
        (1, "KIRK", "go"), (2, "stage instruction", "all wait"), (3, "SPOCK", "yes: sir"), (2, "stage instruction", ""),
        (4, "ORIGINAL AIRDATE", "x"),  # the original takes a dated line for a speech, since it has a colon
    ]
    (tmp_path / "vec.txt").write_text("3 2\ncat 1 2\nDog 1 2\nx1 3 4\ndog 0.5 1\n")
    assert {r["token"]: r["embedding"] for r in readers.word_vector_text(spark, str(tmp_path / "vec.txt")).collect()} == {"cat": [1, 2], "dog": [0.5, 1]}


def test_documents_of_a_folder(spark, tmp_path):
    for name, text in {
        "novels/Ann Author/A Book.txt": "front\n\n\nChapter 1\n\none\n\ntwo", "novels/README.md": "no", "screenplays/Star/S1/Pilot.txt": "kirk: go\nbones: no",
        "screenplays/Star/Film.txt": "kirk: stay", "shakespeare/play.xml": '<play><title>A Play</title><scene actnum="1" num="2"><speech><speaker>Bob</speaker><line globalnumber="7">Hear</line></speech></scene></play>',
    }.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = {r["title"]: r for r in readers.documents(spark, str(tmp_path / "root")).collect()}
    assert {(t, r["author"], r["category"]) for t, r in rows.items()} == {
        ("A Book", "Ann Author", "novels"), ("S1, Pilot", "Star", "screenplays"), ("Film", "Star", "screenplays"), ("A Play", "William Shakespeare", "shakespeare"),
    }
    assert rows["A Book"]["text"] == "front\n\n\nChapter 1\n\none\n\ntwo"
    assert rows["S1, Pilot"]["speakers"] == {1: "KIRK", 2: "BONES"}
    assert rows["A Play"]["text"] == "Hear"
    again = {r["doc_id"] for r in readers.documents(spark, str(tmp_path / "root")).collect()}
    assert again == {r["doc_id"] for r in rows.values()}
    assert min(again) >= 0


def test_dump_and_resolve(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One sentence. Another one", "en", "src")], "doc_id long, text string, lang string, source string")
    signed = corpus.signatures(docs)
    writers.dump(signed, str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).where("value like '%sentence'").count() == 1
    wanted = signed.select("doc_signature", "signature").limit(1).union(spark.createDataFrame([("no", "no")], "a string, b string"))
    hit, missed = corpus.resolve(wanted, signed)
    assert (hit.count(), missed.count()) == (1, 1)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "s", 5) for i in range(20)], incremental.DOCUMENTS)
    docs.repartition(4).write.parquet(str(tmp_path / "docs"))
    stream = incremental.document_stream(spark, str(tmp_path / "docs"), 1)
    search = lambda d: d.select(F.lit(1).alias("query_id"), "doc_id", F.lit(0).alias("sentence_id"), F.col("doc_id").cast("double").alias("score"))
    incremental.progressive_search(stream, search, str(tmp_path / "top"), str(tmp_path / "c1"), 5, 60).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "top").iterdir() if p.name.isdigit())
    assert spark.read.json(str(tmp_path / "top-progress" / str(last))).first()["progress"] == 1.0
    assert 0 < spark.read.json(str(tmp_path / "top-progress" / "0")).first()["done"] < 60
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "top" / str(last))).collect()} == {15, 16, 17, 18, 19}
    incremental.ingest(incremental.document_stream(spark, str(tmp_path / "docs")), corpus.sentences, str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


def test_abort_and_begin(spark):
    import threading
    import time

    stopped = []

    def waiting(batches):
        time.sleep(40)
        yield from batches

    def slow():
        incremental.begin(spark, "someone")
        try:
            spark.range(2, numPartitions=2).mapInPandas(waiting, "id long").collect()
        except Exception as e:
            stopped.append(e)

    thread = threading.Thread(target=slow)
    thread.start()
    time.sleep(5)
    began = time.time()
    incremental.abort(spark, "someone")
    thread.join(60)
    assert time.time() - began < 25
    assert stopped


def test_measures_by_name(spark):
    row = spark.createDataFrame([([0.6, 0.8], [1.0, 0.0])], "a array<double>, b array<double>")
    value = lambda name: row.select(V.measure(name).alias("x")).first()["x"]
    assert value("pnorm-2") == value("p-norm") == pytest.approx(1 - (0.16 + 0.64) ** 0.5 / 2)
    assert value("pnorm-1") == 0
    assert value("pnorm-0.5") == pytest.approx(1 - (0.4**0.5 + 0.8**0.5) ** 2 / 5000)
    assert column(spark, V.apsynp(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)))) == pytest.approx(1)
    assert column(spark, V.clipped(F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.0)))) == [0, 0.5, 1]


def test_other_taggers(spark, small):
    tagger = S.Tagger.of({"red": ("ADJ", "JJ"), "blue": ("ADJ", "JJ"), "swim": ("VERB", "VB")})
    queries = spark.createDataFrame([(1, "red the swim")], "query_id long, query string")
    rows = {r["t_token"]: (r["pos"], r["tag"], r["weight"]) for r in S.needles(queries, S.Options(tagger=tagger, pos_weights={"VB": 1.2})).collect()}
    assert rows == {"red": ("ADJ", "JJ", 1.0), "the": ("NOUN", "NN", 1.0), "swim": ("VERB", "VB", 1.2)}
    score = lambda **o: S.search(*small, spark.createDataFrame([(1, "blue")], "query_id long, query string"), S.Options(pos_mismatch_penalty=1.0, **o)).where("doc_id = 2").first()["score"]
    assert score() == pytest.approx(0.8)
    assert score(tagger=S.Tagger.of({"blue": ("NOUN", "NN"), "red": ("ADJ", "JJ")})) == 0.5


def test_located_results(spark):
    found = spark.createDataFrame([(1, 7, 0, 0.9), (1, 8, 3, 0.8)], "query_id long, doc_id long, sentence_id int, score double")
    places = spark.createDataFrame([(7, 0, 2, 3, 1, 44), (8, 3, -1, 5, -1, 6)], readers.SENTENCES.replace("n_tokens int", "x int").replace("book", "sentence_id int, book").replace(", x int", ""))
    documents = spark.createDataFrame([(7, "Poet", "Play", {1: "HAM"}), (8, "Writer", "Novel", {})], "doc_id long, author string, title string, speakers map<int,string>")
    rows = {r["doc_id"]: tuple(r["location"]) for r in regions.located(found, places, documents).collect()}
    assert rows == {7: ("HAM", "Poet", "Play", "III.3, line 44"), 8: ("", "Writer", "Novel", "Chapter 5, par. 6")}


def test_one_row_for_a_sentence(spark):
    found = spark.createDataFrame([(1, 7, 0, 0, 0.5, [0]), (1, 7, 0, 1, 0.9, [1]), (1, 7, 1, 0, 0.5, [0]), (1, 7, 1, 1, 0.5, [1])], "query_id long, doc_id long, sentence_id int, metric_no int, score double, match array<int>")
    assert [(r["sentence_id"], r["metric_no"]) for r in S.distinct_sentences(found).orderBy(S.MATCH_ORDER).collect()] == [(0, 1), (1, 0)]
    assert column(spark, T.penalised(F.lit(0.8), F.lit(5), 5, F.lit(9))) == pytest.approx(0.4)


def test_settings(tmp_path):
    from palimpsest import settings

    assert settings.load().embeddings == ["fasttext"]
    path = tmp_path / "s.json"
    path.write_text('{"metrics": ["nicdm"], "embeddings": ["a"], "fasttext": "f", "more": 1}')
    assert settings.load(str(path)) == (["nicdm"], ["a"], "f")
    path.write_text('{"metrics": []}')
    with pytest.raises(KeyError, match="embeddings"):
        settings.load(str(path))


def test_stored_tables(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "m.npy", np.array([[1, 2], [3, 4]], "float64"))
    np.save(tmp_path / "w.npy", np.array(["cat", "dog"]))
    rows = readers.numpy_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "w.npy")).collect()
    assert {r["token"]: r["embedding"] for r in rows} == {"cat": [1, 2], "dog": [3, 4]}
    spark.createDataFrame([("cat", 1.0, 2.0)], "token string, v0 float, v1 float").write.parquet(str(tmp_path / "e.parquet"))
    assert readers.embedding_table(spark, str(tmp_path / "e.parquet")).first()["embedding"] == [1, 2]
    tokens = spark.createDataFrame([(1, 0, 3, "NOUN", "NN", -1.0)], readers.TOKENS)
    sentences = spark.createDataFrame([(1, -1, -1, -1, 0, 1)], readers.SENTENCES)
    writers.write_corpus(tokens, sentences, str(tmp_path / "c"), spark.createDataFrame([(1, "cat", "t")], "doc_id long, text string, title string"))
    writers.write_corpus(tokens.limit(0), sentences, str(tmp_path / "c"))
    assert [x.count() for x in readers.corpus_tables(spark, str(tmp_path / "c"))] == [1, 1]
    assert spark.read.parquet(str(tmp_path / "c" / "documents.parquet")).first()["title"] == "t"
    writers.write_evaluation(spark.createDataFrame([("a", 0.5), ("b", None)], "p string, value double"), str(tmp_path / "v"))
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "v"), sep=";", header=True).select("value").collect()) == ["-1.0", "0.5"]
    found = spark.createDataFrame([(1, 1, 7, 0.5)], "query_id long, place int, doc_id long, score double")
    assert writers.results_json(found).first()["json"] == '{"doc_id":7,"score":0.5}'
    assert "<td>7</td>" in writers.html_table(found)


def test_the_only_difference(spark):
    a, b = F.array(F.lit(1), F.lit(2), F.lit(None)), F.array(F.lit(1), F.lit(3), F.lit(None))
    assert column(spark, evaluate.only_difference(a, b)) == 1
    assert column(spark, evaluate.only_difference(a, a)) is None
    assert column(spark, evaluate.only_difference(a, F.array(F.lit(0), F.lit(3), F.lit(None)))) is None


def test_sentence_texts_of_plain_texts_are_byte_slices(spark):
    """Both ways of cutting give the same; the plain one takes no token apart."""
    texts = ["So it goes. Été: yes!  It is…\n\nNo;(never) 1,5", " .. a", "...", "", None, "x", "Ωμέγα. été", "ÀÉ;ñandú — «ok». 2² ¼"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, corpus.sliced_texts(docs).collect()))
    assert sorted(map(tuple, corpus.sentence_texts(docs).collect())) == want
    assert {d for d, *_ in want} == {0, 1, 5, 6, 7}
    plain = corpus.sentence_texts(docs.where("doc_id <> 6"))._jdf.queryExecution().optimizedPlan().toString()
    assert "plain_sentence_texts" in plain or "ArrowEvalPython" in plain or "<lambda>" in plain


def test_compared_pairs_are_those_of_expressions(spark, monkeypatch):
    """Vectors in an array or joined: the same to the last bit. The pairs are not joined to anything."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist(), float(k)) for k in range(40)] + [(40, None, 1.0), (41, [0.0] * 6, None)]
    left = spark.createDataFrame(rows, "k long, a array<double>, mean_a double")
    right = left.where("k % 10 = 0 AND a IS NOT NULL").select(F.col("k").alias("q"), F.col("a").alias("b"), F.col("mean_a").alias("mean_b"))
    told = {}
    for most in (4096, 1):
        monkeypatch.setattr(embeddings, "ASKED", most)
        told[most] = [sorted(map(str, embeddings.compared(left, right, "k", "q", apart).collect())) for apart in (False, True)]
    assert told[4096] == told[1]
    assert len(told[1][0]) == 42 * 4 - 4


def test_neighbour_means_of_both_plans(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in rng.permutation(70).tolist()], "vec_id long, vec array<double>")
    shared = sorted(map(tuple, embeddings.neighbour_means(rows, 9).collect()))
    monkeypatch.setattr(embeddings, "SHARED", 1)
    joined = sorted(map(tuple, embeddings.neighbour_means(rows, 9).collect()))
    assert [x[:2] for x in shared] == [x[:2] for x in joined]
    assert [x[2] for x in shared] == pytest.approx([x[2] for x in joined], rel=1e-12)
    assert len(shared) == 630
