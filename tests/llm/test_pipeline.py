"""Every stage of the pipeline against brute force, each on what the stage before it left, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import common, embedding_dedup, fingerprints, language, minhash, mixing, quality, suffix_dedup, token_counts, token_output
from palimpsest.llm.tokens import WordIds

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
GOOD = ["river", "stone", "wind", "walks", "home", "the", "of", "slowly", "green", "house", "old", "sings", "night", "bread"]
BAD = ["$$$", "BUY", "click", "NOW", "xx1", "###", "free"]


def rows():
    rng = random.Random(11)
    out = []
    for i in range(60):
        words = [rng.choice(BAD if i % 4 == 0 else GOOD) + rng.choice(["", "s", "ly", "er", ","]) for _ in range(rng.randint(5, 120))]
        out.append((i, " ".join(words), "en", rng.choice(["a", "b", None]), 1))
    passage = " ".join(rng.choice(GOOD) + str(k) for k in range(30))
    out += [(60 + k, out[k][1], "en", "a", 1) for k in (1, 2, 3)]  # exact copies
    out += [(70 + k, out[k][1] + " and more", "en", "b", 1) for k in (5, 6, 7) if len(out[k][1].split()) > 20]  # near copies
    out += [(80 + k, f"{GOOD[k]} {k} {passage} tail {k} {' '.join(rng.choice(GOOD) for _ in range(60))}", "en", "c", 1) for k in range(4)]
    out += [(90, "one text of an id that two rows have", "en", "a", 1), (90, "quite another text under the same id", "de", "b", 1), (91, out[9][1], None, None, None), (91, out[9][1], None, None, None)]
    out += [(None, "no id here but words", "en", "a", 1), (None, "no id here but words", "en", "a", 1), (None, "nor here are ids", "fr", None, 1)]
    return out + [(100, None, "en", "a", None), (101, "", "en", None, 0), (102, " \t\n", None, "a", 3), (103, "ß" * 80, "de", "b", 80)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    labels = [(i, int(i % 4 != 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    """What each stage gets, and what the last gives."""
    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(1) for c in ("score", "predicted", "target", "h", "th", "o", "node", "rank", "batch")})
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = docs
        docs = corpus_pipeline.saved(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return found | {"": docs}


def key(r):
    return tuple((x is not None, x) for x in r)


def out_of(inputs, name):
    names = [*STAGES, ""]
    return sorted((tuple(r) for r in inputs[names[names.index(name) + 1]].collect()), key=key)


def into(inputs, name):
    return [tuple(r) for r in inputs[name].select(corpus_pipeline.COLUMNS).collect()]


def plain_score(text, weights):
    """The features of the classifier, one by one, in a dictionary."""
    counts = Counter()
    tokens = quality.TOKEN.findall(text or "")
    mask, mix = (1 << 64) - 1, int(quality.MIX)
    word = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
    form = [xxhash.xxh64_intdigest(quality.shape(t), 1) for t in tokens]
    plain = [w for w, t in zip(word, tokens, strict=True) if quality.shape(t) != "mark"]
    found = word + form + [(a * mix + b) & mask for x in (word, form) for a, b in zip(x, x[1:], strict=False)]
    found += [int(quality.SAME) for a, b in zip(plain, plain[1:], strict=False) if a == b]
    for x in found:
        counts[(x * mix & mask) >> (64 - quality.BITS)] += 1
    return 0.5 * float(weights[quality.CONSTANT]) + sum(float(weights[i]) * (n / len(found)) ** 0.5 for i, n in counts.items())


def test_quality_stage(spark, inputs, sf_dir):
    given = into(inputs, "quality")
    weights = quality.train(inputs["quality"].select(corpus_pipeline.COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted((r for r in given if plain_score(r[1], weights) >= 0), key=key)
    assert out_of(inputs, "quality") == want
    assert 40 < len(want) < len(given)
    assert not [r for r in want if r[0] is not None and r[0] < 60 and r[0] % 4 == 0]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_stage(inputs):
    given = sorted(into(inputs, "near duplicates"), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in given]
    root = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    groups = {}
    for k, r in enumerate(given):
        groups.setdefault(root[k], []).append(r)
    kept = out_of(inputs, "near duplicates")
    # one of each group, of its smallest id
    assert len(kept) == len(groups)
    for own in groups.values():
        assert len([r for r in kept if r in own and r[0] == own[0][0]]) >= 1
    assert {r[1] for r in kept if r[0] == 90} == {r[1] for r in given if r[0] == 90}


def test_repeats_stage(inputs):
    given = [(r[0] if r[0] is not None else (1 << 63) - 1, r[0], (r[1] or "").encode(), r[2], r[3]) for r in into(inputs, "repeated passages")]
    least = {}
    for i, _, text, _, _ in given:
        for k in range(len(text) - 49):
            least[text[k : k + 50]] = min(i, least.get(text[k : k + 50], i))
    want = []
    for i, doc_id, text, lang, source in given:
        gone = [False] * len(text)
        for k in range(len(text) - 49):
            if least[text[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        left = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((doc_id, left, lang, source, len(left)))
    assert out_of(inputs, "repeated passages") == sorted(want, key=key)
    assert sum(len(r[1]) for r in want) < sum(len(r[1] or "") for r in into(inputs, "repeated passages"))


def test_repeats_stage_frees_its_shuffles(spark, inputs):
    """The moved texts and the names of each round are off the disk before the next round, whenever the driver collects garbage."""
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    there = files()
    left = corpus_pipeline.drop_repeated_passages(spark, inputs["repeated passages"], "")
    assert not files() - there
    assert left.count() == inputs["repeated passages"].count()


def stored(spark):
    """Frames and tables that are stored now, without the random end of their names."""
    folder = Path(common.scratch_dir(spark).removeprefix("file://"))
    tables = {r["tableName"] for r in spark.sql("SHOW TABLES").collect() if not r["isTemporary"]}
    return {x.name for x in folder.iterdir()} | tables


def test_near_duplicates_stage_leaves_no_sketches(spark, inputs):
    """Stage 3 begins without what stage 2 compared."""
    there = stored(spark)
    left = corpus_pipeline.drop_near_duplicates(spark, inputs["near duplicates"], "")
    assert {x.split("-")[0] for x in stored(spark) - there} == {"groups"}
    assert left.count() == inputs["repeated passages"].count()


def test_run_keeps_only_what_the_last_stage_reads(spark, sf_dir, inputs, tmp_path):
    for name, table in (("documents", inputs["quality"]), ("labels", spark.read.parquet(f"{sf_dir}/labels.parquet"))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    there, seen = stored(spark), []
    stages = list(corpus_pipeline.STAGES)
    spied = [(name, lambda s, docs, d, f=f: (seen.append(sorted(x.split("-")[0] for x in stored(spark) - there)), f(s, docs, d))[1]) for name, f in stages]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "STAGES", spied)
        found = corpus_pipeline.run(spark, str(tmp_path))
    assert seen == [[], *[["stage"]] * (len(stages) - 1)]
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["length"]) for r in found.collect()) == sorted((r["doc_id"] is not None, r["doc_id"], r["length"]) for r in inputs[""].collect())


def test_runs_of_names_are_little_more_than_the_names():
    """With many buckets a document has a name or two in each, so its id must not outweigh them."""
    rng = random.Random(4)
    odd = [-(1 << 63), -5, 0, 7, 1 << 40, (1 << 63) - 1]
    for ids in ([5], list(range(0, 300_000, 371)), odd):
        doc = np.array(sorted(i for i in ids for _ in range(rng.choice([1, 2]))), np.int64)
        names = np.array([rng.getrandbits(64) for _ in doc], np.uint64)
        blob = suffix_dedup.runs_blob(names, doc)
        back = suffix_dedup.read_runs(blob)
        assert (back[0] == names).all() and (back[1] == doc).all()
        assert len(blob) < 1.5 * names.nbytes or ids is odd or len(ids) == 1


def test_mixing_stage(inputs):
    given = into(inputs, "mixing")
    connection = duckdb.connect()
    import pandas as pd

    named = [(k, r[1], r[3]) for k, r in enumerate(given) if r[0] is not None]
    frame = pd.DataFrame([(given[k][0], t, s) for k, t, s in named], columns=["doc_id", "text", "source"]).astype({"text": object, "source": object})
    # ids that are null have a hash of their own; SQL has them as null too
    frame = pd.concat([frame.astype({"doc_id": "Int64"}), pd.DataFrame([(None, r[1], r[3]) for r in given if r[0] is None], columns=frame.columns).astype({"doc_id": "Int64", "text": object, "source": object})])
    connection.register("documents", frame)
    want = Counter()
    for doc_id, size, source_size, _, taken in connection.execute(mixing.ORACLE).fetchall():
        if size:
            want[doc_id, size, source_size, taken // size] += 1
    sizes = Counter()
    for r in given:
        sizes[r[3]] += len((r[1] or "").split())
    got = Counter(out_of(inputs, "mixing"))
    found = Counter((r[0], len(r[1].split()), sizes[r[3]], got[r] // given.count(r)) for r in given if (r[1] or "").split())
    assert found == want
    assert set(got) <= set(given)
    assert max(got[r] / given.count(r) for r in got) <= 2


def test_packing_stage(inputs):
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in into(inputs, "packing"):
        ids = [*np.frombuffer(words.ids(r[1] or ""), "<u2").tolist(), 1]
        assert ids[:-1] == words.tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want += [(r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    got = [tuple(r) for r in inputs[""].collect()]
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist()
        assert ends[-1] <= 4096
    assert len(sequences) == -(-sum(r[3] for r in got) // 4096)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_empty_table(spark, sf_dir, name):
    empty = spark.createDataFrame([], DOCS)
    assert STAGES[name](spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("name", [n for n in STAGES if n != "quality"])
def test_stages_on_nulls_alone_and_a_very_long_text(spark, sf_dir, name):
    rng = random.Random(2)
    long = " ".join(rng.choice(GOOD) + str(rng.randrange(10**6)) for _ in range(400_000))  # some 5 MB
    table = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, long, None, None, None)], DOCS)
    found = STAGES[name](spark, table, sf_dir).collect()
    if name == "packing":
        assert sum(r["length"] for r in found) == 2 + len(WordIds(public_tokenizers.path("word_bpe_49k.json")).ids(long)) // 2 + 1
    else:
        assert {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in found if r["doc_id"]} == {hashlib.sha256(long.encode()).hexdigest()}


CLASHES = ("score", "predicted", "lang_pred", "target", "size", "h", "skey", "taken", "found", "cells", "next", "bucket", "n_tokens", "number", "offset", "keys", "best", "row")


def test_operators_keep_clear_of_other_columns(spark, sf_dir):
    docs = spark.createDataFrame([(1, "one two three river", "en", "a", 1), (1, "one two three river", "en", "a", 1), (None, "vier fünf sechs Haus", "de", None, 1), (3, None, None, None, None)], DOCS)
    clashing = docs.withColumns({c: F.lit("x") for c in CLASHES})
    weights = quality.train(docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    model = language.train(docs)
    for f in (
        lambda d: quality.score(d, weights).select("doc_id", "text", "score", "predicted"),
        lambda d: language.predict(d, model).select("doc_id", "text", "lang_pred", "score"),
        lambda d: mixing.mix(d),
        lambda d: mixing.mixed_documents(d).select(docs.columns),
        lambda d: fingerprints.fingerprints(d),
        lambda d: token_counts.count_tokens(d),
        lambda d: token_output.packed_ids(d, limit=8).select("n_tokens", "cu_seqlens"),
        lambda d: suffix_dedup.find_repeats(d, columns=("lang",)),
        lambda d: minhash.near_duplicates(d),
    ):
        own, other = (sorted((tuple(r) for r in f(d).collect()), key=str) for d in (docs, clashing))
        assert own
        assert own == other
    assert set(mixing.mixed_documents(clashing).columns) == set(clashing.columns)


def test_folds_are_never_null(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "en", "a", 1), (None, "two", "de", "a", 1)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for f in (quality.classify_query, language.language_query):
        assert {r["held_out"] for r in f(spark, str(tmp_path)).collect() if r["doc_id"] is None} == {False}


def test_the_greatest_id_is_no_null(spark):
    most = (1 << 63) - 1
    text = "the same words in both of these texts, which are longer than fifty bytes"
    docs = spark.createDataFrame([(most, text, "en", "a", 1), (1, text, "en", "a", 1), (None, "x", "en", "a", 1), (most - 1, "y", "en", "a", 1)], DOCS)
    found = sorted((tuple(r)[:3] for r in suffix_dedup.find_repeats(docs).collect()), key=key)
    assert found == sorted([(None, 1, 0), (1, 72, 0), (most - 1, 1, 0), (most, 72, 72)], key=key)


def test_a_large_group_of_near_copies(spark):
    """2,000 copies, each with an edit of its own, around one text: one component, and few rows out of each step."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    table = []
    for k in range(2000):
        words = list(base)
        words[rng.randrange(120)] = f"edit{k}"
        table.append((k, " ".join(words), "en", "a", 1))
    lone = [(5000 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(120)), "en", "a", 1) for k in range(50)]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(table + lone, DOCS)).collect()}
    assert {found[k] for k in range(2000)} == {0}
    assert all(found[5000 + k] == 5000 + k for k in range(50))


def test_copies_below_the_threshold_stay_apart(spark, monkeypatch):
    """Each has two edits, so pairs are alike in most bands and below the threshold: only what links is joined, in small tiles too."""
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    table = []
    for k in range(150):
        words = list(base)
        for _ in range(1 + k % 2):
            words[rng.randrange(60)] = f"edit{k}-{rng.randrange(9)}"
        table.append((k, " ".join(words), "en", "a", 1))
    sets = [shingles(r[1]) for r in table]
    root = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert 5 < len(set(root)) < 150
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(table, DOCS)).collect()}
    assert found == dict(enumerate(root))


def test_links_of_the_test_tables_are_all_found(spark):
    """Recall against exact links, found by a join on shingles, on sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    holders = {}
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        own = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
        sets[r["doc_id"]] = own
        for x in own:
            holders.setdefault(x, []).append(r["doc_id"])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = 0
    for i, own in sets.items():
        counts = Counter(j for x in own for j in holders[x] if j < i)
        for j, n in counts.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert links > 50
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert found == {i: find(i) for i in sets}


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        embedding_dedup.saved.__globals__["scratch_dir"](Session())
