import gc
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brevis.operators import html, ml, rouge, similarity
from brevis.plans import config, presets
from brevis.sources import readers, writers

PAGE = """<div id="documentBody"><p>in  tro</p><table><tr><td>cell</td></tr></table>
<div data-level="1" data-id="KAPITTEL_1"><h2>One</h2><p> a  b </p><div data-level="2" data-id="KAPITTEL_1-1"><h3>h</h3><ul><li>x</li><li>y<b>z</b></li></ul><table><tr><td>cell</td><td>1<i>2</i></td></tr></table><script>no</script><p>one<b>two</b></p><p> </p></div></div>
<div data-level="1" data-id="KAPITTEL_2"><p></p><p>two</p></div></div>"""


def test_xml_is_read_untrimmed(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<root><Disclaimer>d</Disclaimer><Sammendrag> s </Sammendrag><Premiss>p\n\nq</Premiss><Slutning/></root>")
    (tmp_path / "b.txt").write_text("no")
    got = readers.load(spark, "xml", str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a.xml", " s ", "p\n\nq")]


def test_corpus_json_of_both_kinds(spark, tmp_path):
    body = {"train": [{"summary": "s", "filename": "f1", "text": ["x", "y"]}, {"reference": "r2", "text": {"K_0": {"K_0_0": ["a"], "K_0_1": ["b", "c"]}, "K_1": {"K_1_0": ["d"]}}}], "val": [], "test": [{"summary": "t", "filename": "f3", "text": [], "scores": [0.5]}]}
    (tmp_path / "c.json").write_text(json.dumps(body))
    got = {r["doc_id"]: r for r in readers.load(spark, "corpus", str(tmp_path / "c.json")).collect()}
    assert set(got) == {"f1", "r2", "f3"}
    assert [x["text"] for x in got["f1"]["lines"]] == ["x", "y"] and got["f1"]["kind"] == "list"
    assert [tuple(x) for x in got["r2"]["lines"]] == [(0, 0, 0, "a"), (0, 1, 0, "b"), (0, 1, 1, "c"), (1, 0, 0, "d")]
    assert got["r2"]["summary"] == "" and got["r2"]["kind"] == "chapters"
    assert got["f3"]["split"] == "test" and got["f3"]["scores"] == [0.5]


def test_corpus_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("train", "b", "s", ["x"]), ("train", "a", "t", ["y", "z"]), ("test", "c", "u", [])], "split string, filename string, summary string, text array<string>")
    writers.write_corpus_document(df, str(tmp_path / "out"), "filename")
    got = readers.load(spark, "corpus", str(tmp_path / "out" / "part-*"))
    assert sorted((r["split"], r["doc_id"], [x["text"] for x in r["lines"]]) for r in got.collect()) == [("test", "c", []), ("train", "a", ["y", "z"]), ("train", "b", ["x"])]


def test_line_export_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc"), (1, " a ")], "i int, s string")
    writers.write_lines(df, "s", ["i"], str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b c"]


def test_cached_stage(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    path = str(tmp_path / "cache")
    assert writers.write_cached(a.withColumn("y", F.lit(1)), a, path).count() == 2
    assert writers.write_cached(a.withColumn("y", F.lit(2)), a, path).agg(F.sum("y")).first()[0] == 2  # from the cache
    b = a.union(a)
    assert writers.write_cached(b.withColumn("y", F.lit(2)), b, path).agg(F.sum("y")).first()[0] == 8


def test_line_files_and_pairs(spark, tmp_path):
    (tmp_path / "train.source").write_text(" a \nb\n\nc\nd\n")
    (tmp_path / "train.target").write_text("1\n2\n 3\n4")
    got = readers.load(spark, "lines", str(tmp_path / "train.source")).collect()
    assert sorted((r["line_no"], r["text"]) for r in got) == [(0, "a"), (1, "b"), (2, ""), (3, "c"), (4, "d")]
    pairs = readers.load(spark, "line_pairs", str(tmp_path)).collect()
    assert sorted((r["line_no"], r["source"], r["target"]) for r in pairs) == [(0, "a", "1"), (1, "b", "2"), (2, "", "3"), (3, "c", "4")]
    assert readers.load(spark, "line_pairs", str(tmp_path), debug=2).count() == 2


def test_folder_reports_files_that_cannot_be_read(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"PAR1 broken")
    rows, rejects = readers.load(spark, "folder", str(tmp_path / "t"), schema="id long")
    assert rows.count() == 10
    assert [r["path"].rsplit("/", 1)[1] for r in rejects.collect()] == ["bad.parquet"]


def test_corpus_lines(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", ["x"]), ("test", "b", [])], "split string, filename string, text array<string>")
    writers.write_corpus_json(df, str(tmp_path / "c"))
    got = readers.load(spark, "corpus_lines", str(tmp_path / "c"), schema="filename string, text array<string>")
    assert sorted((r["split"], r["filename"], r["text"]) for r in got.collect()) == [("test", "b", []), ("train", "a", ["x"])]


def test_absent_stage_is_empty(spark, tmp_path):
    assert readers.stage(spark, str(tmp_path / "none"), "doc_id long").count() == 0


def test_html_chapters(spark):
    status, lines = html.parse(PAGE)
    assert status == "chapters"
    intro, one, sub = "KAPITTEL_0-0", "KAPITTEL_1-0", "KAPITTEL_1-1"
    assert lines == [(0, 0, 0, intro, "in  tro"), (0, 0, 1, intro, "cell"), (1, 0, 0, one, "One"), (1, 0, 1, one, "a b"), (1, 1, 0, sub, "h"), (1, 1, 1, sub, "x y z"), (1, 1, 2, sub, "cell 1 2"), (1, 1, 3, sub, "one two"), (2, 0, 0, "KAPITTEL_2-0", "two")]
    nested = '<div data-id="AVSNITT_1"><table><tr><td class="x avsnittNummer">1</td><td>a<table><tr><td>b</td></tr></table></td></tr></table></div>'
    assert html.parse(nested) == ("sections", [(0, 0, 0, None, "ab"), (0, 0, 1, None, "b"), (0, 0, 2, None, "b")])
    assert html.parse("<p>x<p>y") == ("paragraphs", [(0, 0, 0, None, "x"), (0, 0, 1, None, "y")])
    assert html.parse("bare <b>text</b>now") == ("text", [(0, 0, 0, None, "bare text now")])
    assert html.parse(None) == ("nothing", [])
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    parsed = html.parse_pages(pages, ["page_id"])
    assert html.page_lines(parsed, ["page_id"]).count() == 9
    assert [r["page_id"] for r in html.rejects(parsed).collect()] == [2]


def test_html_pages_in_slices(spark):
    # what is parsed of many pages isn't held together, and trees go at once
    pages = [PAGE, None, "<p>" + "x" * (html.SLICE // 4) + "</p>", "bare"] * 20
    out = list(html.parsed.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert [r["status"] for part in out for r in part.to_pylist()] == ["chapters", "nothing", "paragraphs", "text"] * 20
    assert len(out) >= 5 and all(part.nbytes <= 2 * html.SLICE for part in out)
    gc.collect()
    gc.disable()
    try:
        for page in pages:
            html.parse(page)
        assert not any(isinstance(x, html.Node) for x in gc.get_objects())
    finally:
        gc.enable()
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string").coalesce(1)
    got = html.parse_pages(rows, ["page_id"]).collect()
    for r in got:
        status, lines = html.parse(pages[r["page_id"]])
        assert r["status"] == status and [tuple(x) for x in r["lines"]] == lines
    assert len(got) == len(pages)


CONFIG = """
[dataset]
name = corpus
[stage1]
input_max_token = 512
lr = 1e-3
debug = False
[summ.n.BRICKS]
source_segmentor = SourceSegmentor
cores = 4
"""


def test_config():
    c = config.parse_config(CONFIG)
    assert c.stage(1).input_max_token == 512 and c.stage(1).lr == 1e-3 and c.stage(1).debug is False
    assert c.stage1.none is None and c.dataset.name == "corpus" and c.nothing is None
    assert config.load_bricks(c, "summ.n") == {"source_segmentor": presets.by_sentences}


def test_presets(spark):
    text = ["The court finds the claim valid.", "It cites the law of contracts.", "The appeal was heard in May.", "Costs are shared."]
    docs = spark.createDataFrame([(1, text[:2], text * 3), (2, text[:1], [])], "doc_id long, summary array<string>, sents array<string>")
    for method in presets.PRESETS:
        out = presets.run(docs, method)
        combined = {r["doc_id"]: r["hypo"] for r in out["combined0"].collect()}
        assert combined[2] == "<s> " and combined[1].startswith("<s> The court")
        assert out["scores"].first()["rouge1_fmeasure"] > 0
    assert presets.run(docs, "summ.n", stages=2)["combined1"].count() == 2


def test_preset_prompts_cache_and_modes(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["A b."], ["One two.", "Three."])], "doc_id long, summary array<string>, sents array<string>")
    for method in presets.PRESETS:
        segments = presets.run(docs, method, prompt="q: ")["segments0"].collect()
        assert segments and all(r["source"].startswith("q: One") for r in segments)
    first = presets.run(docs, "paragraph.rouge", cache=str(tmp_path))["combined0"].collect()
    kept = list((tmp_path / "paragraph.rouge").rglob("fingerprint"))
    assert len(kept) == 1
    stamp = kept[0].stat().st_mtime_ns
    assert presets.run(docs, "paragraph.rouge", cache=str(tmp_path))["combined0"].collect() == first and kept[0].stat().st_mtime_ns == stamp
    assert presets.splits_of("test") == ("test",) == presets.splits_of("train", finegrained=True)
    assert presets.splits_of("train") == ("train", "val", "test")


def test_presets_cut_documents_once(spark, capsys):
    docs = spark.createDataFrame([(1, ["A b."], ["One two.", "Three."]), (2, ["A."], [])], "doc_id long, summary array<string>, sents array<string>")
    for method in ("paragraph.rouge", "paragraph.bert"):
        pairs = presets.run(docs, method)["pairs"]
        pairs.select("doc_id", "n_segments", "n_picks", "hypo", "rouge1_fmeasure").explain()
        assert capsys.readouterr().out.count("ArrowEvalPython [spans(") == 1
        assert sorted((r["doc_id"], r["n_segments"], r["n_picks"], r["hypo"]) for r in pairs.collect()) == [(1, 1, 0, "<s> One two. Three."), (2, 0, 0, "<s> ")]


def test_embedding_similarity_makes_a_vector_once(monkeypatch):
    def slow(items):
        vectors = [np.stack([ml.hashed_vector(t) for t in rouge.tokens(s)] or [np.zeros(ml.DIMENSIONS, np.float32)]) for s in items]
        even = [np.full(len(v), 1 / len(v)) for v in vectors]
        return [round(f, 6) if f == f else 0.0 for f in (similarity.weighted_f(*x) for x in zip(vectors, vectors[1:], even, even[1:]))]

    items = ["The court finds the claim valid.", "...", "It cites the law of contracts and the claim.", "the the", "", "The law."]
    want, made, own = slow(items), [], ml.hashed_vector
    monkeypatch.setattr(ml, "hashed_vector", lambda t: made.append(t) or own(t))
    monkeypatch.setattr(ml, "known_units", lambda u=ml.Units(): u)
    assert presets.embedding_similarity(items * 2)[: len(want)] == want and presets.embedding_similarity([]) == []
    assert len(made) == len(set(made))
    few = ml.Units(most=4)  # begun anew, also amid a sentence's tokens
    for text in items * 2:
        got = few.of(rouge.tokens(text))
        assert np.array_equal(got, ml.Units().of(rouge.tokens(text))) and len(few.place) <= 4 + 9


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(ml.hashed_embeddings("t")).collect()]
    assert [len(x) for x in got] == [3, 0] and got[0][0] == got[0][2] != got[0][1] and len(got[0][0]) == ml.DIMENSIONS


def test_regressor_makes_its_rows_once(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.regression import LinearRegression

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def label(i):
        made.add(1)
        return float(i % 3)

    texts = ["The court finds it.", "It cites law, Law.", "", "Costs are shared.", "Costs of the court."] * 8
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, input_text string").withColumn("label", label("id"))
    model = ml.train_regressor(rows, features=64)
    assert made.value == len(texts)
    want = Pipeline(stages=[
        RegexTokenizer(inputCol="input_text", outputCol="_words", pattern=r"[^\p{L}0-9]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=64),
        IDF(inputCol="_tf", outputCol="_features"), LinearRegression(featuresCol="_features", labelCol="label", predictionCol="score", regParam=0.1)]).fit(rows)
    got, same = ({r["id"]: round(r["score"], 6) for r in ml.regressor_scores(m, rows).collect()} for m in (model, want))
    assert got == same and len(got) == len(texts)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
