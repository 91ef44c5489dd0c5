import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import classifier as cl
from colloquy.operators import logistic as lg
from colloquy.operators import tfidf
from colloquy.operators.classifier import TextClassifier, train_and_report, train_classifier
from colloquy.operators.predictors import (CANNED_REPLY, LAYOUT, constant_predictor,
                                           predict_batch, simple_predictor)
from colloquy.operators.tfidf import terms
from colloquy.plans import catalog
from colloquy.plans import evaluation as ev
from colloquy.plans.golden import golden_set
from colloquy.schema import GOLDEN, INTENTS, THREADS, TWEETS, intents_table
from colloquy.session import materialise
from colloquy.sources import tables as tb

WORDS = {"ban": "banned appeal suspended unfair", "bill": "refund charge payment card",
         "net": "wifi server offline lag"}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(60):
        label = sorted(WORDS)[i % 3]
        w = WORDS[label].split()
        rows.append((f"{i:03d}", f"my {w[i % 4]} and {w[(i // 3) % 4]} please", f"about {label}", label,
                     "yes" if label == "ban" else "no", str(1 + i % 5)))
    rows.append(("900", "no label", "r", " ", None, None))
    return spark.createDataFrame(
        rows, "thread_id string, customer_text string, brand_reply string, intent string, "
              "should_escalate string, reply_quality string")


def softmax_optimum(x, y, classes, c):
    """Plain gradient descent on the summed loss with an unpenalised intercept."""
    n, d = x.shape
    w, b, onehot = np.zeros((classes, d)), np.zeros(classes), np.eye(classes)[y]
    for _ in range(6000):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.2 * ((p - onehot).T @ x / n + w / (c * n))
        b -= 0.2 * (p - onehot).mean(0)
    return w, b


@pytest.mark.parametrize("names", [["ban", "bill", "net"], ["ban", "net"]])
def test_regression_matches_the_plain_formulation(spark, labelled, names):
    rows = labelled.where(F.col("intent").isin(names)).orderBy("thread_id")
    classifier = train_classifier(rows)
    terms_of = {r["term"]: r for r in classifier.terms.collect()}
    got = {r["thread_id"]: r for r in classifier.predict(
        classifier.scored(rows).withColumnRenamed("intent", "truth"), "pred").collect()}
    x, y, ids = np.zeros((len(got), len(terms_of))), [], sorted(got)
    for i, r in enumerate(terms(rows, "customer_text").collect()):
        for t in r["terms"]:
            x[i, terms_of[t]["place"]] += terms_of[t]["idf"]
        y.append(names.index(r["intent"]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if len(names) == 2:  # one penalised weight vector for both classes
        w, b = softmax_optimum(x, np.array(y), 2, 0.5)
        want = x @ (w[1] - w[0]) + b[1] - b[0]
        assert np.allclose([got[i]["scores"][0] for i in ids], want, atol=2e-2)
        assert [got[i]["pred"] for i in ids] == [names[int(z > 0)] for z in want]
        return
    w, b = softmax_optimum(x, np.array(y), 3, 1.0)
    z = x @ w.T + b
    mine = np.array([got[i]["scores"] for i in ids])
    share = [np.exp(s) / np.exp(s).sum(1, keepdims=True) for s in (mine, z)]
    assert np.allclose(*share, atol=2e-3)
    assert [names[i] for i in z.argmax(1)] == [got[i]["pred"] for i in ids]


def test_solver_reaches_the_minimum():
    rng = np.random.default_rng(1)
    half = rng.normal(size=(30, 30))
    a, b = half @ half.T + 0.01 * np.eye(30), rng.normal(size=30)
    x, losses, largest = lg.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(30), 500, 1e-5)
    assert largest <= 1e-5 and np.allclose(x, np.linalg.solve(a, b), atol=1e-2)
    assert all(later < earlier for earlier, later in zip(losses, losses[1:], strict=False))


def test_gradient_does_not_depend_on_blocks(spark, labelled, monkeypatch):
    rows = labelled.where("intent <> ' '")
    one = train_classifier(rows)
    monkeypatch.setattr(lg, "BLOCK_ROWS", 7)
    monkeypatch.setattr(lg, "RANGE", 5)
    many = train_classifier(rows)
    assert np.allclose(one.fit.weights, many.fit.weights, atol=1e-9) and one.fit.gradient <= lg.GRADIENT


def test_vocabulary_limit_and_idf(spark):
    docs = terms(spark.createDataFrame([(1, "bb aa bb"), (2, "aa cc")], "id int, t string"), "t")
    rows = tfidf.vocabulary(tfidf.term_stats(tfidf.term_counts(docs, "id")), 2, 3).orderBy("term").collect()
    assert [r["term"] for r in rows] == ["aa", "aa bb", "bb"] and [r["df"] for r in rows] == [2, 1, 1]
    assert [r["idf"] for r in rows] == pytest.approx([1.0, np.log(1.5) + 1, np.log(1.5) + 1])


def test_one_class_none_and_unusual_rows(spark, labelled):
    rows = labelled.where("intent = 'ban'")
    assert {r["intent"] for r in train_classifier(rows).predict(labelled).collect()} == {"ban"}
    assert {r["intent"] for r in train_classifier(rows.limit(0)).predict(labelled).collect()} == {None}
    odd = spark.createDataFrame([("1", None, 5), ("2", "", 6), (None, "zzz qqq", 7)],
                                "thread_id string, customer_text string, scores int")
    got = train_classifier(labelled.where("intent <> ' '")).predict(odd)
    assert got.columns == ["thread_id", "customer_text", "scores", "intent"]
    assert len({r["intent"] for r in got.collect()}) == 1


@pytest.mark.parametrize("query", ["simple_predict", "train_report"])
def test_queries_fit_on_all_terms_until_the_gradient_is_small(spark, sf_dir, monkeypatch, query):
    """The queries fit on the whole vocabulary of the fitting rows and end by convergence."""
    fits = []
    fit = cl.fit_logistic

    def seen(blocks, n_rows, n_features, *options):
        found = fit(blocks, n_rows, n_features, *options)
        fits.append((n_rows, n_features, found))
        return found

    monkeypatch.setattr(cl, "fit_logistic", seen)
    catalog.QUERIES[query](spark, sf_dir)
    (n_rows, n_features, found), = fits
    docs = catalog.documents(spark, sf_dir)
    if query == "simple_predict":
        every = terms(docs, "text").select(F.explode("terms")).distinct().count()
        assert (n_rows, n_features) == (docs.count(), every)
    assert found.gradient <= lg.GRADIENT and len(found.losses) < cl.MAX_ITER
    assert abs(found.losses[-2] - found.losses[-1]) < 1e-4 * found.losses[-1]


def test_train_save_load_predict(spark, labelled, tmp_path):
    classifier, split, report = train_and_report(labelled)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 48, "test": 12}
    assert {r["label"]: r["f1"] for r in report.collect()}["macro avg"] == 1.0
    classifier.save(str(tmp_path / "model"))
    again = TextClassifier.load(spark, str(tmp_path / "model"))
    test = split.where("split = 'test'").drop("intent")
    assert again.predict(test).select("thread_id", "intent").collect() == classifier.predict(
        test).select("thread_id", "intent").collect()


def test_predictors_and_evaluation(spark, labelled):
    rows = ev.evaluation_rows(labelled)
    assert rows.count() == 60
    predictors = {"trivial": constant_predictor("ban"),
                  "simple": simple_predictor(train_classifier(rows), rows, exclude_self=True)}
    batch = predict_batch(labelled, predictors, "trivial", n=5)
    assert batch.columns == list(LAYOUT) and batch.count() == 5
    assert batch.first()["reply"] == CANNED_REPLY
    with pytest.raises(ValueError):
        predict_batch(labelled, predictors, "other")
    preds = materialise(ev.run_system("trivial", predictors, rows).unionByName(
        ev.run_system("simple", predictors, rows)), "preds")
    assert preds.count() == 120
    scores = {r["system"]: r for r in ev.score_systems(preds).collect()}
    assert scores["trivial"]["intent_accuracy"] == pytest.approx(1 / 3)
    assert scores["simple"]["intent_accuracy"] == 1.0
    assert scores["trivial"]["escalation_f1"] == 0.0
    simple = preds.where("system = 'simple'")
    assert simple.where(F.col("pred_reply") == F.concat(F.lit("about "), "true_intent")).count() == 60
    assert set(ev.summary(ev.score_systems(preds)).columns) == {"metric", "simple", "trivial"}


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,7,True,Wed Oct 11 06:55:44 +0000 2017,"a ""quoted""\nline, two","2,3",\n'
        "2,shop,False,Wed Oct 11 07:00:00 +0000 2017,plain,,1\n")
    rows = tb.read_tweets_csv(spark, str(path)).orderBy("tweet_id").collect()
    assert len(rows) == 2
    assert rows[0]["text"] == 'a "quoted"\nline, two' and rows[0]["response_tweet_id"] == "2,3"
    assert rows[0]["inbound"] is True and rows[0]["in_response_to_tweet_id"] is None
    assert rows[1]["response_tweet_id"] is None


def test_thread_round_trips(spark, tmp_path):
    threads = spark.createDataFrame(
        [("1", 'say "x"\nnow', "r", [("a", "t\n", True)], True), ("2", "", "r", [], False),
         ("3", None, "r", [], False)], THREADS)
    tb.write_threads(threads, str(tmp_path / "p"))
    tb.write_threads_csv(threads, str(tmp_path / "c"))
    want = threads.where("thread_id = '1'").collect()
    assert tb.read_threads(spark, str(tmp_path / "p")).collect() == want
    assert tb.read_threads_csv(spark, str(tmp_path / "c")).collect() == want
    contexts = tb.read_contexts(spark, str(tmp_path / "p"))
    scan = contexts._jdf.queryExecution().executedPlan().toString()
    assert "brand_reply" not in scan and contexts.count() == 3


def test_other_tables(spark, labelled, tmp_path):
    assert tb.read_labelled(labelled).count() == 60
    labelled.coalesce(1).write.option("header", True).csv(str(tmp_path / "l"))
    strings = tb.read_strings_csv(spark, str(tmp_path / "l"), labelled.schema)
    assert strings.where("thread_id = '900'").first()["should_escalate"] == ""
    preds = spark.createDataFrame([("1", "a"), ("2", "b")], "thread_id string, system string")
    tb.write_predictions(preds, str(tmp_path / "preds"))
    tb.write_predictions(preds, str(tmp_path / "preds"))
    back = spark.read.parquet(str(tmp_path / "preds"))
    assert back.where("system = 'a'").count() == 2
    tb.write_metrics(preds, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    tb.write_split(labelled.withColumn("split", F.lit("test")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=test").is_dir()
    vec = spark.createDataFrame([("1", "c", "r", True, [1.0])], "thread_id string, customer_text "
                                "string, brand_reply string, escalated boolean, embedding array<float>")
    path = str(tmp_path / "v")
    tb.write_vectors(vec, path)
    tb.write_vectors(vec.union(vec), path)
    assert tb.read_vectors(spark, path).count() == 1
    tb.write_vectors(vec.union(vec), path, force=True)
    assert tb.read_vectors(spark, path).count() == 2


def test_golden_set(spark):
    rows = [(str(i), "refund" if i % 2 else "hello", "r", [], False) for i in range(80)]
    rows.append(("x", None, "r", [], False))
    golden = golden_set(spark.createDataFrame(rows, THREADS))
    assert golden.columns == GOLDEN.fieldNames()
    out = golden.collect()
    assert len(out) == 22 + 24
    assert sum(r["suggested_intent"] == "billing_subscription" for r in out) >= 22
    assert intents_table(spark).count() == len(INTENTS)


def test_tweet_schema_is_readable(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", True, None, "t", None, None)], TWEETS)
    df.write.parquet(str(tmp_path / "t"))
    assert tb.read_tweets(spark, str(tmp_path / "t")).collect() == df.collect()


def test_neither_terms_nor_weights_are_gathered(spark, monkeypatch):
    """The driver sees a row per fitting row, class or task, however many terms there are, when fitting and when scoring."""
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ala", "olo", "umu", "eke")]
    rows = spark.createDataFrame(
        [(str(i), " ".join(words[(i * j + j) % len(words)] for j in range(1, 40)), "xy"[i % 2]) for i in range(12)],
        "thread_id string, customer_text string, intent string")
    kind, gathered = type(rows), []
    for name in ("collect", "toPandas"):
        plain = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda df, plain=plain: gathered.append(plain(df)) or gathered[-1])
    model = train_classifier(rows)
    scored = model.predict(rows.select("thread_id", "customer_text"))
    assert max(map(len, gathered)) <= 12 and model.fit.weights.shape == (12, 1)
    monkeypatch.undo()
    assert model.terms.count() > 100 and scored.count() == 12


def test_blocks_hold_whole_terms(spark, monkeypatch):
    monkeypatch.setattr(lg, "BLOCK_ROWS", 7)
    want = {(f"t{t:02d}", row, 1 + (t + row) % 3) for t in range(20) for row in range(1 + t % 12)}
    counts = spark.createDataFrame(sorted(want), "term string, row int, tf int").repartition(3)
    blocks = lg.term_blocks(counts).collect()
    got, places = [], []
    for b in blocks:
        weight, term, row, value = lg.read_block(b["at"], b["row"], b["tf"], lambda df: np.ones(len(df)))
        got += [(b["term"][t], int(r), int(v)) for t, r, v in zip(term, row, value, strict=True)]
        places += [(b["part"], b["first"] + i) for i in range(len(weight))]
    assert sorted(got) == sorted(want) and len(set(places)) == len(places) == 20 and len(blocks) > 4
    names = [t for b in blocks for t in b["term"]]
    assert len(names) == len(set(names))


def test_rows_of_no_known_term_and_limited_vocabulary(spark, labelled):
    model = train_classifier(labelled.where("intent <> ' '"), max_features=3)
    assert model.terms.count() == 3 and sorted(r["place"] for r in model.terms.collect()) == [0, 1, 2]
    odd = spark.createDataFrame([("1", "zzz qqq"), ("1", None)], "thread_id string, customer_text string")
    assert [r["scores"] for r in model.scored(odd).collect()] == [pytest.approx(model.intercepts)] * 2


def test_every_labelled_row_is_fitted(spark):
    """More rows than once were drawn; the one row of the last class counts as well."""
    n = 50_200
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("thread_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("customer_text"),
        F.when(F.col("id") == 77, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("intent"))
    model = train_classifier(rows.unionByName(rows.limit(1).withColumn("intent", F.lit(" "))), max_iter=1)
    assert model.labels == ["even", "odd", "rare"] and model.fit.weights.shape == (n, 3)
    assert model.terms.where("term = 'word'").first()["df"] == n


def test_remembered_steps_lie_in_files():
    x = lg._stored(lg.Span(np.arange(6.0).reshape(3, 2), np.ones(2), np.zeros((0, 2))))
    assert isinstance(x.share.base, np.memmap) and np.array_equal(x.share, np.arange(6.0).reshape(3, 2))
    assert x.score.shape == (0, 2)


def test_terms_are_sorted_by_one_number(spark, monkeypatch):
    """A number alone is sorted without comparing terms; terms that share one still stay whole."""
    monkeypatch.setattr(lg, "BLOCK_ROWS", 7)
    want = {(f"t{t:02d}", row, 1) for t in range(12) for row in range(9)}
    counts = spark.createDataFrame(sorted(want, key=lambda x: (x[1], x[0])), "term string, row int, tf int")
    monkeypatch.setattr(lg.F, "xxhash64", lambda c: lg.F.length(c).cast("long"))
    blocks = lg.term_blocks(counts).collect()
    plan = lg.term_blocks(counts)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [hash#" in plan and plan.count(" ASC NULLS FIRST") == 1
    got, names = set(), [t for b in blocks for t in b["term"]]
    for b in blocks:
        _, term, row, value = lg.read_block(b["at"], b["row"], b["tf"], lambda df: np.ones(len(df)))
        got |= {(b["term"][t], int(r), int(v)) for t, r, v in zip(term, row, value, strict=True)}
    assert got == want and len(names) == len(set(names)) == 12
    assert len({(b["part"], b["first"] + i) for b in blocks for i in range(len(b["term"]))}) == 12
