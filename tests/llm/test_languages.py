import numpy as np
import pytest
from pyspark.sql import functions as F

from querytally.llm.languages import _trigrams, held_out, identify, infer, train
from querytally.llm.queries import op1

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return train(docs.filter(~held_out()))


def test_held_out_accuracy(spark, docs):
    got = op1(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.count("doc_id").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert r.n > 200 and r.ok > 0.99
    assert got.filter("score < 0 OR score > 1").count() == 0 and got.count() == docs.count()


def test_mixtures_are_found(docs, model):
    """Half a German and half a French text are both; a text of one language is one."""
    by = {lang: [r.text.encode() for r in docs.filter(f"lang = '{lang}' AND length(text) > 1500").orderBy("doc_id").limit(12).collect()] for lang in ("de", "fr")}
    mixed = [a[:700] + b" " + b[:700] for a, b in zip(by["de"], by["fr"])]
    chosen, shares = infer(mixed, model.probabilities)
    names = [{model.names[i] for i in c if i >= 0} for c in chosen.tolist()]
    assert sum(n == {"de", "fr"} for n in names) >= 10
    assert np.abs(shares[:, 0] - 0.5).max() < 0.2 and np.allclose(shares.sum(axis=1), 1)
    chosen, _ = infer(by["de"], model.probabilities)
    assert sum((c >= 0).sum() == 1 for c in chosen) >= 10


def test_shares_are_the_likelihood_maximum(model):
    """The EM result against a fine grid search for two languages."""
    from querytally.llm.languages import _mixture

    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(50), 2)
    counts = rng.multinomial(400, 0.3 * p[0] + 0.7 * p[1]).astype(float)
    share, top = _mixture(p, counts, np.array([0, 50]), np.ones((1, 2)), 500)
    grid = [(counts * np.log(a * p[0] + (1 - a) * p[1])).sum() for a in np.linspace(0.001, 0.999, 999)]
    assert abs(top[0] - max(grid)) < 1e-2 and abs(share[0, 0] - np.linspace(0.001, 0.999, 999)[int(np.argmax(grid))]) < 0.01


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 !? 🙂 "), (4, "a"), (5, "und der die das " * 20_000), (None, "el la los"), (4, "a"), (6, "É")]
    frame = spark.createDataFrame([(*r, "en", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = identify(frame, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0
    assert by[5].lang_pred == "de" and by[4].lang_pred != "und" and by[6].lang_pred != "und"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1
    assert identify(frame.filter("false"), model).count() == 0


def test_no_labelled_rows(spark):
    frame = spark.createDataFrame([(1, "der", None)], "doc_id long, text string, lang string")
    assert identify(frame, train(frame)).first().lang_pred == "und"


def _invented(rng):
    """Texts of sixteen languages: eight with many words of few letters, so close to each other, eight with few words of other letters."""
    words = []
    for letters, n in (("aeiounrstl", 300), ("ابتثجحخدرزسشعغفقكلمنهوي", 60)):
        words += [["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(n)] for _ in range(8)]
    return lambda i, n: " ".join(rng.choice(words[i], n))


def test_a_minority_language_beyond_the_best_six(spark):
    """Four fifths of one script and a fifth of another: by itself the minority's language explains the whole text worse than six others."""
    text = _invented(np.random.default_rng(5))
    learned = train(spark.createDataFrame([(i * 20 + j, text(i, 200), f"l{i:02}") for i in range(16) for j in range(20)], "doc_id long, text string, lang string"))
    mixed = [(text(0, 160) + " " + text(9, 40)).encode() for _ in range(6)]
    for one in mixed:
        alone = np.log(learned.probabilities)[:, _trigrams([one])[0]].sum(axis=1)
        assert (alone > alone[9]).sum() >= 6
    chosen, shares = infer([*mixed, b"", mixed[0][:400]], learned.probabilities)
    assert chosen[:6, :3].tolist() == [[0, 9, -1]] * 6 and chosen[7, 0] == 0 and (chosen[6] == -1).all()
    assert (shares[:6, 1] > 0.15).all() and np.allclose(shares[:6].sum(axis=1), 1)


def test_candidates_to_begin_with_do_not_decide(docs, model):
    """Starting from one or two languages gives the sets that all of them give."""
    by = {lang: [r.text.encode() for r in docs.filter(f"lang = '{lang}' AND length(text) > 1500").orderBy("doc_id").limit(6).collect()] for lang in ("de", "fr", "es")}
    mixed = [a[:900] + b" " + b[:300] + b" " + c[:300] for a, b, c in zip(*by.values())] + by["fr"]
    sets = [[sorted(x for x in c if x >= 0) for c in infer(mixed, model.probabilities, candidates=n)[0].tolist()] for n in (1, 2, len(model.names))]
    assert sets[0] == sets[1] == sets[2] and len(sets[2][0]) == 3
