import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import language as L

TEXTS = {
    "en": "the house on the hill was built by people who came from the north and it has stood there for many years",
    "de": "das Haus auf dem Hügel wurde von Leuten gebaut die aus dem Norden kamen und es steht seit vielen Jahren dort",
    "fr": "la maison sur la colline a été construite par des gens venus du nord et elle est là depuis de nombreuses années",
    "es": "la casa en la colina fue construida por personas que vinieron del norte y lleva allí muchos años en pie",
}


@pytest.fixture(scope="module")
def model():
    return L.fit([t for t in TEXTS.values() for _ in range(5)], [k for k in TEXTS for _ in range(5)])


def decide(spark, rows, model, **options):
    docs = spark.createDataFrame(rows, "id bigint, text string, host string, declared string, language string")
    out = L.identify(docs, model, ["id"], host=F.col("host"), declared=F.col("declared"), **options)
    return {r.id: (r.language, r.confidence, r.accepted) for r in out.collect()}


def test_texts(spark, model):
    rows = [(i, t, None, None, "x") for i, t in enumerate(TEXTS.values())]
    out = decide(spark, rows, model)
    assert [out[i][0] for i in range(4)] == list(TEXTS)
    assert all(accepted and p > 0.9 for _, p, accepted in out.values())


def test_nothing_to_go_by(spark, model):
    rows = [(1, None, "h.de", "de", None), (2, "", None, None, None), (3, "123 $$$ 42 !!", "h.de", "de", None), (4, "qxzj wvkq zzxq qqkz xjxj zqzq wqxz kzkz vvqx", None, None, None)]
    out = decide(spark, rows, model)
    assert [out[i][0] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert [out[i][1] for i in (1, 2, 3)] == [0.0] * 3
    assert not any(accepted for _, _, accepted in out.values())


def test_other_evidence_decides_where_the_text_does_not(spark, model):
    """`la` is French and Spanish; markup, suffix or the host's other texts tell."""
    rows = [(1, "la", None, "es-MX", None), (2, "la", None, "FR", None), (3, "la", "www.casa.es", None, None), (4, "la", "www.maison.fr", None, None), (5, "la", "spain.example", None, None), (6, "la", "france.example", None, None)]
    rows += [(100 + i, TEXTS["es"], "spain.example", None, None) for i in range(20)]
    rows += [(200 + i, TEXTS["fr"], "france.example", None, None) for i in range(20)]
    out = decide(spark, rows, model)
    assert [out[i][0] for i in range(1, 7)] == ["es", "fr", "es", "fr", "es", "fr"]


def test_hosts_smooth_towards_their_domains(spark, model):
    """An unseen host of a domain with Spanish texts expects Spanish, one of another domain does not."""
    rows = [(1, "la", "new.spain.example", None, None), (2, "la", "new.other.test", None, None)]
    rows += [(100 + i, TEXTS["es"], f"h{i}.spain.example", None, None) for i in range(20)]
    rows += [(200 + i, TEXTS["fr"], f"h{i}.france.test", None, None) for i in range(20)]
    out = decide(spark, rows, model)
    assert out[1][0] == "es"
    assert out[2][0] == "fr"


def test_priors(spark, model):
    """Against the same smoothing by hand."""
    n = len(model.languages)
    certain = {k: [0.0 if j == k else -1000.0 for j in range(n)] + [-2000.0, 50.0] for k in range(n)}
    rows = [("a.x.uk", certain[0])] * 3 + [("b.x.uk", certain[1])] + [("c.y.uk", certain[2])] * 2 + [(None, certain[3])] * 5
    found = L.host_priors(spark.createDataFrame(rows, "host string, e array<double>"), n, smoothing=10.0)
    counts = {"a.x.uk": np.eye(n)[0] * 3, "b.x.uk": np.eye(n)[1], "c.y.uk": np.eye(n)[2] * 2}

    def smooth(c, parent):
        return (c + 10 * parent) / (c.sum() + 10)

    top = smooth(sum(counts.values()), np.full(n, 1 / n))
    uk = smooth(sum(counts.values()), top)
    domains = {"x.uk": smooth(counts["a.x.uk"] + counts["b.x.uk"], uk), "y.uk": smooth(counts["c.y.uk"], uk)}
    for r in found.collect():
        assert r.prior == pytest.approx(smooth(counts[r.host], domains[r.host[2:]]))
    assert found.count() == 3


@pytest.mark.parametrize(
    "address, host",
    [("http://A.example.com/x", "a.example.com"), ("https://u:p@h.de:80/", "h.de"), ("ftp://h", "h"), ("no address", None), (None, None), ("http://", None), ("http://h?q#f", "h")],
)
def test_host_of(spark, address, host):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(L.host_of(F.col("a")).alias("h")).first().h == host


def test_stage_keeps_rows_and_columns(spark):
    rows = [(1, TEXTS["en"], "en", "s", 7), (1, TEXTS["en"], "en", "s", 7), (2, TEXTS["de"], None, None, 7), (None, TEXTS["fr"], "fr", "s", 7), (3, None, "en", "s", 7), (4, "12 34", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, confidence int")
    out = L.keep_known(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "None"]
    assert L.keep_known(docs.limit(0)).count() == 0


def test_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = L.identify(docs, L.fit_on(docs, rows=60), ["doc_id", "lang"], host=F.col("source"))
    good = found.where("language = lang and accepted").count()
    assert good >= 0.99 * docs.count()


def test_rare_languages_are_sampled(spark, prose):
    """A language with three texts beside 300 of another is in the model though the sample is small."""
    rows = [(prose(i, 20), "en") for i in range(300)]
    rows += [(f"το σπίτι στο λόφο χτίστηκε από ανθρώπους {i}", "el") for i in range(3)]
    model = L.fit_on(spark.createDataFrame(rows, "text string, lang string"), rows=5)
    assert "el" in model.languages
    docs = spark.createDataFrame([(1, "το σπίτι των ανθρώπων χτίστηκε στο λόφο")], "id bigint, text string")
    assert [r.language for r in L.identify(docs, model, ["id"]).collect()] == ["el"]


def test_texts_are_scored_once_in_each_pass(spark, model, tmp_path, monkeypatch):
    """A filter on the evidence does not score every text again."""
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS.values())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "docs"))
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    staged = L.staged
    monkeypatch.setattr(L, "staged", kept)
    out = L.keep_known(spark.read.parquet(str(tmp_path / "docs")))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3]
    assert sorted(plan.count("ArrowEvalPython") for plan in plans) == [0, 1, 1]


def test_fitting_brings_counts_to_the_driver(spark, prose, monkeypatch):
    """No text of the sample leaves the tasks; the model is that of its texts, each once."""
    texts = [(prose(i, 30), "en") for i in range(40)] + [(t, k) for k, t in TEXTS.items()] + [("12 34", "xx")]
    docs = spark.createDataFrame([*texts, texts[0], (None, "en"), ("", "de")], "text string, lang string").repartition(4)
    brought = []
    for name in ("collect", "toArrow", "toPandas"):

        def noted(df, *args, real=getattr(type(docs), name)):
            brought.append(df.dtypes)
            return real(df, *args)

        monkeypatch.setattr(type(docs), name, noted)
    model = L.fit_on(docs)
    assert brought == [[("l", "string"), ("bucket", "bigint"), ("n", "bigint")]]
    expected = L.fit(*zip(*texts))
    assert model.languages == expected.languages == ["de", "en", "es", "fr", "xx"]
    assert np.array_equal(model.table, expected.table)
