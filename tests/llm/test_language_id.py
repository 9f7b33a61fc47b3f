import random

from pyspark.sql import functions as F

from corpusquery.llm.language_id import fit_text_model, identify_languages, text_evidence, visible_text

WORDS = {
    "de": "der die und nicht ist ein eine schön für über auch werden haben keine zwischen".split(),
    "en": "the and not is with this that which have been would there their about from".split(),
    "fr": "le les est une dans pour avec sur plus être même très déjà où cette".split(),
}


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def labelled(spark, n=40):
    rng = random.Random(1)
    rows = [(i, prose(lang, 60, rng), lang) for i, lang in enumerate([*WORDS] * n)]
    rows += [(9000, None, "en"), (9001, "x", None), (9002, "", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_text_outside_of_markup():
    html = "<html><script>var x = '<p>';</script><STYLE>p{}</STYLE><p>a<b>c</b></p><!-- n --> d < e <script>open"
    assert visible_text(html).split() == ["a", "c", "d", "<", "e"]
    assert visible_text("<" * 100_000).strip("<") == ""


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    languages, model = fit_text_model(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0").select("lang", F.col("text").alias("html"))
    rows = text_evidence(held, model).collect()
    right = sum(languages[r.evidence.index(max(r.evidence))] == r.lang for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


def test_evidence_is_fused(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        rows.append((i, f"http://a.de/{i}", f'<html lang="de"><p>{prose("de", 50, rng)}'))
        rows.append((100 + i, f"http://b.fr/{i}", f'<html lang="fr"><p>{prose("fr", 50, rng)}'))
    rows += [
        (200, "http://b.fr/x", "<p>12345"),  # host only
        (201, "http://c.de/x", None),  # suffix only
        (202, None, '<html class=x lang="fr-FR">'),  # declaration only
        (203, "http://b.fr/y", f'<html lang="de"><p>{prose("de", 50, rng)}'),  # text against host
        (204, "http://a.de/z", f'<html lang="xx"><p>{prose("fr", 200, rng)}'),
        (204, "http://a.de/z", f'<html lang="xx"><p>{prose("fr", 200, rng)}'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("language", F.lit("?"))
    out = identify_languages(pages, labelled(spark))
    assert out.columns == ["page_id", "url", "host", "suffix", "declared", "text_language", "language", "confidence"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == 85 and out.count() == 86
    assert all(got[i].language == ("de" if i < 100 else "fr") for i in got if i < 200)
    assert [got[i].language for i in range(200, 205)] == ["fr", "de", "fr", "de", "fr"]
    assert (got[202].declared, got[202].host, got[204].declared, got[201].declared) == ("fr", "", "xx", None)
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.de/", "<p>x")], "page_id long, url string, html string")
    docs = labelled(spark)
    assert identify_languages(pages.limit(0), docs).collect() == []
    row = identify_languages(pages, docs.limit(0)).first()
    assert (row.language, row.confidence, row.suffix) == (None, None, "de")
