import random
from collections import Counter

from corpusquery.llm.line_rules import clean_documents, line_quality


def measures(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    return {r.doc_id: r for r in line_quality(docs).collect()}


def expected(text):
    words = (text or "").replace("\x0b", " ").replace("\f", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_agree_with_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h " * 3, "x\nx\n\n \nx", "é😀 ü\x0bq\x85z #&|"]
    for _ in range(30):
        words = [rng.choice("abcd") for _ in range(rng.randrange(120))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    texts.append("word other. " * 40_000)
    got = measures(spark, *texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected(t), t


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."


def test_lines_go_first_and_heavy_losers_are_rejected(spark):
    nav = "Home | News | Sport | Contact"
    clean = prose(60)
    mixed = f"{nav}\n{clean}\n\nAccept all cookies.\nno end\n### *** $$$ %%% &&& x.\nSaid \"so.\""
    lost = "\n".join(prose(4, k)[:-1] for k in range(30)) + "\n" + prose(20, 9)
    got = measures(spark, clean, mixed, lost, prose(19), "a b c d e f g h. " * 30)
    assert [got[i].kept for i in range(5)] == [True, True, False, False, False]
    assert [got[i].base_failed for i in range(5)] == [False, False, False, True, True]
    assert got[0].cleaned == clean
    assert got[1].cleaned == f"{clean}\n\nSaid \"so.\""


def test_clean_texts_of_any_layout_are_kept(spark):
    one_line = " ".join(prose(8, k) for k in range(27))[:-1]  # the last sentence lacks its mark
    wrapped = "\n".join(" ".join(prose(40, k).split()[i : i + 10]) for k in range(5) for i in range(0, 40, 10))
    thai = "\n".join("ภาษาไทยไม่มีเครื่องหมายจบประโยค " * 8 for _ in range(4))
    armenian = "\n".join(f"{prose(3, k)[:-1]}։" for k in range(10))
    got = measures(spark, one_line, wrapped, thai, armenian)
    assert [got[i].cleaned for i in range(4)] == [one_line, wrapped, thai, armenian]
    assert [got[i].kept for i in (0, 1, 3)] == [True, True, True]


def test_the_rules_are_evaluated_once(documents):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = documents(prose(40))
    assert plan(clean_documents(docs)).count("(cookies") == plan(line_quality(docs)).count("(cookies") > 0


def test_clashing_columns(spark):
    ddl = "doc_id long, Text string, quality int, quality_ string, _q string"
    docs = spark.createDataFrame([(1, prose(40), 7, "a", "b")], ddl)
    out = clean_documents(docs)
    assert out.columns == docs.columns and tuple(out.first()) == tuple(docs.first())
    assert line_quality(docs).first().quality == 7


def test_cleaned_documents_keep_their_columns(spark, documents):
    docs = documents(prose(40) + "\na | b | c | d", None, "short")
    out = clean_documents(docs.unionAll(docs))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [(0, prose(40), len(prose(40)))] * 2
    assert clean_documents(docs.limit(0)).collect() == []
