import random

from tests.llm import cases
from tests.oracle import compare
from waymark.llm import quality as Q
from waymark.llm.queries import op2_line_frequency

D = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


def pages(n=60):
    """Texts on two hosts, each with a menu line; some have little else, and one text is copied many times."""
    rng = random.Random(5)
    prose = lambda k: " ".join(f"w{rng.randint(0, 10**6)}x" for _ in range(k))
    menu = "Home | About | Contact 2024 " + " ".join("link" + chr(97 + i) for i in range(24))
    rows = [(i, f"{menu}\n{prose(60)}\n", "a") for i in range(n)]
    rows += [(100 + i, f"{menu.replace('2024', '1999').upper()}\n{prose(3)}", "a") for i in range(5)]
    rows += [(200 + i, f"{prose(60)}\n{menu}", "b") for i in range(15)] + [(300 + i, prose(40), "b") for i in range(40)]
    copy = prose(50)
    return rows + [(400 + i, copy, "b") for i in range(50)] + [(500, prose(30) + "\n" + prose(30), None)]


def test_against_sql(spark, tmp_path):
    compare(spark, op2_line_frequency, Q.sql(), D)
    odd = cases.odd(spark).select("doc_id", "text", "source").union(spark.createDataFrame(pages(), DOCS))
    odd = odd.union(spark.createDataFrame([(600, "a b c d e f g h i a b c d e f g h x\n \na b\n a b\na b", "c"), (601, "# *$%&|<> é😀", "c")], DOCS))
    compare(spark, op2_line_frequency, Q.sql(), cases.write(spark, tmp_path, documents=odd), ("documents",))
    assert op2_line_frequency(spark, cases.write(spark, tmp_path / "e", documents=cases.none(spark))).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(*r, "x") for r in pages()], DOCS + ", kept string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert all(got[i].kept and got[i].removed_words == 30 for i in range(60))
    assert not any(got[100 + i].kept for i in range(5))
    assert all(got[i].kept and not got[i].removed for i in (200, 300, 400, 449, 500))
    out = {r.doc_id: r for r in Q.apply(df).collect()}
    assert out.keys() == {i for i, r in got.items() if r.kept}
    assert "Home" not in out[0].text and out[0].text.endswith("\n") and "Home" in out[200].text and out[0].kept == "x"


def test_hot_host(spark):
    """A line in 30 of a host's 400 different texts, less than a tenth of them, goes as it does on a small host."""
    rng = random.Random(6)
    prose = lambda k: " ".join(f"w{rng.randint(0, 10**6)}x" for _ in range(k))
    foot = "All rights reserved by the owners of this page and its friends"
    rows = [(i, f"{prose(40)}\n{foot}" if i < 30 else prose(40), "hot") for i in range(400)]
    rows += [(500 + i, f"{prose(40)}\n{foot} rare", "hot") for i in range(19)]
    got = {r.doc_id: r for r in Q.apply(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any("rights" in got[i].text for i in range(30)) and all("rights" in got[500 + i].text for i in range(19))
    found = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[i].removed_words == 12 for i in range(30)) and all(found[500 + i].removed_words == 0 for i in range(19))


def test_repeat_words():
    rng = random.Random(2)
    docs = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))] for _ in range(200)]
    for w, n in zip(docs, Q.repeat_words(docs).tolist(), strict=True):
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert n == len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)})
