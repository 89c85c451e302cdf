import random
import textwrap

import duckdb

from barline.llm import licenses


def test_same_as_sql(spark):
    texts = [None, "", "\n\n", "RELEASED under the mit license", "word\nLicensed under CC BY-NC 4.0.\nword", "Licensed under the Apache License Version 2", "é İ x",
             "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "a " * 40_000, licenses.TEMPLATES["gpl-3.0-header"].replace(", ", ",\n"), "same the same", "same the same"]
    df = spark.createDataFrame([(i // 2, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, license string, dice double")
    got = sorted(map(tuple, licenses.scanned(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("docs", df.toPandas())
    assert got == sorted(con.execute(licenses.oracle("docs")).fetchall(), key=repr)
    assert sorted(str(r[1]) for r in got if r[0] == 1) == ["None", "mit"]
    assert sum(r[1] is not None for r in got) == 5
    assert licenses.scanned(df.limit(0)).collect() == []


def test_units_at_the_threshold(spark):
    units = []
    for text in licenses.TEMPLATES.values():
        words, t = text.split(), len(licenses.template_pairs(text))
        units += [" ".join(words + [f"more{i}" for i in range(n)]) for n in range(t // 2 - 1, t // 2 + 2)]
        units += [" ".join(words[:n]) for n in range(len(words) - t // 3 - 2, len(words) + 1)]
    df = spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scanned(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("docs", df.toPandas())
    assert got == sorted(con.execute(licenses.oracle("docs")).fetchall(), key=repr)
    assert sum(r[2] == 0.8 for r in got) >= 4


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scanned(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("docs", df.toPandas())
    assert got == sorted(con.execute(licenses.oracle("docs")).fetchall(), key=repr)
    return {r[0]: r for r in got}


def test_wrapped_and_inner_notices_of_long_texts(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("river stone music under license the work window garden".split()) for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    wrapped = [prose(400) + "\n" + textwrap.fill(licenses.TEMPLATES[n], 60).replace("\n", "\n * ") + "\n" + prose(400) for n in names]
    inner = [prose(200) + " " + licenses.TEMPLATES[n] + " " + prose(200) for n in names]
    got = check(spark, wrapped + inner + [prose(2000)])
    for i, name in enumerate(names * 2):
        # The header begins with the whole of the shorter notice.
        assert got[i][1] in (name, name.removesuffix("-header")) and got[i][2] == 1.0, (name, got[i])
    assert got[2 * len(names)][1] is None


def test_windows_overlap_and_end_with_the_text(spark):
    texts = ["released under the released under the mit license", "it is released under the", "x released under the mit licence\nreleased under the mit license"]
    got = check(spark, texts + ["Released under the MIT License. " * 300, "permission is hereby " * 2_000])
    assert [got[i][1] for i in range(3)] == ["mit", None, "mit"] and got[3][3] >= 300 and got[4][1] is None
