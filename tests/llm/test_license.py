import numpy as np

from hookline.llm import license_scan as L

from . import data

NOTICES = {
    21: ("MIT", "Something else first.\nReleased under the MIT License.\n"),
    22: ("Apache-2.0", "text text\nLicensed under the Apache License, Version 2.0."),
    23: ("GPL", "This work is licensed under the GNU General Public License, version 3.\nand more"),
    24: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    25: ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    26: ("LGPL,MIT", "Released under the MIT License.\nYou can redistribute it under the terms of the GNU Lesser General Public License"),
    27: ("", "We talk about a driving licence and the general public here, under no terms at all."),
    28: ("", "The version of the work that the public saw was released in two parts."),
}


def test_notices_are_named_and_confirmed(spark):
    notes = spark.createDataFrame([(i, t) for i, (_, t) in NOTICES.items()], "doc_id long, text string")
    docs = data.documents(spark).select("doc_id", "text").where("doc_id < 21 OR doc_id > 28").unionByName(notes)
    got = {r.doc_id: r for r in L.licenses(docs).collect()}
    assert {i: got[i].license for i in NOTICES} == {i: f for i, (f, _) in NOTICES.items()}
    text = data.texts()
    cues = ("License", "licensed", "Licensed")
    others = [i for i in got if i not in NOTICES and not any(c in text[i] for c in cues)]
    assert len(others) > 100 and not any(got[i].grants for i in others)
    found = [i for i in got if i not in NOTICES and any(c in text[i] for c in cues)]
    assert all(got[i].grants for i in found)


def test_edge_cases_and_empty(spark):
    rows = L.licenses(data.edge_docs(spark)).collect()
    assert len(rows) == len(data.ROWS) and all(r.license == "" for r in rows)
    assert L.licenses(data.empty_docs(spark)).count() == 0


def test_plan_is_native(spark):
    plan = L.licenses(data.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_reserved_rights_and_wrapped_notices(spark):
    notes = {
        31: ("", "All-Rights-Reserved", 1, "Plain words first.\nAll rights reserved."),
        32: ("Apache-2.0", "Apache-2.0", 1, "Some text.\n\nLicensed under the Apache\nLicense, Version 2.0 (the License); you may\n"
             "not use this file except in compliance\n\nmore text"),
        33: ("MIT", "All-Rights-Reserved,MIT", 2, "All rights reserved.\nReleased under the MIT License."),
        34: ("MIT", "MIT", 1, "word " * 300 + "Permission is hereby granted, free of charge, to any person obtaining a copy "
             "of this software" + " other" * 300),
        35: ("", "", 0, "All of the old rights were, as some say, reserved for a few."),
        36: ("", "", 0, "Licensed under the\n\nMIT boats and harbours"),
    }
    rows = spark.createDataFrame([(i, x[-1]) for i, x in notes.items()], "doc_id long, text string")
    docs = data.documents(spark).select("doc_id", "text").where("doc_id < 31 OR doc_id > 36").unionByName(rows)
    got = {r.doc_id: (r.grants, r.license, r.n_notices) for r in L.licenses(docs).collect()}
    assert {i: got[i] for i in notes} == {i: x[:3] for i, x in notes.items()}
    text = data.texts()
    assert all(("All-Rights-Reserved" in got[i][1]) == ("All rights reserved" in text[i]) for i in got if i not in notes)


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    """A plain text gets no findings from a notice with the same id, or no id."""
    rows = [(7, "Released under the MIT License."), (7, "Plain words of no consequence here."),
            (None, "Licensed under CC BY-SA 4.0."), (None, "Other plain words."), (None, None)]
    docs = data.documents(spark).select("doc_id", "text").where("doc_id > 100").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.license) for r in L.licenses(docs).collect() if r.doc_id in (7, None)]
    assert sorted(got, key=str) == sorted([(7, "MIT"), (7, ""), (None, "CC-BY-SA"), (None, ""), (None, "")], key=str)


def test_passages_without_a_cue_are_never_named(spark, monkeypatch):
    """Findings with the cue words are those of scoring every passage."""
    docs = data.documents(spark).select(L.C.row_key().alias("key"), "text")
    model, limit = L.train(docs)

    def found():
        return sorted(tuple(r) for r in L.findings(docs, model, limit).collect())

    counted = L._counter(spark)
    some = L.cues(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), counted.vocabulary, limit)
    assert some and len(some) < len({w for g in counted.vocabulary for w in g.split(" ")})
    with_cues = found()
    monkeypatch.setattr(L, "cues", lambda *a: None)
    assert with_cues == found() and with_cues


def test_cues_bound_the_odds():
    vocabulary = ["a", "b", "a b", "c"]
    weights = np.array([[0.0, 0.0, 0.0, 1.0], [2.0, 0.2, 3.0, 0.0], [0.0, 0.4, 0.0, 0.0]])
    some = L.cues(weights, np.array([1.0, 0.0, 0.0]), vocabulary, 0.6)
    assert some == ["a"]  # without it: 0.2 and 0.4 of the log odds, against 1.4 and more
    assert L.cues(weights, np.array([0.0, 3.0, 0.0]), vocabulary, 0.6) is None


def test_passages_of_all_documents_teach_and_calibrate(spark, monkeypatch):
    """The unknown class rests on every passage, also of documents beyond the first hundreds."""
    docs = spark.range(1_200).selectExpr("id AS key", "concat('plain words of row ', id, '\\nand of no law') AS text")
    staged, stage = {}, L.C.stage
    monkeypatch.setattr(L.C, "stage", lambda df, name, *a: staged.setdefault(name, stage(df, name, *a)))
    L.train(docs)
    rows = staged["background"].collect()
    assert sum(r["n"] for r in rows) == 1_200 * 3 + 1  # two lines, a break, and the made-up passage
    weight = {bool(r.label): r.w for r in staged["notices"].groupBy("label").agg({"weight": "sum"}).toDF("label", "w").collect()}
    assert abs(weight[False] - L.UNKNOWN_WEIGHT) < 1e-6


def test_passages_keep_the_grams_of_templates(spark):
    docs = spark.createDataFrame([(1, "Some MIT license here\nunder no terms of the work"), (2, "")], "key long, text string")
    got = {(r.key, r.line, r.seam): sorted(r.grams) for r in L.passages(docs).collect()}
    known = set(L._counter(spark).vocabulary)

    def want(words):
        return sorted(g for g in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))} if g in known)

    first, second = "some mit license here".split(), "under no terms of the work".split()
    assert got == {(1, 0, False): want(first), (1, 1, False): want(second), (1, 1, True): want(first + second)}
    assert "mit license" in got[1, 0, False] and "some" not in got[1, 0, False]
