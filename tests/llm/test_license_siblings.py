from lodestone.llm import licenses

GNU = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version 2 of the License, or any later version."
CC = "This work is licensed under a Creative Commons Attribution{} International License"
CASES = [
    *[(t.text, t.label) for t in licenses.TEMPLATES],
    (GNU.replace("library", "program").format("General Public License"), "gpl"),
    (GNU.format("Lesser General Public License"), "lgpl"), (GNU.format("Library General Public License"), "lgpl"), (GNU.format("Affero General Public License"), ""),
    (GNU.replace("library", "program").format("Lesser General Public License"), "lgpl"),
    (CC.format(" 4.0"), "cc-by"), (CC.format(" 3.0"), "cc-by"), (CC.format("-NonCommercial 4.0"), "cc-by-nc"), (CC.format("-ShareAlike 4.0"), "cc-by-sa"),
    (CC.format("-Non-Commercial 4.0"), "cc-by-nc"), (CC.format("-Share Alike 3.0"), "cc-by-sa"), (CC.format("-NoDerivatives 4.0"), ""), (CC.format("-NonCommercial-ShareAlike 4.0"), "cc-by-nc,cc-by-sa"),
    (CC.format(" 4.0") + ". The figures: " + CC.format("-NonCommercial 4.0"), "cc-by,cc-by-nc"),
]


def test_siblings_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert [(CASES[i][0], got[i]) for i in sorted(got)] == CASES
