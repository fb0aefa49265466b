from pagesig.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["license"], r["edits"]) for r in licenses.scan(df).collect()}


def test_every_template_is_found_in_prose(spark):
    texts = [f"Some words before it.\n{t}\nand after it" for _, t in licenses.TEMPLATES]
    got = scan(spark, texts)
    assert {(i, n, 0) for i, (n, _) in enumerate(licenses.TEMPLATES)} <= got


def test_wording_decides(spark):
    got = scan(spark, [
        "licensed under the apache license version 2.0", "Licensed under the Apache License, Version 1.1.",
        "This work is licenced under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-SA 4.0.", "A licensed driver has permission to park here.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public "
        "License as published by our Free Software Foundation, either version 3 of the License"])
    # a share of MAX_EDITS of a template's words may differ
    assert got == {(0, "Apache-2.0", 0), (2, "GPL-3.0", 1), (3, "GPL-2.0", 0), (4, "CC-BY-SA-4.0", 0), (6, "GPL-3.0", 3)}


def test_edited_and_missing_cues(spark):
    got = scan(spark, [
        "Please note: this work is licenced under the GNU General Public License, version 3.",
        "Source code. This work is under the GNU General Public License, version 3. Have fun.",
        "Approval is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction. Permission is hereby granted, free of charge, to any "
        "person obtaining a copy of this software and its associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
        "This work is not licenced under the GNU General Public License, version 3.",
        "This work is licenced under the GNU General Public License, version 4.",
        "Software is free and unencumbered and was releasd into the public domain."])
    assert got == {(0, "GPL-3.0", 1), (1, "GPL-3.0", 1), (2, "MIT", 1)}


def test_all_lines_of_the_documents(docs):
    want = {r["doc_id"] for r in docs.collect() for line in r["text"].split("\n") if line in {t for _, t in licenses.TEMPLATES}}
    assert want <= {r["doc_id"] for r in licenses.scan(docs).collect()}


def test_odd_rows(odd, empty):
    assert licenses.scan(odd).collect() == [] and licenses.scan(empty).collect() == []
