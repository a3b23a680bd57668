import re

import duckdb

from quirefold.llm import license_join as L, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(docs):
    out = []
    for doc_id, text in docs:
        w = _words(text)
        places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        found, best = set(), 0.0
        for line in (text or "").split("\n"):
            have = set(_words(line))
            for label, template in L.TEMPLATES:
                ws = L.template_words(template)
                shared = len(have & set(ws))
                if shared >= L.needed(len(ws)) and have >= set(L.names_of(label, template)):
                    found.add(label)
                    best = max(best, shared / len(ws))
        base = {label for _, label in places}
        starts = [i for i, _ in places]
        out.append((doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best))
    return sorted(out, key=repr)


def _got(spark, docs):
    return sorted((tuple(r) for r in L.scanned(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)


def test_equals_brute_force_around_the_threshold(spark):
    docs = []
    for n, (_, template) in enumerate(L.TEMPLATES):
        ws = L.template_words(template)
        for cut in range(len(ws) // 2 + 1):
            docs.append((100 * n + cut, "some line\n" + " x ".join(ws[cut:]).upper() + "\nMIT license"[: 12 * (cut % 2)]))
    docs += [(9001, None), (9002, ""), (9003, "MIT\nLicense, apache license. General public LICENSE mit license"), (9003, "MIT\nLicense"), (9004, "license " * 4000), (None, "the Apache License")]
    assert _got(spark, docs) == _plain(docs)


def test_the_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = queries.op5_license_scan(spark, sf_dir)
    want = con.sql(L.oracle_sql())
    columns = want.columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", "t", 3)], "doc_id long, text string, labels string, n_words int")
    assert [r["labels"] for r in L.scanned(docs).collect()] == ["cc-by-nc"]
    assert L.scanned(docs.where("false")).collect() == []


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "isc": " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0. If a copy",
}


def _windows(text):
    """Labels and best containment over every window of every template's length, one after the other."""
    w, found = _words(text), {}
    for label, template in L.TEMPLATES:
        ws = set(L.template_words(template))
        for i in range(len(w)):
            have = set(w[i : i + L.span(template)])
            c = len(ws & have)
            if c >= L.needed(len(ws)) and have >= set(L.names_of(label, template)):
                found[label] = max(found.get(label, 0), c / len(ws))
    return found


def test_wrapped_notices_are_found_as_a_whole(spark):
    docs = [(i, f"some text\n{notice}\nmore text") for i, notice in enumerate(WRAPPED.values())]
    docs += [(10, WRAPPED["bsd"].replace(" ", "\n")), (11, "free of\ncharge " * 400), (12, WRAPPED["isc"].replace("\n", "\n" + "x " * 60)), (None, WRAPPED["mpl"])]
    docs += [(20 + n, "a\n" + "\n".join(L.template_words(t)[cut:]) + "\nb") for n, (_, t) in enumerate(L.TEMPLATES) for cut in range(3)]
    got = sorted(((r["doc_id"], r["labels"], r["score"]) for r in L.scanned(spark.createDataFrame(docs, "doc_id long, text string")).where("n_base = 0").collect()), key=repr)
    want = [(i, ",".join(sorted(f)), max(f.values(), default=0.0)) for i, t in docs for f in [_windows(t)] if not any(p in " ".join(_words(t)) for p, _ in L.PHRASES)]
    assert got == sorted(want, key=repr)
    assert [x[1] for x in got if x[0] in range(4)] == list(WRAPPED) and (12, "", 0.0) in got


def test_variants_of_a_short_notice_keep_their_own_labels(spark):
    said = {"BY-SA": "cc-by-sa", "BY": "cc-by", "BY-ND": "cc-by-nd", "BY-NC": "cc-by-nc", "BY-NC-SA": "cc-by-nc,cc-by-sa"}
    docs, want = [], {}
    for n, (code, labels) in enumerate(said.items()):
        one = f"Licensed under CC {code} 4.0"
        for k, text in enumerate([f"x\n{one}.\ny", f"under CC {code} 4.0", f"x\n{one.replace('CC ', 'CC' + chr(10))} y", one.replace(" ", "\n"), f"{one}\nsa nd"]):
            docs.append((10 * n + k, text))
            want[10 * n + k] = labels
    docs += [(90, "Licensed under CC BY-SA 4.0\nLicensed under CC BY 4.0"), (None, "Licensed under CC BY-SA 4.0"), (91, "CC BY-NC")]
    want |= {90: "cc-by,cc-by-sa", None: "cc-by-sa", 91: ""}
    got = L.scanned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == want
    assert {r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] % 10 == 0 and r["doc_id"] < 90} == {1.0}


def test_other_licenses_of_the_same_wording_get_no_false_label(spark):
    texts = [
        "Licensed under the Educational Community License, Version 2.0",
        "Licensed under the Open Software License version 2.0",
        "Licensed under the\nEclipse Public License, Version 2.0",
        "This Source Code Form is subject to the terms of the Common Public License, v. 2.0",
        "Licensed under CC 4.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at example.org",
    ]
    got = L.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r["labels"], r["score"]) for r in got] == [("", 0.0)] * len(texts)


def test_a_very_long_text_is_scanned_to_its_end(spark):
    text = "some words and more\n" * 60_000 + WRAPPED["bsd"]
    (row,) = L.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["labels"] == "bsd" and row["n_words"] > 240_000
